"""Predicates on items, symbols and paths. An absent filter adds no predicate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import glob_regex

# The globs of an index run without its own.
INCLUDE = ("**/*.java", "**/*.sql", "**/*.md")
EXCLUDE = (".git", "target", "build", "dist", "node_modules", ".venv", "__pycache__")
#: the columns a keyword may be found in; column names and metadata are scored, but make no candidate
KEYWORD_COLUMNS = ("title", "content", "summary", "symbol", "table_name", "heading_path", "path")
# The symbol kinds of an asset type.
KINDS = {
    "code": ("annotation_type", "class", "constructor", "enum", "field", "interface", "method", "record"),
    "db_schema": ("table", "column"),
    "doc": (),
}


def item_filter(
    df: DataFrame,
    *,
    repo: str | None = None,
    asset_type: str | None = None,
    path_prefix: str | None = None,
    path: str | None = None,
    language: str | None = None,
    symbol_types: Sequence[str] | None = None,
    table: str | None = None,
    commit_sha: str | None = None,
) -> DataFrame:
    """Prefixes are literal: neither _ nor % stands for anything else."""
    equal = {"repo": repo, "asset_type": asset_type, "path": path, "language": language, "table_name": table, "commit_sha": commit_sha}
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    if path_prefix is not None:
        df = df.where(F.col("path").startswith(path_prefix))
    return df.where(F.col("symbol_type").isin(*symbol_types)) if symbol_types else df


def symbol_filter(df: DataFrame, repo: str, *, path: str | None = None, path_prefix: str | None = None, language: str | None = None, kinds: Sequence[str] | None = None, commit_sha: str | None = None) -> DataFrame:
    df = df.where(F.col("repo") == repo)
    for column, value in {"path": path, "language": language, "commit_sha": commit_sha}.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    if path_prefix is not None:
        df = df.where(F.col("path").startswith(path_prefix))
    return df.where(F.col("kind").isin(*kinds)) if kinds else df


def list_symbols(df: DataFrame, repo: str, **filters) -> DataFrame:
    return symbol_filter(df, repo, **filters).orderBy("qualified_name", "symbol_id")


def list_items(df: DataFrame, **filters) -> DataFrame:
    return item_filter(df, **filters).orderBy("id", "repo")


def get_item(df: DataFrame, item_id: str, repo: str | None = None) -> DataFrame:
    """The item, or without a repo the first by repo."""
    return item_filter(df, repo=repo).where(F.col("id") == item_id).orderBy("repo").limit(1)


def first_by_repo(df: DataFrame) -> DataFrame:
    """get_item without a repo, for every id at once."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("repo"))).where("k = 1").drop("k")


def list_paths(df: DataFrame, repo: str | None = None, path_prefix: str | None = None) -> DataFrame:
    return item_filter(df, repo=repo, path_prefix=path_prefix).where("path is not null").select("path").distinct().orderBy("path")


def included(path: Column, patterns: Sequence[str] = INCLUDE) -> Column:
    """Whether any glob matches; **/x matches x at the root too."""
    tails = [p[3:] for p in patterns if p.startswith("**/")]
    return _any([path.rlike(glob_regex(p)) for p in (*patterns, *tails)])


def excluded(path: Column, patterns: Sequence[str] = EXCLUDE) -> Column:
    """Whether a pattern is a part of the path, or matches it all; excluding beats including."""
    parts = F.split(path, "/")
    return _any([F.array_contains(parts, p) | path.rlike(glob_regex(p)) for p in patterns])


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def haystack() -> Column:
    """The keyword columns in lower case, apart from each other."""
    return F.concat_ws("\x01", *[F.lower(F.coalesce(c, F.lit(""))) for c in KEYWORD_COLUMNS])


def match_count(text: Column, tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: F.contains(text, t)))


def unfit(df: DataFrame) -> DataFrame:
    """Rows that break an invariant of items, with the first broken one as reason; the others may be stored."""
    kind = F.col("asset_type")
    rules = [
        ("empty identity", F.coalesce(F.length("id"), F.lit(0)) == 0),
        ("no repo", F.coalesce(F.length("repo"), F.lit(0)) == 0),
        ("empty text", F.exists(F.array("title", "content", "summary"), lambda x: F.coalesce(F.length(x), F.lit(0)) == 0)),
        ("unknown asset type", ~F.coalesce(kind.isin("code", "db_schema", "doc"), F.lit(False))),
        ("asset type is not source type", ~kind.eqNullSafe(F.col("source_type"))),
        ("line below 1", F.coalesce(F.least("start_line", "end_line") < 1, F.lit(False))),
        ("reversed lines", F.coalesce(F.col("end_line") < F.col("start_line"), F.lit(False))),
        ("code without place", (kind == "code") & (F.col("path").isNull() | F.col("start_line").isNull() | F.col("end_line").isNull())),
        ("schema without table", (kind == "db_schema") & F.col("table_name").isNull()),
        ("doc without place", (kind == "doc") & (F.col("path").isNull() | F.col("heading_path").isNull() | F.col("start_line").isNull() | F.col("end_line").isNull())),
    ]
    reason = F.coalesce(*[F.when(broken, name) for name, broken in rules])
    return df.withColumn("reason", reason).where("reason is not null")
