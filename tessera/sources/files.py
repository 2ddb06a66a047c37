"""Scanning a source tree and parsing its files into items and symbols."""

from __future__ import annotations

import os
import subprocess
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.filters import EXCLUDE, INCLUDE, excluded, included
from tessera.sources import ddl, java, markdown
from tessera.sources.schema import ITEM, SYMBOL, names

PARSERS = {".java": java.parse, ".sql": ddl.parse, ".md": markdown.parse}
FAILURE = "path string, stage string, error string"


@dataclass(frozen=True)
class Scope:
    """What a run covers: everything, or directories and single files."""

    shown: tuple[str, ...] = (".",)
    everything: bool = True
    prefixes: frozenset[str] = frozenset()
    files: frozenset[str] = frozenset()
    failures: tuple[tuple[str, str, str], ...] = ()

    def covers(self, path: Column) -> Column:
        if self.everything:
            return F.lit(True)
        cond = path.isin(*sorted(self.files)) if self.files else F.lit(False)
        for p in sorted(self.prefixes):
            cond = cond | path.startswith(p)
        return cond


def scope(root: str, paths: Sequence[str] | None = None) -> Scope:
    """Paths outside the root are failures; the others count."""
    if not paths:
        return Scope()
    base = os.path.realpath(root)
    prefixes, files, shown, failures, everything = set(), set(), set(), [], False
    for raw in paths:
        real = os.path.realpath(os.path.join(base, raw))
        relative = os.path.relpath(real, base).replace(os.sep, "/")
        if relative == ".":
            everything = True
        elif relative.startswith(".."):
            failures.append((str(raw), "config", "--path must stay within --root"))
            continue
        elif os.path.isdir(real):
            prefixes.add(relative + "/")
        else:
            files.add(relative)
        shown.add(relative)
    return Scope(tuple(sorted(shown)), everything, frozenset(prefixes), frozenset(files), tuple(failures))


@dataclass(frozen=True)
class Provenance:
    """What a run stamps on its rows."""

    branch: str | None = None
    commit_sha: str | None = None
    indexed_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    index_batch_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    warnings: tuple[str, ...] = ()


def git_provenance(root: str, timeout: float = 3.0) -> Provenance:
    """Branch and commit of the tree; null with a warning where git can't tell."""
    values, warnings = {}, []
    for name, args in (("branch", ("rev-parse", "--abbrev-ref", "HEAD")), ("commit_sha", ("rev-parse", "HEAD"))):
        try:
            values[name] = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout, check=True).stdout.strip() or None
        except (OSError, subprocess.SubprocessError) as x:
            values[name] = None
            warnings.append(f"{name}: {type(x).__name__}")
    return Provenance(values["branch"], values["commit_sha"], warnings=tuple(warnings))


def scan(spark: SparkSession, root: str, within: Scope = Scope(), include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE) -> DataFrame:
    """(path, content, file_hash) of the files in scope, content as bytes. Only files with a suffix of the globs are opened, if all have one."""
    base = os.path.realpath(root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    suffixes = {p.rpartition("*.")[2] for p in include}
    if all(s.isalnum() and p.endswith("*." + s) for s, p in zip((p.rpartition("*.")[2] for p in include), include)):
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(sorted(suffixes)) + "}")
    files = reader.load(f"file://{base}")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/*" + _escape(base.lstrip("/")) + "/", "")
    rows = files.withColumn("path", path)
    rows = rows.where(within.covers(F.col("path")) & included(F.col("path"), include) & ~excluded(F.col("path"), exclude))
    return rows.select("path", "content", F.sha2("content", 256).alias("file_hash"))


def _escape(text: str) -> str:
    return r"\Q" + text + r"\E"


def decoded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, text, file_hash) of valid UTF-8 files, and the others as failures."""
    rows = files.withColumn("ok", F.col("content").isNotNull() & F.is_valid_utf8(F.col("content").cast("string")))
    good = rows.where("ok").select("path", F.decode("content", "UTF-8").alias("text"), "file_hash")
    return good, rows.where("not coalesce(ok, false)").select("path", F.lit("read").alias("stage"), F.lit("not valid UTF-8").alias("error"))


def parsed(files: DataFrame, wanted: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(path, file_hash, failed, items, symbols): each file's rows as arrays, or why it couldn't be parsed. wanted: the kinds and columns to keep, else all."""
    columns = {}
    for kind, schema in (("items", ITEM), ("symbols", SYMBOL)):
        if wanted is None or kind in wanted:
            columns[kind] = {n: t for n, t in (x.split() for x in schema.split(", ")) if n not in PROVENANCE and (wanted is None or n in wanted[kind])}
    texts = not {"content", "metadata"}.isdisjoint(columns.get("items", ()))
    parsers = PARSERS if texts else PARSERS | {".java": partial(java.parse, texts=False)}

    def run(batches):
        for pdf in batches:
            out = []
            for path, text, file_hash in zip(pdf["path"], pdf["text"], pdf["file_hash"]):
                suffix = os.path.splitext(path)[1].lower()
                try:
                    found = dict(zip(("items", "symbols"), parsers[suffix](path, text) if suffix in parsers else ([], [])))
                    out.append((path, file_hash, None, *([{n: x.get(n) for n in kept} for x in found[kind]] for kind, kept in columns.items())))
                except Exception as x:  # one bad file must not stop the others
                    out.append((path, file_hash, str(x)[:500], *([] for _ in columns)))
            yield pd.DataFrame(out, columns=["path", "file_hash", "failed", *columns])

    arrays = [f"{kind} array<struct<{', '.join(f'{n}:{t}' for n, t in kept.items())}>>" for kind, kept in columns.items()]
    return files.select("path", "text", "file_hash").mapInPandas(run, ", ".join(["path string, file_hash string, failed string", *arrays]))


#: columns stamped after parsing
PROVENANCE = ("repo", "branch", "commit_sha", "file_hash", "indexed_at", "index_batch_id")


def stamped(files: DataFrame, kind: str, repo: str, provenance: Provenance) -> DataFrame:
    """The items or symbols of parsed files with repo and provenance, and seq, their order within the file."""
    schema = ITEM if kind == "items" else SYMBOL
    rows = files.select("file_hash", F.posexplode(kind).alias("seq", "row")).select("file_hash", "seq", "row.*")
    stamp = {"repo": F.lit(repo), "branch": F.lit(provenance.branch).cast("string"), "commit_sha": F.lit(provenance.commit_sha).cast("string"), "indexed_at": F.lit(provenance.indexed_at).cast("timestamp"), "index_batch_id": F.lit(provenance.index_batch_id)}
    return rows.withColumns(stamp).select(*names(schema), "seq")
