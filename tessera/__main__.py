"""python -m tessera index|eval|search: index a tree, judge golden tasks, ask one query."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import functions as F

from tessera.operators.evaluate import MIN_HIT_RATE, TOP_K
from tessera.operators.filters import EXCLUDE, INCLUDE
from tessera.plans import settings
from tessera.plans.evaluation import evaluate
from tessera.plans.ingest import index_tree, summary_json
from tessera.plans.service import Engine, RequestError
from tessera.plans.store import Store
from tessera.plans.tables import session
from tessera.sources import aliases, golden

PASSED, FAILED, WRONG = 0, 1, 2


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index a source tree")
    index.add_argument("--root", required=True)
    index.add_argument("--repo", help="default: the name of the root")
    index.add_argument("--path", action="append", help="only this file or directory; may be repeated")
    index.add_argument("--include", action="append")
    index.add_argument("--exclude", action="append")
    index.add_argument("--dry-run", action="store_true")
    index.add_argument("--with-embedding", action="store_true")
    for name in ("provider", "base-url", "api-key", "model", "dimension", "batch-size"):
        index.add_argument(f"--embedding-{name}")
    judge = commands.add_parser("eval", help="judge golden tasks")
    judge.add_argument("--tasks", required=True)
    judge.add_argument("--expected-commit")
    judge.add_argument("--repo")
    judge.add_argument("--top-k", type=int, default=TOP_K)
    judge.add_argument("--min-hit-rate", type=float, default=MIN_HIT_RATE)
    judge.add_argument("--format", choices=("text", "markdown", "json"), default="text")
    judge.add_argument("--output")
    judge.add_argument("--validate-only", action="store_true")
    ask = commands.add_parser("search", help="one query; the answer as JSON lines")
    ask.add_argument("text")
    ask.add_argument("--kind", choices=("code", "db_schema", "doc"), default="code")
    ask.add_argument("--repo")
    ask.add_argument("--limit", type=int, default=10)
    for command in (index, judge, ask):
        command.add_argument("--store", help=f"default: {settings.PREFIX}STORE")
    return top


def main(argv: Sequence[str] | None = None, out=None, env=None, spark=None) -> int:
    out, args = out or sys.stdout, _parser().parse_args(argv)
    env = dict(os.environ if env is None else env)
    if args.store:
        env[settings.PREFIX + "STORE"] = args.store
    if args.command == "index":
        for name in ("provider", "base_url", "api_key", "model", "dimension", "batch_size"):
            if value := getattr(args, f"embedding_{name}"):
                env[f"{settings.PREFIX}EMBEDDING_{name.upper()}"] = value
    try:
        if args.command == "eval" and args.validate_only:
            spark = spark or session()
            samples = golden.from_file(spark, args.tasks)
            out.write(f"valid: {args.tasks} ({samples.select('sample_group').distinct().count()} groups, {samples.count()} samples)\n")
            return PASSED
        config = settings.load(env, embeddings=args.command != "index" or args.with_embedding)
        if args.command == "index" and args.with_embedding and config.provider is None:
            raise settings.SettingsError("embeddings are wanted, but there are no embedding settings")
        spark = spark or session()
        store = Store(spark, config.store)
        if args.command == "index":
            repo = args.repo or os.path.basename(os.path.realpath(args.root))
            run = index_tree(spark, args.root, repo, store, paths=args.path, include=args.include or INCLUDE, exclude=args.exclude or EXCLUDE, provider=config.provider, dry_run=args.dry_run)
            out.write(summary_json(run))
            return FAILED if run.failed else PASSED
        vocabulary = aliases.from_file(spark, config.alias_file) if config.alias_file else None
        engine = Engine(store.read("items"), store.read("symbols"), store.read("embeddings"), provider=config.provider, aliases=vocabulary, default_repo=config.default_repo, require_repo=config.require_repo)
        if args.command == "search":
            search = {"code": engine.search_code, "db_schema": engine.search_db_schema, "doc": engine.search_doc}[args.kind]
            answer = search(args.text, args.limit, {"repo": args.repo} if args.repo else None)
            columns = ("rank", "score", "repo", "id", "path", "start_line", "end_line", "match_reason")
            for r in answer.results.orderBy("rank").select(*columns, F.col("score_parts")).collect():
                out.write(json.dumps(r.asDict(recursive=True), ensure_ascii=False) + "\n")
            return PASSED
        report = evaluate(engine, golden.from_file(spark, args.tasks), repo=args.repo, commit_sha=args.expected_commit, top_k=args.top_k, min_hit_rate=args.min_hit_rate)
        text = report.text(args.format) + "\n"
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            out.write(text)
        return PASSED if report.passed else FAILED
    except (ValueError, OSError, RequestError) as x:
        sys.stderr.write(f"error: {x}\n")
        return WRONG


if __name__ == "__main__":
    sys.exit(main())
