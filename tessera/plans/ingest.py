"""An index run: scan, parse, compare with what is stored, write what changed."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.filters import EXCLUDE, INCLUDE, excluded, included
from tessera.operators.incremental import plan
from tessera.plans.settings import redacted
from tessera.plans.store import Store, cascade, last_wins, upsert, without_paths
from tessera.plans.tables import materialize
from tessera.sources.files import FAILURE, Provenance, decoded, git_provenance, parsed, scan, scope, stamped
from tessera.sources.providers import Provider, embedded
from tessera.sources.schema import KEYS, names, SCHEMAS


@dataclass(frozen=True)
class Run:
    """What a run did; failed means exit code 1."""

    summary: dict
    plan: DataFrame

    @property
    def failed(self) -> bool:
        return bool(self.summary["failures"])


def index_tree(
    spark: SparkSession,
    root: str,
    repo: str,
    store: Store,
    *,
    paths: Sequence[str] | None = None,
    include: Sequence[str] = INCLUDE,
    exclude: Sequence[str] = EXCLUDE,
    provider: Provider | None = None,
    provenance: Provenance | None = None,
    dry_run: bool = False,
) -> Run:
    """Index the files of a tree. Files that cannot be read or parsed keep their stored rows; the other files go on."""
    if not repo:
        raise ValueError("repo must not be empty")
    began = time.perf_counter()
    within, provenance = scope(root, paths), provenance or git_provenance(root)
    files, unread = decoded(scan(spark, root, within, include, exclude))
    done = materialize(parsed(files), "parsed")
    good = done.where("failed is null")
    errors = unread.unionByName(done.where("failed is not null").select("path", F.lit("index").alias("stage"), F.col("failed").alias("error")))
    errors = materialize(errors.select(*names(FAILURE)), "failures")

    items, symbols, embeddings = (store.read(t) for t in SCHEMAS)
    covered = within.covers(F.col("path")) & included(F.col("path"), include) & ~excluded(F.col("path"), exclude)
    stored = items.where((F.col("repo") == repo) & covered)
    changes = materialize(plan(good.select("path", "file_hash", F.size("items").alias("items")), stored.select("path", "file_hash"), errors.select("path")), "plan")
    changed, deleted = (changes.where(F.col("change") == c).select("path") for c in ("changed", "deleted"))
    fresh = good.join(changed, "path", "left_semi")

    def rows_of(df: DataFrame, of: DataFrame) -> int:
        return df.where(F.col("repo") == repo).join(of, "path", "left_semi").count()

    sizes = good.agg(F.count_if(F.size("items") > 0).alias("files"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("items"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).alias("symbols")).first()
    counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    new = fresh.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("items"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).alias("symbols")).first()
    summary = {
        "repo": repo, "database": redacted(store.root), "scope_paths": list(within.shown), "files_scanned": done.count() + errors.where("stage = 'read'").count(), "files_indexed": sizes.files,
        "files_changed": counts.get("changed", 0), "files_unchanged": counts.get("unchanged", 0), "files_deleted": counts.get("deleted", 0), "items_estimated": sizes["items"], "symbols_estimated": sizes.symbols,
        "items_written": 0 if dry_run else new["items"], "symbols_written": 0 if dry_run else new.symbols, "items_deleted": rows_of(items, deleted), "symbols_deleted": rows_of(symbols, deleted), "embedding_written": 0,
        "branch": provenance.branch, "commit_sha": provenance.commit_sha, "indexed_at": provenance.indexed_at.isoformat().replace("+00:00", "Z"), "index_batch_id": provenance.index_batch_id, "provenance_warnings": list(provenance.warnings),
    }
    failures = [r.asDict() for r in errors.orderBy("path").collect()] + [dict(zip(names(FAILURE), f)) for f in within.failures]
    if not dry_run and (counts.get("changed") or counts.get("deleted")):
        stale = changed.unionByName(deleted)
        new_items = materialize(last_wins(stamped(fresh, "items", repo, provenance), KEYS["items"], "seq").drop("seq"), "items")
        new_symbols = last_wins(stamped(fresh, "symbols", repo, provenance), KEYS["symbols"], "seq").drop("seq")
        kept = without_paths(items, repo, stale)
        tables = {"items": upsert(kept, new_items, KEYS["items"]), "symbols": upsert(without_paths(symbols, repo, stale), new_symbols, KEYS["symbols"])}
        tables["embeddings"] = cascade(embeddings, kept)
        try:
            if provider is not None:
                vectors = materialize(embedded(new_items, provider), "vectors")
                summary["embedding_written"] = vectors.count()
                tables["embeddings"] = upsert(tables["embeddings"], vectors, KEYS["embeddings"])
            store.commit(**tables)
        except Exception as x:  # nothing was made current: the old snapshot stays
            failures.append({"path": None, "stage": "embedding" if provider is not None else "database", "error": str(x)[:500]})
            summary |= {"items_written": 0, "symbols_written": 0, "embedding_written": 0}
    summary |= {"items_failed": len(failures), "elapsed_seconds": round(time.perf_counter() - began, 3), "failures": failures}
    return Run(summary, changes)


def summary_json(run: Run) -> str:
    return json.dumps(run.summary, ensure_ascii=False, indent=2) + "\n"
