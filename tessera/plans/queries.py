"""The registered queries of the core: each operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import context as C
from tessera.operators import evaluate as E
from tessera.operators import filters as P
from tessera.operators import fusion as U
from tessera.operators import incremental as N
from tessera.operators import lexical as L
from tessera.operators import symbols as Y
from tessera.operators import vector as V
from tessera.plans.store import cascade, last_wins, without_prefix
from tessera.plans.tables import materialize, scratch, table, workspace
from tessera.sources import aliases as A
from tessera.sources.files import parsed
from tessera.sources.providers import HashProvider, embedded
from tessera.streaming.events import sessions, windowed_counts

LIMIT = 10
SPACE = V.Identity("quarrystone", "qs-embed-64", 64)
ALIASES = (("sign driver", ["label", "gateway"]), ("ledger", ["journal", "account"]), ("运价", ["tariff"]), ("panel", ["locker", "rack"]))
MONOLITH = "scm.norvale.example/platform/hub-monolith"


def items(spark: SparkSession, d: str) -> DataFrame:
    """The stored items: of each identity the row that arrived last."""
    return last_wins(table(spark, d, "indexed_items"), ("repo", "id"), "row_seq")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """The stored symbols: of each identity the newest row."""
    order = [F.col(c).desc_nulls_last() for c in ("indexed_at", "index_batch_id", "path", "start_line", "end_line", "source_item_id", "file_hash", "branch", "commit_sha")]
    w = Window.partitionBy("repo", "symbol_id").orderBy(*order)
    return table(spark, d, "symbols").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def searches(spark: SparkSession, d: str, asset_type: str = "code") -> DataFrame:
    """All searches that results were delivered for."""
    rows = table(spark, d, "search_results")
    return rows.groupBy("query_id").agg(F.min("query_text").alias("query_text"), F.min("repo").alias("repo")).withColumn("asset_type", F.lit(asset_type))


def requests(spark: SparkSession, d: str, asset_type: str = "code") -> DataFrame:
    """The stated query set of what searches all rows: the searches whose id is divisible by 20."""
    return searches(spark, d, asset_type).where("query_id % 20 = 0")


def _tokens(spark, d):
    return L.with_tokens(requests(spark, d), cjk=False)


def _candidates(spark, d):
    return L.keyword_candidates(items(spark, d), _tokens(spark, d), LIMIT)


def _fields(spark, d):
    return L.with_fields(_candidates(spark, d), items(spark, d))


def scan_items_filtered(spark, d):
    df = P.item_filter(items(spark, d), asset_type="code", language="java", symbol_types=["method", "class"])
    return df.select("repo", "id", "title", "start_line")


def scan_symbols_filtered(spark, d):
    df = P.list_symbols(symbols(spark, d), MONOLITH, kinds=["class", "table"])
    return df.select("repo", "symbol_id", "path", "kind")


def list_paths_prefix(spark, d):
    return P.list_paths(items(spark, d), path_prefix="tr")


def path_glob_include_exclude(spark, d):
    paths = table(spark, d, "indexed_items").select("path").distinct()
    return paths.where(P.included(F.col("path"), ("**/*.java", "*.md")) & ~P.excluded(F.col("path"), ("guides", "*/test/*")))


def point_lookup_first_repo(spark, d):
    return P.first_by_repo(items(spark, d)).select("id", "repo", "title")


def quarantine(spark, d):
    return P.unfit(table(spark, d, "indexed_items")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def upsert_last_wins(spark, d):
    return items(spark, d).select("repo", "id", "row_seq", "title")


def delete_by_path_cascade(spark, d):
    kept = items(spark, d).where(~F.coalesce(F.col("path").endswith(".md"), F.lit(False)))
    return cascade(table(spark, d, "item_embeddings"), kept).select("vec_id")


def delete_by_prefix(spark, d):
    return without_prefix(symbols(spark, d), MONOLITH, "t").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


def _file_states(spark, d):
    rows = N.deliveries(table(spark, d, "indexed_items"), table(spark, d, "index_batches"))
    return rows.select(F.concat_ws("/", "repo", "path").alias("path"), "no", "settled", F.col("version").alias("file_hash"))


def incremental_plan_setops(spark, d):
    """Files of the last third of the batches held against those before."""
    cut = table(spark, d, "index_batches").agg((F.max("batch_no") * 2 / 3).alias("cut"))
    rows = _file_states(spark, d).join(F.broadcast(cut))  # one row
    stored = rows.where("no <= cut").select("path", "file_hash")
    new = rows.where("no > cut").groupBy("path").agg(F.max_by("file_hash", "no").alias("file_hash"), F.count(F.lit(1)).alias("items"))
    return N.plan(new, stored)


def p2_found(spark, d):
    all_items, batches = table(spark, d, "indexed_items"), table(spark, d, "index_batches")
    with workspace(spark, "ledger") as root, scratch() as keep:
        kept = N.Ledger(spark, root)
        kept.start(all_items, batches)
        keep.append(out := materialize(kept.pending(all_items, batches).select("repo", "path"), "pending"))
    return out


def p2_ledger(spark, d):
    return N.ledger(table(spark, d, "indexed_items"), table(spark, d, "index_batches"))


def provenance_hash_distinct(spark, d):
    rows = table(spark, d, "indexed_items").where("content is not null").select("repo", F.sha2("content", 256).alias("h"))
    return rows.groupBy("repo").agg(F.countDistinct("h").alias("contents"), F.min("h").alias("least"))


def ascii_tokens(spark, d):
    rows = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(T.ASCII_TOKEN), F.lit(0))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def camel_split_tokens(spark, d):
    rows = table(spark, d, "indexed_items").select(F.explode(T.ascii_tokens(F.col("title"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def symbol_terms(spark, d):
    return searches(spark, d).select("query_id", F.explode(T.symbol_terms(F.col("query_text"))).alias("term"))


def keyword_candidates(spark, d):
    return _candidates(spark, d).select("query_id", "repo", "id", F.col("match_count").cast("long").alias("match_count"), F.col("place").cast("long").alias("place"))


def weighted_tf_doc_length(spark, d):
    c = _fields(spark, d)
    return L.document_stats(c, L.postings(c, cjk=False)).select("query_id", "repo", "id", F.round("length", 6).alias("length"), "n", F.round("avg_length", 6).alias("avg_length"))


def document_frequency(spark, d):
    return L.postings(_fields(spark, d), cjk=False).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("df"), F.round(F.sum("wtf"), 6).alias("wtf"))


def _hits(df):
    return df.select("query_id", "channel", "repo", "id", F.col("rank").cast("long").alias("rank"), F.round("raw_score", 6).alias("raw_score"), "reason")


def bm25_topk(spark, d):
    return _hits(L.lexical_recall(items(spark, d), requests(spark, d), LIMIT, cjk=False))


def lexical_recall_cjk(spark, d):
    """The lexical channel with CJK segmentation."""
    return _hits(L.lexical_recall(items(spark, d), requests(spark, d, "doc"), LIMIT))


def _aliases(spark):
    return spark.createDataFrame(list(ALIASES), A.SCHEMA)


def alias_expand_match(spark, d):
    return A.matched(searches(spark, d), _aliases(spark)).select("query_id", "term")


def cosine_topk(spark, d):
    """The ten nearest of the plain vectors, for those whose id is divisible by 20."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    e = e.withColumn("norm", F.sqrt(V.dot(F.col("v"), F.col("v"))))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("norm").alias("qn"))
    near = e.join(L.sized(q), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(V.cosine(F.col("v"), F.col("qv"), F.col("norm"), F.col("qn")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10")


def _usable(spark, d):
    """Vectors of the space, one for each item."""
    e = V.in_space(table(spark, d, "item_embeddings"), SPACE)
    e = e.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    w = Window.partitionBy("repo", "item_id").orderBy("vec_id")
    return e.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def _vector_requests(spark, d):
    q = _usable(spark, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "repo", F.lit("code").alias("asset_type"), F.col("embedding").alias("vector"))
    return q.withColumn("query_text", F.lit(""))


def cosine_topk_filtered_identity(spark, d):
    hits = V.vector_recall(items(spark, d), _usable(spark, d), _vector_requests(spark, d), LIMIT, SPACE)
    return hits.select("query_id", "repo", "id", F.col("rank").cast("long").alias("rank"), "raw_score")


def embedding_left_first(spark, d):
    df = V.first_embedding(items(spark, d).select("repo", "id"), table(spark, d, "item_embeddings"))
    return df.select("repo", "id", "provider", "model", "dimension")


def _names(spark, d):
    """(row_seq, q_repo, term): the stated query set of symbol lookups, the last name in the symbol of every item whose row_seq is divisible by 20."""
    rows = table(spark, d, "indexed_items").where("row_seq % 20 = 0 and symbol is not null")
    return rows.select("row_seq", F.col("repo").alias("q_repo"), F.element_at(F.split("symbol", r"\."), -1).alias("term"))


def symbol_exact(spark, d):
    """find_exact of many names."""
    hit = (F.col("repo") == F.col("q_repo")) & Y.exact_hit(F.col("term"))
    return symbols(spark, d).join(L.sized(_names(spark, d)), hit).select("row_seq", "term", "repo", "symbol_id")


def symbol_prefix(spark, d):
    """find_prefix of many names without their last three letters."""
    names = _names(spark, d).withColumn("term", F.expr("left(term, length(term) - 3)"))
    return symbols(spark, d).join(L.sized(names), (F.col("repo") == F.col("q_repo")) & Y.prefix_hit(F.col("term"))).select("row_seq", "term", "repo", "symbol_id")


def _ladder(spark, d):
    return Y.ladder(symbols(spark, d), Y.with_terms(requests(spark, d), cjk=False))


def symbol_ladder(spark, d):
    return _ladder(spark, d).select("query_id", "repo", "symbol_id", "score", "reason")


def symbol_to_item_dedupe(spark, d):
    return _hits(L.ranked(Y.items_of_symbols(_ladder(spark, d), items(spark, d), LIMIT), "symbol", F.col("reason")))


def _channels(spark, d):
    """Hits of two channels from the delivered search results: places by two of the score parts."""
    rows = table(spark, d, "search_results").where("score is not null and not isnan(score)").groupBy("query_id", "repo", F.col("item_id").alias("id")).agg(F.max("score").alias("score"), F.max("result_id").alias("result_id"))
    hits = None
    for channel, order in (("lexical", [F.desc("score"), F.col("repo"), F.col("id")]), ("vector", [F.asc("result_id")])):
        w = Window.partitionBy("query_id").orderBy(*order)
        part = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 30).select("query_id", F.lit(channel).alias("channel"), "repo", "id", "rank", (1 / F.col("rank")).alias("raw_score"), F.concat(F.lit(channel), F.lit(" hit")).alias("reason"))
        hits = part if hits is None else hits.unionByName(part)
    return hits


def rrf_fusion(spark, d):
    return U.match_reason(U.rrf(_channels(spark, d), LIMIT)).select("query_id", "repo", "id", "score", F.col("rank").cast("long").alias("rank"), "match_reason")


def rrf_score_parts(spark, d):
    return U.score_parts(U.rrf(_channels(spark, d), LIMIT)).select("query_id", "repo", "id", "keyword", "lexical", "vector", "symbol", "rrf")


def trace_by_channel(spark, d):
    t = U.trace(_channels(spark, d))
    return t.select("query_id", "channel", "candidate_count", F.array_join(F.transform("hits", lambda h: h["id"]), " | ").alias("ids"))


def hybrid_search_topk(spark, d, asked=requests):
    """Lexical and symbol channels, fused; ASCII tokens."""
    df = U.hybrid_search(items(spark, d), None, symbols(spark, d), asked(spark, d), LIMIT, cjk=False)
    return df.select("query_id", "repo", "id", "score", F.col("rank").cast("long").alias("rank"), "keyword", "symbol", "match_reason")


def hybrid_search_all_channels(spark, d):
    """All channels with CJK segmentation; the query vectors are an item's of the same repo."""
    vectors = _usable(spark, d).groupBy("repo").agg(F.min_by("embedding", "vec_id").alias("vector"))
    q = requests(spark, d).join(vectors, "repo", "left")
    df = U.hybrid_search(items(spark, d), _usable(spark, d), symbols(spark, d), q, LIMIT, SPACE)
    return df.select("query_id", "repo", "id", "score", "rank", "keyword", "vector", "symbol", "match_reason")


def stale_index_flag(spark, d):
    """Every second query asks for a commit that isn't there."""
    q = requests(spark, d).withColumn("commit_sha", F.when(F.col("query_id") % 40 == 0, "none"))
    hits = L.lexical_recall(items(spark, d), q, LIMIT, cjk=False)
    return U.stale(items(spark, d), q, hits, cjk=False)


def cross_repo_risk(spark, d):
    return U.cross_repo(table(spark, d, "search_results"))


def _results(spark, d):
    """Delivered results as the groups of a context, with their items."""
    rows = table(spark, d, "search_results").where("score is not null and not isnan(score)")
    group = F.create_map(*[F.lit(x) for g, a in C.ASSETS.items() if g != "similar_implementations" for x in (a, g)])[F.col("asset_type")]
    rows = rows.groupBy("query_id", "repo", F.col("item_id").alias("id"), group.alias("group")).agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id", "group").orderBy(F.desc("score"), "repo", "id")
    rows = rows.withColumn("rank", F.row_number().over(w)).withColumn("match_reason", F.lit("delivered"))
    code = rows.where("group = 'related_code' and rank % 2 = 1").withColumn("group", F.lit("similar_implementations"))
    own = items(spark, d).drop("row_seq", "asset_type")
    return rows.unionByName(code).join(own, ["repo", "id"])


def _budgets(spark, d):
    return table(spark, d, "search_results").select("query_id").distinct().withColumn("token_budget", (F.col("query_id") % 7 * 200 + 50).cast("int"))


def context_dedupe(spark, d):
    return C.dedupe(_results(spark, d)).select("query_id", "group", F.col("rank").cast("long").alias("rank"), "evidence_role")


def context_token_cost(spark, d):
    return table(spark, d, "indexed_items").select("row_seq", T.token_cost(F.col("title"), F.col("summary"), F.col("content")).cast("long").alias("cost"))


def _kept(spark, d):
    return C.within_budget(C.with_cost(C.dedupe(_results(spark, d))), _budgets(spark, d))


def context_token_budget(spark, d):
    return _kept(spark, d).select("query_id", "group", F.col("rank").cast("long").alias("rank"), F.col("cost").cast("long").alias("cost"))


def missing_context(spark, d):
    df = C.missing(_kept(spark, d), _budgets(spark, d))
    return df.select("query_id", F.array_join("missing", ",").alias("missing"))


def incomplete_provenance(spark, d):
    return C.incomplete_provenance(_results(spark, d))


def context_risks(spark, d):
    stale = _budgets(spark, d).select("query_id", (F.col("query_id") % 5 == 0).alias("stale"))
    df = C.risks(_kept(spark, d), _budgets(spark, d), stale)
    return df.select("query_id", F.array_join(F.transform("risks", lambda r: r["code"]), ",").alias("risks"))


def citations_unique(spark, d):
    return C.citations(_results(spark, d)).select("query_id", F.col("place").cast("long").alias("place"), "repo", "path", "start_line", "end_line", "symbol", "table_name", "column_name", "heading_path")


def _samples(spark, d):
    """Searches as samples: the expected hit is the path of the best delivered result of one asset type or another."""
    rows = table(spark, d, "search_results").where("score is not null and not isnan(score)").join(items(spark, d).select("repo", F.col("id").alias("item_id"), "path", "source_type"), ["repo", "item_id"])
    best = rows.groupBy("query_id").agg(F.min(F.struct("result_id", "path", "source_type")).alias("x"), F.min("item_id").alias("worst"))
    null = F.lit(None).cast("string")
    hit = F.struct(F.col("x.source_type").alias("source_type"), F.col("x.path").alias("path"), null.alias("symbol"), null.alias("table_name"), null.alias("column_name"), null.alias("heading_path"))
    return best.select(F.concat(F.lit("g"), F.col("query_id") % 4).alias("sample_group"), F.col("query_id").alias("sample_id"), F.array(hit).alias("expected_hits"), F.array("worst").alias("irrelevant_ids"))


def _judged(spark, d):
    return E.judge(_samples(spark, d), _results(spark, d))


def eval_hit_at_k(spark, d):
    return _judged(spark, d).select("sample_id", F.col("first_rank").cast("long").alias("first_rank"), "hit")


def eval_irrelevant(spark, d):
    return _judged(spark, d).select("sample_id", "irrelevant")


def eval_completeness(spark, d):
    return _judged(spark, d).select("sample_id", "returned", "sourced", "failed")


def eval_mrr(spark, d):
    return E.by_group(_judged(spark, d)).select("sample_group", "samples", "hits", "mrr")


def eval_rollup_by_group(spark, d):
    return E.with_overall(_judged(spark, d)).select("sample_group", "samples", "hits", "hit_rate", "mrr", "irrelevant", "completeness", "passed")


def _parse(spark, rows, kind, columns):
    return parsed(rows, {kind: columns}).select("path", "failed", F.explode_outer(kind).alias("x")).select("path", *[F.col(f"x.{c}").alias(c) for c in columns], "failed")


def markdown_sections(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("file_hash"))
    return _parse(spark, rows, "items", ("id", "title", "start_line", "end_line", "heading_path")).where("id is not null")


def java_items(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("src/"), F.col("doc_id"), F.lit(".java")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("file_hash"))
    return _parse(spark, rows, "items", ("id", "title", "start_line", "end_line", "symbol_type"))


def java_symbols(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("src/"), F.col("doc_id"), F.lit(".java")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("file_hash"))
    return _parse(spark, rows, "symbols", ("symbol_id", "kind", "qualified_name", "source_item_id"))


def ddl_items(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("db/"), F.col("doc_id"), F.lit(".sql")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("file_hash"))
    return _parse(spark, rows, "items", ("id", "title", "content", "symbol_type"))


def fallback_segment_cjk(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.cjk_tokens(F.col("text"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


def embed_items(spark, d):
    return embedded(items(spark, d), HashProvider()).select("repo", "item_id", "provider", "dimension", F.round(F.element_at("embedding", 1), 6).alias("first"))


def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


def event_sessions(spark, d):
    return sessions(table(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events")


QUERIES = {
    f.__name__: f
    for f in (
        scan_items_filtered, scan_symbols_filtered, list_paths_prefix, path_glob_include_exclude, point_lookup_first_repo, quarantine, upsert_last_wins, delete_by_path_cascade, delete_by_prefix, incremental_plan_setops,
        p2_found, p2_ledger, provenance_hash_distinct, ascii_tokens, camel_split_tokens, symbol_terms, keyword_candidates, weighted_tf_doc_length, document_frequency, bm25_topk, lexical_recall_cjk,
        alias_expand_match, cosine_topk, cosine_topk_filtered_identity, embedding_left_first, symbol_exact, symbol_prefix, symbol_ladder, symbol_to_item_dedupe, rrf_fusion, rrf_score_parts, trace_by_channel,
        hybrid_search_topk, hybrid_search_all_channels, stale_index_flag, cross_repo_risk, context_dedupe, context_token_cost, context_token_budget, missing_context, incomplete_provenance, context_risks,
        citations_unique, eval_hit_at_k, eval_irrelevant, eval_completeness, eval_mrr, eval_rollup_by_group, markdown_sections, java_items, java_symbols, ddl_items, fallback_segment_cjk, embed_items, event_windows, event_sessions,
    )
}
