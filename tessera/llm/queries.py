"""The queries of the problems solved in this package, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chunks, history, neardup, packing, quality, ranks, shingles, terms, vectors
from tessera.plans.tables import materialize, table

SIMILAR, RUN, LEAST_WORDS = 0.7, 3, 30


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "indexed_items")
    classes, links = neardup.near_duplicates(items, "row_seq", "content", SIMILAR, RUN, LEAST_WORDS)
    return neardup.row_pairs(items, classes, links, "row_seq", "content", ["repo", "id"])


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per row: its class, its group and its class's links to other classes."""
    items = table(spark, d, "indexed_items")
    classes, links = neardup.near_duplicates(items, "row_seq", "content", SIMILAR, RUN, LEAST_WORDS)
    roots = neardup.components(links)
    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    rows = items.where("content is not null").select("row_seq", shingles.text_key(F.col("content")).alias("md5")).join(classes, "md5")
    return (
        rows.join(roots, rows.cid == roots.node, "left")
        .join(degree, rows.cid == degree.a, "left")
        .select("row_seq", F.col("cid").alias("class_id"), F.coalesce("root", "cid").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    )


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split(table(spark, d, "indexed_items"), "row_seq", "content", "start_line", "end_line").withColumnRenamed("row", "row_seq")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("piece_no = 0").select("row_seq")


ITEM = ["repo", "item_id"]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    parts = F.col("score_parts")
    scores = {"lexical": ranks.part(parts, "lexical", "keyword"), "vector": ranks.part(parts, "vector"), "symbol": ranks.part(parts, "symbol")}
    return ranks.item_values(table(spark, d, "search_results"), ["query_id"], ITEM, scores)


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranks.median_rank(_scored(spark, d), ["query_id"], ITEM, {"lexical": 1.0, "vector": 1.0, "symbol": 1.0})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that lead two parts: those whose median rank of the three parts is one of the first three, as an equal part beside it."""
    leads = F.size(F.filter(F.map_values("ranks"), lambda r: r <= 3))
    return _ranking(spark, d).where((F.col("median_rank") <= 3) & (leads >= 2)).select("query_id", *ITEM)


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    df = ranks.placed(_ranking(spark, d), ["query_id"], ITEM)
    return df.select("query_id", *ITEM, "score", "median_rank", F.round("mean_rank", 6).alias("mean_rank"), F.col("parts").cast("long").alias("parts"), F.col("place").cast("long").alias("place"))


def _usable(spark: SparkSession, d: str) -> DataFrame:
    return vectors.usable(table(spark, d, "item_embeddings"), "vec_id", ["provider", "model"], "dimension", "embedding", ["repo", "item_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.neighbours(_usable(spark, d), 10, 0.93)
    return near.select(F.least("row", "other").alias("vec_a"), F.greatest("row", "other").alias("vec_b")).distinct()


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of every usable vector."""
    return vectors.neighbours(_usable(spark, d), 10)


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its counts and mark."""
    items = table(spark, d, "indexed_items")
    return terms.marked(terms.term_counts(items, ["title", "content"]), items.count()).drop("n")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_terms(spark, d).where("mark is not null").select("term", "mark")


def p6_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the n-grams of up to five words that recur: those that more than one record holds."""
    return terms.term_counts(table(spark, d, "indexed_items"), ["title", "content"], 5).where("records > 1")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeated_rows(table(spark, d, "indexed_items"), table(spark, d, "index_batches"), SIMILAR, RUN, LEAST_WORDS)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = bpe.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.containers(sizes, "doc_id", "tokens")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    stats = materialize(quality.text_statistics(table(spark, d, "documents"), "doc_id", "text", "lang"), "stats")
    return quality.judged(stats, "doc_id", quality.fit_models(stats, table(spark, d, "doc_labels"), "doc_id", "kind"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("kind is not null").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its statistics, its distance from prose and each statistic's contribution."""
    df = _judged(spark, d)
    stats = [F.round(F.col("stats")[i], 6).alias(s) for i, s in enumerate(quality.STATS)]
    parts = [F.round(F.col("contributions")[i], 6).alias(f"{s}_part") for i, s in enumerate(quality.STATS)]
    return df.select("doc_id", *quality.COUNTS, *stats, F.round("distance", 6).alias("distance"), "prose_lang", *parts, "kind")


WORDS_SQL = "regexp_extract_all(lower({0}), '[a-z0-9_]+|[\\x{{4E00}}-\\x{{9FFF}}]')"
SETS_SQL = f"""
w AS (SELECT content, min(row_seq) cid, any_value({WORDS_SQL.format('content')}) ws FROM indexed_items WHERE content IS NOT NULL GROUP BY content),
s AS (SELECT content, cid, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) toks FROM w WHERE len(ws) >= 30),
t AS (SELECT cid, len(toks) n, unnest(toks) tok FROM s),
o AS (SELECT a.cid a, b.cid b, count(*) o, any_value(a.n) na, any_value(b.n) nb FROM t a JOIN t b ON a.tok = b.tok AND a.cid < b.cid AND b.n >= 0.69 * a.n AND a.n >= 0.69 * b.n GROUP BY 1, 2),
link AS (SELECT a, b FROM o WHERE o / (na + nb - o) >= 0.7),
r AS (SELECT i.row_seq, i.repo, i.id, i.index_batch_id, s.cid FROM indexed_items i JOIN s ON i.content = s.content)
"""

RANKS_SQL = """
v AS (SELECT query_id, repo, item_id, map_entries(score_parts) e FROM search_results),
f AS (SELECT query_id, repo, item_id,
  list_transform(list_filter(e, lambda x: lower(trim(x.key)) = 'lexical' AND x.value IS NOT NULL), lambda x: x.value) l,
  list_transform(list_filter(e, lambda x: lower(trim(x.key)) = 'keyword' AND x.value IS NOT NULL), lambda x: x.value) k,
  list_transform(list_filter(e, lambda x: lower(trim(x.key)) = 'vector' AND x.value IS NOT NULL), lambda x: x.value) v,
  list_transform(list_filter(e, lambda x: lower(trim(x.key)) = 'symbol' AND x.value IS NOT NULL), lambda x: x.value) s FROM v),
u AS (SELECT query_id, repo, item_id, unnest([{'part': 'lexical', 'vals': CASE WHEN len(l) > 0 THEN l ELSE k END}, {'part': 'vector', 'vals': v}, {'part': 'symbol', 'vals': s}]) p FROM f),
m AS (SELECT query_id, repo, item_id, p.part part, max(list_max(list_filter(p.vals, lambda x: x > 0 AND isfinite(x)))) val FROM u GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY query_id, part ORDER BY val DESC) rk, count(*) OVER (PARTITION BY query_id, part) n FROM m WHERE val IS NOT NULL)"""
TERMS_SQL = f"""
t AS (SELECT row_seq, unnest(list_concat(coalesce({WORDS_SQL.format('title')}, []), coalesce({WORDS_SQL.format('content')}, []))) term FROM indexed_items),
c AS (SELECT term, count(*) occurrences, count(DISTINCT row_seq) records FROM t GROUP BY 1),
q AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.1 * (SELECT count(*) FROM indexed_items) THEN 'common' END mark FROM c)"""
NGRAMS_SQL = " UNION ALL ".join(f"SELECT {n} n, row_seq, array_to_string(ws[i:i + {n - 1}], ' ') term FROM (SELECT row_seq, ws, unnest(range(1, len(ws) - {n - 2})) i FROM f)" for n in range(1, 6))
HASH_SQL = "regexp_replace(lower(regexp_replace(file_hash, '^\\s+|\\s+$', '', 'g')), '^[a-z0-9_\\-]+:\\s*', '')"

ORACLE: dict[str, str] = {
    "p1_found": "SELECT row_seq FROM indexed_items WHERE length(content) > 2000",
    "p4_found": f"WITH {RANKS_SQL} SELECT query_id, repo, item_id FROM k WHERE rk <= 3 GROUP BY ALL HAVING count(*) >= 2",
    "p4_ranking": f"""WITH {RANKS_SQL}, last AS (SELECT query_id, part, max(n) n FROM k GROUP BY ALL),
p(part) AS (VALUES ('lexical'), ('vector'), ('symbol')), i AS (SELECT DISTINCT query_id, repo, item_id FROM search_results),
a AS (SELECT i.*, p.part, k.rk, coalesce(k.rk, last.n + 1, 1) r FROM i CROSS JOIN p LEFT JOIN k ON k.query_id = i.query_id AND k.repo = i.repo AND k.item_id = i.item_id AND k.part = p.part
  LEFT JOIN last ON last.query_id = i.query_id AND last.part = p.part),
g AS (SELECT query_id, repo, item_id, CASE WHEN count(rk) > 0 THEN 1 / median(r) END score, median(r)::DOUBLE median_rank, round(avg(r), 6) mean_rank, count(rk) parts FROM a GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY parts = 0, median_rank, mean_rank, repo NULLS FIRST, item_id NULLS FIRST) place FROM g""",
    "p5_found": """WITH v AS (SELECT vec_id, repo, item_id, provider, model, dimension, embedding e FROM item_embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = dimension AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
c AS (SELECT a.vec_id a, b.vec_id b, list_cosine_similarity(a.e, b.e) s FROM v a JOIN v b ON a.provider IS NOT DISTINCT FROM b.provider AND a.model IS NOT DISTINCT FROM b.model AND a.dimension = b.dimension
  AND (a.repo IS DISTINCT FROM b.repo OR a.item_id IS DISTINCT FROM b.item_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) r FROM c WHERE s >= 0.93)
SELECT DISTINCT least(a, b) vec_a, greatest(a, b) vec_b FROM k WHERE r <= 10""",
    "p6_found": f"WITH {TERMS_SQL} SELECT term, mark FROM q WHERE mark IS NOT NULL",
    "p6_terms": f"WITH {TERMS_SQL} SELECT term, occurrences, records, mark FROM q",
    "p6_ngrams": f"""WITH f AS (SELECT row_seq, {WORDS_SQL.format('title')} ws FROM indexed_items UNION ALL SELECT row_seq, {WORDS_SQL.format('content')} FROM indexed_items), g AS ({NGRAMS_SQL})
SELECT n, term, count(*) occurrences, count(DISTINCT row_seq) records FROM g GROUP BY ALL HAVING count(DISTINCT row_seq) > 1""",
    "p7_found": f"""WITH {SETS_SQL}, b AS (SELECT i.row_seq, i.repo, i.id, {HASH_SQL} h, s.cid, CASE WHEN i.index_batch_id IS NULL THEN -1 ELSE batch_no END no
  FROM indexed_items i LEFT JOIN index_batches USING (index_batch_id) LEFT JOIN s ON s.content = i.content),
same AS (SELECT row_seq FROM b WHERE no > (SELECT min(no) FROM b y WHERE y.h = b.h)),
l AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link UNION ALL SELECT cid, cid FROM s)
SELECT row_seq, 'same' kind FROM same
UNION ALL SELECT DISTINCT x.row_seq, 'near' FROM b x JOIN l ON l.a = x.cid JOIN b y ON y.cid = l.b AND y.no < x.no AND (y.repo IS DISTINCT FROM x.repo OR y.id IS DISTINCT FROM x.id) WHERE x.row_seq NOT IN (SELECT row_seq FROM same)""",
    "p3_found": f"""WITH {SETS_SQL}, l AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link UNION ALL SELECT cid, cid FROM s)
SELECT x.row_seq row_a, y.row_seq row_b FROM l JOIN r x ON x.cid = l.a JOIN r y ON y.cid = l.b AND x.row_seq < y.row_seq
WHERE x.repo IS DISTINCT FROM y.repo OR x.id IS DISTINCT FROM y.id""",
    "p3_groups": f"""WITH RECURSIVE {SETS_SQL}, l AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
c(node, root) AS (SELECT cid, cid FROM s UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node),
g AS (SELECT node, min(root) root FROM c GROUP BY 1), d AS (SELECT a, count(*) links FROM l GROUP BY 1)
SELECT r.row_seq, r.cid class_id, g.root group_id, coalesce(d.links, 0) links FROM r JOIN g ON g.node = r.cid LEFT JOIN d ON d.a = r.cid""",
}

QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p3_found, p3_groups, p4_found, p4_ranking, p5_found, p5_neighbours, p6_found, p6_terms, p6_ngrams, p7_found,
        p8_ids, p9_containers, p10_found, p10_statistics,
    )
}
