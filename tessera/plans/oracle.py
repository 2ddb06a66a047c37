"""The queries of the core as SQL for DuckDB."""

from __future__ import annotations

from tessera.functions.text import ASCII_TOKEN, SEPARATORS
from tessera.operators.context import SOURCE
from tessera.operators.lexical import COLUMN_OF, WEIGHTS
from tessera.plans.queries import ALIASES

CUR = "cur AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY row_seq DESC) k FROM indexed_items) WHERE k = 1)"
_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in ("indexed_at", "index_batch_id", "path", "start_line", "end_line", "source_item_id", "file_hash", "branch", "commit_sha"))
SYM = f"sym AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY repo, symbol_id ORDER BY {_ORDER}) k FROM symbols) WHERE k = 1)"
NAMES = "t AS (SELECT row_seq, repo, string_split(symbol, '.')[-1] term FROM indexed_items WHERE row_seq % 20 = 0 AND symbol IS NOT NULL)"
ALL = "req AS (SELECT query_id, min(query_text) query_text, min(repo) repo FROM search_results GROUP BY 1)"
REQ = "req AS (SELECT query_id, min(query_text) query_text, min(repo) repo FROM search_results WHERE query_id % 20 = 0 GROUP BY 1)"


def split(t: str) -> str:
    parts = f"list_filter(regexp_split_to_array({t}, '{SEPARATORS}'), lambda p: p <> '')"
    camel = "regexp_replace(regexp_replace(p, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    pieces = f"flatten(list_transform({parts}, lambda p: list_concat([lower(p)], list_transform(list_filter(string_split({camel}, ' '), lambda c: c <> ''), lambda c: lower(c)))))"
    return f"list_filter(list_distinct(list_concat({pieces}, CASE WHEN len({parts}) > 1 THEN [lower(array_to_string({parts}, '.'))] ELSE [] END)), lambda x: length(x) > 1)"


def found(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{ASCII_TOKEN}')"


def tokens(text: str) -> str:
    return f"flatten(list_transform({found(text)}, lambda t: {split('t')}))"


def terms(text: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter({found(text)}, lambda t: length(t) > 1), lambda t: list_concat([t, lower(t)], {split('t')}))))"


_HAY = " || chr(1) || ".join(f"coalesce(lower({c}), '')" for c in ("title", "content", "summary", "symbol", "table_name", "heading_path", "path"))
QTOK = f"qt AS (SELECT query_id, repo, query_text, list_distinct({tokens('query_text')}) tokens FROM req)"
CAND = f"""cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match_count DESC, id, repo) place FROM
  (SELECT q.query_id, q.tokens, c.*, len(list_filter(q.tokens, lambda t: contains({_HAY.replace('lower(', 'lower(c.')}, t))) match_count FROM cur c JOIN qt q ON c.repo = q.repo WHERE c.asset_type = 'code') WHERE match_count > 0) WHERE place <= 30)"""
_FIELDS = " UNION ALL ".join(
    f"SELECT query_id, repo, id, '{n}' field, {w}::DOUBLE w, unnest({tokens(chr(97) + 'rray_to_string(map_values(metadata), ' + chr(39) + ' ' + chr(39) + ')' if n == 'metadata' else COLUMN_OF.get(n, n))}) token FROM cand" for n, w in WEIGHTS.items()
)
POST = f"fld AS ({_FIELDS}), post AS (SELECT query_id, repo, id, token, sum(w) wtf, list_sort(list(DISTINCT field)) fields FROM fld GROUP BY ALL)"
STAT = """len AS (SELECT c.query_id, c.repo, c.id, greatest(coalesce(l.s, 0), 1) length FROM cand c LEFT JOIN (SELECT query_id, repo, id, sum(wtf) s FROM post GROUP BY ALL) l USING (query_id, repo, id)),
stat AS (SELECT *, count(*) OVER (PARTITION BY query_id) n, avg(length) OVER (PARTITION BY query_id) avg_length FROM len), df AS (SELECT query_id, token, count(*) df FROM post GROUP BY ALL)"""
BM25 = """want AS (SELECT query_id, unnest(tokens) token FROM qt),
sc AS (SELECT query_id, repo, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * length / greatest(avg_length, 1)))) raw, list_sort(list(DISTINCT token)) toks, list_sort(list_distinct(flatten(list(fields)))) fields
  FROM post JOIN want USING (query_id, token) JOIN df USING (query_id, token) JOIN stat USING (query_id, repo, id) GROUP BY ALL),
lx AS (SELECT *, round(raw / max(raw) OVER (PARTITION BY query_id), 6) score FROM sc WHERE raw > 0),
lex AS (SELECT query_id, 'lexical' channel, repo, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, id) AS "rank", score raw_score,
  'keyword/lexical hit: ' || array_to_string(toks[1:5], ', ') || ' fields=' || array_to_string(fields[1:5], ',') reason FROM lx WHERE score > 0)"""
LEX = f"{CUR}, {REQ}, {QTOK}, {CAND}, {POST}, {STAT}, {BM25}"
LADDER = f"""lt AS (SELECT query_id, repo, unnest(list_filter(list_distinct(list_concat({terms('query_text')}, {tokens('query_text')})), lambda x: length(x) > 1)) term FROM req),
lm AS (SELECT l.query_id, s.repo, s.symbol_id, s.qualified_name, s.source_item_id, l.term, CASE WHEN lower(l.term) IN (lower(name), lower(qualified_name), lower(symbol_id)) THEN 1.0::DOUBLE
   WHEN starts_with(lower(name), lower(l.term)) OR starts_with(lower(qualified_name), lower(l.term)) OR starts_with(lower(symbol_id), lower(l.term)) THEN 0.85::DOUBLE
   WHEN contains(lower(name), lower(l.term)) OR contains(lower(qualified_name), lower(l.term)) OR contains(lower(symbol_id), lower(l.term)) THEN 0.65::DOUBLE END score
  FROM sym s JOIN lt l ON s.repo = l.repo WHERE s.kind IN ('annotation_type', 'class', 'constructor', 'enum', 'field', 'interface', 'method', 'record')),
lad AS (SELECT query_id, repo, symbol_id, qualified_name, source_item_id, score, 'symbol ' || CASE score WHEN 1.0 THEN 'exact' WHEN 0.85 THEN 'prefix' ELSE 'fuzzy' END || ' hit: ' || term reason FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id, repo, symbol_id ORDER BY score DESC, length(term) DESC, term) k FROM lm WHERE score IS NOT NULL) WHERE k = 1)"""
SYMHITS = """si AS (SELECT l.query_id, l.repo, l.source_item_id id, l.score, l.reason, l.qualified_name, l.symbol_id, row_number() OVER (PARTITION BY l.query_id, l.repo, l.source_item_id ORDER BY l.score DESC, l.qualified_name, l.symbol_id) k
  FROM lad l JOIN cur c ON c.repo = l.repo AND c.id = l.source_item_id AND c.asset_type = 'code'),
sj AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, qualified_name, symbol_id) p FROM si WHERE k = 1),
syh AS (SELECT query_id, 'symbol' channel, repo, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, id) AS "rank", round(score, 6) raw_score, reason FROM sj WHERE p <= 30)"""
CHAN = """sr AS (SELECT query_id, repo, item_id id, max(score) score, max(result_id) result_id FROM search_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
hits AS (SELECT query_id, 'lexical' channel, repo, id, k AS "rank", 1 / k raw_score, 'lexical hit' reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, id) k FROM sr) WHERE k <= 30
  UNION ALL SELECT query_id, 'vector', repo, id, k, 1 / k, 'vector hit' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY result_id) k FROM sr) WHERE k <= 30)"""
RRF = """fus AS (SELECT query_id, repo, id, round(sum(1 / (60 + "rank")), 6) score, max(CASE channel WHEN 'lexical' THEN raw_score END) lexical, max(CASE channel WHEN 'vector' THEN raw_score END) vec, max(CASE channel WHEN 'symbol' THEN raw_score END) sym,
  array_to_string(list(reason ORDER BY CASE channel WHEN 'lexical' THEN 0 WHEN 'vector' THEN 1 ELSE 2 END), '; ') match_reason FROM hits GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, id) AS "rank" FROM fus) WHERE "rank" <= 10)"""
_SRC = ", ".join(SOURCE)
_GROUP = "CASE asset_type WHEN 'code' THEN 'related_code' WHEN 'db_schema' THEN 'related_db_schema' WHEN 'doc' THEN 'related_docs' END"
_AT = "list_position(['related_code', 'related_db_schema', '{}', '{}'], grp)"
AT_DEDUPE, AT_BUDGET = _AT.format("similar_implementations", "related_docs"), _AT.format("related_docs", "similar_implementations")
RES = f"""{CUR}, ra AS (SELECT query_id, repo, item_id id, {_GROUP} grp, max(score) score FROM search_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
rb AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, repo, id) rk FROM ra),
rc AS (SELECT * FROM rb UNION ALL SELECT query_id, repo, id, 'similar_implementations', score, rk FROM rb WHERE grp = 'related_code' AND rk % 2 = 1),
res AS (SELECT rc.query_id, rc.id, rc.grp, rc.score, rc.rk, {', '.join('c.' + c for c in SOURCE)}, c.title, c.summary, c.content FROM rc JOIN cur c ON c.repo = rc.repo AND c.id = rc.id)"""
DEDUPE = f"ded AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {_SRC} ORDER BY {AT_DEDUPE}, rk) k FROM res) WHERE k = 1)"


def cost(text: str) -> str:
    """Also for the whole of a text: a quarter of its ASCII characters and half of the others."""
    ascii_only = f"length(regexp_replace({text}, '[^\\x00-\\x7F]', '', 'g'))"
    return f"greatest(1, {ascii_only} // 4 + (length({text}) - {ascii_only}) // 2)"


_TEXT = "coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(content, '')"
_COST = cost("(" + _TEXT + " || ' delivered')")
BUDGET = f"""cst AS (SELECT *, {_COST} cost, query_id % 7 * 200 + 50 budget, row_number() OVER (PARTITION BY query_id ORDER BY {AT_BUDGET}, rk) p FROM ded),
fold AS (SELECT query_id, p, true keep, greatest(0, budget - cost) rest FROM cst WHERE p = 1
  UNION ALL SELECT c.query_id, c.p, c.cost <= f.rest, CASE WHEN c.cost <= f.rest THEN f.rest - c.cost ELSE f.rest END FROM fold f JOIN cst c ON c.query_id = f.query_id AND c.p = f.p + 1),
kept AS (SELECT c.* FROM cst c JOIN fold f ON f.query_id = c.query_id AND f.p = c.p WHERE f.keep)"""
MISS = """ids AS (SELECT DISTINCT query_id FROM search_results),
mis AS (SELECT i.query_id, list_filter(['code', 'db_schema', 'doc'], lambda a: NOT list_contains(coalesce(k.g, []), a)) m FROM ids i LEFT JOIN
  (SELECT query_id, list(DISTINCT CASE grp WHEN 'related_code' THEN 'code' WHEN 'related_db_schema' THEN 'db_schema' WHEN 'related_docs' THEN 'doc' END) g FROM kept WHERE grp <> 'similar_implementations' GROUP BY 1) k ON k.query_id = i.query_id)"""
_LACKS = "bool_or(coalesce(source_type IN ('code', 'doc'), false) AND (coalesce(file_hash, '') = '' OR indexed_at IS NULL))"
EVAL = """sm AS (SELECT s.query_id, min({'result_id': s.result_id, 'path': c.path, 'source_type': c.source_type}) x, min(s.item_id) worst FROM search_results s JOIN cur c ON c.repo = s.repo AND c.id = s.item_id WHERE s.score IS NOT NULL AND NOT isnan(s.score) GROUP BY 1),
pl AS (SELECT r.*, sm.x, sm.worst, row_number() OVER (PARTITION BY r.query_id ORDER BY list_position(['related_code', 'related_db_schema', 'related_docs', 'similar_implementations'], grp), rk) place FROM res r JOIN sm ON sm.query_id = r.query_id
  WHERE CASE sm.x.source_type WHEN 'code' THEN 'related_code' WHEN 'db_schema' THEN 'related_db_schema' WHEN 'doc' THEN 'related_docs' END = grp),
ag AS (SELECT query_id, min(CASE WHEN place <= 5 AND source_type = x.source_type AND (x.path IS NULL OR path = x.path) THEN place END) first_rank, count(*) FILTER (place <= 10 AND id = worst) irrelevant, count(*) returned, count(source_type) sourced FROM pl GROUP BY 1),
ju AS (SELECT 'g' || sm.query_id % 4 sample_group, sm.query_id sample_id, first_rank, first_rank IS NOT NULL hit, coalesce(irrelevant, 0) irrelevant, coalesce(returned, 0) returned, coalesce(sourced, 0) sourced, first_rank IS NULL OR coalesce(sourced, 0) < coalesce(returned, 0) failed FROM sm LEFT JOIN ag ON ag.query_id = sm.query_id)"""
_MET = """count(*) samples, count(*) FILTER (hit) hits, round(avg(hit::INT), 4) hit_rate, round(sum(coalesce(1 / first_rank, 0)) / count(*), 4) mrr, sum(irrelevant)::BIGINT irrelevant, round(CASE WHEN sum(returned) > 0 THEN sum(sourced) / sum(returned) ELSE 1 END, 4) completeness,
 avg(hit::INT) >= 0.7 AND sum(irrelevant) <= 3 AND coalesce(sum(sourced) = sum(returned), true) AND NOT bool_or(failed) passed"""
_HASH = "regexp_replace(lower(regexp_replace(file_hash, '^\\s+|\\s+$', '', 'g')), '^[a-z0-9_\\-]+:\\s*', '')"
DEL = f"""dl AS (SELECT i.repo, i.path, CASE WHEN i.index_batch_id IS NULL THEN -1 ELSE batch_no END no, coalesce(lower(regexp_replace(status, '^\\s+|\\s+$', '', 'g')) = 'succeeded', i.index_batch_id IS NULL) settled, min({_HASH.replace("file_hash", "i.file_hash")}) version
  FROM indexed_items i LEFT JOIN index_batches b ON b.index_batch_id = i.index_batch_id WHERE i.index_batch_id IS NULL OR batch_no IS NOT NULL GROUP BY ALL)"""
_USE = """use AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY repo, item_id ORDER BY vec_id) k FROM item_embeddings
  WHERE provider = 'quarrystone' AND model = 'qs-embed-64' AND dimension = 64 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE k = 1)"""
_ALIAS = ", ".join("('{}', [{}])".format(t, ", ".join(f"'{x}'" for x in to)) for t, to in ALIASES)

ORACLE: dict[str, str] = {
    "scan_items_filtered": f"WITH {CUR} SELECT repo, id, title, start_line FROM cur WHERE asset_type = 'code' AND language = 'java' AND symbol_type IN ('method', 'class')",
    "scan_symbols_filtered": f"WITH {SYM} SELECT repo, symbol_id, path, kind FROM sym WHERE kind IN ('class', 'table') AND repo = 'scm.norvale.example/platform/hub-monolith'",
    "list_paths_prefix": f"WITH {CUR} SELECT DISTINCT path FROM cur WHERE starts_with(path, 'tr')",
    "path_glob_include_exclude": "SELECT DISTINCT path FROM indexed_items WHERE (ends_with(path, '.java') OR ends_with(path, '.md')) AND NOT list_contains(string_split(path, '/'), 'guides') AND NOT contains(path, '/test/')",
    "point_lookup_first_repo": f"WITH {CUR} SELECT id, repo, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY repo) k FROM cur) WHERE k = 1",
    "quarantine": """SELECT reason, count(*) n FROM (SELECT CASE WHEN coalesce(length(id), 0) = 0 THEN 'empty identity' WHEN coalesce(length(repo), 0) = 0 THEN 'no repo'
  WHEN coalesce(length(title), 0) = 0 OR coalesce(length(content), 0) = 0 OR coalesce(length(summary), 0) = 0 THEN 'empty text'
  WHEN NOT coalesce(asset_type IN ('code', 'db_schema', 'doc'), false) THEN 'unknown asset type' WHEN asset_type IS DISTINCT FROM source_type THEN 'asset type is not source type'
  WHEN coalesce(least(start_line, end_line) < 1, false) THEN 'line below 1' WHEN coalesce(end_line < start_line, false) THEN 'reversed lines'
  WHEN asset_type = 'code' AND (path IS NULL OR start_line IS NULL OR end_line IS NULL) THEN 'code without place' WHEN asset_type = 'db_schema' AND table_name IS NULL THEN 'schema without table'
  WHEN asset_type = 'doc' AND (path IS NULL OR heading_path IS NULL OR start_line IS NULL OR end_line IS NULL) THEN 'doc without place' END reason FROM indexed_items) WHERE reason IS NOT NULL GROUP BY 1""",
    "upsert_last_wins": f"WITH {CUR} SELECT repo, id, row_seq, title FROM cur",
    "delete_by_path_cascade": f"WITH {CUR} SELECT e.vec_id FROM item_embeddings e WHERE EXISTS (SELECT 1 FROM cur WHERE cur.repo = e.repo AND cur.id = e.item_id AND NOT coalesce(ends_with(path, '.md'), false))",
    "delete_by_prefix": f"WITH {SYM} SELECT repo, count(*) n FROM sym WHERE NOT coalesce(repo = 'scm.norvale.example/platform/hub-monolith' AND starts_with(path, 't'), false) GROUP BY 1",
    "incremental_plan_setops": f"""WITH {DEL}, p AS (SELECT concat_ws('/', repo, path) path, no, version h FROM dl), c AS (SELECT max(batch_no) * 2 / 3 cut FROM index_batches),
n AS (SELECT path, arg_max(h, no) h FROM (SELECT path, no, h FROM p, c WHERE no > cut) GROUP BY 1), n0 AS (SELECT DISTINCT path FROM p, c WHERE no > cut),
nn AS (SELECT n0.path, (SELECT h FROM p, c WHERE no > cut AND p.path = n0.path ORDER BY no DESC LIMIT 1) h FROM n0),
o AS (SELECT path, min(h) lo, max(h) hi, count(*) FILTER (h IS NULL) nulls FROM p, c WHERE no <= cut GROUP BY 1)
SELECT nn.path, CASE WHEN coalesce(lo = h AND hi = h AND nulls = 0, false) THEN 'unchanged' ELSE 'changed' END change FROM nn LEFT JOIN o ON o.path = nn.path
UNION ALL SELECT path, 'deleted' FROM o WHERE path NOT IN (SELECT path FROM n0)""",
    "p2_found": f"""WITH {DEL}, a AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY no DESC) k FROM dl), s AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY no DESC) k FROM dl WHERE settled)
SELECT a.repo, a.path FROM a LEFT JOIN s ON s.repo = a.repo AND s.path = a.path AND s.k = 1 WHERE a.k = 1 AND NOT a.settled AND NOT coalesce(a.version = s.version, false)""",
    "p2_ledger": f"WITH {DEL} SELECT repo, path, version, no::BIGINT AS no FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY no DESC) k FROM dl WHERE settled) WHERE k = 1",
    "provenance_hash_distinct": "SELECT repo, count(DISTINCT sha256(content)) contents, min(sha256(content)) least FROM indexed_items WHERE content IS NOT NULL GROUP BY 1",
    "ascii_tokens": f"SELECT token, count(*) n FROM (SELECT unnest({found('text')}) token FROM documents) GROUP BY 1",
    "camel_split_tokens": f"SELECT token, count(*) n FROM (SELECT unnest({tokens('title')}) token FROM indexed_items) GROUP BY 1",
    "symbol_terms": f"WITH {ALL} SELECT query_id, unnest({terms('query_text')}) term FROM req",
    "keyword_candidates": f"WITH {CUR}, {REQ}, {QTOK}, {CAND} SELECT query_id, repo, id, match_count, place FROM cand",
    "weighted_tf_doc_length": f"WITH {CUR}, {REQ}, {QTOK}, {CAND}, {POST}, {STAT} SELECT query_id, repo, id, round(length, 6) length, n, round(avg_length, 6) avg_length FROM stat",
    "document_frequency": f"WITH {CUR}, {REQ}, {QTOK}, {CAND}, {POST} SELECT query_id, token, count(*) df, round(sum(wtf), 6) wtf FROM post GROUP BY ALL",
    "bm25_topk": f"WITH {LEX} SELECT * FROM lex",
    "alias_expand_match": f"WITH {ALL}, a(term, expands_to) AS (VALUES {_ALIAS}) SELECT query_id, term FROM req JOIN a ON contains(lower(query_text), lower(term)) OR len(list_filter(expands_to, lambda x: contains(lower(query_text), lower(x)))) > 0",
    "cosine_topk": """WITH q AS (SELECT vec_id query_id, embedding qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[])), 6) score FROM embeddings JOIN q ON vec_id <> query_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) place FROM s) WHERE place <= 10""",
    "cosine_topk_filtered_identity": f"""WITH {CUR}, {_USE}, q AS (SELECT vec_id query_id, repo, embedding qv FROM use WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, c.repo, c.id, round(greatest(0, list_cosine_similarity(u.embedding, q.qv)), 6) score FROM q JOIN cur c ON c.repo = q.repo AND c.asset_type = 'code' JOIN use u ON u.repo = c.repo AND u.item_id = c.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, repo) k FROM s WHERE score > 0)
SELECT query_id, repo, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, id) AS "rank", score raw_score FROM k WHERE k <= 30""",
    "embedding_left_first": f"""WITH {CUR}, e AS (SELECT *, row_number() OVER (PARTITION BY repo, item_id ORDER BY provider, model, dimension, vec_id) k FROM item_embeddings)
SELECT c.repo, c.id, provider, model, dimension FROM cur c LEFT JOIN e ON e.repo = c.repo AND e.item_id = c.id AND e.k = 1""",
    "symbol_exact": f"WITH {SYM}, {NAMES} SELECT row_seq, term, s.repo, symbol_id FROM sym s JOIN t ON t.repo = s.repo AND term IN (name, qualified_name, symbol_id)",
    "symbol_prefix": f"WITH {SYM}, {NAMES}, u AS (SELECT row_seq, repo, substr(term, 1, greatest(0, length(term) - 3)) term FROM t) SELECT row_seq, term, s.repo, symbol_id FROM sym s JOIN u ON u.repo = s.repo AND term <> '' AND (starts_with(name, term) OR starts_with(qualified_name, term))",
    "symbol_ladder": f"WITH {SYM}, {REQ}, {LADDER} SELECT query_id, repo, symbol_id, score, reason FROM lad",
    "symbol_to_item_dedupe": f"WITH {CUR}, {SYM}, {REQ}, {LADDER}, {SYMHITS} SELECT * FROM syh",
    "rrf_fusion": f'WITH {CHAN}, {RRF} SELECT query_id, repo, id, score, "rank", match_reason FROM top',
    "rrf_score_parts": f"WITH {CHAN}, {RRF} SELECT query_id, repo, id, round(coalesce(lexical, 0), 6) keyword, round(coalesce(lexical, 0), 6) lexical, round(coalesce(vec, 0), 6) vector, round(coalesce(sym, 0), 6) symbol, score rrf FROM top",
    "trace_by_channel": f"""WITH {CHAN} SELECT query_id, channel, count(*) candidate_count, array_to_string(list(id ORDER BY "rank"), ' | ') ids FROM hits GROUP BY ALL""",
    "hybrid_search_topk": f"""WITH {LEX}, {SYM}, {LADDER}, {SYMHITS}, hits AS (SELECT * FROM lex UNION ALL SELECT * FROM syh), {RRF}
SELECT query_id, repo, id, score, "rank", round(coalesce(lexical, 0), 6) keyword, round(coalesce(sym, 0), 6) symbol, match_reason FROM top""",
    "stale_index_flag": f"WITH {LEX} SELECT r.query_id, r.query_id % 40 = 0 AND EXISTS (SELECT 1 FROM lex WHERE lex.query_id = r.query_id) AS stale FROM req r",
    "cross_repo_risk": "SELECT query_id, count(DISTINCT repo) repos, count(DISTINCT repo) > 1 cross_repo FROM search_results GROUP BY 1",
    "context_dedupe": f"""WITH {RES}, {DEDUPE} SELECT query_id, grp "group", rk AS "rank", CASE grp WHEN 'related_docs' THEN 'background' WHEN 'similar_implementations' THEN 'related' ELSE 'primary' END evidence_role FROM ded""",
    "context_token_cost": f"SELECT row_seq, {cost('(' + _TEXT + ')')} AS cost FROM indexed_items",
    "context_token_budget": f"""WITH RECURSIVE {RES}, {DEDUPE}, {BUDGET} SELECT query_id, grp "group", rk AS "rank", cost FROM kept""",
    "missing_context": f"WITH RECURSIVE {RES}, {DEDUPE}, {BUDGET}, {MISS} SELECT query_id, array_to_string(m, ',') missing FROM mis",
    "incomplete_provenance": f"WITH {RES} SELECT query_id, {_LACKS} incomplete FROM res GROUP BY 1",
    "context_risks": f"""WITH RECURSIVE {RES}, {DEDUPE}, {BUDGET}, {MISS}, k AS (SELECT query_id, max(score) < 0.01 low, {_LACKS} inc FROM kept WHERE grp <> 'similar_implementations' GROUP BY 1)
SELECT mis.query_id, array_to_string(list_concat(list_transform(m, lambda x: 'MISSING_CONTEXT'), list_filter([CASE WHEN low THEN 'LOW_CONFIDENCE' END, CASE WHEN inc THEN 'INCOMPLETE_PROVENANCE' END, CASE WHEN mis.query_id % 5 = 0 THEN 'STALE_INDEX' END], lambda x: x IS NOT NULL)), ',') risks
FROM mis LEFT JOIN k ON k.query_id = mis.query_id""",
    "citations_unique": f"""WITH {RES}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, {_SRC} ORDER BY {AT_BUDGET}, rk) k FROM res)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {AT_BUDGET}, rk) place, repo, path, start_line, end_line, symbol, table_name, column_name, heading_path FROM f WHERE k = 1""",
    "eval_hit_at_k": f"WITH {RES}, {EVAL} SELECT sample_id, first_rank, hit FROM ju",
    "eval_irrelevant": f"WITH {RES}, {EVAL} SELECT sample_id, irrelevant FROM ju",
    "eval_completeness": f"WITH {RES}, {EVAL} SELECT sample_id, returned, sourced, failed FROM ju",
    "eval_mrr": f"WITH {RES}, {EVAL} SELECT sample_group, samples, hits, mrr FROM (SELECT sample_group, {_MET} FROM ju GROUP BY 1)",
    "eval_rollup_by_group": f"""WITH {RES}, {EVAL}, m AS (SELECT sample_group, {_MET} FROM ju GROUP BY GROUPING SETS ((sample_group), ()))
SELECT * REPLACE (CASE WHEN sample_group IS NULL THEN (SELECT bool_and(passed) FROM m WHERE sample_group IS NOT NULL) ELSE passed END AS passed) FROM m""",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) events, round(sum(value), 4) total FROM events GROUP BY ALL",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM e)
SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) events FROM s GROUP BY user_id, k""",
}
