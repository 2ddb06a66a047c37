import pytest

from tessera.operators import fusion as U
from tessera.operators import lexical as L
from tessera.operators import symbols as Y
from tessera.operators import vector as V
from tessera.plans.service import Engine, RequestError
from tessera.plans.store import last_wins
from tessera.sources import aliases
from tessera.sources.schema import EMBEDDING, ITEM, SYMBOL, names

REPO = "git.example.com/harbour/quay"


def item(id, title, content="", kind="code", repo=REPO, **more):
    base = {"repo": repo, "id": id, "asset_type": kind, "source_type": kind, "title": title, "content": content or title, "summary": f"{title} summary", "metadata": {}, "path": f"src/{title}.java", "start_line": 10, "end_line": 30}
    if kind == "db_schema":
        base |= {"table_name": title, "start_line": None, "end_line": None, "path": "db/x.sql"}
    if kind == "code":
        base |= {"symbol": title, "language": "java", "symbol_type": "method"}
    if kind == "doc":
        base |= {"heading_path": title, "path": f"docs/{title}.md"}
    return base | more


def items(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in names(ITEM)) for r in rows], ITEM)


def seed(spark):
    return items(
        spark,
        item("code:TideGauge.level", "TideGauge.level", "level of the tide at the gauge for a mooring"),
        item("code:RopeCounter.count", "RopeCounter.count", "print the invoice"),
        item("db_schema:mooring", "mooring", "ropes of a mooring, tide by tide", "db_schema"),
        item("doc:Night Watch", "Night Watch", "how the night watch reads the tide", "doc"),
    )


def embeddings(spark, rows):
    return spark.createDataFrame([(REPO, i, "manual", "dimension-3", 3, list(map(float, v))) for i, v in rows], EMBEDDING)


def symbols(spark, *rows):
    return spark.createDataFrame([tuple({"repo": REPO, "language": "java", **r}.get(n) for n in names(SYMBOL)) for r in rows], SYMBOL)


def engine(spark, data, vectors=None, catalog=(), **more):
    return Engine(data, symbols(spark, *catalog), embeddings(spark, vectors) if vectors else None, identity=V.manual_identity(3) if vectors else None, **more)


def found(answer):
    return [r.id for r in answer.results.orderBy("rank").collect()]


def test_keyword_hit_comes_first(spark):
    rows = engine(spark, seed(spark)).search_code("tide gauge level", 2).results.collect()
    assert [r.id for r in rows] == ["code:TideGauge.level"] and rows[0].score_parts.keyword == 1.0 and rows[0].match_reason.startswith("keyword/lexical hit: gauge, level, tide")


def test_filters_and_repos_apart(spark):
    data = items(spark, item("a", "tide one", path="x/a"), item("b", "tide two", path="y/b", language="sql"), item("a", "tide other", repo="other"))
    e = engine(spark, data)
    assert found(e.search_code("tide", filters={"repo": REPO, "path_prefix": "x/"})) == ["a"]
    assert found(e.search_code("tide", filters={"repo": REPO, "language": "sql"})) == ["b"]
    assert found(e.search_code("tide", filters={"repo": "other"})) == ["a"]
    assert found(e.search_code("tide", filters={"repo": REPO, "symbol_type": ["class"]})) == []
    every = e.search_code("tide")
    assert len(found(every)) == 3 and [x.code for x in every.risks.first().risks] == ["CROSS_REPO_RESULTS"]


def test_commit_filter_comes_before_the_cap(spark):
    data = items(spark, *[item(f"code:stale-{i:02}", "same text", commit_sha="old") for i in range(30)], item("code:zcurrent", "same text", commit_sha="new"))
    e = engine(spark, data)
    assert found(e.search_code("same text", 1, {"repo": REPO, "expected_commit_sha": "new"})) == ["code:zcurrent"]
    none = e.search_code("same text", 1, {"repo": REPO, "expected_commit_sha": "none"})
    assert found(none) == [] and [x.code for x in none.risks.first().risks] == ["STALE_INDEX"]
    assert not e.search_code("nowhere", 1, {"repo": REPO, "expected_commit_sha": "none"}).risks.first().stale


def test_match_count_ranks_before_the_cap(spark):
    data = items(spark, item("code:adapter", "ai adapter", summary="x"), item("code:config", "ai config", summary="x"))
    q = spark.createDataFrame([(1, REPO, "code", ["ai", "config"])], "query_id long, repo string, asset_type string, tokens array<string>")
    first = L.keyword_candidates(data, q, 1).where("place = 1").first()
    assert (first.id, first.match_count) == ("code:config", 2)


def test_vector_channel(spark):
    data, vectors = seed(spark), [("code:TideGauge.level", [1.0, 0.0, 0.0]), ("code:RopeCounter.count", [0.0, 1, 0])]
    rows = engine(spark, data, vectors).search_code("unmatched text", vector=[0, 1, 0]).results.collect()
    assert [(r.id, r.score_parts.vector) for r in rows] == [("code:RopeCounter.count", 1.0)]
    with pytest.raises(V.DimensionError):
        engine(spark, data, vectors).search_code("x", vector=[1, 0])


def test_channels_are_merged(spark):
    data = items(spark, item("k", "rare tide"), item("v", "other"))
    rows = engine(spark, data, [("v", [1.0, 0.0, 0.0])]).search_code("rare tide", vector=[1, 0, 0]).results.orderBy("rank").collect()
    assert [(r.id, r.score_parts.keyword, r.score_parts.vector) for r in rows] == [("k", 1.0, 0.0), ("v", 0.0, 1.0)]


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 0.0]), ([], []), ([1.0, 0.0], [-1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(df.a, df.b)).collect()] == [0.0] * 5
    d = spark.createDataFrame([(0.25,), (None,), (2.0,)], "d double")
    assert [r[0] for r in d.select(V.distance_score(d.d)).collect()] == [0.75, 0.0, 0.0]


def test_without_identity_the_first_vector_counts(spark):
    e = spark.createDataFrame([(REPO, "k", "b", "m", 2, [0.0, 1.0]), (REPO, "k", "a", "m", 3, [1.0, 0.0, 0.0])], EMBEDDING)
    q = spark.createDataFrame([(1, "", REPO, "code", [1.0, 0.0, 0.0])], "query_id long, query_text string, repo string, asset_type string, vector array<double>")
    assert V.vector_recall(items(spark, item("k", "x")), e, q).first().raw_score == 1.0
    assert V.first_embedding(items(spark, item("k", "x"), item("l", "y")), e).orderBy("id").select("provider").collect() == [("a",), (None,)]


CATALOG = [
    {"symbol_id": "java:class:example.TideSurveyDesk", "kind": "class", "name": "TideSurveyDesk", "qualified_name": "example.TideSurveyDesk", "source_item_id": "code:WatchList.enter", "path": "a"},
    {"symbol_id": "java:class:example.TideSurveyDeskTest", "kind": "class", "name": "TideSurveyDeskTest", "qualified_name": "example.TideSurveyDeskTest", "source_item_id": "gone", "path": "a"},
    {"symbol_id": "java:method:example.Other.doTide()", "kind": "method", "name": "doTide", "qualified_name": "example.Other.doTide()", "source_item_id": None, "path": "b"},
]


def test_symbol_only_hit(spark):
    data = items(spark, item("code:WatchList.enter", "WatchList.enter", "nothing here"))
    e = engine(spark, data, catalog=CATALOG)
    row = e.search_code("TideSurveyDesk", filters={"repo": REPO}).results.first()
    assert (row.id, row.score_parts.symbol, row.score_parts.keyword) == ("code:WatchList.enter", 1.0, 0.0) and row.match_reason == "symbol exact hit: TideSurveyDesk"
    assert found(e.search_code("TideSurveyDesk")) == [] and found(e.search_doc("TideSurveyDesk", filters={"repo": REPO})) == []
    trace = e.search_code("TideSurveyDesk", filters={"repo": REPO}).trace().collect()
    assert [(t.channel, t.candidate_count, t.hits[0].rank) for t in trace] == [("symbol", 1, 1)]


def test_symbol_ladder_and_lookups(spark):
    s = symbols(spark, *CATALOG)
    q = spark.createDataFrame([(1, "tide", REPO, "code")], "query_id long, query_text string, repo string, asset_type string")
    got = {r.qualified_name: (r.score, r.reason) for r in Y.ladder(s, Y.with_terms(q)).collect()}
    assert got["example.TideSurveyDesk"] == (0.85, "symbol prefix hit: tide") and got["example.Other.doTide()"] == (0.65, "symbol fuzzy hit: tide")
    assert [r.name for r in Y.find_exact(s, REPO, "TideSurveyDesk").collect()] == ["TideSurveyDesk"]
    assert [r.name for r in Y.find_prefix(s, REPO, "example.Tide", limit=1).collect()] == ["TideSurveyDesk"]
    assert Y.find_exact(s, REPO, "").count() == Y.find_prefix(s, REPO, "x", limit=0).count() == 0


def test_aliases_expand_the_query(spark):
    vocabulary = aliases.from_mapping(spark, {"aliases": [{"term": "现金流审批", "expands_to": ["cashflow approval", "TideSurveyDesk", " "]}, {"term": " ", "expands_to": ["x"]}]})
    data = items(spark, item("code:WatchList.enter", "WatchList.enter", "nothing here"))
    row = engine(spark, data, catalog=CATALOG, aliases=vocabulary).search_code("现金流审批", filters={"repo": REPO}).results.first()
    assert row.score_parts.symbol == 1.0
    q = spark.createDataFrame([(1, "CASHFLOW approval"), (2, "none")], "query_id long, query_text string")
    got = {r.query_id: (r.query_text, r.aliases) for r in aliases.expanded(q, vocabulary).collect()}
    assert got[1] == ("CASHFLOW approval 现金流审批 cashflow approval TideSurveyDesk", ["现金流审批 -> cashflow approval, TideSurveyDesk"]) and got[2] == ("none", [])
    for bad in ([], {"aliases": {}}, {"aliases": ["x"]}, {"aliases": [{"term": "a", "expands_to": "b"}]}):
        with pytest.raises(ValueError):
            aliases.from_mapping(spark, bad)


def test_fusion(spark):
    hits = spark.createDataFrame(
        [(1, "vector", "r", "b", 1, 0.9, "v"), (1, "lexical", "r", "b", 2, 0.5, "l"), (1, "lexical", "r", "a", 1, 1.0, "l"), (1, "symbol", None, "c", 1, 1.0, "s")], "query_id long, channel string, repo string, id string, rank int, raw_score double, reason string"
    )
    rows = U.match_reason(U.rrf(hits, 2)).orderBy("rank").collect()
    assert [(r.id, r.score) for r in rows] == [("b", round(1 / 61 + 1 / 62, 6)), ("c", round(1 / 61, 6))]
    assert rows[0].reasons == ["l", "v"] and rows[0].ranks == {"lexical": 2, "vector": 1} and rows[0].match_reason == "l; v"
    assert U.rrf(hits.orderBy("reason", "id"), None).orderBy("rank").collect() == U.rrf(hits, None).orderBy("rank").collect()


def test_bad_requests(spark):
    e = engine(spark, seed(spark), require_repo=True)
    for call in (lambda: e.search_code(" "), lambda: e.search_code("x", 0), lambda: e.search_code("x", 51), lambda: e.search_code("x"), lambda: e.search_code("x", filters={"repo": REPO, "colour": 1})):
        with pytest.raises(RequestError) as x:
            call()
        assert x.value.envelope()["error"]["code"] == "invalid_request"

    class Broken:
        identity, batch_size = V.manual_identity(3), 1

        def embed(self, texts):
            raise OSError("down")

    with pytest.raises(RequestError) as x:
        Engine(seed(spark), symbols(spark), provider=Broken()).search_code("x")
    assert x.value.code == "embedding_unavailable"


def test_last_row_wins(spark):
    df = spark.createDataFrame([("r", "a", 1, "x"), ("r", "a", 3, "z"), ("r", "a", 2, "y"), ("s", "a", 1, "w")], "repo string, id string, seq int, v string")
    assert sorted(r.v for r in last_wins(df, ("repo", "id"), "seq").collect()) == ["w", "z"]


def test_push_down_and_pruning(spark, tmp_path):
    seed(spark).write.parquet(str(tmp_path / "i"))
    from tessera.operators.filters import item_filter

    df = item_filter(spark.read.parquet(str(tmp_path / "i")), repo=REPO, path_prefix="src/").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(repo" in plan and "StringStartsWi" in plan and "content" not in plan.split("ReadSchema")[1]


def test_unreadable_tables(spark, tmp_path):
    seed(spark).write.parquet(f"{tmp_path}/i")
    data = spark.read.parquet(f"{tmp_path}/i")
    import shutil

    shutil.rmtree(f"{tmp_path}/i")
    with pytest.raises(RequestError) as x:
        engine(spark, data).search_code("tide", filters={"repo": REPO})
    assert x.value.code == "storage_unavailable"
