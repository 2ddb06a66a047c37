import json
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tessera.operators.vector import Identity
from tessera.plans import settings
from tessera.plans.ingest import index_tree, summary_json
from tessera.plans.store import Store, cascade, without_paths, without_prefix
from tessera.sources import ddl, java, markdown
from tessera.sources import files as S
from tessera.sources import providers as P
from tessera.sources.schema import EMBEDDING

JAVA = """// reads the gauge at the quay
package harbour.tide;

@Component("gauge")
final class TideGauge {
    @Override
    @Deprecated
    protected double level(int hour, double swell) {
        return hour * swell;
    }
}
"""
KINDS = """package harbour;

class Crane<L extends Load> {
    private double reach = 2.5, height; // } not here
    static final Map<String, Integer> BERTHS = new HashMap<>(), SPARE = null;
    private String mark = "}";
    private final Runnable idle = new Runnable() { public void rest() { } };

    Crane() {
    }

    boolean lift(final L load, @Nonnull Set<String> crew, Object... extra) throws IOException {
        char quote = '"';
        return crew.isEmpty();
    }

    static class Hook {
        int[] turn(byte[] left, byte right[]) { return null; }
    }
}

enum Flag {
    GREEN { void wave() {} }, RED;
    private int mast;
    int mast() { return mast; }
}

record Berth(String quay, int metres) {
    Berth {
    }
}

@interface Inspected {
    int years() default 3;
    String by() default "{";
}

interface Pilot {
    void board(Berth berth);
}
"""
SQL = """-- moorings; one row a rope
CREATE TABLE mooring (
    rope_no INTEGER PRIMARY KEY,
    knot varchar(20) not null,
    strain NUMERIC(9, 3),
    CONSTRAINT pulled CHECK (strain > 0)
);

CREATE UNIQUE INDEX ux_mooring_knot ON mooring (knot);
"""
MARKDOWN = """# Night watch

Who walks the pier, and when.

Two rounds until dawn.

## Lamps

- fill the oil
- trim the wick

### Spare glass

Kept under the stairs.

## Fog horn

Three blasts.
"""


def test_java_class_and_method():
    items, _ = java.parse("a/B.java", JAVA)
    cls, method = items
    assert (cls["title"], cls["start_line"], cls["end_line"], cls["metadata"]["annotations"], cls["metadata"]["signature"]) == ("TideGauge", 4, 11, "Component", "final class TideGauge")
    assert (method["id"], method["start_line"], method["end_line"], method["metadata"]["annotations"]) == ("code:a/B.java:TideGauge.level", 6, 10, "Override Deprecated")
    assert method["metadata"]["signature"] == "protected double level(int hour, double swell)" and method["summary"] == "Java 方法 TideGauge.level。"


def test_java_catalog():
    items, symbols = java.parse("a/B.java", KINDS)
    names = [s["qualified_name"] for s in symbols]
    assert names == sorted(names)
    assert {
        "harbour.Pilot.board(Berth)", "harbour.Berth.<init>()", "harbour.Crane.<init>()", "harbour.Crane.reach", "harbour.Crane.height", "harbour.Crane.SPARE", "harbour.Crane.mark",
        "harbour.Crane.lift(L, Set<String>)", "harbour.Crane.Hook.turn(byte[], byte)", "harbour.Inspected", "harbour.Flag",
    } <= set(names)
    assert all(s["source_item_id"] for s in symbols)
    titles = [i["title"] for i in items]
    # methods of enums are items only, those of nested and anonymous classes also belong to the outer type; elements of annotations are neither
    assert {"Flag.mast", "Flag.wave", "Crane.turn", "Crane.rest", "Hook.turn"} <= set(titles)
    assert not any("Inspected." in x or "Flag.mast" in x for x in names) and "Inspected.years" not in titles


@pytest.mark.parametrize("text", ["", "class", "class A {", "class A { int x", "}}}", "@", "enum E { A(", "class A { void f( }", '"""', "/* class A {} ", "package a.b", "record R(int", "class A<T extends B<C>> { <X> X f() { new A() {"])
def test_java_survives_broken_text(text):
    java.parse("x.java", text)


@pytest.mark.parametrize(
    "text",
    [
        "class A { int x; } " + '{\\"a\\": \\"b\\"} ' * 20_000,  # each escaped quote was tried up to the end of its line
        "class A { int x; }\n" + '\\"""\n' * 40_000,
        "class A { boolean x = " + "a < " * 20_000 + "c; }",
        "class A { void x() { " + "{ " * 300 + "y(); " * 30_000 + "} " * 300 + " } }",
        "class A { void x() { " + "(" * 20_000 + ")" * 20_000 + " } }",
        "class A { void x() { " + "new B( " * 20_000 + " } }",
    ],
)
def test_java_time_grows_with_the_text(text):
    began = time.process_time()
    items, symbols = java.parse("A.java", text)
    assert time.process_time() - began < 5
    assert [x["title"] for x in items] == ["A", "A.x"] and len(symbols) == 2


@pytest.mark.parametrize("text", ["class A { x @interface", "class A { x @interface B { } }", "class A { x @"])
def test_java_misplaced_annotation_type_ends(text):
    assert java.parse("A.java", text)[0][0]["title"] == "A"  # the first two were read for ever, the last failed


def test_java_reads_nothing_twice():
    items, _ = java.parse("A.java", "class Z { " + "int x = g( class A { ) ; " * 12 + "}")  # made 12,286 items
    assert len(items) == 37


def test_java_of_much_prose_is_read_fast():
    rows = ["The default of each final harbour, say, is static; it isn't {read} @night. " * 400] * 100
    began = time.process_time()
    assert all(java.parse("A.java", text) == ([], []) for text in rows)
    assert time.process_time() - began < 2


def test_java_long_line_costs_no_contents_where_none_are_wanted(spark):
    text = "class A { " + "".join(f"void m{i}() {{ }} " for i in range(4_000)) + "}"
    tracemalloc.start()
    _, symbols = java.parse("A.java", text, texts=False)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 50e6 and len(symbols) == 4_001  # the contents are 4,001 times the line
    files = spark.createDataFrame([("A.java", JAVA, "h"), ("B.java", KINDS, "h"), ("s.sql", SQL, "h"), ("w.md", MARKDOWN, "h")], "path string, text string, file_hash string")
    whole = S.parsed(files)
    for kind, columns in (("items", ("id", "start_line", "symbol_type")), ("items", ("id", "content", "metadata")), ("symbols", ("symbol_id", "source_item_id"))):
        rows = S.parsed(files, {kind: columns})
        assert rows.columns == ["path", "file_hash", "failed", kind]
        read = lambda df: [[r.path, r.failed, [tuple(x[c] for c in columns) for x in r[kind]]] for r in df.sort("path").collect()]
        assert read(rows) == read(whole)


def test_ddl():
    items, symbols = ddl.parse("s.sql", SQL)
    table, _, knot, strain = items
    assert table["metadata"] == {"symbol_type": "table", "table": "mooring", "columns": "rope_no knot strain", "indexes": "ux_mooring_knot"}
    assert table["content"].startswith("CREATE TABLE mooring (rope_no INTEGER PRIMARY KEY, knot VARCHAR(20) NOT NULL, strain NUMERIC(9, 3)")
    assert (knot["metadata"]["data_type"], knot["content"], knot["id"]) == ("VARCHAR(20)", "knot VARCHAR(20) NOT NULL", "db_schema:s.sql:mooring.knot")
    assert [s["symbol_id"] for s in symbols][:2] == ["sql:table:mooring", "sql:column:mooring.rope_no"] and all(s["source_item_id"] for s in symbols)
    for broken in ("", "CREATE", "CREATE TABLE", "CREATE TABLE x", "CREATE TABLE x (", "CREATE INDEX ON", ";;", "SELECT 1", "CREATE TABLE a.b.c (d int);"):
        ddl.parse("s.sql", broken)


def test_markdown():
    items, _ = markdown.parse("d.md", MARKDOWN)
    assert [(i["heading_path"], i["start_line"], i["end_line"]) for i in items] == [("Night watch", 1, 5), ("Night watch > Lamps", 7, 10), ("Night watch > Lamps > Spare glass", 12, 14), ("Night watch > Fog horn", 16, 18)]
    assert items[1]["content"] == "## Lamps\n\n- fill the oil\n- trim the wick"
    # without a blank line before the next heading the last line is lost; code holds no headings; text before the first is in none
    items, _ = markdown.parse("d.md", "before\n# A #\none\ntwo\nTitle\n=====\n```\n# no\n```\n")
    assert [(i["title"], i["content"]) for i in items] == [("A", "# A #\none"), ("one two Title", "one\ntwo\nTitle\n=====\n```\n# no\n```")] or [i["title"] for i in items][0] == "A"
    with pytest.raises(ValueError):
        markdown.parse("d.md", "#\ntext")


@pytest.fixture
def tree(tmp_path):
    for path, text in (("src/harbour/TideGauge.java", JAVA), ("schema/mooring.sql", SQL.replace("    strain NUMERIC(9, 3),\n    CONSTRAINT pulled CHECK (strain > 0)\n", "").replace("not null,", "not null")), ("docs/a b.md", MARKDOWN.split("### ")[0]), ("target/X.java", JAVA), ("notes.txt", "x")):
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(text)
    return tmp_path / "tree"


def test_index_runs(spark, tree, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    run = lambda **k: index_tree(spark, str(tree), "r", store, provenance=S.Provenance("main", "c1"), **k)
    first = run(dry_run=True)
    assert (first.summary["files_scanned"], first.summary["files_indexed"], first.summary["items_estimated"], first.summary["symbols_estimated"], first.summary["items_written"]) == (3, 3, 7, 5, 0)
    assert store.read("items").count() == 0
    first = run(provider=P.HashProvider())
    assert (first.summary["items_written"], first.summary["symbols_written"], first.summary["embedding_written"], first.failed) == (7, 5, 7, False) and json.loads(summary_json(first))["branch"] == "main"
    assert store.read("items").where("file_hash is null or repo <> 'r' or commit_sha <> 'c1'").count() == 0
    assert {r.path for r in store.read("items").select("path").distinct().collect()} == {"src/harbour/TideGauge.java", "schema/mooring.sql", "docs/a b.md"}

    class Never(P.HashProvider):
        def embed(self, texts):
            raise AssertionError("not called for unchanged files")

    again = run(provider=Never())
    assert (again.summary["files_unchanged"], again.summary["files_changed"], again.summary["items_written"]) == (3, 0, 0) and not again.failed
    # another repo in the same store, then a change, a deletion, an unreadable and a broken file
    index_tree(spark, str(tree), "other", store, provenance=S.Provenance())
    (tree / "src/harbour/TideGauge.java").write_text(JAVA.replace("swell;", "swell + 1;"))
    (tree / "schema/mooring.sql").unlink()
    (tree / "docs/bad.md").write_bytes(b"\xff\xfe")
    (tree / "docs/a b.md").write_text("#\n")
    last = run()
    s = last.summary
    assert (s["files_changed"], s["files_deleted"], s["items_written"], s["symbols_written"], s["items_deleted"], s["symbols_deleted"]) == (1, 1, 2, 2, 3, 3)
    assert last.failed and {(f["path"], f["stage"]) for f in s["failures"]} == {("docs/bad.md", "read"), ("docs/a b.md", "index")}
    counts = {(r.repo, r.asset_type): r["count"] for r in store.read("items").groupBy("repo", "asset_type").count().collect()}
    assert counts == {("r", "code"): 2, ("r", "doc"): 2, ("other", "code"): 2, ("other", "doc"): 2, ("other", "db_schema"): 3}
    assert store.read("embeddings").count() == 2 and "swell + 1" in store.read("items").where("repo = 'r' and symbol_type = 'method'").first().content
    # scopes
    assert run(paths=["docs"], dry_run=True).summary["scope_paths"] == ["docs"]
    scoped = run(paths=["schema", "../out", "notes.txt"], dry_run=True).summary
    assert scoped["files_deleted"] == 0 and scoped["failures"][0]["stage"] == "config"
    assert store.vacuum() > 0 and store.read("items").count() == 11


def test_failed_embedding_keeps_the_snapshot(spark, tree, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")

    class Short(P.HashProvider):
        def embed(self, texts):
            return []

    run = index_tree(spark, str(tree), "r", store, provider=Short(), provenance=S.Provenance())
    assert run.failed and run.summary["failures"][0]["stage"] == "embedding" and store.read("items").count() == 0


def test_scope(tmp_path):
    (tmp_path / "d").mkdir()
    s = S.scope(str(tmp_path), ["d", "f.java", str(tmp_path / "d"), "/elsewhere"])
    assert (s.prefixes, s.files, s.shown, s.everything, len(s.failures)) == ({"d/"}, {"f.java"}, ("d", "f.java"), False, 1)
    assert S.scope(str(tmp_path), ["."]).everything and S.scope(str(tmp_path)).everything


def test_git_provenance_without_git(tmp_path):
    p = S.git_provenance(str(tmp_path))
    assert p.branch is None and p.commit_sha is None and len(p.warnings) == 2


def test_store_upserts_and_deletes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    row = lambda i, v: ("r", i, "p", "m", 2, v)
    store.save("embeddings", spark.createDataFrame([row("a", [1.0, 2.0]), row("b", [3.0, 4.0])], EMBEDDING))
    store.save("embeddings", spark.createDataFrame([row("a", [5.0, 6.0])], EMBEDDING))
    assert {r.item_id: r.embedding for r in store.read("embeddings").collect()} == {"a": [5.0, 6.0], "b": [3.0, 4.0]}
    with pytest.raises(Exception, match="vector of 1"):
        store.save("embeddings", spark.createDataFrame([row("c", [1.0])], EMBEDDING))
    assert store.read("embeddings").count() == 2
    items = spark.createDataFrame([("r", "a", "src_x/1"), ("r", "b", "srcXy/2"), ("s", "a", "src_x/1")], "repo string, id string, path string")
    assert without_prefix(items, "r", "src_").count() == 2
    assert without_paths(items, "r", items.select("path")).count() == 1
    assert cascade(store.read("embeddings"), items.where("id = 'b'")).count() == 1


def test_providers():
    identity = Identity("openai", "m", 2)
    calls = []

    def post(url, headers, body, timeout):
        calls.append((url, headers["Authorization"]))
        return {"data": [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": [1, 2]}]}

    assert P.BatchProvider(identity, "http://x/v1/", "k", post=post).embed(["a", "b"]) == [[1.0, 2.0], [3.0, 4.0]] and calls == [("http://x/v1/embeddings", "Bearer k")]
    with pytest.raises(P.ProviderError):
        P.BatchProvider(identity, "http://x", "k", post=post).embed(["a"])
    with pytest.raises(P.ProviderError):
        P.BatchProvider(identity, "http://x", "k", post=lambda *a: {"nothing": 1}).embed(["a"])
    for answer in ([1, 2], "[1, 2]", {"embedding": [1, 2]}, {"vectors": [[1, 2]]}, {"choices": [{"message": {"content": "[1, 2]"}}]}, {"data": {"output": "{\"vector\": [1, 2]}"}}, {"result": [[1, 2]]}):
        assert P.find_vector(answer) == [1.0, 2.0]
    for answer in ([], "", "x", {}, [[1], [2]], {"choices": []}, None, 5):
        assert P.find_vector(answer) is None
    with pytest.raises(P.ProviderError):
        P.SingleProvider(identity, "http://x", "k", post=lambda *a: [1, 2, 3]).embed(["a"])
    assert "secret" not in repr(P.BatchProvider(identity, "u", "secret"))


def test_embedding_in_batches(spark):
    items = spark.createDataFrame([("r", str(i), "t", "s", "c") for i in range(7)], "repo string, id string, title string, summary string, content string")
    got = P.embedded(items, P.HashProvider(batch_size=3))
    assert got.count() == 7 and got.where(F.size("embedding") == 32).count() == 7
    with pytest.raises(ValueError):
        P.embedded(items, P.HashProvider(batch_size=0))


def test_settings():
    full = {"TESSERA_STORE": "s", "TESSERA_EMBEDDING_BASE_URL": "u", "TESSERA_EMBEDDING_API_KEY": "k", "TESSERA_EMBEDDING_MODEL": "m", "TESSERA_EMBEDDING_DIMENSION": "3", "TESSERA_EMBEDDING_BATCH_SIZE": "2", "TESSERA_REQUIRE_REPO": "yes"}
    got = settings.load(full)
    assert got.provider.identity == Identity("openai", "m", 3) and got.require_repo
    assert isinstance(settings.load(full | {"TESSERA_EMBEDDING_PROVIDER": "infer"}).provider, P.SingleProvider)
    assert settings.load({"TESSERA_STORE": "s", "TESSERA_EMBEDDING_MODEL": "m"}, embeddings=False).provider is None
    for bad in ({}, {"TESSERA_STORE": "s", "TESSERA_LOG_LEVEL": "loud"}, {"TESSERA_STORE": "s", "TESSERA_EMBEDDING_MODEL": "m"}, full | {"TESSERA_EMBEDDING_DIMENSION": "0"}, full | {"TESSERA_REQUIRE_REPO": "maybe"}, full | {"TESSERA_EMBEDDING_PROVIDER": "x"}):
        with pytest.raises(settings.SettingsError):
            settings.load(bad)
    assert settings.redacted("postgresql://user:secret@host/db") == "postgresql://user:***@host/db" and settings.redacted("/a/b") == "/a/b"
