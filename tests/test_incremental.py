from pyspark.sql import functions as F

from tessera.operators import incremental as N

BATCH = "index_batch_id string, batch_no int, status string"
RUNS = BATCH + ", repo string"
ITEM = "repo string, path string, index_batch_id string, file_hash string"


def found(df):
    return {(r.repo, r.path): r.version for r in df.collect()}


def test_plan(spark):
    stored = spark.createDataFrame([("same", "1"), ("same", "1"), ("mixed", "1"), ("mixed", "2"), ("changed", "1"), ("gone", "1"), ("emptied", "1"), ("failed", "1"), ("null", None)], "path string, file_hash string")
    current = spark.createDataFrame([("same", "1", 2), ("mixed", "1", 2), ("changed", "2", 1), ("new", "1", 3), ("emptied", "2", 0), ("blank", "1", 0), ("null", "1", 1)], "path string, file_hash string, items int")
    got = {r.path: r.change for r in N.plan(current, stored, spark.createDataFrame([("failed",)], "path string")).collect()}
    assert got == {"same": "unchanged", "mixed": "changed", "changed": "changed", "new": "changed", "emptied": "deleted", "blank": "empty", "gone": "deleted", "null": "changed"}


def test_pending_files(spark):
    batches = spark.createDataFrame([("b1", 1, "succeeded", "r"), ("b2", 2, " Failed", "r"), ("b3", 3, "SUCCEEDED ", "r"), ("b4", 4, "running", "r"), ("b5", 5, None, "r")], RUNS)
    rows = [
        ("r", "old", None, "1"), ("r", "old", "b2", "SHA256: 1 "),  # same as before all batches
        ("r", "retried", "b2", "1"), ("r", "retried", "b3", "1"),
        ("r", "changed", "b1", "1"), ("r", "changed", "b4", "2"),
        ("r", "back", "b1", "1"), ("r", "back", "b3", "2"), ("r", "back", "b4", "1"),
        ("r", "new", "b4", "1"), ("r", "hashless", "b1", None), ("r", "hashless", "b5", None),
        ("r", "known", "b3", "9"), ("r", "known", "b4", "9"), ("r", "lost", "gone", "1"), (None, None, "b4", "3"),
    ]
    items = spark.createDataFrame(rows, ITEM)
    done = N.ledger(items, batches)
    got = found(N.pending(items, batches, done))
    assert got == {("r", "changed"): "2", ("r", "back"): "1", ("r", "new"): "1", ("r", "hashless"): None, (None, None): "3"}
    # a run over them that fails leaves the ledger; one that succeeds moves it, once and for all
    assert found(N.pending(items, batches, done)) == got
    later = N.advance(done, N.pending(items, batches, done))
    assert found(N.pending(items, batches, later)) == {("r", "hashless"): None}
    assert sorted(map(str, N.advance(later, N.pending(items, batches, done)).collect())) == sorted(map(str, later.collect()))


def test_marks_move_with_each_repo(spark):
    rows = [("a", 1, "succeeded", "r"), ("b", 2, " Running", "r"), ("c", 3, "succeeded", "r"), ("d", 4, "failed", "s"), ("e", 5, None, "s")]
    assert {r.repo: r.since for r in N.marks(spark.createDataFrame(rows, RUNS)).collect()} == {"r": 2, "s": 6}
    assert {r.no for r in N.unsettled(spark.createDataFrame(rows, RUNS)).collect()} == {2, 4, 5}
    assert N.marks(spark.createDataFrame([], RUNS)).count() == 0


def test_a_stored_ledger_survives_failures(spark, tmp_path, monkeypatch):
    """Runs over growing batches: each takes what is new, once, whatever failed in between."""
    runs = [("b1", 1, "succeeded", "r"), ("b2", 2, "failed", "r"), ("b3", 3, "running", "r")]
    rows = [("r", "a", "b1", "1"), ("r", "a", "b2", "2"), ("r", "b", "b2", "1"), ("r", "c", "b3", "1"), ("r", "d", "b1", "1"), ("r", "d", "b2", "1")]
    frames = lambda: (spark.createDataFrame(rows, ITEM), spark.createDataFrame(runs, RUNS))
    items, batches = frames()
    kept = N.Ledger(spark, f"file://{tmp_path}/ledger")
    kept.start(items, batches)
    want = {("r", "a"): "2", ("r", "b"): "1", ("r", "c"): "1"}
    assert found(kept.pending(items, batches)) == want
    write = N.advance
    monkeypatch.setattr(N, "advance", lambda *x: 1 / 0)
    for _ in range(2):
        try:
            kept.commit(kept.pending(items, batches), batches)
        except ZeroDivisionError:
            pass
        # the next run opens the ledger anew
        kept = N.Ledger(spark, f"file://{tmp_path}/ledger")
        assert found(kept.pending(items, batches)) == want
    monkeypatch.setattr(N, "advance", write)
    taken = kept.pending(items, batches).cache()
    kept.commit(taken, batches)
    assert found(kept.pending(items, batches)) == {} and {r.repo: r.since for r in kept.since().collect()} == {"r": 3}
    before = sorted(map(str, kept.read().collect()))
    kept.commit(taken, batches)
    assert sorted(map(str, kept.read().collect())) == before and len(kept._versions()) == 2
    # b3 goes on and succeeds, b4 fails: what was taken isn't taken again, late rows of b3 are settled, b4's changes are new
    runs[2] = ("b3", 3, "succeeded", "r")
    runs.append(("b4", 4, "failed", "r"))
    rows += [("r", "c", "b3", "1"), ("r", "e", "b3", "5"), ("r", "e", "b4", "5"), ("r", "b", "b4", "2"), ("r", "a", "b4", " MD5: 2")]
    items, batches = frames()
    kept.settle(items, batches)
    assert found(kept.pending(items, batches)) == {("r", "b"): "2"}


def test_empty_and_extra_columns(spark):
    batches = spark.createDataFrame([], RUNS)
    items = spark.createDataFrame([], ITEM + ", no int, settled string, version string")
    assert N.pending(items, batches, N.ledger(items, batches)).count() == 0
    items = spark.createDataFrame([("r", "p", None, "1", 7, "x", "y")], ITEM + ", no int, settled string, version string")
    assert found(N.ledger(items, batches)) == {("r", "p"): "1"}


def test_hashes_are_normalised(spark):
    df = spark.createDataFrame([(x,) for x in (" SHA256: AbC ", "abc", "\tabc\n", None, "")], "h string")
    assert [r[0] for r in df.select(N.plain_hash(F.col("h"))).collect()] == ["abc", "abc", "abc", None, ""]
