from tessera.plans.store import Store
from tessera.sources.schema import EMBEDDING
from tessera.streaming import events as E

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def rows(spark):
    import datetime as D

    at = lambda h, m: D.datetime(2025, 1, 1, h, m)
    return spark.createDataFrame([(1, at(1, 0), 1, "view", 1.0), (2, at(1, 10), 1, "view", 2.0), (3, at(3, 0), 1, "click", 3.0), (4, at(1, 5), 2, "view", 4.0)], EVENTS)


def test_windows_and_sessions(spark):
    got = {(r.start.hour, r.event_type): (r.events, r.total) for r in E.windowed_counts(rows(spark), size="1 hour").collect()}
    assert got == {(1, "view"): (3, 7.0), (3, "click"): (1, 3.0)}
    assert E.windowed_counts(rows(spark), size="1 hour", slide="30 minutes").count() == 4
    assert sorted((r.user_id, r.start.hour, r.events) for r in E.sessions(rows(spark)).collect()) == [(1, 1, 2), (1, 3, 1), (2, 1, 1)]


def test_stream_equals_batch(spark, tmp_path):
    rows(spark).repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    q = E.windowed_counts(stream, size="1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(60)
    assert sorted(spark.table("counts").collect()) == sorted(E.windowed_counts(rows(spark), size="1 hour").collect())


def test_each_file_is_taken_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    batch = lambda i, v: spark.createDataFrame([("r", i, "p", "m", 1, [v])], EMBEDDING).selectExpr("*", f"{int(v)} as seq")
    go = lambda: E.follow(spark, f"{tmp_path}/in", EMBEDDING + ", seq int", E.upserting(store, "embeddings", "seq"), f"{tmp_path}/c").awaitTermination(60)
    batch("a", 1.0).write.parquet(f"{tmp_path}/in/1")
    batch("a", 1.0).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    batch("a", 2.0).unionByName(batch("b", 1.0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    go()
    assert {r.item_id: r.embedding for r in store.read("embeddings").collect()} == {"a": [2.0], "b": [1.0]}
