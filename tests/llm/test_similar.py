"""Near-duplicates and checks against history, held against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import history as H
from tessera.llm import neardup as N
from tessera.llm import shingles as S

WORDS = [f"w{i}" for i in range(400)]


def texts(seed=1, families=25, hot=0):
    """Families of edited texts, some with a head that many share, and unusual rows."""
    rng, out = random.Random(seed), []
    for f in range(families):
        head = [f"head{i}" for i in range(hot)]
        base = head + [rng.choice(WORDS) for _ in range(rng.randint(28, 120))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                i = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(i, rng.choice(WORDS)), lambda: w.insert(i, rng.choice(WORDS)), lambda: w.pop(i)])()
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[k:] + w[:k]
            out.append(" ".join(w).upper() if rng.random() < 0.3 else ", ".join(w))
    out += [None, "", "  \n", "short text", out[0], out[0], "一二三四五六七八九十" * 4, "一二三四五六七八九十" * 4 + "x", "only " * 50]
    return out


def triples(text, k=3, least=30):
    w = S.words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= least else None


def similarity(a, b):
    return len(a & b) / len(a | b) if a is not None and b is not None else 0.0


def frame(spark, rows):
    return spark.createDataFrame([(i, f"r{i % 3}", f"id{i}", t) for i, t in enumerate(rows)], "row_seq long, repo string, id string, content string").repartition(3)


def brute(rows, t):
    sets = [triples(x) for x in rows]
    return {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if similarity(sets[i], sets[j]) >= t}


@pytest.mark.parametrize("t,hot", [(0.7, 0), (0.7, 40), (0.9, 0)])
def test_pairs_equal_brute_force(spark, t, hot):
    rows = texts(3, hot=hot)
    df = frame(spark, rows)
    classes, links = N.near_duplicates(df, "row_seq", "content", t, 3, 30)
    got = {(r.row_a, r.row_b) for r in N.row_pairs(df, classes, links, "row_seq", "content", ["repo", "id"]).collect()}
    assert got == brute(rows, t) and len(got) >= 10


def test_large_blocks_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_BLOCK", 6)
    monkeypatch.setattr(S, "CELL", 4)
    monkeypatch.setattr(S, "CELL_FAN", 2)
    rows = texts(5, families=40, hot=25)
    df = frame(spark, rows)
    classes, links = N.near_duplicates(df, "row_seq", "content", 0.7, 3, 30)
    got = {(r.row_a, r.row_b) for r in N.row_pairs(df, classes, links, "row_seq", "content", ["repo", "id"]).collect()}
    assert got == brute(rows, 0.7)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    sets = [rng.choice(3000, rng.integers(30, 90), replace=False).astype(np.int64) for _ in range(60)]
    sets += [np.r_[s[: len(s) - 4], rng.choice(10**6, 3)] for s in sets[:30]]
    got = [S.signature(x) for x in sets]
    n, c, sig = np.array([len(x) for x in sets]), np.array([x[1] for x in got]), np.stack([x[0] for x in got])
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= 0.7}
    # all in one block, each under two of five keys, and roles that keep new from new
    for blocks in (1, 5):
        key = np.concatenate([np.arange(90) % 30 % blocks, np.arange(90) // 7 % blocks + 10])
        role = np.tile(np.where(np.arange(90) < 60, 3 | 64, 3 | 32), 2)
        x = np.arange(180) % 90
        for roles in (np.full(180, 3), role):
            tree = S.SignatureTree(key, n[x], c[x], sig[x], roles)
            found = {(min(x[a], x[b]), max(x[a], x[b])) for i, j in tree.pairs(0.7) for a, b in zip(i.tolist(), j.tolist()) if x[a] != x[b]}
            meet = {(i, j) for i, j in want if (roles[i] & 96) == 0 or roles[i] & 96 != roles[j] & 96}
            assert meet <= found and len(found) < 90 * 89 / 2 / 4 and len(want) >= 25
            assert all((roles[i] & 96) == 0 or roles[i] & 96 != roles[j] & 96 for i, j in found)
            assert tree.kept < tree.seen / 2


def test_tree_in_chunks_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 50)
    monkeypatch.setattr(N, "CHUNK", 3)
    rows = texts(6, hot=20) + texts(6, hot=20)[:8] * 4
    df = frame(spark, rows).coalesce(1)
    classes, links = N.near_duplicates(df, "row_seq", "content", 0.7, 3, 30)
    got = [(r.row_a, r.row_b) for r in N.row_pairs(df, classes, links, "row_seq", "content", ["repo", "id"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.7)


def test_segments_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    met = apart = 0
    far = np.unique(rng.integers(-(2**63), 2**63 - 1, 40))
    for trial in range(600):
        n, t = int(rng.integers(1, 150)), float(rng.choice([0.5, 0.7, 0.8]))
        x = rng.integers(-(2**63), 2**63 - 1, n)
        keep = int(np.ceil(n * rng.uniform(t, 1)))
        y = np.r_[rng.permutation(x)[:keep], rng.integers(-(2**63), 2**63 - 1, int(rng.integers(0, n + 1)))]
        # some tokens are frequent, for a few sets most of them
        hot = {*x[: n // int(rng.choice([2, 10, 50]))].tolist()}
        rank = lambda s: np.array([int(v in hot) for v in s.tolist()])
        for a, b in ((x, y), (y, x)):
            a, b = np.unique(a), np.unique(b)
            # beside a set of its own, whose keys are the other's
            x1, y1 = H.Cut(np.r_[a, far], np.array([len(a), 40]), np.r_[rank(a), np.zeros(40, int)], t), H.Cut(np.r_[far, b], np.array([40, len(b)]), np.r_[np.zeros(40, int), rank(b)], t)
            (p, po), (s, so) = x1.probed(), y1.stored()
            meet = np.isin(p[po == 0], s[so == 1]).any()
            assert np.isin(s[so == 0], p[po == 1]).any()
            if len({*x} & {*y}) / len({*x} | {*y}) >= t:
                assert meet, (trial, n, t)
                met += 1
            apart += not meet
    assert met > 200 and apart > 50


def test_bitmaps_hold_all_keys(spark):
    rng = np.random.default_rng(8)
    keys = rng.integers(-(2**63), 2**63 - 1, 3000)
    counts = spark.createDataFrame([(int(k), 1 + i % 2) for i, k in enumerate(keys)], "key long, f long")
    any_, several = S.key_bitmaps(counts, 3000)
    assert S.in_bitmap(any_, keys).all() and S.in_bitmap(several, keys[1::2]).all() and S.in_bitmap(several, keys[::2]).mean() < 0.05
    assert S.in_bitmap(any_, rng.integers(-(2**63), 2**63 - 1, 3000)).mean() < 0.05


def test_groups(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 9), (8, 9), (6, 10), (10, 11), (11, 12), (12, 13), (20, 20)], "a long, b long")
    got = {r.node: r.root for r in N.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 10: 5, 11: 5, 12: 5, 13: 5, 7: 7, 8: 7, 9: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in N.components(chain).collect()} == {0}


ITEM = "row_seq long, repo string, id string, index_batch_id string, file_hash string, content string"


def history_brute(rows, batches, t=0.7):
    no = {b: n for b, n, _ in batches}
    at = lambda r: -1 if r[3] is None else no.get(r[3])
    norm = lambda h: None if h is None else h.strip().lower().split(":")[-1].strip()
    sets = [triples(r[5]) for r in rows]
    out = {}
    for i, r in enumerate(rows):
        if at(r) is None:
            continue
        for j, q in enumerate(rows):
            if at(q) is None or at(q) >= at(r):
                continue
            if norm(r[4]) is not None and norm(r[4]) == norm(q[4]):
                out[r[0]] = "same"
            elif out.get(r[0]) != "same" and r[1:3] != q[1:3] and similarity(sets[i], sets[j]) >= t:
                out[r[0]] = "near"
    return out


def history_rows(seed=7):
    rng = random.Random(seed)
    batches = [(f"b{i}", i, "succeeded") for i in range(6)]
    ids = [None, *(b for b, _, _ in batches), "lost"]
    rows = [(i, rng.choice(["r", "s", None]), f"id{rng.randrange(30)}", rng.choice(ids), rng.choice([None, f"h{rng.randrange(60)}", f" SHA256: H{rng.randrange(60)}"]), t) for i, t in enumerate(texts(seed))]
    return rows, batches


@pytest.mark.parametrize("loads", [1, 3])
def test_history_equals_brute_force(spark, loads):
    rows, batches = history_rows()
    items = spark.createDataFrame(rows, ITEM).repartition(3)
    b = spark.createDataFrame(batches, "index_batch_id string, batch_no int, status string")
    got = [tuple(r) for r in H.repeated_rows(items, b, 0.7, 3, 30, loads).collect()]
    want = history_brute(rows, batches)
    assert dict(got) == want and len(got) == len(want) and {"same", "near"} == set(want.values())


ROW = "row_seq long, repo string, id string, no long, file_hash string, content string"


def into(spark, rows):
    return H.delivered(spark.createDataFrame(rows, ROW), "row_seq", "content", "file_hash", ["repo", "id"], F.col("no"))


def test_index_kept_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "HOT_BLOCK", 6)
    monkeypatch.setattr(S, "CELL", 4)
    root = f"file://{tmp_path}/index"
    all_texts = texts(9, families=12)
    rows = [(i, ["r", None][i % 2], f"id{i % 30}", i // 25, f"h{i}" if i % 9 else None, x) for i, x in enumerate(all_texts)]
    rows += [(500 + i, "s", f"id{i}", rows[-1][3] + 1, f" SHA1: H{i}" if i % 2 else None, x) for i, x in enumerate(all_texts[:10])]
    want = history_brute([(*r[:3], f"b{r[3]}", *r[4:]) for r in rows], [(f"b{i}", i, "") for i in range(9)])
    got = {}
    for no in sorted({r[3] for r in rows}):
        # opened anew, as by another run
        index = H.SegmentIndex(spark, root, 0.7, 3, 30)
        part = into(spark, [r for r in rows if r[3] == no])
        got |= {r.row: r.kind for r in index.check(part).collect()}
        index.accept(f"batch-{no}", part)
        index.close()
    assert got == want and {"same", "near"} == set(want.values())
    with pytest.raises(ValueError):
        H.SegmentIndex(spark, root, 0.8, 3, 30)


def test_known_contents_are_not_cut_again(spark, tmp_path, monkeypatch):
    # a content of too few words has no set, but is known from its load
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(0, "r", "a", "h0", text, 0), (1, "r", "b", "h1", "x" * 50, 0), (2, "r", "c", "h2", text, 1), (3, "r", "d", "h3", "x" * 50, 1)], "row_seq long, repo string, id string, file_hash string, content string, at long")
    rows = H.delivered(df, "row_seq", "content", "file_hash", ["repo", "id"], F.col("at"))
    index = H.SegmentIndex(spark, f"file://{tmp_path}/index", 0.7, 3, 30)
    index.accept("one", rows.where("at = 0"))
    cut, sets = [], H._sets
    monkeypatch.setattr(H, "_sets", lambda texts, *args: cut.append(texts.count()) or sets(texts, *args))
    index.accept("two", rows.where("at = 1"))
    assert cut == [0]
    assert [tuple(r) for r in index.check(rows.where("at = 1")).collect()] == [(2, "near")]
    assert cut == [0]
    index.close()


def test_bucket_bitmaps_hold_all_keys(spark, monkeypatch):
    rng = np.random.default_rng(8)
    keys = np.r_[rng.integers(-(2**63), 2**63 - 1, 3000), 0, -1]
    df = spark.createDataFrame([(int(k), 0) for k in [*keys, *keys[::2]]], "key long, x int").repartition(5, "key")
    assert S.bucket_of(keys, 5).tolist() == [r[0] for r in spark.createDataFrame([(int(k),) for k in keys], "key long").select(F.expr("pmod(hash(key), 5)")).collect()]
    # by bucket and chunk, and with keys of one bucket in several tasks
    for rows, chunk in ((df, 1 << 21), (df, 100), (df.repartition(3, "x", F.rand(1)), 100)):
        monkeypatch.setattr(S, "COUNTED", chunk)
        bits = S.BucketBits.of(rows, 4503, 5)
        any_, several = bits.held(keys)
        assert any_.all() and several[::2].all() and several[1::2].mean() < 0.05
        assert bits.held(rng.integers(-(2**63), 2**63 - 1, 3000))[0].mean() < 0.05


def test_frequent_tokens_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_FREQUENT", 100)
    rng = np.random.default_rng(3)
    sets = [[int(x) for x in np.unique(rng.integers(1000, 10**9, 50))] + [7] * (i % 2) + [8] * (i % 3 == 0) + [9] * (i % 40 == 0) for i in range(600)]
    df = spark.createDataFrame([(len(x), x) for x in sets], "n int, toks array<long>").repartition(3)
    for chunk in (1 << 21, 500):
        monkeypatch.setattr(S, "COUNTED", chunk)
        # 7 and 8 are in 1 and 0.7 of 100 tokens, of which a chunk may have more
        hot, rank = S.frequent(df)
        assert {*hot.tolist()} <= {7, 8} and (7 not in hot or rank[list(hot).index(7)] == len(hot))
    monkeypatch.setattr(S, "MOST_FREQUENT", 1000)
    assert [x.tolist() for x in S.frequent(df)] == [[7, 8], [2, 1]]


def test_history_writes_entries_of_large_blocks_only(spark, tmp_path, monkeypatch):
    rows = [(i, "r", f"id{i}", i % 2, f"h{i}", x) for i, x in enumerate(texts(11, families=8))]
    want, names, write = None, [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: names.append(name) or write(df, name))
    for most in (4096, 2):
        monkeypatch.setattr(S, "HOT_BLOCK", most)
        index = H.SegmentIndex(spark, f"file://{tmp_path}/index-{most}", 0.7, 3, 30)
        index.accept("one", into(spark, rows))
        got = sorted(tuple(r) for r in index.check(into(spark, rows)).collect())
        assert got and want in (None, got) and ("entries" in names) == (most == 2)
        want = got
        index.close()


def test_history_leaves_no_shuffle_files(spark):
    jvm = spark.sparkContext._jvm
    files = lambda: {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(option, None)
    texts = [" ".join(f"w{i % 31 + j}" for i in range(50)) for j in range(4)]
    df = spark.createDataFrame([(i, "r", str(i), f"b{i % 3}", f"h{i % 9}", texts[i % 4]) for i in range(40)], "row_seq long, repo string, id string, index_batch_id string, file_hash string, content string")
    batches = spark.createDataFrame([(f"b{i}", i) for i in range(3)], "index_batch_id string, batch_no int")
    # the last ones are deleted a moment later
    out, end = H.repeated_rows(df, batches, 0.7, 3, 30), time.time() + 10
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert out.count() and not left and spark.conf.get(option, None) == was


def test_a_load_that_fails_between_its_writes(spark, tmp_path, monkeypatch):
    rows, batches = history_rows(3)
    no = {b: n for b, n, _ in batches} | {None: -1}
    rows = [(*r[:3], no[r[3]], *r[4:]) for r in rows if r[3] in no]
    old, new = into(spark, [r for r in rows if r[3] < 3]), into(spark, [r for r in rows if r[3] >= 3])
    index, write = H.SegmentIndex(spark, f"file://{tmp_path}/index", 0.7, 3, 30), H.SegmentIndex._write
    index.accept("old", old)
    want = {tuple(r) for r in index.check(new).collect()}

    for broken in ("segments", "members"):

        def fail(self, table, load, df):
            if table == broken:
                raise OSError("lost")
            write(self, table, load, df)

        monkeypatch.setattr(H.SegmentIndex, "_write", fail)
        with pytest.raises(OSError):
            index.accept("new", new)
        monkeypatch.setattr(H.SegmentIndex, "_write", write)
        # nothing of the failed load is seen, in this run or the next
        assert index.loads() == ["old"] and {tuple(r) for r in index.check(new).collect()} == want
        index.close()
        index = H.SegmentIndex(spark, f"file://{tmp_path}/index", 0.7, 3, 30)
        assert {tuple(r) for r in index.check(new).collect()} == want
    index.accept("new", new)
    counts = {t: index._read(t).count() for t in H.TABLES}
    index.accept("new", new)
    once = H.SegmentIndex(spark, f"file://{tmp_path}/other", 0.7, 3, 30)
    once.accept("old", old)
    once.accept("new", new)
    assert counts == {t: index._read(t).count() for t in H.TABLES} == {t: once._read(t).count() for t in H.TABLES} and min(counts.values()) > 0


def test_empty_tables_and_other_columns(spark):
    more = ", md5 string, cid long, r string, toks string, n int"
    empty = spark.createDataFrame([], "row_seq long, repo string, id string, content string" + more)
    classes, links = N.near_duplicates(empty, "row_seq", "content")
    assert links.count() == classes.count() == N.components(links).count() == 0
    text = " ".join(WORDS[:60])
    df = spark.createDataFrame([(1, None, "a", text, "x", 1, "y", "z", 3), (2, None, "b", text, "x", 1, "y", "z", 3), (3, None, "a", text, "x", 1, "y", "z", 3)], empty.schema)
    classes, links = N.near_duplicates(df, "row_seq", "content", 0.7, 3, 30)
    assert sorted(tuple(r) for r in N.row_pairs(df, classes, links, "row_seq", "content", ["repo", "id"]).collect()) == [(1, 2), (2, 3)]
    b = spark.createDataFrame([], "index_batch_id string, batch_no int, status string")
    assert H.repeated_rows(spark.createDataFrame([], ITEM), b).count() == 0


def test_very_long_content(spark):
    long = " ".join(f"{w}{i}" for i in range(60) for w in WORDS)
    df = frame(spark, [long, long + " tail", long[: len(long) // 2]])
    classes, links = N.near_duplicates(df, "row_seq", "content", 0.7, 3, 30)
    assert [(r.a, r.b) for r in links.collect()] == [(0, 1)]
