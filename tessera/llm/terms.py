"""Problem 6: frequency of every distinct term, by suffix arrays with common-prefix intervals.

Each task numbers the words of its records and sorts all word suffixes to their
fields' ends, by prefix doubling, and takes from it the whole common prefix of
each suffix and the one before. The intervals of suffixes that share more words
than their neighbours outside are found once, of all lengths together, nested
as they are: the n-grams that end between the length of the enclosing interval
and its own share one count, the interval's length, and one number of records,
less the suffixes that follow one of their own record within the interval.
Terms and n-grams of every length are read from these classes. Records are
whole within a task, so the tasks' counts add up; equal n-grams meet in one
aggregation combined before the shuffle.

Defined results: null and empty fields hold no term; a term of several fields
of a record counts once for the record; n-grams don't run over the end of a
field; an empty table gives no row; every row is a record, repeated or not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shingles import words

#: words of a suffix array; a task's records beyond go to the next one
BLOCK = 1_000_000


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def suffix_order(ids: np.ndarray, end: np.ndarray, deepest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The starts of all suffixes in order, and their places by the first 1, 2, 4, ... words, up to deepest.

    end: where each place's field ends. A field's end differs from every word
    and every other end. A suffix's place by so many words is where the
    suffixes that share them begin; those alone in their place are settled.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.r_[True, ids[order[1:]] != ids[order[:-1]]] if n else np.empty(0, bool)
    place = np.empty(n, np.int64)
    place[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    levels, width = [place.astype(np.int32)], 1
    slots = np.flatnonzero(~(first & np.r_[first[1:], True])) if n else np.empty(0, np.int64)
    while len(slots):
        at = order[slots]
        after = at + width
        key = place[at] * (2 * n) + np.where(after < end[at], place[np.minimum(after, n - 1)] + n, at)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        first = np.r_[True, key[1:] != key[:-1]]
        place[at] = slots[np.flatnonzero(first)[np.cumsum(first) - 1]]
        slots = slots[~(first & np.r_[first[1:], True])]
        width *= 2
        if width <= deepest:
            levels.append(place.astype(np.int32))
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """How many words each suffix shares with the one before it, as far as the levels tell."""
    shared = np.zeros(len(order), np.int32)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[at - 1], order[at]
    for k in range(len(levels) - 1, -1, -1):
        i = np.flatnonzero((a < end[order[at - 1]]) & (b < end[order[at]]))
        i = i[levels[k][a[i]] == levels[k][b[i]]]
        shared[at[i]] += 1 << k
        a[i] += 1 << k
        b[i] += 1 << k
    return shared


def classes(ids: np.ndarray, record: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, least, most, occurrences, records) of each class of n-grams of any length.

    A class is a common-prefix interval of the suffix order, or a suffix alone:
    the n-grams of least to most words from start, all of the same occurrences
    and records. Each n-gram of the records is in one class; there are fewer
    than two classes for each word. ids: the words in record order; left: words
    from each place to its field's end.
    """
    n = len(ids)
    if not n:
        return (np.empty(0, np.int64),) * 5
    end = np.arange(n) + left
    order, levels = suffix_order(ids, end, n)
    s = np.r_[common_prefixes(order, levels, end), np.int32(-1)]
    del levels
    s[0] = -1
    # where the least of the 2**k prefixes from each place on is, as far as an interval may reach
    stops = np.flatnonzero(s <= 0)
    reach = int(np.diff(stops).max()) - 1
    low = [np.arange(n + 1, dtype=np.int32)]
    for k in range(max(1, reach).bit_length() - 1):
        x, y = low[-1], low[-1][np.minimum(np.arange(n + 1) + (1 << k), n)]
        low.append(np.where(s[x] <= s[y], x, y))

    # an interval is known by the first of its least prefixes; those before it are longer, back to its begin
    at = np.flatnonzero(s > 0)
    begin = at - 1
    far = np.flatnonzero(s[begin] > s[at])
    for k in range(len(low) - 1, -1, -1):
        window = low[k][np.maximum(begin[far] - (1 << k) + 1, 0)]
        begin[far] -= (s[window] > s[at[far]]) << k
    first = s[begin] < s[at]
    at, begin = at[first], begin[first]
    after = at + 1
    far = np.flatnonzero(s[after] >= s[at])
    for k in range(len(low) - 1, -1, -1):
        window = low[k][after[far]]
        after[far] += (s[window] >= s[at[far]]) << k

    # each suffix and the one before it of the same record are both in the intervals that hold the least prefix between them
    by = np.argsort(record[order], kind="stable")
    same = record[order[by[1:]]] == record[order[by[:-1]]]
    p, q = by[:-1][same], by[1:][same]
    near = q - p <= reach
    p, q = p[near], q[near]
    again = np.zeros(n + 1, np.int64)
    step = np.frexp(q - p)[1] - 1
    for k in range(len(low)):
        on = step == k
        x, y = low[k][p[on] + 1], low[k][q[on] - (1 << k) + 1]
        least = np.where(s[x] <= s[y], x, y)
        again += np.bincount(least[s[least] > 0], minlength=n + 1)
    again = np.cumsum(again)

    held = after - begin
    shorter = np.maximum(np.maximum(s[begin], s[after]), 0)
    alone = np.maximum(np.maximum(s[:-1], s[1:]), 0)
    one = np.flatnonzero(left[order] > alone)
    ones = np.ones(len(one), np.int64)
    return (
        np.concatenate([order[begin], order[one]]),
        np.concatenate([shorter, alone[one]]) + 1,
        np.concatenate([s[at], left[order[one]]]),
        np.concatenate([held, ones]),
        np.concatenate([held - (again[after - 1] - again[begin]), ones]),
    )


def interval_counts(ids: np.ndarray, record: np.ndarray, left: np.ndarray, longest: int | None):
    """For n = 1..longest, or all n without it: (n, start of an occurrence, occurrences, records) of each n-gram, read from the classes."""
    start, least, most, occurrences, records = classes(ids, record, left)
    n = 1
    while (longest is None or n <= longest) and len(start):
        on = least <= n
        yield n, start[on], occurrences[on], records[on]
        n += 1
        more = most >= n
        start, least, most, occurrences, records = (x[more] for x in (start, least, most, occurrences, records))


def term_counts(df: DataFrame, fields: list[str], longest: int | None = 1) -> DataFrame:
    """(n, term, occurrences, records) of every n-gram of up to longest words; None: of any length, the square of a field's words in rows."""

    def block(numbers, ids, lengths, records):
        names = list(numbers)
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        size = np.array(lengths, np.int64)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
        for n, at, occ, rec in interval_counts(flat, np.repeat(records, size), left, longest):
            for k in range(0, len(at), 50_000):
                cut = slice(k, k + 50_000)
                terms = [names[i] for i in flat[at[cut]]] if n == 1 else [" ".join(names[j] for j in flat[i : i + n]) for i in at[cut]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), n, np.int32)), pa.array(terms, pa.string()), pa.array(occ[cut]), pa.array(rec[cut])], names=["n", "term", "occurrences", "records"])

    def run(batches):
        numbers, ids, lengths, records, total, row = _Numbers(), [], [], [], 0, 0
        for batch in batches:
            for texts in zip(*(c.to_pylist() for c in batch.columns)):
                row += 1
                for text in texts:
                    if text and (w := words(text)):
                        ids.append(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)))
                        lengths.append(len(w))
                        records.append(row)
                        total += len(w)
                if total >= BLOCK:
                    yield from block(numbers, ids, lengths, records)
                    numbers, ids, lengths, records, total = _Numbers(), [], [], [], 0
        yield from block(numbers, ids, lengths, records)

    counts = df.select(*[F.col(f) for f in fields]).mapInArrow(run, "n int, term string, occurrences long, records long")
    return counts.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, all_records: int, least: int = 3, most_share: float = 0.1) -> DataFrame:
    """The counts with mark: rare under least records, common beyond most_share of all records, else null."""
    mark = F.when(F.col("records") < least, "rare").when(F.col("records") > most_share * all_records, "common")
    return counts.withColumn("mark", mark)
