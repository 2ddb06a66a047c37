"""Problem 1: splitting oversized contents by content-defined chunking.

A rolling hash over the last WINDOW characters marks landmarks. From the last
cut the first landmark at least `least` characters on is snapped to the nearest
natural boundary (line end, else sentence end, else blank) between the least
and the most; so the cuts depend on the text around them, and an edit moves
those beside it only. Each next piece starts up to `overlap` characters before
its cut, at the first natural boundary there.

Defined results: null, empty and short contents (up to `most` characters) give
no piece; without any boundary the cut is at the landmark, or after `most`
characters, but not between a CR and its LF nor before a combining mark (where
there is another place); a reversed line range counts from its smaller end; no
start_line, no line numbers. Characters are code points. Lines end with CRLF,
LF or CR. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 32
LINE, SENTENCE, BLANK = re.compile(r"\r\n|\n|\r"), re.compile(r"[.!?;。！？；](?=\s)|[。！？；]"), re.compile(r"[ \t　 ]+")
PIECES = "row long, piece_no int, pieces int, start_char int, end_char int, shared int, piece string, start_line int, end_line int"


def _gear(codes: np.ndarray) -> np.ndarray:
    """For each character the rolling hash of the WINDOW characters up to it."""
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    w = 1
    while w < WINDOW:
        h[w:] = h[w:] + (h[:-w] << np.uint64(w))
        w *= 2
    return h ^ (h >> np.uint64(32))


def _ends(pattern: re.Pattern, text: str) -> np.ndarray:
    return np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)


def _within(places: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return places[np.searchsorted(places, lo) : np.searchsorted(places, hi, "right")]


def _whole(text: str, at: int, lo: int) -> int:
    """at, moved back out of a CRLF and off combining marks, if there is room."""
    x = at
    while x > lo and x < len(text) and (text[x - 1 : x + 1] == "\r\n" or unicodedata.combining(text[x]) or text[x] in "‍️"):
        x -= 1
    return x if x > lo else at


def cuts(text: str, most: int, least: int, overlap: int, mask: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.flatnonzero((_gear(codes) & np.uint64(mask)) == 0) + 1
    kinds = [_ends(p, text) for p in (LINE, SENTENCE, BLANK)]
    out, start, cut = [], 0, 0
    while len(text) - start > most:
        lo, hi = cut + least, start + most
        found = _within(marks, lo, hi)
        aim = int(found[0]) if len(found) else hi
        end = aim if len(found) else hi
        for places in kinds:
            near = _within(places, lo, hi)
            if len(near):
                end = int(near[np.argmin(np.abs(near - aim))])
                break
        else:
            end = _whole(text, end, lo)
        out.append((start, end))
        begin = max(end - overlap, start + 1)
        start = begin
        for places in kinds:
            near = _within(places, begin, end)
            if len(near) and near[0] < end:
                start = int(near[0])
                break
        else:
            start = _whole(text, begin, max(0, begin - 8)) if begin == end - overlap else begin
            start = max(start, end - overlap)
            while start < end and (text[start - 1 : start + 1] == "\r\n" or unicodedata.combining(text[start])):
                start += 1
        cut = end
    out.append((start, len(text)))
    return out


def split(df: DataFrame, row_id: str, content: str, start_line: str, end_line: str, most: int = 2000, overlap: int = 200, least: int = 800, mask: int = 0xFF) -> DataFrame:
    """PIECES of the contents longer than most characters; piece_no from 0, offsets in the content, shared characters with the piece before."""
    if not 0 <= overlap < least <= most - overlap:
        raise ValueError("need 0 <= overlap < least <= most - overlap")

    def run(batches):
        for batch in batches:
            rows = []
            for row, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lines = _ends(LINE, text)
                first = None if a is None else a if b is None else min(a, b)
                parts = cuts(text, most, least, overlap, mask)
                before = 0
                for i, (s, e) in enumerate(parts):
                    top = None if first is None else first + int(np.searchsorted(lines, s, "right"))
                    low = None if first is None else first + int(np.searchsorted(lines, e - 1, "right"))
                    rows.append((row, i, len(parts), s, e, before - s if i else 0, text[s:e], top, low))
                    before = e
            kinds = [pa.int64(), *[pa.int32()] * 5, pa.string(), pa.int32(), pa.int32()]
            cols = list(zip(*rows)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    long = df.where(F.length(content) > most).select(F.col(row_id).cast("long"), content, F.col(start_line).cast("int"), F.col(end_line).cast("int"))
    return long.mapInArrow(run, PIECES)
