"""Problem 10: per-document text statistics, and which documents aren't prose.

Each text gives counts and shares of its words, symbols and lines, among them
the shares of its non-blank characters in lines of each kind. Robust means and
covariances (repeated trimming to the nearest three quarters) of all statistics
are fitted on labelled documents, at most MOST_LABELLED of them, chosen by
hash: of prose for each language, of the other kinds over all languages. Fits
of few rows are shrunk towards those of all prose, or of all other kinds. A
document's squared Mahalanobis distance from the nearest language's prose is
split into the contributions of the statistics. A document farther than the
limit is an outlier; of the models of prose and of each kind the likeliest by
distance (plus the logarithm of its covariance's determinant) is its kind. For
the distances line shares are bent (steep), so that they count most where one
kind comes to hold half of a text.

Defined results: null, empty and blank texts have zero counts, null shares and
distance, and no kind; lines end with CRLF, LF or CR; a language that is null,
unknown or wrong doesn't matter, as the nearest prose counts; a document judged
differently counts by the majority, not at all if there is none; a kind without
labels has a model of its own lines alone, and prose one of none of them; an
empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("list", "table", "code", "junk")
STATS = (
    "word_length", "symbol_share", "digit_share", "upper_share", "line_words", "stop_share", "common_share", "bullet_share", "repeat_share", "odd_share",
    "list_chars", "table_chars", "code_chars", "junk_chars",
)
COUNTS = ("chars", "words", "lines")
#: bound of the labelled sample; most languages of prose; rows that the common fit counts for in a model's; floor of a statistic's standard deviation; bend of line shares
MOST_LABELLED, MOST_LANGS, SHRINK, FLOOR, BEND = 20_000, 50, 50, 0.05, 4.0
#: common words of the five languages (fixed values, in natural order)
COMMON = frozenset(
    "the of and to in a is that it for on with as was be by are this at from or an not have but which "
    "der die das und ist nicht ein eine zu den mit von für auf im dem des wird sich auch wenn nur noch bei "
    "le la les de des et un une est que pour dans en du au pas sur avec par ce se qui ne plus sont "
    "el los las y una es que por con para en del al no se lo como más pero sus su ya o son".split()
)

SPLIT = re.compile(r"\r\n|\n|\r")
WORDS = re.compile(r"[^\W\d_]+|[一-鿿]")
_RUN = r"(?:\([0-9]{1,4}\)|[0-9]{1,4}[.):]|[a-zA-Z][.)]|\([a-zA-Z]\)|[ivxIVX]{1,5}[.)])"
BULLET = re.compile(rf"(?:[-*+•–—·▪◦‣●○■□✓✔]\s*\[[ xX]\]\s|[-*+•–—·▪◦‣●○■□✓✔]\s|\[[ xX]\]\s|{_RUN}\s|[一二三四五六七八九十百]+[、.．)]|[（(][一二三四五六七八九十百]+[）)])")
HEX = re.compile(r"[0-9a-fA-F]{4,16}:?\s+(?:[0-9a-fA-F]{2}\s*){2,}")
PACKED = re.compile(r"[A-Za-z0-9+/=_-]{24,}$")
ESCAPES = re.compile(r"&(?:[a-z]{2,8};)+|&(?:amp;)*#?\w{1,8};|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|%[0-9A-F]{2}")
MISREAD = re.compile(r"[ÃÂâãäåæçèéïð][\x80-\xbfŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]|[\x80-\x9f�]")
CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{5,}")
SENTENCE_ENDS, CLOSING = ".!?。！？…:：", "\"'»”’)）`*_"
DIGIT, CAPITALS = re.compile("[0-9]"), re.compile(r"[(;,]|\b[A-Z]{3,}\b")
LETTER_BYTES = bytes(i for i in range(256) if i > 127 or chr(i).isalnum() or chr(i).isspace())
BOX, BOX_SET = "┌├└╔╠╚┬┼", frozenset("|-:+ │─┌├└┐┤┘┬┴┼═╔╠╚╦╩╬║╗╣╝")
CODE_END = re.compile(r"(?:[;{}]|\)\s*(?:throws \w+ ?)?\{|[\])]\s*[;,])$")
CODE_WORD = re.compile(
    r"(?:package|import|using|namespace|public|private|protected|static|final|class|interface|enum|record|return|throw|if|for|while|switch|case|try|catch|else|def|from|func|fn|let|const|var|val|struct|impl|async|await)\b.*[\w;:{()]"
)
CODE_START = re.compile(r"(?:@[A-Z]\w+(?:\(.*\))?$|//|/\*|\*/|#include|<\?|\}|\{|\)\s*[;{]|--\s)")
DDL = re.compile(r"(?:CREATE|ALTER|DROP|INSERT|SELECT|UPDATE|DELETE|GRANT|COMMENT ON|PRIMARY KEY|FOREIGN KEY|CONSTRAINT|REFERENCES|UNIQUE)\b", re.I)
COLUMN = re.compile(r"[\w\"`]+\s+(?:BIGINT|INT|INTEGER|SMALLINT|SERIAL|BIGSERIAL|TEXT|VARCHAR|CHAR|DATE|TIMESTAMP|TIMESTAMPTZ|TIME|BOOLEAN|DECIMAL|NUMERIC|JSONB?|UUID|BYTEA|DOUBLE|REAL|FLOAT)\b(?!\s+[a-z]{2,})")
ASSIGNMENT = re.compile(r"[\w.\[\]]+\s*=\s*\S.*;$")
KEY = re.compile(r"[\w.\-]+$")
GAP = re.compile(r"\S {2,}(?=\S)")
SMALL_CELL = re.compile(r"[^.!?。！？]{0,40}$")


def _ends_sentence(x: str) -> bool:
    return x.rstrip(CLOSING)[-1:] in SENTENCE_ENDS if x else False


def _code(raw: str, x: str) -> bool:
    if CODE_START.match(x) or COLUMN.match(x):
        return True
    last = x[-1]
    if last in ";{}," and CODE_END.search(x[-40:]) and (len(x) < 3 or raw[:1] in " \t" or "(" in x or CODE_WORD.match(x) or ASSIGNMENT.match(x) or DDL.match(x)):
        return True
    if last in ";{(" and CODE_WORD.match(x):
        return True
    return bool(DDL.match(x) and CAPITALS.search(x) and x[: x.find(" ")].isupper())


def line_kinds(lines: list[str], bare: list[str], solids: list[int], times: Counter) -> list[str]:
    """The kind of each non-blank line (bare: without blanks around): list, table, code, junk or prose."""
    total = sum(map(len, bare)) or 1
    out, commas = [], []
    for raw, x, solid in zip(lines, bare, solids):
        kind, seps = "", 0
        n = len(x)
        if times[x] >= 3 and n * times[x] > 0.3 * total and (n > 3 or times[x] > 8):
            kind = "junk"
        elif HEX.match(x) or (n >= 24 and " " not in x and PACKED.match(x) and DIGIT.search(x) and x.lower() != x and x.upper() != x):
            kind = "junk"
        elif n >= 5 and not x[0].isalnum() and "|" not in x and len(set(x)) <= 2:
            kind = "junk"
        else:
            # characters beyond ASCII pass as letters here
            signs = len(x.encode("utf-8", "replace").translate(None, LETTER_BYTES))
            wordy = solid - signs
            bars = x.count("|") + x.count("│")
            if bars >= 2 or x[0] in BOX:
                if not set(x) - BOX_SET:
                    kind = "table"
                elif wordy >= 0.3 * (solid - bars) and n <= 62 * (bars + 1):
                    kind = "table"
            if not kind and (
                (solid >= 8 and wordy < 0.35 * solid and x[0] not in "{}")
                or (not x.isascii() and len(MISREAD.findall(x)) > 0.06 * n)
                or (n >= 12 and ("&" in x or "%" in x or "\\" in x) and sum(map(len, ESCAPES.findall(x))) > 0.35 * solid)
                or (n >= 40 and sum(map(len, CLUSTER.findall(x))) > 0.12 * solid)
            ):
                kind = "junk"
            if not kind and BULLET.match(x):
                kind = "list"
            if not kind and _code(raw, x):
                kind = "code"
            if not kind:
                tabs = raw.count("\t") if "\t" in raw else 0
                gaps = len(GAP.findall(x)) if "  " in x and not _ends_sentence(x) else 0
                if tabs and len(WORDS.findall(x)) <= 12 * (tabs + 1):
                    kind = "table"
                elif x.count("=") >= 2 and len(p := [w for w in x.split() if KEY.match(w.partition("=")[0]) and "=" in w]) >= 2 and sum(map(len, p)) > 0.7 * solid:
                    kind = "table"
                elif gaps:
                    kind = "table" if gaps >= 2 else "gap"
                elif '";"' in x:
                    kind = "table"
                else:
                    seps = max(x.count(","), x.count(";"))
        out.append(kind)
        commas.append(seps if not kind else 0)
    # rows of cells: neighbours with as many separators, and small cells
    for i, x in enumerate(bare):
        if commas[i] and len(x) <= 25 * (commas[i] + 1) and (commas[i] == (commas[i - 1] if i else -1) or commas[i] == (commas[i + 1] if i + 1 < len(bare) else -1)):
            cells = re.split("[,;]", x)
            if (", " not in x or commas[i] >= 3) and all(SMALL_CELL.match(c) or c.strip().replace(".", "").replace("-", "").isdigit() for c in cells):
                out[i] = "row"
    # one gap counts beside other rows of cells
    for at in (range(len(out)), range(len(out) - 1, -1, -1)):
        for i in at:
            if out[i] == "gap" and "table" in out[max(0, i - 1) : i + 2]:
                out[i] = "table"
    gaps = [k == "gap" for k in out]
    for i, k in enumerate(out):
        if k == "row" or gaps[i] and (i and gaps[i - 1] or i + 1 < len(out) and gaps[i + 1]):
            out[i] = "table"
        elif k == "gap":
            out[i] = ""
    for i, x in enumerate(bare):
        if not out[i]:
            if len(x) > 90 or x[0] == "#":
                out[i] = "prose"
                continue
            n, zh = len(WORDS.findall(x)), not x.isascii() and re.search("[一-鿿]", x)
            long = n > (24 if zh else 10) or n > (16 if zh else 7) and _ends_sentence(x)
            out[i] = "prose" if long else "?"
    # a run of three or more short lines without sentences is a list, or belongs to the code around it
    i = 0
    while i < len(out):
        if out[i] != "?":
            i += 1
            continue
        j = i
        while j < len(out) and out[j] == "?":
            j += 1
        around = {out[i - 1] if i else "", out[j] if j < len(out) else ""}
        kind = "list" if j - i >= 3 or "list" in around else "code" if around == {"code"} else "prose"
        out[i:j] = [kind] * (j - i)
        i = j
    return out


def statistics(text: str | None) -> tuple[list[int], list[float] | None]:
    """The COUNTS and STATS of a text."""
    lines = [x for x in SPLIT.split(text) if x.strip()] if text else []
    if not lines:
        return [len(text or ""), 0, 0], None
    solid = [len("".join(x.split())) for x in lines]
    chars = sum(solid)
    stripped = [x.strip() for x in lines]
    times = Counter(stripped)
    share = Counter()
    for k, n in zip(line_kinds(lines, stripped, solid, times), solid):
        share[k] += n / chars
    low = WORDS.findall(text.lower())
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    digits, upper = int(((codes > 47) & (codes < 58)).sum()), int(((codes > 64) & (codes < 91)).sum())
    ends, bullets = sum(map(_ends_sentence, stripped)), sum(1 for x in stripped if BULLET.match(x))
    letters = sum(map(len, low))
    odd = (0 if text.isascii() else len(MISREAD.findall(text))) + sum(map(len, ESCAPES.findall(text)))
    stats = [
        min(letters / max(1, len(low)), 40.0) / 10,
        max(0.0, chars - letters - digits) / chars,
        digits / chars,
        upper / chars,
        float(np.log1p(len(low) / len(lines))) / 4,
        ends / len(lines),
        sum(map(COMMON.__contains__, low)) / max(1, len(low)),
        bullets / len(lines),
        1 - len(times) / len(lines),
        min(1.0, odd / chars),
        *[min(1.0, share[k]) for k in KINDS],
    ]
    return [len(text), len(low), len(lines)], stats


def text_statistics(df: DataFrame, row_id: str, text: str, lang: str | None = None) -> DataFrame:
    """(row_id, lang, COUNTS, stats) of every row, on its whole text."""
    cols = [F.col(row_id).cast("long").alias(row_id), F.lower(F.trim(lang)).alias("lang") if lang else F.lit(None).cast("string").alias("lang"), F.col(text).alias("text")]

    def run(batches):
        for batch in batches:
            got = [statistics(t) for t in batch.column(2).to_pylist()]
            counts = list(zip(*[c for c, _ in got])) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array([s for _, s in got], pa.list_(pa.float64()))], names=[row_id, "lang", *COUNTS, "stats"]
            )

    return df.select(*cols).mapInArrow(run, f"`{row_id}` long, lang string, {', '.join(f'{c} long' for c in COUNTS)}, stats array<double>")


def steep(x: np.ndarray) -> np.ndarray:
    """Statistics with line shares bent around one half."""
    y = np.array(x, np.float64)
    y[:, -len(KINDS) :] = 0.5 * np.tanh(BEND * (y[:, -len(KINDS) :] - 0.5))
    return y


@dataclass
class Models:
    """Robust means and inverse covariances: of prose by language (langs), then of each of KINDS."""

    langs: list[str]
    means: np.ndarray
    inverses: np.ndarray

    def judge(self, x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For rows of statistics: squared distance from the nearest prose, its language's place, contributions (they add up to the distance), kind's place (-1: prose)."""
        d = steep(x)[:, None, :] - self.means[None]
        parts = d * np.einsum("nls,lst->nlt", d, self.inverses)
        total = parts.sum(2)
        prose, at = len(self.langs), np.arange(len(x))
        best = total[:, :prose].argmin(1)
        distance = total[at, best]
        likely = (total - np.linalg.slogdet(self.inverses)[1]).argmin(1)
        return distance, best, parts[at, best], np.where((distance > limit) & (likely >= prose), likely - prose, -1)


def robust(x: np.ndarray, keep: float = 0.75, rounds: int = 10, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, covariance and inverse covariance after repeated trimming to the share keep nearest to the centre; common counts for SHRINK rows."""
    floor = np.eye(x.shape[1]) * FLOOR**2
    if len(x) < 2:
        mean, cov = common
        return mean, cov, np.linalg.inv(cov + floor)
    centre = np.median(x, 0)
    spread = np.median(np.abs(x - centre), 0) * 1.4826 + FLOOR
    d = (((x - centre) / spread) ** 2).sum(1)
    for _ in range(rounds):
        best = x[np.argsort(d, kind="stable")[: max(2, int(np.ceil(len(x) * keep)))]]
        centre, cov = best.mean(0), np.cov(best, rowvar=False)
        if common is not None:
            n = len(best) + SHRINK
            centre, cov = (len(best) * centre + SHRINK * common[0]) / n, (len(best) * cov + SHRINK * common[1]) / n
        inverse = np.linalg.inv(cov + floor)
        d = np.einsum("ns,st,nt->n", x - centre, inverse, x - centre)
    return centre, cov, inverse


def fit_models(stats: DataFrame, labels: DataFrame, row_id: str, label: str, prose: str = "prose") -> Models:
    """Fit on the labelled documents: at most MOST_LABELLED rows reach the driver."""
    votes = labels.where(F.col(label).isin(prose, *KINDS)).groupBy(row_id, label).agg(F.count(F.lit(1)).alias("n"))
    judged = votes.groupBy(row_id).agg(F.max_by(label, "n").alias("of"), F.max("n").alias("most"), F.sum("n").alias("n")).where("2 * most > n").select(row_id, "of")
    rows = stats.where("stats is not null").join(judged, row_id).select("lang", "of", "stats", F.xxhash64(row_id).alias("h")).orderBy("h", "stats").limit(MOST_LABELLED).toArrow()
    x = steep(np.array(rows["stats"].to_pylist(), np.float64).reshape(-1, len(STATS)))
    lang, of = np.array(rows["lang"].to_pylist(), dtype=object), np.array(rows["of"].to_pylist(), dtype=object)

    def lines(kind: str | None) -> np.ndarray:
        return steep(np.array([[0.5] * (len(STATS) - len(KINDS)) + [float(k == kind) for k in KINDS]]))[0]

    # what is assumed without any labels: anything of the other statistics, lines of one kind
    wide = np.diag([1.0] * (len(STATS) - len(KINDS)) + [FLOOR**2] * len(KINDS))
    own = x[of == prose]
    every = robust(own, common=(lines(None), wide))
    langs = sorted(k for k, _ in Counter(v for v in lang[of == prose].tolist() if v).most_common(MOST_LANGS)) or ["all"]
    fits = [robust(own if k == "all" else x[(of == prose) & (lang == k)], common=every[:2]) for k in langs]
    groups = [x[of == k] for k in KINDS]
    apart = np.concatenate([g - np.median(g, 0) for g in groups if len(g) > 1] or [x[:0]])
    within = robust(apart, common=(np.zeros(len(STATS)), wide))[1]
    fits += [robust(g, common=(np.median(g, 0) if len(g) else lines(k), within)) for k, g in zip(KINDS, groups)]
    return Models(langs, np.stack([f[0] for f in fits]), np.stack([f[2] for f in fits]))


def judged(stats: DataFrame, row_id: str, models: Models, limit: float = 30.0) -> DataFrame:
    """stats with distance (squared, from the nearest prose), prose_lang, contributions (by statistic), kind (null: prose, or no text)."""
    shared = stats.sparkSession.sparkContext.broadcast(models)
    names = [f"`{row_id}`", "lang", *COUNTS, "stats"]
    schema = f"`{row_id}` long, lang string, {', '.join(f'{c} long' for c in COUNTS)}, stats array<double>, distance double, prose_lang string, contributions array<double>, kind string"
    doubles = pa.list_(pa.float64())

    def run(batches):
        m: Models = shared.value
        langs, kinds = np.array(m.langs, dtype=object), np.array([*KINDS, None], dtype=object)
        for batch in batches:
            column = batch.column(len(names) - 1)
            has = column.is_valid().to_numpy(zero_copy_only=False)
            x = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))
            distance, best, parts, kind = m.judge(x, limit)
            # places of the rows with a text among all rows; the others take a null
            at = pa.array(np.cumsum(has) - 1, mask=~has)
            split = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATS), pa.int32()), pa.array(parts.ravel()))
            new = [pa.array(distance), pa.array(langs[best], pa.string()), split.cast(doubles), pa.array(kinds[kind], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[c.take(at) for c in new]], names=[*[n.strip("`") for n in names], "distance", "prose_lang", "contributions", "kind"])

    return stats.select(*names).mapInArrow(run, schema)
