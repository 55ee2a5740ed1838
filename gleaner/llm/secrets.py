"""Operator 7: secret scans by password guess cost.

Base detectors find assigned credentials, access keys and long hexadecimal strings. Besides, every value in a
credential context is priced, also those that a base span holds in part or whole: dynamic programming finds its cheapest
segmentation into words, dates, repeats, keyboard walks and brute-force spans, and a value that would take very many
guesses is a further span. Placeholders and dictionary passwords are priced low and get none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, table
from gleaner.llm.passages import text_batches

KINDS = ("assign", "access", "hex")
# Letters of the names stand in either case, as ASCII.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
# Values in quotes may hold anything but line ends; others end at white space, quotes, angles, commas and semicolons.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth(?:orization)?|credentials?|bearer|(?:private|access|client)[_-]?(?:key|secret))["']?\s*(?:[:=]|=>)\s*(?:"([^"\r\n]{8,})"|'([^'\r\n]{8,})'|["']?([^\s"'<>,;]{8,}))""",
    re.IGNORECASE | re.ASCII,
)
NAMES = ("pass", "secret", "token", "api", "pwd", "auth", "credential", "bearer", "key")
#: Rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
DATES = (
    re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d)"),
    re.compile(r"(?:19|20)\d\d"),
)
#: Decimal logarithms of guesses: a brute-force character, a new segment, a date, the start of a walk, a change of case.
CHARACTER, SEGMENT, DAY, WALK, CASE = 1.0, math.log10(2), math.log10(365 * 100), math.log10(47), math.log10(2)
LONGEST_WORD = 24
UNKNOWN_WORD = "guess"

_PLACE = {c: (k, j) for k, row in enumerate(ROWS) for j, c in enumerate(row)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) of every base span."""
    low, out = text.lower(), []
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def contexts(text: str) -> list[tuple[int, int]]:
    """Where the values of credential contexts stand."""
    low = text.lower()
    return [m.span(m.lastindex) for m in CONTEXT.finditer(text)] if any(x in low for x in NAMES) else []


def _step(a: str, b: str) -> tuple[int, int] | None:
    """The move from one key to an adjacent one."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    move = (q[0] - p[0], q[1] - p[1]) if p and q else None
    return move if move and move != (0, 0) and abs(move[0]) <= 1 and abs(move[1]) <= 1 else None


def _extended(starts: list[tuple[int, float]], cost, new: tuple[int, float] | None) -> list[tuple[int, float]]:
    """The (start, base cost) of runs that may still be the cheapest; ``cost`` gives a run's price as it stands.

    An earlier start that is no dearer now will never be: the logarithm of its length grows more slowly.
    """
    kept: list[tuple[int, float]] = []
    for own in [*starts, *([new] if new else [])]:
        if not kept or cost(*own) < cost(*kept[-1]):
            kept.append(own)
    return kept


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` takes.

    Every stretch may be a brute-force span, a word, a date, a repeated character, a keyboard walk, or further copies of
    the characters before it. Runs keep only starts that may still be the cheapest, so the time is about linear.
    """
    n, low = len(value), value.lower()
    best = [0.0] + [math.inf] * n  # up to here, at the end of a segment
    brute = [math.inf] * (n + 1)  # up to here, inside a brute-force span
    same: list[tuple[int, float]] = []
    walks: list[tuple[int, float]] = []
    copies: list[list[tuple[int, float]]] = [[] for _ in range(9)]
    turns, last = 0, None  # changes of direction since the beginning; those before a start are taken off its base
    for i in range(n):
        # Segments that begin at i.
        brute[i + 1] = min(brute[i], best[i] + SEGMENT) + CHARACTER
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = ranks.get(low[i:j])
            if rank:
                cost = math.log10(rank + 1) + CASE * (value[i:j] != low[i:j])
                best[j] = min(best[j], best[i] + SEGMENT + cost)
        for date in DATES if value[i].isdigit() else ():
            if m := date.match(value, i):
                best[m.end()] = min(best[m.end()], best[i] + SEGMENT + DAY)
        # Runs that end with i.
        price = lambda s, base, end=i + 1: base + math.log10(end - s)
        same = _extended(same if i and value[i] == value[i - 1] else [], price, (i, best[i] + SEGMENT + CHARACTER))
        move = _step(low[i - 1], low[i]) if i else None
        turns += move is not None and last is not None and move != last
        last = move
        # The first move of a walk is no turn: its start's turns are those counted with that move.
        fresh = (i - 1, best[i - 1] + SEGMENT + WALK - turns * math.log10(4)) if move else None
        walks = _extended(walks if move else [], price, fresh)
        best[i + 1] = min(
            best[i + 1], brute[i + 1], *(price(*x) for x in same if i + 1 - x[0] >= 3), *(price(*x) + turns * math.log10(4) for x in walks if i + 1 - x[0] >= 4),
        )
        for size in range(2, 9):  # the block before the start, times the number of copies
            times = lambda s, base, end=i + 1, size=size: base + math.log10(1 + (end - s) / size)
            copies[size] = _extended(copies[size], times, (i, best[i])) if i >= size and low[i] == low[i - size] else []
            best[i + 1] = min(best[i + 1], *(times(*x) for x in copies[size] if i + 1 - x[0] >= size), math.inf)
    return best[n]


def common_words(docs: DataFrame, *, text_col: str = "text", least_share: float = 2e-5, least_times: int = 5) -> dict[str, int]:
    """Rank of each word of three letters a to z or more that makes up at least this share of all such words of the
    corpus and stands there ``least_times``, so that a secret's own letters are no word. Their number is at most
    1 / least_share, whatever the size of the corpus."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), "[^a-z]+")).alias("word")).where(F.length("word").between(3, LONGEST_WORD))
    counts = materialize(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.where(F.col("n") >= max(least_times, least_share * total)).collect()
    return {r["word"]: k + 1 for k, r in enumerate(sorted(kept, key=lambda r: (-r["n"], r["word"])))}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 12.0) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, joined by commas) and guesses.

    A value in a credential context is added, as kind ``guess``, if it takes at least 10 ** ``threshold`` guesses, whether
    or not a base span holds it. ``guesses`` has start:end:price of all these values, the price as a decimal logarithm
    with two places. Null and empty texts and empty tables have no spans; repeated rows each get a row; texts of any
    length are scanned whole, in batches by bytes.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(common_words(docs, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in text_batches(batches, 1):
            counts: list[list[int]] = []
            base, spans, prices = [], [], []
            for _, raw in some:
                text = raw.decode("utf-8", "surrogatepass")
                found = base_spans(text)
                counts.append([sum(s[1] == k for s in found) for k in range(len(KINDS))])
                base.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found))
                priced = [(a, b, guess_cost(text[a:b], ranks.value)) for a, b in contexts(text)]
                more = [(a, len(KINDS), b) for a, b, price in priced if price >= threshold]
                spans.append(",".join(f"{(*KINDS, UNKNOWN_WORD)[k]}:{a}:{b}" for a, k, b in sorted([*found, *more])) if more else base[-1])
                prices.append(",".join(f"{a}:{b}:{price:.2f}" for a, b, price in priced))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in some], pa.int64()), *columns, pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(prices, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "guesses"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, guesses string")


def op7_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts of base spans, their digest, and all spans."""
    return scan(table(spark, sf_dir, "documents"))
