"""Periodic runs of words by an online sparse diagonal DP.

A run is a stretch of words that repeats itself with a period.  On the diagonal of lag q (word i
against word i - q) it is a sequence of matches; the DP goes over the words once and keeps, per
active lag, how far its matches reach.  For each word, its earlier occurrences increment the
match lengths of their lags; a lag whose matches are long enough gives its run at once.

Sparse: a stretch of ``least_exponent`` periods holds (least_exponent - 1) * q matches side by
side.  With 2^s <= q < 2^(s+1), at least least_exponent - 1 of them fall on words whose number is
a multiple of 2^s, so only such words increment lag q, in steps of 2^s.  A word thus looks at its
earlier occurrences within twice the largest power of two that divides its number, which makes
at most n log2 n increments for any text, however often a word comes back.  A lag that reaches
the needed steps is followed word by word to both ends of its matches, once.

Multiples of a period are not followed again: where a found stretch of period p reaches p + q
words to both sides of a word, a stretch of lag q > p through it would by Fine and Wilf's theorem
have the period gcd(p, q), so q is not its smallest.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .common import text_rows

LEAST_WORDS = 6
LEAST_EXPONENT = 4

SCHEMA = "row_key long, doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _matches(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of ``a`` and ``b`` are equal."""
    at, block = 0, 32
    while at < len(a):
        differ = np.flatnonzero(a[at:at + block] != b[at:at + block])
        if len(differ):
            return at + int(differ[0])
        at, block = at + block, 2 * block
    return len(a)


def _has_smaller_period(words: np.ndarray, start: int, q: int) -> bool:
    """Whether the stretch of period ``q`` at ``start`` (two periods or more) has a divisor as period."""
    left, r = q, 2
    while left > 1:
        if r * r > left:
            r = left
        if left % r == 0:
            p = q // r
            if np.array_equal(words[start:start + q], words[start + p:start + p + q]):
                return True
            while left % r == 0:
                left //= r
        r += 1
    return False


def find_runs(words: np.ndarray, before: np.ndarray, hits: np.ndarray, least_words: int = LEAST_WORDS,
              least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, by start, then period.

    ``words``: codes of the words; ``before``: the number of the last earlier word that is the
    same, or -1; ``hits``: the words that have one near enough to increment a lag."""
    n, needed = len(words), least_exponent - 1
    steps: dict[int, tuple[int, int]] = {}          # lag: word that incremented it last, its steps
    ends: dict[int, int] = {}                       # lag: end of the matches followed so far
    open_: list[tuple[int, int, int]] = []          # found stretches that may reach the next words
    found = []
    for i in hits.tolist():
        reach = 2 * (i & -i)
        j = int(before[i])
        while j >= 0 and (q := i - j) < reach:
            last, length = steps.get(q, (-1, 0))
            length = length + 1 if last == i - (1 << (q.bit_length() - 1)) else 1
            steps[q] = (i, length)
            j = int(before[j])
            if length < needed or i < ends.get(q, 0):
                continue
            open_ = [o for o in open_ if o[1] > i]
            inside = [o for o in open_ if 2 * o[2] <= (least_exponent - 2) * q and o[2] < q
                      and o[0] <= i - o[2] - q and i + o[2] + q <= o[1]]
            if inside:
                if of := [o for o in inside if q % o[2] == 0]:
                    ends[q] = of[0][1]              # its matches end with that stretch
                continue
            back = _matches(words[q:i][::-1], words[:i - q][::-1])
            end = i + _matches(words[i:], words[i - q:n - q])
            start = i - back - q
            ends[q] = end
            if end - start >= least_exponent * q and not _has_smaller_period(words, start, q):
                open_.append((start, end, q))
                if end - start >= least_words:
                    found.append((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list], least_words: int = LEAST_WORDS,
                  least_exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, a list of words.  Earlier occurrences are found for all texts together."""
    code = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.fromiter((c for t in texts for c in map(code.__getitem__, t)), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    keyed = codes + np.repeat(np.arange(len(texts)) * (len(code) + 1), sizes)
    order = np.argsort(keyed, kind="stable")
    same = keyed[order[1:]] == keyed[order[:-1]]
    before = np.full(len(codes), -1, np.int64)
    before[order[1:][same]] = place[order[:-1][same]]
    near = np.flatnonzero((before >= 0) & (place - before < 2 * (place & -place)))
    cuts = np.searchsorted(near, np.append(starts, len(codes)))
    return [find_runs(codes[s:s + n], before[s:s + n], near[a:b] - s, least_words, least_exponent) if b > a else []
            for s, n, a, b in zip(starts.tolist(), sizes.tolist(), cuts[:-1].tolist(), cuts[1:].tolist())]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    covered = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        covered[start + period] += 1
        covered[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(covered)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
                  least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """row_key, doc_id, n_words, runs (start, length, period by start, then period), collapsed text
    per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A run is a stretch with smallest period q of at least
    ``least_words`` words and ``least_exponent`` (2 or more) periods that no neighbouring word
    extends.  ``collapsed`` keeps the words that no run holds after its first q, joined by a space.
    Null and empty texts and texts without a run have no runs; the former collapse to the empty
    text.  Repeated rows and null ids are kept as they are; an empty table gives no rows.  A text
    is one row of one task, whole, however long; memory grows with the longest text and otherwise
    with ``batches.SLICE_BYTES``.  No shuffle.
    """
    if least_exponent < 2:
        raise ValueError("least_exponent must be 2 or more")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = [t.split() for t in part.column("text").to_pylist()]        # bytes: ASCII blanks only
            runs = runs_of_texts(texts, least_words, least_exponent)
            kept = [b" ".join(collapse(t, r)) for t, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row_key"), part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in runs], _RUNS),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["row_key", "doc_id", "n_words", "runs", "collapsed"])

    bodies = text_rows(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    return bodies.mapInArrow(rows, SCHEMA)
