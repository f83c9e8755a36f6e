"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(threshold_k - s) with one score s = w . x per text and ordered thresholds.
The features x are hashes of a text's words, of their character grams and of their shapes, each
weighing log(1 + count) of the word; x is scaled by the length of the word counts.  All of a
word's features add up to one number, so a text's score is a sum over its distinct words.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Memory, slices
from .common import partitions, text_rows

GRADES = 3                  # 0 toxic, 1 poor, 2 good
FIT_ROWS = 2500             # labelled rows per grade that the model is fitted on
DIMS = 1 << 22
GRAM = 5
LEAST_ROWS = 3              # a feature is learned if so many fitted rows have it
SCALE = 10.0
SHORT = 200.0               # added to the squared length, so that short texts are not blown up
ROUNDS = 200
RATE = 0.03
DECAY = 3e-3
BLOCK = 1 << 20             # features gone over at once while fitting
LONG_RUN = 1 << 16          # letters of words gone over at once

_OTHER = re.compile(r"(?:[^\w\n]|[\d_])+")
_REPEATED = re.compile(r"(.)\1+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Kinds(dict):
    """The kind of each character, as a table for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


_KINDS = _Kinds()


def _grams(points: np.ndarray) -> np.ndarray:
    """Features of all windows of GRAM code points."""
    last = len(points) - GRAM + 1
    wide = points.astype(np.uint64)
    hashed = wide[:last].copy()
    for k in range(1, GRAM):
        hashed = hashed * _MIX + wide[k:last + k]
    hashed = (hashed ^ hashed >> np.uint64(31)) * _MIX
    return (hashed >> np.uint64(40) & np.uint64(DIMS - 1)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _long_word(letters: str, found: list[int]) -> np.ndarray:
    """Features of one word of many letters, block by block: a run without blanks may be a whole
    page, and beside copies of it no more than a mark per feature is held."""
    marks = np.zeros(DIMS, bool)
    marks[found] = True
    padded = f"^{letters}$"
    for at in range(0, len(padded) - GRAM + 1, LONG_RUN):
        marks[_grams(_points(padded[at:at + LONG_RUN + GRAM - 1]))] = True
    return np.flatnonzero(marks)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, feature): the hashed features of blank-separated words, each once a word,
    by word: its letters, all their grams, its shape.  The words are gone over together: one
    array of their code points, whose windows are hashed at once."""
    together = "\n".join(words)
    letters = _OTHER.sub("", together).lower().split("\n")
    shapes = _REPEATED.sub(r"\1+", together.translate(_KINDS)).split("\n")
    shape = {s: xxhash.xxh32_intdigest(f"s {s}") % DIMS for s in set(shapes)}
    own = np.array([[shape[s], xxhash.xxh32_intdigest(f"w {w}") % DIMS] for s, w in zip(shapes, letters)], np.int64)
    number = np.arange(len(words))
    keys = [number * DIMS + own[:, 0], number * DIMS + own[:, 1]]
    long = [i for i, w in enumerate(letters) if len(w) > LONG_RUN]
    for i in long:
        keys.append(i * DIMS + _long_word(letters[i], own[i].tolist()))
        letters[i] = ""
    points = _points("^" + "$\n^".join(letters) + "$")
    if len(points) >= GRAM:
        ends = points == 10
        word = np.cumsum(ends)
        inside = np.flatnonzero((word[:-GRAM + 1] == word[GRAM - 1:]) & ~ends[:-GRAM + 1])
        keys.append(word[inside] * DIMS + _grams(points)[inside])
    found = np.concatenate(keys)
    found.sort()
    found = found[np.r_[True, found[1:] != found[:-1]]]
    return found // DIMS, found % DIMS


def by_letters(words: list[str], limit: int) -> list[list[str]]:
    """The words in lists of about ``limit`` letters at most; a longer word is a list of its own."""
    out, held = [[]], 0
    for w in words:
        if held + len(w) > limit and out[-1]:
            out.append([])
            held = 0
        out[-1].append(w)
        held += len(w)
    return out if words else []


_LOGS = [math.log1p(n) for n in range(1000)]


def text_words(text: str) -> tuple[list[str], np.ndarray, float]:
    """Distinct words with log(1 + count), a pseudo-word for how often words repeat, and the scale."""
    words = Counter(text.split())
    total = words.total()
    logs = np.array([_LOGS[n] if n < 1000 else math.log1p(n) for n in words.values()])
    scale = SCALE / math.sqrt(float(logs @ logs) + SHORT)
    return ([*words, f"\x00distinct{10 * len(words) // total if total else 0}"], np.append(logs, 1 / scale), scale)


def graded(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality",
           toxic_col: str = "toxic") -> DataFrame:
    """(doc_id, grade): 0 if toxic, else 1 if of poor quality, else 2; the lowest of several
    labels of an id.  A row without a toxic label, or without a quality label and not toxic,
    has no grade."""
    toxic, quality = F.col(toxic_col), F.col(quality_col)
    grade = F.when(toxic == 1, 0).when(toxic == 0, F.when(quality == 0, 1).when(quality == 1, 2))
    return (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), grade.cast("int").alias("grade"))
            .where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade")))


def fit_ordinal(sizes: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, weight: np.ndarray,
                dims: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the weighted log-likelihood.

    ``sizes`` features per row lie one row after another in ``cols`` and ``values``; a round goes
    over them in blocks, so that it needs little memory beside them.
    """
    w = np.zeros(dims)
    share = np.cumsum(np.bincount(grades, weight, GRADES)) / weight.sum()
    share = np.clip(share[:-1], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    # thresholds as a first one and positive steps keep their order
    t = np.r_[first[0], np.log(np.maximum(np.diff(first), 1e-2))]
    m, v = np.zeros(dims + len(t)), np.zeros(dims + len(t))
    ends = np.cumsum(sizes)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK)), len(sizes)])
    blocks = [(lo, hi, slice(ends[lo] - sizes[lo], ends[hi - 1])) for lo, hi in zip(cuts, cuts[1:])]

    def sigmoid(x):
        return 0.5 * (1 + np.tanh(0.5 * x))

    for step in range(1, rounds + 1):
        theta = np.r_[t[0], t[0] + np.cumsum(np.exp(t[1:]))]
        s = np.zeros(len(grades))
        for lo, hi, at in blocks:
            running = np.r_[0.0, np.cumsum(w[cols[at]] * values[at])]
            own = np.r_[0, np.cumsum(sizes[lo:hi])]
            s[lo:hi] = running[own[1:]] - running[own[:-1]]
        upper = np.where(grades < GRADES - 1, sigmoid(np.r_[theta, 0][grades] - s), 1.0)
        lower = np.where(grades > 0, sigmoid(np.r_[0, theta][grades] - s), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
        ds = du - dl                                            # gradient of -log p by the score
        gt = np.zeros(GRADES - 1)
        np.add.at(gt, grades[grades < GRADES - 1], -du[grades < GRADES - 1])
        np.add.at(gt, grades[grades > 0] - 1, dl[grades > 0])
        gw = DECAY * w
        for lo, hi, at in blocks:
            gw += np.bincount(cols[at], np.repeat(ds[lo:hi], sizes[lo:hi]) * values[at], dims) / weight.sum()
        g = np.r_[gw, gt.sum() / weight.sum(), [gt[k:].sum() * math.exp(t[k]) / weight.sum() for k in range(1, len(t))]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, t = w - move[:dims], t - move[dims:]
    return w, np.r_[t[0], t[0] + np.cumsum(np.exp(t[1:]))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        fit_rows: int = FIT_ROWS) -> dict:
    """The model: sparse weights over DIMS hashed features and the thresholds.

    Fitted on ``fit_rows`` labelled ids of each grade (all where there are fewer), the first by
    a hash of the id, weighted back to the grades' shares.  An id that stands in several rows is
    fitted once, on the text whose hash is smallest.  So at most GRADES x fit_rows labels are
    broadcast to the scan of the texts, and that many rows' features reach the driver.
    """
    grades = graded(labels)
    have = {r["grade"]: r["count"] for r in grades.groupBy("grade").count().collect()}
    if not have:
        return {"cols": np.empty(0, np.int64), "weights": np.empty(0), "thresholds": None}
    chosen = None
    for grade in sorted(have):
        first = grades.where(F.col("grade") == grade).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(fit_rows)
        chosen = first if chosen is None else chosen.unionAll(first)
    rows = text_rows(docs, id_col, text_col).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = (rows.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first"))
            .select(F.col("first.text").alias("text"), "grade").repartition(partitions(docs.sparkSession)))

    def features(batches):
        for batch in batches:
            cols, values = [], []
            for text in batch.column(0).to_pylist():
                words, logs, scale = text_words(text)
                found, amounts, at = [], [], 0
                for block in by_letters(words, 1 << 18):
                    word, feature = word_features(block)
                    found.append(feature)
                    amounts.append(logs[at + word] * scale)
                    at += len(block)
                held, place = np.unique(np.concatenate(found), return_inverse=True)
                cols.append(held.astype(np.int32).tobytes())
                values.append(np.bincount(place, np.concatenate(amounts)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cols, pa.binary()), pa.array(values, pa.binary()),
                                              batch.column(1)], names=["cols", "values", "grade"])
    got = rows.select("text", "grade").mapInArrow(features, "cols binary, values binary, grade int")
    parts = [(np.frombuffer(r["cols"], np.int32), np.frombuffer(r["values"], np.float32), r["grade"])
             for r in got.collect()]
    parts.sort(key=lambda p: (p[2], p[0].tobytes()))            # the order of tasks must not matter
    if not parts:
        return {"cols": np.empty(0, np.int64), "weights": np.empty(0), "thresholds": None}
    common = np.bincount(np.concatenate([c for c, _, _ in parts]), minlength=DIMS) >= LEAST_ROWS
    number = np.cumsum(common) - 1
    kept = [(number[c[common[c]]].astype(np.int32), v[common[c]]) for c, v, _ in parts]
    y = np.array([g for _, _, g in parts])
    weight = np.array([have[g] for g in y], np.float64) / np.bincount(y, minlength=GRADES)[y]
    sizes = np.array([len(c) for c, _ in kept])
    cols, values = np.concatenate([c for c, _ in kept]), np.concatenate([v for _, v in kept])
    del parts, kept, number
    w, thresholds = fit_ordinal(sizes, cols, values, y, weight / weight.mean(), int(common.sum()))
    return {"cols": np.nonzero(common)[0], "weights": w, "thresholds": thresholds}


class Grader:
    def __init__(self, model: dict) -> None:
        self.weights = np.zeros(DIMS, np.float32)
        self.weights[model["cols"]] = model["weights"]
        self.thresholds = model["thresholds"]
        self.memory = Memory()

    def scores(self, texts: list[str]) -> list[float]:
        split = [text_words(t) for t in texts]
        new, known = list(self.memory.unknown(set().union(*(words for words, _, _ in split)))), self.memory.known
        for block in by_letters(new, 1 << 18):
            word, feature = word_features(block)
            known.update(zip(block, np.bincount(word, self.weights[feature], len(block)).tolist()))
        get = known.__getitem__
        return [float(np.fromiter(map(get, words), np.float64, len(words)) @ logs) * scale for words, logs, scale in split]


def grade_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    fit_rows: int = FIT_ROWS, least: float = 0.5) -> DataFrame:
    """row_key, doc_id, score, expected_grade, p_at_least_1, p_at_least_2, kept of every row.

    Whole texts are scored; a null text is an empty one; repeated rows are scored each.  Words are
    remembered up to a bound in bytes (``batches.MEMORY_BYTES``).  ``kept``: the tail probability of the
    best grade is at least ``least``.  Without any graded row there is no model: every grade is
    as likely and every row is kept.
    """
    model = fit(docs, labels, id_col, text_col, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        grader = Grader(shared.value)
        for batch in slices(batches, "text"):
            s = np.array(grader.scores(batch.column(2).to_pylist()), np.float64)
            if grader.thresholds is None:
                tails = [np.full(len(s), 1 - (k + 1) / GRADES) for k in range(GRADES - 1)]
                kept = np.ones(len(s), bool)
            else:
                tails = [0.5 * (1 + np.tanh(0.5 * (s - t))) for t in grader.thresholds]
                kept = tails[-1] >= least
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array(np.sum(tails, axis=0)),
                 *map(pa.array, tails), pa.array(kept)],
                names=["row_key", "doc_id", "score", "expected_grade", "p_at_least_1", "p_at_least_2", "kept"])
    return text_rows(docs, id_col, text_col).mapInArrow(
        run, "row_key long, doc_id long, score double, expected_grade double, p_at_least_1 double, "
             "p_at_least_2 double, kept boolean")
