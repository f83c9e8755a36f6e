"""Language identification by word-first backoff.

A word that the training rows know scores with its log frequency in each language.  A word
they don't know falls back to its character n-grams, the longest length of which any is known;
every word counts the same either way.  The best total wins.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import Memory
from .common import text_rows

FIT_ROWS = 6000             # labelled rows per language that the model is fitted on, about
FIT_BYTES = 128 << 20       # text of all languages together that the model is fitted on, about
LEAST_ROWS = 20             # about so many rows of a language are taken whatever their bytes
LONGEST = 4
SMOOTH = 0.5
CACHE_BYTES = 88 << 20      # of words remembered with their grams



def _characters(*categories: str) -> str:
    """The characters of Unicode categories that begin so, as ranges of a character class."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in categories]
    ends = [i for i in range(len(found)) if i + 1 == len(found) or found[i + 1] != found[i] + 1]
    starts = [0, *(i + 1 for i in ends[:-1])]
    return "".join(f"\\U{found[a]:08x}-\\U{found[b]:08x}" for a, b in zip(starts, ends))


# A word is letters (category L) with the marks (M) that stand on them: numbers such as those in
# circles or fractions are none, and a mark doesn't end a word.
_WORDS = re.compile(f"[{_characters('L')}][{_characters('L', 'M')}]*")

# The same among the first 256 characters, in lower case: they hold no mark.
_NEAR_WORDS = re.compile("[a-zªµºß-öø-ÿ]+")


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text; the shorter class is only the faster one."""
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WORDS.findall(text)
    return _NEAR_WORDS.findall(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5, or the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("bigint").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _count_pass(batches):
    """(lang, text) -> (lang, kind, item, n): kind 0 a word, else the length of a character gram."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("item", pa.string()), ("n", pa.int64())])
    for batch in batches:
        per: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            per.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in per.items():
            items = {(0, w): n for w, n in words.items()}
            for word, count in words.items():
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        items[n, g] = items.get((n, g), 0) + count
            kinds, names = zip(*items) if items else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(items), pa.string()), pa.array(kinds, pa.int32()),
                 pa.array(names, pa.string()), pa.array(items.values(), pa.int64())], schema=schema)


def shares(have: list[tuple[str, int, int]], fit_rows: int, fit_bytes: int) -> list[tuple[str, float]]:
    """The part of each language's rows to learn from, given (language, rows, bytes) of all: about
    ``fit_rows`` rows, and of texts of more than the evenly dealt ``fit_bytes`` so much less."""
    part = {lang: min(1.0, fit_rows / rows) for lang, rows, _ in have}
    left = float(fit_bytes)
    order = sorted(have, key=lambda h: (part[h[0]] * h[2], h[0]))
    for i, (lang, rows, size) in enumerate(order):              # what a small language leaves is dealt on
        most = left / (len(order) - i)
        if part[lang] * size > most:
            part[lang] = max(most / size, min(part[lang], LEAST_ROWS / rows))
        left = max(0.0, left - part[lang] * size)
    return sorted(part.items())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> dict:
    """The model: all languages, and for words and each gram length the items and their log
    frequencies: those of an item that a language lacks, and what each language that has it adds.

    Fitted on about ``fit_rows`` labelled rows of each language (all where there are fewer) and
    ``fit_bytes`` of text in all, dealt evenly to the languages, chosen by a hash of id and text,
    and never on held-out rows.  Every word and gram of these rows is learned, so the model's size
    is bounded by ``fit_bytes`` (and LEAST_ROWS rows per language) and does not grow with the corpus.
    """
    rows = text_rows(docs, id_col, text_col, F.col(lang_col).cast("string").alias("lang"),
                     held_out(id_col).alias("held")).where("not held and lang is not null")
    have = [(r["lang"], r["n"], r["size"]) for r in
            rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()]
    langs = sorted(lang for lang, _, _ in have)
    if not langs:
        return {"langs": [], "tables": []}
    part = docs.sparkSession.createDataFrame(shares(have, fit_rows, fit_bytes), "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = (rows.join(F.broadcast(part), "lang").where(draw < F.col("share")).select("lang", "text")
              .mapInArrow(_count_pass, "lang string, kind int, item string, n long")
              .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).toArrow())
    counts = counts.sort_by([("kind", "ascending"), ("item", "ascending"), ("lang", "ascending")])
    kinds, n = counts["kind"].to_numpy(), counts["n"].to_numpy()
    lang = pc.index_in(counts["lang"], pa.array(langs, pa.string())).to_numpy()
    tables = []
    for kind in range(LONGEST + 1):
        lo, hi = np.searchsorted(kinds, [kind, kind + 1])
        items = counts["item"].slice(lo, hi - lo).combine_chunks()
        new = np.ones(hi - lo, bool)
        if len(new) > 1:
            new[1:] = pc.not_equal(items.slice(1), items.slice(0, len(items) - 1)).to_numpy(zero_copy_only=False)
        first = np.nonzero(new)[0]
        total = np.maximum(np.bincount(lang[lo:hi], n[lo:hi], len(langs)), 1)
        lacking = math.log(SMOOTH) - np.log(total + SMOOTH * max(1, len(first)))
        adds = (np.log(n[lo:hi] + SMOOTH) - math.log(SMOOTH)).astype(np.float32)
        tables.append((items.take(pa.array(first)).to_pylist(),
                       (lacking, np.r_[first, hi - lo], lang[lo:hi].astype(np.int32), adds)))
    return {"langs": langs, "tables": tables}


def _entries(logs: np.ndarray) -> tuple:
    """A plain matrix of log frequencies, items x languages, as fit() gives them."""
    n, langs = logs.shape
    return (np.zeros(langs), np.arange(n + 1) * langs, np.tile(np.arange(langs, dtype=np.int32), n), logs.ravel())


class Scorer:
    """All items in a row, words, then the grams of each length, each with its languages' entries."""

    def __init__(self, model: dict) -> None:
        self.langs = model["langs"]
        tables = [t if isinstance(t, tuple) else _entries(t) for _, t in model["tables"]]
        sizes = [len(names) for names, _ in model["tables"]]
        self.lacking = np.array([t[0] for t in tables])
        self.kind = np.repeat(np.arange(len(sizes)), sizes)
        width = np.concatenate([np.diff(t[1]) for t in tables])
        self.width, self.start = width, np.cumsum(width) - width
        self.lang = np.concatenate([t[2] for t in tables])
        self.adds = np.concatenate([t[3] for t in tables])
        self.index, base = [], 0
        for names, _ in model["tables"]:
            self.index.append({name: base + i for i, name in enumerate(names)})
            base += len(names)
        self.fallback = Memory(CACHE_BYTES)

    def _total(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        width = self.width[at]
        ends = np.cumsum(width)
        entry = np.arange(ends[-1]) + np.repeat(self.start[at] - ends + width, width)
        adds = np.bincount(self.lang[entry], np.repeat(weight, width) * self.adds[entry], len(self.langs))
        return np.bincount(self.kind[at], weight, len(self.lacking)) @ self.lacking + adds

    def _unseen(self, word: str) -> list[int]:
        for n in range(LONGEST, 0, -1):
            known = self.index[n]
            if found := [known[g] for g in grams(word, n) if g in known]:
                return found
        return []

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text)) if text else None
        if not words or not self.langs:
            return "und", 0.0
        vocabulary, at, weight = self.index[0], [], []
        for word, n in words.items():
            if (i := vocabulary.get(word)) is not None:
                at.append(i)
                weight.append(n)
                continue
            found = self.fallback.known.get(word)
            if found is None:
                found = self._unseen(word)
                self.fallback.learn_one(word, found, 8 * len(found))
            if found:
                at.extend(found)
                weight.extend([n / len(found)] * len(found))
        total = np.zeros(len(self.langs))
        if at:
            total = self._total(np.asarray(at), np.asarray(weight, np.float64))
        best = int(np.argmax(total))
        return self.langs[best], 1.0 / math.fsum(np.exp(total - total[best]))


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """row_key, doc_id, held_out, lang_pred, score of every row; whole texts are scored.

    Words are letters with their marks, lower-cased; repeated rows are predicted each.  ``und`` with
    score 0 where the text is null or has no letter, and everywhere if no row has
    a language to learn; else the best language, the first by name in a tie, and its share of
    the posterior under equal priors.  Only the text is an input of a prediction.
    """
    model = fit(docs, id_col, text_col, lang_col, fit_rows, fit_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value["langs"] else None
        for batch in batches:
            found = [scorer.predict(t) if scorer else ("und", 0.0) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=["row_key", "doc_id", "held_out", "lang_pred", "score"])
    rows = text_rows(docs, id_col, text_col, held_out(id_col).alias("held_out"))
    return rows.select("row_key", "doc_id", "held_out", "text").mapInArrow(
        run, "row_key long, doc_id long, held_out boolean, lang_pred string, score double")
