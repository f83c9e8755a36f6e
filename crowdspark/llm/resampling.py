"""Target-distribution importance resampling on hashed word n-grams.

Features fall into buckets by CRC-32.  A bucket's gain says how much more often the target has it
than the documents; a document's weight is the mean gain of its features, and the documents with
the highest weight plus Gumbel noise are drawn, which samples without replacement in proportion
to the importance weights.

The CRCs are computed in length-bucketed matrices: distinct features of equal length are rows of a
two-dimensional uint8 array, all CRCs advance column by column, and the results are scattered back
to the features.  Bytes beyond ``COLUMNS`` make further rows, whose CRCs are combined pairwise, so
a long feature costs no more columns than a short one.

Both passes over the documents read them where they lie.  What travels: a bucket's count per task,
and numbers per document, sorted by range.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import Memory, slices
from .common import partitions, stored, text_rows

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 10                      # per cent of the documents with enough words
SEED = 2024
COLUMNS = 64                    # of a matrix

# A byte of a word stays (A-Z lower-cased), any other becomes a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# How the CRC register moves on by a zero byte, for each value of its low byte.
_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def features_of(words: list[bytes], least: int, most: int) -> list[bytes]:
    """All runs of ``least`` to ``most`` consecutive words, joined by one space, repeats included."""
    if least == most == 1:
        return words
    return [b" ".join(words[i:i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def _advance(register: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The registers after the columns of ``matrix``, one after the other."""
    for column in np.ascontiguousarray(matrix.T):
        register = _STEP[(register ^ column) & 255] ^ (register >> 8)
    return register


def _over_zeros(length: int) -> np.ndarray:
    """Tables (4 x 256) that move a register over ``length`` zero bytes: the move is linear in its bits."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    moved = bits
    power = _STEP[bits & 255] ^ (bits >> 8)                     # images of the bits over one byte
    while length:
        if length & 1:
            moved = _linear(power, moved)
        power, length = _linear(power, power), length >> 1
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_linear(moved, values << np.uint32(8 * k)) for k in range(4)])


def _linear(images: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), images[bit], np.uint32(0))
    return out


def crc32_all(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each feature, by matrices of equal length."""
    out = np.empty(len(features), np.uint32)
    grouped: dict[int, list[int]] = defaultdict(list)
    for i, feature in enumerate(features):
        size = len(feature)
        # longer ones: as many rows as the next power of two, padded with zeros in front
        grouped[size if size <= COLUMNS else COLUMNS << (-(-size // COLUMNS) - 1).bit_length()].append(i)
    for width, members in grouped.items():
        if width <= COLUMNS:
            matrix = np.frombuffer(b"".join([features[i] for i in members]), np.uint8).reshape(len(members), width)
            out[members] = ~_advance(np.full(len(members), 0xFFFFFFFF, np.uint32), matrix)
            continue
        # the start value is that of the first four bytes inverted and a register of zero, which
        # zeros in front leave as it is
        bodies = [bytes(b ^ 255 for b in f[:4]) + f[4:] for f in (features[i] for i in members)]
        matrix = np.frombuffer(b"".join(b.rjust(width, b"\0") for b in bodies), np.uint8).reshape(-1, COLUMNS)
        register = _advance(np.zeros(len(matrix), np.uint32), matrix).reshape(len(members), -1)
        span = COLUMNS
        while register.shape[1] > 1:
            tables = _over_zeros(span)
            left, right = register[:, 0::2], register[:, 1::2]
            register = right ^ tables[0][left & 255] ^ tables[1][left >> 8 & 255] ^ tables[2][left >> 16 & 255] ^ tables[3][left >> 24]
            span *= 2
        out[members] = ~register[:, 0]
    return out


class Hasher:
    """Buckets of the features of texts; distinct features are hashed once while remembered."""

    def __init__(self, buckets: int, least: int, most: int) -> None:
        self.buckets, self.least, self.most = buckets, least, most
        self.memory = Memory()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets of all features, features per text, words per text)."""
        words = [words_of(t) for t in texts]
        features = [features_of(w, self.least, self.most) for w in words]
        new, known = list(self.memory.unknown(set().union(*features))), self.memory.known
        known.update(zip(new, (crc32_all(new) % np.uint32(self.buckets)).tolist()))
        sizes = np.array([len(f) for f in features], np.int64)
        found = np.fromiter(map(known.__getitem__, chain.from_iterable(features)), np.int64, int(sizes.sum()))
        return found, sizes, np.array([len(w) for w in words], np.int64)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, least: int = 1, most: int = 1) -> DataFrame:
    """(bucket, n) over the texts of ``rows``; each task sends a bucket once."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets, least, most), np.zeros(buckets, np.int64)
        for part in slices(batches, "text"):
            total += np.bincount(hasher(part.column("text").to_pylist())[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket from its counts in the documents and in the target, in thousandths."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    n = float(len(s))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document in thousandths; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             buckets: int = BUCKETS, least: int = 1, most: int = 1, least_words: int = LEAST_WORDS, share: int = SHARE,
             seed: int = SEED) -> DataFrame:
    """row_key, doc_id, n_features, n_words, weight, score, rank per row of ``docs``.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters; features are
    all runs of ``least`` to ``most`` of them.  ``rank`` (1, 2, ...) is given to the floor(share %)
    highest scores of the documents of at least ``least_words`` words; ties go to the smaller id (a
    null id is behind every other), then to the earlier row.  Null and empty texts have no features
    and weight 0.  Repeated rows count and are ranked once each.  With an empty target, or no
    documents, the formula holds with its counts of zero.  The driver and every task hold one
    number per bucket, a parameter; texts are read whole.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    aims = target.select(F.coalesce(F.col(target_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def counts(of: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(of, buckets, least, most).collect():     # at most one row a bucket
            out[bucket] = n
        return out

    gain = gains(counts(rows), counts(aims))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets, least, most)
        for part in slices(batches, "text"):
            found, sizes, words = hasher(part.column("text").to_pylist())
            ends = np.cumsum(sizes)
            sums = np.append(0, np.cumsum(gain[found]))
            weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)      # floors go down
            yield pa.RecordBatch.from_arrays(
                [part.column("row_key"), part.column("doc_id"), *map(pa.array, (sizes, words, weight))],
                names=["row_key", "doc_id", "n_features", "n_words", "weight"])

    weighed = rows.mapInArrow(weigh, "row_key long, doc_id long, n_features long, n_words long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn(
        "able", F.col("n_words") >= least_words)
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row_key").asc()]
    scored = stored(scored, "scores")
    ranged = stored(scored.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()), "ranked")
    # one row per range: how many documents are in it and how many of them can be drawn
    sizes = sorted((r["range"], r["n"], r["able"]) for r in ranged.groupBy("range").agg(
        F.count("*").alias("n"), F.count_if("able").alias("able")).collect())
    quota = share * sum(s[2] for s in sizes) // 100
    ahead = np.cumsum([0, *(s[1] for s in sizes)]).tolist()
    before = F.element_at(F.create_map(*chain.from_iterable((F.lit(s[0]), F.lit(a)) for s, a in zip(sizes, ahead))),
                          F.col("range")) if sizes else F.lit(0)
    place = before + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return (ranged.withColumn("place", place.cast("long"))
            .withColumn("rank", F.when(F.col("able") & (F.col("place") <= quota), F.col("place")))
            .select("row_key", "doc_id", "n_features", "n_words", "weight", "score", "rank"))
