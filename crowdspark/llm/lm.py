"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

P(w | h) = l2(b) c(h,w)/c(h) + l1(b) c(w)/N + l0(b) 1/(V+1), where b is the bucket of the context's
frequency c(h).  The training texts are divided: one part is deleted from the counts, and the
mixture weights of each bucket are learned on it by expectation-maximisation with the other
part's counts.  Scores then use the counts of all training texts.

Counts are looked up without ever sending one row per token.  A chunk (part of an input
partition, of bounded size) asks for its distinct n-grams, each once with the chunk's own
counts; reducers add up and answer only where the total differs from what the chunk has, or where
its deleted texts meet an n-gram of its counted ones; the answers go back to the chunk's texts.
The deleted texts of a chunk thus find all they need in the answers and zeros.  A frequent word or word pair is one row per chunk.
Requests and answers travel as sorted arrays, one row per (chunk, reducer).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import ENTRY_BYTES
from .common import partitions, stored, text_rows

CHUNK_BYTES = 8 << 20               # of stored input
FLUSH_TOKENS = 2 << 20              # a mapper sends its requests when it holds so many tokens
SLICES = 4                          # of the key space, for each reducer: evens them out
CACHE_BYTES = 110 << 20             # of words remembered
ROUNDS = 30
SETTLED = 1e-6                      # EM ends when no weight moves by more
BUCKETS = 64                        # by the binary logarithm of the context's frequency

END = np.uint64(0x9E6D3B1F5A7C2E81)         # key of the end token: no word hashes here but by chance
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29)

FIT, DELETED, UNSEEN = 0, 1, 2      # role of a text: counted, for the weights, only scored


def role(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 7: 2 is held out, 4 is the deleted part; a null id is held out."""
    rest = F.crc32(F.col(id_col).cast("bigint").cast("string").cast("binary")) % 7
    return F.when(rest == 4, DELETED).when(rest != 2, FIT).otherwise(UNSEEN).cast("int")


class WordKeys(dict):
    """64-bit key of each word, remembered up to a bound in bytes."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + ENTRY_BYTES
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = len(word) + ENTRY_BYTES
        key = self[word] = xxhash.xxh64_intdigest(word)
        return key


def token_keys(text: str, keys: WordKeys) -> np.ndarray:
    """Keys of the lower-cased words (A-Z) and the end token."""
    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(keys.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of (previous token, token); the text begins behind an end token."""
    before = np.empty_like(tokens)
    before[0], before[1:] = END, tokens[:-1]
    x = before * _A + tokens
    x ^= x >> _C
    x *= _B
    return x ^ (x >> np.uint64(32))


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple:
    """Sorted distinct keys with the sums of each count."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0] if len(keys) else np.empty(0, np.int64)
    return (keys[first], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts))


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, in as many low bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(keys) else 1
    return bytes([width]) + steps[:, None].view(np.uint8)[:, :width].tobytes()


def _unpacked_keys(data: bytes) -> np.ndarray:
    width = data[0]
    low = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(low), 8), np.uint8)
    steps[:, :width] = low
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _packed(array: np.ndarray) -> bytes:
    """64-bit counts, most of them small, as compressed planes of as many low bytes as the largest needs."""
    width = max(1, -(-int(array.max()).bit_length() // 8)) if len(array) else 1
    planes = np.ascontiguousarray(array.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    low = np.frombuffer(zlib.decompress(memoryview(data)[1:]), np.uint8).reshape(width, -1)
    counts = np.zeros((low.shape[1], 8), np.uint8)
    counts[:, :width] = low.T
    return counts.view("<u8").ravel().astype(np.int64)


REQUEST = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("words", pa.bool_()), ("keys", pa.binary()),
                     ("fit", pa.binary()), ("deleted", pa.binary())])


def _request_pass(parts: int):
    """(chunk, role, text) -> for each chunk and reducer the distinct n-grams and own counts."""
    def rows(chunk: int, held: list) -> Iterator[pa.RecordBatch]:
        roles = np.concatenate([np.full(len(t), r) for r, t in held])
        for words, keys in ((True, [t for _, t in held]), (False, [pair_keys(t) for _, t in held])):
            keys, fit, deleted = _summed(np.concatenate(keys), (roles == FIT).astype(np.int64),
                                         (roles == DELETED).astype(np.int64))
            part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            out = [(p, chunk, words, _packed_keys(keys[a:b]), _packed(fit[a:b]), _packed(deleted[a:b]))
                   for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), REQUEST)], schema=REQUEST)

    def run(batches):
        keys, held, size = WordKeys(), {}, 0
        for batch in batches:
            for chunk, r, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = token_keys(text, keys)
                held.setdefault(chunk, []).append((r, tokens))
                size += len(tokens)
                if size >= FLUSH_TOKENS:
                    for own, texts in held.items():
                        yield from rows(own, texts)
                    held, size = {}, 0
        for own, texts in held.items():
            yield from rows(own, texts)
    return run


ANSWER = pa.schema([("chunk", pa.int64()), ("words", pa.bool_()), ("keys", pa.binary()), ("fit", pa.binary()),
                    ("deleted", pa.binary()), ("known", pa.int64()), ("n_fit", pa.int64()), ("n_deleted", pa.int64())])


def _answer_pass(batches):
    """Requests of one reducer -> answers by chunk, and one row (chunk null) of sums over its words.

    A reducer holds its slice of the key space: what each chunk asked of it, once per n-gram.
    """
    asked: dict[bool, list] = {True: [], False: []}
    for batch in batches:
        for r in batch.to_pylist():
            asked[r["words"]].append((r["chunk"], _unpacked_keys(r["keys"]), _unpacked(r["fit"]),
                                      _unpacked(r["deleted"])))
    for words, blocks in asked.items():
        if not blocks:
            continue
        keys, fit, deleted = _summed(*(np.concatenate([b[i] for b in blocks]) for i in (1, 2, 3)))
        own: dict[int, list] = {}
        for block in blocks:
            own.setdefault(block[0], []).append(block)
        out = []
        for chunk in sorted(own):
            mine = _summed(*(np.concatenate([b[i] for b in own[chunk]]) for i in (1, 2, 3)))
            at = np.searchsorted(keys, mine[0])
            differ = (fit[at] != mine[1]) | (deleted[at] != mine[2]) | ((mine[1] > 0) & (mine[2] > 0))
            at = at[differ]
            if len(at):
                out.append((chunk, words, _packed_keys(keys[at]), _packed(fit[at]), _packed(deleted[at]), 0, 0, 0))
        if words:
            out.append((None, True, b"", b"", b"", int(((fit + deleted) > 0).sum()), int(fit.sum()),
                        int(deleted.sum())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ANSWER)], schema=ANSWER)


def _totals(keys: np.ndarray, roles: np.ndarray, answers: pd.DataFrame, all_texts: bool) -> tuple:
    """The total of each token's n-gram, and the distinct n-grams with theirs: the answers' counts
    where there are any, else the texts' own.  One sort numbers the n-grams; no token is searched.
    The answers may hold n-grams of other texts of the chunk."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    first = np.nonzero(new)[0]
    distinct, own = ordered[first], roles[order]
    del ordered
    total = np.add.reduceat((own == FIT) | (all_texts & (own == DELETED)), first, dtype=np.int64)
    for row in answers.itertuples():
        asked = _unpacked_keys(row.keys)
        at = np.searchsorted(distinct, asked)
        at[at == len(distinct)] = 0
        here = distinct[at] == asked
        total[at[here]] = (_unpacked(row.fit) + _unpacked(row.deleted) if all_texts else _unpacked(row.fit))[here]
    out = np.empty(len(keys), np.int32 if len(total) == 0 or total.max() < (1 << 31) - 1 else np.int64)
    out[order] = total[np.cumsum(new) - 1]
    return out, distinct, total


def _token_counts(texts: pd.DataFrame, answers: pd.DataFrame, all_texts: bool) -> tuple:
    """A chunk's texts -> tokens per text, and for all its tokens in a row c(h,w), c(w) and c(h)."""
    keys = WordKeys()
    tokens = [token_keys(t, keys) for t in texts["text"]]
    sizes = np.array([len(t) for t in tokens])
    starts = np.cumsum(sizes) - sizes
    flat, pairs = np.concatenate(tokens), np.concatenate([pair_keys(t) for t in tokens])
    del tokens, keys
    roles = np.repeat(texts["role"].to_numpy(np.int8), sizes)
    of_words = answers["words"].to_numpy(bool)
    word, distinct, total = _totals(flat, roles, answers[of_words], all_texts)
    end = total[np.searchsorted(distinct, END)]
    del flat, distinct, total
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[starts] = end
    pair, _, _ = _totals(pairs, roles, answers[~of_words], all_texts)
    return sizes, starts, pair, word, context


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unknown context, else one more than the binary logarithm of its frequency."""
    return np.where(context > 0, np.frexp(np.maximum(context, 1).astype(np.float64))[1], 0)


def estimates(pair: np.ndarray, word: np.ndarray, context: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of both orders; without a context the higher is 0."""
    return pair / np.maximum(context, 1), word / max(n, 1)


def fit_weights(held: DataFrame, p0: float, rounds: int = ROUNDS, settled: float = SETTLED) -> np.ndarray:
    """Weights (BUCKETS x 3: unigram, bigram, uniform) by EM over the deleted part's token rows
    (bucket, p2, p1, n).  Each round is one aggregation; only its 64 sums reach the driver.
    A bucket that the deleted part never meets keeps even weights."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0.5, 0.0, 0.5)                    # no context: nothing for the higher order
    for _ in range(rounds):
        table = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in weights])
        own = F.element_at(table, F.col("bucket") + 1)
        parts = held.select("bucket", "n", (own[0] * F.col("p1")).alias("a"), (own[1] * F.col("p2")).alias("b"),
                            (own[2] * F.lit(p0)).alias("c")).withColumn("all", F.col("a") + F.col("b") + F.col("c"))
        got = parts.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(c) / F.col("all")).alias(c) for c in "abc"])
        new = weights.copy()
        for r in got.collect():
            share = np.array([r["a"], r["b"], r["c"]])
            new[r["bucket"]] = share / share.sum()
        moved = float(np.abs(new - weights).max())
        weights = new
        if moved <= settled:
            break
    return weights


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    rounds: int = ROUNDS) -> DataFrame:
    """row_key, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``docs`` must be a stored table (a file scan): its partitions are the chunks.  A null or empty
    text is the end token alone.  Logarithms are decimal.  Without training texts every word is
    unknown and only the uniform part scores; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    split = max(1, _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) // CHUNK_BYTES)
    rows = text_rows(docs, id_col, text_col, role(id_col).alias("role")).withColumn(
        "chunk", F.spark_partition_id().cast("long") * split + F.pmod(F.xxhash64("doc_id", "text"), F.lit(split)))
    asked = rows.select("chunk", "role", "text").mapInArrow(_request_pass(SLICES * parts), _ddl(REQUEST))
    answers = stored(asked.repartition(parts, "part").mapInArrow(_answer_pass, _ddl(ANSWER)), "lm-counts")
    total = answers.where("chunk is null").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("known", "n_fit", "n_deleted")]).first()
    known, n_fit, n_all = total["known"], total["n_fit"], total["n_fit"] + total["n_deleted"]
    p0 = 1.0 / (known + 1)
    given = answers.where("chunk is not null").select("chunk", "words", "keys", "fit", "deleted")

    def joined(of: DataFrame, run, schema: str) -> DataFrame:
        return of.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInPandas(run, schema)

    def deleted_tokens(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({"bucket": [], "p2": [], "p1": [], "n": []})
        _, _, pair, word, context = _token_counts(texts, answers, False)
        p2, p1 = estimates(pair, word, context, n_fit)
        return (pd.DataFrame({"bucket": bucket(context).astype(np.int32), "p2": p2, "p1": p1, "n": 1})
                .groupby(["bucket", "p2", "p1"], as_index=False, sort=False)["n"].sum())

    held = joined(rows.where(F.col("role") == DELETED).select("chunk", "role", "text"), deleted_tokens, "bucket int, p2 double, p1 double, n long")
    weights = fit_weights(stored(held, "lm-deleted"), p0, rounds)

    def scores(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({c: [] for c in names})
        sizes, starts, pair, word, context = _token_counts(texts, answers, True)
        p2, p1 = estimates(pair, word, context, n_all)
        own = bucket(context)
        p = weights[own, 0] * p1
        p += weights[own, 1] * p2
        p += weights[own, 2] * p0
        return pd.DataFrame({
            "row_key": texts["row_key"], "doc_id": texts["doc_id"], "held_out": texts["role"] == UNSEEN,
            "n_tokens": sizes, "n_known": np.add.reduceat(word > 0, starts, dtype=np.int64), "train_tokens": n_all,
            "base_score": np.add.reduceat(np.log10((word + 1) / (n_all + known + 1)), starts),
            "score": np.add.reduceat(np.log10(p), starts)})

    names = ["row_key", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return joined(rows, scores, "row_key long, doc_id long, held_out boolean, n_tokens long, n_known long, "
                                "train_tokens long, base_score double, score double")


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _bytes(text: str) -> int:
    """A size setting such as 134217728b, 16m or 128MB in bytes."""
    number = text.lower().rstrip("ib")
    unit = {"k": 10, "m": 20, "g": 30}.get(number[-1:], 0)
    return int(number.rstrip("kmg")) << unit
