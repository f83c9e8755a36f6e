"""Byte-level BPE encoding in overlapping chunks, and decoding.

Texts are cut into chunks that overlap; each chunk is pre-tokenised on its own, wherever its row
lies.  Chunk and successor are stitched at the first place in their overlap where both have a
pre-token boundary: from a common boundary on the pattern finds the same pre-tokens in both, as
it never looks back.  Each chunk then encodes the pieces from its first stitch to its last one.
Boundaries near the end of a chunk are not used, as the pattern may have looked past the end,
nor those behind white space, as the pattern tells white space at the end of a text from others.

Chunks that have no such boundary in common (one pre-token longer than the overlap) are joined to one
chunk, until every neighbour is stitched.  Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices
from .common import stored, text_rows

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK = 1 << 15                 # characters from a chunk's start to the next one's
OVERLAP = 1 << 10               # characters shared with the next chunk
LOOKAHEAD = 3                   # characters behind a match's end that the pattern can have looked at

PIECE = "row_key long, doc_id long, chunk int, start long, own long, last boolean, text string"
ENCODED = "row_key long, doc_id long, ids binary"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pattern():
    import public_tokenizers
    import regex
    return regex.compile(public_tokenizers.PATTERN)


class Codec:
    """Ids of texts by the vocabulary's ranks, and the bytes of ids."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        ranks = ranks_of(path)
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text, each pre-token by itself."""
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, bool, str]]:
    """(start, characters to the next start, whether the last, text) of the chunks of a text."""
    n = max(1, -(-(len(text) - overlap) // chunk))
    for k in range(n):
        last = k == n - 1
        yield k * chunk, len(text) - k * chunk if last else chunk, last, text[k * chunk:None if last else (k + 1) * chunk + overlap]


def boundaries(find, text: str, last: bool, own: int, overlap: int) -> tuple[list[int], list[int]]:
    """Places of pre-token boundaries in the first ``overlap`` characters of a chunk, and in what
    it shares with the next one, that are those of the whole text read from the chunk's start; in
    the latter none behind white space."""
    sure = len(text) if last else len(text) - LOOKAHEAD
    ends = [m.end() for m in find(text) if m.end() <= sure]
    closes = [] if last else [e for e in ends if own <= e < own + overlap and not text[e - 1].isspace()]
    return [0, *(e for e in ends if e < overlap)], closes


def _long_texts(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of the texts that have several, dealt to all tasks, where they meet their stitches:
    (row_key, doc_id, chunk, text, first, behind).  ``first``: characters before the chunk's first
    piece, ``behind``: characters of the next chunk's pieces."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for key, doc, text in zip(*(part.column(c).to_pylist() for c in ("row_key", "doc_id", "text"))):
                for k, (start, own, last, piece) in enumerate(cut(text, chunk, overlap)):
                    yield pa.RecordBatch.from_pydict(
                        {"row_key": [key], "doc_id": [doc], "chunk": [k], "start": [start], "own": [own], "last": [last],
                         "text": [piece]},
                        schema=pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()),
                                          ("start", pa.int64()), ("own", pa.int64()), ("last", pa.bool_()),
                                          ("text", pa.string())]))

    def edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = pattern().finditer
        for part in slices(batches, "text"):
            got = [boundaries(find, t, last, own, overlap) for t, last, own in
                   zip(*(part.column(c).to_pylist() for c in ("text", "last", "own")))]
            start = part.column("start").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("row_key", "chunk", "start", "own", "last")),
                 *(pa.array([[s + e for e in g[side]] for s, g in zip(start, got)], pa.list_(pa.int64())) for side in (0, 1))],
                names=["row_key", "chunk", "start", "own", "last", "opens", "closes"])

    table = stored(rows.mapInArrow(chunks, PIECE).repartition("row_key", "chunk"), "chunks")
    in_order = Window.partitionBy("row_key").orderBy("chunk")
    while True:
        seen = table.mapInArrow(edges, "row_key long, chunk int, start long, own long, last boolean, "
                                       "opens array<long>, closes array<long>")
        met = F.array_min(F.array_intersect("closes", F.lead("opens").over(in_order)))
        seams = stored(seen.withColumn("to", met).drop("opens", "closes"), "seams")
        if seams.where(F.col("to").isNull() & ~F.col("last")).isEmpty():
            break
        # neighbours without a common boundary are islands: each becomes one chunk
        opens = F.lag("to").over(in_order).isNotNull() | F.lag("chunk").over(in_order).isNull()
        islands = (seams.withColumn("opener", F.when(opens, F.col("chunk")))
                   .select("row_key", "chunk", F.max("opener").over(in_order).alias("island")))
        parts = table.join(islands, ["row_key", "chunk"])
        part = F.struct("chunk", "start", "own", "last", "text")
        joined = parts.groupBy("row_key", F.col("island").alias("chunk")).agg(
            F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(part)).alias("p"))
        final = F.element_at("p", -1)
        body = F.array_join(F.transform(F.slice("p", 1, F.size("p") - 1), lambda x: F.left(x["text"], x["own"].cast("int"))), "")
        table = stored(joined.select(
            "row_key", "doc_id", "chunk", F.element_at("p", 1)["start"].alias("start"),
            F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["own"]).alias("own"),
            final["last"].alias("last"), F.concat(body, final["text"]).alias("text")), "chunks")
    length = F.length("text")
    ranged = seams.withColumn("from", F.coalesce(F.lag("to").over(in_order), F.col("start")))
    return (table.join(ranged.select("row_key", "chunk", "from", "to"), ["row_key", "chunk"])
            .select("row_key", "doc_id", "chunk", "text",
                    (F.col("from") - F.col("start")).alias("first"),
                    F.when(F.col("last"), 0).otherwise(F.col("start") + length - F.col("to")).alias("behind")))


def _encoded(chunks: DataFrame, path: str) -> DataFrame:
    """Ids of the pieces of each chunk."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in slices(batches, "text"):
            ids = [own.encode(t[a:len(t) - b]) for t, a, b in
                   zip(*(part.column(c).to_pylist() for c in ("text", "first", "behind")))]
            yield pa.RecordBatch.from_arrays(
                [part.column("row_key"), part.column("doc_id"), part.column("chunk"), pa.array(ids, pa.binary())],
                names=["row_key", "doc_id", "chunk", "ids"])

    return chunks.mapInArrow(rows, "row_key long, doc_id long, chunk int, ids binary")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                     chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row_key, doc_id, ids per row of ``docs``: the ids of the whole text as little-endian unsigned
    32-bit integers, as a plain encoder without special tokens gives them.

    ``docs`` must be a stored table.  Texts of one chunk are encoded where they lie; only the
    chunks of longer ones travel.  A null or empty text has no ids; repeated rows and null ids
    are kept as they are; an empty table gives no rows.  A pre-token is never cut, so a text
    without a boundary in ``overlap`` characters is encoded by one task, whole.
    """
    if not LOOKAHEAD < overlap <= chunk:
        raise ValueError("the overlap must hold some characters and be at most a chunk")
    path = vocabulary or vocabulary_path()
    rows = text_rows(docs, id_col, text_col)
    short = F.length("text") <= chunk + overlap
    whole = rows.where(short).select("row_key", "doc_id", F.lit(0).alias("chunk"), "text", F.lit(0).cast("long").alias("first"),
                                     F.lit(0).cast("long").alias("behind"))

    def join(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("chunk").to_numpy())
        ids = table.column("ids").to_pylist()
        return pa.table([table.column("row_key").slice(0, 1), table.column("doc_id").slice(0, 1),
                         pa.array([b"".join(ids[i] for i in order)], pa.binary())], names=["row_key", "doc_id", "ids"])

    parts = _encoded(_long_texts(rows.where(~short), chunk, overlap), path)
    joined = parts.groupBy("row_key").applyInArrow(join, ENCODED)
    return _encoded(whole, path).select("row_key", "doc_id", "ids").unionByName(joined)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``encoded`` (row_key, doc_id, ids) with the bytes the ids stand for as ``decoded``."""
    path = vocabulary or vocabulary_path()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in slices(batches, "ids"):
            decoded = pa.array([own.decode(i) for i in part.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    return encoded.select("row_key", "doc_id", "ids").mapInArrow(rows, ENCODED + ", decoded binary")
