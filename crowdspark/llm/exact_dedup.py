"""Exact deduplication by Grace hashing.

Each task partitions its records into spill files by hash bits, again and again, until the
distinct texts of a bucket fit an open-addressing table that compares complete contents.

Two passes keep hot texts apart: the first runs on the input partitions as they lie and keeps
one representative of each text and partition; only representatives travel in the second,
which groups them over the cluster.  A text that a third of all rows share thus reaches its
task once per input partition, and its rows are told their group through a join on the
representative, whose key is spread.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, partitions, stored, text_rows

MEMORY_BYTES = 48 << 20
FANOUT_BITS = 4

_HEAD = struct.Struct("<32sqqqI")       # digest, row key, smallest id, rows, content length
NO_ID = (1 << 63) - 1                   # stands for a null id: behind every other

LOCAL = "row_key long, doc_id long, rep_key long, text_sha256 string, rep_id long, rows long, body binary"
GLOBAL = "rep_key long, keep_key long, keep_id long, group_size long"


class ContentTable:
    """Open addressing with linear probing; equal means equal complete content."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.entries: list[list] = []       # digest, content, smallest (id, key), rows, members
        self.bytes = 0

    def _probe(self, digest: bytes, body: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "little") & mask
        while (found := self.slots[at]) >= 0:
            entry = self.entries[found]
            if entry[0] == digest and entry[1] == body:
                return at
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, body: bytes, key: int, doc_id: int, rows: int) -> None:
        at = self._probe(digest, body)
        if self.slots[at] < 0:
            self.slots[at] = len(self.entries)
            self.entries.append([digest, body, (doc_id, key), rows, [(key, doc_id, rows)]])
            self.bytes += len(body) + 300
            if 2 * len(self.entries) > len(self.slots):
                self._grow()
        else:
            entry = self.entries[self.slots[at]]
            entry[2] = min(entry[2], (doc_id, key))
            entry[3] += rows
            entry[4].append((key, doc_id, rows))
            self.bytes += 100

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for i, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][8:16], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i

    def fits(self, limit: int) -> bool:
        """One text alone cannot be split further, however long or often it is."""
        return self.bytes <= limit or len(self.entries) == 1

    def records(self) -> Iterator[tuple]:
        for digest, body, _, _, members in self.entries:
            for key, doc_id, rows in members:
                yield digest, body, key, doc_id, rows


def _bucket(digest: bytes, level: int) -> int:
    """FANOUT_BITS fresh hash bits per level; beyond the digest's bits, of a new hash of it."""
    per_digest = 64 // FANOUT_BITS
    if level >= per_digest:
        digest = hashlib.blake2b(digest, digest_size=8, salt=level.to_bytes(8, "little")).digest()
        level %= per_digest
    return (int.from_bytes(digest[:8], "little") >> (level * FANOUT_BITS)) & ((1 << FANOUT_BITS) - 1)


def _read(path: str) -> Iterator[tuple]:
    with open(path, "rb", buffering=1 << 18) as file:
        while head := file.read(_HEAD.size):
            digest, key, doc_id, rows, length = _HEAD.unpack(head)
            yield digest, file.read(length), key, doc_id, rows


def grace_groups(records: Iterable[tuple], limit: int, folder: str, level: int = 0) -> Iterator[list]:
    """Yield [digest, content, (smallest id, its key), rows, members] of each distinct content."""
    table, files = ContentTable(), None
    names = [os.path.join(folder, f"{level}-{i}") for i in range(1 << FANOUT_BITS)]

    def spill(record: tuple) -> None:
        digest, body, key, doc_id, rows = record
        out = files[_bucket(digest, level)]
        out.write(_HEAD.pack(digest, key, doc_id, rows, len(body)))
        out.write(body)

    try:
        for record in records:
            if files is not None:
                spill(record)
                continue
            table.add(*record)
            if not table.fits(limit):
                files = [open(name, "wb", buffering=1 << 16) for name in names]
                for held in table.records():
                    spill(held)
                table = ContentTable()
    finally:
        for file in files or ():
            file.close()
    yield from table.entries
    if files is not None:
        del table
        for name in names:
            sub = f"{name}.d"
            os.mkdir(sub)
            yield from grace_groups(_read(name), limit, sub, level + 1)
            os.remove(name)
            os.rmdir(sub)


def _batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size; the last element of a row may be a long binary."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _local_pass(limit: int):
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("rep_key", pa.int64()),
                        ("text_sha256", pa.string()), ("rep_id", pa.int64()), ("rows", pa.int64()),
                        ("body", pa.binary())])

    def records(batches):
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bodies = batch.column(2)
            for i, (key, doc_id) in enumerate(zip(keys, ids)):
                body = bodies[i].as_buffer().to_pybytes()
                yield hashlib.sha256(body).digest(), body, key, NO_ID if doc_id is None else doc_id, 1

    def known(value):
        return None if value == NO_ID else value

    def run(batches):
        def rows():
            with tempfile.TemporaryDirectory() as folder:
                for digest, body, (rep_id, rep_key), n, members in grace_groups(records(batches), limit, folder):
                    sha = digest.hex()
                    for key, doc_id, _ in members:
                        first = key == rep_key
                        yield (key, known(doc_id), rep_key, sha, known(rep_id) if first else None,
                               n if first else None, body if first else None)
        yield from _batches(rows(), schema)
    return run


def _global_pass(limit: int):
    schema = pa.schema([("rep_key", pa.int64()), ("keep_key", pa.int64()), ("keep_id", pa.int64()),
                        ("group_size", pa.int64())])

    def records(batches):
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            bodies = batch.column(4)
            for i, (key, doc_id, rows, sha) in enumerate(zip(*cols)):
                yield (bytes.fromhex(sha), bodies[i].as_buffer().to_pybytes(), key,
                       NO_ID if doc_id is None else doc_id, rows)

    def run(batches):
        def rows():
            with tempfile.TemporaryDirectory() as folder:
                for _, _, (keep_id, keep_key), n, members in grace_groups(records(batches), limit, folder):
                    for key, _, _ in members:
                        yield key, keep_key, None if keep_id == NO_ID else keep_id, n
        yield from _batches(rows(), schema)
    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row per input row: row_key, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; a null text
    is an empty one.  The row with the smallest id stays; null ids come last, and of rows with
    the same id the first in the table stays, so exactly one row of a group has ``kept``.
    ``row_key`` is monotonically_increasing_id over ``docs``, for joining back to a stored table.
    Empty tables give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col).select(
        "row_key", "doc_id", F.regexp_replace("text", BLANKS, " ").cast("binary").alias("body"))
    local = stored(rows.mapInArrow(_local_pass(memory_bytes), LOCAL), "exact-local")
    reps = (local.where(F.col("body").isNotNull()).select("rep_key", "rep_id", "rows", "text_sha256", "body")
            .repartition(partitions(spark), "text_sha256"))
    groups = reps.mapInArrow(_global_pass(memory_bytes), GLOBAL)
    return (local.select("row_key", "doc_id", "rep_key", "text_sha256").join(groups, "rep_key")
            .select("row_key", "doc_id", "keep_id", "group_size",
                    (F.col("row_key") == F.col("keep_key")).alias("kept"), "text_sha256"))
