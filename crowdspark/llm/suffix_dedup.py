"""Removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes when it lies in a ``length``-byte string that also starts in a document with a
smaller id.  Only suffixes that can matter are sorted, and no string is lost on the way:

1. Of equal texts one representative is looked at (a copy's bytes all go if it is long enough).
2. Each ``length``-byte window is known by its smallest 16-byte gram.  Equal windows have equal
   smallest grams, so only windows whose gram occurs under two ids can repeat.  Chunks of texts
   ask reducers for their grams once and are told the shared ones.
3. The windows of one gram in one place form a context of at most 2 x length - 16 bytes.  Contexts
   meet by gram; equal ones are settled at once, and the suffixes of different ones are sorted:
   multikey quicksort on 8-byte characters down to a shallow depth, then a blind trie for each
   group that still agrees.  Suffixes with ``length`` bytes in common lie side by side.
4. The contexts of a gram in very many texts meet by content instead, which settles the equal
   ones (the inside of a common passage).  The windows of those that are left (its edges) meet by
   content in a second round.  Equal strings are settled within each chunk and task before they
   travel, so no task gets all occurrences of a common passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, text_rows

LENGTH = 50
GRAM = 16
HOT_TEXTS = 16_384          # a gram that occurs more often meets by content, not by gram
SHALLOW = 24                # bytes sorted by multikey quicksort before blind tries take over
BLOCK = 1 << 20             # bytes hashed at once
FLUSH_GRAMS = 1 << 21
SLICES = 4                  # of the gram space, for each reducer: evens them out
CHUNK_BYTES = (1 << 20, 64 << 20)   # bytes of text in a chunk, from and to, about
SORT_ROWS = 20_000
LAST_ID = (1 << 63) - 1     # a null id: behind every other

_A, _M, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(31)


def _words(data: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from each position as one number."""
    return np.ndarray((max(0, len(data) - 7),), f"{order}u8", data.tobytes(), strides=(1,)).astype(np.uint64)


def smallest_grams(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple]:
    """Blocks of (text, first window, last window, gram's place, gram's key), one per run of
    windows with the same smallest gram (the leftmost of equals); places count from the text's start."""
    width = length - GRAM + 1
    low = np.uint64(BLOCK * 2 - 1)
    block: list[tuple[int, int, bytes]] = []
    size = 0

    def hashed() -> tuple:
        data = np.frombuffer(b"".join(b for _, _, b in block) + bytes(8), np.uint8)
        n = len(data) - 8
        sizes = np.array([len(b) for _, _, b in block])
        begin = np.cumsum(sizes) - sizes
        part = _words(data, "<")
        grams = part[:n - GRAM + 1] * _A
        for at in range(8, GRAM, 8):
            grams ^= grams >> _S
            grams = (grams ^ part[at:at + len(grams)]) * _M
        grams ^= grams >> _S
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if width > step:
            rest = width - step
            least = np.minimum(least[:-rest], least[rest:])
        place = (least & low).astype(np.int64)              # of the smallest gram of window i
        inside = np.zeros(len(place) + 1, np.int8)
        inside[begin] += 1
        inside[begin + sizes - length + 1] -= 1
        inside = np.cumsum(inside[:-1]).astype(bool)
        change = np.r_[True, (place[1:] != place[:-1]) | ~inside[:-1]]
        first = np.nonzero(change & inside)[0]
        breaks = np.r_[np.nonzero(change | ~inside)[0], len(place)]
        last = breaks[np.searchsorted(breaks, first, "right")] - 1
        which = np.searchsorted(begin, first, "right") - 1
        shift = np.array([at for _, at, _ in block])[which] - begin[which]
        where = place[first]
        return np.array([t for t, _, _ in block])[which], first + shift, last + shift, where + shift, grams[where]

    for t, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), BLOCK - length):
            piece = text[at:at + BLOCK - 1]
            if len(piece) < length:
                break
            if size + len(piece) > BLOCK:
                yield hashed()
                block, size = [], 0
            block.append((t, at, piece))
            size += len(piece)
    if block:
        yield hashed()


ASK = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("ids", pa.binary()),
                 ("counts", pa.binary()), ("often", pa.binary()), ("times", pa.binary())])


def _ends(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which occurrences to send: of a gram with three or more in the chunk only those of the
    smallest and the largest id; and such grams with how many are left out."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.nonzero(np.r_[True, ordered[1:] != ordered[:-1]])[0]
    sizes = np.diff(np.r_[first, len(keys)])
    keep = np.ones(len(keys), bool)
    some = order[np.repeat(sizes > 2, sizes)]
    if len(some):
        some = some[np.lexsort((ids[some], keys[some]))]
        inner = np.r_[False, keys[some][1:] == keys[some][:-1]] & np.r_[keys[some][1:] == keys[some][:-1], False]
        keep[some[inner]] = False
    return keep, ordered[first[sizes > 2]], sizes[sizes > 2] - 2


def _ask_pass(parts: int, length: int):
    """(chunk, id, text) -> each chunk's grams by reducer, with the ids they stand under."""
    def slice_of(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)

    def rows(chunk: int, ids: list[np.ndarray], grams: list[np.ndarray]) -> pa.RecordBatch:
        own, keys = np.concatenate(ids), np.concatenate(grams)
        keep, often, times = _ends(keys, own)
        own, keys = own[keep], keys[keep]
        part = slice_of(keys)
        order = np.argsort(part, kind="stable")
        own, keys = own[order], keys[order]
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        more = np.searchsorted(slice_of(often), np.arange(parts + 1))
        out = []
        for p, (a, b, c, d) in enumerate(zip(cuts, cuts[1:], more, more[1:])):
            if a < b:
                runs = np.nonzero(np.r_[True, own[a + 1:b] != own[a:b - 1]])[0]
                out.append((p, chunk, keys[a:b].tobytes(), own[a:b][runs].tobytes(),
                            np.diff(np.r_[runs, b - a]).astype("<u4").tobytes(), often[c:d].tobytes(),
                            times[c:d].astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ASK)], schema=ASK)

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            chunks, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t.as_buffer().to_pybytes() for t in batch.column(2)]
            for which, _, _, _, grams in smallest_grams(texts, length):
                for chunk in np.unique(chunks[which]).tolist():
                    mine = chunks[which] == chunk
                    own = held.setdefault(chunk, ([], []))
                    own[0].append(ids[which[mine]])
                    own[1].append(grams[mine])
                size += len(grams)
                if size >= FLUSH_GRAMS:
                    for chunk, own in held.items():
                        yield rows(chunk, *own)
                    held, size = {}, 0
        for chunk, own in held.items():
            yield rows(chunk, *own)
    return run


SHARED = pa.schema([("chunk", pa.int64()), ("grams", pa.binary()), ("hot", pa.binary())])


def _shared_pass(hot: int):
    """One reducer's grams -> to each chunk those that stand under two ids, and which are hot."""
    def run(batches):
        asked: dict[int, list[np.ndarray]] = {}
        ids, often, times = [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                grams = np.frombuffer(r["grams"], "<u8")
                asked.setdefault(r["chunk"], []).append((grams, len(ids)))
                ids.append(np.repeat(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["counts"], "<u4")))
                often.append(np.frombuffer(r["often"], "<u8"))
                times.append(np.frombuffer(r["times"], "<u4"))
        if not ids:
            return
        blocks = sorted(((place, grams) for own in asked.values() for grams, place in own), key=lambda b: b[0])
        keys, own = np.concatenate([g for _, g in blocks]), np.concatenate(ids)
        order = np.argsort(keys)
        keys, own = keys[order], own[order]
        first = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
        shared = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
        total = np.diff(np.r_[first, len(keys)])
        np.add.at(total, np.searchsorted(keys[first], np.concatenate(often)), np.concatenate(times))
        many = (total > hot)[shared]
        keys = keys[first][shared]
        out = []
        for chunk, parts in asked.items():
            mine = np.unique(np.concatenate([g for g, _ in parts]))
            at = np.searchsorted(keys, mine)
            at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == mine)] if len(keys) else at[:0]
            if len(at):
                out.append((chunk, keys[at].tobytes(), many[at].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SHARED)], schema=SHARED)
    return run


CONTEXT = pa.schema([("key", pa.int64()), ("hot", pa.bool_()), ("chunk", pa.int64()), ("row_key", pa.int64()),
                     ("id", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("body", pa.binary())])
CONTEXT_DDL = "key long, hot boolean, chunk long, row_key long, id long, start long, windows long, body binary"
HELD_WINDOWS = 200_000


def _key(body: bytes) -> int:
    return xxhash.xxh64_intdigest(body) - (1 << 63)


def _settled(holders: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """(id, ...) of equal strings -> those of the smallest id, and the others: they go."""
    if len(holders) == 1:
        return holders, []
    least = min(h[0] for h in holders)
    return [h for h in holders if h[0] == least], [h for h in holders if h[0] > least]


def _context_pass(length: int):
    """A chunk's texts and shared grams -> contexts (body set) and windows already settled (no body)."""
    def run(texts: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(shared):
            return pd.DataFrame({c: [] for c in CONTEXT.names})
        keys = np.concatenate([np.frombuffer(g, "<u8") for g in shared["grams"]])
        hot = np.concatenate([np.frombuffer(h, bool) for h in shared["hot"]])
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        texts_, found, bodies = texts["text"].tolist(), [], []
        for which, first, last, _, grams in smallest_grams(texts_, length):
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = np.nonzero(keys[at] == grams)[0]
            found.append((which[hit], first[hit], last[hit] - first[hit] + 1, grams[hit].view(np.int64), hot[at[hit]]))
            bodies += [texts_[t][lo:hi] for t, lo, hi in
                       zip(which[hit].tolist(), first[hit].tolist(), (last[hit] + length).tolist())]
        if not bodies:
            return pd.DataFrame({c: [] for c in CONTEXT.names})
        which, start, count, key, many = (np.concatenate(c) for c in zip(*found))
        own, row = texts["id"].to_numpy()[which], texts["row_key"].to_numpy()[which]
        code = pa.array(bodies, pa.binary()).dictionary_encode().indices.to_numpy()
        least = np.full(int(code.max()) + 1, LAST_ID)
        np.minimum.at(least, code, own)
        go = own > least[code]                          # settled here: a smaller id of the chunk has it
        key = np.where(go, _spread(row, start), key)
        for i in np.nonzero(many & ~go)[0].tolist():
            key[i] = _key(bodies[i])
        body = np.array(bodies, object)
        body[go] = None
        return pd.DataFrame({"key": key, "hot": many & ~go, "chunk": int(texts["chunk"].iloc[0]), "row_key": row, "id": own,
                             "start": start, "windows": count, "body": body})
    return run


def _spread(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Any keys that spread rows evenly."""
    return ((row.astype(np.uint64) * _A + place.astype(np.uint64)) * _M).view(np.int64)


class BlindTrie:
    """Patricia trie over equally long strings: inner nodes branch on one byte and store only its
    position; an insertion walks down blindly, compares with one leaf, and branches there."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | None = None               # inner: [position, {byte: node}]; leaf: [-1, members]

    def insert(self, i: int) -> None:
        own = self.strings[i]
        if self.root is None:
            self.root = [-1, [i]]
            return
        node = self.root
        while node[0] >= 0:
            node = node[1].get(own[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        if own == other:
            node[1].append(i)
            return
        at = next(k for k, (x, y) in enumerate(zip(own, other)) if x != y)
        node, above = self.root, None
        while node[0] >= 0 and node[0] < at:
            above, node = node, node[1][own[node[0]]]
        if node[0] == at:
            node[1][own[at]] = [-1, [i]]
            return
        branch = [at, {own[at]: [-1, [i]], other[at]: node}]
        if above is None:
            self.root = branch
        else:
            above[1][own[above[0]]] = branch

    def groups(self) -> Iterator[list[int]]:
        """Members of equal strings, in the order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[1]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def multikey_sort(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` bytes (a multiple of 8), and where groups that
    agree in them begin.  Each round splits only the groups left by the last, on 8 bytes."""
    chars = _words(data, ">")
    order = np.argsort(chars[starts], kind="stable")
    values = chars[starts[order]]
    begins = np.r_[True, values[1:] != values[:-1]] if len(order) else np.empty(0, bool)
    for at in range(8, depth, 8):
        group = np.cumsum(begins)
        sizes = np.bincount(group)
        open_ = np.nonzero(sizes[group] > 1)[0]
        if not len(open_):
            break
        values = chars[starts[order[open_]] + at]
        again = np.lexsort((values, group[open_]))
        order[open_] = order[open_][again]
        values, own = values[again], group[open_]
        begins[open_] = np.r_[True, (values[1:] != values[:-1]) | (own[1:] != own[:-1])]
    return order, begins


def equal_windows(bodies: list[bytes], length: int, shallow: int = SHALLOW) -> Iterator[list[tuple[int, int]]]:
    """Groups of two or more equal ``length``-byte windows, as (body, place), by deep-shallow sorting."""
    sizes = np.array([len(b) for b in bodies])
    begin = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    which = np.repeat(np.arange(len(bodies)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    starts = begin[which] + place
    raw = b"".join(bodies) + bytes(8)
    shallow = min(shallow, length) // 8 * 8
    order, begins = multikey_sort(np.frombuffer(raw, np.uint8), starts, shallow)
    cuts = np.r_[np.nonzero(begins)[0], len(order)]
    for k in np.nonzero(np.diff(cuts) > 1)[0].tolist():
        members = order[cuts[k]:cuts[k + 1]].tolist()
        trie = BlindTrie([raw[starts[i] + shallow:starts[i] + length] for i in members])
        for i in range(len(members)):
            trie.insert(i)
        for group in trie.groups():
            if len(group) > 1:
                yield [(int(which[members[i]]), int(place[members[i]])) for i in group]


def _spans(chunk, row, own, start, windows) -> pa.RecordBatch:
    n = len(chunk)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, bool)), pa.array(chunk), pa.array(row), pa.array(own),
         pa.array(start), pa.array(windows), pa.nulls(n, pa.binary())], schema=CONTEXT)


def _meet(rows: pa.Table, length: int, windows: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
    """Contexts of complete keys -> spans that also start under a smaller id; of hot contexts what
    is left goes to ``windows``.

    Equal contexts have one code; of each code only the rows of its smallest id are left.  The
    windows of codes that share a gram are sorted, and equal ones go but for the smallest id.
    """
    key, hot, chunk, row, own, start, count = (rows.column(i).to_numpy() for i in range(7))
    coded = rows.column(7).combine_chunks().dictionary_encode()
    code, bodies = coded.indices.to_numpy(), coded.dictionary
    least = np.full(len(bodies), LAST_ID)
    np.minimum.at(least, code, own)
    go = own > least[code]
    yield _spans(chunk[go], row[go], own[go], start[go], count[go])
    left = np.nonzero(~go)[0]
    for i in left[hot[left]].tolist():
        body, holder = bodies[int(code[i])].as_py(), (int(own[i]), int(chunk[i]), int(row[i]))
        for j in range(int(count[i])):
            windows.setdefault(body[j:j + length], []).append((*holder, int(start[i]) + j))
    left = left[~hot[left]]
    codes, at = np.unique(code[left], return_index=True)        # codes and a row of each
    _, which, times = np.unique(key[left[at]], return_inverse=True, return_counts=True)
    several = codes[times[which] > 1]                           # codes that share their gram
    if not len(several):
        return
    number = np.full(len(bodies), -1)
    number[several] = np.arange(len(several))
    left = left[number[code[left]] >= 0]
    left = left[np.argsort(number[code[left]], kind="stable")]
    ends = np.searchsorted(number[code[left]], np.arange(len(several) + 1))
    low = least[several].tolist()
    gone, place = [], []
    for group in equal_windows(bodies.take(pa.array(several)).to_pylist(), length):
        first = min(low[b] for b, _ in group)
        for b, p in group:
            if low[b] > first:
                gone.append(b)
                place.append(p)
    if gone:
        gone, place = np.array(gone), np.array(place)
        held = np.diff(ends)[gone]
        at = left[np.repeat(ends[gone], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)]
        yield _spans(chunk[at], row[at], own[at], start[at] + np.repeat(place, held), np.ones(len(at), np.int64))


def _sort_pass(length: int):
    """Contexts sorted by key -> spans (no body), and for hot contexts that are left the windows
    that have to meet in the next round (body set)."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        windows: dict[bytes, list] = {}

        def drop_windows() -> Iterator[pa.RecordBatch]:
            out = []
            for body, holders in windows.items():
                stay, go = _settled(holders)
                out += [(0, False, chunk, row, own, start, 1, None) for own, chunk, row, start in go]
                out += [(_key(body), False, chunk, row, own, start, 1, body) for own, chunk, row, start in stay]
            windows.clear()
            for at in range(0, len(out), 100_000):
                some = out[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), CONTEXT)], schema=CONTEXT)

        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, schema=CONTEXT)
            known = batch.column(7).is_null()
            if known.true_count:                        # settled before: passed on
                yield batch.filter(known)
                batch = batch.filter(pc.invert(known))
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= SORT_ROWS:
                rows = pa.Table.from_batches(held)
                keys = rows.column(0).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1], "left"))
                if cut:
                    yield from _meet(rows.slice(0, cut), length, windows)
                    held = rows.slice(cut).to_batches()
                if len(windows) > HELD_WINDOWS:
                    yield from drop_windows()
        if held:
            yield from _meet(pa.Table.from_batches(held), length, windows)
        if windows:
            yield from drop_windows()
    return run


def covered(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows (start, how many)."""
    out: list[list[int]] = []
    for start, n in sorted(spans):
        end = start + n - 1 + length
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _cut_pass(length: int):
    def run(texts: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        by_row = {k: list(zip(g["start"].tolist(), g["windows"].tolist())) for k, g in spans.groupby("row_key")} \
            if len(spans) else {}
        out = []
        for key, text in zip(texts["row_key"], texts["text"]):
            runs = covered(by_row.get(key, []), length)
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            out.append((key, sum(b - a for a, b in runs), len(runs), digest.hexdigest(), runs))
        return pd.DataFrame(out, columns=["rep_key", "n_removed", "n_spans", "kept_sha256", "spans"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   hot: int = HOT_TEXTS) -> DataFrame:
    """row_key, doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row.

    ``spans`` are the removed runs [from, to) of bytes.  A null text is empty; texts shorter than
    ``length`` lose nothing.  Null ids come behind all others and never cause a removal among
    themselves, nor do rows with the same id.  Strings are judged on the input.
    """
    parts = partitions(docs.sparkSession)
    texts = text_rows(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary")).withColumn(
        "id", F.coalesce("doc_id", F.lit(LAST_ID)))
    texts = texts.withColumn("sha", F.unhex(F.sha2("text", 256)))
    rows = stored(texts.select("row_key", "doc_id", "id", F.length("text").cast("long").alias("n_bytes"), "sha"),
                  "repeat-rows")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    per_chunk = min(max(total // (4 * parts), CHUNK_BYTES[0]), CHUNK_BYTES[1])
    split = max(1, total // (parts * per_chunk))
    # one text of each kind, combined before the shuffle: the only time that all texts travel
    # for it, and copies never do
    firsts = texts.groupBy("sha").agg(F.min(F.struct("id", "row_key")).alias("first"), F.first("text").alias("text"))
    firsts = stored(firsts.select(
        "sha", F.col("first.id").alias("first_id"), F.col("first.row_key").alias("rep_key"), "text",
        # chunks are parts of the partitions written, so that a task that reads them meets few
        (F.spark_partition_id().cast("long") * split + F.pmod(F.xxhash64("first.row_key"), F.lit(split))).alias("chunk")),
        "repeat-texts")
    reps = firsts.where(F.length("text") >= length).select(
        F.col("rep_key").alias("row_key"), F.col("first_id").alias("id"), "text", "chunk")
    firsts = firsts.select("sha", "first_id", "rep_key")

    asked = reps.select("chunk", "id", "text").mapInArrow(
        _ask_pass(SLICES * parts, length), "part int, chunk long, grams binary, ids binary, counts binary, "
                                  "often binary, times binary")
    shared = stored(asked.repartition(parts, "part").mapInArrow(
        _shared_pass(hot), "chunk long, grams binary, hot binary"), "repeat-grams")
    contexts = reps.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(_context_pass(length), CONTEXT_DDL)

    def meet(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_sort_pass(length), CONTEXT_DDL)

    first = stored(meet(contexts), "repeat-spans")
    spans = first.where("body is null").unionAll(meet(first.where("body is not null"))).select(
        "chunk", "row_key", "start", "windows")
    cut = reps.select("chunk", "row_key", "text").groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInPandas(
        _cut_pass(length), "rep_key long, n_removed long, n_spans long, kept_sha256 string, "
                           "spans array<struct<`from`: long, `to`: long>>")
    whole = (F.col("id") > F.col("first_id")) & (F.col("n_bytes") >= length)
    nothing = F.sha2(F.lit(""), 256)
    return (rows.join(firsts, "sha").join(cut, "rep_key", "left")
            .select("row_key", "doc_id", "n_bytes",
                    F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                    F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                    F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha"))))
                    .alias("kept_sha256"),
                    F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_bytes").alias("to"))))
                    .otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<`from`: bigint, `to`: bigint>>)")))
                    .alias("spans")))
