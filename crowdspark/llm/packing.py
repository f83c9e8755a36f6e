"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Pieces are dealt by hash into groups of a bounded number; each group starts from a best-fit
placement and then empties its worst bins: documents move, swap one for one or two for one
between underfull bins whenever that raises the sum of squared fills, until the volume's bound
is met or no exchange helps.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Memory
from .common import stored, text_rows

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
GROUP_PIECES = 16_384
CACHE_BYTES = 256 << 20        # of chunks whose ids a worker remembers at a time


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    blank-separated chunks in order (tests hold this against encoding whole texts).  A chunk of
    Latin letters, with or without a comma or full stop behind it, is what the tokenizer's model
    makes of the lower-cased word; the other chunks are encoded together, set apart by a mark
    whose ids no other chunk can contain: it is one private-use character, and its ids spell
    exactly its bytes.
    """

    MARK = "\ue000"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memory = Memory(CACHE_BYTES)
        self.known: dict[bytes, bytes] = self.memory.known
        self.mark = self._ids([self.MARK])[0]
        self.stops = {c: self._ids([c])[0].tobytes() for c in (",", ".")}
        # bytes stand in the model's vocabulary as characters: the printable ones of Latin-1 as
        # themselves, the others from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        hidden = [b for b in range(256) if b not in shown]
        self.bytes_as = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        probe = ["word", "Straße", "ÉTÉ", "àÿþ"]
        self.direct = [i.tobytes() for i in self._ids(probe)] == [self._word(w.lower()) for w in probe]
        self.odd = (self.MARK.encode(), b"<|")          # encoded alone: the mark itself, special tokens

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of one lower-case word by the model alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.bytes_as)
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, chunks: list[bytes]) -> None:
        alone = [c for c in chunks if any(o in c for o in self.odd)]
        for chunk, ids in zip(alone, self._ids([c.decode() for c in alone])):
            self.known[chunk] = ids.tobytes()
        if alone:
            skip = set(alone)
            chunks = [c for c in chunks if c not in skip]
        ids = self._ids([f" {self.MARK} ".join([*(c.decode() for c in chunks), ""])])[0]
        width = len(self.mark)
        ends = np.ones(max(0, len(ids) - width + 1), bool)
        for i, own in enumerate(self.mark):
            ends &= ids[i:len(ids) - width + 1 + i] == own
        ends = (4 * np.nonzero(ends)[0]).tolist()
        raw, at = ids.tobytes(), 0
        if len(ends) != len(chunks):
            raise ValueError("the tokenizer does not set the mark apart")
        for chunk, end in zip(chunks, ends):
            self.known[chunk] = raw[at:end]
            at = end + 4 * width

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [t.encode().split() for t in texts]     # bytes: ASCII blanks only
        known = self.known
        new = self.memory.unknown(set().union(*split))
        others: list[bytes] = []
        for chunk in new:
            word, tail = chunk.decode(), b""
            if word[-1] in self.stops:
                word, tail = word[:-1], self.stops[word[-1]]
            # letters of Latin-1: composed already, and lower-cased one by one
            if not (self.direct and word.isalpha() and (word.isascii() or max(word) < "\u0100")):
                others.append(chunk)
                continue
            word = word.lower()
            key = word.encode()
            ids = known.get(key)
            if ids is None:
                ids = known[key] = self._word(word)
            known[chunk] = ids + tail
        for at in range(0, len(others), 4096):
            self._learn(others[at:at + 4096])
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process, so that what it has learned serves its later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _runs(texts: list[str], most: int = 1 << 20):
    """Consecutive texts of about ``most`` characters together."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """row_key, doc_id, piece, start, length, ids_crc32 (and ids): a document's token ids and the
    end id, cut every ``capacity`` ids.  A null or empty text is the end id alone."""
    path = tokenizer or tokenizer_path()
    schema = "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        encode, end = encoder(path), END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            keys, doc_ids, texts = (c.to_pylist() for c in batch.columns)
            for lo, hi in _runs(texts):
                for key, doc_id, raw in zip(keys[lo:hi], doc_ids[lo:hi], encode.batch(texts[lo:hi])):
                    raw += end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at:at + 4 * capacity]
                        out.append((key, doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part),
                                    np.frombuffer(part, "<u4") if with_ids else None))
            cols = list(zip(*out)) or [()] * 7
            arrays = [pa.array(c, t) for c, t in zip(cols[:6], [pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                                                               pa.int64(), pa.int64()])]
            names = ["row_key", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int64) for p in cols[6]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return text_rows(docs, id_col, text_col).mapInArrow(run, schema + (", ids array<long>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []            # (room left, bin), sorted
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            room, b = gaps.pop(at)
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        if room > size:
            insort(gaps, (room - size, b))
    return bins


def _view(size: np.ndarray, bin_of: np.ndarray, use: np.ndarray) -> tuple:
    """The bins to ``use`` as _exchange looks at them: items by bin and size, the bins, and the
    pairs that lie side by side in a bin."""
    items = np.nonzero(use[bin_of])[0]
    items = items[np.lexsort((size[items], bin_of[items]))]
    where = bin_of[items]
    same = where[1:] == where[:-1]
    first, second = items[:-1][same], items[1:][same]
    return (items, size[items], where, where[np.r_[True, ~same]] if len(where) else where,
            first, second, size[first] + size[second], bin_of[first])


def _exchange(size: np.ndarray, fill: np.ndarray, view: tuple, mine: list[int], low: int,
              capacity: int) -> tuple | None:
    """The exchange that takes volume out of bin ``low``, which holds ``mine``, into one of the
    ``view``'s bins: (volume, items out, items back, bin), or None.  Kinds are tried in order: a
    move; one for one and two for one; one for two; of the first with a gain the best.

    Volume d goes from ``low`` to a bin y with at least d of room; with fill(y) + d > fill(low)
    the sum of squared fills grows by 2 d (fill(y) + d - fill(low)).
    """
    items, sizes, where, bins, first, second, pairs, pair_bins = view
    mine = sorted(mine, key=lambda i: (-size[i], i))
    volume = [int(size[i]) for i in mine]

    def limits(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        room = np.where(y == low, -1, capacity - fill[y])
        return np.maximum(fill[low] - fill[y], 0), room

    above, room = limits(bins)
    for a, d in zip(mine, volume):                              # move a to the tightest bin
        ok = np.nonzero((d > above) & (d <= room))[0]
        if len(ok):
            return d, [a], [], int(bins[ok[np.argmin(room[ok])]])
    best, move = 0, None

    def swap(out: list[int], volume: int, others: np.ndarray, above: np.ndarray, room: np.ndarray) -> int:
        """Where the most volume goes out against one of ``others``, -1 if not more than the best."""
        nonlocal best
        d = volume - others
        gain = np.where((d > above) & (d <= room), d, 0)
        k = int(np.argmax(gain)) if len(gain) else -1
        if k < 0 or gain[k] <= best:
            return -1
        best = int(gain[k])
        return k

    above, room = limits(where)
    tried: set[int] = set()                                     # equal volumes have equal exchanges
    for i, a in enumerate(mine):                                # swap a for a shorter b
        if volume[i] not in tried:
            tried.add(volume[i])
            if (k := swap([a], volume[i], sizes, above, room)) >= 0:
                move = [a], [int(items[k])], int(where[k])
    for i, a in enumerate(mine):                                # a pair for one b
        for j in range(i + 1, len(mine)):
            if (both := volume[i] + volume[j]) not in tried:
                tried.add(both)
                if (k := swap([a, mine[j]], both, sizes, above, room)) >= 0:
                    move = [a, mine[j]], [int(items[k])], int(where[k])
    if move is None:
        above, room = limits(pair_bins)
        tried = set()
        for i, a in enumerate(mine):                            # a for a pair that lies side by side in y
            if volume[i] not in tried:
                tried.add(volume[i])
                if (k := swap([a], volume[i], pairs, above, room)) >= 0:
                    move = [a], [int(first[k]), int(second[k])], int(pair_bins[k])
    return None if move is None else (best, *move)


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> np.ndarray:
    """The bin of each item after emptying underfull bins, the least full first.

    Every exchange raises the sum of squared fills, so the search ends by itself: when no bin has
    an exchange left, or at the volume's bound.  A bin without one is looked at again only
    against the bins that have changed since, and so is every bin that holds the same lengths.
    """
    size = np.asarray(lengths, np.int64)
    bin_of = np.empty(len(size), np.int64)
    for b, items in enumerate(bins):
        bin_of[items] = b
    held = [set(items) for items in bins]
    fill = np.bincount(bin_of, size, len(bins)).astype(np.int64)
    least, in_use = -(-int(size.sum()) // capacity), int((fill > 0).sum())
    now, changed = 0, np.zeros(len(bins), np.int64)     # exchanges made, and at which a bin changed
    seen: dict[tuple, int] = {}                         # lengths in a bin: when they had no exchange
    done = np.zeros(len(bins), bool)                    # looked at in this round
    view, viewed, round_from = None, -1, 0
    while in_use > least:
        underfull = (fill > 0) & (fill < capacity)
        todo = np.nonzero(underfull & ~done)[0]
        if not len(todo):
            if now == round_from:
                break
            done[:], round_from = False, now
            continue
        low = int(todo[np.argmin(fill[todo])])
        lengths_in = tuple(sorted(size[list(held[low])].tolist()))
        since = seen.get(lengths_in, -1)
        if since < changed[low]:                        # its like were not compared with it
            since = -1
        found = None
        if since < 0:
            if viewed != now:
                view, viewed = _view(size, bin_of, underfull), now
            found = _exchange(size, fill, view, held[low], low, capacity)
        elif (fresh := underfull & (changed > since)).any():
            found = _exchange(size, fill, _view(size, bin_of, fresh), held[low], low, capacity)
        if found is None:
            seen[lengths_in] = now
            done[low] = True
            continue
        volume, out, back, y = found
        bin_of[out], bin_of[back] = y, low
        held[low].difference_update(out)
        held[low].update(back)
        held[y].difference_update(back)
        held[y].update(out)
        fill[y] += volume
        fill[low] -= volume
        in_use -= fill[low] == 0
        now += 1
        changed[[low, y]] = now
        done[[low, y]] = False
    return bin_of


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each piece; a full piece is a bin of its own."""
    lengths = np.asarray(lengths, np.int64)
    out = np.empty(len(lengths), np.int64)
    full = lengths >= capacity
    out[full] = np.arange(int(full.sum()))
    rest = np.nonzero(~full)[0]
    if len(rest):
        own = lengths[rest]
        out[rest] = int(full.sum()) + local_search(own, best_fit(own, capacity), capacity)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   tokenizer: str | None = None, with_ids: bool = False,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """row_key, doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset per piece.

    Only documents longer than ``capacity`` are cut.  Pieces of a sequence lie end to end from
    offset 0.  Repeated rows are packed once each; null ids are packed like others; an empty
    table gives no rows.
    """
    pieces = stored(token_pieces(docs, id_col, text_col, capacity, tokenizer, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    names = [f.name for f in pieces.schema]
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row_key", "piece"), F.lit(groups)))
    schema = ("group long, row_key long, piece int, sequence_id long, offset long")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_key", "piece"], ignore_index=True)
        seq = pack_group(pdf["length"].to_numpy(), capacity)
        order = np.lexsort((np.arange(len(seq)), seq))
        run = np.cumsum(pdf["length"].to_numpy()[order])
        first = np.r_[True, seq[order][1:] != seq[order][:-1]]
        begin = run - pdf["length"].to_numpy()[order]
        offset = np.empty(len(seq), np.int64)
        offset[order] = begin - np.maximum.accumulate(np.where(first, begin, 0))
        group = pdf["group"].to_numpy()
        return pd.DataFrame({"group": group, "row_key": pdf["row_key"], "piece": pdf["piece"],
                             "sequence_id": (group << 32) + seq, "offset": offset})

    placed = dealt.select("group", "row_key", "piece", "length").groupBy("group").applyInPandas(pack, schema)
    return (pieces.join(placed.drop("group"), ["row_key", "piece"])
            .select(*names, "sequence_id", "offset"))
