"""SimHash near-duplicates: a self-join of the fingerprints' binary trie.

Fingerprints at most d bits apart agree on at least one of d + 1 fixed groups of bits, so each
distinct fingerprint goes to d + 1 subtrees, one per group of bits read first.  A subtree with
too many fingerprints is divided by the same argument over its remaining bits, which loses no
pair however the fingerprints lie.  In a subtree the trie is joined with itself: pairs of nodes
are walked together, differing bits add up, and a pair over the budget is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, text_rows
from .components import connected_components, star_links

SHINGLE = 4
MOST_BITS = 4
SEED = 42
SUBTREE = 4096                  # fingerprints in a subtree before it is divided again
LEAF_PAIRS = 4096               # node pairs up to this many fingerprint pairs are compared at once
_BLOCK = 1 << 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 text: majority of the bits of its shingles' XXH64 hashes."""
    words = data.lower().split()            # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n:].tolist()
    counts = np.zeros(2048, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in
                           zip(starts[at:at + _BLOCK], ends[at:at + _BLOCK])], np.uint64)
        lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048)
    bits = (counts.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(row_key, doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             names=["row_key", "doc_id", "fp"])
    return text_rows(docs, id_col, text_col).mapInArrow(run, "row_key long, doc_id long, fp long")


def _groups(bits: list[int], n: int) -> list[int]:
    """The given bit numbers cut into ``n`` runs, as masks."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def subtree_masks(budget: int) -> list[tuple[int, list[int]]]:
    """For each first group of bits its mask and the masks of its second level."""
    firsts = _groups(list(range(63, -1, -1)), budget + 1)
    return [(m, [m | s for s in _groups([b for b in range(63, -1, -1) if not m >> b & 1], budget + 1)])
            for m in firsts]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def trie_self_join(fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted distinct uint64 ``fps`` that differ in at most ``budget`` bits.

    A node is a run of the sorted fingerprints that share the bits read so far.
    """
    left, right = [], []
    stack = [(0, len(fps), 0, len(fps), 63, 0)]

    def children(lo: int, hi: int, bit: int) -> tuple:
        high = (int(fps[lo]) >> (bit + 1)) << (bit + 1) | 1 << bit
        mid = lo + int(np.searchsorted(fps[lo:hi], np.uint64(high)))
        return (lo, mid), (mid, hi)

    while stack:
        alo, ahi, blo, bhi, bit, off = stack.pop()
        if (ahi - alo) * (bhi - blo) <= LEAF_PAIRS or bit < 0:
            differ = np.bitwise_count(fps[alo:ahi, None] ^ fps[None, blo:bhi])
            i, j = np.nonzero(differ <= budget)
            i, j = i + alo, j + blo
            if alo == blo:
                i, j = i[i < j], j[i < j]
            left.append(i)
            right.append(j)
            continue
        a = children(alo, ahi, bit)
        b = a if alo == blo and ahi == bhi else children(blo, bhi, bit)
        pairs = [(a[0], b[0], 0), (a[1], b[1], 0), (a[0], b[1], 1)]
        if b is not a:
            pairs.append((a[1], b[0], 1))
        for (p, q), (r, s), more in pairs:
            if p < q and r < s and off + more <= budget:
                stack.append((p, q, r, s, bit - 1, off + more))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _stars(fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within a subtree as a star per component: every other member to its first."""
    return star_links(fps, *trie_self_join(fps, budget))


def _subtree_pass(budget: int):
    """Rows (tree, sub, prefix, fp) sorted by the first three -> links (u, v)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, label = [], None

        def links(parts: list) -> pa.RecordBatch:
            u, v = _stars(np.sort(np.concatenate(parts).view(np.uint64)), budget)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if not len(cols[0]):
                continue
            new = np.zeros(len(cols[0]), bool)
            for c in cols[:3]:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.nonzero(new)[0].tolist(), len(new)]
            for lo, hi in zip(cuts, cuts[1:]):
                if (own := tuple(int(c[lo]) for c in cols[:3])) != label:
                    if sum(map(len, held)) > 1:
                        yield links(held)
                    held, label = [], own
                held.append(cols[3][lo:hi].copy())
        if sum(map(len, held)) > 1:
            yield links(held)
    return run


def near_fingerprints(fps: DataFrame, budget: int = MOST_BITS, subtree: int = SUBTREE) -> DataFrame:
    """(u, v) links that connect the distinct fingerprints ``fps`` (fp) exactly as all pairs at
    most ``budget`` bits apart do; pairs already connected in a subtree may be left out."""
    masks = subtree_masks(budget)
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m, _ in masks]))
                      .alias("tree", "prefix"))
    sizes = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, ["tree", "prefix"])
    second = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in subs]) for _, subs in masks]),
                          F.col("tree") + 1)
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.col("prefix").alias("prefix")))
    divided = F.transform(second, lambda m, i: F.struct(i.alias("sub"), F.col("fp").bitwiseAND(m).alias("prefix")))
    rows = (rows.select("tree", "fp", F.explode(F.when(F.col("n") <= subtree, whole).otherwise(divided)).alias("s"))
            .select("tree", F.col("s.sub").alias("sub"), F.col("s.prefix").alias("prefix"), "fp"))
    n = partitions(fps.sparkSession)
    return (rows.repartition(n, "tree", "sub", "prefix").sortWithinPartitions("tree", "sub", "prefix")
            .mapInArrow(_subtree_pass(budget), "u long, v long"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   budget: int = MOST_BITS) -> DataFrame:
    """row_key, doc_id, fingerprint (16 hex digits), component_id, kept of every row.

    Words are lower-cased (A-Z); a text with fewer words than a shingle is one shingle; without
    words, null or empty, the fingerprint is zero and links like any other.  component_id is the
    smallest doc_id reachable by links; null ids come last (a group of null ids has null).
    ``kept`` holds for exactly one row of a component: the smallest id, then the smallest row_key.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))
    distinct = stored(rows.groupBy("fp").agg(low.alias("low")), "distinct-fingerprints")
    roots = connected_components(near_fingerprints(distinct.select("fp"), budget))
    member = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    # stored, so that the join's two sides are plain shuffles and a huge component can be split
    least = stored(member.groupBy("root").agg(F.min("low").alias("first")), "simhash-groups")
    member = member.join(least, "root").select("fp", "first")
    return rows.join(member, "fp").select(
        "row_key", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"), (F.col("row_key") == F.col("first.row_key")).alias("kept"))
