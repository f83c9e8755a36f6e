"""Hierarchical weighted hash tree: region, rack and shard chosen by weighted hash draws.

At each level every child c of the chosen node draws ``-ln(u(c)) / weight(c)`` with u a hash of
the row's id and c; the smallest draw wins.  A child wins in proportion to its weight, and a
changed weight moves only rows into or out of the child it belongs to, so movement is confined
to the subtrees whose weights changed.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored, text_rows

REGIONS, RACKS, SHARDS = 5, 2, 4        # the installed tree: 40 shards of weight 1
ROW_BYTES = 16
SEED = 7

Tree = dict[str, list[tuple[str, float]]]


def shard_tree(shards: int, weights: dict[int, float] | None = None) -> Tree:
    """Children and weights of each inner node for ``shards`` shards.

    Shards fill the installed regions and racks in order.  Each shard beyond the installed ones
    is a region of its own, so that it takes rows only into itself: no other subtree's weight
    changes.  ``weights`` overrides the weight 1 of single shards; inner nodes weigh their sum.
    """
    tree: Tree = {}
    total: dict[str, float] = {}
    for shard in range(shards):
        if shard < REGIONS * RACKS * SHARDS:
            region = f"r{shard // (RACKS * SHARDS)}"
            rack = f"{region}.{shard // SHARDS % RACKS}"
        else:
            region = f"x{shard}"
            rack = f"{region}.0"
        weight = float((weights or {}).get(shard, 1.0))
        tree.setdefault(rack, []).append((str(shard), weight))
        for node, parent in ((region, "root"), (rack, region)):
            if node not in total:
                tree.setdefault(parent, []).append((node, 0.0))
            total[node] = total.get(node, 0.0) + weight
    return {parent: [(child, total.get(child, weight)) for child, weight in children]
            for parent, children in tree.items()}


def _winner(key: Column, node: Column | None, tree: Tree) -> Column:
    """The child of ``node`` (the root if None) with the smallest weighted draw."""
    def children(of: list[tuple[str, float]]) -> Column:
        return F.array(*[F.struct(F.lit(c).alias("id"), F.lit(w).alias("w")) for c, w in of if w > 0])

    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, child["id"], F.lit(SEED)), 11)
        unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(unit) / child["w"]).alias("draw"), child["id"].alias("id"))

    if node is None:
        among = children(tree["root"])
    else:
        parents = [p for p in tree if p != "root"]
        among = F.element_at(F.create_map(*[x for p in parents for x in (F.lit(p), children(tree[p]))]), node)
    return F.array_min(F.transform(among, draw))["id"]


def assign(df: DataFrame, key: str, out: str, tree: Tree) -> DataFrame:
    """Add ``out``: the shard of each row, by descending region, rack and shard."""
    inner: dict[int, Tree] = {1: {}, 2: {}}
    for region, _ in tree["root"]:
        inner[1][region] = tree[region]
        for rack, _ in tree[region]:
            inner[2][rack] = tree[rack]
    return (df.withColumn("_region", _winner(F.col(key), None, tree))
            .withColumn("_rack", _winner(F.col(key), F.col("_region"), inner[1]))
            .withColumn(out, _winner(F.col(key), F.col("_rack"), inner[2]).cast("int"))
            .drop("_region", "_rack"))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                    weights: dict[int, float] | None = None) -> DataFrame:
    """row_key, doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Law ``key``: the id and the shard count decide.  Rows with the same id, null included,
    share a shard.  ``slot`` numbers the rows of a shard from 0 without gaps: rows are numbered
    within (shard, chunk), a chunk being one input partition, and chunk counts are summed up
    before them, so no task ever sorts a whole shard.  Empty tables give no rows.
    """
    grown = dict(weights) if weights else None
    rows = text_rows(docs, id_col, text_col).select(
        "row_key", "doc_id", F.spark_partition_id().alias("chunk"),
        (F.octet_length("text") + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    rows = assign(rows, "doc_id", "shard", shard_tree(shards, weights))
    rows = assign(rows, "doc_id", "grown_shard", shard_tree(shards + 1, grown))
    rows = stored(rows, "shards")
    before = (rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("base", F.coalesce(F.sum("n").over(
                  Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0)))
              .select("shard", "chunk", "base"))
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row_key"))
    return (rows.withColumn("_n", within.cast("long")).join(before, ["shard", "chunk"])
            .select("row_key", "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("base") + F.col("_n") - 1).alias("slot"), "grown_shard"))
