"""Embedding near-duplicates by collision-counting projections.

Vectors are unit-scaled and projected on many random lines.  Over the sorted values of a line,
each query's window (its value plus and minus a width) holds the vectors it collides with; a
pair is verified by its exact cosine if it collides on at least ``least`` lines.  Width and
count follow from the wanted recall: the difference of a pair at the threshold, projected, is
about normal, so its collisions are binomial and ``least`` is the count that all but 1 - recall
of such pairs reach.

Equal vectors are one class.  Classes of a label are sorted along the first line and cut into
blocks of bounded size; every task counts collisions between two blocks.  Blocks further apart
on that line than any linked pair can be (Cauchy-Schwarz) never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored
from .components import connected_components, star_links

THRESHOLD = 0.93
LINES = 32
WIDTH = 1.5                 # of the windows, in standard deviations of a threshold pair
RECALL = 0.99999
BLOCK = 1024
SEED = 11


def lines(dim: int, n: int = LINES, seed: int = SEED) -> np.ndarray:
    """``n`` random unit directions in ``dim`` dimensions."""
    at = np.random.default_rng([seed, dim]).standard_normal((n, dim))
    return at / np.linalg.norm(at, axis=1, keepdims=True)


def reach(threshold: float) -> float:
    """The distance of two unit vectors with this cosine."""
    return math.sqrt(max(0.0, 2 - 2 * threshold))


def least_collisions(n: int = LINES, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with at least this probability."""
    p = math.erf(width / math.sqrt(2))
    missed = 0.0
    for k in range(n + 1):
        missed += math.comb(n, k) * p ** k * (1 - p) ** (n - k)
        if missed > 1 - recall:
            return k
    return n


def collisions(queries: np.ndarray, data: np.ndarray, half: float) -> np.ndarray:
    """Collision counts of each (query, datum) from projections (vectors x lines): on each line
    the data is sorted, and a query's window is a run of ranks."""
    counts = np.zeros((len(queries), len(data)), np.uint8)
    for q, d in zip(queries.T, data.T):
        order = np.argsort(d, kind="stable")
        rank = np.empty(len(d), np.uint16)
        rank[order] = np.arange(len(d), dtype=np.uint16)
        low = np.searchsorted(d[order], q - half, "left").astype(np.uint16)
        high = np.searchsorted(d[order], q + half, "right").astype(np.uint16)
        counts += (rank[None, :] - low[:, None]) < (high - low)[:, None]        # ranks below wrap round
    return counts


def linked_pairs(a: np.ndarray, b: np.ndarray, same: bool, threshold: float = THRESHOLD) -> tuple:
    """Index pairs of unit vectors with cosine >= threshold that pass the calibrated count."""
    at = lines(a.shape[1])
    half = WIDTH * reach(threshold) / math.sqrt(a.shape[1])
    i, j = np.nonzero(collisions(a @ at.T, b @ at.T, half) >= least_collisions())
    if same:
        i, j = i[i < j], j[i < j]
    keep = [np.einsum("ij,ij->i", a[i[k:k + 65536]], b[j[k:k + 65536]]) >= threshold
            for k in range(0, len(i), 65536)]
    keep = np.concatenate(keep) if keep else np.empty(0, bool)
    return i[keep], j[keep]


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _block_pass(block: int):
    """Classes sorted by (label, dim, along) -> the same with the block each belongs to."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        label, held, first = None, 0, 0
        for batch in batches:
            labels, dims, nodes = (batch.column(c).to_pylist() for c in ("label", "dim", "node"))
            out = []
            for own, node in zip(zip(labels, dims), nodes):
                if own != label or held == block:
                    label, held, first = own, 0, node
                held += 1
                out.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())],
                                             names=[*batch.schema.names, "block"])
    return run


def _compare_pass(threshold: float):
    """The members of two blocks -> links as stars (u, v) and each class's linked rows (u, links)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf["first"].iloc[0], pdf["second"].iloc[0]
        pdf = pdf.sort_values("node")
        a, b = pdf[pdf["block"] == first], pdf[pdf["block"] == second]
        i, j = linked_pairs(_unit(a["vec"]), _unit(b["vec"]), first == second, threshold)
        na, nb = a["node"].to_numpy(), b["node"].to_numpy()
        if first == second:
            links = np.bincount(i, b["n"].to_numpy()[j], len(a)) + np.bincount(j, a["n"].to_numpy()[i], len(a))
            u, v = star_links(na, i, j)
            nodes = na
        else:
            links = np.r_[np.bincount(i, b["n"].to_numpy()[j], len(a)), np.bincount(j, a["n"].to_numpy()[i], len(b))]
            u, v = star_links(np.r_[na, nb], i, j + len(a))
            nodes = np.r_[na, nb]
        some = links > 0
        return pd.DataFrame({"u": np.r_[u, nodes[some]], "v": pd.array([*v.tolist(), *[None] * int(some.sum())], "Int64"),
                             "links": np.r_[np.zeros(len(u)), links[some]].astype(np.int64)})
    return run


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                     threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """row_key, vec_id, n_links, component_id, kept of every row.

    Two rows link if their labels are equal and not null and the cosine of their vectors in
    double precision is at least ``threshold``; rows with equal vectors link.  Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors
    of different lengths.  component_id is the smallest vec_id reachable, null ids last; ``kept``
    is vec_id = component_id (two null ids count as equal).
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    rows = stored(vectors.select(F.monotonically_increasing_id().alias("row_key"),
                                 F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"),
                                 vec.alias("vec")), "vectors")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.where(F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0))
    low = F.min(F.struct(F.col("vec_id").isNull().alias("last"), "vec_id"))
    classes = stored(valid.groupBy("label", "vec").agg(F.min("row_key").alias("node"), F.count(F.lit(1)).alias("n"),
                                                       low.alias("low")), "vector-classes")
    dims = [r["dim"] for r in classes.select(F.size("vec").alias("dim")).distinct().collect()]
    if not dims:
        return rows.select("row_key", "vec_id", F.lit(0).cast("long").alias("n_links"),
                           F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def along(pdfs) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                pdf["dim"] = pdf["vec"].map(len)
                pdf["along"] = 0.0
                for dim, own in pdf.groupby("dim"):
                    pdf.loc[own.index, "along"] = _unit(own["vec"]) @ lines(dim)[0]
                yield pdf

    kind = dict(classes.dtypes)["label"]
    member = f"label {kind}, node long, n long, vec array<double>, dim int, along double"
    members = classes.select("label", "node", "n", "vec").mapInPandas(along, member)
    count = partitions(spark)
    members = stored(members.repartitionByRange(count, "label", "dim", "along")
                     .sortWithinPartitions("label", "dim", "along", "node")
                     .mapInArrow(_block_pass(block), member + ", block long"), "vector-blocks")
    blocks = members.groupBy("label", "dim", "block").agg(F.min("along").alias("lo"), F.max("along").alias("hi"))
    a, b, far = blocks.alias("a"), blocks.alias("b"), reach(threshold) + 1e-9
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim"))
                   & (F.col("a.block") <= F.col("b.block"))
                   & (F.col("a.lo") - F.col("b.hi") <= far) & (F.col("b.lo") - F.col("a.hi") <= far))
    sides = pairs.select(F.col("a.block").alias("first"), F.col("b.block").alias("second")).select(
        "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))
    found = stored(members.select("block", "node", "n", "vec").join(sides, "block").groupBy("first", "second")
                   .applyInPandas(_compare_pass(threshold), "u long, v long, links long"), "vector-links")
    roots = connected_components(found.where("v is not null").select("u", "v"))
    links = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = (classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
             .join(links, "node", "left"))
    # stored, so that the join's two sides are plain shuffles and a huge component can be split
    least = stored(named.groupBy("root").agg(F.min("low").alias("least")), "vector-groups")
    named = named.join(least, "root").select(
        "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.col("least.vec_id").alias("component_id"), F.lit(True).alias("linked"))
    # rows and classes meet by a hash of the vector, and by the vector itself
    key = F.xxhash64("label", "vec")
    out = (rows.withColumn("key", key).alias("r")
           .join(named.withColumn("key", key).alias("c"),
                 (F.col("r.key") == F.col("c.key")) & (F.col("r.label") == F.col("c.label"))
                 & (F.col("r.vec") == F.col("c.vec")), "left"))
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(F.col("r.row_key").alias("row_key"), "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
