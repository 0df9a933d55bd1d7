"""Groups of linked rows: bounded units of candidates, and connected components.

A bucket holds rows that may link. A bucket of many rows is cut to blocks, and
every pair of blocks is a unit of its own, so that no task holds more than two
blocks; a unit returns at most one edge a row (a spanning forest), never all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each of ``n`` nodes' component under links ``a[i] - b[i]``."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def in_units(keyed: DataFrame, keys: list[str], row_id: str, block: int, singles: bool = True) -> DataFrame:
    """Deal the rows of ``keyed`` (any columns, ``keys`` and ``row_id``) to units.

    Adds ``unit_a, unit_b`` (blocks, ``unit_a <= unit_b``) and ``own`` (this row's
    block). Without ``singles``, buckets of one row are left out: nothing links there.
    Otherwise only buckets beyond a block are looked up, which are few.
    """
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("bucket_n")).where(F.col("bucket_n") > (block if singles else 1))
    rows = keyed.join(sizes, keys, "left" if singles else "inner")
    rows = rows.withColumn("blocks", F.ceil(F.coalesce("bucket_n", F.lit(1)) / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(row_id, F.lit("block")), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("*", other)
    least, most = F.least("own", "other"), F.greatest("own", "other")
    return rows.withColumns({"unit_a": least, "unit_b": most}).drop("other", "blocks", "bucket_n")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` of every node of ``edges`` (``a``, ``b``: long): the least node reachable.

    Alternates large-star and small-star steps, which keep connectivity and end as
    stars around the least nodes; each round is written to the shared folder. Minima
    are aggregated before rows meet; what joins them still meets by node, so that the
    links of a hub are joined in one task (unless Spark splits the join).
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = staged(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(edges.select("b", "b").distinct())
