"""Running sums and numbers across tasks: a group that holds all rows is scanned by as many tasks as any other.

Rows are dealt to ranges of group and order and written. Each range sums up its part of
each group; the sums of the ranges before it, few numbers, are what the range's own
running sums start from. With a budget, ranges that start beyond it are left out before
any of their rows moves again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def _columns(names: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def scanned(rows: DataFrame, group: list, order: list, values: dict[str, Column], below: dict[str, int] | None = None) -> DataFrame:
    """``rows`` with ``before_<name>`` for each of ``values``: its sum over the rows before, of the same group, by ``order``
    (ascending, nulls first). Rows of equal order come in any order, but one.

    ``below``: only rows whose sum before lies below a bound; values must not be negative then.
    """
    keys, at = _columns(group), _columns(order)
    held = rows.select(F.struct(*rows.columns).alias("row"), F.struct(F.lit(0).alias("_"), *[k.alias(f"g{i}") for i, k in enumerate(keys)]).alias("g"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(at)]).alias("o"), *[v.alias(f"v_{n}") for n, v in values.items()])
    held = written(held.repartitionByRange("g", "o").withColumn("part", F.spark_partition_id()), "ranges")
    sums = held.groupBy("part", "g").agg(*[F.sum(f"v_{n}").alias(f"s_{n}") for n in values])
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sums.select("part", "g", *[F.coalesce(F.sum(f"s_{n}").over(earlier), F.lit(0)).alias(f"start_{n}") for n in values])
    for n, most in (below or {}).items():
        starts = starts.where(F.col(f"start_{n}") < most)
    own = Window.partitionBy("part", "g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(starts, ["part", "g"]).select("row", *[(F.col(f"start_{n}") + F.coalesce(F.sum(f"v_{n}").over(own), F.lit(0))).alias(f"before_{n}") for n in values])
    for n, most in (below or {}).items():
        out = out.where(F.col(f"before_{n}") < most)
    return out.select("row.*", *[f"before_{n}" for n in values])


def row_numbers(rows: DataFrame, group: list, order: list, name: str = "rn") -> DataFrame:
    """``rows`` with their number in the group, from 1."""
    return scanned(rows, group, order, {name: F.lit(1)}).withColumn(name, (F.col(f"before_{name}") + 1).cast("long")).drop(f"before_{name}")


def trailing(rows: DataFrame, group: list, order: list, n: int, aggregate: Column, name: str, block: int = 100_000) -> DataFrame:
    """``rows`` with ``aggregate`` over each row and the ``n - 1`` before it, of the same group.

    Rows go to blocks of their group by number; the last ``n - 1`` of a block go to the next one too.
    """
    held = [F.struct(F.lit(0).alias("_"), *[k.alias(f"g{i}") for i, k in enumerate(_columns(group))]).alias("_g")]
    numbered = row_numbers(rows, group, order, "_rn").select("*", *held)
    at = ((F.col("_rn") - 1) / block).cast("long")
    halo = (F.col("_rn") - 1) % block >= block - (n - 1)
    blocks = F.explode(F.when(halo, F.array(at, at + 1)).otherwise(F.array(at))).alias("_block")
    dealt = numbered.select("*", blocks, at.alias("_own"))
    near = Window.partitionBy("_g", "_block").orderBy("_rn").rowsBetween(-(n - 1), 0)
    return dealt.withColumn(name, aggregate.over(near)).where(F.col("_block") == F.col("_own")).drop("_rn", "_g", "_block", "_own")
