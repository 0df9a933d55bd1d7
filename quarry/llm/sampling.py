"""Bounded, deterministic samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of a label that are learned, the most frequent ones.
VALUES = 200


def stratified(rows: DataFrame, by: str, most: int, key: str = "doc_id", values: int = VALUES) -> DataFrame:
    """``most`` rows at most for each value of ``by`` (all, where there are fewer), and one a ``key``.

    A hash of ``key`` chooses. Its bound follows from a value's count, so that about ``most`` rows pass;
    they are counted out by the hash. Of rows that share a key and a value the least stays. Nulls of ``by``
    or ``key`` are left out, and so are all but the ``values`` most frequent values.
    """
    rows = rows.where(F.col(by).isNotNull() & F.col(key).isNotNull())
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(values).collect()
    if not counts:
        return rows.limit(0)
    grain = 1_000_000_007
    bound = F.lit(0)
    for r in counts:
        bound = F.when(F.col(by) == r[by], int(grain * min(1.0, most / r["n"])) + 1).otherwise(bound)
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(grain))
    others = [c for c in rows.columns if c not in (by, key)]
    rows = rows.where(place < bound).groupBy(by, key).agg(*[F.min(c).alias(c) for c in others], F.count(F.lit(1)).alias("_times"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(place, key))  # of about ``most`` rows
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth", "_times")


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``doc_id, label, text`` of the chosen ids; of documents that share an id the least text."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # a sample of each label
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
