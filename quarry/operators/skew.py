"""Equi-joins whose keys may hold a third of all rows on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Joined rows of one key beyond which its rows are dealt to several tasks.
PAIRS = 1_000_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], deal: list[str], pairs: int = PAIRS) -> DataFrame:
    """Inner join on ``keys``. Of a key with more than ``pairs`` joined rows, the left rows are dealt by a hash of ``deal``
    to so many parts that each makes about ``pairs``, and the right rows go to all of them."""
    n = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)) for df, name in ((left, "_n"), (right, "_m"))]
    hot = n[0].join(n[1], keys).where(F.col("_n") * F.col("_m") > pairs)
    hot = hot.select(*keys, F.least(F.col("_n"), F.ceil(F.col("_n") * F.col("_m") / pairs)).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*deal), parts).cast("int")).drop("_parts")
    copied = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"]).drop("_part")
