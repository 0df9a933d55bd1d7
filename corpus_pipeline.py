"""A corpus pipeline of five stages over ``documents``: filter, deduplicate, clean, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. Stages are judged on their own input; null and empty
texts, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, packing, quality, simhash, suffix
from quarry.llm.queries import vocabulary
from quarry.llm.shared import documents, passing, staged


#: Bytes of a passage that counts as repeated: some fifty words.
REPEAT = 250


def _wrapped(docs: DataFrame) -> DataFrame:
    """``row`` (all columns) and ``text``: what an operator adds can't clash with columns of the documents."""
    return docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality by nearest neighbours: documents whose score is under 0.5 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    space = quality.train(docs, quality.known_labels(labels))
    return quality.predict(_wrapped(docs), space).where("predicted = 1").select("row.*")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language by compression: documents without a clear language go, by the operator's own margin."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.train(docs.where(~held & F.col("lang").isNotNull()))
    return langid.predict(_wrapped(docs), model).where("not rejected").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash groups: the row of the smallest id stays; rows without an id come after those with one."""
    return simhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix arrays: passages of ``REPEAT`` bytes or more that stand at an earlier place too are cut out, so
    that the first one stays; rows of which nothing is left go; n_chars follows the text."""
    cut = suffix.without_repeats(docs, REPEAT, keep_first=True, drop_empty=True)
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return cut.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the remaining documents' tokens to sequences of 2,048."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", one_of_each),
    ("repeats", without_repeats),
    ("packing", pack),
]

#: Trained scores and compression have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, from ``documents``. What a stage has staged goes once its result is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with passing():
            out = stage(spark, docs, sf_dir)
            docs = staged(out, name)
    return STAGES[-1][1](spark, docs, sf_dir)
