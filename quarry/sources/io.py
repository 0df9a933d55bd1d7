"""Scans and sinks: tables, trees of files, line formats, YAML documents, hashes and previews."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import language_of, matches_glob
from ..schemas import SCHEMAS, assert_schema

#: Directories of other people's code (fixed values).
VENDORED = ("venv", ".venv", "node_modules", "__pycache__", ".git", ".tox")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the warehouse, of the graph or the chunks; empty if nothing was written yet."""
    try:
        return assert_schema(spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}"), name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def append(df: DataFrame, root: str, name: str) -> None:
    assert_schema(df, name).select(*SCHEMAS[name].names).write.mode("append").parquet(f"{root}/{name}")


def replace_table(df: DataFrame, root: str, name: str) -> None:
    """Overwrite a table, which must not be read in the same plan."""
    assert_schema(df, name).select(*SCHEMAS[name].names).write.mode("overwrite").parquet(f"{root}/{name}")


def drop_and_recreate(spark: SparkSession, root: str, name: str) -> None:
    spark.createDataFrame([], SCHEMAS[name]).write.mode("overwrite").parquet(f"{root}/{name}")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Set-or-replace: the last value of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (key, order)]), order).alias("s")).select(key, "s.*")


def new_mappings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore."""
    keys = ["symbol_id", "chunk_id"]
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, vendored: bool = False) -> DataFrame:
    """``path`` (below the root), ``content, length, modified, language`` of the files that the globs take; with ``vendored``
    those of other people's code too, as the walk of an index has it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    base = root.split(":", 1)[-1].rstrip("/")
    rows = rows.select(F.substring(path, len(base) + 2, 1 << 30).alias("path"), "content", "length", F.col("modificationTime").alias("modified"))
    rows = rows if vendored else rows.where(~F.col("path").rlike("(^|/)(" + "|".join(v.replace(".", r"\.") for v in VENDORED) + ")/"))
    rows = rows.where(matches_glob(F.col("path"), include)) if include else rows
    rows = rows.where(~matches_glob(F.col("path"), exclude)) if exclude else rows
    return rows.withColumn("language", language_of(F.col("path")))


def languages(listing: DataFrame) -> DataFrame:
    """Which analyzers apply: a Go module file, a TypeScript configuration, any Python file."""
    has = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)).cast("boolean")
    p = F.col("path")
    return listing.agg(has(p == "go.mod").alias("go"), has(p == "tsconfig.json").alias("typescript"), has(p.endswith(".py")).alias("python"))


def ndjson(spark: SparkSession, path: str, schema: str, most: int = 1 << 20) -> DataFrame:
    """Records of lines of JSON; bad lines and those over ``most`` bytes are skipped."""
    rows = spark.read.text(path).where(F.octet_length("value") <= most)
    return rows.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def yaml_documents(listing: DataFrame, schema: str) -> DataFrame:
    """Documents of YAML files (``path, content``) as JSON text of their own, read with ``schema``; bad ones have null fields."""
    @F.pandas_udf("string")
    def to_json(s: pd.Series) -> pd.Series:
        import yaml

        def one(raw):
            try:
                return None if raw is None else json.dumps(yaml.safe_load(bytes(raw)), default=str)
            except yaml.YAMLError:
                return None

        return s.map(one)

    return listing.withColumn("r", F.from_json(to_json(F.col("content")), schema)).drop("content").select("*", "r.*").drop("r")


def yaml_listing(spark: SparkSession, root: str, schema: str = "title string, type string, target_module string") -> DataFrame:
    """``filename, size_bytes, mod_time`` (UTC) of the YAML files right in a folder, with fields of their documents (null where
    a file can't be read); no rows if there is no such folder."""
    head = "filename string, size_bytes long, mod_time string"
    try:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{head}, {schema}")
    name = F.element_at(F.split("path", "/"), -1)
    at = F.expr("date_format(to_utc_timestamp(modificationTime, current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    rows = rows.where(F.lower(name).rlike(r"\.ya?ml$")).select(name.alias("filename"), F.col("length").alias("size_bytes"), at.alias("mod_time"), "content")
    return yaml_documents(rows, schema)


def write_json(df: DataFrame, path: str) -> None:
    """Documents as JSON; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def tail_preview(listing: DataFrame, most: int) -> DataFrame:
    """The last ``most`` bytes of each file, what is not UTF-8 left out, and whether something was cut."""
    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return listing.select("path", text(F.substring("content", -most, most)).alias("preview"), "length", (F.col("length") > most).alias("cut"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, hash`` as saved; empty if there is no such file or it can't be read."""
    schema = "path string, hash string"
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("path is not null and hash is not null")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows


def save_file_hashes(hashes: DataFrame, path: str) -> None:
    hashes.select("path", "hash").write.mode("overwrite").json(path)


def responses(rows: DataFrame) -> DataFrame:
    """A row's fields as one JSON text, nulls left out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("response"))


def register_artifact(spark: SparkSession, root: str, artifact: dict, created_at: str) -> DataFrame:
    """Append a file to the table of artifacts, with its size; type and path are needed. Returns the row."""
    if not artifact.get("artifact_type") or not artifact.get("path"):
        raise ValueError("an artifact needs a type and a path")
    size = spark.read.format("binaryFile").load(artifact["path"]).agg(F.max("length")).first()[0]
    names = SCHEMAS["artifacts"].names
    row = {**dict.fromkeys(names), **artifact, "size_bytes": size, "created_at": created_at}
    out = spark.createDataFrame([tuple(row[n] for n in names)], SCHEMAS["artifacts"])
    append(out, root, "artifacts")
    return out
