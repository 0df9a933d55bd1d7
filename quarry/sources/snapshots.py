"""The chunk index as committed versions: chunks and file hashes change together, or not at all.

A version is a manifest, a small JSON file ``_manifests/<number>.json``: which folder
holds each bucket of chunks, and which the hashes. Chunks are dealt to buckets by their
file's path. An upsert writes new folders for the buckets it touches only, first the
chunks, then the hashes, and last puts the manifest in place by a rename that fails if
the number is taken. Whatever fails before leaves the version before readable, with its
hashes, so that the files concerned are taken up again; of two writers one gets a
``Conflict`` and may try again on the new version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMAS
from .scratch import file_system

#: Buckets of chunks, by a hash of the file's path.
BUCKETS = 64
HASHES = "path string, hash string"


class Conflict(RuntimeError):
    """Another writer has committed the version meanwhile."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    schema_version: str = ""
    dims: int = 0
    chunks: dict[str, str] = field(default_factory=dict)
    hashes: str | None = None


class Index:
    """An index below ``root``; ``dims`` is the length of its vectors, ``schema_version`` the version of its layout."""

    def __init__(self, spark: SparkSession, root: str, dims: int, schema_version: str = "1", buckets: int = BUCKETS):
        self.spark, self.root, self.dims, self.schema_version, self.buckets = spark, root.rstrip("/"), dims, schema_version, buckets
        self.schema = SCHEMAS["chunks"]

    # --- versions ---

    def versions(self) -> list[int]:
        at, fs = file_system(self.spark, f"{self.root}/_manifests")
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, by default the last one; the empty one if there is none."""
        found = self.versions()
        if not found and not number:
            return Version()
        n = found[-1] if number is None else number
        if n not in found:
            raise ValueError(f"there is no version {n}")
        text = self.spark.read.text(f"{self.root}/_manifests/{n}.json", wholetext=True).first()[0]
        return Version(**json.loads(text))

    def _commit(self, after: Version) -> Version:
        """Put a manifest in place under its number, which must be free."""
        jvm = self.spark._jvm
        text = json.dumps(after.__dict__, sort_keys=True)
        tmp, fs = file_system(self.spark, f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        target, _ = file_system(self.spark, f"{self.root}/_manifests/{after.number}.json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri() if tmp.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(fs.makeQualified(tmp), fs.makeQualified(target), none)
        except Py4JJavaError as e:
            fs.delete(tmp, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                raise Conflict(f"version {after.number} is there already") from None
            raise
        return after

    # --- reading ---

    def chunks(self, number: int | None = None) -> DataFrame:
        return self._chunks(self.version(number).chunks)

    def _chunks(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in sorted(folders.values())])

    def hashes(self, number: int | None = None, force: bool = False) -> DataFrame:
        """Recorded hashes that still hold: none by force, or after a change of the layout or of the vectors' length."""
        v = self.version(number)
        if force or not v.hashes or (v.schema_version, v.dims) != (self.schema_version, self.dims):
            return self.spark.createDataFrame([], HASHES)
        return self.spark.read.schema(HASHES).parquet(f"{self.root}/{v.hashes}")

    # --- writing ---

    def _bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("string")

    def _checked(self, chunks: DataFrame) -> DataFrame:
        """Fails, as it is written, at a chunk without id or path, or whose vector has another length."""
        ok = F.col("id").isNotNull() & F.col("file_path").isNotNull() & F.coalesce(F.size("embedding") == self.dims, F.lit(False))
        told = F.format_string(f"chunk %s: %s numbers in its vector, not {self.dims}", F.coalesce("id", F.lit("without id")), F.coalesce(F.size("embedding").cast("string"), F.lit("no")))
        rows = chunks.select(*self.schema.names)
        return rows.withColumn("id", F.when(ok, F.col("id")).otherwise(F.raise_error(told)))

    def upsert(self, chunks: DataFrame, hashes: DataFrame, stale: DataFrame | None = None) -> Version:
        """Commit ``chunks`` (an older one of the same id goes; of equal ids one stays) and the ``hashes`` (``path, hash``) of their files.

        ``stale``: files (``path``) whose chunks and hashes go first, such as changed and deleted ones.
        """
        before = self.version()
        if before.number and (before.schema_version, before.dims) != (self.schema_version, self.dims):
            before = Version(number=before.number)  # another layout: begin anew
        gone = None if stale is None else stale.select(F.col("path").alias("file_path")).where("file_path is not null").distinct()
        paths = chunks.select("file_path") if gone is None else chunks.select("file_path").unionByName(gone)
        touched = [r[0] for r in paths.select(self._bucket(F.col("file_path")).alias("b")).distinct().collect()]  # ``buckets`` at most
        held = self._chunks({b: f for b, f in before.chunks.items() if b in touched})
        kept = held.join(chunks.select("id"), "id", "left_anti")
        kept = kept if gone is None else kept.join(gone, "file_path", "left_anti")
        rows = kept.select(*self.schema.names).unionByName(self._checked(chunks.dropDuplicates(["id"])))
        number, name = before.number + 1, uuid.uuid4().hex
        folders = self.write_chunks(rows, f"data/chunks-{number}-{name}", touched)
        old = self._old_hashes(before, hashes, gone)
        place = self.write_hashes(old.unionByName(hashes.select("path", "hash").dropDuplicates(["path"])), f"data/hashes-{number}-{name}")
        return self._commit(Version(number, self.schema_version, self.dims, {b: f for b, f in before.chunks.items() if b not in touched} | folders, place))

    def purge(self, stale: DataFrame) -> Version:
        """Commit that the chunks and hashes of files (``path``) are gone."""
        none = self.spark.createDataFrame([], self.schema)
        return self.upsert(none, self.spark.createDataFrame([], HASHES), stale)

    def drop_and_recreate(self) -> Version:
        """Commit an empty index; older versions stay readable."""
        return self._commit(Version(self.version().number + 1, self.schema_version, self.dims))

    def _old_hashes(self, before: Version, hashes: DataFrame, gone: DataFrame | None) -> DataFrame:
        old = self.spark.read.schema(HASHES).parquet(f"{self.root}/{before.hashes}") if before.hashes else self.spark.createDataFrame([], HASHES)
        old = old.join(hashes.select("path"), "path", "left_anti")
        return old if gone is None else old.join(gone.select(F.col("file_path").alias("path")), "path", "left_anti")

    def write_chunks(self, rows: DataFrame, place: str, touched: list[str]) -> dict[str, str]:
        """Write buckets of chunks; the folder of each that has rows."""
        if not touched:
            return {}
        rows = rows.withColumn("bucket", self._bucket(F.col("file_path")))
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{place}")
        at, fs = file_system(self.spark, f"{self.root}/{place}")
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return {n.partition("=")[2]: f"{place}/{n}" for n in names if n.startswith("bucket=")}

    def write_hashes(self, hashes: DataFrame, place: str) -> str:
        hashes.write.parquet(f"{self.root}/{place}")
        return place

    def vacuum(self, keep: int = 2) -> list[int]:
        """Remove versions but the last ``keep``, and what only they refer to. Returns the numbers removed."""
        numbers = self.versions()
        dropped = numbers[:-keep] if keep else numbers
        held = [self.version(n) for n in numbers if n not in dropped]
        used = {f for v in held for f in [*v.chunks.values(), *([v.hashes] if v.hashes else [])]}
        for n in dropped:
            v = self.version(n)
            at, fs = file_system(self.spark, f"{self.root}/_manifests/{n}.json")
            fs.delete(at, False)  # first, so that no manifest names a folder that is gone
            for f in {*v.chunks.values(), *([v.hashes] if v.hashes else [])} - used:
                at, fs = file_system(self.spark, f"{self.root}/{f}")
                fs.delete(at, True)
        return dropped
