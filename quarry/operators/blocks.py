"""Vectors in blocks: all pairs' products are taken block by block within tasks, and never become rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

#: Bytes of the vectors of one block of rows, and of one block of queries.
ROW_BYTES, QUERY_BYTES = 1 << 22, 1 << 18


def packed(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """``id, dim, x``: vectors of finite numbers as little-endian doubles; others are left out."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(id_).alias("id"), v.alias("v")).where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))

    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            raw = [flat[i:j].astype("<f8").tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends).astype(np.int32)), pa.array(raw, pa.binary())], names=["id", "dim", "x"])

    return rows.mapInArrow(run, StructType([StructField("id", rows.schema["id"].dataType), StructField("dim", IntegerType()), StructField("x", BinaryType())]))


def dealt(rows: DataFrame, n: int, name: str) -> DataFrame:
    """``dim, <name>, <name>s``: vectors of one length in ``n`` blocks, as arrays of structs (``id, x``)."""
    block = F.pmod(F.xxhash64("x", "id"), F.lit(n)).cast("int")
    return rows.withColumn(name, block).groupBy("dim", name).agg(F.collect_list(F.struct("id", "x")).alias(f"{name}s"))  # bounded by the dealing


def block_pairs(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries, rows``: every block of queries beside every block of rows of the same length; both as ``packed``."""
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    m = queries.count()
    blocks = [max(1, -(-count // max(1, size // (8 * dim)))) for count, size in ((n, ROW_BYTES), (m, QUERY_BYTES))]
    asked = dealt(queries, blocks[1], "query").select("dim", F.col("querys").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(blocks[0] - 1))).alias("row"))
    return asked.join(dealt(rows, blocks[0], "row"), ["dim", "row"]).select("dim", "queries", "rows")


def matrix(block: pa.StructArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(block.field("x").to_pylist()), "<f8").reshape(-1, dim)


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``q`` the places in ``x`` and the distances of its ``k`` nearest, ties by id.

    Squared distances come from one matrix product, which rounds; what lies within its error of the kth is taken
    along, and its distance worked out again from the differences.
    """
    size = (x * x).sum(1)
    about = size[None, :] - 2 * (q @ x.T)  # less the query's own square
    error = 1e-12 * (size.max(initial=0) + (q * q).sum(1) + 1)
    out = []
    for i, row in enumerate(about):
        cut = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
        near = np.flatnonzero(row <= cut + error[i])
        d = q[i] - x[near]
        d = np.sqrt((d * d).sum(1))
        best = np.lexsort((ids[near], d))[:k]
        out.append((near[best], d[best]))
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query, id, distance``: candidates for the ``k`` nearest rows of each query, ``k`` of every block at most."""
    kinds = {name: df.schema["id"].dataType for name, df in (("query", queries), ("id", rows))}
    ddl = ", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items()) + ", distance double"

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column(0)[i].as_py()
                asked, held = (b.column(c).slice(i, 1).flatten() for c in (1, 2))
                names = np.array(held.field("id").to_pylist())
                found = nearest(matrix(asked, dim), matrix(held, dim), names, k)
                sizes = [len(p) for p, _ in found]
                at = pa.array(np.concatenate([p for p, _ in found]).astype(np.int64))
                query = asked.field("id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([query, held.field("id").take(at), pa.array(np.concatenate([d for _, d in found]))], names=["query", "id", "distance"])

    return block_pairs(rows, queries).mapInArrow(run, ddl)
