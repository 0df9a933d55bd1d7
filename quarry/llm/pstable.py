"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected to Gaussian directions and quantised; ``HASHES``
quantised projections and the label make a key, in each of ``TABLES`` tables.
Vectors at cosine 0.98 (0.2 apart) share a key of some table with a probability
over 0.9999, nearer ones sooner; vectors that share one are compared by exact
cosine in double precision. Equal vectors with equal labels are collapsed first.
A pair that meets in several tables counts in the first one only.

Defined results: null vectors, zero vectors, those with null or non-finite
components and those whose label is null link with nothing (one row, no links, a
component of their own); vectors of different length never link; rows with a null
``vec_id`` are returned without component, not kept and without links; rows that
repeat an id are vectors of their own that share its name, told apart by a number of
each distinct vector; very long vectors are compared whole; an empty table gives no
rows; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import components, forest, in_units
from .shared import small_batches, staged, widened

#: Tables, hashes a key, and the width of a quantised step (in units of the unit sphere).
TABLES, HASHES, WIDTH = 32, 12, 1.6
SEED = 17


def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, TABLES * HASHES)), rng.uniform(0, WIDTH, TABLES * HASHES)


def table_keys(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A 64-bit key of each vector for each table."""
    a, shift = projections(unit.shape[1])
    step = np.floor((unit @ a + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, HASHES)
    key = (label.astype(np.int64).view(np.uint64)[:, None] * np.uint64(1000003) + np.uint64(unit.shape[1])) * np.ones((1, TABLES), np.uint64)
    for h in range(HASHES):
        key = (key ^ step[:, :, h]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _links(group: np.ndarray, cross: np.ndarray, own: np.ndarray, table: np.ndarray, label: np.ndarray, keys: np.ndarray, unit: np.ndarray, least: float):
    """``i, j`` of the links between rows of one group, each in the first table that they share."""
    found = []
    bounds = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(bounds, len(group)))
    for start, n in zip(bounds[size > 32].tolist(), size[size > 32].tolist()):  # large groups: one product each
        x = unit[start : start + n]
        i, j = np.nonzero(np.triu(x @ x.T >= least - 1e-9, 1))
        found.append((i + start, j + start))
    small = np.repeat(size <= 32, size)
    i, d = np.flatnonzero(small), 1
    while len(i):
        i = i[i + d < len(group)]
        i = i[group[i] == group[i + d]]
        found.append((i, i + d))
        d += 1
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    keep = (label[i] == label[j]) & ~(cross[i] & (own[i] == own[j]))
    i, j = i[keep], j[keep]
    parts = []
    for at in range(0, len(i), 20_000):
        a, b = i[at : at + 20_000], j[at : at + 20_000]
        earlier = ((keys[a] == keys[b]) & (np.arange(TABLES)[None, :] < table[a][:, None])).any(1)
        a, b = a[~earlier], b[~earlier]
        ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
        parts.append((a[ok], b[ok]))
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))


def near_duplicates(vectors: DataFrame, least: float = 0.98, block: int = 512) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    own = rows.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"))

    def normal(b: pa.RecordBatch, k: int):
        """Row numbers and unit vectors, by length."""
        lists = b.column(k)
        sizes = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten())
        at = np.append(0, np.cumsum(sizes))
        for dim in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dim)
            x = flat[at[own][:, None] + np.arange(dim)]
            x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
            yield own, x / np.sqrt((x * x).sum(1, keepdims=True))

    def keyed(batches):
        for b in batches:
            label, keys = np.asarray(b.column(0)), np.empty((b.num_rows, TABLES), np.int64)
            for at, unit in normal(b, 1):
                keys[at] = table_keys(unit, label[at])
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * TABLES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=[*b.schema.names, "keys"])

    # keys are worked out once and go with their vector, so that no rounding can tell two of its copies apart
    reps = own.mapInArrow(keyed, widened(own, keys="array<bigint>"))
    reps = staged(reps.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    units = in_units(reps.select("cls", F.posexplode("keys").alias("t", "key")), ["t", "key"], "cls", block, singles=False)
    order = ["t", "key", "unit_a", "unit_b"]
    units = units.join(reps, "cls").select(*order, "own", "cls", "n", "label", "v", "keys").repartition(*order).sortWithinPartitions(*order)
    out = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("b", pa.int64())])

    def compare(cols: list[np.ndarray], new: np.ndarray, lists: pa.Array, key_lists: pa.Array):
        """Degrees (``cls, n``) and a spanning set of links (``cls, b``) of whole units."""
        t, _, ua, ub, own, rep, n, label = cols
        group, keys = np.cumsum(new), np.asarray(key_lists.flatten()).reshape(-1, TABLES)
        for rows_, unit in normal(pa.RecordBatch.from_arrays([lists], names=["v"]), 0):
            i, j = _links(group[rows_], (ua != ub)[rows_], own[rows_], t[rows_], label[rows_], keys[rows_], unit, least)
            if not len(i):
                continue
            names, at = np.unique(rep[rows_], return_inverse=True)
            i, j, m = rows_[i], rows_[j], n
            back = np.zeros(len(rep), np.int64)
            back[rows_] = at
            degree = np.bincount(np.append(back[i], back[j]), np.append(m[j], m[i]), minlength=len(names)).astype(np.int64)
            some = np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(degree[some]), pa.nulls(len(some), pa.int64())], schema=out)
            root = forest(len(names), back[i], back[j])
            far = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(np.zeros(len(far), np.int64)), pa.array(names[root[far]])], schema=out)

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            cols = [np.asarray(t.column(k).combine_chunks()).astype(np.int64) for k in range(8)]
            new = np.append(True, np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0))
            cut = int(np.flatnonzero(new)[-1])
            held = t.slice(cut)
            if cut:
                yield from compare([c[:cut] for c in cols], new[:cut], *(t.slice(0, cut).column(k).combine_chunks() for k in (8, 9)))
        if held is not None and held.num_rows:
            held = held.combine_chunks()
            cols = [np.asarray(held.column(k).combine_chunks()).astype(np.int64) for k in range(8)]
            yield from compare(cols, np.append(True, np.zeros(held.num_rows - 1, bool)), *(held.column(k).combine_chunks() for k in (8, 9)))

    found = staged(units.mapInArrow(run, "cls long, n long, b long"), "vector-links")
    degree = found.where("b is null").groupBy("cls").agg(F.sum("n").alias("more"))
    joined = components(found.where("b is not null").select(F.col("cls").alias("a"), "b"))
    known = reps.drop("keys").join(degree, "cls", "left").join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least_ids = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = known.join(least_ids, "component").select("label", "v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("fine").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
