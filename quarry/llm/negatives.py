"""Hard-negative mining by distributed radix selection.

Rows are dealt to blocks of vectors, anchors to blocks of their own, and blocks meet
pair by pair: one matrix product gives the scores of all their pairs, which never
leave the task. A *window* is what an anchor selects from: rows of its label, or rows of
other labels whose score lies between two bounds that its positive gives. To find a
window's kth row, every task counts the window's scores by their leading digit; the
counts of all tasks add up to a histogram, which tells the bucket that holds the kth
score. The bucket's scores are counted by the next digit, and so on; scores that are
all equal are told apart by the digits of the rows' ids. Once a window's bucket ends
within ``SLACK`` rows of its top, a last pass gathers the rows up to it, which are
ranked. What a task counts beyond its own kth row can't hold the kth of all, so it sends
``k`` buckets a window at most.

All windows take their digits in the same passes; windows that have settled leave them.
Scores are whole numbers: products run in double precision where it is exact. Nothing is
broadcast: blocks, windows and positives all meet by shuffles, whatever their size.

Defined results: rows whose id, label or vector is null, or whose vector is empty or
holds null or non-finite components, take no part, nor do vectors whose square reaches
2^62, as their scores may not fit; rows that repeat id, label and vector count once,
other rows of one id are rows of their own; scores are taken between vectors of equal
length only; very long vectors are compared whole; ties go by smaller ``vec_id``; an
anchor without positives gives no rows, nor does an empty table; other columns, whatever
their names, are never read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, parts, setting, staged

#: Bits of a digit; a window whose bucket ends at or above this rank is gathered.
DIGIT, SLACK = 12, 64
#: Bytes of the vectors of a block of rows, and of one of anchors.
BLOCK_BYTES, ANCHOR_BYTES = 1 << 22, 1 << 18
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
#: A window: its current bucket of scores (``low`` to ``high``, at last one score) and of ids, its best score, and
#: how many rows are better than the bucket.
STATE = "rid long, w int, low long, high long, top long, id_low long, id_high long, above long, settled boolean"
_STATE = [c.split()[0] for c in STATE.split(", ")]


def quantised(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """``rid, vec_id, label, dim, square, x``: rows that take part; ``x`` is the vector's whole numbers, as little-endian 64-bit."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + F.pow(F.floor(c * scale).cast("double"), 2))
    rows = rows.withColumn("square", F.ceil(square)).where(F.col("square") < 1 << 62)
    rows = rows.select("vec_id", "label", F.size("v").alias("dim"), "square", F.transform("v", lambda c: F.floor(c * scale)).alias("x")).distinct()

    def run(batches):
        at = TaskContext.get().partitionId() << 33  # written with the row, so that its number stays
        for b in batches:
            lists = b.column(4)
            flat, ends = np.asarray(lists.flatten()).astype("<i8"), (np.asarray(lists.offsets) - lists.offsets[0].as_py()).tolist()
            raw = pa.array([flat[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), *b.columns[:4], raw], names=["rid", "vec_id", "label", "dim", "square", "x"])
            at += b.num_rows

    return staged(rows.mapInArrow(run, "rid long, vec_id long, label long, dim int, square long, x binary"), "quantised")


def _in_blocks(rows: DataFrame, n: int, columns: list[str], name: str) -> DataFrame:
    """``dim, <name>, <name>s``: rows of one length dealt to ``n`` blocks, each an array of structs."""
    block = F.pmod(F.xxhash64("rid", F.lit(name)), F.lit(n)).cast("int")
    return rows.withColumn(name, block).groupBy("dim", name).agg(F.collect_list(F.struct(*columns)).alias(f"{name}s"))  # bounded by the dealing


class Block:
    """Rows of one block as arrays."""

    def __init__(self, rows: pa.StructArray, dim: int):
        self.rid, self.vec_id, self.label = (rows.field(c).to_numpy() for c in ("rid", "vec_id", "label"))
        self.x = np.frombuffer(b"".join(rows.field("x").to_pylist()), "<i8").reshape(-1, dim)
        self.windows = rows.field("windows").to_pylist() if rows.type.get_field_index("windows") >= 0 else []


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of the two, exactly."""
    most = [float(np.abs(m.astype(float)).max(initial=0)) for m in (a, b)]
    if most[0] * most[1] * a.shape[1] < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def shift(low: int, high: int) -> int:
    """How many bits lie below the leading digit of ``0 .. high - low``."""
    return max(0, (high - low).bit_length() - DIGIT)


def selected(batches, same: bool):
    """``anchor's rid, window, scores, ids`` of the rows that lie in each window, block pair by block pair: those
    of its current bucket, and of the better ones too if the window has settled."""
    for b in batches:
        for i in range(b.num_rows):
            anchors, rows = (Block(b.column(c).slice(i, 1).flatten(), b.column(0)[i].as_py()) for c in (1, 2))
            s = scores(anchors.x, rows.x)
            for a, windows in enumerate(anchors.windows):
                own = s[a]
                fits = rows.label == anchors.label[a] if same else rows.label != anchors.label[a]
                if same:
                    fits &= rows.rid != anchors.rid[a]
                for w in windows:
                    top = w["top"] if w["settled"] else w["high"]
                    found = np.flatnonzero(fits & (own >= w["low"]) & (own <= top))
                    if w["low"] == w["high"] and len(found):  # among equal scores the ids decide
                        ids = rows.vec_id[found]
                        inside = (ids <= w["id_high"]) & (w["settled"] | (ids >= w["id_low"]))
                        found = found[inside | (own[found] > w["low"])]
                    if len(found):
                        yield int(anchors.rid[a]), w, own[found], rows.vec_id[found]


def _counted(pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """``rid, w, bucket, n``: rows of open windows by the leading digit of what tells them apart now, the best bucket 0."""

    def run(batches):
        out: tuple[list, ...] = ([], [], [], [])
        for rid, w, own, ids in selected(batches, same):
            if w["low"] < w["high"]:
                bucket = (w["high"] - own) >> shift(w["low"], w["high"])
            else:
                bucket = ((ids.astype(object) - w["id_low"]) // (1 << shift(w["id_low"], w["id_high"]))).astype(np.int64)
            names, n = np.unique(bucket, return_counts=True)
            last = int(np.searchsorted(np.cumsum(n), k - w["above"])) + 1
            for column, v in zip(out, ([rid] * len(names[:last]), [w["w"]] * len(names[:last]), names[:last].tolist(), n[:last].tolist())):
                column.extend(v)
            if len(out[0]) >= 50_000:
                yield _batch(out)
                out = ([], [], [], [])
        yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["rid", "w", "bucket", "n"])

    return pairs.mapInArrow(run, "rid long, w int, bucket long, n long")


def _gathered(pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """``rid, w, score, vec_id``: rows up to each settled window's bucket; of one block's, ``k`` at most can count."""

    def run(batches):
        for rid, w, own, ids in selected(batches, same):
            best = np.lexsort((ids, -own))[:k]
            n = len(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rid)), pa.array(np.full(n, w["w"], np.int32)), pa.array(own[best]), pa.array(ids[best])], names=["rid", "w", "score", "vec_id"])

    return pairs.mapInArrow(run, "rid long, w int, score long, vec_id long")


def _narrowed(open_: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The windows after one more digit: the bucket of the kth row, and what lies above it."""
    by = Window.partitionBy("rid", "w").orderBy("bucket")
    summed = counts.groupBy("rid", "w", "bucket").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(by))
    at = summed.join(open_.select("rid", "w", "above"), ["rid", "w"]).where(F.col("above") + F.col("upto") >= k)
    at = at.groupBy("rid", "w").agg(F.min(F.struct("bucket", "n", "upto")).alias("at")).select("rid", "w", "at.bucket", "at.n", "at.upto")

    def run(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                bucket = r.pop("bucket")
                n, upto = r.pop("n"), r.pop("upto")
                if bucket != bucket or bucket is None:  # fewer than k in all: every one counts
                    r["settled"] = True
                else:
                    bucket, n, upto = int(bucket), int(n), int(upto)
                    r["above"] += upto - n
                    if r["low"] < r["high"]:
                        bits = shift(r["low"], r["high"])
                        r["high"] -= bucket << bits
                        r["low"] = max(r["low"], r["high"] - (1 << bits) + 1)
                    else:
                        bits = shift(r["id_low"], r["id_high"])
                        r["id_low"] += bucket << bits
                        r["id_high"] = min(r["id_high"], r["id_low"] + (1 << bits) - 1)
                    r["settled"] = r["above"] + n <= SLACK or r["low"] == r["high"] and r["id_low"] == r["id_high"]
                rows.append(r)
            yield pd.DataFrame(rows, columns=_STATE)

    found = open_.join(at, ["rid", "w"], "left").select(*_STATE, "bucket", "n", "upto")
    return found.mapInPandas(run, STATE)


class Blocks:
    """All rows in blocks, written once, and what the passes need to know of them."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.n, self.dim, self.square, self.id_low, self.id_high = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1)), F.coalesce(F.max("square"), F.lit(0)), F.coalesce(F.min("vec_id"), F.lit(0)), F.coalesce(F.max("vec_id"), F.lit(0))).first()
        self.count = parts(self.n, max(1, BLOCK_BYTES // (8 * self.dim)))
        self.rows = staged(_in_blocks(rows, self.count, ["rid", "vec_id", "label", "x"], "row"), "row-blocks")

    def pairs(self, anchors: DataFrame, n_anchors: int, windows: DataFrame) -> DataFrame:
        """``dim, anchors, rows``: each block of the anchors that have ``windows`` beside each block of rows."""
        held = windows.groupBy("rid").agg(F.collect_list(F.struct(*_STATE[1:])).alias("windows"))  # k of an anchor at most
        asked = _in_blocks(anchors.join(held, "rid"), parts(n_anchors, max(1, ANCHOR_BYTES // (8 * self.dim))), ["rid", "vec_id", "label", "x", "windows"], "anchor")
        asked = asked.select("dim", "anchors", F.explode(F.sequence(F.lit(0), F.lit(self.count - 1))).alias("row"))
        return asked.hint("merge").join(self.rows, ["dim", "row"]).select("dim", "anchors", "rows")  # the copies of the anchors grow with both sides, which Spark's estimate doesn't know

    def best(self, anchors: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """``rid, w, rank, vec_id, score``: the first ``k`` rows of every window (``rid, w, low, high``)."""
        n_anchors = anchors.count()
        fresh = windows.select("rid", "w", "low", "high", F.col("high").alias("top"), F.lit(self.id_low).cast("long").alias("id_low"), F.lit(self.id_high).cast("long").alias("id_high"), F.lit(0).cast("long").alias("above"), F.lit(False).alias("settled"))
        states = [staged(fresh, "windows")]
        with setting(self.spark, _BATCH, "4"), setting(self.spark, _BROADCAST, "-1"):  # pairs of blocks, not rows; windows grow with the anchors
            while (open_ := states[-1].where(~F.col("settled"))).limit(1).count():
                counts = staged(_counted(self.pairs(anchors, n_anchors, open_), k, same), "digits")
                with setting(self.spark, _BATCH, "10000"):
                    states.append(staged(_narrowed(open_, counts, k), "windows"))
                drop(counts)
            settled = reduce(DataFrame.unionByName, [s.where("settled") for s in states])
            found = staged(_gathered(self.pairs(anchors, n_anchors, settled), k, same), "hits")
        drop(*states)
        best = Window.partitionBy("rid", "w").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column | None = None, label: Column | None = None, positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows where ``anchor`` holds (a condition on ``vec_id``; all by default). Its positives are the first
    ``positives`` other rows of its label, by inner product. For each, the first ``negatives`` rows of other labels
    are returned whose score is at least ``least_percent`` of the positive's, and no more than it.
    """
    rows = quantised(vectors, F.col("label") if label is None else label, scale)
    blocks = Blocks(rows)
    anchors = rows if anchor is None else rows.where(anchor)
    bound = F.lit(blocks.square + blocks.square // 1_000_000 + 1).cast("long")  # no score is greater; the square is rounded
    first = blocks.best(anchors, anchors.select("rid", F.lit(0).alias("w"), (-bound).alias("low"), bound.alias("high")), positives, same=True)
    first = staged(first.select("rid", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(25,0)")
    least = F.floor((score * least_percent + 99) / 100)
    windows = first.where("positive_score >= 0").select("rid", "w", least.cast("long").alias("low"), F.col("positive_score").alias("high"))
    found = blocks.best(anchors, windows, negatives, same=False).select("rid", "w", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = first.hint("merge").join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return found.hint("merge").join(named, ["rid", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
