"""First-fit decreasing over a tournament tree, in randomised groups of documents.

Documents are encoded and cut to full sequences and a remainder. Full ones stand
alone. Remainders go to groups of about ``GROUP_TOKENS`` by a hash of their place,
whatever their text or id; in each group they go, longest first, to the first bin
with room, which a tournament tree over the bins' rooms finds in logarithmic time.

Documents may be cut, so what first fit leaves open is then closed: pieces of the
emptiest bins of the group fill up the fullest, one cut a bin at most. One bin a
group may stay open; as sequences whose length is a power of two need no padding,
it is cut to such lengths.

Defined results: null text counts as empty (its end id alone is packed); repeated
rows are packed one by one; a null ``doc_id`` is packed like any other; a very long
text becomes as many pieces as it needs, whole; pieces of equal length are taken in
the order of their rows; an empty table gives no rows; other columns, whatever their
names, are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, setting, staged
from .tokens import encoder

#: Tokens and pieces of one group, which one task holds.
GROUP_TOKENS, GROUP_ROWS = 1 << 22, 50_000
PACKED = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Rooms:
    """A tournament tree over the rooms of ``n`` bins: each node holds the larger room below it."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Put ``size`` into the first bin with room for it, and return that bin."""
        most, leaves, at = self.most, self.leaves, 1
        while at < leaves:
            at *= 2
            if most[at] < size:
                at += 1
        found = at - leaves
        most[at] -= size
        while at > 1:
            at >>= 1
            left, right = most[2 * at], most[2 * at + 1]
            larger = left if left > right else right
            if most[at] == larger:
                break
            most[at] = larger
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item indices. First fit opens fewer than twice the bins that the total fills, and one."""
    total = int(lengths.sum())
    rooms = Rooms(min(len(lengths), 2 * total // capacity + 2), capacity)
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        b = rooms.first_fit(int(lengths[i]))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def _powers(n: int) -> list[int]:
    """Powers of two that add up to ``n``, the largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def closed(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(item, from, to)`` without padding: the emptiest bins' items fill up the fullest."""
    done, open_ = [], []
    for b in bins:
        pieces = [(i, 0, int(lengths[i])) for i in b]
        fill = sum(p[2] for p in pieces)
        (done if fill == capacity or fill & (fill - 1) == 0 else open_).append((fill, pieces))
    open_.sort(key=lambda f: -f[0])  # fullest first; equal ones as they came
    filled = [s for _, s in done]
    lo, hi = 0, len(open_) - 1
    while lo < hi:
        (fill, into), donor = open_[lo], open_[hi][1]
        room = capacity - fill
        while room and lo < hi:
            i, x, y = donor.pop()
            take = min(room, y - x)
            into.append((i, x, x + take))
            room -= take
            if take < y - x:
                donor.append((i, x + take, y))
            if not donor:
                hi -= 1
                donor = open_[hi][1]
        if not room:
            filled.append(into)
            lo += 1
        else:  # it was the last one, and stays open
            open_[lo] = (capacity - room, into)
    for _, left in open_[lo : hi + 1]:
        left = left[::-1]
        for size in _powers(sum(y - x for _, x, y in left)):
            part = []
            while size:
                i, x, y = left.pop()
                take = min(size, y - x)
                part.append((i, x, x + take))
                size -= take
                if take < y - x:
                    left.append((i, x + take, y))
            filled.append(part)
    return filled


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Encode every text and append ``end_id``; full sequences, and what remains of each document, numbered by ``at``."""

    def run(batches):
        words, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(b.column(0).to_pylist(), words.encode(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    size = min(capacity, n - at)
                    for column, v in zip(out, (doc, at, size, n, ids[4 * at : 4 * (at + size)])):
                        column.append(v)
            at = pa.array(np.arange(number, number + len(out[0])))
            number += len(out[0])
            yield pa.RecordBatch.from_arrays([at, *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], names=["at", "doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "at bigint, doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids`` (little-endian unsigned 32-bit) ``, sequence_id, offset`` of every piece."""
    spark = docs.sparkSession
    with setting(spark, _BATCH, "1000"):  # so that long texts don't fill a worker
        found = staged(pieces(docs, vocabulary, end_id, capacity), "pieces", "zstd")
    short = found.where(F.col("length") < capacity)
    tokens, rows = short.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    n = max(parts(tokens, GROUP_TOKENS), parts(rows, GROUP_ROWS))

    def run(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        table = table.sort_by("at").combine_chunks()
        lengths = table.column("length").to_numpy()
        raw, start = table.column("ids").to_pylist(), table.column("start").to_numpy()
        sequences = closed(first_fit_decreasing(lengths, capacity), lengths, capacity)
        item, lo, hi = (np.array([p[k] for s in sequences for p in s], np.int64) for k in range(3))
        size = np.array([len(s) for s in sequences])
        seq = np.repeat(np.arange(len(size)), size)
        ends = np.cumsum(hi - lo)
        begins = ends - (hi - lo)
        offset = begins - np.repeat(begins[np.cumsum(size) - size], size)
        cut = [raw[i] if y - x == n else raw[i][4 * x : 4 * y] for i, x, y, n in zip(item.tolist(), lo.tolist(), hi.tolist(), lengths[item].tolist())]
        own = table.select(["doc_id", "doc_tokens"]).take(pa.array(item))
        cols = [own.column("doc_id"), start[item] + lo, hi - lo, own.column("doc_tokens"), pa.array(cut, pa.binary()), group * (1 << 32) + seq, offset]
        return pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in cols], names=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

    group = F.pmod(F.xxhash64("at", F.lit("group")), F.lit(n))
    held = ["doc_id", "start", "length", "doc_tokens", "ids"]
    full = found.where(F.col("length") >= capacity).select(*held, (F.lit(1 << 62) + F.col("at")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return short.withColumn("grp", group).groupBy("grp").applyInArrow(run, PACKED).unionByName(full)
