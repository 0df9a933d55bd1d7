"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are encoded and cut to pieces of at most ``capacity`` tokens, the
first piece of a long one taking the remainder. Full pieces are sequences of
their own. Shorter ones are dealt to groups of about ``group_rows`` by a hash of
their place; each group is packed by best fit (longest first), then local search
exchanges one-for-one, two-for-one or moves pieces between underfull bins, taking
only steps that raise the sum of squared fills, until no pair of bins has such a
step or the bins are as few as the tokens allow. Groups are packed by different
tasks; each may leave underfull bins of its own.

Defined results: null text counts as empty (its end id alone is packed); empty
tables give no rows; repeated rows are packed one by one, as pieces of their
own; a null ``doc_id`` is packed like any other; a very long text becomes as many
pieces as it needs, whole; pieces of equal length are packed in the order of their
rows; further columns, whatever their names, are never read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, small_batches, staged
from .tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Encode every text, append ``end_id`` and cut to pieces."""
    small_batches(docs.sparkSession)

    def run(batches):
        words = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), words.encode(b.column(1).to_pylist())):
                ids += end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - at - 1) % capacity + 1 if not at else capacity
                    rows.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES)


_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item indices: each item, longest first, goes where least room is left after it."""
    order = np.argsort(-lengths, kind="stable").tolist()
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the rooms that some bin has, ascending
    bins: list[list[int]] = []
    for i in order:
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            if not by_room[room - n]:
                insort(rooms, room - n)
            by_room[room - n].append(b)
    return bins


class LocalSearch:
    """Raises the sum of squared fills of underfull bins by steps between two bins.

    A step moves ``x`` tokens net from a giver to a receiver and gains where ``x``
    exceeds what the giver is fuller by. Which bins can give a length is looked up:
    a mask of the lengths that some underfull bin holds (and one of the sums of two
    of its pieces), and the bins that hold each, by fill. So a receiver asks all bins.
    """

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.n, self.capacity = lengths.tolist(), capacity
        self.bins = [list(b) for b in bins]
        self.fill = [sum(self.n[i] for i in b) for b in self.bins]
        self.masks = [0, 0, 0]
        self.holders: list[list[dict[int, set[int]]]] = [[], *([{} for _ in range(capacity + 1)] for _ in range(2))]
        for b in range(len(self.bins)):
            self._index(b, True)

    def _lengths(self, b: int) -> list[int]:
        return sorted({self.n[i] for i in self.bins[b]})

    def _sums(self, b: int) -> set[int]:
        """Sums of two pieces of a bin; by distinct length, of which a bin holds few."""
        own = Counter(self.n[i] for i in self.bins[b])
        names = list(own)
        return {x + y for k, x in enumerate(names) for y in names[k:] if x != y or own[x] > 1}

    def _index(self, b: int, add: bool) -> None:
        if not 0 < self.fill[b] < self.capacity:
            return
        for kind, found in ((1, self._lengths(b)), (2, self._sums(b))):
            for s in found:
                held = self.holders[kind][s]
                if add:
                    held.setdefault(self.fill[b], set()).add(b)
                else:
                    held[self.fill[b]].discard(b)
                    if not held[self.fill[b]]:
                        del held[self.fill[b]]
                if held:
                    self.masks[kind] |= 1 << s
                else:
                    self.masks[kind] &= ~(1 << s)

    def _best(self, into: int) -> tuple[int, int, int, int] | None:
        """``(gain in tokens, kind, length given, length returned)`` and giver of the best step to ``into``."""
        room, fill = self.capacity - self.fill[into], self.fill
        best: tuple = (0,)
        for kind in (1, 2):
            for back in [0, *self._lengths(into)]:
                # lengths that fit once ``back`` is out, and beat the best so far
                open_ = self.masks[kind] & ((1 << (room + back + 1)) - 1) & ~((1 << (back + best[0] + 1)) - 1)
                while open_:
                    s = open_.bit_length() - 1
                    held = self.holders[kind][s]
                    least = min((f for f, bins in held.items() if len(bins) > 1 or into not in bins), default=None)
                    giver = None if least is None else next(g for g in held[least] if g != into)
                    if giver is not None and s - back > fill[giver] - fill[into]:
                        best = (s - back, kind, s, back, giver)
                        break
                    open_ &= ~(1 << s)
        return best if best[0] else None

    def _take(self, b: int, kind: int, s: int) -> list[int]:
        """Pieces of ``b``: one of length ``s``, or two of that sum."""
        by: dict[int, list[int]] = {}
        for i in self.bins[b]:
            by.setdefault(self.n[i], []).append(i)
        if kind == 1:
            return [by[s][0]]
        x = next(x for x in sorted(by) if s - x in by and (2 * x != s or len(by[x]) > 1))
        return [by[x][0], by[s - x][1 if 2 * x == s else 0]]

    def step(self, into: int) -> bool:
        found = self._best(into)
        if not found:
            return False
        gain, kind, s, back, giver = found
        given, returned = self._take(giver, kind, s), self._take(into, 1, back) if back else []
        for b in (into, giver):
            self._index(b, False)
        self.bins[giver] = [i for i in self.bins[giver] if i not in given] + returned
        self.bins[into] = [i for i in self.bins[into] if i not in returned] + given
        self.fill[into] += gain
        self.fill[giver] -= gain
        for b in (into, giver):
            self._index(b, True)
        return True

    def run(self) -> list[list[int]]:
        """Until no step gains or the bins are as few as can be."""
        least_bins = -(-sum(self.fill) // self.capacity)
        gained = True
        while gained and sum(1 for f in self.fill if f) > least_bins:
            gained = False
            for into in sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: -self.fill[b]):
                while 0 < self.fill[into] < self.capacity and self.step(into):
                    gained = True
        return [b for b in self.bins if b]


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return LocalSearch(lengths, best_fit(lengths, capacity), capacity).run()


def packed(found: DataFrame, capacity: int = 2048, group_rows: int = 20_000) -> DataFrame:
    """Give each row of ``pieces`` (written to files, so that places stay) a sequence and its place there."""
    found = found.withColumn("at", F.monotonically_increasing_id())
    short = found.where(F.col("length") < capacity)
    n = parts(short.count(), group_rows)

    def run(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        table = table.sort_by("at").drop_columns(["grp", "at"])
        lengths = table.column("length").to_numpy()
        seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for k, b in enumerate(pack(lengths, capacity)):
            seq[b] = group * (1 << 32) + k
            off[b] = np.cumsum(lengths[b]) - lengths[b]
        return table.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    group = F.pmod(F.xxhash64("at", F.lit("group")), F.lit(n))
    full = found.where(F.col("length") >= capacity).select(*_NAMES, (F.lit(1 << 62) + F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.withColumn("grp", group).groupBy("grp").applyInArrow(run, PACKED).unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    return packed(staged(pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)
