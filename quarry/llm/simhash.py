"""SimHash fingerprints, linked by Golay-code fuzzy hashing.

A fingerprint is cut to three segments of 21, 21 and 22 bits, each decoded as a
word of the perfect [23, 12] Golay code. Fingerprints that differ in four bits or
fewer have two segments that differ in (1, 1) bits or fewer, or one equal and one
that differs in two. Words one bit apart share the nearest codeword of one of them;
words two bits apart have a common codeword within four bits of both. So each
segment gives its nearest codeword, or all within four bits, and pairs of segments
give keys; no link within four bits is missed. Distinct fingerprints that share a
key meet in bounded units, are verified by bit count, and form components.

Defined results: null texts and texts without words have fingerprint zero and link
like any other; equal fingerprints always link; rows with a null ``doc_id`` get the
component of their fingerprint (null if no row of it has an id); an empty table
gives no rows; repeated rows are returned as often as given; very long texts are read
whole; of equal ids none is before the other, so ties need no order; other columns,
whatever their names, are never read, and are kept by ``one_of_each``.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import components, forest, in_units
from .shared import kept_in_worker, small_batches, staged, widened

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Cuts of a fingerprint's bits to segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Generator polynomial of the binary Golay code (fixed value).
_POLYNOMIAL = 0b101011100011


def fingerprint(text: str | None, width: int = 4) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(line, 42)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        hashes = [xxh64_intdigest(line[a : b - 1], 42) for a, b in zip([0, *ends], ends[width - 1 :])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, width: int = 4) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``fp`` (64 bits as a long). ``key`` is made a long."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    docs = docs.select(*[F.col(c).cast("long") if c == key else F.col(c) for c in others], F.col("text").cast("string"))

    def run(batches):
        kept_in_worker("simhash")
        for b in batches:
            got = np.array([fingerprint(t, width) for t in b.column(len(others)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(got)], names=[*others, "fp"])

    return docs.mapInArrow(run, widened(docs.drop("text"), fp="long"))


class Golay:
    """Nearest codewords of 23-bit words, by tables over the 2,048 syndromes."""

    def __init__(self):
        unit = [self._syndrome(1 << i) for i in range(23)]
        self.high = np.zeros(1 << 12, np.int32)
        self.low = np.zeros(1 << 11, np.int32)
        for table, at in ((self.low, 0), (self.high, 11)):
            for x in range(len(table)):
                for i in range(12):
                    if x >> i & 1:
                        table[x] ^= unit[at + i]
        self.leader = np.zeros(2048, np.int32)
        self.weight = np.zeros(2048, np.int32)
        self.fours: list[list[int]] = [[] for _ in range(2048)]
        from itertools import combinations

        for w in (1, 2, 3, 4):
            for places in combinations(range(23), w):
                s = 0
                for i in places:
                    s ^= unit[i]
                e = sum(1 << i for i in places)
                if w < 4:
                    self.leader[s], self.weight[s] = e, w
                else:
                    self.fours[s].append(e)
        self.more = np.array([f if len(f) == 5 else [0] * 5 for f in self.fours], np.int32)

    @staticmethod
    def _syndrome(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= _POLYNOMIAL << (i - 11)
        return word

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 2047] ^ self.high[words >> 11]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index (its 12 leading bits) of the only codeword within three bits of each word."""
        return (words ^ self.leader[self.syndrome(words)]) >> 11

    def within_four(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, index)`` of every codeword within four bits of each word: one, or six at distance three."""
        s = self.syndrome(words)
        far = np.flatnonzero(self.weight[s] == 3)
        more = (words[far, None] ^ self.more[s[far]]) >> 11
        return np.concatenate([np.arange(len(words)), np.repeat(far, 5)]), np.concatenate([self.nearest(words), more.ravel()])


def keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: fingerprints within four bits share a key, of all that each of them has."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay.nearest(s) for s in seg]
    four = [golay.within_four(s) for s in seg]
    rows, found = [], []

    def give(kind: int, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        rows.append(row)
        found.append(np.int64(kind) << 48 | a.astype(np.int64) << 22 | b.astype(np.int64))

    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        # At most one bit in each: the nearest codeword of either side is within four bits of
        # the other side. Which side that is may differ by segment, so each gives both forms.
        row, c = four[i]
        give(k, row, c, near[j][row])
        row, c = (x[len(fps) :] for x in four[j])  # its nearest one stands in the first form
        give(k, row, near[i][row], c)
    for k, (same, other) in enumerate(((0, 1), (1, 0), (2, 0))):
        # An equal segment, and two bits in another: some codeword is within four bits of both.
        row, c = four[other]
        give(3 + k, row, c, seg[same][row])
    return np.concatenate(rows), np.concatenate(found)


def linked(fps: DataFrame, most: int = 4, block: int = 1024) -> DataFrame:
    """``a, b``: a spanning set of the links between distinct ``fp`` that differ in ``most`` (up to 4) bits."""

    def spread(batches):
        held = kept_in_worker("simhash")
        golay = held.get("golay") or Golay()
        held["golay"] = golay
        for b in batches:
            held = np.asarray(b.column(0)).astype(np.int64)
            row, key = keys(held.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(held[row])], names=["key", "fp"])

    def verify(group: np.ndarray, own: np.ndarray, cross: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(fp, return_inverse=True)
        bits, a, b = fp.view(np.uint64), [], []
        i, d = np.arange(len(fp)), 1
        while len(i):
            i = i[i + d < len(fp)]
            i = i[group[i] == group[i + d]]
            hit = i[(np.bitwise_count(bits[i] ^ bits[i + d]) <= most) & ~(cross[i] & (own[i] == own[i + d]))]
            a.append(at[hit])
            b.append(at[hit + d])
            d += 1
        root = forest(len(names), np.concatenate(a), np.concatenate(b))
        far = np.flatnonzero(root != np.arange(len(root)))
        return names[far], names[root[far]]

    def run(batches):
        """Rows come sorted by unit; a unit that a batch may have cut waits for the next one."""
        kept_in_worker("simhash")
        held = None
        for b in batches:
            cols = [np.asarray(c).astype(np.int64) for c in b.columns]
            if held is not None:
                cols = [np.concatenate(p) for p in zip(held, cols)]
            new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))
            cut = int(np.flatnonzero(new)[-1])
            held = [c[cut:] for c in cols]
            if cut:
                yield found([c[:cut] for c in cols], new[:cut])
        if held is not None and len(held[0]):
            cols = held
            yield found(cols, np.append(True, np.zeros(len(cols[0]) - 1, bool)))

    def found(cols: list[np.ndarray], new: np.ndarray) -> pa.RecordBatch:
        a, b = verify(np.cumsum(new), cols[3], cols[1] != cols[2], cols[4])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    units = in_units(fps.select("fp").mapInArrow(spread, "key long, fp long"), ["key"], "fp", block)
    order = ["key", "unit_a", "unit_b"]
    units = units.select(*order, "own", "fp").repartition(*order).sortWithinPartitions(*order)
    return units.mapInArrow(run, "a long, b long")


def _components(found: DataFrame, most: int) -> DataFrame:
    """``fp, component`` of each distinct fingerprint of ``found``."""
    own = staged(found.select("fp").distinct(), "fps")
    joined = components(linked(own, most))
    return own.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, most: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id``; the fingerprint as 16 hexadecimal digits."""
    found = staged(fingerprints(docs.select(F.col("doc_id").alias("id"), "text"), "id"), "fingerprints")
    named = _components(found, most)
    first = found.groupBy("fp").agg(F.min("id").alias("first_id"))
    named = named.join(first, "fp")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return found.join(named, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, most: int = 4, small: int = 2_000_000) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest ``doc_id`` (rows without one come last), the first of equal ones.

    Rows are told apart by a number of their own, so that repeated and null ids lose nothing. The numbers of
    what goes are broadcast if they are at most ``small``; else they are joined by a shuffle.
    """
    spare = "_" * (1 + max(map(len, docs.columns)))
    rows = staged(docs.withColumn(spare, F.monotonically_increasing_id()), "rows", "zstd")
    found = staged(fingerprints(rows.select(F.col(spare).alias("id"), "text", F.col("doc_id").cast("long").alias("doc_id")), "id"), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "id")
    first = found.groupBy("fp").agg(F.min(rank).alias("first"))  # of equal fingerprints, before any join
    least = _components(found, most).join(first, "fp").groupBy("component").agg(F.min("first.id").alias("id"), F.min("first").alias("first"))
    kept = least.select(F.col("first.id").alias("id"))
    goes = staged(found.select("id").join(kept, "id", "left_anti").withColumnRenamed("id", spare), "copies")
    few = goes.count() <= small
    return rows.join(F.broadcast(goes) if few else goes, spare, "left_anti").select(*docs.columns)
