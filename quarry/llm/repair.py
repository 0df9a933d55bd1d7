"""Token ids on disk: Re-Pair grammar compression per shard, with random access.

A shard is a run of documents in ascending ``doc_id``. Frequent adjacent id pairs
are replaced by nonterminals, again and again (many pairs a round, none across a
document's end), until no pair occurs ``LEAST`` times. A row of the file holds the
rules, their expansion lengths, the compressed sequence and where each document
begins in it: one document decodes alone, and so does any run of token positions,
found by the expansion lengths. Files are Parquet with binary columns, so that any
store that Spark writes to will do.

Defined results: null or empty text gives the end id alone; rows with equal or
null ``doc_id`` are kept, one after the other (null first, ties in the order of the
input); a very long text fills a shard of its own, whole; an empty table writes no
shard; further columns, whatever their names, are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import parts, small_batches
from .tokens import encoder

#: A pair is replaced while it occurs so often in a shard.
LEAST = 24
FILE = "part int, shard int, n_null int, doc_ids binary, n_ids binary, begins binary, rules binary, rule_lengths binary, first_rule long, width int, sequence binary"


def compress(ids: np.ndarray, ends: np.ndarray, first_rule: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sequence, ends in it, rules)``. ``ends``: where each document ends in ``ids``, ascending.

    ``rules[k]`` is the pair that ``first_rule + k`` stands for. A round counts exactly, and
    replaces the most frequent pair of each slot of a hash; rounds go on until no pair
    occurs ``least`` times.
    """
    seq, ends, rules = ids.astype(np.uint32), ends.astype(np.int64), []
    bits = 16
    while True:
        n = len(seq)
        if n < 2:
            break
        codes = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
        inner = np.ones(n - 1, bool)
        inner[ends[(ends > 0) & (ends < n)] - 1] = False
        slot = (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)
        # the most frequent pair stands for a slot, the lesser code of equals; only slots with enough hits are counted
        busy = np.flatnonzero(inner & (np.bincount(slot, minlength=1 << bits) >= least)[slot])
        found, times = np.unique(codes[busy], return_counts=True)
        found, times = found[times >= least], times[times >= least]
        if not len(found):
            break
        home = (found * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)
        order = np.lexsort((found, -times))[::-1]  # what is written last stays
        pair, count = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        pair[home[order]], count[home[order]] = found[order], times[order]
        at = busy[pair[slot[busy]] == codes[busy]]
        slot = slot[at]
        chosen = np.flatnonzero(count >= least)
        number = np.full(1 << bits, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        new = number[slot]
        at, new = at[new >= 0], new[new >= 0]
        pairs = pair
        # of hits that overlap, every second one from the left is replaced
        fresh = np.append(True, np.diff(at) > 1)
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0
        at, new = at[take], new[take]
        base = first_rule + sum(map(len, rules))
        rules.append(np.stack([pairs[chosen] >> np.uint64(32), pairs[chosen] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        seq[at] = base + new
        keep = np.ones(n, bool)
        keep[at + 1] = False
        seq, ends = seq[keep], ends - np.searchsorted(at + 1, ends)
    return seq, ends, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each rule stands for; rules refer to earlier ones only."""
    out = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - first_rule] if a >= first_rule else 1) + (out[b - first_rule] if b >= first_rule else 1)
    return out


def expand(seq: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Inverse of ``compress`` for any run of its sequence."""
    seq = seq.astype(np.uint32)
    while len(rules):
        big = seq >= first_rule
        if not big.any():
            break
        to = np.repeat(seq, np.where(big, 2, 1))
        at = np.flatnonzero(big) + np.arange(int(big.sum()))
        pair = rules[seq[big] - first_rule]
        to[at], to[at + 1] = pair[:, 0], pair[:, 1]
        seq = to
    return seq


def expand_whole(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    """``expand`` of a whole sequence: rules are expanded once (``lengths``), then laid out in one go.

    Rules of a round don't overlap in the ids, so all expansions together are no longer than a few shards.
    """
    flat = np.concatenate([np.arange(first_rule, dtype=np.uint32), expand(first_rule + np.arange(len(rules)), rules, first_rule)])
    where = np.concatenate([np.arange(first_rule), first_rule + np.cumsum(lengths) - lengths])[seq]
    n = np.concatenate([np.ones(first_rule, np.int64), lengths])[seq]
    begins = np.cumsum(n) - n
    return flat[np.repeat(where - begins, n) + np.arange(int(n.sum()))]


def document(shard: dict, k: int) -> np.ndarray:
    """Random access: the ids of the ``k``-th document of a file row, decoding nothing else."""
    begins = np.frombuffer(shard["begins"], "<i8")
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    seq = np.frombuffer(shard["sequence"], f"<u{shard['width']}")
    return expand(seq[begins[k] : begins[k + 1]], rules, shard["first_rule"])


def tokens(shard: dict, start: int, stop: int) -> np.ndarray:
    """Random access: ids ``start`` to ``stop`` of a file row, all its documents counted as one sequence.

    Expansion lengths tell which symbols cover them; only those are decoded.
    """
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    seq = np.frombuffer(shard["sequence"], f"<u{shard['width']}").astype(np.int64)
    stands_for = np.append(np.frombuffer(shard["rule_lengths"], "<i8"), 1)
    ends = np.cumsum(stands_for[np.where(seq >= shard["first_rule"], seq - shard["first_rule"], -1)])
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skip = start - (int(ends[a - 1]) if a else 0)
    return expand(seq[a:b], rules, shard["first_rule"])[skip : skip + max(0, stop - start)]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, docs_a_part: int = 4000, ids_a_shard: int = 1_000_000) -> None:
    """Encode every text, append ``end_id``, compress and write the files."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    n_parts = parts(docs.count(), docs_a_part)

    def run(batches):
        words = encoder(vocabulary)
        first = words.tok.get_vocab_size()
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        held, shard, size = [], 0, 0

        def flush():
            docs_ = np.array([d for d, _ in held if d is not None], "<i8")  # those without id come first
            n = np.array([len(x) // 4 for _, x in held], np.int64)
            seq, ends, rules = compress(np.frombuffer(b"".join(x for _, x in held), "<u4"), np.cumsum(n), first)
            width = 2 if max(first + len(rules), int(seq.max(initial=0)) + 1) <= 65536 else 4
            row = [part, shard, len(held) - len(docs_), docs_.tobytes(), n.astype("<i8").tobytes(), np.append(0, ends).astype("<i8").tobytes(), rules.astype("<u4").tobytes()]
            row += [expansion_lengths(rules, first).astype("<i8").tobytes(), first, width, seq.astype(f"<u{width}").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names=_NAMES)

        for b in batches:
            for d, ids in zip(b.column(0).to_pylist(), words.encode(b.column(1).to_pylist())):
                if held and size >= ids_a_shard:
                    yield flush()
                    shard, held, size = shard + 1, [], 0
                held.append((d, ids + end))
                size += len(ids) // 4 + 1
        if held:
            yield flush()

    # ranges of ids, ties dealt by their place in the input, so that no id fills a task
    out = docs.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(n_parts, "doc_id", "at").sortWithinPartitions("doc_id", "at")
    out.select("doc_id", "text").mapInArrow(run, FILE).write.mode("overwrite").parquet(path)


_TYPES = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int32(), pa.binary()]
_NAMES = ["part", "shard", "n_null", "doc_ids", "n_ids", "begins", "rules", "rule_lengths", "first_rule", "width", "sequence"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """``part, shard, k, doc_id, n_tokens, at, ids_crc32`` of each document of the files, decoded.

    ``k``: its place in the shard; ``at``: the ids of the shard before it.
    """

    def run(batches):
        for b in batches:
            for s in b.to_pylist():
                begins, n = np.frombuffer(s["begins"], "<i8"), np.frombuffer(s["n_ids"], "<i8")
                ids = expand_whole(np.frombuffer(s["sequence"], f"<u{s['width']}"), np.frombuffer(s["rules"], "<u4").reshape(-1, 2), np.frombuffer(s["rule_lengths"], "<i8"), s["first_rule"])
                assert len(begins) == len(n) + 1 and len(ids) == n.sum(), "the file is damaged"
                raw, at = ids.astype("<u4").tobytes(), np.append(0, np.cumsum(n)) * 4
                docs_ = [None] * s["n_null"] + np.frombuffer(s["doc_ids"], "<i8").tolist()
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                m = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["part"]] * m, pa.int32()), pa.array([s["shard"]] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(docs_, pa.int64()), pa.array(n), pa.array((at[:-1] // 4)), pa.array(crc, pa.int64())],
                    names=["part", "shard", "k", "doc_id", "n_tokens", "at", "ids_crc32"],
                )

    files = spark.read.schema(FILE).parquet(path).select("part", "shard", "n_null", "doc_ids", "n_ids", "begins", "rules", "rule_lengths", "first_rule", "width", "sequence")
    return files.mapInArrow(run, "part int, shard int, k int, doc_id long, n_tokens long, at long, ids_crc32 long")


def starts(read_back: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before each one.

    Totals of shards are summed first; only they meet in the window of a part,
    and only the totals of parts (one a few thousand documents) in the last one.
    """
    from pyspark.sql import Window

    shard = read_back.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    part = shard.groupBy("part").agg(F.sum("n").alias("n"))
    before = part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard")
    shard = shard.select("part", "shard", (F.sum("n").over(inside) - F.col("n")).alias("shard_start"))
    first = shard.join(before, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))
    return read_back.join(first, ["part", "shard"]).withColumn("start", F.col("shard_start") + F.col("at"))
