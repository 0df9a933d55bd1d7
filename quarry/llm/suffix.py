"""Removal of repeated passages: suffix arrays over what may repeat.

Every window of ``width`` bytes has an anchor: the leftmost of its least-hashed
``GRAM``-byte strings. Equal windows have equal anchors at equal places, so a
document falls into runs of windows with one anchor each, and only runs whose
anchor occurs again can hold a repeated window. Runs of equal content repeat as a
whole: they meet by anchor and digest, 128 bits together. What differs, but agrees
with another run on one side of the anchor as far as a shared window must, goes, once
each, to shards by anchor. A shard sorts its suffixes by Larsson-Sadakane refinement
and reads common prefixes off Kasai's array. An anchor with more content than a
shard takes is dealt to several; their window digests, each shard's equal ones
merged, meet in parts by a hash of the digest, where they are sorted and found by
binary search. No window is dropped, sampled or judged twice.

Two rules: by the first, every byte goes that is covered by a window which also
starts anywhere else. With ``keep_first``, the first place of each window (by row,
then position) is spared, so that one copy of a passage stays.

Defined results: null text counts as empty; texts under ``width`` bytes keep all;
repeated rows count as documents of their own, so by the first rule both lose what
they share; very long texts are searched whole, a text that repeats itself too; rows
with a null ``doc_id`` are handled as any other; an empty table gives no rows; other
columns, whatever their names, are never read, and are kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, drop, kept_in_worker, parts, small_batches, staged, widened

#: Bytes of the string whose hash makes an anchor.
GRAM = 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Columns of a run of windows with one anchor, all of them whole numbers.
_RUN = ["anchor", "dig", "rid", "first", "head", "last", "n", "left", "right"]
#: Places that one walk of Kasai's takes at most; walks go in step, so long pieces take several.
_WALK = 256
#: Ends a piece in a shard's text; no byte of UTF-8 has this value.
_FENCE = 255


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sums(raw: np.ndarray, up: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])


def _hashes(sums: np.ndarray, down: np.ndarray, at: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hash of each string from ``at`` to ``end``, equal for equal strings wherever they stand."""
    h = (sums[end] - sums[at]) * down[at]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(h: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` adjacent hashes, where the leftmost least one stands."""
    n = len(h) - span + 1
    at = np.arange(len(h))
    least, place, reach = h.copy(), at, 1
    while reach < span:  # minima over doubled reaches, the leftmost of equal ones
        step = min(reach, span - reach)
        a, b = least[:-step], least[step:]
        right = b < a
        least = np.where(right, b, a)
        place = np.where(right, place[step:], place[:-step])
        reach += step
    return place[:n]


def runs(raw: bytes, width: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: its hash, first and last window, and hashes of the strings on either side.

    A window that two runs share reaches at least half of what it has beside its anchor to one side; so the runs
    agree in the string of that length there. Its hash is 0 where no window of the run reaches so far.
    """
    if len(raw) < width:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, *[np.zeros(0, np.uint64)] * 2)
    text = np.frombuffer(raw, np.uint8)
    sums, n = _sums(text, up), len(text)
    h = _hashes(sums, down, slice(0, n - GRAM + 1), slice(GRAM, n + 1))
    place = anchors(h, width - GRAM + 1)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    gram, half = place[first], (width - GRAM) // 2
    left, right = gram - half, gram + GRAM + half
    sides = []
    for fits, x, y in ((first <= left, left, gram), (last + width >= right, gram + GRAM, right)):
        own = np.zeros(len(first), np.uint64)
        own[fits] = _hashes(sums, down, x[fits], y[fits]) | np.uint64(1)
        sides.append(own)
    return h[gram], first, last, *sides


def suffix_array(text: np.ndarray, enough: int | None = None) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane: ranks by five symbols, then each group of equal
    rank is refined by the rank that stands ``reach`` further on, ``reach`` doubling; groups
    of one rest. With ``enough``, suffixes that agree in so many symbols may stay in text order."""
    n = len(text)
    bits = int(n + 2).bit_length()
    mask = np.uint64((1 << bits) - 1)

    def in_order(key: np.ndarray, key_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the sorted keys stood, and the keys; places ride in the low bits where they fit."""
        if key_bits + bits > 64:
            move = np.argsort(key, kind="stable")
            return move, key[move]
        packed = np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
        return (packed & mask).astype(np.int64), packed >> np.uint64(bits)

    padded = np.append(text.astype(np.uint64) + np.uint64(1), np.zeros(5, np.uint64))
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = key * np.uint64(258) + padded[k : k + n]
    order, key = in_order(key, 41)
    head = np.append(True, key[1:] != key[:-1])
    rank = np.zeros(n + 1, np.uint64)  # of a suffix: the first place of its group, plus one; 0 beyond the end
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    reach = 5
    open_ = np.arange(n)
    while True:
        alone = head & np.append(head[1:], True)
        open_ = open_[~alone[open_]]  # places whose suffixes are not settled
        if not len(open_) or enough and reach >= enough:
            return order
        suffix = order[open_]
        move, key = in_order(rank[suffix] << np.uint64(bits) | rank[np.minimum(suffix + reach, n)], 2 * bits)
        suffix = suffix[move]
        order[open_] = suffix
        fresh = np.append(True, key[1:] != key[:-1])
        head[open_] = fresh
        rank[suffix] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))] + 1
        reach *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Kasai: symbols (``most`` at most) that each suffix has in common with the one before it in order.

    Kasai's walks go along ``lengths`` places of the text from each of ``starts``, in step. Elsewhere the
    result is 0. What a place has in common is at least what the last one had, less one, if the last one's
    predecessor, moved on by one, stands before this place; so few symbols are compared. Where suffixes that
    agree in ``most`` symbols are in no order of their own it may not; then all symbols are compared.
    """
    n = len(text)
    padded = np.append(text.astype(np.uint64), np.zeros(8, np.uint64))
    eight = np.zeros(n, np.uint64)  # the eight symbols from each place, the first one lowest
    for k in range(8):
        eight |= padded[k : k + n] << np.uint64(8 * k)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    common, had, moved = np.zeros(n, np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    active = len(starts)
    for t in range(int(lengths.max(initial=0))):
        active = int(np.searchsorted(-lengths[:active], -t, "left"))  # pieces longer than t
        i = starts[:active] + t
        at = place[i]
        j = np.where(at > 0, order[at - 1], -1)
        own = np.where((at > 0) & (place[moved[:active]] < at), np.maximum(had[:active] - 1, 0), 0)
        moved[:active] = np.minimum(j + 1, n - 1)
        end = np.minimum(most, n - np.maximum(i, j))
        open_ = np.flatnonzero((j >= 0) & (own < end))
        while len(open_):
            differ = eight[i[open_] + own[open_]] ^ eight[j[open_] + own[open_]]
            low = differ & (~differ + np.uint64(1))
            own[open_] += np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
            open_ = open_[(differ == 0) & (own[open_] < end[open_])]
        own = np.minimum(own, np.maximum(end, 0))
        common[i] = had[:active] = own
    return common[order]


def classes(pieces: list[bytes], width: int) -> np.ndarray:
    """A number for each window of each piece, one after the other: equal for equal windows only."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.full(int((lengths + 1).sum()), _FENCE, np.uint8)
    body = np.ones(len(text), bool)
    body[starts + lengths] = False
    text[body] = np.frombuffer(b"".join(pieces), np.uint8)
    order = suffix_array(text, width)
    counts = lengths - width + 1
    walks = -(-counts // _WALK)
    nth = np.arange(int(walks.sum())) - np.repeat(np.cumsum(walks) - walks, walks)
    begins, most = np.repeat(starts, walks) + _WALK * nth, np.repeat(counts, walks) - _WALK * nth
    common = common_prefixes(text, order, begins, np.minimum(most, _WALK), width)  # a suffix that is no window holds a fence, so it equals none
    at = np.repeat(starts, counts) + (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts))
    number = np.empty(len(text), np.int64)
    number[order] = np.cumsum(common < width)
    return number[at]


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def repeats(held: DataFrame, width: int = 400, keep_first: bool = False, shard_bytes: int = 1_000_000, deal_bytes: int = 3_000_000) -> DataFrame:
    """``held``: a table bucketed by rid (unique long), with text. Returns ``rid, first, last``, staged: runs of
    windows that go by the rule."""
    small_batches(held.sparkSession)

    def find(batches):
        from xxhash import xxh3_64_intdigest

        kept_in_worker("suffix")
        up, down = _powers(1 << 16)
        for b in batches:
            cols: list[list] = [[] for _ in _RUN]
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) > len(up):
                    up, down = _powers(2 * len(raw))
                h, first, last, left, right = runs(raw, width, up, down)
                if not len(h):
                    continue
                dig = np.array([xxh3_64_intdigest(raw[x : y + width]) for x, y in zip(first.tolist(), last.tolist())], np.uint64)
                # adjacent runs of equal content (text that repeats itself) make one row
                head = np.flatnonzero(np.append(True, (dig[1:] != dig[:-1]) | (h[1:] != h[:-1])))
                n = np.diff(np.append(head, len(h)))
                for c, v in zip(cols, (h[head].view(np.int64), dig[head].view(np.int64), np.full(len(head), rid), first[head], last[head], last[head + n - 1], n, left[head].view(np.int64), right[head].view(np.int64))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in cols], names=_RUN)

    # head: the last window of the first of n adjacent equal runs
    seen = staged(held.select("rid", "text").mapInArrow(find, ", ".join(f"{c} long" for c in _RUN)), "runs", "zstd")
    # each content of an anchor once, with how often it stands somewhere
    content = seen.groupBy("anchor", "dig").agg(F.sum("n").alias("times"), F.min(F.struct("rid", "first", "head", "last", "left", "right")).alias("at"))
    per_anchor = content.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("at.last") - F.col("at.first") + width).alias("size"))
    content = content.join(per_anchor.where("kinds > 1"), "anchor", "left").where("times > 1 or kinds > 1")
    content = staged(content.select("anchor", "dig", "times", "at", "kinds", "size"), "content")
    whole = seen.join(content.where("times > 1").select("anchor", "dig", "at"), ["anchor", "dig"])
    if keep_first:  # of the first place of a content, what follows its first run goes
        is_first = (F.col("rid") == F.col("at.rid")) & (F.col("first") == F.col("at.first"))
        whole = whole.withColumn("first", F.when(is_first, F.col("head") + 1).otherwise(F.col("first"))).where("first <= last")
    whole = whole.select("rid", "first", "last")

    open_, sides = content.where("kinds > 1"), []
    for side in ("left", "right"):  # contents that agree with another one of their anchor on a side
        of = F.col(f"at.{side}")
        twins = content.where("kinds > 1").where(of != 0).groupBy("anchor", of.alias("side")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        twins = staged(twins.select("anchor", "side", F.lit(True).alias(f"twin_{side}")), "twins")  # written, so that a join may split a hot side
        sides.append(twins)
        open_ = open_.withColumn("side", of).join(twins, ["anchor", "side"], "left").drop("side")
    asked_from = staged(open_.where("twin_left or twin_right"), "open")
    open_ = asked_from.withColumn("deal", F.ceil(F.col("size") / deal_bytes).cast("int"))
    total = open_.agg(F.sum(F.col("at.last") - F.col("at.first") + width)).first()[0] or 0
    shards = parts(total, shard_bytes)
    salt = F.pmod(F.xxhash64("dig", F.lit("salt")), F.col("deal"))
    shard = F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).cast("int")
    asked = open_.select(F.col("at.rid").alias("rid"), F.struct(shard.alias("shard"), (F.col("deal") > 1).alias("dealt"), (F.col("times") > 1).alias("known"), F.col("at.first").alias("first"), F.col("at.last").alias("last")).alias("ask"))
    asked = asked.groupBy("rid").agg(F.collect_list("ask").alias("asks"))  # runs of one text

    def cut(batches):
        for b in batches:
            out = []
            for rid, text, asks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                out += [(a["shard"], a["dealt"], a["known"], rid, a["first"], raw[a["first"] : a["last"] + width]) for a in asks]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, [pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()])], names=["shard", "dealt", "known", "rid", "first", "piece"])

    pieces = held.join(asked, "rid").select("rid", "text", "asks").mapInArrow(cut, "shard int, dealt boolean, known boolean, rid long, first long, piece binary")
    answer = pa.schema([("rid", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("digest", pa.binary()), ("sure", pa.bool_())])

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rid", "ascending"), ("first", "ascending")])  # so that the first place of a class comes first
        raw, rid, first = table.column("piece").to_pylist(), table.column("rid").to_numpy(), table.column("first").to_numpy()
        known, dealt = table.column("known").to_numpy(), table.column("dealt").to_numpy()
        number = classes(raw, width)
        counts = np.array([len(p) - width + 1 for p in raw])
        owner = np.repeat(np.arange(len(raw)), counts)
        _, leads, number, often = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
        sure = often > 1
        if keep_first:
            hit = np.ones(len(number), bool)
            hit[leads] = False
            sure[:] = False
        else:
            sure[number[known[owner]]] = True
            hit = sure[number] & ~known[owner]
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        out: list[list] = [[], [], [], [], []]

        def put(k: int, a: int, b: int, digest, is_sure: bool) -> None:
            for c, v in zip(out, (int(rid[k]), int(first[k]) + a, int(first[k]) + b, digest, is_sure)):
                c.append(v)

        ends = np.cumsum(counts)
        for k in range(len(raw)):
            a, b = _spans(hit[ends[k] - counts[k] : ends[k]])
            for x, y in zip(a.tolist(), b.tolist()):
                put(k, x, y, None, True)
        # windows of dealt anchors: the first of each class goes on to meet those of other shards
        for w in leads[dealt[owner[leads]]].tolist():
            k, x = int(owner[w]), int(offset[w])
            put(k, x, x, hashlib.blake2b(raw[k][x : x + width], digest_size=16).digest(), bool(sure[number[w]]))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, answer.types)], schema=answer)

    judged = staged(pieces.groupBy("shard").applyInArrow(judge, "rid long, first long, last long, digest binary, sure boolean"), "judged")

    def meet(batches):
        """Digests of a part, sorted; those found twice are repeated, in all shards that hold them (but for the first)."""
        held_ = list(batches)
        if not sum(b.num_rows for b in held_):
            return
        t = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=answer) for b in held_]).sort_by([("rid", "ascending"), ("first", "ascending")])
        d = np.array([x for x in t.column("digest").to_pylist()], "S16")
        order = np.argsort(d, kind="stable")
        ranked = d[order]
        left = np.searchsorted(ranked, d, "left")
        goes = np.searchsorted(ranked, d, "right") - left > 1
        goes &= order[left] != np.arange(len(d)) if keep_first else ~t.column("sure").to_numpy()
        yield from t.filter(pa.array(goes)).to_batches()

    apart = judged.where("digest is not null")
    far = parts(apart.count(), 500_000)
    met = apart.repartition(far, "digest").mapInArrow(meet, judged.schema)
    found = whole.unionByName(judged.where("digest is null").select("rid", "first", "last")).unionByName(met.select("rid", "first", "last"))
    found = staged(found, "repeats")
    drop(seen, content, *sides, asked_from, judged)
    return found


def _merged(asks: list[dict], width: int) -> list[tuple[int, int]]:
    """Byte spans covered by windows, ascending and apart."""
    spans: list[list[int]] = []
    for a, b in sorted((x["first"], x["last"] + width) for x in asks):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def _held(docs: DataFrame, rows_a_part: int) -> DataFrame:
    """The one copy of the rows that is written: ``rid``, ``row`` (all columns but the text) and ``text``, bucketed by ``rid``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    spare = "_" * (1 + max(map(len, docs.columns)))  # a struct needs a field
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*others, F.lit(0).alias(spare)).alias("row"), F.col("text").cast("string").alias("text"))
    return bucketed(rows, "texts", parts(docs.count(), rows_a_part, 6), "rid")


def judged_texts(held: DataFrame, found: DataFrame, width: int = 400) -> DataFrame:
    """``row, text, kept (binary, null: nothing goes), n_bytes, n_removed, n_spans, kept_sha256`` of the rows of ``held``."""
    asks = found.groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("asks"))  # windows of one text
    added = {"kept": "binary", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    joined = held.join(asks, "rid", "left").select("row", "text", "asks")

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone = _merged(spans or [], width)
                kept = b"".join(raw[a:b] for a, b in zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), len(raw)]))
                out.append((kept if gone else None, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), t) for c, t in zip(zip(*out), types))], names=["row", "text", *added])

    return joined.mapInArrow(run, widened(joined.drop("asks"), **added))


def removal_report(docs: DataFrame, width: int = 400, rows_a_part: int = 4000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, by the first rule."""
    held = _held(docs.select("doc_id", "text"), rows_a_part)
    return judged_texts(held, repeats(held, width), width).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, width: int = 400, keep_first: bool = False, drop_empty: bool = False, rows_a_part: int = 4000) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; characters cut in two go as a whole.

    ``drop_empty``: rows of which nothing is left go (those that were empty before stay).
    """
    held = _held(docs, rows_a_part)
    cut = judged_texts(held, repeats(held, width, keep_first), width).select("row", "text", "kept")
    texts = cut.mapInArrow(_decoded, widened(cut.drop("kept"), emptied="boolean"))
    if drop_empty:
        texts = texts.where("not emptied")
    return texts.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def _decoded(batches):
    for b in batches:
        old, kept = b.column(1).to_pylist(), b.column(2).to_pylist()
        text = [t if k is None else k.decode("utf-8", "ignore") for t, k in zip(old, kept)]
        emptied = [k is not None and not t for t, k in zip(text, kept)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(emptied, pa.bool_())], names=["row", "text", "emptied"])
