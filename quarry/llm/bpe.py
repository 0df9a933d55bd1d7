"""Byte-level BPE with Spark's higher-order functions, and decoding.

Texts are cut to words by the vocabulary's pattern. Words that are tokens stand for
themselves. The other distinct words of a block of texts get numbers; documents
refer to them by number. All blocks' words meet by their bytes, so that each becomes
an array of its bytes' ids once, and a fold over that array merges its lowest-ranked
adjacent pair, step by step, until none is left. Ranks are looked up in a literal map
from id pairs: one array of offsets by left id, one of entries at offset plus right
id. The ids of the words go back to their blocks, where documents are put together.
Decoding concatenates the binary pieces of the ids.

A word that occurs in very many blocks is folded once for each ``BLOCKS`` of them, so
that no group grows with the corpus. Words over ``LONG`` bytes would make the fold
quadratic: they are merged with a heap, to the same ids.

Defined results: null text counts as empty (no ids, digests of the empty string);
rows repeat as given, with null ``doc_id`` too; special tokens' names in a text are
ordinary text; very long texts and words are encoded whole; of equally ranked pairs
the leftmost merges first; an empty table gives no rows; other columns, whatever
their names, are never read. A vocabulary of more than 65,536 ids is an error, and so are
some 12,000,000 distinct words beyond the vocabulary within the texts of one Arrow batch
(1,000 texts, or one that is very long).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bucketed, parts, small_batches, staged

#: Characters of text, and distinct words that are no tokens, that share one list of words.
BLOCK, WORDS = 40_000_000, 1 << 22
#: Ids of a vocabulary, which ranks and references leave room for, and references of a block.
IDS, REFS = 1 << 16, 1 << 24
#: Blocks whose words share one fold, and the longest word (bytes) that is folded.
BLOCKS, LONG = 1000, 200
#: Letters under this code point were letters in every edition of Unicode.
_OLD = "ɐ"
#: Marks that make a word of their own after letters. No apostrophe (it makes one with letters).
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def mergeable(ranks: dict[bytes, int]) -> dict[int, dict[int, int]]:
    """By left id, then right id: the rank of the token that the two make."""
    pairs: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                pairs.setdefault(a, {})[b] = rank
    return pairs


class PairMap:
    """A literal map from id pairs to ranks: ``entries[offsets[left] + right]`` is ``left << 16 | rank``.

    Rows of one left id, the longest first, are laid over each other where they leave no two
    entries in one place (row displacement).
    """

    def __init__(self, ranks: dict[bytes, int]):
        pairs = mergeable(ranks)
        n = max(ranks.values()) + 1
        if n > IDS:
            raise ValueError(f"{n} ids; {IDS} at most")
        size = 8 * sum(map(len, pairs.values())) + 2 * n + 4096
        self.entries, taken = np.full(size, -1), np.zeros(size, bool)  # -1: free, and the pair of no id
        self.offsets = np.full(n, size, np.int64)  # beyond the end: no pair
        at = 0  # longer rows have filled what lies before
        rows = sorted(((left, np.array(sorted(row))) for left, row in pairs.items()), key=lambda r: (-len(r[1]), r[0]))
        for left, right in rows:
            if len(right) > 1:
                while True:
                    clash = taken[(at + np.arange(64))[:, None] + (right - right[0])[None, :]].any(1)
                    if not clash.all():
                        at += int(np.flatnonzero(~clash)[0])
                        break
                    at += 64
                place = at + right - right[0]
                taken[place] = True
                self.entries[place] = left << 16 | np.array([pairs[left][b] for b in right.tolist()])
                self.offsets[left] = at - int(right[0])
        alone = [(left, int(right[0])) for left, right in rows if len(right) == 1]
        for (left, right), place in zip(alone, np.flatnonzero(~taken)[: len(alone)].tolist()):  # rows of one fill what is free
            taken[place] = True
            self.entries[place] = left << 16 | pairs[left][right]
            self.offsets[left] = place - right
        self.entries = self.entries[: int(np.flatnonzero(taken)[-1]) + 1 if pairs else 1]

    def key(self, a: Column, b: Column) -> Column:
        """Under 65,536: the rank of two adjacent ids' token. Greater, or null: there is none.

        The literals go to every task, element by element: free places are null, which takes the least
        room, and each stands in the expression once.
        """
        entries = [None if e < 0 else e + IDS for e in self.entries.tolist()]  # left + 1, so that none is 0
        offsets = [None if o >= len(entries) else o for o in self.offsets.tolist()]
        held, starts = (F.from_json(F.lit(json.dumps(t)), kind) for t, kind in ((entries, "array<bigint>"), (offsets, "array<int>")))
        return F.get(held, F.get(starts, a) + b).bitwiseXOR(F.shiftleft(a.cast("bigint") + 1, 16))


def merged(word: Column, table: PairMap) -> Column:
    """Fold the ranked merges over an array of ids of single bytes."""

    def step(ids: Column, _: Column) -> Column:
        # ranks with their places in the low bits, so that the least one names both
        ranked = F.transform(ids, lambda a, i: F.shiftleft(table.key(a, F.get(ids, i + 1)), 16) + i)

        def merge(least: Column) -> Column:
            at, rank = least.bitwiseAND(F.lit(65535)).cast("int"), F.shiftright(least, 16).cast("int")
            return F.when(least < IDS << 16, F.concat(F.slice(ids, F.lit(1), at), F.array(rank), F.slice(ids, at + 3, F.size(ids)))).otherwise(ids)

        return F.get(F.transform(F.array(F.array_min(ranked)), merge), F.lit(0))

    return F.aggregate(F.slice(word, 2, 1 << 30), word, step)


def merged_long(ids: list[int], pairs: dict[int, dict[int, int]]) -> list[int]:
    """The same merges of a long word: pairs wait in a heap by rank and place."""
    n = len(ids)
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def push(i: int) -> None:
        if i >= 0 and after[i] < n:
            rank = pairs.get(ids[i], {}).get(ids[after[i]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

    for i in range(n - 1):
        push(i)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue  # one of the two has merged meanwhile
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        push(before[i])
        push(i)
    return [x for x in ids if x >= 0]


def _planes(refs: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The three low bytes of each text's references, all lowest ones first: files take half the room."""
    low, mid, high = ((refs >> shift).astype(np.uint8).tobytes() for shift in (0, 8, 16))
    return [low[x:y] + mid[x:y] + high[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _from_planes(raw: bytes) -> np.ndarray:
    low, mid, high = np.frombuffer(raw, np.uint8).reshape(3, -1).astype(np.int32)
    return low | mid << 8 | high << 16


ROWS = "block long, doc_id long, refs binary, number int, bytes array<tinyint>, ids array<int>"
_SCHEMA = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("refs", pa.binary()), ("number", pa.int32()), ("bytes", pa.list_(pa.int8())), ("ids", pa.list_(pa.int32()))])


def _lists(parts_: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts_)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array([x for p in parts_ for x in p], np.int32)))


class Cutter:
    """Word references of texts: a token's id, or ``first`` plus the number of another word of this block.

    Texts are cut at their spaces, and equal pieces of a batch found, in Arrow. A piece is resolved once a
    block, and its references are laid out by position. Letters, marks after letters and line breaks
    between them are told apart without the pattern.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.first = max(ranks.values()) + 1
        self.ranks = {}
        for token, rank in ranks.items():
            try:
                self.ranks[token.decode()] = rank
            except UnicodeDecodeError:  # part of a character, so no word of its own
                pass
        self.clear()

    def clear(self) -> None:
        self.known = dict(self.ranks)
        self.words: list[str] = []  # in the order of their numbers
        self.seen: dict[str, int] = {}  # pieces after a space, numbered
        self.flat, self.ends = array("i"), array("q", [0])  # their references, one after the other
        self.alone = bytearray()  # 0: the piece can't stand alone

    def ref(self, word: str) -> int:
        r = self.known.get(word)
        if r is None:
            self.known[word] = r = self.first + len(self.words)
            self.words.append(word)
        return r

    def atom(self, p: str, lead: str) -> list[int]:
        """References of a part with no white space at its ends, ``lead`` before it."""
        core = p.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or max(core) < _OLD):
            return [self.ref(lead + core)] if len(core) == len(p) else [self.ref(lead + core), self.ref(p[len(core) :])]
        return list(map(self.ref, self.find(lead + p)))

    def piece(self, p: str) -> list[int] | None:
        """References of what follows a single space; None if it can't stand alone."""
        if not p or p[0].isspace() or p[-1].isspace():
            return None
        if "\n" not in p:
            return self.atom(p, " ")
        lines = p.split("\n")
        if any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            return list(map(self.ref, self.find(" " + p)))
        out = self.atom(lines[0], " ")
        for x in lines[1:]:
            out.append(self.ref("\n"))
            out += self.atom(x, "")
        return out

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """References of all texts, one after the other, and where each text's begin, with the end (null: empty)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        split = pc.split_pattern(texts, " ")
        bounds, code = np.asarray(split.offsets), split.values.dictionary_encode()
        names, code = code.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(code.indices)
        inner = np.ones(len(code), bool)
        inner[bounds[:-1]] = False
        used = np.flatnonzero(np.bincount(code[inner], minlength=len(names)))
        pieces = [names[k] for k in used.tolist()]
        seen, flat, ends, alone = self.seen, self.flat, self.ends, self.alone
        for p in pieces:
            if p not in seen:
                seen[p] = len(seen)
                if p.isalpha() and (p.isascii() or max(p) < _OLD):  # most are: no list for them
                    flat.append(self.ref(" " + p))
                    alone.append(1)
                else:
                    refs = self.piece(p)
                    flat.extend(refs or ())
                    alone.append(refs is not None)
                ends.append(len(flat))
        place = np.zeros(len(names), np.int64)
        place[used] = list(map(seen.__getitem__, pieces))
        at = place[code]
        # openings, and texts with a piece that can't stand alone, are resolved one by one and numbered after the pieces
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(bounds, np.flatnonzero(inner)[np.frombuffer(bytes(alone), np.uint8)[at[inner]] == 0], "right") - 1] = True
        opened = []
        for k, c in enumerate(code[bounds[:-1]].tolist()):
            head = names[c]
            if whole[k] or head[-1:].isspace():
                whole[k], head = True, texts[k].as_py()
            opened.append(list(map(self.ref, self.find(head))))
        at[bounds[:-1]] = len(seen) + np.arange(len(texts))
        own = np.cumsum([len(flat), *map(len, opened)])
        begin = np.concatenate([np.array(ends)[:-1], own[:-1]])
        size = np.concatenate([np.diff(np.array(ends)), np.diff(own)])
        n = size[at]
        n[inner & np.repeat(whole, np.diff(bounds))] = 0
        upto = np.append(0, np.cumsum(n))
        every = np.concatenate([np.array(flat, np.int32), np.array([r for refs in opened for r in refs], np.int32)])
        return every[np.repeat(begin[at] - upto[:-1], n) + np.arange(upto[-1])], upto[bounds]


def _cut_to_blocks(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block: int) -> DataFrame:
    """Rows of documents (``block, doc_id, refs``) and of the words they refer to (``block, number``, and
    ``bytes``, or ``ids`` if long)."""
    single = [ranks[bytes([b])] for b in range(256)]

    def run(batches):
        cutter, size = Cutter(ranks, pattern), 0
        pairs: dict = {}
        at = TaskContext.get().partitionId() << 24

        def words():
            if cutter.first + len(cutter.words) > REFS:
                raise ValueError(f"one text has {len(cutter.words)} distinct words that are no tokens")
            raw = pa.array(cutter.words, pa.large_string()).cast(pa.large_binary())
            is_long = pc.greater(pc.binary_length(raw), LONG)
            order = pc.sort_indices(raw)  # like words side by side pack well
            order = order.filter(pc.invert(is_long.take(order)))
            for lo in range(0, len(order), 20_000):
                own = order[lo : lo + 20_000]
                like = raw.take(own).cast(pa.binary())
                _, ends, data = like.buffers()
                flat = pa.Array.from_buffers(pa.int8(), len(data) if data else 0, [None, data])
                yield batch(len(own), number=own.cast(pa.int32()), bytes=pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(own) + 1, [None, ends]), flat))
            long = np.flatnonzero(np.asarray(is_long)).tolist()
            if long and not pairs:
                pairs.update(mergeable(ranks))
            if long:
                yield batch(len(long), number=pa.array(long, pa.int32()), ids=_lists([merged_long([single[b] for b in raw[k].as_py()], pairs) for k in long]))

        def batch(n: int, **cols) -> pa.RecordBatch:
            cols["block"] = pa.array(np.full(n, at))
            return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)

        for b in batches:
            yield batch(b.num_rows, doc_id=b.column(0), refs=pa.array(_planes(*cutter.cut(b.column(1))), pa.binary()))
            size += pc.sum(pc.utf8_length(b.column(1))).as_py() or 0
            if size >= block or len(cutter.words) >= WORDS:
                yield from words()
                cutter.clear()
                at, size = at + 1, 0
        yield from words()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    small_batches(docs.sparkSession)
    ranks = load_ranks(path)
    n_blocks = parts(docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0, block)
    held = bucketed(_cut_to_blocks(docs, ranks, pattern, block), "words", min(20_000, 4 * n_blocks), "block", moved=False)
    single = F.array(*[F.lit(ranks[bytes([b])]) for b in range(256)])
    word = F.transform("bytes", lambda b: F.get(single, F.pmod(b.cast("int"), F.lit(256))))
    short = held.where("bytes is not null").select("block", "number", "bytes").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(parts(n_blocks, BLOCKS))))
    same = Window.partitionBy("bytes", "salt").orderBy("block")
    short = short.withColumn("nth", F.row_number().over(same)).withColumn("folded", F.when(F.col("nth") == 1, merged(word, PairMap(ranks))))
    short = short.withColumn("ids", F.first("folded", True).over(same.rowsBetween(Window.unboundedPreceding, 0)))
    words = short.select("block", "number", "ids").unionByName(held.where("ids is not null").select("block", "number", "ids"))
    words = staged(words.withColumn("ids", F.transform("ids", lambda t: (t - 32768).cast("smallint"))), "word-ids", "zstd")
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token

    def assemble(texts: pa.Table, own: pa.Table) -> pa.Table:
        n = len(pieces)
        number, lists = own.column("number").to_numpy(), own.column("ids").combine_chunks()
        ends = np.asarray(lists.offsets).astype(np.int64)
        flat = pa.array(np.asarray(lists.flatten()).astype(np.int32) + 32768)
        ends -= ends[0] if len(ends) else 0
        place = np.arange(n + len(number))
        place[n + number] = n + np.arange(len(number))
        size = np.append(np.ones(n, np.int64), np.diff(ends))

        def spelt(written: list[bytes]) -> pa.Array:
            """Of each id and word: what its ids are written as, one after the other."""
            ids = pa.array(written, pa.large_binary())
            _, at, data = ids.take(flat).buffers()
            upto = np.frombuffer(at, np.int64)[: len(flat) + 1][ends] if len(flat) else np.zeros(len(number) + 1, np.int64)
            return pa.concat_arrays([ids, pa.Array.from_buffers(pa.large_binary(), len(number), [None, pa.py_buffer(upto.tobytes()), data])])

        def digests(spelling: pa.Array, refs: pa.Array, bounds: np.ndarray, cut: int) -> list[str]:
            """SHA-256 of each text, less ``cut`` bytes at its end."""
            _, at, data = spelling.take(refs).buffers()
            upto = np.frombuffer(at, np.int64)[bounds].tolist() if len(refs) else [0] * len(bounds)
            view = memoryview(data or b"")
            return [hashlib.sha256(view[x : max(x, y - cut)]).hexdigest() for x, y in zip(upto, upto[1:])]

        digits, binary = spelt([b"%d," % k for k in range(n)]), spelt(pieces)
        cols: list[list] = [[], [], [], []]
        for lo in range(0, texts.num_rows, 1000):
            some = texts.slice(lo, 1000)
            refs = [_from_planes(raw) for raw in some.column("refs").to_pylist()]
            bounds = np.cumsum([0, *map(len, refs)])
            at = place[np.concatenate(refs)]
            upto = np.append(0, np.cumsum(size[at]))[bounds]
            cols[0] += some.column("doc_id").to_pylist()
            cols[1] += np.diff(upto).tolist()
            cols[2] += digests(digits, pa.array(at), bounds, 1)
            cols[3] += digests(binary, pa.array(at), bounds, 0)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, out.types)], schema=out)

    texts = held.where("refs is not null").select("block", "doc_id", "refs")
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
