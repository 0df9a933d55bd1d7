"""Whole-text encoding with the public ``tokenizers`` library, remembered by word.

The texts of a batch are cut at their spaces and before their line breaks, and equal
pieces are found, in Arrow. Both vocabularies start a new pre-token there, so the ids of
the pieces, one after the other, are the ids of the text. A piece falls into atoms the
same way: a line break, and ASCII marks after letters. Atoms go through the library, many
in one call, once per worker; pieces are looked up, once a batch, and their ids laid out
by position. Where a cut may change the result (white space at an edge, the name of a
special token anywhere), the whole text goes to the library. What a worker has seen before
never changes a result: atoms after a space, atoms at the start of a line and whole
pieces are kept in tables of their own.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import kept_in_worker

#: Distinct pieces that one worker remembers, and the longest; others are encoded each time.
REMEMBERED, LONGEST = 500_000, 64
#: Atoms that one call of the library encodes together.
_TOGETHER = 100
#: Letters that every edition of Unicode that a library may carry calls so; lower-casing leaves them one letter (no İ).
_LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+").fullmatch
#: Marks that end a word: a pre-token of their own after letters. No apostrophe (it makes one with letters).
_MARKS = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'


class Pieces:
    """Ids of numbered pieces, one after the other; a size of -1: the text needs the library."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64)

    def joined(self, ids: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of these pieces, and of those after them."""
        sizes = np.array([-1 if x is None else len(x) // 4 for x in ids], np.int64)
        return np.concatenate([self.ids, np.frombuffer(b"".join([x or b"" for x in ids]), "<u4")]), np.concatenate([self.sizes, sizes])


class WordEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.remembered = remembered
        self.spaced = self.ids(" a") != self.ids("a")  # a space belongs to the word after it; else white space is dropped
        self.known = Pieces()  # after a space
        self.first = Pieces()  # openings of texts
        self.after_space: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}
        self.line_break = self.raw("\n")
        names = (self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size()))
        self.opens = np.array([t.startswith("Ġ") for t in names])
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fence = next(c for c in "™♪©ª" if self.spaced or len(self.ids(c)) == 1)
        self.fence_id = self.ids(self.fence)[0]

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def raw(self, text: str | None) -> bytes:
        return np.array(self.ids(text or ""), "<u4").tobytes()

    def _learn(self, words: list[str], after_space: bool, into: dict[str, bytes]) -> None:
        """Ids of atoms, many in one call."""
        own = []
        for w in words:
            if self.fence in w and not self.spaced:
                into[w] = self.raw(w)
            else:
                own.append(w)
        groups = [own[i : i + _TOGETHER] for i in range(0, len(own), _TOGETHER)]
        joined = f" {self.fence} " if not self.spaced else " " if after_space else "\n"
        texts = [(" " if after_space else "") + joined.join(g) for g in groups]
        for g, e in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            if after_space:
                cuts = np.flatnonzero(self.opens[ids])
                ends = np.append(cuts[1:], len(ids))
            else:
                at = np.flatnonzero(ids == (self.ids("\n")[0] if self.spaced else self.fence_id))
                cuts, ends = np.append(0, at + 1), np.append(at, len(ids))
            if len(cuts) != len(g):  # not expected; one at a time stays right
                into.update((w, self.raw(" " * after_space + w)) for w in g)
                continue
            flat = ids.tobytes()
            into.update((w, flat[x:y]) for w, x, y in zip(g, (cuts * 4).tolist(), (ends * 4).tolist()))

    def _resolve(self, plain: list[str], others: list[str], spaced: bool) -> list[bytes | None]:
        """The ids of pieces that are not known yet: ``plain`` ones hold letters alone. ``spaced``: they
        stand after a space, but for those that begin with a line break."""
        spaced &= self.spaced
        words, tails, after = [], [], bytearray()  # flat lists: nothing here for the garbage collector to walk
        for p in others:
            w = p[1:] if p[:1] == "\n" else p
            after.append(spaced and w is p)
            core = w.rstrip(_MARKS)
            if len(core) == len(w) or not _LETTERS(core):
                core = w
            tails.append(w[len(core) :])
            words.append(core)
        if not self.spaced:
            plain, words = ([w.lower() if w.isascii() else w for w in ws] for ws in (plain, words))
        need = ({w for w, x in zip(words, after) if not x}.union(tails), {w for w, x in zip(words, after) if x})
        need[spaced].update(plain)
        tables = []
        for is_after, held in ((False, self.at_start), (True, self.after_space)):
            got: dict[str, bytes] = {}
            self._learn([w for w in need[is_after] if w and w not in held], is_after, got)
            got[""] = b""
            if len(held) < self.remembered:
                held.update((w, v) for w, v in got.items() if len(w) <= LONGEST)
            tables.append(held if all(map(held.__contains__, got)) else {w: got[w] if w in got else held[w] for w in need[is_after] | {""}})
        at_start, after_space = tables
        found: list[bytes | None] = list(map(tables[spaced].__getitem__, plain))
        for p, w, tail, x in zip(others, words, tails, after):
            if not self.spaced:
                ids = at_start[w]
            elif not w:  # nothing between spaces or line breaks
                found.append(None if x or p else b"")
                continue
            elif w[0].isspace() or w[-1].isspace():
                found.append(None)
                continue
            else:
                ids = after_space[w] if x else at_start[w] if p[0] != "\n" else self.line_break + at_start[w]
            found.append(ids + at_start[tail] if tail else ids)
        return found

    def _numbers(self, pieces: list[str], held: Pieces, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each piece, and ids and sizes of all numbers."""
        number = list(map(held.number.get, pieces))
        if None not in number:
            return np.array(number, np.int64), held.ids, held.sizes
        fresh = [p for p, n in zip(pieces, number) if n is None]
        plain, others = [p for p in fresh if p.isalpha()], [p for p in fresh if not p.isalpha()]
        names, ids = plain + others, self._resolve(plain, others, spaced)
        short = len(names)
        if max(map(len, names)) > LONGEST:  # long ones go last, as the first ones are remembered
            order = sorted(range(len(names)), key=lambda k: len(names[k]) > LONGEST)
            names, ids = [names[k] for k in order], [ids[k] for k in order]
            short = sum(len(p) <= LONGEST for p in names)
        first = len(held.sizes)
        own = dict(zip(names, range(first, first + len(names))))
        all_ids, sizes = held.joined(ids)
        most = self.remembered // (1 if held is self.known else 5)  # openings are few
        if room := max(0, min(short, most - first)):
            held.number.update(own if room == len(own) else zip(names[:room], range(first, first + room)))
            held.sizes = sizes[: first + room].copy()
            held.ids = all_ids[: int(np.maximum(held.sizes, 0).sum())].copy()
        return np.array([own[p] if n is None else n for p, n in zip(pieces, number)], np.int64), all_ids, sizes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null counts as empty."""
        if not len(texts):
            return []
        cut = pc.split_pattern(pc.replace_substring(pa.array([t or "" for t in texts], pa.large_string()), "\n", " \n"), " ")
        bounds, code = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        names, code = code.dictionary.to_numpy(zero_copy_only=False).tolist(), code.indices.to_numpy()
        if self.spaced:  # a text's first piece stands after no space
            inner = np.ones(len(code), bool)
            inner[bounds[:-1]] = False
            groups = ((self.known, inner, True), (self.first, bounds[:-1], False))
        else:
            groups = ((self.known, slice(None), False),)
        ids, sizes, at, base = [], [], np.empty(len(code), np.int64), 0
        for held, where, spaced in groups:
            own = code[where]
            used = np.flatnonzero(np.bincount(own, minlength=len(names)))
            number, own_ids, own_sizes = self._numbers([names[k] for k in used.tolist()], held, spaced)
            place = np.zeros(len(names), np.int64)
            place[used] = number + base
            at[where] = place[own]
            ids.append(own_ids)
            sizes.append(own_sizes)
            base += len(own_sizes)
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        length = np.maximum(size, 0)
        begin = np.cumsum(length) - length
        n = length[at]
        upto = np.append(0, np.cumsum(n))
        raw = flat[np.repeat(begin[at] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        done = [raw[x:y] for x, y in zip((4 * upto[bounds[:-1]]).tolist(), (4 * upto[bounds[1:]]).tolist())]
        unsure = set((np.searchsorted(bounds, np.flatnonzero(size[at] < 0), "right") - 1).tolist())
        unsure.update(k for k, t in enumerate(texts) if t and any(s in t for s in self.special))
        for k in unsure:
            done[k] = self.raw(texts[k])
        return done


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and worker process."""
    held = kept_in_worker(f"tokens {path}")
    if not held:
        held["encoder"] = WordEncoder(path)
    return held["encoder"]
