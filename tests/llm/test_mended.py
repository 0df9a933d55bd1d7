"""Pairs that are none, marks in texts, and tables of runs side by side."""

import hashlib
import random
import string
import threading
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("quarry.llm")

from quarry.llm import bpe, shared  # noqa: E402
from quarry.llm.queries import vocabulary  # noqa: E402


def found(t: bpe.PairMap, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank that the map gives for pairs, as the column expression does; -1: none."""
    at = t.offsets[a] + b
    inside = (at >= 0) & (at < len(t.entries))
    e = np.where(inside, t.entries[np.where(inside, at, 0)], -1)
    return np.where((e >> 16) == a, e & 65535, -1)


def test_no_pair_but_the_vocabularys():
    """Every right id beside id 0, the bytes beside all ids, and random pairs."""
    ranks = bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    t, pairs, n = bpe.PairMap(ranks), bpe.mergeable(ranks), max(ranks.values()) + 1
    rng = np.random.default_rng(1)
    every, low = np.arange(n), np.arange(256)
    asked = [(np.zeros(n, int), every), (every, np.zeros(n, int)), (np.repeat(low, 256), np.tile(low, 256)), (rng.integers(0, n, 400_000), rng.integers(0, n, 400_000))]
    for a, b in asked:
        want = [pairs.get(x, {}).get(y, -1) for x, y in zip(a.tolist(), b.tolist())]
        assert found(t, a, b).tolist() == want
    with pytest.raises(ValueError, match="65537 ids"):
        bpe.PairMap({b"a": 0, b"b": 65536})


def test_bpe_of_marks(spark):
    """20,000 short texts over printable ASCII, half of them marks, against tiktoken."""
    import public_tokenizers
    import tiktoken

    path, rng = vocabulary("byte_bpe_multi_50k.tiktoken"), random.Random(9)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = ["wow!;", "!-x", "!/", "!~", "hello !%", "foo !$ bar", *(f"{a}{b}" for a in string.punctuation for b in string.punctuation)]
    texts += ["".join(rng.choice(string.punctuation + "!!!!" if rng.random() < 0.5 else string.printable) for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = bpe.encode_and_decode(rows, path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        ids = enc.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), repr(t)
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_cuts_as_the_pattern_does():
    """20,000 odd texts in batches; the pattern is asked for openings only where letters, marks and line breaks do."""
    import public_tokenizers
    import pyarrow as pa
    import regex

    ranks, rng = bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken")), random.Random(5)
    find = regex.compile(public_tokenizers.PATTERN).findall
    cutter = bpe.Cutter(ranks, public_tokenizers.PATTERN)
    token = {v: k for k, v in cutter.ranks.items()}
    odd = ["a", "foo", "é", "ß", "'s", "don't", "\n", "\n\n", "\r\n", " ", "  ", "\t", "!", "...", "42", "ɐ", "한", "e\u0301", "x_y", "'", "\xa0", "\x1c", "\x85", "\u2028", "𝒳", "İ", "ª", "中文"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(12))) for _ in range(20_000)] + [None, "", " ", "\n", "a \nb", "a\n b"]
    for k in range(0, len(texts), 700):
        refs, ends = cutter.cut(pa.array(texts[k : k + 700], pa.string()))
        for t, x, y in zip(texts[k : k + 700], ends.tolist(), ends[1:].tolist()):
            assert [token[r] if r < cutter.first else cutter.words[r - cutter.first] for r in refs[x:y].tolist()] == find(t or ""), repr(t)
    cutter.clear()
    asked: list[str] = []
    cutter.find = lambda t: asked.append(t) or find(t)
    cutter.cut(pa.array([" ".join(f"Wort{'abc'[k % 3] * k}.\nZeile, und so!" for k in range(1, 200))] * 3))
    assert len(asked) == 3


def test_bpe_tables_go_to_a_task_once(spark):
    """Each literal of the pair map stands once in the fold; they go to every task, element by element."""
    from pyspark.sql import functions as F

    fold = bpe.merged(F.col("w"), bpe.PairMap({b"a": 0, b"b": 1, b"ab": 2, b"aba": 3}))
    assert str(fold).count("from_json") == 2
    rows = spark.createDataFrame([([0, 1, 0, 1],), ([1, 1, 0],), ([0],), ([],)], "w array<int>").select(fold.alias("ids")).collect()
    assert [r["ids"] for r in rows] == [[2, 2], [1, 1, 0], [0], []]


def test_tables_belong_to_their_run(spark):
    """Two runs in two threads keep their last table each, and leave nothing else; a failed run leaves nothing."""
    made, errors = {}, []

    def path(df):
        return Path(df._own_files[0].removeprefix("file://"))

    def run(name, wait, go):
        try:
            with shared.passing():
                first = shared.staged(spark.range(5), name)
                go.set()
                wait.wait(20)
                last = shared.staged(first.where("id > 2"), name)
            made[name] = (first, last)
        except Exception as e:
            errors.append(e)

    a, b = threading.Event(), threading.Event()
    threads = [threading.Thread(target=run, args=("one", a, b)), threading.Thread(target=run, args=("two", b, a))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    for first, last in made.values():
        assert not path(first).exists() and last.count() == 2
    held = []
    with pytest.raises(RuntimeError), shared.passing():
        held.append(shared.staged(spark.range(3), "failed"))
        raise RuntimeError
    assert not path(held[0]).exists()
    outside = shared.staged(spark.range(3), "outside")
    with shared.passing():
        pass
    assert outside.count() == 3


def test_driver_learns_quality_in_little_memory(spark):
    """3,000 labelled texts: before, the driver's arrays took over 150 MB at once."""
    import tracemalloc

    from pyspark.sql import functions as F

    from quarry.llm import quality

    docs = spark.range(3200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2((F.col("id") + k).cast("string"), 256) for k in range(6)]).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    tracemalloc.start()
    space = quality.train(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert space.known.shape == (3000, quality.DIMENSIONS) and peak < 80e6


def test_leading_axes():
    """The subspace of eigh, for matrices of full and of low rank, of one value and of none."""
    from quarry.llm import quality

    rng = np.random.default_rng(3)
    for rows, size in ((500, 200), (40, 200), (3, 5), (50, 10)):
        x = rng.standard_normal((rows, size)) * np.linspace(3, 0.1, size)
        values, vectors = np.linalg.eigh(x.T @ x)
        n = min(rows, size, 8)
        got = quality.leading_axes(x.T @ x, n)
        assert np.allclose(got.T @ got, np.eye(n)) and np.linalg.svd(vectors[:, ::-1][:, :n].T @ got)[1].min() > 1 - 1e-6
    assert quality.leading_axes(np.zeros((6, 6)), 4).shape == (6, 4)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_with_marks_and_after_line_breaks_are_known(name):
    """Of known words only new marks go to the library; before, each word went again with its marks. Long
    pieces and a full table change nothing."""
    from tokenizers import Tokenizer

    from quarry.llm import tokens

    plain, asked = Tokenizer.from_file(vocabulary(name)), []
    own = tokens.WordEncoder(vocabulary(name), 40)
    learn = own._learn
    own._learn = lambda words, after, into: (asked.extend(words), learn(words, after, into))
    texts = ["one alpha béta gamma\\nalpha\\ngamma".replace("\\n", "\n"), "one alpha!! béta&&& gamma.\ngamma###\nalpha,", "one " + "q" * 70 + " alpha?? béta!!", *(f"one w{k} alpha!!\nw{k}" for k in range(60))]
    for k, t in enumerate(texts):
        asked.clear()
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
        if k == 1:
            assert set(asked) == {"!!", "&&&", ".", "###", ","}
        if k == 2:
            assert set(asked) == {"q" * 70, "??"}
    assert len(own.known.number) == len(own.known.sizes) == 40 and "q" * 70 not in own.known.number
    assert own.encode([]) == [] and own.encode([None, ""]) == [b"", b""]


def test_windows_are_equal_only_if_their_bytes_are():
    """Random repetitive pieces against a dictionary of windows; before, some unequal windows got one number."""
    from quarry.llm import suffix

    rng = random.Random(5)
    for case in range(400):
        width = rng.choice([6, 11, 12, 17, 23, 40])
        some = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(4)]
        pieces = [b"".join(rng.choice(some) for _ in range(rng.randrange(1, 9))) for _ in range(12)]
        pieces = [p for p in pieces if len(p) >= width] or [b"a" * width]
        seen: dict[bytes, int] = {}
        want = [seen.setdefault(p[k : k + width], len(seen)) for p in pieces for k in range(len(p) - width + 1)]
        got: dict[int, int] = {}
        assert [got.setdefault(x, len(got)) for x in suffix.classes(pieces, width).tolist()] == want, case


def test_long_pieces_are_walked_in_parts(monkeypatch):
    """A piece of 60,000 bytes is no walk of 60,000 steps, as before."""
    from quarry.llm import suffix

    walks, plain = [], suffix.common_prefixes
    monkeypatch.setattr(suffix, "common_prefixes", lambda text, order, starts, lengths, most: walks.append(lengths.max()) or plain(text, order, starts, lengths, most))
    rng = random.Random(6)
    some = [rng.randbytes(700).replace(b"\xff", b"x") for _ in range(20)]
    pieces = [b"".join(rng.choice(some) for _ in range(90)), *some]
    seen: dict[bytes, int] = {}
    want = [seen.setdefault(p[k : k + 400], len(seen)) for p in pieces for k in range(len(p) - 399)]
    got: dict[int, int] = {}
    assert [got.setdefault(x, len(got)) for x in suffix.classes(pieces, 400).tolist()] == want
    assert max(walks) <= 1000
