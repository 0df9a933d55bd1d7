"""Whitening, first-fit packing and hard negatives against brute force, and on odd rows."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("quarry.llm")

from pyspark.sql import functions as F  # noqa: E402

from quarry.llm import firstfit, negatives, whitening  # noqa: E402
from quarry.llm.queries import queries, vocabulary  # noqa: E402
from quarry.llm.tokens import WordEncoder  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, n int, x string, rid string, w int, dim string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, "x", "y", 2, "z") for i, v, k in rows], VECTORS).repartition(3)


ODD = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan"), 1.0], 1), (903, [float("inf"), 0.0], 2), (904, [], 3)]


# --- whitening ---


def test_whitening_is_that_of_numpy(spark, sf):
    got = queries()["op11_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect())
    x = np.floor(256 * np.array([r["embedding"] for r in rows], float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    want = (x - s / n) @ u[:, ::-1][:, :4] / np.sqrt(e[::-1][:4])
    assert len(got) == 4 * len(x) and got["vec_id"].tolist() == np.repeat([r["vec_id"] for r in rows], 4).tolist()
    w = got["whitened"].to_numpy().reshape(-1, 4)
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-9
    assert (got["n"] == n).all() and (got["deviation"].to_numpy().reshape(-1, 4) == ((n * x - s) ** 2).sum(1)[:, None]).all()
    assert np.abs(got["explained"].to_numpy()[:4] - e[::-1][:4] / e.sum()).max() < 1e-12
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_counts_each_distinct_vector_once(spark):
    """A hot vector weighs as any other; odd rows are dropped; lengths are lists of their own."""
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [-1.0, -3.0], 0), (5, [2.0, 2.0, 2.0], 0), (None, [0.0, -0.0], None)] + [(10 + k, [1.0, 0.0], 1) for k in range(50)]
    got = whitening.whiten(vectors(spark, rows + ODD)).collect()
    two = [r for r in got if r["n"] == 4]
    assert len(two) == 2 * 54 and {r["component"] for r in two} == {1, 2} and None in {r["vec_id"] for r in two}
    fit = np.array([[256, 0], [0, 256], [-256, -768], [0, 0]])
    by = {(r["vec_id"], r["component"]): r for r in two}
    sums = fit.sum(0)
    assert all(int(by[v, 1]["deviation"]) == int(((4 * fit[k] - sums) ** 2).sum()) for k, v in enumerate([1, 2, 3, None]))
    assert by[10, 1]["whitened"] == by[59, 1]["whitened"] == by[1, 1]["whitened"]
    assert max(r["identity_error"] for r in two) < 1e-9
    alone = [r for r in got if r["n"] == 1]  # one distinct vector has no variance
    assert [(r["vec_id"], r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in alone] == [(5, None, 0.0, 0, None)] * 3
    assert whitening.whiten(vectors(spark, ODD)).count() == whitening.whiten(vectors(spark, [])).count() == 0


def test_whitening_of_large_numbers_is_exact(spark):
    rows = [(1, [3e9, 1.0], 0), (2, [-3e9, 2.0], 0), (3, [1.5e9, 7.0], 0)]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(vectors(spark, rows)).where("component = 1").collect()}
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v, _ in rows]
    s = [sum(c) for c in zip(*x)]
    assert got == {k + 1: sum((3 * c - t) ** 2 for c, t in zip(v, s)) for k, v in enumerate(x)} and max(got.values()) > 1 << 63
    d = whitening.deviations(np.array([[1 << 61, -5]]), 9, [3, 4])
    assert d.tolist() == [[9 * (1 << 61) - 3, -49]] and whitening.squares(d).tolist() == [(9 * (1 << 61) - 3) ** 2 + 49**2]


# --- first fit ---


def test_first_fit_by_the_tree_is_first_fit():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array([rng.randrange(1, 100) for _ in range(rng.randrange(1, 80))])
        rooms, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((b for b, r in enumerate(rooms) if r >= lengths[i]), len(rooms))
            if b == len(rooms):
                rooms.append(100)
                want.append([])
            rooms[b] -= lengths[i]
            want[b].append(i)
        assert firstfit.first_fit_decreasing(lengths, 100) == want
        pieces = firstfit.closed(want, lengths, 128)
        assert sorted(p for s in pieces for p in s) == sorted({p for s in pieces for p in s})
        held = {}
        for i, x, y in sorted(p for s in pieces for p in s):
            assert x == held.get(i, 0) and y > x
            held[i] = y
        assert held == dict(enumerate(lengths.tolist()))
        fills = [sum(y - x for _, x, y in s) for s in pieces]
        assert all(f <= 128 and f & (f - 1) == 0 for f in fills) and sum(f < 128 for f in fills) <= 7 + sum(sum(lengths[b]) in (1, 2, 4, 8, 16, 32, 64) for b in want)


TEXTS = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "no id"), (6, "é😀 \n\n x"), (7, "word " * 6000), (8, "<|endoftext|> of"), *((100 + k, "some words " * (k % 90)) for k in range(300))]


def packed(spark, rows, **k):
    docs = spark.createDataFrame([(d, t, "a", "b", 1, 2) for d, t in rows], "doc_id long, text string, at string, grp string, length int, ids int").repartition(3)
    return firstfit.pack_documents(docs, vocabulary("byte_bpe_50k.json"), **k).collect()


def test_packing_holds_every_id_once(spark, monkeypatch):
    enc = WordEncoder(vocabulary("byte_bpe_50k.json"))
    for groups in (1 << 22, 5000):
        monkeypatch.setattr(firstfit, "GROUP_TOKENS", groups)
        got = packed(spark, TEXTS, capacity=256)
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], []).append(r)
        want = {}
        for d, t in TEXTS:
            want.setdefault(d, []).append(np.array([*enc.ids(t or ""), 0], "<u4"))
        for d, texts in want.items():
            for r in by[d]:  # rows of one id have one text here
                assert r["doc_tokens"] == len(texts[0]) and bytes(r["ids"]) == texts[0][r["start"] : r["start"] + r["length"]].tobytes()
            assert sum(r["length"] for r in by[d]) == sum(map(len, texts))
            assert len(texts) > 1 or sorted((r["start"], r["length"]) for r in by[d])[-1][0] == max(r["start"] for r in by[d])
        fill = {}
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == fill.get(r["sequence_id"], 0)
            fill[r["sequence_id"]] = r["offset"] + r["length"]
        assert all(0 < f <= 256 and f & (f - 1) == 0 for f in fill.values())  # no padding at all
    assert packed(spark, []) == []


def test_registered_packing(spark, sf):
    rows = queries()["op12_firstfit"](spark, sf).collect()
    enc = WordEncoder(vocabulary("byte_bpe_50k.json"))
    ids = {r["doc_id"]: np.array([*enc.ids(r["text"] or ""), 0], "<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(own)
        at[r["doc_id"]] += r["length"]
    assert at == {d: len(v) for d, v in ids.items()}


# --- hard negatives ---


def brute(rows, anchor, k=5, m=5, pct=80):
    whole, seen = [], set()
    for i, v, c in rows:
        if i is None or c is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = tuple(int(np.floor(256 * float(np.float32(a)))) for a in v)
        if (i, c, x) not in seen:
            seen.add((i, c, x))
            whole.append((i, c, x))
    out = []
    for i, c, x in whole:
        if not anchor(i):
            continue
        others = [(-sum(a * b for a, b in zip(x, y)), j, d == c) for j, d, y in whole if len(y) == len(x) and (j, d, y) != (i, c, x)]
        for s, j, _ in sorted(o for o in others if o[2])[:k]:
            found = sorted((t, o) for t, o, same in others if not same and pct * -s <= 100 * -t <= 100 * -s)
            out += [(i, j, n + 1, o, -s, -t) for n, (t, o) in enumerate(found[:m])]
    return sorted(out)


def mined(spark, rows, anchor="vec_id % 3 = 0", **k):
    return sorted(tuple(r) for r in negatives.mine(vectors(spark, rows), F.expr(anchor), **k).collect())


def test_negatives_are_those_of_brute_force(spark, monkeypatch):
    """Ties, copies of one vector in most rows, ids far apart, one-bit digits, tiny blocks: the same rows."""
    rng = np.random.default_rng(5)
    near = [(int(i), (np.array([1.0, 0.5, 0.2, 0.1]) + rng.normal(0, 0.2, 4)).tolist(), int(rng.integers(3))) for i in range(70)]
    hot = [(int(i), [0.5, 0.5, 0.25, 0.0], int(i) % 2) for i in rng.permutation(200)[:120]]
    far = [(-(1 << 62), [0.5, 0.5, 0.25, 0.0], 1), (1 << 62, [0.5, 0.5, 0.25, 0.0], 0), (3, [0.5, 0.5, 0.25, 0.0], 0), (3, [0.5, 0.5, 0.25, 0.0], 0), (6, [1.0, 1.0], 0), (7, [1.0, 0.9], 0), (8, [1.0, 0.85], 1), (None, [1.0, 1.0], 0), (11, [1.0, 1.0], None), (12, [-1.0, 0.0], 5), (15, [1.0, 0.0], 5)]
    for rows in (near, hot + far + ODD):
        want = brute(rows, lambda i: i % 3 == 0)
        assert want and mined(spark, rows) == want
    monkeypatch.setattr(negatives, "DIGIT", 4)
    monkeypatch.setattr(negatives, "SLACK", 1)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 1024)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 512)
    rows = near[:30] + hot[:60] + far + ODD
    assert mined(spark, rows, positives=2, negatives=3) == brute(rows, lambda i: i % 3 == 0, 2, 3)
    assert mined(spark, []) == mined(spark, ODD) == mined(spark, [(3, [1.0], 1)]) == []


def test_scores_are_exact():
    a = np.array([[3_000_000_019, 5]], np.int64)
    assert negatives.scores(a, np.array([[1_000_000_007, 2], [1, -1]], np.int64)).tolist() == [[3_000_000_019 * 1_000_000_007 + 10, 3_000_000_014]]
    assert negatives.shift(0, 4095) == 0 and negatives.shift(0, 4096) == 1 and negatives.shift(-(1 << 63), (1 << 63) - 1) == 52


def test_blocks_meet_without_broadcast(spark):
    """Copies of the anchors for each block of rows are not sent to the driver, however small their table seems."""
    rows = negatives.quantised(vectors(spark, [(k, [float(k), 1.0], k % 2) for k in range(20)]), F.col("label"), 1)
    held = rows.select("rid", *[F.lit(v).cast(t).alias(c) for c, t, v in (("w", "int", 0), ("low", "long", 0), ("high", "long", 9), ("top", "long", 9), ("id_low", "long", 0), ("id_high", "long", 9), ("above", "long", 0), ("settled", "boolean", False))])
    plan = negatives.Blocks(rows).pairs(rows, 20, held)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [dim" in plan
