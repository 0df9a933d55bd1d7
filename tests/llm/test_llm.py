"""The training-data operators against brute force, and on nulls, empty and long texts, ties and empty tables."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("quarry.llm")

from pyspark.sql import functions as F  # noqa: E402

from quarry.llm import bpe, langid, links, merkle, packing, pstable, quality, repair, sampling, simhash, suffix, tokens, toxicity  # noqa: E402
from quarry.llm.queries import vocabulary  # noqa: E402

ODD = [(1, None), (2, ""), (3, "a"), (4, "Hello  world\n don't STOP "), (5, "Hello  world\n don't STOP "), (None, "no id"), (6, "é😀 ̈x\t\x1cy　z"), (7, "word " * 6000), (8, "<|endoftext|> of.\nThe end.")]
SCHEMA = "doc_id long, text string, score double, fp string, rid string, row int, part string"


def docs(spark, rows=ODD):
    return spark.createDataFrame([(d, t, 9.0, "x", "y", 3, "z") for d, t in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


VOCABULARIES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
#: Parts of random texts: marks, white space of all kinds, letters that change when lower-cased or composed, special tokens.
PARTS = ["a", "B", "foo", "Bar", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'S", "'t", "'", "İ", "Σ", "ς", "ß", "e\u0301", "é", "\u0301", "한", "\u1112", "\u1161", "1", "²", "½", "Ⅷ", "x1", "™", "ª", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\x1c", "\x85", "\u00a0", "\u3000", "\u180e", "\u200b", "😀", "İ.", "word.", "word,", "Word.\nThe", "--", "K", "ŉ", "\r\n", "\x0b", "...", ".,", "\ufeff", "𝒳", "Ꭰ", "Ა", "ﬁ"]


@pytest.mark.parametrize("remembered", [100_000, 30])
@pytest.mark.parametrize("name", VOCABULARIES)
def test_encoder_is_the_library_however_warm(name, remembered):
    """Random texts, in batches, against the tokenizer as loaded; one encoder for all of them."""
    from tokenizers import Tokenizer

    plain, w, rng = Tokenizer.from_file(vocabulary(name)), tokens.WordEncoder(vocabulary(name), remembered), random.Random(11)
    seen = 0
    while seen < 4000:
        texts = ["".join(rng.choice(PARTS) if rng.random() < 0.7 else rng.choice([" ", "a", "x "]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 30))]
        for t, got in zip(texts, w.encode(texts)):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
        seen += len(texts)
    texts = [t for _, t in ODD] + ["x\nfoo", "a \nfoo", "word. x", "a \t. b", "İ.", "q" * 5000 + " x"]
    for t, got in zip(texts, w.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.4, 30_000) % 900).astype(np.uint32)
    ends = np.array([0, 5, 5, 999, 30_000])
    seq, cut, rules = repair.compress(ids, ends, 1000)
    assert len(seq) < len(ids) and (repair.expand(seq, rules, 1000) == ids).all()
    lo = np.append(0, ends[:-1])
    row = {"begins": np.append(0, cut).astype("<i8").tobytes(), "rules": rules.astype("<u4").tobytes(), "sequence": seq.astype("<u4").tobytes(), "width": 4, "first_rule": 1000}
    for k in range(len(ends)):
        assert (repair.document(row, k) == ids[lo[k] : ends[k]]).all()
    lengths = repair.expansion_lengths(rules, 1000)
    row["rule_lengths"] = lengths.astype("<i8").tobytes()
    for start, stop in [(0, 1), (7, 7), (990, 1010), (0, 30_000), (29_999, 30_000)]:
        assert (repair.tokens(row, start, stop) == ids[start:stop]).all()
    assert (repair.expand_whole(seq, rules, lengths, 1000) == ids).all()
    one = np.full(5000, 7, np.uint32)  # nothing but one id
    seq, _, rules = repair.compress(one, np.array([5000]), 10)
    assert (repair.expand_whole(seq, rules, repair.expansion_lengths(rules, 10), 10) == one).all() and len(seq) < 500
    assert all(lengths[k] == len(repair.expand(np.array([1000 + k]), rules, 1000)) for k in range(0, len(rules), 7))


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.tile(rng.integers(0, 40_000, 300), 30), rng.zipf(1.3, 120_000) % 40_000]).astype(np.uint32)
    ends = np.array([9000, 20_000, len(ids)])
    seq, cut, rules = repair.compress(ids, ends, 40_000)
    pairs = {}
    for lo, hi in zip([0, *cut[:-1]], cut):
        for pair in zip(seq[lo : hi - 1].tolist(), seq[lo + 1 : hi].tolist()):
            pairs[pair] = pairs.get(pair, 0) + 1
    assert max(pairs.values()) < 24 and (repair.expand(seq, rules, 40_000) == ids).all()


def test_id_files(spark, tmp_path):
    path = str(tmp_path / "ids")
    repair.write(docs(spark), path, vocabulary("word_bpe_49k.json"), 1, docs_a_part=3, ids_a_shard=50)
    got = repair.starts(repair.read(spark, path)).collect()
    enc = tokens.WordEncoder(vocabulary("word_bpe_49k.json"))
    at = 0
    for d, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*enc.ids(t or ""), 1]
        want = (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert want in {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got}
        at += len(ids)
    assert len(got) == len(ODD)
    repair.write(empty(spark), path, vocabulary("word_bpe_49k.json"), 1)
    assert repair.starts(repair.read(spark, path)).count() == 0


def test_local_search_beats_best_fit():
    lengths = np.array([6, 6, 5, 5, 5, 4, 4, 3, 2])  # 40 in bins of 10: four do, best fit takes five
    bins = packing.pack(lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[b]) <= 10 for b in bins)
    rng = random.Random(1)
    for _ in range(60):
        n = np.array([rng.randrange(1, 60) for _ in range(40)])
        first, last = packing.best_fit(n, 100), packing.pack(n, 100)
        assert sum((sum(n[b])) ** 2 for b in last) >= sum((sum(n[b])) ** 2 for b in first) and len(last) <= len(first)
        assert sorted(i for b in last for i in b) == list(range(40)) and all(sum(n[b]) <= 100 for b in last)


def test_local_search_leaves_no_step():
    """No move, one-for-one or two-for-one exchange between any two bins raises the sum of squares, by trying all."""
    rng = random.Random(4)
    for _ in range(25):
        n = np.array([rng.choice([rng.randrange(30, 70), rng.randrange(1, 40)]) for _ in range(24)])
        bins = packing.pack(n, 100)
        fill = [int(sum(n[b])) for b in bins]
        if len(bins) == -(-int(n.sum()) // 100):
            continue
        for i, j in ((i, j) for i in range(len(bins)) for j in range(len(bins)) if i != j and fill[i] < 100 and fill[j] < 100):
            gives = [(a,) for a in bins[j]] + [(a, b) for k, a in enumerate(bins[j]) for b in bins[j][k + 1 :]]
            for back in [0, *(int(n[t]) for t in bins[i])]:
                for g in gives:
                    x = int(sum(n[list(g)])) - back
                    after = fill[i] + x
                    assert after > 100 or x <= 0 or after**2 + (fill[j] - x) ** 2 <= fill[i] ** 2 + fill[j] ** 2


def test_packing_of_repeated_rows(spark):
    """A third of the rows are one document: they spread over groups, and each row is packed."""
    found = packing.pieces(docs(spark, [(1, "one same text")] * 40 + [(None, None)] * 20 + [(k, f"text {k}") for k in range(60)]), vocabulary("byte_bpe_50k.json"), 0, 64)
    rows = packing.packed(found, 64, group_rows=10).collect()
    assert len(rows) == 120 and len({r["sequence_id"] >> 32 for r in rows if r["doc_id"] == 1}) > 4


def test_packing(spark):
    got = packing.pack_documents(docs(spark), vocabulary("byte_bpe_50k.json"), capacity=64).collect()
    enc = tokens.WordEncoder(vocabulary("byte_bpe_50k.json"))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in by.values():
        at = 0
        for off, n in sorted(rows):
            assert off == at
            at += n
        assert at <= 64
    ids = [*enc.ids(ODD[7][1]), 0]
    rows = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 7)
    assert sum(n for _, n, _ in rows) == len(ids) and all(n == 64 for _, n, _ in rows[1:])
    assert all(c == zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n, c in rows)
    assert packing.pack_documents(empty(spark), vocabulary("byte_bpe_50k.json")).count() == 0


def test_golay_keys_miss_no_pair():
    rng = np.random.default_rng(5)
    g = simhash.Golay()
    assert all(len(f) in (0, 5) for f in g.fours)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), False)) for _ in a]
    b = a ^ np.array(flips, np.uint64)
    ra, ka = simhash.keys(a, g)
    rb, kb = simhash.keys(b, g)
    own, other = [set() for _ in a], [set() for _ in a]
    for r, k in zip(ra.tolist(), ka.tolist()):
        own[r].add(k)
    for r, k in zip(rb.tolist(), kb.tolist()):
        other[r].add(k)
    assert all(x & y for x, y in zip(own, other))


def brute_fp(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    import xxhash

    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash_groups(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    rows = list(ODD)
    for k in range(60):  # near copies: a word or two changed
        w = list(base)
        for _ in range(k % 3):
            w[rng.randrange(400)] = rng.choice(words)
        rows.append((100 + k, " ".join(w)))
    fps = {d: brute_fp(t) for d, t in rows}
    names = [d for d, _ in rows if d is not None]
    root = {d: d for d in names}
    for a in names:
        for b in names:
            if bin(fps[a] ^ fps[b]).count("1") <= 4 and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert {d: (f"{fps[d]:016x}", root[d]) for d in names} == {d: v for d, v in got.items() if d is not None}
    assert None in got and simhash.near_duplicates(empty(spark)).count() == 0


def test_hot_buckets_in_blocks(spark):
    n = 300
    fps = spark.createDataFrame([(k % 7 | (k // 7) << 40,) for k in range(n)], "fp long").distinct()
    small = links.components(simhash.linked(fps, 4, block=16)).collect()
    large = links.components(simhash.linked(fps, 4, block=4096)).collect()
    assert {tuple(r) for r in small} == {tuple(r) for r in large}


def test_components_of_a_chain(spark):
    rows = [(k, k + 1) for k in range(0, 200)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 1000: 1000, 1001: 1000}


def test_vector_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.03, 0.05, 0.2)])
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0], 1), (904, x[0].tolist(), None), (None, x[0].tolist(), 0), (905, x[0].tolist(), 0), (906, [None] * 16, 0), (907, [1e300] * 16, 2), (908, [1e300] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pstable.near_duplicates(df, block=8).collect() if r["vec_id"] is not None}
    whole = {r[0]: (np.array(r[1]) / np.linalg.norm(np.array(r[1]) / 1e300) / 1e300 if r[0] in (907, 908) else np.array(r[1]) / np.linalg.norm(r[1]), r[2]) for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    links_ = {a: [b for b in whole if b != a and whole[a][1] == whole[b][1] and len(whole[a][0]) == len(whole[b][0]) and whole[a][0] @ whole[b][0] >= 0.98] for a in whole}
    for a in whole:
        assert got[a][0] == len(links_[a]), a
    assert all(got[k] == (0, k, True) for k in (900, 901, 902, 903, 904, 906))
    assert got[908][1] == 907 and pstable.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_one_id(spark):
    """Rows that share an id are vectors of their own: only what links counts."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.01, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, c, 0), (3, a, 1), (5, a, 0), (5, a, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in pstable.near_duplicates(df).collect())
    assert got == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (5, 2, 1, False), (5, 2, 1, False)])


def test_suffix_arrays():
    rng = random.Random(4)
    text = np.array([rng.choice([1, 2, 3]) for _ in range(300)], np.int32)
    order = suffix.suffix_array(text)
    assert order.tolist() == sorted(range(300), key=lambda i: text[i:].tolist())
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 60))) for _ in range(50)]
    windows = [p[k : k + 8] for p in pieces for k in range(len(p) - 7)]
    number = suffix.classes(pieces, 8).tolist()
    assert len({*zip(number, windows)}) == len(set(number)) == len(set(windows))


def test_removal_of_repeats(spark):
    rng = random.Random(6)
    rand = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, rows = rand(500), list(ODD)
    rows += [(100 + k, rand(300) + shared[k * 7 :] + rand(200)) for k in range(14)] + [(200, shared), (201, "ab" * 900), (202, rand(3000)), (203, shared + rand(50) + shared), (300, rand(450)), (301, rows[0][1])]
    rows += [(302, rand(399)), (303, "x" * 400), (304, "x" * 401)]
    seen = {}
    raw = [((t or "").encode(), d) for d, t in rows]
    for b, _ in raw:
        for k in range(len(b) - 399):
            seen[b[k : k + 400]] = seen.get(b[k : k + 400], 0) + 1
    want = []
    for b, d in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        want.append((d, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    kinds = (1_000_000, 3_000_000), (2000, 2000)  # one shard, and anchors dealt to many
    original = suffix.repeats.__defaults__
    try:
        for shard, deal in kinds:
            suffix.repeats.__defaults__ = (400, False, shard, deal)
            got = [tuple(r) for r in suffix.removal_report(docs(spark, rows), rows_a_part=5).collect()]
            assert sorted(got, key=key) == sorted(want, key=key)
        texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
        for shard, deal in kinds:  # the first place stays
            suffix.repeats.__defaults__ = (400, True, shard, deal)
            one = spark.createDataFrame([(d, t, "y") for d, t in rows], "doc_id long, text string, rid string").coalesce(1)
            order = one.collect()
            met, left = set(), {}
            for r in order:
                b = (r["text"] or "").encode()
                gone = bytearray(len(b))
                for k in range(len(b) - 399):
                    if b[k : k + 400] in met:
                        gone[k : k + 400] = b"\1" * 400
                    met.add(b[k : k + 400])
                left[r["doc_id"]] = None if r["text"] is None else bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
            assert texts(suffix.without_repeats(one, 400, True)) == left
            kept = texts(suffix.without_repeats(one, 400, True, drop_empty=True))
            assert kept == {d: t for d, t in left.items() if t != "" or not dict(rows)[d]} and len(kept) < len(left)
    finally:
        suffix.repeats.__defaults__ = original
    kept = suffix.without_repeats(docs(spark, rows))
    assert kept.columns == docs(spark).columns
    by = {r["doc_id"]: r for r in kept.collect()}
    assert by[1]["text"] is None and by[200]["text"] == "" and by[202]["text"] == dict(rows)[202] and by[202]["rid"] == "y"
    assert suffix.removal_report(empty(spark)).count() == 0


def test_merkle(spark):
    rows = sorted(merkle.compare_with_edits(docs(spark)).collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    order = sorted(ODD, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, ((d, t), r) in enumerate(zip(order, rows)):
        t, nx = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert r["doc_id"] == d and r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nx[:half]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[4] == prints[5] and prints[1] == prints[2] and prints[3] != prints[4]
    assert merkle.compare_with_edits(empty(spark)).count() == 0
    two = spark.createDataFrame([("one. two.\nthree four.\nfive.", "one. two.\nthree for.\nfive.")], "a string, b string")
    got = two.select(*[merkle.fingerprint(merkle.sections(F.col(c))).alias(c) for c in "ab"]).select(merkle.differing(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert [(x["section"], x["paragraph"]) for x in got] == [(1, 0)]


def test_merkle_next_over_parts(spark):
    rows = [(k, f"t{k}") for k in range(0, 97, 3)]
    for each in (4, 1, 100):
        got = {r["doc_id"]: r["next"]["text"] for r in merkle.with_next(docs(spark, rows), rows_a_part=each).collect()}
        ids = sorted((d for d, _ in rows), reverse=True)
        assert got == {d: f"t{ids[(k + 1) % len(ids)]}" for k, d in enumerate(ids)}
    rows = [(None, f"n{k}") for k in range(20)] + [(7, f"s{k}") for k in range(20)] + [(-(2**63), "low"), (2**63 - 1, "high")]  # hot ids spread over ranges
    got = [tuple(r) for r in merkle.with_next(in_order(spark, [(d, t, 0.0, "", "", 0, "") for d, t in rows]), rows_a_part=3).collect()]
    order = ["high", *(f"s{k}" for k in range(20)), "low", *(f"n{k}" for k in range(20))]
    assert {t: nx["text"] for _, t, nx in got} == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)}


def test_bpe(spark):
    import public_tokenizers
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = [r for r in ODD] + [(20, "Hello naïve Straßenbahnhaltestelle antidisestablishmentarianism 12345 ∑ßµ 한국어 텍스트  x\n\n y")]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_and_decode(docs(spark, rows), path, public_tokenizers.PATTERN, block=20_000).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_and_decode(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_pair_map_finds_every_pair():
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"aba": 3}
    t = bpe.PairMap(ranks)
    found = {(a, b): int(t.entries[t.offsets[a] + b]) for a in range(4) for b in range(4) if 0 <= t.offsets[a] + b < len(t.entries)}
    assert {(a, b, e & 65535) for (a, b), e in found.items() if e >> 16 == a} == {(0, 1, 2), (2, 0, 3)}
    ranks = bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    t, pairs = bpe.PairMap(ranks), bpe.mergeable(ranks)
    for a, row in pairs.items():
        b = np.array(sorted(row))
        e = t.entries[t.offsets[a] + b]
        assert (e >> 16 == a).all() and (e & 65535).tolist() == [row[x] for x in b.tolist()]
    assert all(t.offsets[a] >= len(t.entries) for a in range(len(t.offsets)) if a not in pairs)


def test_bpe_of_random_and_long_words(spark):
    """Random texts against tiktoken; words of 10 to 60,000 letters, which the fold leaves to a heap."""
    import public_tokenizers
    import tiktoken

    path, rng = vocabulary("byte_bpe_multi_50k.tiktoken"), random.Random(3)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = [(k, "".join(rng.choice(PARTS) if rng.random() < 0.8 else " " for _ in range(rng.randrange(14)))) for k in range(600)]
    rows += [(1000 + k, "".join(rng.choice("abcdeEétz") for _ in range(n))) for k, n in enumerate([10, 199, 200, 201, 999, 60_000])]
    rows += [(2000, "a" * 5000), (2001, "ab" * 130)]
    got = {r["doc_id"]: r for r in bpe.encode_and_decode(docs(spark, rows), path, public_tokenizers.PATTERN, block=30_000).collect()}
    for d, t in rows:
        ids = enc.encode_ordinary(t)
        assert got[d]["n_tokens"] == len(ids) and got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), repr(t)
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def labelled(spark):
    rng = random.Random(7)
    plain, bad = "the quick brown fox jumps over one lazy dog".split(), ["vile"]
    rows, labels = [], []
    for k in range(300):
        s = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(5)]
        toxic = k % 3 == 0
        if toxic:
            s[rng.randrange(5)] += " you vile thing"
        good = k % 2 == 0
        text = ". ".join(s) + "." if good else " ".join(w.upper() + "!!" for w in " ".join(s).split()) + " you vile" * toxic
        rows.append((k, text))
        labels.append((k, int(good), int(toxic)))
    labels += [(None, 1, 1), (9999, 1, 0), (5, None, None)]
    return docs(spark, rows + [(1000, None), (1001, ""), (None, "x"), (1002, "vile " * 9000)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_quality_and_toxicity(spark):
    d, labels, truth = labelled(spark)
    for got, field in ((quality.classify(d, labels), 1), (toxicity.classify(d, labels), 2)):
        rows = got.collect()
        assert len(rows) == 304 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
        by = {r["doc_id"]: r for r in rows}
        want = {t[0]: t[field] for t in truth[:300]}
        held = [k for k in want if by[k]["held_out"]]
        assert held and sum(by[k]["predicted"] == want[k] for k in held) >= 0.97 * len(held)
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.classify(d, none).collect()} == {0.0}
    assert {r["score"] for r in quality.classify(d, none).collect()} == {0.5}
    assert quality.classify(empty(spark), labels).count() == 0 and toxicity.classify(empty(spark), none).count() == 0
    model = toxicity.Model({"vile": 9.0}, -5.0)
    found = toxicity.offending(docs(spark, [(1, "Fine. You vile thing! Good."), (2, None)]), model).collect()
    assert [(r["doc_id"], r["sentence"].strip()) for r in found] == [(1, "You vile thing!")]


def test_language(spark):
    rng = random.Random(8)
    words = {"aa": ["bosko", "tarlin", "merdu", "folpan"], "bb": ["xiqua", "zhenu", "wyqi", "quzha"]}
    rows = [(k, lang, " ".join(rng.choice(words[lang]) for _ in range(30))) for k in range(80) for lang in ("aa" if k % 2 else "bb",)]
    rows += [(100, "aa", None), (101, None, "12 !! 34"), (102, "bb", ""), (None, "aa", "bosko tarlin"), (103, None, "bosko " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("score", F.lit(5))
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows) and all(got[k]["lang_pred"] == lang for k, lang, t in rows if k is not None and k < 80)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["rejected"] for k in (100, 101, 102))
    assert got[103]["lang_pred"] == "aa" and langid.identify(df.limit(0)).count() == 0


def test_dictionaries_hold_whole_texts(spark):
    """Whole texts while they fit, short ones first; one at least, however long; every language, each with its part of the room."""
    rows = [(k, "aa", f"word{chr(97 + k % 26)}{chr(97 + k // 26)} " * (30 if k % 2 else 400)) for k in range(60)]
    schema = "doc_id long, lang string, text string"
    made = langid.train(spark.createDataFrame(rows, schema), 60, 20_000)["aa"].decode()
    texts = {" ".join(t.split()) for _, _, t in rows}
    held = made.split("\n")
    assert set(held) <= texts and len(held) == len(set(held)) and 15_000 < len(made.encode()) <= 20_000
    assert all(t in held for t in texts if len(t) < 400)  # those up to a fiftieth of the room
    long = langid.train(spark.createDataFrame([(1, "aa", "bosko " * 9000)], schema), 60, 20_000)["aa"].decode()
    assert long == " ".join(["bosko"] * 9000)
    short = langid.train(spark.createDataFrame([(1, "aa", "bosko é tarlin")], schema))["aa"]
    assert short.decode() == "bosko é tarlin"
    many = spark.range(900).selectExpr("id AS doc_id", "concat('l', id % 450) AS lang", "concat('w', repeat(char(97 + id % 20), 5)) AS text")
    assert len(langid.train(many)) == 450


def test_language_stage_rejects_foreign_and_mixed_texts(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    docs_ = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").where("lang is not null and length(text) > 300")
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs_.collect()]
    by = {}
    for _, lang, text in rows:
        by.setdefault(lang, []).append(text.split())
    letters = "abcdefghijklmnopqrstuvwxyz"
    plain, foreign, mixed = [], [], []
    for k in range(120):
        a, b = rng.sample(sorted(by), 2)
        n = rng.choice([8, 20, 60, 200])
        one, other = rng.choice(by[a])[:n], rng.choice(by[b])[:n]
        plain.append((10_000 + k, None, " ".join(one)))
        foreign.append((20_000 + k, None, " ".join(one).lower().translate(str.maketrans(letters, "".join(rng.sample(letters, 26))))))
        mixed.append((30_000 + k, None, " ".join(w for pair in zip(one, other) for w in pair)))
    got = corpus_pipeline.keep_language(spark, spark.createDataFrame(rows + plain + foreign + mixed, "doc_id long, lang string, text string"), sf)
    kept = {r["doc_id"] for r in got.collect()}
    share = [len(kept & {r[0] for r in part}) / len(part) for part in (rows, plain, foreign, mixed)]
    assert share[0] >= 0.97 and share[1] >= 0.95, share
    assert share[2] <= 0.2 and share[3] <= 0.75, share  # at a margin of 0.001: 0.63 and 0.98


def test_pipeline_stages(spark, tmp_path, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "repeats", "packing"]
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_, sf)
        out.write.parquet(str(tmp_path / name))
        back = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            groups = simhash.near_duplicates(docs_).collect()
            assert sorted(r["doc_id"] for r in back.select("doc_id").collect()) == sorted({r["component_id"] for r in groups})
        if k < 4:
            assert back.columns == docs_.columns and 0 < back.count() <= docs_.count()
            docs_ = back
    assert json.dumps(back.columns)


def linked_rows(fps):
    """Component of each row, by trying all pairs."""
    root = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4 and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = [x if v == y else v for v in root]
    return root


def in_order(spark, rows, schema=SCHEMA):
    """One part, so that the order of the rows is that of the list."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_one_of_each_loses_no_text(spark):
    a, b, c = "one two three four five", "entirely other words stand here", "and a third text of some words"
    rows = [(3, a), (5, a), (5, b), (9, c), (9, c), (None, "without an id one"), (None, "without an id one"), (None, a), (None, None), (None, ""), (12, "")]
    root = linked_rows([brute_fp(t) for _, t in rows])
    want = [min((rows[k] for k in range(len(rows)) if root[k] == r), key=lambda x: (x[0] is None, x[0] or 0)) for r in sorted(set(root))]
    got = simhash.one_of_each(docs(spark, rows))
    assert got.columns == docs(spark).columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    kept = sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=key)
    assert kept == sorted(((d, t or "") for d, t in want), key=key)
    assert [x[:1] for x in kept if x[1] in (a, b, c)] == [(3,), (5,), (9,)]
    few = simhash.one_of_each(docs(spark, rows), small=0)  # the way without a broadcast
    assert len(few.collect()) == len(kept) and simhash.one_of_each(empty(spark)).count() == 0


def stage_rows():
    """Documents with null and repeated ids, empty, very long and repeated texts, and columns named as what operators add."""
    rng = random.Random(12)
    words = ["alder", "birch", "cedar", "dogwood", "elder", "fir", "ginkgo", "hazel", "iris", "juniper", "kapok", "larch"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ","]) for _ in range(n))
    shared = prose(60)
    rows = [(k, prose(40) + ". " + (shared if k % 7 == 0 else "") + prose(30)) for k in range(60)]
    rows += [(None, prose(50)), (None, None), (3, rows[3][1]), (3, prose(30)), (None, rows[4][1]), (500, ""), (501, "x" * 600), (502, prose(9000)), (503, shared), (504, "12 !!")]
    return [(d, t, "aa", "s", len(t or ""), 1.5, "p", 7) for d, t in rows]


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, rid int"


def test_each_pipeline_stage_by_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = stage_rows()
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf_dir, one = str(tmp_path), in_order(spark, rows, STAGE_SCHEMA)
    stages = dict(pipeline.STAGES)
    got = {name: stages[name](spark, one, sf_dir) for name in stages}
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    of = lambda name: sorted((tuple(r) for r in got[name].select(*one.columns).collect()), key=key)
    assert all(got[n].columns == one.columns for n in list(stages)[:-1])

    space = quality.train(one, quality.known_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    good = [r for r in rows if brute_quality(space, r[1]) >= 0.5]
    assert of("quality") == sorted(good, key=key) and good

    held = [zlib.crc32(str(r[0]).encode()) % 3 == 1 if r[0] is not None else False for r in rows]
    model = langid.train(spark.createDataFrame([r for r, h in zip(rows, held) if not h], STAGE_SCHEMA))
    clear = [r for r in rows if brute_language(model, r[1])[2]]
    assert of("language") == sorted(clear, key=key) and 0 < len(clear) < len(rows)

    root = linked_rows([brute_fp(r[1]) for r in rows])
    first = [min((k for k in range(len(rows)) if root[k] == g), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)) for g in sorted(set(root))]
    assert of("near_duplicates") == sorted((rows[k] for k in first), key=key)

    met, left, width = set(), [], pipeline.REPEAT
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if b[k : k + width] in met:
                gone[k : k + width] = b"\1" * width
            met.add(b[k : k + width])
        text = None if r[1] is None else bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if text or not b:
            left.append((r[0], text, *r[2:4], r[4] if text is None else len(text), *r[5:]))
    assert of("repeats") == sorted(left, key=key) and len(left) < len(rows)

    plain = tokens.WordEncoder(vocabulary("byte_bpe_50k.json"))
    packed = got["packing"].collect()
    assert sum(r["length"] for r in packed) == sum(len(plain.ids(r[1] or "")) + 1 for r in rows)
    nothing = spark.createDataFrame([], STAGE_SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0, name
    spark.createDataFrame(rows, STAGE_SCHEMA).coalesce(1).write.parquet(f"{sf_dir}/documents.parquet")
    whole = pipeline.run(spark, sf_dir)
    assert set(whole.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and whole.count() > 0


def brute_quality(space, text):
    """The vote on one text, neighbour by neighbour, from the space's own vectors."""
    if space is None:
        return 0.5
    counts = quality.terms(text)
    pairs, words = counts[: quality.KINDS**2], np.zeros(quality.WORDS)
    if not pairs.sum():
        return space.share
    for w in (text or "").split():
        words[zlib.crc32(w.encode()) % quality.WORDS] += 1
    parts_ = []
    for tf, idf, weight in ((pairs, space.idf[0], 1), (words, space.idf[1], quality.WORD_WEIGHT)):
        weighted = np.log1p(1000 * tf / max(1, tf.sum())) * idf
        parts_.append(weight * weighted / max(np.linalg.norm(weighted), 1e-12))
    x = np.concatenate([*parts_, counts[-4:]])
    x = (x / np.linalg.norm(x)) @ space.axes
    near = sorted(((float(x @ v / max(np.linalg.norm(x), 1e-12)), y) for v, y in zip(space.known, space.labels)), reverse=True)
    least = near[: quality.NEIGHBOURS][-1][0]
    votes = [(max(0.0, c) ** quality.POWER, y) for c, y in near if c >= least - 1e-12]
    total = sum(v for v, _ in votes)
    return sum(v * y for v, y in votes) / total if total else space.share


def brute_language(model, text):
    """``language, score, clear`` of one text, by compressing it afresh with each dictionary."""
    import regex
    import zstandard as z

    words = " ".join(regex.findall(r"[\p{L}\p{M}]+", (text or "").lower()))
    if not regex.search(r"\p{L}", words) or not model:
        return "und", 0.0, False
    size = {}
    for name, raw in model.items():
        c = z.ZstdCompressor(level=langid.LEVEL, dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        size[name] = len(c.compress(words.encode()))
    best = min(sorted(size), key=size.get)
    rest = min((n for k, n in size.items() if k != best), default=None)
    score = 1.0 if rest is None else (rest - size[best]) / rest
    return best, score, score >= langid.MARGIN


def test_scores_by_brute_force(spark, sf):
    """Quality, toxicity and language of every document, worked out one by one from the trained model."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    space = quality.train(d, quality.known_labels(labels))
    for r in quality.classify(d, labels).collect():
        assert abs(r["score"] - brute_quality(space, texts[r["doc_id"]])) < 1e-6 and r["predicted"] == int(r["score"] >= 0.5)
    known = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    model = toxicity.train(d, spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in known], "doc_id long, label int"))
    for r in toxicity.classify(d, labels).collect():
        text, clean = texts[r["doc_id"]] or "", 1.0
        parts_ = [x for x in re.findall(r"[^.!?\n]+[.!?]*", text) if x.strip()] or [""]
        for x in parts_:
            words = set(re.findall(r"[^\W\d_]+", x.lower()))
            z = model.bias + sum(model.weights.get(w, 0.0) for w in words | {w[:4] + "*" for w in words if len(w) > 4})
            clean *= 1 - 1 / (1 + np.exp(-z))
        assert abs(r["score"] - (1 - clean)) < 1e-6
    spoken = langid.train(d.where("lang is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    for r in langid.identify(d).collect():
        want = brute_language(spoken, texts[r["doc_id"]])
        assert (r["lang_pred"], r["rejected"]) == (want[0], not want[2]) and abs(r["score"] - want[1]) < 0.02


def test_letters_are_those_of_unicode(spark):
    model = {"aa": b"bosko tarlin merdu", "bb": b"xiqua zhenu wyqi"}
    rows = [(1, "² ½ Ⅷ"), (2, "́ ̈"), (3, "12_34"), (4, "हिन्दी में"), (5, "bosko")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(spark, rows), model).collect()}
    assert [got[k] for k in (1, 2, 3)] == ["und"] * 3 and got[4] != "und" and got[5] == "aa"
    assert langid.letters("हिन्दी में") == "हिन्दी में"


def test_samples_are_bounded(spark):
    """However often an id or a value repeats."""
    rows = [(k, "a") for k in range(2000)] + [(7, "a")] * 500 + [(k, "b") for k in range(30)] + [(None, "a"), (3, None)] + [(9000 + k, f"v{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    for most in (20, 100):
        got = sampling.stratified(df, "label", most, values=3).collect()
        by = {}
        for r in got:
            by.setdefault(r["label"], []).append(r["doc_id"])
        assert len(by) == 3 and all(len(v) <= most and len(v) == len(set(v)) for v in by.values()) and len(by["b"]) == min(30, most)
        assert len(by["a"]) > 0.6 * most
    texts = spark.createDataFrame([(7, f"t{k}") for k in range(300)] + [(8, None)], "doc_id long, text string")
    assert sampling.texts_of(texts, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, label int")).orderBy("doc_id").collect() == [(7, 1, "t0"), (8, 0, "")]


def brute_tree(text):
    """``fingerprint, leaves with their lengths`` of a text."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    nodes = []
    for line in text.split("\n"):
        words = line.replace("\x01", "\x01\x01").split(" ")
        line = " ".join(w + "\x01" * (zlib.crc32(w.encode()) % 4 == 0) for w in words)
        leaves = [(sha(p), f"{len(p):x}") for p in re.findall(r"(?:[^ .!?\x01]+ ?){1,32}[.!?]*\x01? ?|[.!? \x01]+", line)]
        nodes.append((sha(",".join(a + n for a, n in leaves)), [a[:16] + n for a, n in leaves]))
    return sha("".join(n for n, _ in nodes)) + ";" + ";".join(f"{n[:16]}:{','.join(x)}" for n, x in nodes), {x for _, own in nodes for x in own or [""]}


def brute_likeness(a, b):
    weight = lambda s: sum(max(1, int(x[16:] or "0", 16)) for x in s)
    return 1.0 if a == b else 2 * weight(a & b) / (weight(a) + weight(b))


def test_merkle_after_an_inserted_word(spark):
    """A word put before, into or behind a line of 200 words, or taken from it, leaves nearly all paragraphs as they were."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    line = " ".join(words)
    others = [" ".join([*words[:k], "inserted", *words[k:]]) for k in (0, 1, 77, 100, 199, 200)] + [" ".join([*words[:k], *words[k + 1 :]]) for k in (0, 60, 199)]
    two = spark.createDataFrame([(line, x) for x in others], "a string, b string")
    cols = [merkle.fingerprint(merkle.sections(F.col(c))).alias(c) for c in "ab"]
    near = [merkle.likeness(merkle.leaves(F.col("a")), merkle.leaves(F.col("b"))).alias("near"), merkle.differing(F.col("a"), F.col("b")).alias("d")]
    for r in two.select(*cols).select(*near).collect():
        assert r["near"] > 0.9 and 1 <= len(r["d"]) <= 2
    same = [("x\x01", "x"), ("x\x01 y", "x y"), ("x\x01\x01", "x\x01"), ("\x01", ""), ("a \x01", "a ")] + [(f"{w}\x01 z", f"{w} z") for w in words]
    prints = spark.createDataFrame(same, "a string, b string").select(*cols).collect()
    assert all(r["a"] != r["b"] for r in prints)


def test_merkle_by_brute_force(spark, sf):
    rows = [(d, t) for d, t in ODD if d is not None] + [(50, "," * 70_000), (51, "," * 70_000 + "x"), (52, "a b c. d e!\n\nf g h i j k l m\nn"), (53, "a b c. d e!\n\nf g h i j k l m\no")]
    rows += [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    order = sorted(rows, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in merkle.compare_with_edits(docs(spark, rows)).collect()}
    for k, (d, t) in enumerate(order):
        t, nx = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nx[: len(t) // 2]
        (own, a), (changed, b), (_, c) = map(brute_tree, (t, edited, nx))
        assert got[d]["fingerprint"] == own and got[d]["edited_fingerprint"] == changed
        assert abs(got[d]["near_edited"] - brute_likeness(a, b)) < 1e-9 and abs(got[d]["near_next"] - brute_likeness(a, c)) < 1e-9
