"""Operators that must not depend on how rows are dealt, against brute force: graphs, scans, products, joins, search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import analytics, blocks, documents, graph, index, retrieval, scans, skew

# --- graph ---


def all_ways(symbols, edges, bounds, root, up, o):
    """By walking every way that the guard allows."""
    use = [e for e in edges if e[3] >= o.min_confidence and (not o.edge_types or e[2] in o.edge_types) and (up or e[2] != "IMPLEMENTS")]
    hops = [(t, s, c, k) if up else (s, t, c, k) for s, t, k, c in use]
    best, level = {}, [(root, None)]
    for depth in range(1, o.depth + 1):
        then = []
        for at, path in level:
            for a, b, c, k in hops:
                if a != at or (b in bounds and not (up and depth == 1)):
                    continue
                if depth > 1 and (b == root or (b in path.split(">") if o.strict else b in path)):
                    continue
                way = b if path is None else f"{path}>{b}"
                then.append((b, way))
                best[b] = min(best.get(b, (99,)), (depth, -c, way, k))
        level = then
    rows = [(i, v[0], -v[1], v[2], v[3]) for i, v in best.items() if i in symbols]
    return sorted(sorted(rows, key=lambda r: (r[1], -r[2], r[0]))[: o.budget])


@pytest.mark.parametrize("hub", [10_000, 3])
@pytest.mark.parametrize("strict", [False, True])
def test_blast_of_many_roots(spark, monkeypatch, hub, strict):
    """Ids that are parts of others, parallel edges, cycles, boundaries, a hub dealt to parts, all symbols as roots."""
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(6)
    names = ["go:p:f:A", "go:p:f:AB", "go:p:f:ABC", "go:p:f:B", "go:p:f:C", "py:go:p:f:A", "go:p:f:D", "go:p:f:DA", "go:p:f:E", "hub"]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(["CALLS", "IMPLEMENTS", "IMPORTS"]), rng.choice([0.4, 0.7, 0.9])) for _ in range(26)] + [(n, "hub", "CALLS", 0.8) for n in names[:6]] + [("hub", n, "CALLS", 0.6) for n in names[3:]]
    bounds, symbols = {"go:p:f:E"}, set(names) - {"go:p:f:C"}
    s = spark.createDataFrame([(n, n[-1], f"src/{n[-1]}.go", "function") for n in sorted(symbols)], "id string, name string, file_path string, kind string")
    e = spark.createDataFrame(edges, "source_id string, target_id string, edge_type string, confidence double")
    b = spark.createDataFrame([(x,) for x in bounds], "id string")
    roots = spark.createDataFrame([(n,) for n in names] + [(names[0],), (None,)], "root_id string")
    for up in (True, False):
        o = graph.BlastOptions(depth=4, budget=6, strict=strict)
        got = {}
        for r in graph.blast(s, e, b, roots, up, o).collect():
            got.setdefault(r["root_id"], []).append((r["id"], r["depth"], r["confidence"], r["path"], r["edge_type"]))
        want = {n: w for n in names if (w := all_ways(symbols, edges, bounds, n, up, o))}
        assert {k: sorted(v) for k, v in got.items()} == want


def test_parts_of_ids(spark):
    ids = spark.createDataFrame([(x,) for x in ("abc", "abcd", "xabc", "abcabcd", "q")], "id string")
    got = {r["id"]: r["holds"] for r in graph.inner_ids(ids).collect()}
    assert got == {"abcd": ["abc"], "xabc": ["abc"], "abcabcd": ["abc", "abcd"]}


def test_roots_by_name(spark):
    s = spark.createDataFrame([("b", "f", "x.go", "function"), ("a", "f", "y.go", "method"), ("g", "h", "x.go", "function"), ("h", "z", "z.go", "function"), ("t", "T", "x.go", "type")], "id string, name string, file_path string, kind string")
    files = spark.createDataFrame([("x.go",), ("y.go",)], "path string")
    roots = lambda by: {(r["asked_id"], r["root_id"]) for r in graph.known_file_roots(s, files, by).collect()}
    assert roots("id") == {("b", "b"), ("a", "a"), ("g", "g")}
    assert roots("name") == {("b", "a"), ("a", "a"), ("g", "h")}  # the id "h" comes before names


def test_boundaries_are_replaced(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, name string")
    new = spark.createDataFrame([("b", "z", 1), ("b", "w", 2), ("c", "v", 3)], "id string, name string, ord int")
    assert sorted(map(tuple, graph.store_boundaries(old, new).collect())) == [("a", "x"), ("b", "w"), ("c", "v")]


# --- scans ---


def test_scans_across_ranges(spark):
    """One group holds most rows, over several ranges; null groups and keys; a budget; a mean that reaches back."""
    rng = random.Random(1)
    rows = [("g" if k % 5 else None if k % 2 else "h", k * 7 % 1009, rng.randrange(50), k % 3 / 2) for k in range(1000)]
    df = spark.createDataFrame(rows, "grp string, ord int, size int, v double").repartition(7)
    before, number, held = {}, {}, {}
    for g, o, n, v in sorted(rows, key=lambda r: r[1]):
        before[g, o] = sum(x for x, _ in held.get(g, []))
        number[g, o] = len(held.get(g, [])) + 1
        held.setdefault(g, []).append((n, v))
    got = scans.scanned(df, ["grp"], ["ord"], {"size": F.col("size")}).collect()
    assert {(r["grp"], r["ord"]): r["before_size"] for r in got} == before and len(got) == len(rows)
    got = scans.scanned(df, ["grp"], ["ord"], {"size": F.col("size")}, {"size": 900}).collect()
    assert {(r["grp"], r["ord"]) for r in got} == {k for k, s in before.items() if s < 900}
    assert {(r["grp"], r["ord"]): r["rn"] for r in scans.row_numbers(df, ["grp"], ["ord"]).collect()} == number
    assert [r["n"] for r in scans.row_numbers(df, [], [-F.col("ord")], "n").orderBy(F.desc("ord")).collect()] == list(range(1, 1001))
    got = scans.trailing(df, ["grp"], ["ord"], 10, F.avg("v"), "mean", block=16)
    want = {(g, o): np.mean([v for _, v in held[g][max(0, number[g, o] - 10) : number[g, o]]]) for g, o in before}
    assert {(r["grp"], r["ord"]): round(r["mean"], 9) for r in got.collect()} == {k: round(float(v), 9) for k, v in want.items()} and set(got.columns) == {*df.columns, "mean"}
    assert scans.scanned(df.limit(0), ["grp"], ["ord"], {"size": F.col("size")}).count() == 0
    cut = documents.byte_budget(df, ["grp"], ["ord"], F.col("size"), 100, 30).groupBy("grp").agg(F.sum("taken").alias("n")).collect()
    assert {r["n"] for r in cut} == {100}
    judged = df.withColumns({"human_agreed": F.when(F.col("size") > 9, F.col("v")), "created_at": F.col("ord"), "id": F.col("ord")})
    assert analytics.rolling_agreement(judged, None).count() == judged.where("size > 9").count()


# --- products and joins ---


def test_top_k_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROW_BYTES", 400)
    monkeypatch.setattr(blocks, "QUERY_BYTES", 100)
    rng = np.random.default_rng(2)
    v = [(f"c{k:03d}", rng.normal(size=4).round(1).tolist()) for k in range(90)] + [(f"d{k}", [0.5] * 4) for k in range(30)] + [("n", None), ("m", [1.0, None, 0.0, 0.0]), ("o", [float("nan")] * 4), ("s", [1.0, 2.0])]
    q = [(k, rng.normal(size=4).round(1).tolist()) for k in range(13)] + [(77, [0.5] * 4), (78, [1.0, 2.0]), (79, None)]
    got = {}
    for r in retrieval.joined_top_k(spark.createDataFrame(v, "id string, embedding array<float>"), spark.createDataFrame(q, "query int, q array<double>"), 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], round(r["distance"], 6)))
    want = {}
    for k, x in q:
        near = sorted((float(np.sqrt(sum((float(np.float32(a)) - b) ** 2 for a, b in zip(y, x)))), i) for i, y in v if x and y and len(y) == len(x) and all(a is not None and a == a for a in y))
        if near:
            want[k] = [(n + 1, i, round(d, 6)) for n, (d, i) in enumerate(near[:5])]
    assert {k: sorted(r) for k, r in got.items()} == want
    assert retrieval.joined_top_k(spark.createDataFrame([], "id string, embedding array<float>"), spark.createDataFrame(q, "query int, q array<double>"), 5).count() == 0


def test_salted_join_is_the_join(spark):
    left = spark.createDataFrame([("hot", k) for k in range(60)] + [(f"k{k % 7}", k) for k in range(40)] + [(None, 1)], "k string, a int")
    right = spark.createDataFrame([("hot", k) for k in range(50)] + [(f"k{k % 5}", k) for k in range(20)] + [(None, 2)], "k string, b int")
    rows = lambda df: sorted(map(tuple, df.select("k", "a", "b").collect()))
    assert rows(skew.salted_join(left, right, ["k"], ["a"], pairs=100)) == rows(left.join(right, "k"))


def test_reverse_calls_of_a_popular_name(spark, monkeypatch):
    """A name that most chunks bear and call, with packages that name a directory, that the caller's path holds, and none."""
    monkeypatch.setattr(index, "salted_join", lambda *a: skew.salted_join(*a, pairs=50))
    rng = random.Random(4)
    paths = ["x.go", "a/b/y.go", "b/z.go", "c/w.go", "a/b/v.go"]
    chunks = [(f"i{k}", rng.choice(["Run", "Run", "Run", f"F{k % 6}", ""]), rng.choice(paths), rng.choice(["go", "go", "python"]), [(rng.choice(["Run", "F1", "F2"]), rng.choice(["", "b", "a/b", "c", "nope", None]), None) for _ in range(rng.randrange(4))]) for k in range(60)]
    df = spark.createDataFrame(chunks, "id string, name string, file_path string, language string, calls array<struct<name: string, package: string, file: string>>")
    want = {}
    for i, name, path, _, calls in chunks:
        for called, package, _ in calls:
            package = package or ""
            for j, other, at, language, _ in chunks:
                where = at.rpartition("/")[0] or "."
                if language == "go" and other and other == called and j != i and (not package or package in path or where == package or where.endswith("/" + package)):
                    want.setdefault(j, []).append((name, package, path))
    got = {r["id"]: sorted(map(tuple, r["called_by"])) for r in index.reverse_calls(df, parts=3).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}


def test_distinct_callers_meet_places_once(spark, monkeypatch):
    """Callers of one entry, chunks that call themselves alone or among others, ids that several chunks bear, nulls;
    joined rows follow the distinct entries and the chunks, not their pairs."""
    joined = []

    def counted(*a):
        out = skew.salted_join(*a, pairs=50)
        joined.append(out.count())
        return out

    monkeypatch.setattr(index, "salted_join", counted)
    rng = random.Random(5)
    paths = ["x.go", "a/b/y.go", "b/z.go", "a/b/v.go"]
    chunks = [(f"i{k % 230}" if k else None, rng.choice(["Run", "Run", f"F{k % 3}", ""]), rng.choice(paths), rng.choice(["go", "go", "python"]), [(rng.choice(["Run", "F1", "F2"]), rng.choice(["", "b", "a/b", "nope", None]), None) for _ in range(rng.randrange(3))]) for k in range(240)]
    chunks += [("own", "Own", "q/o.go", "go", [("Own", "", None)]), ("two", "Two", "q/t.go", "go", [("Two", "", None), ("Own", "q", None)]), ("too", "Two", "q/t.go", "go", [("Two", "q", None)])]
    df = spark.createDataFrame(chunks, "id string, name string, file_path string, language string, calls array<struct<name: string, package: string, file: string>>")
    want = {}
    for i, name, path, _, calls in chunks:
        for called, package, _ in calls:
            package = package or ""
            for j, other, at, language, _ in chunks:
                where = at.rpartition("/")[0] or "."
                if language == "go" and other and other == called and None not in (i, j) and j != i and (not package or package in path or where == package or where.endswith("/" + package)):
                    want.setdefault(j, set()).add(f"{name}@{path}")
    got = {r["id"]: r["callers"] for r in index.reverse_callers(df, lambda r: F.concat(r["name"], F.lit("@"), r["file"]), parts=3).collect()}
    assert got == {k: sorted(v) for k, v in want.items()} and "Own@q/o.go" not in got.get("own", [])
    assert sum(joined) < 3 * len(chunks)


# --- search ---


def test_search_in_one_plan(spark):
    """Direct hits take 60 per cent or as many as there are, hops the rest; a request that failed gets the basic hits."""
    names = [(f"c{k}", f"n{k}", [(f"n{(k + d) % 40}",) for d in (1, 7)], [(f"n{(k + 3) % 40}",)]) for k in range(40)]
    ref = "array<struct<name: string>>"
    chunks = spark.createDataFrame(names, f"id string, name string, calls {ref}, called_by {ref}")
    hits = [("r1", q, f"c{(q * 3 + k) % 40}", k / 10) for q in range(3) for k in range(10)] + [("r2", 0, "c5", 0.25)] + [("r3", 0, "c1", 0.1)]
    basic = [("r3", f"c{k}", k / 10, k + 1) for k in range(20)]
    requests = spark.createDataFrame([("r1", False), ("r2", None), ("r3", True), ("r4", True)], "request string, failed boolean")
    got = {}
    for r in retrieval.search(spark.createDataFrame(hits, "request string, query int, id string, distance double"), spark.createDataFrame(basic, "request string, id string, distance double, rank int"), requests, chunks, most=15).collect():
        got.setdefault(r["request"], []).append((r["ord"], r["id"], r["is_dependency_hop"], r["query_hit_count"], round(r["score"], 6)))

    def enriched(rows, most):
        seen = {}
        for _, _, i, d in rows:
            n, best = seen.get(i, (0, -9.0))
            seen[i] = (n + 1, max(best, 1 - d))
        ranked = sorted(seen.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[: most * 60 // 100]
        out, ids = [(i, False, n, round(s, 6)) for i, (n, s) in ranked], {i for i, _ in ranked}
        by = {n: i for i, n, _, _ in names}
        held = {i: (c, b) for i, _, c, b in names}
        for i, _ in ranked:
            for (n,) in [*held[i][0], *held[i][1]]:
                if len(out) < most and by[n] not in ids:
                    ids.add(by[n])
                    out.append((by[n], True, 0, 0.0))
        return [(k + 1, *r) for k, r in enumerate(out)]

    assert sorted(got.pop("r1")) == enriched([h for h in hits if h[0] == "r1"], 15)
    assert sorted(got.pop("r2")) == enriched([h for h in hits if h[0] == "r2"], 15)
    assert sorted(got.pop("r3")) == [(k + 1, f"c{k}", False, 0, round(1 - k / 10, 6)) for k in range(10)]
    assert not got


def test_layouts(spark):
    rows = spark.createDataFrame([("q", 1, "c1", 0.876, "a/b.go", "F", 3, 9, "does it", "func F()"), ("q", 2, "c2", 0.5, "x.py", "g", 1, 2, None, None)], "request string, ord int, id string, score double, file_path string, name string, line_start int, line_end int, description string, signature string")
    assert retrieval.results_block(rows, ["request"], "ord").first()["block"] == "=== SEMANTICALLY RELEVANT CODE (via RAG) ===\n[Score: 0.88] a/b.go — F (lines 3-9)\n  does it\n  func F()\n\n[Score: 0.50] x.py — g (lines 1-2)\n  \n  \n\n"
    ref = "array<struct<name: string, package: string>>"
    chunks = [("1", "F", "a.go", 5, [("g", "p"), ("h", "")], [], ["T"], []), ("2", "G", "a.go", 1, [], [("F", None)], [], ["I", "J"]), ("3", "", "a.go", 0, [("x", "")], [], [], []), ("4", "H", "b.go", 1, [], [], [], None)]
    df = spark.createDataFrame(chunks, f"id string, name string, file_path string, line_start int, calls {ref}, called_by {ref}, types_used array<string>, implements_ifaces array<string>")
    got = {r["file_path"]: r["block"] for r in index.relations(df).collect()}
    assert got == {"a.go": "=== RELATIONSHIP CONTEXT ===\nFunction: G\n  Called by: F\n  Implements: I, J\n\nFunction: F\n  Calls: g (p), h\n  Types used: T\n\n"}




def test_calls_meet_one_symbol_of_a_head(spark):
    """Heads of packages, an empty module, nulls, characters beyond the BMP; calls and symbols meet by name and head."""
    symbols = [(f"s{k:02d}", "f" if k % 3 else "g", ("pkg", "pkg/a", "p\U0001f600q", "", None)[k % 5]) for k in range(40)]
    calls = [(k, name, module) for k, (name, module) in enumerate([(n, m) for n in ("f", "g", "h", None) for m in ("", "pkg", "pkg/", "p\U0001f600", "q", None)])]
    df = graph.qualified_names(spark.createDataFrame(calls, "call_id int, name string, module string"), spark.createDataFrame(symbols, "id string, name string, package string"))
    want = {k: min(found) for k, n, m in calls if m is not None and (found := [i for i, name, p in symbols if name == n and p is not None and p.startswith(m)])}
    assert {r["call_id"]: r["target_id"] for r in df.collect()} == want
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and "module#" in joins[0] and "startswith" not in joins[0].lower()


def test_file_sets_are_worked_out_once(spark):
    """A task's file set is cleaned once for the first of each set and once for the tasks that come later."""
    tasks = spark.createDataFrame([], "task_id string, title string, known_files array<string>, criteria array<string>, requirements array<string>, depends_on array<string>, ord int")
    plan = documents.task_violations(tasks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(split(") == 2 * 2  # of a rooted path and of another one
