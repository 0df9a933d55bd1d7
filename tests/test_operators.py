"""Small worlds with outcomes worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalar as fn
from quarry.operators import analytics, documents, graph, index, render, retrieval, validation, warehouse
from quarry.schemas import SCHEMAS, assert_schema, normalize_plan_runs
from quarry.sources import io
from quarry.streaming import events


def one(spark, expr, **cols):
    names = list(cols) or ["x"]
    df = spark.createDataFrame([tuple(cols.values()) or (1,)], ", ".join(f"{n} {'string' if isinstance(v, (str, type(None))) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long'}" for n, v in (cols or {"x": 1}).items()))
    assert df.columns == names
    return df.select(expr.alias("v")).first()["v"]


def edges(spark, rows):
    return spark.createDataFrame([(i, a, b, t, c) for i, (a, b, t, c) in enumerate(rows)], "id long, source_id string, target_id string, edge_type string, confidence double")


def symbols(spark, names):
    return spark.createDataFrame([(n, n, f"src/{n}.go") for n in names], "id string, name string, file_path string")


def reach(spark, rows, root, up, boundaries=(), **options):
    names = sorted({x for r in rows for x in r[:2]} - set(boundaries))
    bounds = spark.createDataFrame([(b,) for b in boundaries], "id string")
    roots = spark.createDataFrame([(root,)], "root_id string")
    out = graph.blast(symbols(spark, names), edges(spark, rows), bounds, roots, up, graph.BlastOptions(**options)).collect()
    return {(r["id"], r["depth"]) for r in out}


def test_chain_star_boundary_cycle_confidence(spark):
    chain = [("A", "B", "CALLS", 1.0), ("D", "B", "CALLS", 1.0), ("B", "C", "CALLS", 1.0)]
    assert reach(spark, chain, "B", True) == {("A", 1), ("D", 1)}
    assert reach(spark, chain, "A", False) == {("B", 1), ("C", 2)}
    star = [(f"c{i}", "Center", "CALLS", 1.0) for i in range(10)]
    assert len(reach(spark, star, "Center", True, budget=5)) == 5
    assert reach(spark, [("Foo", "Println", "CALLS", 1.0)], "Foo", False, ("Println",)) == set()
    cycle = [("A", "B", "CALLS", 1.0), ("B", "C", "CALLS", 1.0), ("C", "A", "CALLS", 1.0)]
    assert reach(spark, cycle, "A", False, depth=10) == {("B", 1), ("C", 2)}
    assert reach(spark, [("A", "B", "CALLS", 1.0), ("A", "C", "CALLS", 0.3)], "A", False) == {("B", 1)}


def test_self_call_and_substring_guard(spark):
    assert reach(spark, [("A", "A", "CALLS", 1.0)], "A", False) == {("A", 1)}
    path = [("X", "RunAll", "CALLS", 1.0), ("RunAll", "Run", "CALLS", 1.0)]
    assert reach(spark, path, "X", False) == {("RunAll", 1)}
    assert reach(spark, path, "X", False, strict=True) == {("RunAll", 1), ("Run", 2)}


def test_text_time_and_ranges(spark):
    df = spark.createDataFrame([("2026-03-01 23:59:59",), ("2026-03-02 00:00:00",), ("2026-03-01T23:00:00Z",)], "created_at string")
    kept = [r[0] for r in df.where(fn.since_text(F.col("created_at"), "2026-03-01T00:00:00Z")).collect()]
    assert kept == ["2026-03-02 00:00:00", "2026-03-01T23:00:00Z"]
    now = datetime(2026, 3, 31)
    assert warehouse.parse_range("7d", now) == "2026-03-24T00:00:00Z"
    assert warehouse.parse_range("all", now) is None and warehouse.parse_range("x", now) == "2026-03-01T00:00:00Z"
    assert one(spark, fn.seconds_between(F.col("a"), F.col("b")), a="2026-01-01 00:00:00", b="2026-01-01T00:01:00Z") == 60
    assert str(one(spark, fn.day(F.col("a")), a="2026-01-01T23:30:00-02:00")) == "2026-01-02"


@pytest.mark.parametrize(
    "expr, cols, want",
    [
        (lambda: fn.slug(F.col("a")), {"a": " Add: the Thing! "}, "add-the-thing"),
        (lambda: fn.slug(F.col("a"), 10), {"a": "one two three four"}, "one-two"),
        (lambda: fn.title_of(F.col("a"), F.lit("feature")), {"a": "x: 1\ntitle:\ntitle: 'Do it'\n"}, "Do it"),
        (lambda: fn.title_of(F.col("a"), F.lit("feature")), {"a": None}, "feature"),
        (lambda: fn.strip_code_fence(F.col("a")), {"a": "```json\n{}\n```"}, "{}"),
        (lambda: fn.outermost(F.col("a")), {"a": 'x {"a": {}} y'}, '{"a": {}}'),
        (lambda: fn.json_or_text(F.col("a")), {"a": "{bad"}, "{bad"),
        (lambda: fn.list_or_single(F.col("a")), {"a": '["x","y"]'}, ["x", "y"]),
        (lambda: fn.list_or_single(F.col("a")), {"a": "plain"}, ["plain"]),
        (lambda: fn.list_or_single(F.col("a")), {"a": ""}, None),
        (lambda: fn.truncate_bytes(F.col("a"), 3), {"a": "abé"}, "ab"),
        (lambda: fn.percent(F.lit(2), F.lit(3)), {}, 66),
        (lambda: fn.percent(F.lit(2), F.lit(0)), {}, 0),
        (lambda: fn.result_kind(F.col("a")), {"a": " MET "}, "met"),
        (lambda: fn.result_kind(F.col("a")), {"a": "odd"}, "unassessable"),
        (lambda: fn.test_base(F.col("a")), {"a": "x/y_test.go"}, "x/y.go"),
        (lambda: fn.diff_path(F.col("a")), {"a": "diff --git a/x b/y b/z"}, "y b/z"),
        (lambda: fn.path_suffixes(F.col("a")), {"a": "a/b/c"}, ["a/b/c", "b/c", "c"]),
        (lambda: fn.language_of(F.col("a")), {"a": "x/y.ts"}, "typescript"),
        (lambda: fn.language_of(F.col("a")), {"a": "x/y.TS"}, ""),
        (lambda: fn.language_of(F.col("a")), {"a": "x/y.js"}, ""),
        (lambda: fn.human_duration(F.lit(180)), {}, "3m"),
        (lambda: fn.human_duration(F.lit(7200)), {}, "2h"),
        (lambda: fn.criterion_key(F.lit(" "), F.col("a")), {"a": " It Works "}, "description:it works"),
        (lambda: fn.tool_summary(F.col("a")), {"a": '{"command":"c","file_path":"p"}'}, "p"),
        (lambda: fn.tool_summary(F.col("a")), {"a": '{"description":"d","url":"u"}'}, "u"),
        (lambda: analytics.event_status(F.col("a")), {"a": "build_stdout"}, "running"),
        (lambda: analytics.event_status(F.col("a")), {"a": "build_completed"}, "pending"),
        (lambda: fn.file_set(F.col("a")), {"a": [" b ", "./a"]}, "a|b"),
        (lambda: fn.file_set(F.col("a")), {"a": ["a"]}, ""),
        (lambda: fn.file_set(F.col("a")), {"a": ["x/../b//c", " a/./b/ ", " "]}, "a/b|b/c"),
        (lambda: fn.clean_path(F.col("a")), {"a": "/../a/b/.."}, "/a"),
        (lambda: fn.clean_path(F.col("a")), {"a": "x/.."}, "."),
        (lambda: fn.clean_path(F.col("a")), {"a": "../../a/../b"}, "../../b"),
        (lambda: fn.chart_duration(F.lit(119.6)), {}, "1m 60s"),
        (lambda: fn.chart_percent(F.lit(0.456)), {}, "45.6%"),
        (lambda: fn.truncate_bytes(F.col("a"), 5, "..."), {"a": "é😀x"}, "é..."),
        (lambda: fn.truncate_bytes(F.col("a"), 6, "..."), {"a": "é😀x"}, "é😀..."),
        (lambda: fn.human_duration(F.lit(125)), {}, "2m 5s"),
        (lambda: fn.merge_json(F.col("a"), F.lit("w"), F.lit(None).cast("string"), F.lit("s")), {"a": '{"session_id":"own"}'}, '{"session_id":"own","workflow_id":"w"}'),
        (lambda: fn.tool_summary(F.col("a")), {"a": '{"query":"q","file_path":"p"}'}, "p"),
        (lambda: fn.cost_usd(F.lit(1000), F.lit(500), F.lit(3.0), F.lit(15.0)), {}, 0.0105),
    ],
)
def test_scalars(spark, expr, cols, want):
    assert one(spark, expr(), **cols) == want


def test_globs(spark):
    for glob, path, want in (("docs/", "docs/a/b.md", True), ("**/*.go", "a/b/c.go", True), ("**/*.go", "c.go", True), ("*.go", "a/c.go", False), ("a?.py", "ab.py", True), ("docs/", "x/docs/y.md", True), ("docs/", "xdocs/y.md", False), ("**/vendor/", "a/vendor/b", True), ("[a-c]x.go", "bx.go", True), ("[^a-c]x.go", "bx.go", False), ("a/**/b.go", "a/c/d/b.go", False), ("a/**/b.go", "a/c/b.go", True), ("**/a/*.go", "x/a/c.go", True), ("[a", "[a", False), ("\\*.go", "*.go", True), ("\\*.go", "a.go", False)):
        assert one(spark, fn.matches_glob(F.col("a"), [glob]), a=path) is want


def test_audit_usefulness_and_double_counting(spark):
    rows = [("a", 2, 3, "changed", 1, 0), ("b", 2, 2, "", 0, 0), ("c", None, 5, None, None, None)]
    df = spark.createDataFrame(rows, "id string, pre_audit_work_order_count long, post_audit_work_order_count long, audit_change_text string, audit_work_orders_added long, audit_work_orders_modified long")
    got = {r["id"]: (r["audit_changed"], r["count_delta"]) for r in warehouse.audit_usefulness(df).collect()}
    assert got == {"a": (True, 1), "b": (False, 0), "c": (False, None)}
    stats = warehouse.audit_stats(df).first()
    assert (stats["changed_runs"], stats["unchanged_runs"]) == (2, 2)  # the run without a count before is both


def test_empty_warehouse(spark):
    runs = spark.createDataFrame([], SCHEMAS["pipeline_runs"])
    calls = spark.createDataFrame([], SCHEMAS["sub_calls"])
    s = analytics.pipeline_summary(runs, calls).first()
    assert s["total_runs"] == 0 and s["total_cost"] == 0 and s["pass_rate"] == 0
    assert warehouse.pipeline_stats(runs).first()["verify_pass"] is None
    assert analytics.verify_distribution(runs).count() == 0


def test_pending_plans_settle(spark):
    rows = [("a", "pending", 3, "2026-01-01 00:00:00"), ("b", "pending", None, "2026-01-01 00:00:00"), ("c", "pending", None, "2026-01-01 23:00:00")]
    df = spark.createDataFrame(rows, "id string, state string, work_orders_generated long, created_at string")
    assert [r["state"] for r in normalize_plan_runs(df, "2026-01-02 00:00:00").orderBy("id").collect()] == ["complete", "failed", "pending"]


def test_plan_status_rules(spark):
    tasks = spark.createDataFrame([("1", []), ("2", []), ("3", ["1"]), ("4", []), ("5", ["1"]), ("6", ["2"]), ("7", []), ("8", []), ("9", ["2"])], "task_id string, depends_on array<string>")
    runs = spark.createDataFrame([("1", "PASS", "approved", "completed"), ("2", "FAIL", "rejected", "completed"), ("3", "PASS", None, "human_review"), ("4", None, None, "build"), ("7", "FAIL", None, "human_review"), ("8", "PASS", None, "completed"), ("9", "PASS", None, "awaiting_review")], "plan_task_id string, verify_result string, human_result string, current_state string")
    got = {r["task_id"]: r["status"] for r in warehouse.plan_task_status(tasks, runs).collect()}
    assert got == {"1": "complete", "2": "failed", "3": "awaiting-review", "4": "in-progress", "5": "not-started", "6": "blocked", "7": "failed", "8": "failed", "9": "in-progress"}


def test_criteria_merge_and_status(spark):
    catalog = spark.createDataFrame([("AC-1", "d1", True, 1), ("AC-2", "d2", True, 2)], "id string, description string, required boolean, ord int")
    results = spark.createDataFrame([("AC-1", "", "unassessable", "pre", 1), ("AC-2", "", "met", None, 2)], "id string, description string, result string, note string, ord int")
    rows = documents.merged_criteria(catalog, results)
    assert [(r["key"], r["result"], r["notes"]) for r in rows.orderBy("ord").collect()] == [("id:ac-1", "unassessable", ["pre"]), ("id:ac-2", "met", [])]
    s = documents.report_status(rows, []).first()
    assert (s["status"], s["all_met"], s["all_unmet"]) == ("WARN", False, False)
    advisory = spark.createDataFrame([("unmet", False)], "result string, required boolean")
    assert documents.report_status(advisory, []).first()["status"] == "WARN"
    assert documents.report_status(advisory.withColumn("required", F.lit(True)), []).first()["status"] == "FAIL"


def test_segments_and_violations(spark):
    files = spark.createDataFrame([("a.go",), ("a_test.go",), ("b.py",)], "path string")
    assert sorted(map(tuple, (r["files"] for r in documents.segments(files).collect()))) == [("a.go", "a_test.go"), ("b.py",)]
    tasks = spark.createDataFrame([("t1", "Same ", ["a", "b"], ["c"], ["r"], [], 1), ("t2", "same", ["b", "a"], ["c"], [], ["t3"], 2), ("t3", "x", [], [], ["r"], [], 3)], "task_id string, title string, known_files array<string>, criteria array<string>, requirements array<string>, depends_on array<string>, ord int")
    got = sorted((r["task_id"], r["rule"]) for r in documents.task_violations(tasks).collect())
    assert got == [("t2", 3), ("t2", 6), ("t2", 7)]  # the later of two twins is at fault
    needs = spark.createDataFrame([("r",), ("s",)], "requirement string")
    assert [r["task_id"] for r in documents.plan_violations(needs, tasks).where("rule = 8").collect()] == ["s"]
    assert {r["task_id"]: r["rule"] for r in documents.first_error(documents.task_violations(tasks)).collect()} == {"t2": 3}


def test_budgets(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([30, 80, 50, 10])], "g string, ord int, size int")
    assert [(r["ord"], r["taken"]) for r in documents.byte_budget(df, ["g"], ["ord"], F.col("size"), 100, 60).orderBy("ord").collect()] == [(0, 30), (1, 60), (2, 10)]
    assert [r["ord"] for r in documents.whole_budget(df, ["g"], ["ord"], F.col("size"), 100).collect()] == [0]


def test_expansion_and_index(spark):
    qs = retrieval.expansion("Add cache", "internal/x", ["Tests pass", "Cache evicts old entries by age", "The module compiles on every platform", "run go  vet on all of it", "no four words here"], ["internal/a/b.go", "c.go"])
    assert qs == ["Add cache", "internal/x", "Cache evicts old entries by age", "internal/a b", "c"]
    md = spark.createDataFrame([("d", "intro\n## A\nx\n### sub\n## B\ny")], "doc string, text string")
    got = [(r["name"], r["line_start"], r["line_end"]) for r in index.markdown_sections(md, "doc").orderBy("section").collect()]
    assert got == [("A", 2, 4), ("B", 5, 6)]
    py = spark.createDataFrame([("m.py", "@d\ndef f():\n    pass\n\nclass C:\n    def m(self):\n        pass\n"), ("bad.py", "def (")], "path string, text string")
    assert sorted((r["chunk_type"], r["name"], r["line_start"], r["line_end"]) for r in index.python_chunks(py).collect()) == [("class", "C", 5, 7), ("function", "f", 1, 3), ("method", "C.m", 6, 7)]
    ref = "array<struct<name: string, package: string, file: string>>"
    chunks = spark.createDataFrame([("1", "FuncA", "internal/pkg/file1.go", "go", [("FuncB", "internal/pkg", None), ("FuncA", "", None), ("FuncC", "pkg", None), ("FuncD", "", None)]), ("2", "FuncB", "internal/pkg/file2.go", "go", []), ("3", "FuncC", "other/x.go", "go", []), ("4", "FuncD", "x.py", "python", [])], f"id string, name string, file_path string, language string, calls {ref}")
    assert sorted((r["id"], r["called_by"][0]["name"]) for r in index.reverse_calls(chunks).collect()) == [("2", "FuncA"), ("3", "FuncA")]  # a package in the caller's path is anywhere


def test_streams(spark, tmp_path):
    lines = ['{"type":"system"}', '{"type":"assistant","message":{"content":[{"type":"text","text":"hi"}]}}', "{bad", '{"type":"tool_use","tool":{"name":"Read","input":"{}"}}', '{"type":"result","session_id":"s","total_cost_usd":0.5}']
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(lines)], "k string, seq int, line string")
    assert events.records(df).count() == 4 and events.parse_lines(df).count() == 5
    assert events.tool_counts(events.records(df)).first()["n"] == 1
    assert events.last_result(events.records(df), "k").first()["total_cost_usd"] == 0.5
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": 1, "workflow_id": "w"}\n{"id": 2, "workflow_id": "w"}\n')
    got = []
    q = events.deliver(events.tail(spark, str(tmp_path / "in"), "id long, workflow_id string"), str(tmp_path / "cp"), lambda b, _: got.extend(r["id"] for r in b.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [1, 2]
    assert events.cursor_of(None, "7") == 7 and events.cursor_of("x", "7") == 0 and events.cursor_of(None, None) == 0


def test_queue(spark):
    def after(*actions):
        q = events.Queue()
        for a in actions:
            q = events.step(q, *a.split())
        return q.state, ",".join(f"{i}:{s}" for i, s in q.items), q.pause_reason

    assert after("add a") == ("ready", "a:pending", "")
    assert after("start") == ("idle", "", "") and after("pause") == ("idle", "", "")
    assert after("add a", "remove a") == ("idle", "", "") and after("add a", "remove x") == ("ready", "a:pending", "")
    assert after("add a", "start", "remove a") == ("running", "a:executing", "")
    assert after("add a,b", "start", "done", "done") == ("completed", "a:completed,b:completed", "")
    assert after("add a", "start", "done", "add b") == ("ready", "a:completed,b:pending", "")
    assert after("add a,b", "start", "fail") == ("paused", "a:failed,b:pending", "error")
    assert after("add a,b", "start", "fail", "start") == ("paused", "a:failed,b:pending", "error")  # only a ready queue starts
    assert after("add a,b", "start", "fail", "continue") == ("running", "a:failed,b:executing", "")
    assert after("add a,b", "start", "review") == ("paused", "a:executing,b:pending", "awaiting_review")
    assert after("add a,b", "start", "review", "continue") == ("running", "a:completed,b:executing", "")
    assert after("add a,b", "start", "pause", "done") == ("paused", "a:completed,b:pending", "user_requested")
    assert after("add a,b,c", "start", "reorder c,b", "reorder c") == ("running", "a:executing,c:pending,b:pending", "")
    rows = [("q", i, *a.split()) for i, a in enumerate(["add a,b,c", "reorder c,b,a", "start -", "done -", "fail -"])]
    got = events.queue_states(spark.createDataFrame(rows, "queue_id string, seq int, action string, argument string")).first()
    assert (got["state"], got["items"], got["pause_reason"]) == ("paused", "c:completed,b:failed,a:pending", "error")


def test_phases_states_and_flags(spark):
    names = [f"{p}_{k}_at" for p in ("scope", "build", "verify") for k in ("started", "completed")]
    rows = [("1", "s", "c", "s", None, None, None, None, "running", "x"), ("2", "s", "c", "s", "c", "s", "c", "rejected", "completed", None), ("3", None, "c", None, None, None, None, None, "human_review", None)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in ["id", *names, "human_result", "current_state", "error_message"]))
    got = {}
    for r in warehouse.phase_status(df).collect():
        got.setdefault(r["id"], []).append(r["status"])
    assert got == {"1": ["completed", "failed", "pending", "pending"], "2": ["completed"] * 4, "3": ["pending", "pending", "pending", "active"]}
    met = spark.createDataFrame([("a", "met", True), ("b", "met", True), ("c", "unmet", True)], "doc string, result string, required boolean")
    flags = spark.createDataFrame([("a", False, None, False), ("b", False, True, False), ("c", True, False, False), ("d", None, None, True)], "doc string, drift boolean, issues boolean, concerns boolean")
    assert {r["doc"]: r["status"] for r in documents.report_status(met, ["doc"], flags).collect()} == {"a": "PASS", "b": "WARN", "c": "FAIL", "d": "WARN"}
    tasks = spark.createDataFrame([("t1", "w1", "pending", "2"), ("t2", "w2", "pending", "1"), ("t3", "w3", "pending", "0")], "id string, workflow_id string, state string, created_at string")
    flows = spark.createDataFrame([("w1", "running"), ("w2", "cancelled"), ("w3", "paused")], "id string, current_state string")
    assert [r["id"] for r in warehouse.next_runnable(tasks, flows).collect()] == ["t2", "t1"] and warehouse.next_task(tasks, flows).first()["id"] == "t2"
    tries = spark.createDataFrame([("a", 1, 2, "retryable"), ("b", 1, 2, None), ("c", 1, 2, "fatal"), ("d", 2, 2, None)], "id string, attempts int, max_attempts int, error_class string")
    assert sorted(r["id"] for r in warehouse.retryable(tries).collect()) == ["a", "b"]


def test_known_files(spark):
    rows = [(k, p) for k, p in enumerate(["a.go", " ./x/../a.go ", "", ".", "/a.go", "../a.go", "x/../../a.go", "b.go", "dir/", None, "..hidden"])]
    listing = spark.createDataFrame([("a.go", False), ("dir", True)], "path string, is_dir boolean")
    got = {r["owner"]: r["rule"] for r in documents.known_file_violations(spark.createDataFrame(rows, "owner int, path string"), listing).collect()}
    assert got == {2: 1, 3: 1, 4: 2, 5: 3, 6: 3, 7: 4, 8: 5, 9: 1, 10: 3}


def test_sources(spark, tmp_path):
    root = str(tmp_path / "w")
    assert io.table(spark, root, "events").count() == 0
    row = spark.createDataFrame([(1, "w", None, "x", None, "2026-01-01 00:00:00")], SCHEMAS["events"])
    io.append(row, root, "events")
    assert io.table(spark, root, "events").count() == 1
    with pytest.raises(ValueError):
        assert_schema(row.drop("id"), "events")
    tree = tmp_path / "tree"
    (tree / "node_modules").mkdir(parents=True)
    (tree / "node_modules/x.py").write_text("x")
    (tree / "a.py").write_text("héllo")
    got = io.files(spark, str(tree), include=["*.py"])
    assert [(r["path"], r["language"]) for r in got.collect()] == [("a.py", "python")]
    assert io.languages(got).first()["python"] is True
    assert [(r["preview"], r["cut"]) for r in io.tail_preview(got, 4).collect()] == [("llo", True)]
    (tmp_path / "n.json").write_text('{"type":"symbol"}\nbad\n')
    assert io.ndjson(spark, str(tmp_path / "n.json"), "type string").where("type is not null").count() == 1


def test_enclosing_picks_innermost_or_first(spark):
    sym = spark.createDataFrame([("f", "outer", 1, 100), ("f", "inner", 10, 20)], "file_path string, id string, line_start int, line_end int")
    lines = spark.createDataFrame([("f", 15)], "file_path string, line int")
    assert graph.enclosing(lines, sym).first()["symbol_id"] == "inner"
    assert graph.enclosing(lines, sym, innermost=False).first()["symbol_id"] == "outer"


def test_agreement_definitions(spark):
    df = spark.createDataFrame([("1", "WARN", "approved"), ("2", "PASS", "approved"), ("3", "FAIL", None)], "id string, verify_result string, human_result string")
    assert [r["a"] for r in df.orderBy("id").select(analytics.agreed(F.col("verify_result"), F.col("human_result")).alias("a")).collect()] == [0, 1, None]
    assert warehouse.agreement_pivot(df).first()["agreement_pct"] == 100


ORDER = "order_id string, title string, target_module string, type string, schema_version int, known_files array<string>, requirements array<struct<id: string>>, criteria array<struct<id: string, description: string, required: boolean, kind: string, check: string, requirement_ids: array<string>>>"


def test_work_orders(spark):
    good = {"order_id": "ok", "title": "t", "target_module": "m", "type": "docs", "schema_version": 2, "known_files": ["a"], "requirements": [("r1",)], "criteria": [("c1", "d", True, "manual", None, ["r1"])]}
    bad = [
        ({"title": ""}, [1]), ({"target_module": None}, [2]), ({"type": "odd"}, [3]), ({"known_files": ["a", " "]}, [4]), ({"schema_version": 1}, [5]), ({"requirements": []}, [6, 17]), ({"criteria": []}, [7, 18]),
        ({"requirements": [("r1",), (" ",)]}, [8, 18]), ({"requirements": [("r1",), ("r1",)]}, [9]), ({"criteria": [(None, "d", True, "manual", None, ["r1"])]}, [10]), ({"criteria": good["criteria"] * 2}, [11]),
        ({"criteria": [("c", " ", True, "manual", None, ["r1"])]}, [12]), ({"criteria": [("c", "d", None, "manual", None, ["r1"])]}, [13]), ({"criteria": [("c", "d", True, "", None, ["r1"])]}, [14]), ({"criteria": [("c", "d", True, "manual", None, [])]}, [15, 18]),
        ({"criteria": [("c", "d", True, " precheck", " ", ["r1"])]}, [16]), ({"criteria": [("c", "d", True, "manual", None, ["r1", "x"])]}, [17]), ({"requirements": [("r1",), ("r2",)]}, [18]),
    ]
    rows = [good] + [good | {"order_id": str(k)} | change for k, (change, _) in enumerate(bad)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ORDER)
    got = {}
    for r in validation.work_orders(df).collect():
        got.setdefault(r["order_id"], []).append(r["rule"])
    assert {k: sorted(v) for k, v in got.items()} == {str(k): want for k, (_, want) in enumerate(bad)}


def test_raw_responses_and_routing(spark, tmp_path):
    schema = "response_id string, requirements array<struct<id: string>>, epics array<struct<epic_ref: string, title: string, description: string, covers: array<string>>>"
    epic = ("e", "t", "d", ["r"])
    rows = [("ok", [("r",)], [epic]), ("free", [], [epic]), ("none", None, None), ("dup", [("r",), ("r",)], [epic, epic]), ("bare", [("",)], [(" ", "", None, None)]), ("unknown", [("q",)], [epic])]
    got = {}
    for r in validation.epic_responses(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r["response_id"], []).append(r["rule"])
    assert got == {"none": [1], "dup": [3, 5], "bare": [2, 4, 6, 7], "unknown": [8]}
    tasks = spark.createDataFrame([("a", []), ("b", [("t",), ("t",)]), ("c", [("",)]), ("d", [("t",)])], "response_id string, tasks array<struct<task_ref: string>>")
    assert sorted((r["response_id"], r["rule"]) for r in validation.task_responses(tasks).collect()) == [("a", 1), ("b", 3), ("c", 2)]
    assert validation.model_routing({}, {}, []) == ["providers are needed"] and validation.model_routing({"p": "x"}, {"build": "p"}, ["build"]) == []
    assert len(validation.model_routing({"p": " "}, {"scope": "q"}, ["build", "scope"])) == 3
    (tmp_path / "in").mkdir()
    (tmp_path / "out").symlink_to("/")
    assert validation.safe_path(str(tmp_path), "in/new/x.txt").endswith("/in/new/x.txt") and validation.safe_path(str(tmp_path), "/in").endswith("/in")
    for bad in ("../x", "in/../../x", "out/etc"):
        with pytest.raises(ValueError):
            validation.safe_path(str(tmp_path), bad)


def test_search_parts(spark):
    chunks = spark.createDataFrame([("1", "n", "b", [0.5], "a.go", 9), ("2", "m", "c", [0.1], "a.go", 3)], "id string, name string, body string, embedding array<float>, file_path string, line_start int")
    assert retrieval.metadata(chunks).columns == ["id", "name", "file_path", "line_start"]
    assert [r["id"] for r in index.in_file_order(chunks, "a.go").collect()] == ["2", "1"]
    hits = spark.createDataFrame([(True,), (False,), (None,)], "is_dependency_hop boolean")
    assert tuple(retrieval.hit_counts(hits).first()) == (2, 1)
    texts = spark.createDataFrame([(k, f"t{k}") for k in range(70)], "k int, text string").coalesce(1)
    out = retrieval.embedded(texts, "text", lambda x: [[float(len(t)), float(len(x))] for t in x], query=True).collect()
    assert {r["embedding"][1] for r in out} == {32.0, 6.0} and out[0]["embedding"][0] == len(retrieval.QUERY_PREFIX) + 2
    with pytest.raises(Exception, match="vectors"):
        retrieval.embedded(texts, "text", lambda x: [[0.0]]).collect()
    assert retrieval.searched(lambda: chunks.select("missing"), lambda: chunks, 1).count() == 1 and retrieval.searched(lambda: chunks, lambda: None).count() == 2
    assert one(spark, graph.path_nodes(F.col("a")), a="x>y") == ["x", "y"] and one(spark, documents.first_targets(F.col("a"), 2), a=["x", "y", "z"]) == ["x", "y"]
    refs = spark.createDataFrame([([("f", "p", "x.go")],)], "calls array<struct<name: string, package: string, file: string>>").select(retrieval.code_refs(F.col("calls")).alias("r")).first()["r"]
    assert [tuple(r) for r in refs] == [("f", "x.go")]
    good, bad = (lambda: {"edges": edges(spark, [("A", "B", "CALLS", 1.0)])}), (lambda: 1 / 0)
    tables, errors = graph.analyzed({"go": good, "python": bad, "ts": good})
    assert tables["edges"].count() == 2 and list(errors) == ["python"]


def test_blast_as_text(spark):
    targets = spark.createDataFrame([("t", "Run", "function", "a.go", 1, 9, "func Run()")], "id string, name string, kind string, file_path string, line_start int, line_end int, signature string")
    nodes = spark.createDataFrame([("t", "up", 1, 0.9, "CALLS", "Main", "m.go", 3, "")], "root_id string, direction string, depth int, confidence double, edge_type string, name string, file_path string, line_start int, signature string")
    face = spark.createDataFrame([("t", "Runner", "interface", "r.go", 2)], "root_id string, name string, kind string, file_path string, line_start int")
    text = graph.formatted(targets, nodes, face)
    assert text.startswith("=== STRUCTURAL CONTEXT (call graph) ===\n\nTarget: Run (function)\n  File: a.go:1-9\n  Signature: func Run()\n\n  UPSTREAM")
    assert "    [depth 1, confidence 0.9, CALLS] Main\n      File: m.go:3\n\n  IMPLEMENTS:\n    Runner (interface)\n      File: r.go:2\n" in text
    assert "DOWNSTREAM" not in text and graph.formatted(targets.limit(0), nodes, face) == ""


def test_index_state_and_artifacts(spark, tmp_path):
    known = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    at = str(tmp_path / "hashes")
    assert io.file_hashes(spark, at).count() == 0
    io.save_file_hashes(known, at)
    assert sorted(map(tuple, io.file_hashes(spark, at).collect())) == [("a", "1"), ("b", "2")]
    (tmp_path / "bad.json").write_text("{not json")
    assert io.file_hashes(spark, str(tmp_path / "bad.json")).count() == 0
    assert index.known_hashes(known, "1", "2").count() == 0 and index.known_hashes(known, "2", "2", force=True).count() == 0 and index.known_hashes(known, "2", "2").count() == 2
    stored = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, hash string")
    assert sorted(map(tuple, index.after_upsert(known, stored).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    (tmp_path / "x.txt").write_text("12345")
    root = str(tmp_path / "w")
    row = io.register_artifact(spark, root, {"id": "1", "artifact_type": "report", "path": str(tmp_path / "x.txt")}, "2026-01-01 00:00:00").first()
    assert row["size_bytes"] == 5 and io.table(spark, root, "artifacts").count() == 1
    with pytest.raises(ValueError):
        io.register_artifact(spark, root, {"path": "x"}, "2026-01-01 00:00:00")
    assert io.responses(spark.createDataFrame([(1, None)], "a int, b string")).first()["response"] == '{"a":1}'


def test_reports_as_text(spark):
    rows = [(1, "E1", "First", 1, "T1", "one", "complete"), (1, "E1", "First", 2, "T2", "two", "awaiting-review"), (2, "E2", "Second", 1, "T3", "three", "blocked")]
    df = spark.createDataFrame(rows, "epic_ord int, epic_id string, epic_title string, task_ord int, task_id string, title string, status string")
    assert render.plan_status("p.yaml", df) == "Plan: p.yaml\nSummary: complete 1  failed 0  in-progress 0  awaiting-review 1  blocked 1  not-started 0\n\nE1 First\n  [complete] T1 one\n  [awaiting-review] T2 two\n\nE2 Second\n  [blocked] T3 three\n\n"
    assert render.plan_status("p", df.limit(0)).endswith("not-started 0\n\n")
    chunks = spark.createDataFrame([("a.go", "go", "function", datetime(2026, 1, 2, 3, 4, 5)), ("a.go", "go", "type", datetime(2026, 1, 1)), ("b.md", "markdown", "section", None)], "file_path string, language string, chunk_type string, indexed_at timestamp")
    text = render.chunk_report(chunks)
    assert "Total chunks: 3\n  Indexed at:   2026-01-02 03:04:05\n\nBy language:\n  go: 2\n  markdown: 1\n" in text and text.endswith("Top 10 files by chunk count:\n  a.go: 2\n  b.md: 1\n")
    assert "Total chunks: 0" in render.chunk_report(chunks.drop("indexed_at").limit(0))
    runs = spark.createDataFrame([], SCHEMAS["pipeline_runs"])
    names = SCHEMAS["pipeline_runs"].names
    given = {"id": "r", "workflow_id": "workflow-1", "verify_result": "PASS", "scope_tokens_in": 1234567, "created_at": "2026-01-01 00:00:00", "build_cost_usd": 1.5}
    runs = spark.createDataFrame([tuple(given.get(n) for n in names)], SCHEMAS["pipeline_runs"])
    text = render.pipeline_report(runs)
    assert "PASS 1 (100%)  WARN 0 (0%)" in text and "pending 1" in text and "Scope:   1,234,567 in  /  0 out" in text and "Build cost: $1.50" in text
    assert text.endswith("workflow    -               PASS    -           -         pending     1,234,567\n")
