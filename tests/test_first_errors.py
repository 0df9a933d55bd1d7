"""First errors of work orders and plans against a sequential check, written out plainly."""

import random

from quarry.operators import documents, validation

CRITERION = "id string, description string, required boolean, kind string, check string, requirement_ids array<string>"
FIELDS = f"title string, target_module string, type string, schema_version int, known_files array<string>, requirements array<struct<id: string, text: string>>, criteria array<struct<{CRITERION.replace(' string', ': string').replace(' boolean', ': boolean').replace(' array', ': array')}>>"
TASK = "id: string, task_ref: string, epic_id: string, depends_on: array<string>, " + ", ".join(f"{n}: {k}" for n, k in (f.split(" ", 1) for f in ["title string", "target_module string", "type string", "schema_version int", "known_files array<string>", "requirements array<struct<id: string, text: string>>"]))
TASK += f", criteria: array<struct<{CRITERION.replace(' string', ': string').replace(' boolean', ': boolean').replace(' array', ': array')}>>"
PLAN = f"plan_id string, version int, requirements array<struct<id: string, text: string>>, epics array<struct<id: string, epic_ref: string, title: string, description: string, covers: array<string>, depends_on_epics: array<string>, tasks: array<struct<{TASK}>>>>"


def blank(x):
    return not (x or "").strip()


def order_error(o):
    if not o["title"]:
        return 1
    if not o["target_module"]:
        return 2
    if o["type"] not in validation.ORDER_TYPES:
        return 3
    if any(blank(f) for f in o["known_files"] or []):
        return 4
    if o["schema_version"] != 2:
        return 5
    if not o["requirements"]:
        return 6
    if not o["criteria"]:
        return 7
    known = []
    for r in o["requirements"]:
        if blank(r[0]):
            return 8
        if r[0] in known:
            return 9
        known.append(r[0])
    seen, named = [], set()
    for i, description, required, kind, check, refs in o["criteria"]:
        for broken, rule in ((blank(i), 10), (i in seen, 11), (blank(description), 12), (required is None, 13), (blank(kind), 14), (not refs, 15), ((kind or "").strip() == "precheck" and blank(check), 16)):
            if broken:
                return rule
        seen.append(i)
        for r in refs:
            if r not in known:
                return 17
            named.add(r)
    return 18 if set(known) - named else None


def a_order(rng, **more):
    some = lambda good, *bad: rng.choice(bad) if rng.random() < 0.04 else good
    reqs = [(some(f"r{k}", "", "r0"), some("", f"text {k}", "other")) for k in range(some(2, 0, 3))]
    crits = [(some(f"c{k}", " ", "c0", None), some("d", ""), some(True, None, False), some(rng.choice(["manual", " precheck "]), ""), some("x", " "), some([f"r{k % 2}"], [], None, ["r0", "zz"])) for k in range(some(2, 0, 1))]
    return {"title": some("t", "", None), "target_module": some("m", ""), "type": some("docs", "odd", None), "schema_version": some(2, 1, None), "known_files": some(["a"], ["a", " "], None, []), "requirements": some(reqs, None), "criteria": some(crits, None)} | more


def test_first_order_error_is_the_sequential_one(spark):
    rng = random.Random(3)
    orders = [a_order(rng) for _ in range(1500)]
    df = spark.createDataFrame([(str(k), *o.values()) for k, o in enumerate(orders)], f"order_id string, {FIELDS}")
    got = {int(r["order_id"]): r["rule"] for r in validation.first_order_errors(df).collect()}
    want = {k: e for k, o in enumerate(orders) if (e := order_error(o))}
    assert got == want and set(want.values()) == set(range(1, 19))


def document_error(p):
    if p["version"] != 1:
        return 1, 0
    if not p["epics"]:
        return 2, 0
    texts = {}
    for i, text in p["requirements"]:
        if blank(i):
            return 3, 0
        if i in texts:
            return 4, 0
        texts[i] = text or ""
    refs = set()
    for e in p["epics"]:
        ref = (e["epic_ref"] or "").strip()
        for broken, rule in ((not ref, 5), (blank(e["id"]), 6), (ref in refs, 7)):
            if broken:
                return rule, 0
        refs.add(ref)
    tasks, refs = [t for e in p["epics"] for t in e["tasks"] or []], set()
    for t in tasks:
        ref = (t["task_ref"] or "").strip()
        for broken, rule in ((not ref, 8), (blank(t["id"]), 9), (ref in refs, 10)):
            if broken:
                return rule, 0
        refs.add(ref)
    epic_at, task_at = {}, {}
    for n, e in enumerate(p["epics"]):
        if e["id"] in epic_at:
            return 11, 0
        epic_at[e["id"]] = n
        for broken, rule in ((blank(e["title"]), 12), (blank(e["description"]), 13), (texts and any(c not in texts for c in e["covers"] or []), 14), (not e["tasks"], 15)):
            if broken:
                return rule, 0
        for t in e["tasks"]:
            if t["id"] in task_at:
                return 16, 0
            task_at[t["id"]] = len(task_at)
            if blank(t["epic_id"]):
                return 17, 0
            if t["epic_id"] != e["id"]:
                return 18, 0
            if t["schema_version"] != 2:
                return 19, 5
            if order_error(t):
                return 19, order_error(t)
            for i, text in t["requirements"] if texts else []:
                if i not in texts:
                    return 20, 0
                if texts[i] and text and texts[i] != text:
                    return 21, 0
    for at, held, deps, rules in ((epic_at, p["epics"], "depends_on_epics", (22, 23)), (task_at, tasks, "depends_on", (24, 25))):
        for n, x in enumerate(held):
            for d in x[deps] or []:
                if d not in at:
                    return rules[0], 0
                if at[d] >= n:
                    return rules[1], 0
    return None


def a_plan(rng):
    some = lambda good, *bad: rng.choice(bad) if rng.random() < 0.02 else good
    epics, n = [], 0
    for k in range(rng.choice([1, 2, 3])):
        tasks = []
        for _ in range(some(2, 0, 1)):
            order = a_order(rng) if rng.random() < 0.1 else a_order(random.Random(1), requirements=[(some("r0", "r9"), some("", "text 0", "other"))], criteria=[("c", "d", True, "manual", None, ["r0"])], title="t", target_module="m", type="docs", schema_version=2, known_files=["a"])
            if order["requirements"] and order["requirements"][0][0] == "r9":
                order["criteria"] = [("c", "d", True, "manual", None, ["r9"])]
            tasks.append({"id": some(f"t{n}", "", "t0"), "task_ref": some(f"a{n}", " ", "a0 "), "epic_id": some(f"e{k}", " ", "e9"), "depends_on": some([f"t{n - 1}"] if n else [], ["t0"], ["zz"], [f"t{n + 1}"], None)} | order)
            n += 1
        epics.append({"id": some(f"e{k}", " ", "e0"), "epic_ref": some(f"b{k}", "", " b0"), "title": some("x", " "), "description": some("y", ""), "covers": some(["r0"], ["q"], None), "depends_on_epics": some([f"e{k - 1}"] if k else [], ["e0"], ["zz"]), "tasks": tasks})
    return {"version": some(1, 2, None), "requirements": some([("r0", "text 0"), ("r1", "")], [], [(" ", "")], [("r0", ""), ("r0", "")]), "epics": some(epics, [], None)}


def test_first_document_error_is_the_sequential_one(spark):
    rng = random.Random(8)
    plans = [a_plan(rng) for _ in range(2500)]
    order = ["id", "task_ref", "epic_id", "depends_on", "title", "target_module", "type", "schema_version", "known_files", "requirements", "criteria"]
    rows = [(str(k), p["version"], p["requirements"], None if p["epics"] is None else [(*[e[c] for c in ("id", "epic_ref", "title", "description", "covers", "depends_on_epics")], [tuple(t[c] for c in order) for t in e["tasks"]]) for e in p["epics"]]) for k, p in enumerate(plans)]
    got = {int(r["plan_id"]): (r["rule"], r["detail"]) for r in validation.first_document_errors(spark.createDataFrame(rows, PLAN)).collect()}
    want = {k: e for k, p in enumerate(plans) if (e := document_error(p))}
    assert got == want
    assert {r for r, _ in want.values()} == set(validation.DOCUMENT_RULES)


def test_first_errors_of_raw_responses(spark):
    epic = "epic_ref: string, title: string, description: string, covers: array<string>"
    good = ("e", "t", "d", ["r"])
    rows = [
        ("ok", [("r",)], [good]), ("free", [], [("e", "t", "d", ["zz"])]), ("none", [(" ",)], None), ("id", [("r",), (" ",), ("r",)], [good]), ("dup", [("r",), ("r",)], [("", "", "", [])]),
        ("second", [("r",)], [("e", "t", " ", ["zz"]), ("", "t", "d", [])]), ("twin", [("r",)], [good, good]), ("covers", [("r",)], [("e", "t", "d", ["r", "zz"]), ("", "", "", [])]),
    ]
    df = spark.createDataFrame(rows, f"response_id string, requirements array<struct<id: string>>, epics array<struct<{epic}>>")
    assert {r["response_id"]: r["rule"] for r in validation.first_epic_response_errors(df).collect()} == {"none": 1, "id": 2, "dup": 3, "second": 7, "twin": 5, "covers": 8}
    order = a_order(random.Random(1), title="t", target_module="m", type="docs", schema_version=2, known_files=[], requirements=[("r0", "")], criteria=[("c", "d", True, "manual", None, ["r0"])])
    task = lambda ref, **more: (ref, *(order | more).values())
    fields = TASK.split("depends_on: array<string>, ")[1]
    rows = [("ok", [task("a"), task("b")]), ("none", None), ("ref", [task("a"), task(" ")]), ("twin", [task("a"), task("a", title="")]), ("order", [task("a", title=""), task("")]), ("version", [task("a", title="", schema_version=1)]), ("late", [task("a"), task("b", criteria=[("c", "d", True, "manual", None, ["zz"])])])]
    df = spark.createDataFrame(rows, f"response_id string, tasks array<struct<task_ref: string, {fields}>>")
    assert {r["response_id"]: (r["rule"], r["detail"]) for r in validation.first_task_response_errors(df).collect()} == {"none": (1, 0), "ref": (2, 0), "twin": (3, 0), "order": (4, 1), "version": (4, 5), "late": (4, 17)}


def test_first_plan_errors(spark):
    """Tasks one by one: of each its title, sizes, known files, dependencies, file set; requirements at last."""
    tasks = [
        ("a", "t1", "Same", ["x"], ["c"], ["r"], [], 1), ("a", "t2", " same ", ["gone"], ["c"], [], [], 2),  # the title comes before the missing file
        ("b", "t1", "One", ["x", "gone"], ["c"], ["r"], ["t9"], 1),  # the file before the dependency
        ("c", "t1", "One", ["x"], ["c"], ["r"], ["t2"], 1), ("c", "t2", "one", [], [], [], [], 2),  # the earlier task first
        ("d", "t1", "One", ["x", "y"], ["c"], [], [], 1), ("d", "t2", "Two", ["./y", "x "], ["c"], [], ["t1"], 2),
        ("e", "t1", "One", ["x"], ["c"] * 13, ["r"], [], 1), ("f", "t1", "One", ["x"], ["c"], ["q"], [], 1), ("g", "t1", "One", ["x"], ["c"], ["r"], [], 1), ("g", "t2", "Two", ["f"] * 9, ["c"] * 13, ["r"], [], 2),
    ]
    df = spark.createDataFrame(tasks, "plan_id string, task_id string, title string, known_files array<string>, criteria array<string>, requirements array<string>, depends_on array<string>, ord int")
    needs = spark.createDataFrame([(p, r, k) for p in "abcdefg" for k, r in enumerate(["r"] if p != "f" else ["q", "s", "r"])], "plan_id string, requirement string, ord int")
    listing = spark.createDataFrame([("x", False), ("y", False)], "path string, is_dir boolean")
    got = {r["plan_id"]: (r["task_id"], r["rule"]) for r in documents.first_plan_errors(needs, df, listing).collect()}
    assert got == {"a": ("t2", 3), "b": ("t1", 64), "c": ("t1", 6), "d": ("t2", 7), "e": ("t1", 5), "f": ("s", 8), "g": ("t2", 4)}
    assert "b" in {r["plan_id"] for r in documents.first_plan_errors(needs, df).where("rule = 6").collect()}


def test_problems_are_worked_out_once(spark):
    """What is asked of the first problem doesn't repeat the check in the plan; a task's order is checked once too."""
    order = spark.createDataFrame([], f"order_id string, {FIELDS}")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(validation.first_order_errors(order)).count("array_min(") == 1
    assert plan(validation.first_document_errors(spark.createDataFrame([], PLAN))).count("array_min(") == 2
