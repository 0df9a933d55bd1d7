"""Validation of nested documents as rows of violations: a rule is a predicate over the arrays of one row, so nothing is shuffled."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of a work order, and the only version of its schema (fixed values).
ORDER_TYPES = ("new_feature", "bug_fix", "refactor", "schema_change", "docs", "bootstrap")
ORDER_VERSION = 2


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def items(c: str) -> Column:
    """An array column; null counts as empty."""
    return F.coalesce(F.col(c), F.array())


def repeated(names: Column) -> Column:
    return F.size(names) > F.size(F.array_distinct(names))


def violations(rows: DataFrame, key: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """``key, rule, message``: a row for each rule, numbered from 1, that a document breaks."""
    broken = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("rule"), F.lit(m).alias("message"))) for k, (c, m) in enumerate(rules, 1)])
    return rows.select(key, F.inline(F.filter(broken, lambda v: v.isNotNull())))


def work_orders(orders: DataFrame) -> DataFrame:
    """Violations of work orders: ``order_id, title, target_module, type, schema_version, known_files``, ``requirements``
    (``id``) and ``criteria`` (``id, description, required, kind, check, requirement_ids``)."""
    reqs, crits = items("requirements"), items("criteria")
    known = F.transform(reqs, lambda r: r["id"])
    named = F.flatten(F.transform(crits, lambda c: F.coalesce(c["requirement_ids"], F.array().cast("array<string>"))))
    some = lambda test: F.exists(crits, test)
    return violations(orders, "order_id", [
        (F.coalesce("title", F.lit("")) == "", "a title is needed"),
        (F.coalesce("target_module", F.lit("")) == "", "a target module is needed"),
        (~F.coalesce(F.col("type").isin(*ORDER_TYPES), F.lit(False)), "the type is unknown"),
        (F.exists(items("known_files"), blank), "a known file is empty"),
        (~F.col("schema_version").eqNullSafe(F.lit(ORDER_VERSION)), "the schema's version is another one"),
        (F.size(reqs) == 0, "requirements are needed"),
        (F.size(crits) == 0, "criteria are needed"),
        (F.exists(reqs, lambda r: blank(r["id"])), "a requirement lacks its id"),
        (repeated(known), "ids of requirements must differ"),
        (some(lambda c: blank(c["id"])), "a criterion lacks its id"),
        (repeated(F.transform(crits, lambda c: c["id"])), "ids of criteria must differ"),
        (some(lambda c: blank(c["description"])), "a criterion lacks its description"),
        (some(lambda c: c["required"].isNull()), "whether a criterion is required must be said"),
        (some(lambda c: blank(c["kind"])), "a criterion lacks its kind of verification"),
        (some(lambda c: F.coalesce(F.size(c["requirement_ids"]), F.lit(0)) < 1), "a criterion names no requirement"),
        (some(lambda c: (F.trim(c["kind"]) == "precheck") & blank(c["check"])), "a precheck lacks its check"),
        (F.size(F.array_except(named, known)) > 0, "a criterion names an unknown requirement"),
        (F.size(F.array_except(known, named)) > 0, "a requirement is covered by no criterion"),
    ])


def epic_responses(responses: DataFrame) -> DataFrame:
    """Violations of raw epics: ``response_id``, ``requirements`` (``id``), ``epics`` (``epic_ref, title, description, covers``).

    What an epic covers is only checked where the response lists requirements.
    """
    reqs, epics = items("requirements"), items("epics")
    known = F.transform(reqs, lambda r: r["id"])
    covers = F.flatten(F.transform(epics, lambda e: F.coalesce(e["covers"], F.array().cast("array<string>"))))
    return violations(responses, "response_id", [
        (F.size(epics) == 0, "no epics"),
        (F.exists(reqs, lambda r: blank(r["id"])), "a requirement lacks its id"),
        (repeated(known), "ids of requirements must differ"),
        (F.exists(epics, lambda e: blank(e["epic_ref"])), "an epic lacks its ref"),
        (repeated(F.transform(epics, lambda e: e["epic_ref"])), "refs of epics must differ"),
        (F.exists(epics, lambda e: blank(e["title"])), "an epic lacks its title"),
        (F.exists(epics, lambda e: blank(e["description"])), "an epic lacks its description"),
        ((F.size(known) > 0) & (F.size(F.array_except(covers, known)) > 0), "an epic covers an unknown requirement"),
    ])


def task_responses(responses: DataFrame) -> DataFrame:
    """Violations of raw tasks: ``response_id``, ``tasks`` (``task_ref``)."""
    refs = F.transform(items("tasks"), lambda t: t["task_ref"])
    return violations(responses, "response_id", [(F.size(refs) == 0, "no tasks"), (F.exists(refs, blank), "a task lacks its ref"), (repeated(refs), "refs of tasks must differ")])


def model_routing(providers: dict[str, str], roles: dict[str, str], needed: list[str]) -> list[str]:
    """What is wrong with a configuration: ``providers`` name -> type, ``roles`` role -> provider."""
    if not providers:
        return ["providers are needed"]
    found = [f"the type of provider {name} is needed" for name, kind in sorted(providers.items()) if not kind.strip()]
    for role in needed:
        name = roles.get(role, "").strip()
        if not name:
            found.append(f"role {role} is needed")
        elif name not in providers:
            found.append(f"role {role} names the unknown provider {name}")
    return found


def safe_path(root: str, relative: str) -> str:
    """The real path of ``relative`` under ``root``, links followed, parts that don't exist kept; ValueError if it leaves the root."""
    top = os.path.realpath(root)
    path = os.path.realpath(os.path.join(os.path.abspath(root), relative.lstrip("/")))
    if path != top and not path.startswith(top.rstrip("/") + "/"):
        raise ValueError(f"{relative!r} escapes {root!r}")
    return path


# --- the first error, as a check from top to bottom finds it ---


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array())


def _problem(broken: Column, rule: int, *place: Column | int, detail: Column | None = None) -> Column:
    """``place, rule, detail`` if ``broken``, else null; places are compared number by number."""
    at = F.array(*[(F.lit(p) if isinstance(p, int) else p).cast("int") for p in place])
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(at.alias("place"), F.lit(rule).alias("rule"), (F.lit(0) if detail is None else detail).alias("detail")))


def _once(**columns: Column) -> Column:
    """The columns as a generator, which Spark doesn't merge into what reads them: they are worked out once a row."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def _held(values: dict[str, Column], problems) -> Column:
    """Problems of ``problems(values)``, where each value is worked out once; for lambdas, which hold no generator."""
    return F.flatten(F.transform(F.array(F.struct(*[c.alias(name) for name, c in values.items()])), problems))


def _stops(rows: DataFrame, key: str, problems: Column) -> DataFrame:
    """``key, p``: the first problem of each row that has one, worked out once for all that is asked of it."""
    return rows.select(key, F.explode(F.filter(F.array(_first(problems)), lambda p: p.isNotNull())).alias("p"))


def _each(values: Column, problems) -> Column:
    """All problems of an array's elements: ``problems(element, index)`` gives lists of them."""
    return F.flatten(F.transform(values, problems))


def _first(problems: Column) -> Column:
    return F.array_min(F.filter(problems, lambda p: p.isNotNull()))


def _before(values: Column, i: Column, value: Column) -> Column:
    """Whether one of the first ``i`` values is ``value``."""
    return F.array_contains(F.slice(values, F.lit(1), i), value)


def order_problems(order) -> Column:
    """What breaks a rule of ``work_orders`` in an order, with its place. ``order(field)`` is a field's column."""
    reqs, crits = _list(order("requirements")), _list(order("criteria"))
    names = {
        "known": F.transform(reqs, lambda r: _text(r["id"])), "ids": F.transform(crits, lambda c: _text(c["id"])),
        "named": F.flatten(F.transform(crits, lambda c: F.coalesce(c["requirement_ids"], F.array().cast("array<string>")))),
    }

    def of_criterion(c: Column, i: Column, known: Column, ids: Column) -> Column:
        refs, kind = F.coalesce(c["requirement_ids"], F.array().cast("array<string>")), F.trim(_text(c["kind"]))
        single = [(blank(c["id"]), 10), (_before(ids, i, _text(c["id"])), 11), (blank(c["description"]), 12), (c["required"].isNull(), 13), (kind == "", 14), (F.size(refs) == 0, 15), ((kind == "precheck") & blank(c["check"]), 16)]
        unknown = F.transform(refs, lambda r, j: _problem(~F.array_contains(known, _text(r)), 17, 9, i, len(single), j))
        return F.concat(F.array(*[_problem(b, rule, 9, i, k) for k, (b, rule) in enumerate(single)]), unknown)

    head = [(_text(order("title")) == "", 1, 1), (_text(order("target_module")) == "", 2, 2), (~F.coalesce(order("type").isin(*ORDER_TYPES), F.lit(False)), 3, 3)]
    head += [(~order("schema_version").eqNullSafe(F.lit(ORDER_VERSION)), 5, 5), (F.size(reqs) == 0, 6, 6), (F.size(crits) == 0, 7, 7)]
    return _held(names, lambda n: F.concat(
        F.array(*[_problem(b, rule, place) for b, rule, place in head]),
        F.transform(_list(order("known_files")), lambda f, i: _problem(blank(f), 4, 4, i)),
        _each(reqs, lambda r, i: F.array(_problem(blank(r["id"]), 8, 8, i, 0), _problem(_before(n["known"], i, _text(r["id"])), 9, 8, i, 1))),
        _each(crits, lambda c, i: of_criterion(c, i, n["known"], n["ids"])),
        F.transform(reqs, lambda r, i: _problem(~F.array_contains(n["named"], _text(r["id"])), 18, 10, i)),
    ))


def first_order_errors(orders: DataFrame) -> DataFrame:
    """``order_id, rule, place``: the rule of ``work_orders`` that a check of the order from top to bottom stops at.

    Criteria are asked one by one, each for all its fields; ``place`` names the step and the elements it was at.
    """
    return _stops(orders, "order_id", order_problems(F.col)).select("order_id", "p.rule", "p.place")


#: The only version of a plan document (fixed value).
PLAN_VERSION = 1
#: Rules of plan documents by number.
DOCUMENT_RULES = {
    1: "the version is another one", 2: "no epics", 3: "a requirement lacks its id", 4: "ids of requirements must differ", 5: "an epic lacks its ref", 6: "an epic lacks its id", 7: "refs of epics must differ",
    8: "a task lacks its ref", 9: "a task lacks its id", 10: "refs of tasks must differ", 11: "ids of epics must differ", 12: "an epic lacks its title", 13: "an epic lacks its description",
    14: "an epic covers an unknown requirement", 15: "an epic has no tasks", 16: "ids of tasks must differ", 17: "a task lacks its epic", 18: "a task names another epic than its own", 19: "a task is no work order",
    20: "a task names an unknown requirement", 21: "a requirement's text is another one", 22: "an epic depends on an unknown one", 23: "an epic depends on one that isn't earlier", 24: "a task depends on an unknown one", 25: "a task depends on one that isn't earlier",
}


def first_document_errors(plans: DataFrame) -> DataFrame:
    """``plan_id, rule, detail, place, message``: the rule that a check of each plan document stops at.

    ``plans``: ``plan_id, version, requirements`` (``id, text``) and ``epics`` (``id, epic_ref, title, description,
    covers, depends_on_epics, tasks``); tasks have ``id, task_ref, epic_id, depends_on`` and the fields of a work
    order, whose requirements have texts too. ``detail`` is the work order's rule where that is the error. What names
    requirements is only asked where the plan lists some. A plan is one row, so nothing is shuffled.
    """
    rows = plans.select("plan_id", _once(version=F.col("version"), reqs=items("requirements"), epics=items("epics")))
    tasks = F.flatten(F.transform("epics", lambda e, i: F.transform(_list(e["tasks"]), lambda t, j: F.struct(t.alias("t"), i.alias("i"), j.alias("j"), _text(e["id"]).alias("epic")))))
    rows = rows.select("*", _once(
        req_ids=F.transform("reqs", lambda r: _text(r["id"])), epic_ids=F.transform("epics", lambda e: _text(e["id"])),
        epic_refs=F.transform("epics", lambda e: F.trim(_text(e["epic_ref"]))), tasks=tasks,
    ))
    rows = rows.select("*", _once(task_ids=F.transform("tasks", lambda x: _text(x["t"]["id"])), task_refs=F.transform("tasks", lambda x: F.trim(_text(x["t"]["task_ref"])))))
    listed = F.size("req_ids") > 0

    def index(ids: str, value: Column) -> Column:
        """The place of an id, from 0; -1: nowhere."""
        return (F.array_position(ids, value) - 1).cast("int")

    def of_epic(e: Column, i: Column) -> Column:
        single = [(_before(F.col("epic_ids"), i, _text(e["id"])), 11, 1), (blank(e["title"]), 12, 2), (blank(e["description"]), 13, 3), (F.size(_list(e["tasks"])) == 0, 15, 5)]
        covers = F.transform(F.coalesce(e["covers"], F.array().cast("array<string>")), lambda c, k: _problem(listed & (index("req_ids", _text(c)) < 0), 14, 6, i, 4, k))
        return F.concat(F.array(*[_problem(b, rule, 6, i, step) for b, rule, step in single]), covers)

    def of_task(x: Column, n: Column) -> Column:
        t, at = x["t"], (6, x["i"], 6, x["j"])
        single = [(index("task_ids", _text(t["id"])) < n, 16, 1), (blank(t["epic_id"]), 17, 2), (_text(t["epic_id"]) != x["epic"], 18, 3), (~t["schema_version"].eqNullSafe(F.lit(ORDER_VERSION)), 19, 4)]
        heads = F.array(*[_problem(b, rule, *at, step, detail=F.lit(5) if rule == 19 else None) for b, rule, step in single])
        order = _first(order_problems(lambda c: t[c]))
        broken = F.transform(F.array(order), lambda p: _problem(p.isNotNull(), 19, *at, 5, detail=p["rule"]))
        named = _each(_list(t["requirements"]), lambda r, k: F.array(_problem(listed & (index("req_ids", _text(r["id"])) < 0), 20, *at, 6, k, 0), _problem(listed & _other_text(r), 21, *at, 6, k, 1)))
        return F.concat(heads, broken, named)

    def _other_text(r: Column) -> Column:
        held = F.filter("reqs", lambda p: _text(p["id"]) == _text(r["id"]))
        plan = _text(F.get(held, F.lit(0))["text"])
        return (F.size(held) > 0) & (plan != "") & (_text(r["text"]) != "") & (plan != _text(r["text"]))

    def order_of(ids: str, deps: Column, own: Column, stage: int, unknown: int, late: int) -> Column:
        return _each(F.coalesce(deps, F.array().cast("array<string>")), lambda d, k: F.array(_problem(index(ids, _text(d)) < 0, unknown, stage, own, k), _problem(index(ids, _text(d)) >= own, late, stage, own, k)))

    found = F.concat(
        F.array(_problem(~F.col("version").eqNullSafe(F.lit(PLAN_VERSION)), 1, 1), _problem(F.size("epics") == 0, 2, 2)),
        _each(F.col("reqs"), lambda r, i: F.array(_problem(blank(r["id"]), 3, 3, i, 0), _problem(_before(F.col("req_ids"), i, _text(r["id"])), 4, 3, i, 1))),
        _each(F.col("epics"), lambda e, i: F.array(_problem(blank(e["epic_ref"]), 5, 4, i, 0), _problem(blank(e["id"]), 6, 4, i, 1), _problem(_before(F.col("epic_refs"), i, F.trim(_text(e["epic_ref"]))), 7, 4, i, 2))),
        _each(F.col("tasks"), lambda x, n: F.array(_problem(blank(x["t"]["task_ref"]), 8, 5, n, 0), _problem(blank(x["t"]["id"]), 9, 5, n, 1), _problem(_before(F.col("task_refs"), n, F.trim(_text(x["t"]["task_ref"]))), 10, 5, n, 2))),
        _each(F.col("epics"), of_epic),
        _each(F.col("tasks"), of_task),
        _each(F.col("epics"), lambda e, i: order_of("epic_ids", e["depends_on_epics"], i, 7, 22, 23)),
        _each(F.col("tasks"), lambda x, n: order_of("task_ids", x["t"]["depends_on"], n, 8, 24, 25)),
    )
    message = F.element_at(F.create_map(*[F.lit(v) for kv in DOCUMENT_RULES.items() for v in kv]), F.col("p.rule"))
    return _stops(rows, "plan_id", found).select("plan_id", "p.rule", "p.detail", "p.place", message.alias("message"))


def first_epic_response_errors(responses: DataFrame) -> DataFrame:
    """``response_id, rule, place``: the rule of ``epic_responses`` that a check of each response stops at, epic by epic."""
    rows = responses.select("response_id", _once(reqs=items("requirements"), epics=items("epics")))
    rows = rows.select("*", _once(known=F.transform("reqs", lambda r: _text(r["id"])), refs=F.transform("epics", lambda e: _text(e["epic_ref"]))))
    reqs, epics, known, refs = map(F.col, ("reqs", "epics", "known", "refs"))

    def of_epic(e: Column, i: Column) -> Column:
        single = [(blank(e["epic_ref"]), 4), (_before(refs, i, _text(e["epic_ref"])), 5), (blank(e["title"]), 6), (blank(e["description"]), 7)]
        covers = F.transform(F.coalesce(e["covers"], F.array().cast("array<string>")), lambda c, k: _problem((F.size(known) > 0) & ~F.array_contains(known, _text(c)), 8, 3, i, len(single), k))
        return F.concat(F.array(*[_problem(b, rule, 3, i, k) for k, (b, rule) in enumerate(single)]), covers)

    found = F.concat(
        F.array(_problem(F.size(epics) == 0, 1, 1)),
        _each(reqs, lambda r, i: F.array(_problem(blank(r["id"]), 2, 2, i, 0), _problem(_before(known, i, _text(r["id"])), 3, 2, i, 1))),
        _each(epics, of_epic),
    )
    return _stops(rows, "response_id", found).select("response_id", "p.rule", "p.place")


def first_task_response_errors(responses: DataFrame) -> DataFrame:
    """``response_id, rule, detail, place``: the rule of ``task_responses`` that a check stops at, task by task.

    Rule 4: a task can't be made a work order, ``detail`` being the work order's rule; its version is asked first.
    ``tasks`` have a ``task_ref`` and the fields of a work order.
    """
    rows = responses.select("response_id", _once(tasks=items("tasks")))
    rows = rows.select("*", _once(refs=F.transform("tasks", lambda t: _text(t["task_ref"]))))
    tasks, refs = F.col("tasks"), F.col("refs")

    def of_task(t: Column, i: Column) -> Column:
        order = _first(order_problems(lambda c: t[c]))
        heads = F.array(
            _problem(blank(t["task_ref"]), 2, 2, i, 0), _problem(_before(refs, i, _text(t["task_ref"])), 3, 2, i, 1),
            _problem(~t["schema_version"].eqNullSafe(F.lit(ORDER_VERSION)), 4, 2, i, 2, detail=F.lit(5)),
        )
        return F.concat(heads, F.transform(F.array(order), lambda p: _problem(p.isNotNull(), 4, 2, i, 3, detail=p["rule"])))

    found = F.concat(F.array(_problem(F.size(tasks) == 0, 1, 1)), _each(tasks, of_task))
    return _stops(rows, "response_id", found).select("response_id", "p.rule", "p.detail", "p.place")
