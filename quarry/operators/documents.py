"""Nested documents: plans, criteria and reports, budgets of text, validation as rows of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clean_path, criterion_key, file_set, once, result_kind, test_base
from .scans import row_numbers, scanned


def flat_tasks(plans: DataFrame) -> DataFrame:
    """``plan_id, epic_ord, task_ord, epic, task`` of plans with ``epics[].tasks[]``."""
    rows = plans.select("plan_id", F.posexplode("epics").alias("epic_ord", "epic"))
    return rows.select("plan_id", "epic_ord", F.col("epic.id").alias("epic"), F.posexplode("epic.tasks").alias("task_ord", "task"))


def numbered(tasks: DataFrame, group: list[str], order: list[str], prefix: str) -> DataFrame:
    """Canonical ids ``prefix-001`` in order."""
    return row_numbers(tasks, group, order, "_rn").withColumn("canonical_id", F.format_string(f"{prefix}-%03d", "_rn")).drop("_rn")


def remapped(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """``refs`` (``owner, ref``) with ``canonical_id``; unknown refs keep null, which is a violation."""
    return refs.join(ids.select("ref", "canonical_id"), "ref", "left")


def uncovered(requirements: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requirements (``requirement``) that no task (``requirements`` array) names."""
    return requirements.join(tasks.select(F.explode("requirements").alias("requirement")), "requirement", "left_anti")


def first_seen(paths: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each ``key``: the first by ``order``."""
    return paths.groupBy(key).agg(F.min_by(F.struct(*paths.columns), order).alias("r")).select("r.*")


def byte_budget(files: DataFrame, group: list[str], order: list[str], size: Column, cap: int, each: int) -> DataFrame:
    """Files in order until ``cap`` is spent: each at most ``each``, the last cut to what is left. Adds ``taken``."""
    want = F.least(F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)), F.lit(each))
    rows = scanned(files.withColumn("_want", want), group, order, {"want": F.col("_want")}, below={"want": cap})
    return rows.withColumn("taken", F.least("_want", F.lit(cap) - F.col("before_want")).cast("long")).drop("_want", "before_want")


def whole_budget(files: DataFrame, group: list[str], order: list[str], size: Column, cap: int, most: int = 4) -> DataFrame:
    """Whole files in order, ``most`` of them at most, up to the first that would exceed ``cap``."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = files.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= most)  # each task keeps ``most`` of a group
    rows = rows.withColumn("sum_", F.sum(size).over(w))
    over = F.min(F.when(F.col("sum_") > cap, F.col("rn_"))).over(Window.partitionBy(*group))
    return rows.withColumn("over_", over).where(F.col("over_").isNull() | (F.col("rn_") < F.col("over_"))).drop("sum_", "rn_", "over_")


def merged_criteria(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """Each criterion with its worst result (unmet over met over unassessable) and its distinct notes in order.

    ``catalog``: ``id, description, required, ord``; ``results``: ``id, description, result, note, ord``.
    Criteria without result are unassessable; results of unknown criteria stay, as required ones.
    """
    worst = {"unassessable": 0, "met": 1, "unmet": 2}
    rank = reduce(lambda c, kv: F.when(F.col("kind") == kv[0], kv[1]).otherwise(c), worst.items(), F.lit(0))
    got = results.select(criterion_key(F.col("id"), F.col("description")).alias("key"), result_kind(F.col("result")).alias("kind"), "note", "ord").withColumn("rank", rank)
    notes = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "note"))), lambda x: x["note"]))  # notes of one criterion
    got = got.groupBy("key").agg(F.max("rank").alias("rank"), F.filter(notes, lambda n: F.coalesce(n, F.lit("")) != "").alias("notes"), F.min("ord").alias("seen"))
    known = catalog.select(criterion_key(F.col("id"), F.col("description")).alias("key"), F.coalesce("required", F.lit(True)).alias("required"), F.col("ord").alias("cat_ord"))
    rows = known.join(got, "key", "full")
    result = F.when(F.col("rank") == 2, "unmet").when(F.col("rank") == 1, "met").otherwise("unassessable")
    return rows.select("key", result.alias("result"), F.coalesce("required", F.lit(True)).alias("required"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), F.coalesce("cat_ord", F.lit(1 << 20) + F.col("seen")).alias("ord"))


def report_status(criteria: DataFrame, group: list[str], reports: DataFrame | None = None) -> DataFrame:
    """PASS, WARN or FAIL by the worst criterion; whether all are met, and whether all are unmet (false if there are none).

    ``reports`` (``group`` and the booleans ``drift``, ``issues``, ``concerns``: drift of scope or files out of it,
    issues of pattern, concerns) raises a report to WARN where one is true, one without criteria too.
    """
    r, need = F.col("result"), F.coalesce(F.col("required"), F.lit(True))
    level = F.when((r == "unmet") & need, 2).when(r != "met", 1).otherwise(0)
    out = criteria.groupBy(*group).agg(F.max(level).alias("level"), (F.bool_and(r == "met") & (F.count(F.lit(1)) > 0)).alias("all_met"), (F.bool_and(r == "unmet") & (F.count(F.lit(1)) > 0)).alias("all_unmet"))
    if reports is not None:
        flag = F.greatest(*[F.coalesce(F.col(c), F.lit(False)) for c in ("drift", "issues", "concerns")]).cast("int").alias("flag")
        out = reports.select(*group, flag).join(out, group, "left").withColumn("level", F.greatest(F.coalesce("level", F.lit(0)), "flag")).drop("flag").fillna(False, ["all_met", "all_unmet"])
    return out.withColumn("status", F.when(F.col("level") == 2, "FAIL").when(F.col("level") == 1, "WARN").otherwise("PASS")).drop("level")


def segments(files: DataFrame) -> DataFrame:
    """Diff files (``path``) by source, a Go test beside its source; others alone."""
    base = test_base(F.col("path"))
    return files.groupBy(F.when(base == "", F.col("path")).otherwise(base).alias("base")).agg(F.array_sort(F.collect_list("path")).alias("files"))


def stripped_share(paths: DataFrame, listing: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of each document's paths (``doc, path``), the share that does not exist, and whether it exceeds ``threshold``."""
    rows = paths.join(listing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    out = rows.groupBy("doc").agg(F.avg(F.col("there").isNull().cast("int")).alias("stripped"))
    return out.withColumn("rejected", F.col("stripped") > threshold)


def _later_twins(tasks: DataFrame, name: Column, of: list[str]) -> DataFrame:
    """Tasks whose ``name`` an earlier one (by ``ord``) bears too; a null name is no name."""
    rows = tasks.select(*of, "task_id", "ord", F.explode(F.array(name)).alias("_name")).where("_name is not null")  # worked out once a row
    first = rows.groupBy(*of, "_name").agg(F.min("ord").alias("_first"))
    return rows.join(first, [*of, "_name"]).where("ord > _first").drop("_name", "_first")


#: Rules of a plan's tasks by number; the first that fails is a task's error.
def task_violations(tasks: DataFrame, max_files: int = 8, max_criteria: int = 12, of: list[str] | None = None) -> DataFrame:
    """``task_id, rule, message, ord, pos`` of ``task_id, title, known_files, criteria, requirements, depends_on, ord``.

    Of equal titles and file sets the later ones are at fault. ``pos`` is the place of what broke a rule in its list.
    Several plans are told apart by the columns ``of``, which are added.
    """
    of = of or []

    def rule(n: int, rows: DataFrame, message: str, pos: Column | None = None) -> DataFrame:
        return rows.select(*of, "task_id", F.lit(n).alias("rule"), F.lit(message).alias("message"), F.col("ord").cast("long").alias("ord"), (F.lit(0) if pos is None else pos).cast("int").alias("pos"))

    files = once(file_set(F.col("known_files")), lambda s: F.nullif(s, F.lit("")))
    deps = tasks.select(*of, "task_id", "ord", F.posexplode("depends_on").alias("_pos", "dep"))
    earlier = tasks.groupBy(*of, F.col("task_id").alias("dep")).agg(F.max("ord").alias("dep_ord"))
    late = deps.join(earlier, [*of, "dep"], "left").where("dep_ord is null or dep_ord >= ord")
    found = [
        rule(1, tasks.where("coalesce(trim(title), '') = ''"), "a title is needed"),
        rule(2, _later_twins(tasks, F.col("task_id"), of), "ids must be unique"),
        rule(3, _later_twins(tasks, F.lower(F.trim("title")), of), "titles must differ"),
        rule(4, tasks.where(F.size("known_files") > max_files), "too many files"),
        rule(5, tasks.where(F.size("criteria") > max_criteria), "too many criteria"),
        rule(6, late, "dependencies must come earlier", F.col("_pos")),
        rule(7, _later_twins(tasks, files, of), "file sets must differ"),
    ]
    return reduce(DataFrame.unionByName, found)


#: Rule numbers of known files within a plan: 60 and those of ``known_file_violations``.
KNOWN_FILE = 60
#: The order in which a task's rules are asked: known files come before dependencies.
_ASKED = {3: 1, 4: 2, 5: 3, 6: 5, 7: 6}


def plan_violations(requirements: DataFrame, tasks: DataFrame) -> DataFrame:
    """Those of the tasks, and requirements (``requirement``) that no task covers, as rule 8 with ``task_id`` the requirement's."""
    open_ = uncovered(requirements.select("requirement"), tasks)
    held = task_violations(tasks).select("task_id", "rule", "message")
    return held.unionByName(open_.select(F.col("requirement").alias("task_id"), F.lit(8).alias("rule"), F.lit("no task covers the requirement").alias("message")))


def first_plan_errors(requirements: DataFrame, tasks: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """``plan_id, task_id, rule, message``: the error that a check of each plan from first to last task stops at.

    ``tasks`` as for ``task_violations`` with ``plan_id``; of a task its title, its number of files and of criteria, its
    known files one by one (where a ``listing`` of the repository is given), its dependencies one by one and its file set
    are asked. Requirements (``plan_id, requirement, ord``) are asked once all tasks are in order. Titles and ids are
    taken as present and unique, as an earlier check (``first_document_errors``) has it.
    """
    of = ["plan_id"]
    asked = lambda rule: F.coalesce(*[F.when(rule == k, F.lit(v)) for k, v in _ASKED.items()])
    place = lambda step: F.struct(F.lit(0).alias("stage"), F.col("ord"), step.alias("step"), F.col("pos"))
    cells = lambda: F.struct("task_id", "rule", "message")
    rows = task_violations(tasks, of=of).where(F.col("rule").isin(*_ASKED))
    found = rows.select("plan_id", place(asked(F.col("rule"))).alias("place"), cells().alias("error"))
    if listing is not None:
        files = tasks.select("plan_id", "task_id", "ord", F.posexplode("known_files").alias("pos", "path"))
        bad = known_file_violations(files.select(F.struct("plan_id", "task_id", F.col("ord").cast("long").alias("ord"), "pos").alias("owner"), "path"), listing)
        bad = bad.select("owner.*", (F.col("rule") + KNOWN_FILE).alias("rule"), "message")
        found = found.unionByName(bad.select("plan_id", place(F.lit(4)).alias("place"), cells().alias("error")))
    named = tasks.select("plan_id", F.explode("requirements").alias("requirement"))
    open_ = requirements.join(named, ["plan_id", "requirement"], "left_anti")
    last = F.struct(F.lit(1).alias("stage"), F.col("ord").cast("long").alias("ord"), F.lit(0).alias("step"), F.lit(0).alias("pos"))
    found = found.unionByName(open_.select("plan_id", last.alias("place"), F.struct(F.col("requirement").alias("task_id"), F.lit(8).alias("rule"), F.lit("no task covers the requirement").alias("message")).alias("error")))
    return found.groupBy("plan_id").agg(F.min(F.struct("place", "error")).alias("first")).select("plan_id", "first.error.*")


def known_file_violations(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``owner, path, rule, message`` of known files (``owner, path``): the first rule that one breaks.

    ``listing``: ``path, is_dir`` of what is there, relative to the root. Paths are trimmed and cleaned first.
    """
    raw = F.trim(F.coalesce("path", F.lit("")))
    rows = files.withColumns({"clean": clean_path(raw), "rooted": raw.startswith("/")})
    there = listing.groupBy(F.col("path").alias("clean")).agg(F.max("is_dir").alias("is_dir"))
    rows = rows.join(there, "clean", "left")
    rules = [
        (F.col("clean") == ".", "invalid path"),
        (F.col("rooted"), "the path must be relative"),
        (F.col("clean").startswith(".."), "the path escapes the root"),
        (F.col("is_dir").isNull(), "the path does not exist"),
        (F.col("is_dir"), "the path is a directory"),
    ]
    rule = F.coalesce(*[F.when(c, F.struct(F.lit(k + 1).alias("rule"), F.lit(m).alias("message"))) for k, (c, m) in enumerate(rules)])
    return rows.withColumn("v", rule).where("v is not null").select("owner", "path", "v.*")


def first_error(violations: DataFrame) -> DataFrame:
    return violations.groupBy("task_id").agg(F.min(F.struct("rule", "message")).alias("v")).select("task_id", "v.*")


def overridden(config: DataFrame) -> DataFrame:
    """The value that holds: of the workflow, else the session, else the project."""
    return config.withColumn("value", F.coalesce(*[F.nullif(F.col(f"{k}_value"), F.lit("")) for k in ("workflow", "session", "project")]))


def roles(role_table: DataFrame, providers: DataFrame) -> DataFrame:
    return role_table.join(providers.select("provider", "model"), "provider", "left").withColumn("model", F.coalesce("model", F.lit(""))).orderBy("role")


#: Fields of a work order that a plan's task gives (fixed values).
ORDER_FIELDS = ("schema_version", "title", "type", "target_module", "reference_module", "known_files", "requirements", "acceptance_criteria", "constraints", "audit_source")


def work_orders(tasks: DataFrame) -> DataFrame:
    """Flattened plan tasks (``flat_tasks``) as work orders: one struct of a task's id, its epic and ``ORDER_FIELDS``; what a task lacks is null."""
    t, have = F.col("task"), set(tasks.schema["task"].dataType.names)
    given = [(t[c] if c in have else F.lit(None).cast("string")).alias(c) for c in ORDER_FIELDS]
    return tasks.select("plan_id", F.struct(t["id"].alias("id"), F.col("epic").alias("epic_id"), *given).alias("work_order"))


def one_task(tasks: DataFrame, task_id: str) -> DataFrame:
    """A task with its epic; no row if the plan lacks it."""
    return tasks.where(F.col("task.id") == task_id)


def assembled(epics: DataFrame, responses: DataFrame) -> DataFrame:
    """A plan's epics (``epic_ord, epic``) with the tasks answered for each (``epic_ord, task_ord, task``), in order."""
    held = responses.groupBy("epic_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("task_ord", "task"))), lambda x: x["task"]).alias("tasks"))  # tasks of one epic
    return epics.join(held, "epic_ord", "left").withColumn("tasks", F.coalesce("tasks", F.array().cast(held.schema["tasks"].dataType)))


def tagged_by_audit(tasks: DataFrame) -> DataFrame:
    """Audited tasks (``change``): only added and modified ones carry their source."""
    return tasks.withColumn("audit_source", F.when(F.col("change").isin("added", "modified"), F.col("change")))


def audited_plans(responses: DataFrame) -> DataFrame:
    """Audit responses (``version, epics[].tasks[]`` with ``audit_action``) as plan documents: an added or modified task carries
    its action as ``audit_source``, others what they had; a version of 0 or none is 1."""
    def task(t: Column) -> Column:
        kept = F.when(t["audit_action"].isin("added", "modified"), t["audit_action"]).otherwise(t["audit_source"])
        return t.withField("audit_source", kept).dropFields("audit_action")

    epics = F.transform("epics", lambda e: e.withField("tasks", F.transform(e["tasks"], task)))
    version = F.when(F.coalesce("version", F.lit(0)) == 0, 1).otherwise(F.col("version"))
    return responses.withColumns({"version": version, "epics": epics})


def subject_segments(subjects: DataFrame, segments_: DataFrame) -> DataFrame:
    """Segments (``base, files``) that criteria's subjects (``subject``) name, and a synthetic one for each that none holds."""
    held = segments_.select("base", F.explode("files").alias("subject"))
    rows = subjects.select("subject").distinct().join(held, "subject", "left")
    return rows.select("subject", F.coalesce("base", "subject").alias("base"), F.col("base").isNull().alias("synthetic"))


def split_scope(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Scope output (``doc, path, kind`` of modify, new or reference; ``ord``): missing files to modify or
    to refer to are stripped, new files that exist are to be modified, after all others."""
    rows = paths.join(listing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    moved = (F.col("kind") == "new") & F.col("there")
    rows = rows.where((F.col("kind") == "new") | F.col("there"))
    return rows.select("doc", "path", F.when(moved, "modify").otherwise(F.col("kind")).alias("kind"), (F.col("ord") + F.when(moved, 1_000_000).otherwise(0)).alias("ord"))


def file_tree(paths: DataFrame, most: int = 200) -> DataFrame:
    """Sorted paths, ``most`` of them, with their directories, each before its first file: ``entry, depth, is_dir, ord``."""
    rows = paths.select("path").distinct().orderBy("path").limit(most)
    rows = rows.withColumn("n", F.row_number().over(Window.orderBy("path")))  # at most ``most`` rows
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("entry"), i.alias("depth"), (i < F.size(parts)).alias("is_dir")))
    out = rows.select("n", F.inline(heads))
    return out.groupBy("entry", "depth", "is_dir").agg(F.min("n").alias("n")).withColumn("ord", F.row_number().over(Window.orderBy("n", "depth")))


def diff_stat(summaries: DataFrame) -> DataFrame:
    """``additions, deletions, files`` of text such as ``3 files changed, 10 insertions(+), 2 deletions(-)``; names count as files."""
    n = lambda pattern: F.coalesce(F.expr(f"try_cast(regexp_extract(summary, '{pattern}', 1) as bigint)"), F.lit(0))
    return summaries.withColumns({"additions": n(r"(\\d+) insertion"), "deletions": n(r"(\\d+) deletion"), "files": F.size("names")})


def text_changes(plans: DataFrame) -> DataFrame:
    """Lines of an audit's change text that say something."""
    return plans.withColumn("changes", F.filter(F.split(F.coalesce("audit_change_text", F.lit("")), "\n"), lambda x: F.trim(x) != ""))


def descriptions(criteria: Column) -> Column:
    """Descriptions of typed criteria, in order."""
    return F.transform(criteria, lambda c: c["description"])


def first_targets(targets: Column, n: int) -> Column:
    """The first ``n``, in order."""
    return F.slice(targets, 1, n)
