"""Telemetry queries: filters, lists, joins, latest rows and aggregates over runs, sub-calls and plans.

Pure functions of DataFrames; the clock and every parameter are passed in. Where
several rows could answer, ties are broken by id.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import like_prefix, percent, seconds_between, share, since_text


def _count(when: Column) -> Column:
    return F.count_if(when).cast("long")


def _sum_if(when: Column) -> Column:
    """Null over no rows, as SUM(CASE ...) is."""
    return F.sum(F.when(when, 1).otherwise(0)).cast("long")


def parse_range(text: str, now: datetime) -> str | None:
    """``7d``, ``90d`` or ``all`` (no bound); anything else is 30 days. RFC 3339."""
    days = {"7d": 7, "90d": 90, "all": None}.get(text, 30)
    return None if days is None else (now - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%SZ")


def point(df: DataFrame, id_: str) -> DataFrame:
    return df.where(F.col("id") == id_).limit(1)


def by_key(df: DataFrame, key: str, value: str, order: str, descending: bool = False) -> DataFrame:
    """Rows of one parent, ordered; equal ones by id the same way."""
    way = F.desc if descending else F.asc
    return df.where(F.col(key) == value).orderBy(way(order), way("id"))


def optional(df: DataFrame, since: str | None = None, project: str | None = None) -> DataFrame:
    """Bounds that are None do not apply."""
    if since:
        df = df.where(since_text(F.col("created_at"), since))
    return df.where(F.col("project") == project) if project else df


def by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(like_prefix(F.col("id"), prefix)).orderBy(F.desc("created_at"), F.desc("id"))


def newest(df: DataFrame, state: str | None = None, limit: int = 0, state_column: str = "state") -> DataFrame:
    """Newest first, of one state if given; a limit of 0 sets none."""
    if state:
        df = df.where(F.col(state_column) == state)
    df = df.orderBy(F.desc("created_at"), F.desc("id"))
    return df.limit(limit) if limit else df


def verdicts(runs: DataFrame) -> DataFrame:
    """Agreement label and token total of each run."""
    v, h = F.col("verify_result"), F.col("human_result")
    label = F.when(v.isNull() | h.isNull(), "pending").when(v == "WARN", "match").when(((v == "PASS") & (h == "approved")) | ((v == "FAIL") & (h == "rejected")), "match").otherwise("mismatch")
    total = sum((F.coalesce(F.col(f"{p}_tokens_{d}"), F.lit(0)) for p in ("scope", "build", "verify") for d in ("in", "out")), F.lit(0).cast("long"))
    return runs.withColumns({"agreement": label, "total_tokens": total})


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return verdicts(runs).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


#: States of a workflow in which none of its tasks runs (fixed values).
BLOCKED = ("paused", "human_review", "awaiting_review", "review_needed", "completed", "failed")


def next_runnable(tasks: DataFrame, workflows: DataFrame) -> DataFrame:
    """Pending tasks of workflows that may run, oldest first."""
    live = workflows.where(~F.col("current_state").isin(*BLOCKED)).select(F.col("id").alias("workflow_id"), "current_state")
    return tasks.where("state = 'pending'").join(live, "workflow_id").orderBy("created_at", "id")


def next_task(tasks: DataFrame, workflows: DataFrame) -> DataFrame:
    """The oldest task that may run, if there is one."""
    return next_runnable(tasks, workflows).limit(1)


def claimable(tasks: DataFrame, workflows: DataFrame) -> DataFrame:
    """Runnable tasks whose workflow is within its depth and file budgets and that have attempts left."""
    room = workflows.where("current_depth < max_depth and files_changed < max_files_changed").select(F.col("id").alias("workflow_id"))
    return next_runnable(tasks, workflows).join(room, "workflow_id", "left_semi").where("attempts < max_attempts")


def latest_per_task(runs: DataFrame, workflows: DataFrame | None = None) -> DataFrame:
    """One row a plan task: its newest run, the greatest id among equally new ones."""
    rows = runs.where(F.col("plan_task_id").isNotNull())
    if workflows is not None:
        rows = rows.join(workflows.select(F.col("id").alias("workflow_id"), "current_state"), "workflow_id")
    newest = Window.partitionBy("plan_task_id").orderBy(F.desc("created_at"), F.desc("id"))  # tasks keep one row each before rows move
    return rows.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def latest_per_workflow(runs: DataFrame) -> DataFrame:
    """The newest runs of each workflow; equally new ones all stay."""
    last = runs.groupBy("workflow_id").agg(F.max("created_at").alias("created_at"))
    return runs.join(last, ["workflow_id", "created_at"], "left_semi")


def call_totals(calls: DataFrame) -> DataFrame:
    """Cost and calls of each run, summed before any join."""
    return calls.groupBy(F.col("pipeline_run_id").alias("id")).agg(F.sum("estimated_cost_usd").alias("call_cost"), F.count(F.lit(1)).alias("calls"))


def workflow_list(workflows: DataFrame, runs: DataFrame, calls: DataFrame, status: str | None = None, project: str | None = None, limit: int = 50, offset: int = 0, session: str | None = None) -> DataFrame:
    """Workflows with their latest run and its call cost: running first, then in review (human or awaited), newest within each.

    A ``limit`` of 0 or less is 50, a negative ``offset`` 0.
    """
    limit, offset = limit if limit > 0 else 50, max(offset, 0)
    last = latest_per_workflow(runs).join(call_totals(calls), "id", "left")
    last = last.select("workflow_id", F.col("id").alias("run_id"), "project", "session_id", "verify_result", "human_result", F.coalesce("call_cost", F.lit(0.0)).alias("call_cost"))
    rows = workflows.select(F.col("id").alias("workflow_id"), "current_state", "updated_at").join(last, "workflow_id", "left")
    if status:
        rows = rows.where(F.col("current_state") == status)
    for column, value in (("project", project), ("session_id", session)):
        rows = rows.where(F.col(column) == value) if value else rows
    first = F.when(F.col("current_state") == "running", 0).when(F.col("current_state").isin("human_review", "awaiting_review"), 1).otherwise(2)
    return rows.orderBy(first, F.desc("updated_at"), "workflow_id", "run_id").offset(offset).limit(limit)


def session_list(sessions: DataFrame, runs: DataFrame, plan_runs: DataFrame, workflows: DataFrame) -> DataFrame:
    """Sessions with counts of their runs and plan runs and the state of their newest workflow."""
    n_runs = runs.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_runs"))
    n_plans = plan_runs.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_plans"))
    state = runs.where("session_id is not null").groupBy("session_id").agg(F.max_by("workflow_id", F.struct("created_at", "id")).alias("workflow_id"))
    state = state.join(workflows.select(F.col("id").alias("workflow_id"), "current_state"), "workflow_id", "left").select("session_id", "current_state")
    out = sessions.withColumnRenamed("id", "session_id")
    for more in (n_runs, n_plans, state):
        out = out.join(more, "session_id", "left")
    return out.fillna(0, ["n_runs", "n_plans"])


def workflow_detail(workflows: DataFrame, runs: DataFrame, calls: DataFrame, workflow_id: str) -> DataFrame:
    """One workflow, its latest run if any, and the run's calls in order as an array."""
    own = workflows.where(F.col("id") == workflow_id).select(F.col("id").alias("workflow_id"), "current_state")
    last = newest(runs.where(F.col("workflow_id") == workflow_id), limit=1).select("workflow_id", F.col("id").alias("run_id"), "verify_result")
    held = calls.select(F.col("pipeline_run_id").alias("run_id"), F.struct("id", "phase", "step").alias("call")).join(last.select("run_id"), "run_id")
    held = held.groupBy("run_id").agg(F.array_sort(F.collect_list("call")).alias("calls"))  # calls of one run
    return own.join(last, "workflow_id", "left").join(held, "run_id", "left")


def session_detail(session_id: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """The session and its rows in each of the tables given."""
    out = {"session": point(tables.pop("sessions"), session_id)}
    return out | {name: by_key(t, "session_id", session_id, "created_at", descending=True) for name, t in tables.items()}


def run_of_workflow(runs: DataFrame, workflow_id: str) -> DataFrame:
    return runs.where(F.col("workflow_id") == workflow_id).orderBy(F.desc("created_at"), "id").limit(1)


def latest_artifact(artifacts: DataFrame, kind: str, session_id: str | None = None, workflow_id: str | None = None) -> DataFrame:
    if not session_id and not workflow_id:
        raise ValueError("a session or a workflow is needed")
    rows = artifacts.where(F.col("artifact_type") == kind)
    for column, value in (("session_id", session_id), ("workflow_id", workflow_id)):
        rows = rows.where(F.col(column) == value) if value else rows
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def state_mirror(runs: DataFrame, sessions: DataFrame, workflows: DataFrame) -> DataFrame:
    """The state that each run-only session takes from its workflow: review by a human is awaited, what hasn't ended runs."""
    held = sessions.where("kind = 'run_only'").select(F.col("id").alias("session_id"), F.col("state").alias("was"))
    rows = runs.select("session_id", "workflow_id").distinct().join(held, "session_id").join(workflows.select(F.col("id").alias("workflow_id"), "current_state"), "workflow_id")
    s = F.col("current_state")
    to = F.when(s == "human_review", "awaiting_review").when(s.isin("completed", "failed"), s).otherwise("running")
    return rows.withColumn("state", to)


# --- aggregates -------------------------------------------------------------


def pipeline_stats(runs: DataFrame) -> DataFrame:
    """Global counts, mean phase durations and sums; sums over no rows stay null."""
    outs = [F.count(F.lit(1)).alias("total_runs")]
    outs += [_sum_if(F.col("verify_result") == r).alias(f"verify_{r.lower()}") for r in ("PASS", "WARN", "FAIL")]
    outs += [_sum_if(F.col("human_result") == r).alias(f"human_{r}") for r in ("approved", "rejected")] + [_sum_if(F.col("human_result").isNull()).alias("human_pending")]
    outs += [F.avg(seconds_between(F.col(f"{p}_started_at"), F.col(f"{p}_completed_at"))).alias(f"avg_{p}_s") for p in ("scope", "build", "verify")]
    outs += [F.sum(f"{p}_tokens_{d}").alias(f"{p}_tokens_{d}") for p in ("scope", "build", "verify") for d in ("in", "out")]
    return runs.agg(*outs, F.sum("build_cost_usd").alias("build_cost_usd"))


def agreement_matrix(runs: DataFrame) -> DataFrame:
    return runs.where("verify_result is not null and human_result is not null").groupBy("verify_result", "human_result").agg(F.count(F.lit(1)).alias("n"))


def agreement_pivot(runs: DataFrame) -> DataFrame:
    """Verify results against human results, with the rate of agreement over all combinations (WARN matches)."""
    cells = agreement_matrix(runs)
    agree = (F.col("verify_result") == "WARN") | ((F.col("verify_result") == "PASS") & (F.col("human_result") == "approved")) | ((F.col("verify_result") == "FAIL") & (F.col("human_result") == "rejected"))
    rate = cells.agg(percent(F.coalesce(F.sum(F.when(agree, F.col("n")).otherwise(0)), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("agreement_pct"))
    table = cells.groupBy("verify_result").pivot("human_result", ["approved", "rejected"]).agg(F.sum("n")).fillna(0)
    return table.join(F.broadcast(rate))  # one row


def by_work_order_type(runs: DataFrame) -> DataFrame:
    rows = runs.where("work_order_type is not null").groupBy("work_order_type")
    return rows.agg(F.count(F.lit(1)).alias("runs"), _sum_if(F.col("verify_result") == "PASS").alias("passed"), _sum_if(F.col("human_result") == "approved").alias("approved"), F.avg("build_cost_usd").alias("avg_cost"))


def scope_quality(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.avg("scope_files_suggested").alias("avg_suggested"),
        F.avg("build_files_changed").alias("avg_changed"),
        _sum_if(F.col("build_scope_drift") > 0).alias("drifted"),
        _sum_if(F.col("scope_estimated_complexity") == "high").alias("high_complexity"),
        _sum_if(F.col("scope_rag_direct") > 0).alias("with_retrieval"),
    )


def calls_by_provider(calls: DataFrame, run_id: str | None = None) -> DataFrame:
    """Calls, tokens, latency and cost of each provider and model; of one run if given. With the provider's truncated share of all calls."""
    rows = calls.where(F.col("pipeline_run_id") == run_id) if run_id else calls
    out = rows.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.avg("latency_ms").alias("avg_latency_ms"), F.sum("estimated_cost_usd").alias("cost_usd"), _sum_if(F.col("success") == 0).alias("failed")
    )
    total = out.agg(F.sum("calls").alias("all_calls"))  # one row
    return out.join(F.broadcast(total)).withColumn("share_pct", percent(F.col("calls"), F.col("all_calls"))).drop("all_calls")


def calls_by_phase(calls: DataFrame) -> DataFrame:
    """Calls and distinct runs of each phase, and calls a run."""
    out = calls.groupBy("phase").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("pipeline_run_id").alias("runs"))
    return out.withColumn("calls_a_run", share(F.col("calls"), F.col("runs")))


def approved_count(runs: DataFrame, task_id: str) -> DataFrame:
    return runs.where((F.col("plan_task_id") == task_id) & (F.col("verify_result") == "PASS") & (F.col("human_result") == "approved")).agg(F.count(F.lit(1)).alias("n"))


def unmet_dependencies(deps: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of ``deps`` (``task_id, depends_on``) whose dependency has no passed and approved run."""
    done = runs.where("verify_result = 'PASS' and human_result = 'approved'").select(F.col("plan_task_id").alias("depends_on")).distinct()
    return deps.join(done, "depends_on", "left_anti")


def audit_usefulness(plan_runs: DataFrame) -> DataFrame:
    """Whether the audit changed a plan, and by how many work orders (null if either count is)."""
    c = {k: F.coalesce(F.col(f"audit_work_orders_{k}"), F.lit(0)) for k in ("added", "modified")}
    changed = (c["added"] > 0) | (c["modified"] > 0) | (F.coalesce(F.col("audit_change_text"), F.lit("")) != "")
    return plan_runs.withColumns({"audit_changed": changed, "count_delta": F.col("post_audit_work_order_count") - F.col("pre_audit_work_order_count")})


def audit_stats(plan_runs: DataFrame) -> DataFrame:
    """Changed and unchanged runs. The two are not complements: a run without a count before counts as both."""
    pre, post = (F.col(f"{k}_audit_work_order_count") for k in ("pre", "post"))
    added, modified = (F.coalesce(F.col(f"audit_work_orders_{k}"), F.lit(0)) for k in ("added", "modified"))
    text = F.coalesce(F.col("audit_change_text"), F.lit("")) != ""
    changed = (added > 0) | (modified > 0) | text | (F.coalesce(pre, F.lit(0)) != F.coalesce(post, F.lit(0)))
    unchanged = (added == 0) & (modified == 0) & ~text & (pre.isNull() | post.isNull() | (pre == post))
    return plan_runs.agg(F.count(F.lit(1)).alias("runs"), _count(changed).alias("changed_runs"), _count(unchanged).alias("unchanged_runs"), F.sum(added).alias("added"), F.sum(modified).alias("modified"))


def plan_task_status(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of each plan task (``task_id, depends_on array``) from its latest run; the first rule that fits:
    passed and approved is complete; a failed workflow, a rejection or a failed check is failed; review is
    awaited; a workflow that completed otherwise is failed; any other run is in progress. Without a run: blocked
    by a dependency that isn't complete, else not started."""
    last = runs.select(F.col("plan_task_id").alias("task_id"), "verify_result", "human_result", F.col("current_state").alias("run_state"), F.lit(True).alias("has_run"))
    rows = tasks.join(last, "task_id", "left")
    passed = F.coalesce((F.col("verify_result") == "PASS") & (F.col("human_result") == "approved"), F.lit(False))
    done = rows.where(passed).select(F.col("task_id").alias("dep"))
    waits = tasks.select("task_id", F.explode("depends_on").alias("dep")).join(done, "dep", "left_anti").select("task_id").distinct().withColumn("waits", F.lit(True))
    s = F.col("run_state")
    status = (
        F.when(passed, "complete")
        .when(s == "failed", "failed")
        .when(F.col("human_result") == "rejected", "failed")
        .when(F.col("verify_result") == "FAIL", "failed")
        .when(s.isin("human_review", "review_needed"), "awaiting-review")
        .when(s == "completed", "failed")
        .when(F.col("has_run"), "in-progress")
        .when(F.col("waits"), "blocked")
        .otherwise("not-started")
    )
    return rows.join(waits, "task_id", "left").withColumn("status", status).drop("waits", "run_state", "has_run")


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.agg(*[_count(F.col("status") == s).alias(s.replace("-", "_")) for s in ("complete", "failed", "awaiting-review", "in-progress", "blocked", "not-started")])


def phase_status(runs: DataFrame) -> DataFrame:
    """Four rows a run (with ``current_state`` of its workflow and ``error_message``): scope, build, verify and review.

    A phase that has started and ended is completed; one that only started is active, or failed if there is an
    error and no later phase is open. Review is completed by any human result and active while one is awaited.
    """
    names = ("scope", "build", "verify")
    opened = {p: F.coalesce(F.col(f"{p}_started_at"), F.lit("")) != "" for p in names}
    ended = {p: F.coalesce(F.col(f"{p}_completed_at"), F.lit("")) != "" for p in names}
    last_open = F.when(opened["verify"] & ~ended["verify"], "verify").when(opened["build"] & ~ended["build"], "build").when(opened["scope"] & ~ended["scope"], "scope")
    error = F.coalesce(F.col("error_message"), F.lit("")) != ""

    def of(p: str) -> Column:
        failed = error & (last_open == p)
        return F.when(opened[p] & ended[p], "completed").when(opened[p] & failed, "failed").when(opened[p], "active").otherwise("pending")

    awaited = F.col("current_state").isin("awaiting_review", "human_review")
    review = F.when(F.coalesce(F.col("human_result"), F.lit("")) != "", "completed").when(awaited, "active").otherwise("pending")
    cells = [F.struct(F.lit(i).alias("ord"), F.lit(p).alias("phase"), s.alias("status")) for i, (p, s) in enumerate([*((p, of(p)) for p in ("scope", "build", "verify")), ("review", review)])]
    return runs.select("id", F.inline(F.array(*cells)))


def apply_phase_updates(runs: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Set ``columns`` of all runs of a workflow from ``updates`` (one row a ``workflow_id``); nulls leave what is there."""
    new = updates.select("workflow_id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    rows = runs.join(new, "workflow_id", "left")
    return rows.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*runs.columns)


def lifecycle(events: DataFrame, terminal: tuple[str, ...] = ("completed", "failed", "cancelled"), starting: tuple[str, ...] = ("running",)) -> DataFrame:
    """From state changes (``entity_id, seq, state, at``): the last state, the first start, the first terminal time.

    An entity starts with its first change to one of ``starting``; with its first change of all, if none is named.
    """
    begun = F.col("state").isin(*starting) if starting else F.lit(True)
    return events.groupBy("entity_id").agg(F.max_by("state", "seq").alias("state"), F.min(F.when(begun, F.col("at"))).alias("started_at"), F.min(F.when(F.col("state").isin(*terminal), F.col("at"))).alias("completed_at"))


def retryable(tasks: DataFrame) -> DataFrame:
    """Failed tasks to try again: attempts are left, and their error (``error_class``) is transient or of no class."""
    return tasks.where((F.coalesce("error_class", F.lit("retryable")) == "retryable") & (F.col("attempts") < F.col("max_attempts")))


def forbidden(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Paths (``path``) that equal or lie under a forbidden ``prefix``: an equi-join on each path's leading directories."""
    parts = F.split("path", "/")
    heads = paths.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    return heads.join(prefixes.select(F.rtrim("prefix", F.lit("/")).alias("prefix")), "prefix", "left_semi").select(*paths.columns).distinct()
