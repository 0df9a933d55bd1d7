"""Dashboard analytics: summaries, trends, model statistics, daily rollups and rolling agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day, seconds_between, share
from .scans import trailing
from .warehouse import call_totals, optional

PHASES = ("scope", "build", "verify")


def zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def pipeline_summary(runs: DataFrame, calls: DataFrame, since: str | None = None, project: str | None = None) -> DataFrame:
    """One row: counts, pass rate, mean and total cost, mean duration of complete runs, agreement.

    Costs average over all rows (missing: 0), durations over complete ones only. WARN
    counts in the denominator of agreement and never agrees.
    """
    rows = optional(runs, since, project).join(call_totals(calls), "id", "left")
    v, h = F.col("verify_result"), F.col("human_result")
    cost = zero("build_cost_usd") + zero("call_cost")
    took = F.when(F.col("verify_completed_at").isNotNull() & F.col("scope_started_at").isNotNull(), seconds_between(F.col("scope_started_at"), F.col("verify_completed_at")))
    both = v.isNotNull() & h.isNotNull()
    agree = ((v == "PASS") & (h == "approved")) | ((v == "FAIL") & (h == "rejected"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = rows.agg(
        F.count(F.lit(1)).alias("total_runs"), n(v == "PASS").alias("passed"), n(v == "FAIL").alias("failed"), n(v.isNotNull() & ~v.isin("PASS", "FAIL")).alias("errors"),
        F.coalesce(F.avg(cost), F.lit(0.0)).alias("avg_cost"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_cost"), F.coalesce(F.avg(took), F.lit(0.0)).alias("avg_duration_s"), n(both).alias("judged"), n(both & agree).alias("agreed"),
    )
    return out.withColumns({"pass_rate": share(F.col("passed"), F.col("total_runs")), "agreement_rate": share(F.col("agreed"), F.col("judged"))})


def plan_summary(plans: DataFrame, since: str | None = None, project: str | None = None) -> DataFrame:
    """One row; cost is that of generation and audit, averaged over all rows."""
    cost = zero("generation_cost_usd") + zero("audit_cost_usd")
    return optional(plans, since, project).agg(
        F.count(F.lit(1)).alias("total_plans"), F.count_if(F.col("state") == "complete").alias("complete"), F.coalesce(F.avg(cost), F.lit(0.0)).alias("avg_cost"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_cost"), F.coalesce(F.avg(F.coalesce("work_orders_generated", F.lit(0))), F.lit(0.0)).alias("avg_work_orders")
    )


def combined_total(runs: DataFrame, plans: DataFrame) -> DataFrame:
    """Sum of the total costs of a pipeline summary and a plan summary, each of one row."""
    both = runs.select("total_cost").unionByName(plans.select("total_cost"))
    return both.agg(F.sum("total_cost").alias("combined_cost"))


def agreed(v: Column, h: Column) -> Column:
    """1, 0 or null; WARN is 0."""
    return F.when(v.isNull() | h.isNull(), F.lit(None)).when(((v == "PASS") & (h == "approved")) | ((v == "FAIL") & (h == "rejected")), 1).otherwise(0)


def run_trends(runs: DataFrame, calls: DataFrame, since: str | None = None, project: str | None = None) -> DataFrame:
    """A row a run in order of creation: date, cost, durations by phase and in all, agreement."""
    rows = optional(runs, since, project).join(call_totals(calls), "id", "left")
    cols = {f"{p}_s": seconds_between(F.col(f"{p}_started_at"), F.col(f"{p}_completed_at")) for p in PHASES}
    cols |= {"date": day(F.col("created_at")), "cost": zero("build_cost_usd") + zero("call_cost"), "total_s": seconds_between(F.col("scope_started_at"), F.col("verify_completed_at")), "human_agreed": agreed(F.col("verify_result"), F.col("human_result"))}
    return rows.withColumns(cols).select("id", "created_at", "verify_result", *cols)


def plan_trends(plans: DataFrame, since: str | None = None, project: str | None = None) -> DataFrame:
    """A row a plan run; missing counts are 0 in its delta."""
    n = {k: F.coalesce(F.col(f"{k}_audit_work_order_count"), F.lit(0)) for k in ("pre", "post")}
    return optional(plans, since, project).select("id", "created_at", day(F.col("created_at")).alias("date"), (zero("generation_cost_usd") + zero("audit_cost_usd")).alias("cost"), (n["post"] - n["pre"]).alias("count_delta"))


def model_stats(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls by model, provider and phase, and for build the pass rate of the runs built with the model."""
    out = calls.groupBy("model", "provider", "phase").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("estimated_cost_usd").alias("cost"), F.avg("latency_ms").alias("avg_latency_ms"), share(F.sum("success"), F.count(F.lit(1))).alias("success_rate"))
    rate = runs.where("verify_result is not null").groupBy(F.col("build_model").alias("model")).agg(share(F.count_if(F.col("verify_result") == "PASS"), F.count(F.lit(1))).alias("pass_rate"))
    out = out.join(rate, "model", "left")
    return out.withColumn("pass_rate", F.when(F.col("phase") == "build", F.col("pass_rate")))


def daily_costs(run_trends_: DataFrame, plan_trends_: DataFrame) -> DataFrame:
    """Cost of runs and of plans by date; a date of either series is there."""
    tagged = run_trends_.select("date", F.col("cost").alias("run_cost"), F.lit(0.0).alias("plan_cost")).unionByName(plan_trends_.select("date", F.lit(0.0).alias("run_cost"), F.col("cost").alias("plan_cost")))
    return tagged.groupBy("date").agg(F.sum("run_cost").alias("run_cost"), F.sum("plan_cost").alias("plan_cost"))


def verify_distribution(runs: DataFrame) -> DataFrame:
    """Runs that passed, failed or neither (missing ones too); empty kinds are absent."""
    kind = F.when(F.col("verify_result") == "PASS", "pass").when(F.col("verify_result") == "FAIL", "fail").otherwise("error")
    return runs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def rolling_agreement(trends: DataFrame, series: list[str] | None = None, n: int = 10) -> DataFrame:
    """Per cent of agreement over the last ``n`` judged runs of each ``series`` (of all, if none is named)."""
    judged = trends.where("human_agreed is not null")
    return trailing(judged, series or [], ["created_at", "id"], n, F.avg(F.col("human_agreed").cast("double")), "rate").withColumn("rate", F.col("rate") * 100)


def phase_totals(calls: DataFrame) -> DataFrame:
    """Tokens and cost by phase, a row a run."""
    cells = [F.sum(F.when(F.col("phase") == p, F.col(c))).alias(f"{p}_{a}") for p in PHASES for c, a in (("tokens_in", "in"), ("tokens_out", "out"), ("estimated_cost_usd", "cost"))]
    return calls.groupBy("pipeline_run_id").agg(*cells)


def sorted_by(df: DataFrame, column: str, descending: bool, tie: str = "id") -> DataFrame:
    """By a column either way, nulls last both ways."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)


def call_metrics(calls: DataFrame) -> DataFrame:
    """By run and step: tokens, and the model of the last call that succeeded (the last by name of equal ids)."""
    last = F.max_by(F.when(F.col("success") == 1, F.col("model")), F.when(F.col("success") == 1, F.struct("id", "model")))
    return calls.groupBy("pipeline_run_id", "step").agg(F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), last.alias("model"))


def merged_metrics(parts: DataFrame) -> DataFrame:
    """Of a group's parts: sums, and the model if they name one, ``multiple`` if several, else empty."""
    name = F.nullif(F.trim("model"), F.lit(""))
    n = F.countDistinct(name)
    return parts.groupBy("grp").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.when(n == 0, "").when(n == 1, F.max(name)).otherwise("multiple").alias("model"))


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of calls by the price of their endpoint (per million tokens), its trailing slash aside; no price, no cost."""
    key = F.rtrim("endpoint", F.lit("/"))
    table = prices.select(key.alias("_key"), "per_million_in", "per_million_out")
    rows = calls.withColumn("_key", key).join(table, "_key", "left").drop("_key")
    cost = (F.col("tokens_in") * F.col("per_million_in") + F.col("tokens_out") * F.col("per_million_out")) / 1e6
    return rows.withColumn("cost", F.coalesce(cost, F.lit(0.0)))


def merged_results(results: DataFrame) -> DataFrame:
    """Of each group's results in order (``grp, seq, cost, model, tools map``): summed cost, the last model named, tool counts added."""
    head = results.groupBy("grp").agg(F.sum("cost").alias("cost"), F.max_by(F.nullif("model", F.lit("")), F.when(F.col("model") != "", F.col("seq"))).alias("model"))
    tools = results.select("grp", F.explode("tools").alias("tool", "n")).groupBy("grp", "tool").agg(F.sum("n").alias("n"))
    tools = tools.groupBy("grp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"))  # tools of one group
    return head.join(tools, "grp", "left")


#: Display status of event types (fixed values); others are pending.
EVENT_STATUS = {
    "phase_start": "running",
    "build_stdout": "running",
    "phase_complete": "completed",
    "run_complete": "completed",
    "phase_error": "failed",
    "run_awaiting_review": "awaiting_review",
}


def event_status(event_type: Column) -> Column:
    out = F.lit("pending")
    for name, status in EVENT_STATUS.items():
        out = F.when(event_type == name, status).otherwise(out)
    return out
