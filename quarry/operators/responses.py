"""Rows as the answers of an interface: the fields of each kind of answer, and JSON without nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import delta, json_or_text, list_or_single

#: Fields of answers, by kind (fixed values).
SESSION = "id kind project source_spec_path state error_message started_at completed_at created_at updated_at".split()
SESSION_SUMMARY = [*SESSION, "plan_runs_count", "pipeline_runs_count", "latest_workflow_state"]
SESSION_PLAN_RUN = "id spec_file project state spec_fingerprint work_orders_generated pre_audit_work_order_count post_audit_work_order_count work_order_delta audit_changes created_at".split()
SESSION_PIPELINE_RUN = "id workflow_id project work_order_type verify_result human_result created_at".split()
ARTIFACT = "id workflow_id task_id artifact_type path size_bytes metadata created_at".split()
USEFULNESS = "id session_id project spec_file state audit_changed work_orders_generated pre_audit_work_order_count post_audit_work_order_count work_order_delta audit_changes created_at".split()
EVENT = "id workflow_id task_id event_type event_data created_at".split()
PLAN_RUN = (
    "id session_id spec_file project spec_fingerprint state error_message current_phase generation_model epic_generation_model task_generation_model audit_model generation_session_id audit_session_id work_orders_generated epic_count task_count"
    " pre_audit_work_order_count post_audit_work_order_count audit_change_text audit_work_orders_added audit_work_orders_modified audit_work_orders_unchanged generation_cost_usd epic_generation_cost_usd task_generation_cost_usd audit_cost_usd"
    " generation_duration_ms epic_generation_duration_ms task_generation_duration_ms audit_duration_ms generation_retry_count generation_tokens_in generation_tokens_out epic_generation_tokens_in epic_generation_tokens_out"
    " task_generation_call_count task_generation_tokens_in task_generation_tokens_out audit_tokens_in audit_tokens_out created_at"
).split()


def fields(rows: DataFrame, names: list[str], **made: Column) -> DataFrame:
    """``names`` of ``rows``, some of them ``made``; a column that is missing is null."""
    have = set(rows.columns)
    return rows.select(*[(made[n] if n in made else F.col(n) if n in have else F.lit(None).cast("string")).alias(n) for n in names])


def audit_changes(text: Column) -> Column:
    """The changes that an audit names: a JSON list of texts, else the text as the only one; null if there is none."""
    return list_or_single(text)


def session_summaries(listed: DataFrame) -> DataFrame:
    """Of ``warehouse.session_list``."""
    return fields(listed, SESSION_SUMMARY, id=F.col("session_id"), plan_runs_count=F.col("n_plans"), pipeline_runs_count=F.col("n_runs"), latest_workflow_state=F.col("current_state"))


def _audited(plan_runs: DataFrame) -> dict[str, Column]:
    return {"work_order_delta": delta(F.col("post_audit_work_order_count"), F.col("pre_audit_work_order_count")), "audit_changes": audit_changes(F.col("audit_change_text"))}


def session_plan_runs(plan_runs: DataFrame) -> DataFrame:
    return fields(plan_runs, SESSION_PLAN_RUN, **_audited(plan_runs))


def session_pipeline_runs(runs: DataFrame) -> DataFrame:
    return fields(runs, SESSION_PIPELINE_RUN)


def artifacts(rows: DataFrame) -> DataFrame:
    return fields(rows, ARTIFACT, metadata=json_or_text(F.nullif(F.col("metadata_json"), F.lit(""))))


def usefulness(plan_runs: DataFrame) -> DataFrame:
    """Of ``warehouse.audit_usefulness``."""
    return fields(plan_runs, USEFULNESS, **_audited(plan_runs))


def event_rows(events: DataFrame) -> DataFrame:
    return fields(events, EVENT, event_data=json_or_text(F.nullif(F.col("event_data"), F.lit(""))))


def plan_run_detail(plan_runs: DataFrame) -> DataFrame:
    return fields(plan_runs, PLAN_RUN)


def shown_changes(plan_runs: DataFrame) -> DataFrame:
    """``id, changes``: what a page shows of an audit's changes: the lines of its text that say something."""
    return plan_runs.select("id", F.filter(F.split(F.coalesce("audit_change_text", F.lit("")), "\n"), lambda x: F.trim(x) != "").alias("changes"))


def as_json(rows: DataFrame, name: str = "response") -> DataFrame:
    """One JSON text a row, nulls left out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias(name))
