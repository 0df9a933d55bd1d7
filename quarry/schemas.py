"""Table schemas: telemetry, graph and chunks; a check of a DataFrame against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TELEMETRY = {
    "workflows": "id string, original_intent string, original_file string, current_state string, target_repo string, git_branch string, context_package_path string, verification_report_path string, max_depth bigint, max_files_changed bigint, max_duration_mins bigint, current_depth bigint, files_changed bigint, started_at string, created_at string, updated_at string, completed_at string, error_message string",
    "tasks": "id string, workflow_id string, sequence_num bigint, task_type string, agent_type string, target_repo string, phase string, input_artifact string, output_artifact string, state string, claimed_by string, claimed_at string, attempts bigint, max_attempts bigint, exit_code bigint, stdout_log string, stderr_log string, files_changed string, created_at string, started_at string, completed_at string, error_message string",
    "events": "id bigint, workflow_id string, task_id string, event_type string, event_data string, created_at string",
    "sessions": "id string, kind string, project string, source_spec_path string, state string, error_message string, started_at string, completed_at string, created_at string, updated_at string",
    "artifacts": "id string, session_id string, workflow_id string, task_id string, artifact_type string, path string, size_bytes bigint, metadata_json string, created_at string",
    "pipeline_runs": "id string, session_id string, workflow_id string, project string, work_order_type string, plan_file string, plan_task_id string, plan_epic_id string, scope_started_at string, scope_completed_at string, build_started_at string, build_completed_at string, verify_started_at string, verify_completed_at string, scope_model string, build_model string, verify_model string, scope_files_suggested bigint, build_files_changed bigint, build_scope_drift bigint, scope_estimated_complexity string, scope_rag_direct bigint, scope_rag_hops bigint, scope_paths_stripped bigint, scope_paths_reclassified bigint, verify_result string, human_result string, work_order_content string, scope_tokens_in bigint, scope_tokens_out bigint, build_tokens_in bigint, build_tokens_out bigint, verify_tokens_in bigint, verify_tokens_out bigint, build_cost_usd double, build_session_id string, build_tool_calls string, build_claude_md_content string, created_at string, updated_at string",
    "sub_calls": "id bigint, pipeline_run_id string, phase string, step string, target_path string, provider string, model string, tokens_in bigint, tokens_out bigint, latency_ms bigint, estimated_cost_usd double, success bigint, error_message string, created_at string",
    "plan_runs": "id string, session_id string, spec_file string, project string, spec_fingerprint string, generation_model string, epic_generation_model string, task_generation_model string, audit_model string, generation_session_id string, audit_session_id string, work_orders_generated bigint, epic_count bigint, task_count bigint, pre_audit_work_order_count bigint, post_audit_work_order_count bigint, audit_change_text string, audit_work_orders_added bigint, audit_work_orders_modified bigint, audit_work_orders_unchanged bigint, generation_cost_usd double, epic_generation_cost_usd double, task_generation_cost_usd double, audit_cost_usd double, generation_duration_ms bigint, epic_generation_duration_ms bigint, task_generation_duration_ms bigint, audit_duration_ms bigint, generation_retry_count bigint, audit_tokens_in bigint, audit_tokens_out bigint, generation_tokens_in bigint, generation_tokens_out bigint, epic_generation_tokens_in bigint, epic_generation_tokens_out bigint, task_generation_tokens_in bigint, task_generation_tokens_out bigint, task_generation_call_count bigint, state string, error_message string, current_phase string, created_at string",
}
_GRAPH = {
    "symbols": "id string, name string, kind string, language string, package string, file_path string, line_start bigint, line_end bigint, signature string, exported bigint, receiver string",
    "edges": "id bigint, source_id string, target_id string, edge_type string, confidence double, source_line bigint, metadata string",
    "boundary_symbols": "id string, name string, kind string, language string, package string",
    "chunk_mapping": "symbol_id string, chunk_id string",
    "graph_meta": "key string, value string",
}
_CHUNKS = {
    "chunks": "id string, project_name string, file_path string, language string, chunk_type string, name string, signature string, body string, description string, line_start int, line_end int, content_hash string, indexed_at timestamp, calls refs, called_by refs, types_used strings, implements_ifaces strings, imports strings, embedding floats"
}

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType()),
    "refs": T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "package", "file")])),
}
SCHEMAS: dict[str, T.StructType] = {table: T.StructType([T.StructField(*(n, _TYPES[k])) for n, k in (c.split() for c in ddl.split(", "))]) for table, ddl in (_TELEMETRY | _GRAPH | _CHUNKS).items()}


def assert_schema(df: DataFrame, table: str) -> DataFrame:
    """Raise ValueError unless every column of ``table`` is there with its type; further ones may follow."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[table].fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{table} lacks: {', '.join(wrong)}")
    return df


def normalize_plan_runs(plan_runs: DataFrame, now: str) -> DataFrame:
    """Settle pending plan runs: those with work orders are complete, others fail after two hours."""
    stale = F.unix_timestamp(F.try_to_timestamp("created_at")) < F.unix_timestamp(F.lit(now).cast("timestamp")) - 7200
    pending = F.col("state") == "pending"
    state = F.when(pending & F.col("work_orders_generated").isNotNull(), "complete").when(pending & stale, "failed").otherwise(F.col("state"))
    return plan_runs.withColumn("state", state)
