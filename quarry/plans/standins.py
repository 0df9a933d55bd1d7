"""Telemetry, graph and chunk tables made from the star-schema tables of a data folder.

The engine's own tables can't be had at scale, so that the catalog's queries run
on stand-ins of the same schemas: orders are runs, line items are model calls and
edges, customers are workflows, nations are sessions, parts are plan runs and
symbols. The same expressions, in the other dialect, make the views of the SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_AGREE = "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN (o_orderkey * 31 + o_custkey) % 4 = 0 THEN 'rejected' ELSE 'approved' END"
#: Column expressions by table; ``{column+seconds}`` in braces is text of a time.
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "runs": ("orders", {
        "id": "concat('run-', o_orderkey)", "workflow_id": "concat('wf-', o_custkey)", "session_id": "concat('s-', o_custkey % 25)", "project": "concat('p', o_custkey % 5)",
        "work_order_type": "CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_orderpriority END", "plan_task_id": "CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE concat('task-', o_orderkey % 400) END",
        "scope_started_at": "{o_orderdate+0}", "scope_completed_at": "{o_orderdate+10 + o_orderkey % 50}", "build_started_at": "{o_orderdate+60}", "build_completed_at": "CASE WHEN o_orderkey % 8 = 5 THEN NULL ELSE {o_orderdate+100 + o_custkey % 300} END",
        "verify_started_at": "{o_orderdate+400}", "verify_completed_at": "CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE {o_orderdate+420 + o_orderkey % 100} END", "build_model": "concat('m', o_custkey % 4)",
        "scope_files_suggested": "CAST(o_orderkey % 12 AS BIGINT)", "build_files_changed": "CAST(o_custkey % 9 AS BIGINT)", "build_scope_drift": "CAST(o_orderkey % 3 AS BIGINT)", "scope_estimated_complexity": "CASE WHEN o_orderkey % 5 = 0 THEN 'high' ELSE 'low' END", "scope_rag_direct": "CAST(o_orderkey % 4 AS BIGINT)",
        "verify_result": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'PASS' WHEN o_orderstatus = 'O' THEN 'FAIL' ELSE 'WARN' END", "human_result": _AGREE,
        **{f"{p}_tokens_{d}": f"CAST((o_orderkey * {k}) % 5000 AS BIGINT)" for k, (p, d) in enumerate([(p, d) for p in ("scope", "build", "verify") for d in ("in", "out")], 3)},
        "build_cost_usd": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 100000 END", "created_at": "{o_orderdate+0}",
    }),
    "calls": ("lineitem", {
        "id": "l_orderkey * 10 + l_linenumber", "pipeline_run_id": "concat('run-', l_orderkey)", "phase": "CASE WHEN l_linestatus = 'O' THEN 'scope' WHEN l_linenumber % 2 = 0 THEN 'build' ELSE 'verify' END", "step": "concat('step', l_linenumber)",
        "provider": "l_returnflag", "model": "concat('m', l_partkey % 4)", "tokens_in": "CAST(l_quantity * 10 AS BIGINT)", "tokens_out": "CAST(l_quantity AS BIGINT)", "latency_ms": "l_suppkey % 1000", "estimated_cost_usd": "l_extendedprice / 1000000", "success": "CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE 1 END", "created_at": "{l_shipdate+0}",
    }),
    "workflows": ("customer", {
        "id": "concat('wf-', c_custkey)", "current_state": "CASE c_custkey % 9 WHEN 0 THEN 'running' WHEN 1 THEN 'awaiting_review' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' WHEN 4 THEN 'pending' WHEN 5 THEN 'human_review' WHEN 6 THEN 'paused' WHEN 7 THEN 'review_needed' ELSE 'cancelled' END",
        "max_depth": "CAST(5 AS BIGINT)", "current_depth": "c_custkey % 7", "max_files_changed": "CAST(50 AS BIGINT)", "files_changed": "c_custkey % 60", "updated_at": "concat('2026-01-', 10 + c_custkey % 19)", "created_at": "concat('2025-12-', 10 + c_custkey % 19)",
    }),
    "sessions": ("nation", {"id": "concat('s-', n_nationkey)", "kind": "CASE WHEN n_nationkey % 2 = 0 THEN 'run_only' ELSE 'plan_only' END", "project": "concat('p', n_regionkey)", "state": "CASE WHEN n_nationkey % 3 = 0 THEN 'running' ELSE 'completed' END", "created_at": "concat('2026-02-', 10 + n_nationkey % 19)"}),
    "plans": ("part", {
        "id": "concat('plan-', p_partkey)", "session_id": "concat('s-', p_partkey % 30)", "project": "concat('p', p_partkey % 5)", "state": "CASE WHEN p_partkey % 4 = 0 THEN 'failed' ELSE 'complete' END", "work_orders_generated": "CASE WHEN p_partkey % 10 = 7 THEN NULL ELSE CAST(p_size AS BIGINT) END",
        "pre_audit_work_order_count": "CASE WHEN p_partkey % 9 = 2 THEN NULL ELSE CAST(p_size AS BIGINT) END", "post_audit_work_order_count": "CASE WHEN p_partkey % 8 = 3 THEN NULL ELSE CAST(p_size + p_partkey % 3 AS BIGINT) END", "audit_change_text": "CASE WHEN p_partkey % 12 = 0 THEN 'changed' WHEN p_partkey % 12 = 1 THEN '' END",
        "audit_work_orders_added": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 3 END", "audit_work_orders_modified": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 2 END", "generation_cost_usd": "p_retailprice / 1000", "audit_cost_usd": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice / 5000 END", "created_at": "concat('2026-01-', 10 + p_partkey % 19, ' 0', p_partkey % 10, ':00:00')",
    }),
    "tasks": ("orders", {
        "id": "concat('t-', o_orderkey)", "workflow_id": "concat('wf-', o_custkey)", "sequence_num": "o_orderkey % 20", "state": "CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'done' END", "attempts": "o_orderkey % 3", "max_attempts": "CAST(2 AS BIGINT)", "error_message": "CASE o_orderkey % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'fatal' END", "created_at": "{o_orderdate+0}",
    }),
    "symbols": ("part", {"id": "concat('go:pkg:function:P', p_partkey)", "name": "concat('P', p_partkey % 900)", "kind": "CASE WHEN p_size % 3 = 0 THEN 'method' ELSE 'function' END", "package": "concat('pkg', p_partkey % 10)", "file_path": "concat('src/', CASE WHEN p_partkey % 11 = 0 THEN 'latest_' ELSE 'f' END, p_partkey % 50, '.go')", "line_start": "(p_partkey % 40) * 10", "line_end": "(p_partkey % 40) * 10 + p_size"}),
    "edges": ("lineitem", {"id": "l_orderkey * 10 + l_linenumber", "source_id": "concat('go:pkg:function:P', l_partkey)", "target_id": "concat('go:pkg:function:P', (l_partkey * 13 + l_suppkey * 7) % 1900 + 1)", "edge_type": "CASE l_returnflag WHEN 'A' THEN 'IMPLEMENTS' WHEN 'R' THEN 'IMPORTS' ELSE 'CALLS' END", "confidence": "1 - l_discount * 6"}),
    "boundaries": ("supplier", {"id": "concat('go:pkg:function:P', s_suppkey)"}),
    "chunks": ("documents", {"id": "concat('c', doc_id)", "file_path": "concat(source, '/', lang, doc_id % 7, '.md')", "language": "lang", "chunk_type": "CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END", "name": "concat('n', doc_id % 300)", "line_start": "doc_id % 90", "body": "text", "next_name": "concat('n', (doc_id * 7) % 300)", "next_package": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('src', (doc_id * 7) % 20) END"}),
    "log": ("events", {"id": "event_id", "workflow_id": "concat('wf-', user_id)", "event_type": "event_type", "event_data": "props", "created_at": "{ts+0}", "value": "value", "user_id": "user_id"}),
}


def _dialect(expression: str, duck: bool) -> str:
    out, rest = "", expression
    while "{" in rest:
        head, _, rest = rest.partition("{")
        inside, _, rest = rest.partition("}")
        column, _, seconds = inside.partition("+")
        out += head + (f"strftime({column} + INTERVAL 1 SECOND * ({seconds}), '%Y-%m-%d %H:%M:%S')" if duck else f"date_format(timestampadd(SECOND, cast({seconds} as int), {column}), 'yyyy-MM-dd HH:mm:ss')")
    return out + rest


def view_sql(name: str) -> str:
    """The stand-in as a common table expression of DuckDB."""
    source, columns = TABLES[name]
    return f"{name} AS (SELECT " + ", ".join(f"{_dialect(e, True)} AS {c}" for c, e in columns.items()) + f" FROM {source})"


class World:
    """The stand-ins of a data folder, and its own tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            source, columns = TABLES[name]
            found = getattr(self, source).selectExpr(*[f"{_dialect(e, False)} AS {c}" for c, e in columns.items()])
        elif name.startswith("_"):
            raise AttributeError(name)
        else:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self.__dict__[name] = found
        return found

    @cached_property
    def refs(self) -> DataFrame:
        """Chunks with calls as arrays of structs."""
        return self.chunks.selectExpr("*", "array(named_struct('name', next_name, 'package', next_package)) AS calls", "cast(array() as array<struct<name: string, package: string>>) AS called_by")
