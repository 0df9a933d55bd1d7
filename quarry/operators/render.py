"""Reports as text, from aggregates and the few rows that a report shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import index, warehouse

_PHASES = ("scope", "build", "verify")


def plan_status(path: str, tasks: DataFrame) -> str:
    """One plan's tasks by epic: ``epic_ord, epic_id, epic_title, task_ord, task_id, title, status``."""
    n = warehouse.status_counts(tasks).first().asDict()
    names = ("complete", "failed", "in-progress", "awaiting-review", "blocked", "not-started")
    out = [f"Plan: {path}", "Summary: " + "  ".join(f"{s} {n[s.replace('-', '_')]}" for s in names), ""]
    epic = None
    for r in tasks.orderBy("epic_ord", "task_ord").collect():  # the tasks of a plan
        if r["epic_id"] != epic:
            out += [""] * (epic is not None) + [f"{r['epic_id']} {r['epic_title']}"]
            epic = r["epic_id"]
        out.append(f"  [{r['status']}] {r['task_id']} {r['title']}")
    return "\n".join([*out, ""] if epic is not None else out) + "\n"


def chunk_report(chunks: DataFrame, files: int = 10) -> str:
    """What the index holds: totals, counts by language and type (most first), and the files of most chunks."""
    rows = index.chunk_stats(chunks).orderBy(F.desc("n"), "value").collect()  # a row for each language and type
    whole = next((r for r in rows if r["kind"] == "all"), None)
    out = ["RAG Database Stats", f"  Total chunks: {whole['n'] if whole else 0}"]
    if whole and "indexed_at" in chunks.columns:
        out.append(f"  Indexed at:   {whole['latest']:%Y-%m-%d %H:%M:%S}")
    for title, kind in (("By language:", "language"), ("By chunk type:", "chunk_type")):
        out += ["", title, *(f"  {r['value']}: {r['n']}" for r in rows if r["kind"] == kind)]
    top = index.top_files(chunks, files).collect()
    return "\n".join([*out, "", f"Top {files} files by chunk count:", *(f"  {r['file_path']}: {r['n']}" for r in top)]) + "\n"


def pipeline_report(runs: DataFrame, recent: int = 5) -> str:
    """Counts with shares, tokens, mean durations and the newest runs."""
    s = warehouse.pipeline_stats(runs).first().asDict()
    total, whole = s["total_runs"], lambda k: int(s[k] or 0)
    share = lambda k: whole(k) * 100 // total if total else 0
    out = ["=== PIPELINE STATS ===", f"Total runs:     {total}"]
    out.append("Verify results: " + "  ".join(f"{r} {whole(f'verify_{r.lower()}')} ({share(f'verify_{r.lower()}')}%)" for r in ("PASS", "WARN", "FAIL")))
    out += [f"Human results:  approved {whole('human_approved')}    rejected {whole('human_rejected')}     pending {whole('human_pending')}", "", "--- TOKEN USAGE ---"]
    out += [f"{p.capitalize() + ':':<8} {whole(f'{p}_tokens_in'):,} in  /  {whole(f'{p}_tokens_out'):,} out" for p in _PHASES]
    if s["build_cost_usd"]:
        out.append(f"Build cost: ${s['build_cost_usd']:.2f}")
    out += ["", "--- PHASE TIMING (avg) ---", *(f"{p.capitalize() + ':':<8} {int(s[f'avg_{p}_s'] or 0)}s" for p in _PHASES), "", "--- RECENT RUNS ---"]
    row = lambda cells: "{:<10}  {:<14}  {:<6}  {:<10}  {:<8}  {:<10}  {}".format(*cells)
    out.append(row(("ID", "TYPE", "VERIFY", "HUMAN", "CMPLX", "AGREE", "TOKENS")))
    for r in warehouse.recent_runs(runs, recent).collect():
        out.append(row((r["workflow_id"][:8], r["work_order_type"] or "-", r["verify_result"] or "-", r["human_result"] or "-", r["scope_estimated_complexity"] or "-", r["agreement"] or "-", f"{r['total_tokens']:,}")))
    return "\n".join(out) + "\n"
