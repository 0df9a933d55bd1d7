"""Event logs and line streams, batch and streaming: parsing, cursors, folds and the run queue."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

RECORD = "type string, message struct<content: array<struct<type: string, text: string>>>, tool struct<name: string, input: string, output: string>, total_cost_usd double, session_id string, model string, duration_ms long, is_error boolean, usage struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long>"


def parse_lines(lines: DataFrame) -> DataFrame:
    """``line`` plus the fields of its record; unknown types stay, lines that are not JSON have a null ``type``."""
    return lines.withColumn("r", F.from_json("line", RECORD)).select(*lines.columns, "r.*")


def records(lines: DataFrame) -> DataFrame:
    return parse_lines(lines).where("type is not null")


def data_lines(lines: DataFrame) -> DataFrame:
    """Payloads of server-sent ``data:`` lines up to the terminator, by ``seq``."""
    rows = lines.where(F.ltrim("line").startswith("data:")).withColumn("payload", F.trim(F.substring(F.ltrim("line"), 6, 1 << 30)))
    end = rows.where("payload = '[DONE]'").agg(F.min("seq").alias("end"))  # one row
    return rows.join(F.broadcast(end)).where("end is null or seq < end").drop("end")


def since(events: DataFrame, cursor: int, limit: int = 100, **equal) -> DataFrame:
    """Replay: events beyond a cursor, by id."""
    for column, value in equal.items():
        events = events.where(F.col(column) == value)
    return events.where(F.col("id") > cursor).orderBy("id").limit(limit)


def cursor_of(query: str | None, last_event_id: str | None) -> int:
    """The query parameter, else the header, else 0; what is not a number counts as 0."""
    for raw in (query, last_event_id):
        if raw:
            return int(raw) if raw.isdigit() else 0
    return 0


def tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log as a stream; the query's checkpoint is its cursor."""
    return spark.readStream.schema(schema).json(path)


def deliver(stream: DataFrame, checkpoint: str, write) -> DataStreamWriter:
    """Each batch goes to ``write(df, batch_id)``, once a second; what arrives twice is to be dropped by id."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime="1 second").foreachBatch(write)


def newest_unique(events: DataFrame) -> DataFrame:
    return events.dropDuplicates(["id"]).orderBy(F.desc("id"))


def tool_counts(parsed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Uses of each tool; on a stream, run it in update mode."""
    return parsed.where("type = 'tool_use'").groupBy(*(keys or []), F.col("tool.name").alias("tool")).agg(F.count(F.lit(1)).alias("n"))


def last_result(parsed: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last result record of each stream."""
    cells = F.struct("total_cost_usd", "session_id", "model", "duration_ms", "is_error", "usage")
    return parsed.where("type = 'result'").groupBy(key).agg(F.max_by(cells, seq).alias("r")).select(key, "r.*")


def text_of(rows: DataFrame, key: str, seq: str, text: str, glue: str = "") -> DataFrame:
    """Texts of each key joined in order."""
    cells = F.array_sort(F.collect_list(F.struct(seq, text)))  # of one conversation
    return rows.groupBy(key).agg(F.array_join(F.transform(cells, lambda x: F.coalesce(x[text], F.lit(""))), glue).alias("text"))


def latest_checks(events: DataFrame) -> DataFrame:
    """Pre-checks by criterion: the last payload wins, in the order first seen."""
    return events.groupBy("workflow_id", "criterion_id").agg(F.max_by("result", "id").alias("result"), F.min("id").alias("first_seen"))


# --- run queue --------------------------------------------------------------


@dataclass(frozen=True)
class Queue:
    """A run queue: its state (idle, ready, running, paused or completed), items in order with a status each, the
    current item and why it is paused."""

    state: str = "idle"
    items: tuple[tuple[str, str], ...] = field(default=())
    current: str = ""
    pause_reason: str = ""

    def ids(self, status: str) -> list[str]:
        return [i for i, s in self.items if s == status]

    def marked(self, item: str, status: str) -> "Queue":
        return replace(self, items=tuple((i, status if i == item else s) for i, s in self.items))


def _advanced(q: Queue) -> Queue:
    """A running queue takes up its next pending item, or is completed."""
    pending = q.ids("pending")
    if not pending:
        return replace(q, state="completed", current="")
    return replace(q.marked(pending[0], "executing"), current=pending[0])


def step(q: Queue, action: str, argument: str = "") -> Queue:
    """The queue after an action; one that doesn't apply leaves it as it is.

    Users add, remove, reorder, start, pause and continue. Of the current item, ``done``, ``fail`` and ``review``
    (it waits for a human) are reported. A failure and a review pause the queue; continuing completes the item
    that was under way and takes up the next one.
    """
    names = [x for x in argument.split(",") if x]
    if action == "add":
        state = "ready" if names and q.state in ("idle", "completed") else q.state
        return replace(q, state=state, items=q.items + tuple((i, "pending") for i in names))
    if action == "remove":
        if argument not in dict(q.items) or dict(q.items)[argument] == "executing":
            return q
        left = replace(q, items=tuple(x for x in q.items if x[0] != argument))
        return replace(left, state="idle") if left.state == "ready" and not left.ids("pending") else left
    if action == "reorder":
        if sorted(names) != sorted(q.ids("pending")):
            return q
        return replace(q, items=tuple(x for x in q.items if x[1] != "pending") + tuple((i, "pending") for i in names))
    if action == "start" and q.state == "ready":
        return _advanced(replace(q, state="running", pause_reason=""))
    if action == "pause" and q.state == "running":
        return replace(q, state="paused", pause_reason="user_requested")
    if action == "continue" and q.state == "paused":
        done = q.marked(q.current, "completed") if q.current in q.ids("executing") else q
        return _advanced(replace(done, state="running", current="", pause_reason=""))
    if not q.current or q.current not in q.ids("executing"):
        return q
    if action == "done":
        done = replace(q.marked(q.current, "completed"), current="")
        return _advanced(done) if done.state == "running" else done
    if action == "fail":
        return replace(q.marked(q.current, "failed"), state="paused", pause_reason="error", current="")
    if action == "review":
        return replace(q, state="paused", pause_reason="awaiting_review")
    return q


def queue_states(actions: DataFrame) -> DataFrame:
    """``queue_id, state, items, pause_reason`` after all ``actions`` (``queue_id, seq, action, argument``) in order."""
    import pandas as pd

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        q = Queue()
        for a in frame.sort_values("seq").itertuples():
            q = step(q, a.action, a.argument or "")
        return pd.DataFrame({"queue_id": [key[0]], "state": [q.state], "items": [",".join(f"{i}:{s}" for i, s in q.items)], "pause_reason": [q.pause_reason]})

    return actions.groupBy("queue_id").applyInPandas(run, "queue_id string, state string, items string, pause_reason string")
