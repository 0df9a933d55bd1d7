"""Stateful streams: live folds of agents' line streams and of state changes.

Both keep state per key in RocksDB and emit a key's whole fold whenever it changes, in
update mode. Results do not depend on how rows fall into micro-batches: counts add up,
and of competing values the one of the greater sequence number stays, so out-of-order
and split input gives the batch fold. A key that has been idle for some event time is
emitted once more as final, and its state is cleared.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import scratch

#: The state store that arbitrary state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"

#: Of the last result record: its place, and what is reported of it.
_RESULT = "seq long, tokens_in long, tokens_out long, model string, cost_usd double, session_id string"
FOLD = "stream_id string, tools map<string,long>, tokens_in long, tokens_out long, model string, cost_usd double, session_id string, final boolean"
STATES = "entity_id string, state string, started_at string, completed_at string, final boolean"


class _Idle(StatefulProcessor):
    """Keeps one timer a key, at the latest event time plus ``idle_ms``. All state of a key is one value, as each
    access is a call to the JVM."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def touched(self, before: int | None, latest_ms: int) -> int:
        """Move the key's timer to ``idle_ms`` after the latest event time seen; the time it stands at."""
        at = latest_ms + self.idle_ms
        if before is not None:
            if before >= at:
                return before
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        return at

    def close(self) -> None:
        pass


def _plain(v):
    """A value as state holds it: nulls, and Python's own numbers."""
    return None if v is None or v != v else v.item() if hasattr(v, "item") else v


class StreamFold(_Idle):
    """Uses of each tool and the last result record of one line stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.fold = handle.getValueState("fold", f"tools string, until long, {_RESULT}")  # tools: counts by name, as JSON

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.fold.get()
        tools, until, last = (json.loads(held[0]), held[1], tuple(held[2:])) if held else ({}, None, (None,) * 6)
        latest = 0
        for f in rows:
            latest = max(latest, int(f["at_ms"].max()))
            best = None
            for at, (kind, tool, seq) in enumerate(zip(f["type"].tolist(), f["tool"].tolist(), f["seq"].tolist())):
                if kind == "tool_use" and tool is not None:
                    tools[tool] = tools.get(tool, 0) + 1
                elif kind == "result" and _plain(seq) is not None and (last[0] is None or seq > last[0]) and (best is None or seq > best[0]):
                    best = seq, at
            if best:
                last = (int(best[0]), *(_plain(f[c.split()[0]].iat[best[1]]) for c in _RESULT.split(", ")[1:]))
        self.fold.update((json.dumps(tools), self.touched(until, latest), *last))
        yield self._now(key, tools, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.fold.get()
        yield self._now(key, json.loads(held[0]), tuple(held[2:]), True)
        self.fold.clear()

    def _now(self, key, tools: dict[str, int], last: tuple, final: bool) -> pd.DataFrame:
        names = [c.split()[0] for c in FOLD.split(", ")]
        return pd.DataFrame({n: pd.array([v], "Int64") if n in ("tokens_in", "tokens_out") else [v] for n, v in zip(names, (key[0], tools, *last[1:], final))})


def fold_rows(parsed: DataFrame, stream_id: str, seq: str, at: str) -> DataFrame:
    """``stream_id, seq, at, at_ms, type, tool`` and the fields of a result, of parsed lines (``parse_lines``).

    Tokens read from or written to a cache count as input. Lines of other types keep their stream from being idle.
    """
    usage = lambda name: F.coalesce(F.col(f"usage.{name}"), F.lit(0))
    tokens_in = usage("input_tokens") + usage("cache_read_input_tokens") + usage("cache_creation_input_tokens")
    return parsed.select(
        F.col(stream_id).cast("string").alias("stream_id"), F.col(seq).cast("long").alias("seq"), F.col(at).cast("timestamp").alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"),
        F.coalesce("type", F.lit("")).alias("type"), F.coalesce("tool.name", F.lit("")).alias("tool"), tokens_in.alias("tokens_in"), usage("output_tokens").alias("tokens_out"),
        F.coalesce("model", F.lit("")).alias("model"), F.coalesce("total_cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("session_id", F.lit("")).alias("session_id"),
    )


def live_fold(rows: DataFrame, delay: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """The fold of each stream of ``fold_rows``, emitted whenever it changes, and once as final after ``idle_ms`` without rows."""
    return rows.withWatermark("at", delay).groupBy("stream_id").transformWithStateInPandas(StreamFold(idle_ms), FOLD, "Update", "EventTime")


def batch_fold(rows: DataFrame) -> DataFrame:
    """What ``live_fold`` comes to, of a finished table."""
    tools = rows.where("type = 'tool_use'").groupBy("stream_id", "tool").agg(F.count(F.lit(1)).alias("n"))
    tools = tools.groupBy("stream_id").agg(F.map_from_entries(F.collect_list(F.struct("tool", "n"))).alias("tools"))  # tools of one stream
    fields = ["tokens_in", "tokens_out", "model", "cost_usd", "session_id"]
    last = rows.groupBy("stream_id").agg(F.max_by(F.struct(*fields), F.when(F.col("type") == "result", F.col("seq"))).alias("r"))
    return last.join(tools, "stream_id", "left").select("stream_id", F.coalesce("tools", F.create_map().cast("map<string,bigint>")).alias("tools"), *[F.col(f"r.{c}").alias(c) for c in fields])


class StateFold(_Idle):
    """The last state of an entity by sequence number, and its first start and first terminal time."""

    def __init__(self, idle_ms: int, starting: tuple[str, ...], terminal: tuple[str, ...]):
        super().__init__(idle_ms)
        self.starting, self.terminal = starting, terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "seq long, state string, started_at string, completed_at string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.held.get() or (None,) * 5)
        seq, state, started, completed, until = before
        latest = 0
        for f in rows:
            latest = max(latest, int(f["at_ms"].max()))
            r = f.loc[f["seq"].idxmax()]
            if seq is None or r["seq"] > seq:
                seq, state = int(r["seq"]), r["state"]
            begun = f["time"] if not self.starting else f.loc[f["state"].isin(self.starting), "time"]
            ended = f.loc[f["state"].isin(self.terminal), "time"]
            started = min([v for v in (started, *begun) if v is not None], default=None)
            completed = min([v for v in (completed, *ended) if v is not None], default=None)
        self.held.update((seq, state, started, completed, self.touched(until, latest)))
        if (state, started, completed) != before[1:4]:
            yield self._now(key, (state, started, completed), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._now(key, tuple(self.held.get())[1:4], True)
        self.held.clear()

    def _now(self, key, found: tuple, final: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *found, final)], columns=[c.split()[0] for c in STATES.split(", ")])


def live_states(changes: DataFrame, starting: tuple[str, ...] = (), terminal: tuple[str, ...] = ("completed", "failed"), delay: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """``entity_id, state, started_at, completed_at, final`` from state changes (``entity_id, seq, state, at``: text of a time) in any order.

    Emitted when one of the three changes. An entity starts with its first change, or with the first to one of ``starting``.
    """
    time = F.col("at").cast("timestamp")
    rows = changes.select(F.col("entity_id").cast("string").alias("entity_id"), F.col("seq").cast("long").alias("seq"), "state", F.col("at").alias("time"), time.alias("at"), F.unix_millis(time).alias("at_ms"))
    return rows.withWatermark("at", delay).groupBy("entity_id").transformWithStateInPandas(StateFold(idle_ms, starting, terminal), STATES, "Update", "EventTime")


def to_tables(stream: DataFrame, checkpoint: str, path: str):
    """A writer of the stream's batches: ``path/batch=<n>``, each replaced if its batch runs again, so that a restart repeats nothing."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)


def latest(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The last row of each key among the batches of ``to_tables``."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)
    names = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("r")).select(key, "r.*")


def replayed(spark: SparkSession, make: Callable[[], DataFrame], key: str, schema: str, name: str) -> DataFrame:
    """Run a stateful stream over all that is there now, and give the last row of each key."""
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    before = spark.conf.get(_PROVIDER_KEY)
    spark.conf.set(_PROVIDER_KEY, PROVIDER)
    try:
        to_tables(make(), checkpoint, out).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER_KEY, before)
    return latest(spark, out, key, schema)
