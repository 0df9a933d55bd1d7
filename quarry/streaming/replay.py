"""The event log as a stream whose offset is the event id, and delivery that repeats nothing.

``EventLog`` is a Python data source: a query starts behind a cursor, its checkpoint
holds the id of the last event delivered, and a micro-batch is cut to pages of so many
events, each read by a task of its own. Events that arrive twice (a page sent again, two
sources that overlap) are dropped by id within a watermark, so the state is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Events of a page (fixed value).
PAGE = 100


@dataclass
class Page(InputPartition):
    """Events with ``after < id <= upto``."""

    after: int
    upto: int


class _Pages(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.id = schema, options["path"], options.get("id", "id")
        self.key, self.value = options.get("key"), options.get("value")
        self.first, self.page, self.pages = int(options.get("cursor", 0)), int(options.get("page", PAGE)), int(options.get("pages", 0))
        self.at: int | None = None

    def _table(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.path, format="parquet", exclude_invalid_files=False)

    def _rows(self, after: int, upto: int | None):
        import pyarrow.dataset as ds

        rows = ds.field(self.id) > after
        if upto is not None:
            rows &= ds.field(self.id) <= upto
        if self.key is not None:
            rows &= ds.field(self.key).cast(pa.string()) == self.value
        return rows

    def _ids(self, after: int, upto: int | None = None):
        """Ids of the events behind a cursor, ascending; of the log only that column is read."""
        import numpy as np

        found = self._table().to_table(columns=[self.id], filter=self._rows(after, upto))
        return np.unique(found.column(0).to_numpy())

    def initialOffset(self) -> dict:
        self.at = self.first
        return {"id": self.first}

    def latestOffset(self) -> dict:
        """The end of the next batch: of ``pages`` pages, or all there is. A reader that has just come back from a
        checkpoint doesn't know its place yet, and takes all there is, in pages."""
        ids = self._ids(self.first if self.at is None else self.at)
        if not len(ids):
            return {"id": self.first if self.at is None else self.at}
        most = self.pages * self.page if self.pages and self.at is not None else len(ids)
        return {"id": int(ids[min(most, len(ids)) - 1])}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.at = end["id"]
        ids = self._ids(start["id"], end["id"])
        ends = [int(ids[k]) for k in range(self.page - 1, len(ids), self.page)]
        if len(ids) and (not ends or ends[-1] != int(ids[-1])):
            ends.append(int(ids[-1]))
        return [Page(a, b) for a, b in zip([start["id"], *ends], ends)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = self._table().to_table(columns=self.schema.names, filter=self._rows(partition.after, partition.upto)).sort_by(self.id)
        yield from rows.cast(to_arrow_schema(self.schema)).to_batches()

    def commit(self, end: dict) -> None:
        self.at = end["id"]


class EventLog(DataSource):
    """``spark.readStream.format("event_log")`` of a Parquet log that grows by appended files.

    Options: ``path``; ``id`` (its column of ids); ``cursor`` (events with greater ids are delivered, ascending);
    ``key`` and ``value`` (of one workflow only); ``page`` (events a task) and ``pages`` (a batch; 0: all there are).
    An id that turns up below the last one delivered is not delivered, as with any cursor. A schema is needed.
    """

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self):
        raise ValueError("give the schema of the log")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Pages(schema, self.options)


def event_log(spark: SparkSession, path: str, schema: str | StructType, cursor: int = 0, **options) -> DataFrame:
    """The log behind a cursor, as a stream."""
    spark.dataSource.register(EventLog)
    return spark.readStream.format("event_log").schema(schema).options(path=path, cursor=cursor, **{k: str(v) for k, v in options.items()}).load()


def once(events: DataFrame, id_: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Each event once: repeated ids within ``delay`` of event time are dropped, whichever batch they come in."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([id_])


def envelopes(events: DataFrame) -> DataFrame:
    """``id, message``: server-sent events, an id line and a data line, of rows with ``id`` and ``payload``."""
    return events.select("id", F.format_string("id: %d\ndata: %s\n\n", "id", "payload").alias("message"))
