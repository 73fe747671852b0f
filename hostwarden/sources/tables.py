"""Stored tables: every attempt at a batch has folders of its own, and a commit row says which one counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructType

from hostwarden import schemas

# Day partitions for the tables that are read by event time.
DAY_OF = {
    "log_events": "time_created",
    "process_events": "created_at",
    "detection_findings": "event_time",
    "correlation_matches": "first_event_time",
}
REJECTED = "rejected_events"
COMMITS = "commits"
FAILED_RUNS = "failed_runs"
# Metric snapshots may be numbered and committed apart from the event batches.
COMMITS_OF = {"host_metrics": "metric_commits"}
# Texts of events repeat themselves; this halves what batches write.
CODEC = "zstd"
# Attempt of rows that are written without one.
DIRECT = "direct"
_PLACES = ("batch_id", "attempt", "event_date")


class TableStore:
    """Parquet tables below one shared folder.

    An attempt at a batch writes ``<table>/batch_id=<n>/attempt=<a>`` and, last of all, its row
    in ``commits``: one file that is there or not. Readers follow the latest commit of each
    batch. So a batch that fails, or is repeated and fails, changes nothing that was visible,
    and a repetition that succeeds replaces all tables of the batch at once.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def attempt(self, batch_id: int) -> Attempt:
        """A new attempt at a batch."""
        return Attempt(self, batch_id, uuid.uuid4().hex)

    def write(
        self, rows: DataFrame, table: str, batch_id: int, mode: str = "overwrite", attempt: str = DIRECT, by_day: bool = False
    ) -> None:
        """Write an attempt's rows; ``by_day`` says that a task's rows are of few days, so that they need no shuffle."""
        target = f"{self.path(table)}/batch_id={batch_id}/attempt={attempt}"
        day = DAY_OF.get(table)
        if day is None:
            rows.write.mode(mode).parquet(target, compression=CODEC)
            return
        # One day goes to few tasks, so that days do not shatter into tiny files; the
        # rebalance splits a day that is too big for one.
        dated = rows.withColumn("event_date", F.to_date(day))
        placed = dated if by_day else dated.hint("rebalance", "event_date")
        placed.write.mode(mode).partitionBy("event_date").parquet(target, compression=CODEC)

    def exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _rows(self, table: str) -> DataFrame:
        """All rows of all attempts, with batch_id, attempt and event_date."""
        layout = StructType.fromDDL({**schemas.TABLES, **schemas.STORE_TABLES}[table])
        stored = StructType(layout.fields).add("batch_id", LongType()).add("attempt", StringType())
        if table in DAY_OF:
            stored = stored.add("event_date", DateType())
        if not self.exists(table):
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(self.path(table))

    def read(self, table: str, before: int | None = None, only: int | None = None) -> DataFrame:
        """A table, as of the committed batches before one, or the rows of a single batch.

        Of a batch that was committed, ``only`` gives the rows of the attempt that counts.
        """
        rows = self._rows(table)
        if before is not None:
            rows = self._committed_rows(rows.filter(F.col("batch_id") < before), table)
        if only is not None:
            rows = rows.filter(F.col("batch_id") == only)
            chosen = None if table in schemas.STORE_TABLES else self._marks(table).filter(F.col("batch_id") == only).head()
            if chosen is not None:
                rows = rows.filter(F.col("attempt") == chosen["attempt"])
        return rows.drop("attempt")

    def commit(self, batch_id: int, table: str | None = None, attempt: str = DIRECT) -> None:
        """Make an attempt visible; ``table`` names one that is committed apart."""
        row = self.spark.range(1).select(F.current_timestamp().alias("committed_at")).coalesce(1)
        self.write(row, COMMITS_OF.get(table, COMMITS), batch_id, attempt=attempt)

    def _marks(self, table: str) -> DataFrame:
        """The attempt that counts, of every batch that is visible in a table: one row per batch."""
        latest = F.max_by("attempt", F.struct("committed_at", "attempt")).alias("attempt")
        marks = self._rows(COMMITS).groupBy("batch_id").agg(latest)
        if table in COMMITS_OF:
            marks = marks.unionByName(self._rows(COMMITS_OF[table]).groupBy("batch_id").agg(latest))
        return marks

    def _committed_rows(self, rows: DataFrame, table: str) -> DataFrame:
        return rows.join(self._marks(table), ["batch_id", "attempt"], "left_semi")

    def table(self, table: str) -> DataFrame:
        """The committed rows in the layout of the table; of the runs also the failed ones."""
        columns = schemas.columns_of(schemas.TABLES[table])
        rows = self._committed_rows(self._rows(table), table).select(*columns)
        if table == "collector_runs":
            rows = rows.unionByName(self._rows(FAILED_RUNS).select(*columns))
        return rows

    def rejected(self, before: int | None = None) -> DataFrame:
        """The committed rejects with their documents and reasons."""
        columns = schemas.columns_of(schemas.STORE_TABLES[REJECTED])
        rows = self._rows(REJECTED)
        if before is not None:
            rows = rows.filter(F.col("batch_id") < before)
        return self._committed_rows(rows, REJECTED).select(*columns)

    def last_batch(self) -> int | None:
        """Number of the latest committed batch."""
        return self._rows(COMMITS).agg(F.max("batch_id")).head()[0]

    def host_checkpoints(self, before: int | None = None) -> DataFrame:
        """The latest committed checkpoints of every host and channel; a batch that has any stores the full set."""
        rows = self._rows("checkpoints")
        if before is not None:
            rows = rows.filter(F.col("batch_id") < before)
        rows = self._committed_rows(rows, "checkpoints")
        latest = rows.agg(F.max("batch_id").alias("batch_id"))
        return rows.join(F.broadcast(latest), "batch_id").select(*schemas.columns_of(schemas.CHECKPOINTS))

    def checkpoints(self, before: int | None = None) -> DataFrame:
        """The highest checkpoint of each channel over all hosts."""
        rows = self.host_checkpoints(before)
        return rows.groupBy("source_type", "channel").agg(F.max("last_record_id").alias("last_record_id"))


class Attempt:
    """One attempt at a batch: what it writes is read by itself at once, and by others after its commit."""

    def __init__(self, store: TableStore, batch_id: int, name: str) -> None:
        self.store, self.batch_id, self.name = store, batch_id, name

    def write(self, rows: DataFrame, table: str, by_day: bool = False) -> None:
        self.store.write(rows, table, self.batch_id, attempt=self.name, by_day=by_day)

    def read(self, table: str) -> DataFrame:
        rows = self.store._rows(table)
        own = (F.col("batch_id") == self.batch_id) & (F.col("attempt") == self.name)
        return rows.filter(own).drop(*_PLACES)

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows that later steps of the attempt read several times, as files beside the tables.

        Unlike a cache they survive a lost executor, and a reader takes only the columns it needs.
        """
        path = f"{self._staged()}/{name}"
        rows.write.mode("overwrite").parquet(path, compression=CODEC)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    @staticmethod
    def comes_by_day(staged: DataFrame, time: str) -> bool:
        """Whether the staged files hold few days each, as events in order of time do.

        Written as they are, the rows make a file for each pair of staged file and day.
        """
        pairs = staged.select(F.col("_metadata.file_path").alias("file"), F.to_date(time).alias("day")).distinct()
        found = pairs.agg(F.count("*").alias("pairs"), F.countDistinct("file").alias("files"), F.countDistinct("day").alias("days")).head()
        return found["pairs"] <= 2 * (found["files"] + found["days"])

    def clear(self) -> None:
        """Delete what was staged."""
        spark = self.store.spark
        path = spark._jvm.org.apache.hadoop.fs.Path(self._staged())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def _staged(self) -> str:
        return f"{self.store.path('staged')}/batch_id={self.batch_id}/attempt={self.name}"

    def commit(self, table: str | None = None) -> None:
        self.store.commit(self.batch_id, table, self.name)
