"""Metrics of the engine's own runs: what each step wrote, how long it took and how it ended.

A step's rows are counted by an observation while they are written, so metering adds no job. A run's entries, one for a
step or a micro-batch, are few and go into its log when it ends; the logs of all runs under one folder are one table, from
which counters and histograms are aggregated like any other.
"""

from __future__ import annotations

import threading
import time
import uuid
from datetime import UTC, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from scriptorium.operators.ingest import LATENCY_BOUNDS, counters, latency_histogram, metric_lines, metrics_text

#: An entry of a log; seconds are exact, so that their sums are the same in any order.
ENTRY = "run string, step string, status string, rows long, seconds decimal(18, 6), ended_at timestamp"


class _Batches(StreamingQueryListener):
    """Notes every micro-batch of the streams that it is told of, by the stream's name."""

    def __init__(self, note):
        self.note, self.lock, self.own, self.over = note, threading.Lock(), {}, {}

    def follow(self, name: str) -> None:
        self.own[name] = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name in self.own:
            with self.lock:
                self.over[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) in self.over:
            self.note(p.name, "ok", p.numInputRows, Decimal(p.batchDuration) / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.over.get(str(event.runId))
        if name is not None:
            if event.exception is not None:
                self.note(name, "failed", 0, Decimal(0))
            self.own[name].set()


class RunMetrics:
    """The metrics of one run, to be used in a `with` block: its log is written at the end, also when a step fails.

    A run that is killed before leaves no log. Rows are those of the tasks whose results counted; where a lost executor makes
    a stage run again, Spark may count rows of that stage twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.run, self.entries = spark, path, uuid.uuid4().hex, []
        self.batches = None

    def __enter__(self) -> RunMetrics:
        return self

    def __exit__(self, *error) -> None:
        if self.batches is not None:
            self.spark.streams.removeListener(self.batches)
        if self.entries:
            self.spark.createDataFrame(self.entries, ENTRY).coalesce(1).write.parquet(f"{self.path}/run={self.run}")

    def _note(self, step: str, status: str, rows: int, seconds: Decimal) -> None:
        self.entries.append((self.run, step, status, rows, round(seconds, 6), datetime.now(UTC)))

    def write(self, step: str, df: DataFrame, target: str) -> DataFrame:
        """Write df as Parquet, count its rows on the way, and read it back. A failure is noted and raised."""
        seen, begun = Observation(), time.monotonic()
        taken = lambda: Decimal(time.monotonic() - begun)
        try:
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(target)
        except BaseException:
            self._note(step, "failed", 0, taken())
            raise
        # a plan that turned out to be empty may have lost its observation
        self._note(step, "ok", seen.get.get("rows", 0), taken())
        return self.spark.read.schema(df.schema).parquet(target)

    def follow(self, name: str) -> None:
        """Note the micro-batches of the stream that will be started under this name: an entry for each."""
        if self.batches is None:
            self.batches = _Batches(self._note)
            self.spark.streams.addListener(self.batches)
        self.batches.follow(name)

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until a followed stream has ended and its last batch is noted; its failure is raised."""
        try:
            query.awaitTermination()
        finally:
            if not self.batches.own[query.name].wait(seconds):
                raise TimeoutError(f"no end of {query.name} was reported")


def logged(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all runs that ended, of any application."""
    return spark.read.schema(ENTRY).parquet(path)


def run_lines(entries: DataFrame) -> list[tuple[str, str, str, DataFrame]]:
    """The metrics of entries, as `metrics_text` takes them: rows and endings by step, and a histogram of seconds."""
    rows = metric_lines(counters(entries, ["step"], "rows"), "step_rows_total", ["step"])
    ends = metric_lines(counters(entries, ["step", "status"]), "step_runs_total", ["step", "status"])
    seconds = metric_lines(latency_histogram(entries, "seconds", ["step"]), "step_seconds", ["step"], LATENCY_BOUNDS)
    return [
        ("step_rows_total", "Rows that a step wrote or a stream took in.", "counter", rows),
        ("step_runs_total", "How often a step ended, by outcome.", "counter", ends),
        ("step_seconds", "Seconds that a step took.", "histogram", seconds),
    ]


def run_text(entries: DataFrame) -> str:
    return metrics_text(run_lines(entries))
