"""Metrics of the engine's own runs: counts, sums, failures, streams, and logs of several runs."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from scriptorium.operators.run_metrics import RunMetrics, logged, run_text


def samples(text: str) -> dict[str, Decimal]:
    return {k: Decimal(v) for k, v in (line.rsplit(" ", 1) for line in text.splitlines() if not line.startswith("#"))}


def test_text_of_runs_equals_their_counts_and_sums(spark, tmp_path):
    log = f"{tmp_path}/log"
    for i, n in enumerate((1000, 7)):
        with RunMetrics(spark, log) as run:
            even = run.write("even", spark.range(n).filter("id % 2 = 0"), f"{tmp_path}/even{i}")
            grouped = even.groupBy((F.col("id") % 10).alias("k")).count()
            assert run.write("grouped", grouped, f"{tmp_path}/grouped{i}").count() == grouped.count()
            run.write("none", even.filter("id < 0"), f"{tmp_path}/none{i}")
    entries = logged(spark, log)
    found, rows = samples(run_text(entries)), entries.collect()
    assert found['step_rows_total{step="even"}'] == 504 and found['step_rows_total{step="grouped"}'] == 9
    assert found['step_rows_total{step="none"}'] == 0
    for step in ("even", "grouped", "none"):
        taken = [r["seconds"] for r in rows if r["step"] == step]
        assert found[f'step_seconds_sum{{step="{step}"}}'] == sum(taken) > 0
        assert found[f'step_seconds_count{{step="{step}"}}'] == found[f'step_runs_total{{step="{step}",status="ok"}}'] == 2
        below = {Decimal(le): n for k, n in found.items() for le in re.findall(rf'bucket{{step="{step}",le="([\d.]+)"', k)}
        assert below == {b: sum(t <= b for t in taken) for b in below} and len(below) == 10


def test_a_failed_step_is_noted_and_raised(spark, tmp_path):
    with pytest.raises(Exception, match="stopped halfway"), RunMetrics(spark, f"{tmp_path}/log") as run:
        run.write("good", spark.range(3), f"{tmp_path}/good")
        run.write("bad", spark.range(3).select(F.raise_error(F.lit("stopped halfway"))), f"{tmp_path}/bad")
    found = {(r["step"], r["status"], r["rows"]) for r in logged(spark, f"{tmp_path}/log").collect()}
    assert found == {("good", "ok", 3), ("bad", "failed", 0)}


def test_micro_batches_of_a_followed_stream(spark, tmp_path):
    """Three files, one a batch, are three entries; another stream's batches aren't noted; a failing one is."""
    for i, n in enumerate((5, 0, 8)):
        spark.range(n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def started(df, name):
        sink = df.writeStream.queryName(name).option("checkpointLocation", f"{tmp_path}/check-{name}").trigger(availableNow=True)
        return sink.start(f"{tmp_path}/out-{name}", format="parquet")

    with RunMetrics(spark, f"{tmp_path}/log") as run:
        run.follow("landing")
        run.follow("breaking")
        run.wait(started(source, "landing"))
        started(source, "other").awaitTermination()
        with pytest.raises(Exception, match="stopped halfway"):
            run.wait(started(source.select(F.raise_error(F.lit("stopped halfway")).cast("string").alias("x")), "breaking"))
    entries = logged(spark, f"{tmp_path}/log")
    own = entries.filter("step = 'landing'").collect()
    assert sum(r["rows"] for r in own) == 13 and all(r["status"] == "ok" and r["seconds"] > 0 for r in own)
    assert [r["status"] for r in entries.filter("step = 'breaking'").collect()] == ["failed"]
    assert entries.filter("step = 'other'").isEmpty()
