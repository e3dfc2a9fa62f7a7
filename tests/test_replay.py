"""The review log replayed: against a plain replay of random logs with equal times, and as a stream that is restarted."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import review
from scriptorium.streaming.decisions import EVENT, live_gates, review_events

SEEDS = range(1000)


def random_log(seed):
    """(task ids, events) of a run; events: (ts, place, id, kind, task, decision)."""
    rng = random.Random(seed)
    tasks = [f"{seed}/{i}" for i in range(rng.randrange(4))]
    events = []
    for i in range(rng.randrange(1, 14)):
        kind = rng.choice(["decision"] * 5 * bool(tasks) + ["consume", "return"] + ["rejection"] * (rng.random() < 0.15))
        task = rng.choice(tasks) if kind == "decision" else None
        said = rng.choice(["resolve", "resolve", "reject"]) if kind == "decision" else None
        events.append((rng.randrange(6), {"decision": 0, "rejection": 1}.get(kind, 2), i, kind, task, said))
    return tasks, sorted(events, key=lambda e: e[:3])


def plain_replay(tasks, events):
    answers, rejected, frozen = {}, False, False
    for _, _, i, kind, task, said in events:
        outcome = "refused"
        if kind == "decision" and not frozen:
            answers[task], outcome = said, "accepted"
        if kind == "rejection":
            rejected, outcome = True, "accepted"
        bad = sum(a == "reject" for a in answers.values())
        state = "returned" if rejected or bad else "open" if len(answers) < len(tasks) else "passed"
        if kind == "consume" and state == "passed":
            outcome, frozen = ("again" if frozen else "consumed"), True
        if kind == "return" and state == "returned" and not frozen:
            outcome, frozen = "returned", True
        yield i, kind, len(tasks) - len(answers), bad, rejected, state, outcome


@pytest.fixture(scope="module")
def logs():
    return {str(seed): random_log(seed) for seed in SEEDS}


def relations(spark, logs):
    """runs, tasks, decisions, rejections and requests of the logs; ids are unique over all runs."""
    of = lambda *kinds: [(run, int(run) * 100 + e[2], *e) for run, (_, events) in logs.items() for e in events if e[3] in kinds]
    runs = spark.createDataFrame([(r,) for r in logs], "run_id string")
    tasks = spark.createDataFrame([(t, r) for r, (ts, _) in logs.items() for t in ts], "task_id string, run_id string")
    time = lambda ts: F.timestamp_seconds(F.col(ts)).alias("ts")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    decisions = frame([(e[1], e[2], e[6], e[7]) for e in of("decision")], "decision_id long, t long, task_id string, decision string")
    rejections = frame([(e[1], e[2], e[0]) for e in of("rejection")], "rejection_id long, t long, run_id string")
    requests = frame([(e[1], e[2], e[0], e[5], "x") for e in of("consume", "return")], "request_id long, t long, run_id string, wants string, asked_by string")
    return runs, tasks, *(df.withColumn("ts", time("t")).drop("t") for df in (decisions, rejections, requests))


def wanted(logs):
    return sorted((run, int(run) * 100 + x[0], *x[1:]) for run, log in logs.items() for x in plain_replay(*log))


SHOWN = ["run_id", "id", "kind", "open", "rejected", "run_rejected", "state", "outcome"]


def test_replay_equals_a_plain_one(spark, logs):
    found = review.replay(*relations(spark, logs)).select(SHOWN).collect()
    assert sorted(map(tuple, found)) == wanted(logs)
    assert {r.outcome for r in found} == {"accepted", "refused", "consumed", "returned", "again"}


def test_no_run_is_consumed_while_a_question_is_open(spark, logs):
    runs, tasks, decisions, rejections, requests = relations(spark, logs)
    replayed = review.replay(runs, tasks, decisions, rejections, requests).cache()
    assert replayed.filter("outcome = 'consumed' and (open > 0 or rejected > 0 or run_rejected)").isEmpty()
    frozen = review.freezes(replayed)
    assert frozen.groupBy("run_id").count().filter("count > 1").isEmpty()
    late = review.frozen_out(decisions, tasks, frozen).filter("refused").select("decision_id")
    refused = replayed.filter("outcome = 'refused' and kind = 'decision'").select("id")
    assert {r[0] for r in late.collect()} == {r[0] for r in refused.collect()}
    own = decisions.join(tasks, "task_id")
    last = replayed.groupBy("run_id").agg(F.max_by(F.struct("open", "rejected", "state"), F.struct("ts", F.expr("kind not in ('decision')"), F.expr("kind not in ('decision', 'rejection')"), "id")).alias("s"))
    gates = review.gate(runs, tasks, review.latest_decisions(own, frozen), rejections)
    assert gates.join(last, "run_id").filter("open <> s.open or rejected <> s.rejected or state <> s.state").isEmpty()


def test_a_restarted_stream_gives_the_same_outcomes(spark, logs, tmp_path):
    """Events of the first times, then the others after a stop; those of one time arrive together."""
    runs, tasks, decisions, rejections, requests = relations(spark, logs)
    events = review_events(decisions, rejections, requests, tasks, runs)
    for part in (F.col("ts") < F.timestamp_seconds(F.lit(3)), F.col("ts") >= F.timestamp_seconds(F.lit(3))):
        events.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = live_gates(spark.readStream.schema(EVENT).parquet(str(tmp_path / "events")))
        sink = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        sink.format("parquet").option("path", str(tmp_path / "outcomes")).outputMode("append").start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "outcomes")).select(SHOWN).collect()
    assert sorted(map(tuple, found)) == wanted(logs)
