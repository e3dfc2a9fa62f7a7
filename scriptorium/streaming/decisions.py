"""Review events as a stream, and the gates as keyed state.

`live_gates` keeps what a run's gate needs: the answer in force of each answered question, whether the run was rejected,
and the request that froze it. An event is judged when it arrives: within a micro-batch in the order of the batch replay
(time, decisions before rejections before requests, id), between batches in the order of the batches. A decision that
arrives after its run was frozen is refused, whatever time it bears. Where events arrive in the order of their time, the
outcomes are those of `review.replay`. State and progress are in the checkpoint: a stream that is stopped and started
again goes on where it was.

`follow_decisions` appends a stream of decisions to a log of files instead; `gate_now` folds that log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.operators.review import gate, latest_decisions
from scriptorium.session import ship_package

#: Of `review_events`.
EVENT = "run_id string, ts timestamp, place int, id long, kind string, task_id string, decision string, total int"
OUTCOME = "run_id string, id long, kind string, open int, rejected int, run_rejected boolean, state string, outcome string"
#: Answered questions, those of them that are rejected, whether the run is, and the kind of the request that froze it.
STATE = "answered array<string>, refused array<string>, run_rejected boolean, frozen string"


def review_events(decisions: DataFrame, rejections: DataFrame, requests: DataFrame, tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Valid decisions, rejections and requests of known runs as one relation of EVENT's columns; each may be a stream.

    tasks and runs are tables; total is the number of a run's questions.
    """
    none = F.lit(None).cast("string")
    said = decisions.join(tasks.select("task_id", "run_id"), "task_id")
    rows = said.select("run_id", "ts", F.lit(0).alias("place"), F.col("decision_id").alias("id"), F.lit("decision").alias("kind"), "task_id", "decision")
    rows = rows.union(rejections.select("run_id", "ts", F.lit(1), "rejection_id", F.lit("rejection"), none, none))
    rows = rows.union(requests.select("run_id", "ts", F.lit(2), "request_id", "wants", none, none))
    sizes = runs.select("run_id").join(tasks.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("total")), "run_id", "left").fillna(0, ["total"])
    return rows.join(sizes, "run_id")


def _judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    answered, refused, run_rejected, frozen = state.get if state.exists else ([], [], False, None)
    answered, refused, found = set(answered), set(refused), []
    events = pd.concat(list(frames)).sort_values(["ts", "place", "id"], kind="stable")
    for e in events.itertuples(index=False):
        outcome = "refused"
        if e.kind == "decision" and frozen is None:
            answered.add(e.task_id)
            (refused.add if e.decision == "reject" else refused.discard)(e.task_id)
            outcome = "accepted"
        elif e.kind == "rejection":
            run_rejected, outcome = True, "accepted"
        now = "returned" if run_rejected or refused else "open" if len(answered) < e.total else "passed"
        if e.kind == "consume" and now == "passed":
            outcome = "again" if frozen else "consumed"
            frozen = frozen or "consume"
        elif e.kind == "return" and now == "returned" and frozen is None:
            outcome = frozen = "returned"
        found.append((key[0], e.id, e.kind, e.total - len(answered), len(refused), run_rejected, now, outcome))
    state.update((sorted(answered), sorted(refused), run_rejected, frozen))
    yield pd.DataFrame(found, columns=["run_id", "id", "kind", "open", "rejected", "run_rejected", "state", "outcome"])


def live_gates(events: DataFrame) -> DataFrame:
    """Each event of a stream of EVENT's columns with the gate after it and what came of it, as OUTCOME's columns."""
    ship_package(events.sparkSession)
    return events.groupBy("run_id").applyInPandasWithState(_judge, OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout)


def follow_decisions(decisions: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of valid decisions to a log of Parquet files, one folder for each batch."""

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/epoch={epoch}")

    return decisions.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gate_now(runs: DataFrame, tasks: DataFrame, rejections: DataFrame, read_log: Callable[[], DataFrame]) -> DataFrame:
    """The gates by all decisions that the log holds now."""
    return gate(runs, tasks, latest_decisions(read_log().drop("epoch")), rejections)
