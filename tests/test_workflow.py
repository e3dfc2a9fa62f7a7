"""Review rules, sinks and sources, upserts, and the decision stream."""

import os

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import ingest, paper_types, research_units, review, segmentation
from scriptorium.session import discard, materialise
from scriptorium.sources.papers import export_markdown, landed_pdfs, markdown_files, publish_runs, published, read_run
from scriptorium.streaming.decisions import follow_decisions, gate_now

TASKS = "run_id string, paper_id long, task_ordinal int, task_id string, section_ordinal int, review_reason string"


def tasks(spark):
    return spark.createDataFrame(
        [("r", 1, 0, "a", 1, "zero_role_match"), ("r", 1, 1, "b", 2, "multi_role_match"), ("s", 2, 0, "c", -1, "title_ambiguity")],
        TASKS,
    )


def decisions(spark, *rows):
    return spark.createDataFrame(
        [(i, t, d, "results", "T", "why", "me", i) for i, (t, d) in enumerate(rows)],
        "decision_id long, task_id string, decision string, assigned_role string, assigned_title_text string, comment string, reviewer_id string, ts long",
    )


@pytest.mark.parametrize(
    ("given", "rejected", "states"),
    [
        ((), [], ("open", "open", "passed")),
        ((("a", "resolve"),), [], ("open", "open", "passed")),
        ((("a", "resolve"), ("b", "resolve"), ("c", "resolve")), [], ("passed", "passed", "passed")),
        ((("a", "reject"),), [], ("returned", "open", "passed")),
        ((("a", "reject"), ("a", "resolve")), ["q"], ("open", "open", "returned")),
    ],
)
def test_gate(spark, given, rejected, states):
    runs = spark.createDataFrame([("r",), ("s",), ("q",)], "run_id string")
    rejections = spark.createDataFrame([(i, r, i) for i, r in enumerate(rejected)], "rejection_id long, run_id string, ts long")
    found = {
        r.run_id: r.state for r in review.gate(runs, tasks(spark), review.latest_decisions(decisions(spark, *given)), rejections).collect()
    }
    assert (found["r"], found["s"], found["q"]) == states


def test_decisions_after_consumption_are_dropped(spark):
    log = decisions(spark, ("a", "resolve"), ("a", "reject")).withColumn("run_id", F.lit("r"))
    kept = review.latest_decisions(log, spark.createDataFrame([("r", 0)], "run_id string, consumed_at long")).collect()
    assert [(r.decision, r.decision_id, r.created_at) for r in kept] == [("resolve", 0, 0)]


def test_upserts(spark):
    log = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 2, "y"), (2, "c", 5, "z")], "k long, id string, ts long, v string")
    assert sorted(map(tuple, ingest.upsert(log, ["k"], "ts", ["id"]).select("k", "id", "ts", "v").collect())) == [(1, "a", 2, "y"), (2, "c", 5, "z")]
    assert sorted(map(tuple, ingest.insert_if_absent(log, ["k"], "ts").select("k", "id", "v").collect())) == [(1, "a", "x"), (2, "c", "z")]


def test_files_and_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF")
    (tmp_path / "in/b.md").write_bytes("# é\nx".encode())
    assert [r.hash for r in landed_pdfs(spark, str(tmp_path / "in")).collect()] == ["bfa4b10a76324b166cfdad5e02a63730"]
    papers = markdown_files(spark, str(tmp_path / "in")).withColumn("paper_id", F.lit(1))
    assert export_markdown(papers, 1, str(tmp_path / "out.md")) == 6 and (tmp_path / "out.md").read_bytes() == "# é\nx".encode()
    with pytest.raises(LookupError):
        export_markdown(papers, 2, str(tmp_path / "none.md"))


def test_runs_are_published_all_at_once_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "runs")
    with pytest.raises(LookupError):
        published(spark, path)
    runs = spark.range(10000).select(F.concat(F.lit("r"), "id").alias("run_id"), F.lit(1).alias("version"))
    nodes = runs.select("run_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"))
    publish_runs(path, runs=runs, nodes=nodes)
    assert published(spark, path).count() == 10000 and published(spark, path, "nodes").count() == 20000
    old = published(spark, path, "nodes")
    one = runs.filter("run_id = 'r7'").withColumn("version", F.lit(2))
    failing = nodes.withColumn("ordinal", F.when(F.col("run_id") == "r9", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("ordinal")))
    with pytest.raises(Exception, match="lost"):
        publish_runs(path, runs=runs.withColumn("version", F.lit(9)), nodes=failing)
    assert len(list((tmp_path / "runs/batches").iterdir())) == 1
    assert {r.version for r in published(spark, path).select("version").distinct().collect()} == {1}
    publish_runs(path, runs=one, nodes=nodes.filter("run_id = 'r7' and ordinal = 0"))
    assert old.filter("run_id = 'r7'").count() == 2  # a reader that began before goes on with what it saw
    assert [r.ordinal for r in read_run(spark, path, "r7", "nodes").collect()] == [0]
    assert read_run(spark, path, "r8", "nodes").count() == 2 and published(spark, path).count() == 10000
    assert {tuple(r) for r in published(spark, path).groupBy("version").count().collect()} == {(1, 9999), (2, 1)}
    publish_runs(path, runs=one.withColumn("version", F.lit(3)))
    assert read_run(spark, path, "r7", "nodes").count() == 0  # the new batch has no nodes of it
    for missing in (("none", "nodes"), ("r7", "tasks")):
        with pytest.raises(LookupError):
            read_run(spark, path, *missing)


def test_stream_of_decisions(spark, tmp_path):
    given = decisions(spark, ("a", "resolve"), ("b", "resolve"))
    given.write.parquet(str(tmp_path / "source"))
    stream = spark.readStream.schema(given.schema).parquet(str(tmp_path / "source"))
    follow_decisions(stream, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    runs, none = spark.createDataFrame([("r",)], "run_id string"), spark.createDataFrame([], "rejection_id long, run_id string, ts long")
    found = gate_now(runs, tasks(spark), none, lambda: spark.read.parquet(str(tmp_path / "log")))
    assert found.first().state == "passed"


def test_latest_verdict_breaks_ties_by_id(spark):
    log = spark.createDataFrame(
        [(1, "h", 5, 1), (1, "h", 5, 2), (1, "g", 9, 0)],
        "paper_id long, markdown_hash string, created_at long, verdict_id long",
    )
    assert {(r.markdown_hash, r.verdict_id) for r in paper_types.latest_verdicts(log).collect()} == {("h", 2), ("g", 0)}


def test_metrics_text(spark):
    events = spark.createDataFrame([(1, 'a"b', 0.05, 3), (2, 'a"b', 7.5, 9), (3, "c", 100.0, 4)], "id long, kind string, seconds double, size long")
    counted = ingest.metric_lines(ingest.counters(events, ["kind"]), "done_total", ["kind"])
    latest = ingest.metric_lines(ingest.gauges(events, [], "size", "id", "id"), "size", [])
    timed = ingest.latency_histogram(events.filter("kind = 'c'"), "seconds", ["kind"], (0.1, 5))
    timed = ingest.metric_lines(timed, "took", ["kind"], (0.1, 5))
    text = ingest.metrics_text([("took", "Seconds.", "histogram", timed), ("done_total", "Done.", "counter", counted), ("size", "Size.", "gauge", latest)])
    assert text == (
        "# HELP done_total Done.\n# TYPE done_total counter\n" 'done_total{kind="a\\"b"} 2\ndone_total{kind="c"} 1\n'
        "# HELP size Size.\n# TYPE size gauge\nsize 4\n# HELP took Seconds.\n# TYPE took histogram\n"
        'took_bucket{kind="c",le="0.1"} 0\ntook_bucket{kind="c",le="5"} 0\ntook_bucket{kind="c",le="+Inf"} 1\ntook_sum{kind="c"} 100\ntook_count{kind="c"} 1\n'
    )


def test_snapshots_and_freezes(spark):
    frozen = spark.createDataFrame([("r", 3, "a", 8, "returned"), ("s", 1, "c", 9, "consumed")], "run_id string, consumed_at long, consumed_by string, request_id long, how string")
    items = spark.createDataFrame([("r", 0, "a", "zero_role_match", "H", ["T"], "why"), ("q", 0, "c", "run_rejected", None, [], "no")], "run_id string, position int, task_id string, review_reason string, heading_raw string, ancestors array<string>, comment string")
    assert [(r.run_id, r.return_id, r.returned_by, r.consumed_at, r.comment) for r in review.return_snapshot(items, frozen).collect()] == [("r", 8, "a", 3, "why")]
    assert [tuple(r) for r in review.consumed_runs(frozen).collect()] == [("s", 1, "c")]
    late = review.frozen_out(decisions(spark, ("a", "resolve"), ("b", "reject"), ("z", "reject")), tasks(spark), spark.createDataFrame([("r", 0)], "run_id string, consumed_at long"))
    assert sorted((r.task_id, r.refused) for r in late.collect()) == [("a", False), ("b", True)]
    said = spark.createDataFrame([(1, "r", 3), (2, "r", 4), (3, "q", 9)], "rejection_id long, run_id string, ts long")
    assert sorted(r.rejection_id for r in review.rejections_by(said, frozen).collect()) == [1, 3]


def test_rejections_need_a_run_a_reviewer_and_a_comment(spark):
    given = [(1, "r", 5, "why", "me"), (2, "r", 3, " ", "me"), (3, "r", 4, "x", None), (4, "z", 1, "why", "me"), (5, "r", 9, "late", "me")]
    log = spark.createDataFrame(given, "rejection_id long, run_id string, ts long, comment string, reviewer_id string")
    runs = spark.createDataFrame([("r",), ("s",)], "run_id string")
    assert {r.run_id: r.superseded_at for r in review.superseded_runs(runs, log).collect()} == {"r": 5, "s": None}


def test_title_decisions_name_a_node_of_their_run(spark):
    log = decisions(spark, ("c", "resolve"), ("c", "resolve"), ("c", "resolve")).withColumn("assigned_title_node", F.element_at(F.array(F.lit("s#0"), F.lit("r#0"), F.lit(None)), F.col("decision_id").cast("int") + 1))
    nodes = spark.createDataFrame([("s#0", "s"), ("r#0", "r")], "node_id string, run_id string")
    assert {r.decision_id: r.error for r in review.decision_errors(log, tasks(spark), nodes).collect()} == {0: None, 1: "title node of another run", 2: None}


def test_gates_keep_their_id_and_replace_their_evidence(spark):
    log = spark.createDataFrame([(1, "h", "1.0", 5, 1, "single", [("study", "1")]), (1, "h", "1.0", 6, 2, "multi", [("study", "1"), ("study", "2")]), (1, "g", "1.0", 7, 1, "single", [])], "paper_id long, markdown_hash string, rule_version string, verdict_id long, ts long, verdict string, evidence array<struct<kind:string,label:string>>")
    gates = research_units.current_gates(log)
    assert {(r.markdown_hash, r.verdict_id, r.verdict) for r in gates.collect()} == {("h", 5, "multi"), ("g", 7, "single")}
    assert sorted((r.verdict_id, r.position, r.label) for r in research_units.gate_evidence(gates).collect()) == [(5, 0, "1"), (5, 1, "2")]


def test_lookups(spark):
    papers = spark.createDataFrame([(1, "x"), (2, "")], "paper_id long, hash string")
    assert [r.hash for r in ingest.paper_by_id(papers, 1).collect()] == ["x"] and ingest.paper_by_id(papers, 9).count() == 0
    assert [r.paper_id for r in ingest.paper_by_hash(papers, "x").collect()] == [1] and ingest.paper_by_hash(papers, "").count() == 0


def test_written_tables_are_deleted(spark):
    table = materialise(spark.range(3), "three")
    files = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    assert table.count() == 3 and os.path.isdir(files)
    discard(table)
    assert not os.path.exists(files)


def test_questions_about_a_whole_document_have_no_ancestors(spark):
    papers = spark.createDataFrame([(1, "## Zeta\n\n### Eta\n\né"), (2, None)], "paper_id long, markdown string")
    trees = segmentation.paper_trees(papers)
    made, none = segmentation.review_tasks(trees), review.latest_decisions(decisions(spark))
    items = review.review_items(made, none, trees, segmentation.segmentation_runs(trees), papers).collect()
    found = sorted((r.paper_id, r.review_reason, r.section_ordinal, r.heading_raw, r.ancestors, r.text) for r in items)
    assert found == [
        (1, "title_ambiguity", 0, "Zeta", [], "\n\n### Eta\n\né"),
        (1, "zero_role_match", 1, "Eta", ["Zeta"], "\n\né"),
        (2, "no_structure", 0, None, [], ""),
        (2, "title_ambiguity", -1, None, [], None),
    ]
