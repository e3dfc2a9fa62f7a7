"""The scans answer a batch in small arrays: a worker holds the objects of few texts at a time."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from scriptorium.operators import exhibits, research_units, review, segmentation
from scriptorium.plans.queries import Review, _gate_writes
from scriptorium.session import materialise
from scriptorium.sources import lines, markdown


def kind(ddl, spark):
    return to_arrow_type(DataType.fromDDL(ddl))


def paper(i):
    return None if i % 7 == 3 else f"# On the matter {i}\n\n" + "".join(f"## Methods é {k}\n\nWords.\n\n" for k in range(i % 9))


def test_headings_of_a_batch_are_answered_in_small_arrays(spark):
    texts = [paper(i) for i in range(5000)]
    wanted = [markdown.linked_headings(t) for t in texts[:300]]
    given, out = pa.array(texts), kind(markdown.HEADINGS, spark)
    tracemalloc.start()
    sizes, first = [], []
    for found in lines.answers(iter([given, given[:0], given[:10]]), markdown.linked_headings, out):
        sizes.append(len(found))
        first += found.to_pylist() if len(first) < 300 else []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 5010 and max(sizes) <= lines.ANSWERED
    assert first[:300] == wanted
    assert peak < 8_000_000  # 5,000 answers at once: some 25 MB


def test_what_a_scan_holds_does_not_grow_with_its_batch(spark):
    out = kind(markdown.HEADINGS, spark)

    def peak(n):
        given = pa.array([paper(i % 70) for i in range(n)])
        tracemalloc.start()
        answered = sum(len(found) for found in lines.answers(iter([given]), markdown.linked_headings, out))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert answered == n
        return top

    peak(70)  # the headings are remembered from here on
    assert peak(4000) < 1.5 * peak(500)  # whole batches at once: some 8 times


def test_long_texts_are_answered_alone(spark):
    texts = pa.array(["x" * lines.ANSWERED_BYTES] * 3 + ["# a"] * 2)
    assert [len(x) for x in lines.answers(iter([texts]), markdown.linked_headings, kind(markdown.HEADINGS, spark))] == [1, 1, 1, 2]


def test_long_headings_are_not_remembered():
    before = markdown.remembered_matches.cache_info().currsize
    long = "Methods " * 1000
    assert {m["keyword"] for m in markdown.matches_of(long)} == {m["keyword"] for m in markdown.heading_matches(long)} != set()
    assert markdown.remembered_matches.cache_info().currsize == before


def test_headings_through_spark_equal_the_scan(spark):
    given = [(i, paper(i)) for i in range(500)]
    df = spark.createDataFrame(given, "i int, t string").repartition(2)
    found = {r.i: [h.asDict(recursive=True) for h in r.h] for r in df.select("i", markdown.detect_headings(F.col("t")).alias("h")).collect()}
    assert found == {i: markdown.linked_headings(t) for i, t in given}


def test_tables_of_a_batch_are_answered_in_small_arrays(spark):
    texts = [None if i % 7 == 3 else f"x\n| a | {i} |\n\n(continued)\n| é | b |\n![f](u)\n" for i in range(500)]
    for scan, ddl in ((lines.table_blocks, lines.TABLES), (lines.images, lines.IMAGES)):
        found = list(lines.answers(iter([pa.array(texts)]), scan, kind(ddl, spark)))
        assert max(map(len, found)) <= lines.ANSWERED
        assert [x for f in found for x in f.to_pylist()] == [scan(t) for t in texts]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_dropped_blocks_are_scanned_once(spark):
    papers = spark.createDataFrame([(1, "continued\n| a |\n"), (2, "| a |\n"), (3, None)], "paper_id long, markdown string")
    rows = exhibits.dropped_blocks(papers)
    assert scans(rows) == 1
    assert [tuple(r) for r in rows.collect()] == [(1, 1)]


def test_violations_scan_no_paper_again_and_sort_no_text(spark):
    papers = spark.createDataFrame([(1, "## A\né\n## B\nx"), (2, "## A\n## B\n"), (3, None)], "paper_id long, markdown string")
    nodes = segmentation.segment(papers)
    moved = F.when((F.col("paper_id") == 1) & (F.col("ordinal") == 0), 6).otherwise(F.col("start_offset"))
    found = segmentation.violations(nodes.withColumn("start_offset", moved).filter("not (paper_id = 2 and ordinal = 1)"), papers)
    assert scans(found) == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    assert sorted(map(tuple, found.collect())) == [(1, 0, "inside_character"), (2, -1, "node_count")]


def test_rejections_of_runs_scan_no_text(spark, sf):
    r = Review(spark, sf)
    assert scans(r.rejections) == 0 and "trees" not in vars(r)
    ids = lambda runs: sorted(x.run_id for x in runs.select("run_id").collect())
    assert ids(r.run_ids) == ids(r.runs) != []


def test_reviewed_sections_are_cut_without_a_scan_of_texts(spark):
    """Spans come from the trees; a text that has changed since, here so that they would end inside a character, is not cut."""
    papers = spark.createDataFrame([(1, "## Zeta\n\n### Eta\n\né\n## Theta\nx"), (2, None), (3, "## Zeta\nx\n## Eta\ny")], "paper_id long, markdown string")
    trees = materialise(segmentation.paper_trees(papers), "trees")
    tasks, runs = segmentation.review_tasks(trees), segmentation.segmentation_runs(trees)
    none = spark.createDataFrame([], "task_id string, decision string, assigned_role string")
    now = papers.withColumn("markdown", F.when(F.col("paper_id") == 3, "é" * 20).otherwise(F.col("markdown")))
    items = review.review_items(tasks, none, trees, runs, now)
    assert scans(items) == 0
    found = sorted((r.paper_id, r.section_ordinal, r.heading_raw, r.text) for r in items.filter("section_ordinal >= 0").collect())
    assert found == [(1, 0, "Zeta", "\n\n### Eta\n\né\n"), (1, 1, "Eta", "\n\né\n"), (1, 2, "Theta", "\nx"), (2, 0, None, "")]


def test_gate_evidence_is_scanned_once(spark, sf):
    papers = spark.createDataFrame([(1, "## Study 1\nIn Study 2 and study 2.\n"), (2, "## Wave 3\nx"), (3, None)], "paper_id long, markdown string")
    for column in ("in_headings", "in_text"):
        rows = research_units.unit_evidence(papers).select("paper_id", F.posexplode(column).alias("position", "e"))
        assert scans(rows) == 1
        found = sorted((r.paper_id, r.position, r.e.kind, r.e.label) for r in rows.collect())
        assert found == ([(1, 0, "study", "1"), (2, 0, "wave", "3")] if column == "in_headings" else [(1, 0, "study", "2")])
    assert [scans(x) for x in _gate_writes(spark, sf)[:2]] == [0, 0]
