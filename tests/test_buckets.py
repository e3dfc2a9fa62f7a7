"""Bucketed tables: what crosses an exchange where texts meet quotes and reviewed sections."""

import re

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import paper_types, review
from scriptorium.plans.corpus import relation
from scriptorium.plans.queries import Review, bucketed, papers_of
from scriptorium.session import written_root
from scriptorium.sources.buckets import drop_bucketed, write_bucketed


def exchanged(df) -> list[str]:
    """What each exchange of a plan carries, as the plan prints its input."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]", text)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def stored(spark, sf, no_broadcast):
    return bucketed(spark, "papers", papers_of(spark, sf).select("paper_id", "markdown"))


def carries_text(carried: list[str]) -> list[str]:
    return [c for c in carried if re.search(r"\b(markdown|bytes)#", c)]


@pytest.mark.parametrize("both", [False, True])
def test_quotes_meet_texts_where_they_lie(both, spark, sf, stored):
    """Responses are shuffled to the buckets of papers, or nothing is if they lie in buckets too."""
    responses = relation(spark, sf, "responses")
    plain = paper_types.verify_verdicts(responses, papers_of(spark, sf))
    assert carries_text(exchanged(plain))
    rows = paper_types.verify_verdicts(bucketed(spark, "responses", responses) if both else responses, stored)
    carried = exchanged(rows)
    assert not carries_text(carried)
    assert len(carried) == (0 if both else 1)
    names = ["paper_id", "quotes_expected", "quotes_verified", "all_verified"]
    assert sorted(map(tuple, rows.select(*names).collect())) == sorted(map(tuple, plain.select(*names).collect()))


def test_reviewed_sections_are_cut_where_texts_lie(spark, sf, stored):
    r = Review(spark, sf)
    args = (r.tasks, r.decisions, r.trees, r.runs)
    found, wanted = review.review_items(*args, stored), review.review_items(*args, papers_of(spark, sf))
    carried = exchanged(found)
    assert carried and not carries_text(carried)
    shown = lambda df: sorted(map(str, df.select("task_id", "heading_raw", "decision", "text").collect()))
    assert shown(found) == shown(wanted)


def test_bucketed_tables(spark):
    """Null and repeated keys are kept, an empty table is a table, a name or folder in use is an error."""
    root = written_root(spark)
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None), (2, "")], "paper_id long, markdown string")
    table = write_bucketed(df, "few_papers", f"{root}/few_papers", 8)
    assert sorted(map(str, table.collect())) == sorted(map(str, df.collect()))
    assert write_bucketed(df.limit(0), "no_papers", f"{root}/no_papers", 8).count() == 0
    with pytest.raises(Exception, match="(?i)already exists"):
        write_bucketed(df, "few_papers", f"{root}/elsewhere", 8)
    assert table.count() == 5
    drop_bucketed(spark, "few_papers")
    drop_bucketed(spark, "no_papers")
    assert spark.read.parquet(f"{root}/few_papers").filter(F.col("paper_id") == 1).count() == 2
