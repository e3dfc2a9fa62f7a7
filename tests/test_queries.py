"""Every registered query against its SQL in DuckDB, and that the generated corpus reaches every branch."""

import pytest
from pyspark.sql import functions as F

from scriptorium.plans import registry
from tests.compare import duck, rows

registry.load()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(name, spark, sf):
    df = registry.QUERIES[name](spark, sf)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    names, wanted = duck(registry.ORACLE_SQL[name], sf)
    assert sorted(df.columns) == names
    assert found == wanted


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize(
    ("name", "column", "values"),
    [
        ("section_nodes", "method", {"rule", "structural", "inherited", "child_consensus", None}),
        ("section_nodes", "heading_source", {"detected", "inferred", None}),
        ("review_tasks", "review_reason", {"zero_role_match", "multi_role_match", "no_structure", "title_ambiguity"}),
        ("segmentation_runs", "title_method", {"singleton_h1", "structural_rule", None}),
        ("gate_state", "state", {"open", "returned", "passed"}),
        ("decision_validation", "outcome", {"valid", "unknown task", "reviewer missing", "comment missing", "unknown role"}),
        ("request_outcomes", "outcome", {"consumed", "again", "returned", "refused"}),
        ("study_gate", "verdict", {"single", "multi", "uncertain"}),
        ("methodology_class", "methodology_class", {"quantitative", "qualitative", None}),
        ("table_captions", "caption_source", {"above", "first_cell", "none"}),
        ("paper_routing", "route", {"allowed", "not_empirical", "unverified_quotes"}),
        ("paper_lifecycle", "status", {"ready", "failed", "processing", "pending"}),
    ],
)
def test_branches_are_reached(name, column, values, spark):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert values <= {r[0] for r in df.select(column).distinct().collect()}


def test_review_run_is_null_where_its_sql_is(spark, sf):
    shown = ("heading_raw", "ancestors", "text_md5")
    asked = registry.QUERIES["review_run"](spark, sf).select("task_id", *(F.col(c).isNull() for c in shown))
    _, wanted = duck(f"select task_id, {', '.join(f'{c} is null as {c}' for c in shown)} from ({registry.ORACLE_SQL['review_run']})", sf)
    assert rows(["task_id", *shown], [tuple(r) for r in asked.collect()]) == wanted
