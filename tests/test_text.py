"""Vectors of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions.dimensions import CONTENT_CLASS, GLOSSARY, KEYWORD_ROLE, SCOPE


def apply(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("s"))).collect()]


def test_dimensions():
    assert len(KEYWORD_ROLE) == 156 and len(set(KEYWORD_ROLE.values())) == 16
    assert len(CONTENT_CLASS) == len(SCOPE) == 17
    assert [sum(m == x for _, m in GLOSSARY) for x in ("qualitative", "quantitative", "mixed", None)] == [28, 66, 1, 206]
    assert len({t for t, _ in GLOSSARY}) == 301


def test_normalize(spark):
    given = [
        "  Discussion  ",
        "Results   and    discussion",
        "Data\tavailability",
        "Methodology:",
        "Abstract : ",
        "3. Methodology:",
        "RÉSULTATS",
        ":.",
        "ΛΟΓΟΣ",
        "İx",
        None,
    ]
    assert apply(spark, X.normalize, *given) == ["discussion", "results and discussion", "data availability", "methodology", "abstract", "3. methodology", "résultats", "", "λογοσ", "ix", None]


def test_strip_identifiers(spark):
    given = [
        "4 results",
        "section 4: results",
        "section 4a. results",
        "iv. results",
        "b) results",
        "2.1. sample and procedure",
        "3: methodology",
        "a priori power analysis",
        "ivory tower critiques",
        "3d printing",
        "civil. liberties",
    ]
    assert apply(spark, X.strip_identifiers, *given) == ["results"] * 5 + ["sample and procedure", "methodology", "a priori power analysis", "ivory tower critiques", "3d printing", "liberties"]


def test_parse_container(spark):
    given = [
        "appendix",
        "appendix a1",
        "appendix b: robustness checks",
        "appendix c. measures",
        "online appendix",
        "supporting information for reviewers",
        "appendixation of it",
    ]
    assert [tuple(r) for r in apply(spark, X.parse_container, *given)] == [
        ("appendix", None, ""), ("appendix", "A1", ""), ("appendix", "B", "robustness checks"), ("appendix", "C", "measures"), ("appendix", None, ""), (None, None, "supporting information for reviewers"), (
            "appendix",
            None,
            "ation of it",
        ),
    ]


@pytest.mark.parametrize(("s", "w", "held"), [("results and discussion", "results", True), ("art.", "art", True), ("datos análisis", "análisis", True), ("resultset handling", "results", False), ("preresults", "results", False), ("análisis", "lisis", False), ("x", "", False)])
def test_whole_words(spark, s, w, held):
    assert spark.range(1).select(X.contains_whole_word(F.lit(s), F.lit(w))).first()[0] is held


@pytest.mark.parametrize(("s", "w", "n"), [("two samples were drawn", "sample", 1), ("resampling is not sampling", "sampling", 1), ("a variable and two variables", "variable", 2), ("mean, mean and mean again", "mean", 3), ("meaning is not mean", "mean", 1), ("particular results", "art", 0), ("art art art", "art art", 2)])
def test_count_whole_word(spark, s, w, n):
    assert spark.range(1).select(X.count_whole_word(F.lit(s), w)).first()[0] == n


def test_labels_quotes_and_tags(spark):
    assert apply(spark, X.group_of, "1A", "2B", "10", "II") == ["1", "2", "10", "II"]
    assert apply(spark, X.normalise_quote, "  “a”​  ‘b’—c… ") == ["\"a\" 'b'-c..."]
    assert apply(spark, lambda s: X.between(s, "<a>", "</a>"), "x<a>1</a>2</a>", "<a>", "</a><a>") == ["1", None, None]
    assert apply(spark, X.extract_title, "x\n # T \n# U", "none", "\n" * 12 + "# late") == ["T", None, None]
    assert spark.range(1).select(X.sort_labels(F.array(F.lit("II"), F.lit("10"), F.lit("2")))).first()[0] == ["2", "10", "II"]


def test_crop(spark):
    assert tuple(apply(spark, X.parse_crop, "https://x/a-19.jpg?height=943&width=1067&top_left_y=354&top_left_x=468")[0]) == (19, 468, 354, 1067, 943)
    assert tuple(apply(spark, X.parse_crop, "b.png")[0]) == (0, 0, 0, 0, 0)
