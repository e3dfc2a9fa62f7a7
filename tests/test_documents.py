"""Whole documents: headings, trees, exhibits, studies, verdicts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.text import normalize, parse_container, strip_identifiers
from scriptorium.operators import exhibits, methodology, paper_types, research_units, segmentation
from scriptorium.sources.lines import images, table_blocks
from scriptorium.sources.markdown import document_headings, semantic_form


@pytest.mark.parametrize(
    ("markdown", "wanted"),
    [
        ("#Introduction\n## Methods ##\n####### Seven\n", [(2, "Methods")]),
        ("## \n", [(2, "")]), ("### ###\n", [(3, "")]), ("#", [(1, "")]),
        ("```\n# a\n```\n# b", [(1, "b")]), ("~~~\n# a\n~~~~\n# b", [(1, "b")]), ("```\n# a\n~~~\n# b", []),
        ("$$\n# a\n$$\n# b", [(1, "b")]), ("$$x$$\n# b", [(1, "b")]), ("$$\n# a", []),
        ("Title\n---\nOther\n===\n", []), ("    # code\n   # three", [(1, "three")]), ("> # x\n- # y", []),
        ("<div>\n# a\n\n# b", [(1, "b")]), ("<!-- x\n# a\n-->\n# b", [(1, "b")]), ("# a #b\r\n", [(1, "a #b")]), (None, []), ("", []),
    ],
)
def test_headings(markdown, wanted):
    assert [(h[0], h[6]) for h in document_headings(markdown)] == wanted


def test_offsets_are_bytes():
    h = document_headings("é\n  ## Ünder  \nx")[0]
    assert h[1:5] == (5, 8, 14, 16)


ENTRIES = "\n\nA (2001).\n\nB (1999a).\n\nC 2005.\n"


@pytest.mark.parametrize(
    ("markdown", "inferred"),
    [
        ("## A\n\nReferences" + ENTRIES, ["References"]),
        ("## References\n\nReferences" + ENTRIES, []),
        ("References\n\nA (2001).\n", []),
        ("References" + ENTRIES + "Works cited:" + ENTRIES, ["Works cited:"]),
        ("## References and notes\n\n7. Bibliography" + ENTRIES, ["7. Bibliography"]),
    ],
)
def test_inferred_references(markdown, inferred):
    assert [h[6] for h in document_headings(markdown) if h[5]] == inferred


def nodes(spark, markdown):
    return segmentation.segment(spark.createDataFrame([(1, markdown)], "paper_id long, markdown string")).orderBy("ordinal").collect()


def test_tree_inheritance_and_title(spark):
    rows = nodes(spark, "# T\n## Results and discussion\n### Foo\n## Method\n### Foo\n#### Bar\n## Appendix A\n### Zed\n")
    assert [(r.parent_ordinal, r.role, r.method) for r in rows] == [(-1, None, "structural"), (0, None, None), (1, None, None), (0, "methodology", "rule"), (3, "methodology", "inherited"), (4, "methodology", "inherited"), (0, "Unknown", "structural"), (6, "Unknown", "inherited")]
    assert rows[0].node_kind == "document_title" and rows[1].candidate_roles == ["discussion", "results"]


@pytest.mark.parametrize(("children", "role"), [("### Methods\n### Measures\n", "methodology"), ("### Methods\n### Results\n", None), ("### Methods\n", None), ("### Methods\n### Odd\n", None), ("### Appendix A\n### Appendix B\n", None)])
def test_consensus(spark, children, role):
    assert nodes(spark, "# T\n## Foo\n" + children)[1].role == role


def test_headless_and_empty(spark):
    for markdown in ("plain", "##### deep only", "", None):
        (row,) = nodes(spark, markdown)
        assert (row.heading_level, row.role, row.status, row.end_offset) == (0, "Unknown", "resolved", len(markdown or ""))


def test_semantic_form_is_that_of_the_columns(spark):
    rng = random.Random(6)
    parts = [
        "Appendix",
        "appendices",
        " ",
        "\t",
        "A",
        "B2",
        ".",
        ":",
        "-",
        "iv.",
        "2.1",
        "section 3",
        ")",
        "Results",
        "İ",
        "Σ",
        "ΣΑΣ",
        "é",
        "\x1c",
        "\u2003",
        "\xa0",
        "References",
        "online appendix",
        "1",
        "x",
        "ß",
        "ǅ",
    ]
    given = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(3000)})
    df = spark.createDataFrame([(g,) for g in given], "h string").withColumn("c", parse_container(strip_identifiers(normalize(F.col("h")))))
    assert [(r.h, semantic_form(r.h)) for r in df.collect()] == [(r.h, r.c.remainder) for r in df.collect()]


def test_blocks_of_lines():
    text = "Discontinued\n\n| a |\n\n| b |\nx\n||\n| é |\u2003\n \t| c | \n\nplain\n| d |"
    assert [[(b["block"], b["continuation"], [x["place"] for x in b["lines"]], [x["place"] for x in b["above"]]) for b in t] for t in table_blocks(text)] == [
        [(1, True, [2], [0]), (2, True, [4], [0, 2])], [(3, False, [7, 8], [4, 5, 6])], [(4, False, [11], [7, 8, 10])],
    ]
    assert [x["stop"] for t in table_blocks(text) for b in t for x in b["lines"]][-1] == len(text.encode())
    assert table_blocks(None) == table_blocks("a | b") == [[]] and images(None) == images("![]") == []
    assert [[n["place"] for n in i["near"]] for i in images("a\n![x](u)\nb")] == [[2, 0]]


def test_violations_of_moved_offsets_and_lost_nodes(spark):
    papers = spark.createDataFrame([(1, "## A\né\n## B\nx"), (2, "## A\n## B\n"), (3, "plain")], "paper_id long, markdown string")
    nodes = segmentation.segment(papers)
    assert segmentation.violations(nodes, papers).count() == 0
    moved = F.when((F.col("paper_id") == 1) & (F.col("ordinal") == 0), 6).otherwise(F.col("start_offset"))
    kept = nodes.withColumn("start_offset", moved).filter("not (paper_id = 2 and ordinal = 1) and paper_id <> 3")
    assert sorted(map(tuple, segmentation.violations(kept, papers).collect())) == [(1, 0, "inside_character"), (2, -1, "node_count"), (3, -1, "node_count")]


def test_no_papers(spark):
    empty = spark.createDataFrame([], "paper_id long, markdown string")
    assert segmentation.segment(empty).count() == methodology.methodology(empty).count() == exhibits.tables(empty).count() == 0


def test_table_forms(spark):
    markdown = "Table 1.\n\nMeans of all\n\n| a | $b$ |\n|---|---|\n| 1 | 2 |\n\n(continued)\n| 3 | 4 |\n\n# Head\n\n| Table A2 | |\n| x | y | z |\n"
    rows = exhibits.tables(spark.createDataFrame([(1, markdown)], "paper_id long, markdown string")).orderBy("table_number").collect()
    assert [(r.label, r.caption, r.caption_source, r.header, r.rows, r.has_latex, r.column_count) for r in rows] == [
        ("1", "Means of all", "above", ["a", "$b$"], [["1", "2"], ["3", "4"]], True, 2), (
            "A2",
            "",
            "first_cell",
            None,
            [["x", "y", "z"]],
            False,
            3,
        )
    ]
    assert [(c.start, c.end) for c in rows[0].continuation_offsets] == [(markdown.index("| 3"), markdown.index("\n# Head"))]


def test_studies(spark):
    papers = spark.createDataFrame(
        [
            (1, "## Study 1\n## Study 2A\n## Study 2B\n"),
            (2, "## Phase 1\n## Wave 2\n"),
            (3, "## A\nStudy 1 and study 2 of others\n"),
            (4, "## A\nIn Study 1.\n"),
            (5, "## Study 1\nthen Study 2\n"),
        ],
        "paper_id long, markdown string",
    )
    found = {r.paper_id: (r.verdict, r.study_count, r.labels, r.split_groups) for r in research_units.study_gate(papers).collect()}
    assert found == {1: ("multi", 2, "1, 2", False), 2: ("uncertain", 0, "1, 2", False), 3: ("uncertain", 0, "1, 2", False), 4: ("single", 0, "", False), 5: ("single", 1, "", True)}


VALID = {
    "primary_type": "A",
    "subtype": None,
    "secondary_type": None,
    "decision_rule": 2,
    "confidence": "high",
    "evidence": [{"quote": "a b", "signals": "s"}, {"quote": "c", "signals": "s"}],
    "counter_evidence": None,
}


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, None), ({"primary_type": "E"}, "unknown primary_type"), ({"decision_rule": 6}, "decision_rule out of range"), ({"confidence": "sure"}, "unknown confidence"), ({"primary_type": "B"}, "subtype missing"), (
            {"subtype": "meta_analysis"},
            "subtype not allowed",
        ),
        ({"primary_type": "B", "subtype": "odd"}, "unknown subtype"), ({"primary_type": "B", "subtype": "mathematical_proof"}, "subtype of another type"), ({"secondary_type": "Q"}, "unknown secondary_type"), (
            {"secondary_type": "A"},
            "secondary_type equals primary_type",
        ),
        ({"primary_type": "UNCLASSIFIED"}, "unclassified_reason missing"), ({"unclassified_reason": "x"}, "unclassified_reason not allowed"), ({"evidence": VALID["evidence"][:1]}, "number of quotes"), (
            {"evidence": [{"quote": " "}, {"quote": "c"}]},
            "empty quote",
        ),
        ({"evidence": [{"quote": "w " * 26}, {"quote": "c"}]}, "quote too long"), ({"counter_evidence": {"quote": "", "points_to": "B"}}, "empty counter quote"), (
            {"counter_evidence": {"quote": "q", "points_to": "Z"}},
            "unknown points_to",
        ),
    ],
)
def test_contract(spark, change, error):
    verdict = {**VALID, **change}
    raw = f"<answer>\n```json\n{json.dumps(verdict)}\n```</answer><verdict> {verdict['primary_type']} </verdict>"
    assert paper_types.parse_verdicts(spark.createDataFrame([(raw,)], "raw_response string")).first().error == error


def test_broken_responses(spark):
    raws = [
        "",
        "<answer>{}</answer>",
        "<answer>{oops</answer><verdict>A</verdict>",
        "<answer>" + json.dumps(VALID) + "</answer><verdict>B</verdict>",
        None,
    ]
    rows = (
        paper_types.parse_verdicts(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw_response string"))
        .orderBy("i")
        .collect()
    )
    assert [r.error for r in rows] == ["no <answer> block", "no <verdict> block", "invalid JSON", "verdict tag differs from primary_type", "no <answer> block"]


def test_build_input(spark):
    row = spark.range(1).select(
        paper_types.build_input(F.lit("FULL"), F.array(F.lit(" A ")), F.lit("body")), paper_types.build_input(F.lit("SELECTION"), F.array().cast("array<string>"), F.lit("body")), paper_types.build_input(
            F.lit("FULL"),
            F.array().cast("array<string>"),
            F.lit(" "),
        )
    ).first()
    assert row[0] == "INPUT FORM: FULL\n\nCOMPLETE HEADING LIST (every heading in the document, in order):\n  A\n\nMANUSCRIPT:\n\nbody" and row[1] is None and row[2] is None
