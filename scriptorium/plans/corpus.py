"""A deterministic corpus of papers, written in SQL over the documents table, the same in Spark and DuckDB.

Every document becomes one paper: its whole text stands between generated headings, paragraphs, fenced and
mathematical blocks, tables, figures and references lists, chosen by arithmetic on its id. ¶ stands for a newline in
the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.session import read_table

HEADINGS = (
    "Introduction", "Methods", "Results and discussion", "Theoretical background", "Background and theoretical background", "Sample and data", "Zeta topics", "RÉSULTATS divers", "Discussion of results", "Study 1: the first wave",
    "Study 2", "Summary and conclusions", "Appendix A: robustness checks", "Appendix", "Supporting information", "Appendixation of the method", "Limitations and future research", "Data availability statement", "Phase 1", "Wave 2",
    "Abstract:", "Case findings", "Ownership", "Conclusions", "Measures", "Implications for practice", "Author contributions", "Experiment 1A", "Funding statement", "Related work", "Appendix B2. Measures", "Procedure and findings",
)
NUMBERS = ("", "", "4 ", "2.1. ", "iv. ", "Section 3: ", "b) ", "")
LEVELS = ("##", "##", "###", "###", "####", "##", "#####")
SENTENCES = (
    "A variable and two variables were entered in the regression; the coefficient and its standard error follow a t test and an ANOVA.",
    "Each interview was coded by thematic analysis, in the manner of grounded theory; a focus group and a case study followed.",
    "The mean, mean and mean again; the median and the mode have a p value.",
    "Nothing here marks a method, neither artful nor particular.",
    "A mixed method design with participant observation, ethnography and one Delphi round; Cronbach’s alpha and the correlation stood at .7.",
    "As in Study 1 and study 2A of other authors, Experiment II was run in two waves.",
    "See Study 1 below.",
)
BLOCKS = (
    "```¶# not a heading¶```¶¶",
    "$$¶# not a heading either¶$$¶¶",
    "Table 1. Means and correlations¶¶| Name | $x$ |¶|---|---|¶| a | 1 |¶¶(continued)¶| b | 2 |¶¶",
    "![](https://cdn.example/img-19.jpg?height=943&width=1067&top_left_y=354&top_left_x=468)¶Fig 3. The model¶¶",
    "| Table A2 | |¶| x | y |¶| discontinued | z |¶¶TABLE IV¶Fit of all models¶¶| m | 0.2 | 7 |¶",
    "![plot](b.png)¶¶Plain words.¶¶Figure 2¶![c](c-3.png?width=7)¶",
    "Continued¶| z | 9 |¶¶",
    "Plain.¶¶Plain again.¶¶And more.¶¶| lone | row |¶¶",
)
AGREED = "## Zeta topics¶¶### Methods¶¶One.¶¶### Measures¶¶Two.¶¶"
REFERENCES = "References¶¶Roe, A. (2001). One.¶¶Doe, B. (1999a). Two.¶¶Poe, C. 2005. Three.¶¶"


class Dialect:
    """The few places where the two engines spell things differently."""

    def __init__(self, name: str):
        self.spark = name == "spark"

    def pick(self, values: tuple[str, ...], index: str) -> str:
        own = ", ".join(f"'{v}'" for v in values)
        return f"element_at(array({own}), cast(({index}) % {len(values)} as int) + 1)" if self.spark else f"list_value({own})[({index}) % {len(values)} + 1]"

    def joined(self, count: str, each: str) -> str:
        """each, for i from 0 to count - 1, concatenated."""
        return f"array_join(transform(sequence(0L, {count} - 1), i -> {each}), '')" if self.spark else f"array_to_string(list_transform(range(0, {count}), lambda i: {each}), '')"

    def papers(self, documents: str = "documents") -> str:
        number = self.pick(NUMBERS, "doc_id + i")
        heading = f"concat({self.pick(LEVELS, 'doc_id * 3 + i * i')}, ' ', {number}, {self.pick(HEADINGS, 'doc_id * 7 + i * 13')}, '¶¶')"
        body = f"concat({self.pick(SENTENCES, 'doc_id + i * 3')}, '¶¶', case when i % 3 = 1 then {self.pick(BLOCKS, 'doc_id + i')} else '' end)"
        section = f"concat(case when doc_id % 17 = 9 then '' else {heading} end, {body}, case when i = 2 then concat(coalesce(text, ''), '¶¶') else '' end)"
        title = "case when doc_id % 17 = 9 then '' when doc_id % 11 = 3 then '# Methods¶¶' when doc_id % 5 = 0 then '' when doc_id % 13 = 5 then '# One title ##¶¶# Another¶¶' else concat('# On the matter ', cast(doc_id as varchar(20)), '¶¶') end"
        agreed = f"case when doc_id % 14 = 6 then '{AGREED}' else '' end"
        tail = f"case when doc_id % 3 = 0 then '{REFERENCES}' else '' end"
        return f"select doc_id as paper_id, replace(concat({title}, {self.joined('(3 + doc_id % 9)', section)}, {agreed}, {tail}), '¶', chr(10)) as markdown from {documents}"

    def landed(self) -> str:
        """Papers as they land: hash, url, status and times by arithmetic; documents with equal texts have equal hashes."""
        return """select doc_id as paper_id, concat('https://papers.example/', source, '/', cast(doc_id as varchar(20)), '.pdf') as url, md5(coalesce(text, '')) as hash,
            (doc_id * 7919) % 100003 as created_at, case when doc_id % 19 = 4 then 'ocr failed' end as error, doc_id % 23 <> 6 as started from documents"""

    def responses(self) -> str:
        """Raw model responses, some of them in breach of the contract; quotes come from the documents' texts."""
        clean = "replace(replace(replace(coalesce(text, ''), chr(10), ' '), '\"', ''), chr(92), '')"
        kind = self.pick(("A", "A", "B", "C", "D", "UNCLASSIFIED"), "doc_id")
        subtype = "case when doc_id % 29 = 3 then '\"meta_analysis\"' when doc_id % 6 = 2 then '\"systematic_review\"' when doc_id % 6 = 4 then '\"mathematical_proof\"' else 'null' end"
        missing = "case when doc_id % 7 = 1 then 'words that stand nowhere' else substr(clean, 30, 24) end"
        json = f"""concat('{{"primary_type": "', kind, '", "subtype": ', {subtype}, ', "secondary_type": ', case when doc_id % 10 = 3 then '"A"' else 'null' end, ', "decision_rule": ', case when doc_id % 31 = 7 then '9' else '2' end,
            ', "confidence": "', case when doc_id % 37 = 8 then 'sure' else 'high' end, '", "evidence": [{{"quote": "', substr(clean, 1, 24), '", "signals": "s"}}', case when doc_id % 41 = 9 then '' else concat(', {{"quote": "', {missing}, '", "signals": "t"}}') end,
            '], "counter_evidence": ', case when doc_id % 8 = 5 then concat('{{"quote": "', substr(clean, 5, 20), '", "points_to": "C"}}') else 'null' end, ', "unclassified_reason": ', case when kind = 'UNCLASSIFIED' then '"too short"' else 'null' end, '}}')"""
        fence = "chr(96) || chr(96) || chr(96)"
        return f"""select doc_id as paper_id, doc_id * 2 as verdict_id, (doc_id * 104729) % 1009 as created_at,
            concat('<answer>', case when doc_id % 4 = 0 then {fence} || 'json' || chr(10) else '' end, case when doc_id % 43 = 10 then '{{broken' else {json} end, case when doc_id % 4 = 0 then chr(10) || {fence} else '' end,
                '</answer>', case when doc_id % 47 = 11 then '' else concat('<verdict>', case when doc_id % 53 = 12 then 'Z' else kind end, '</verdict>') end) as raw_response
            from (select doc_id, {clean} as clean, {kind} as kind from documents) as d"""

    def decisions(self) -> str:
        """Review decisions from the event stream: each event answers a task of some paper."""
        roles = ("methodology", "results", "discussion", "introduction", "theory", "conclusion")
        paper = "cast(event_id % (select count(*) from documents) as varchar(20))"
        next_paper = "cast((event_id + 1) % (select count(*) from documents) as varchar(20))"
        return f"""select event_id as decision_id, ts, concat({paper}, '/', cast(user_id % 3 as varchar(20))) as task_id,
            case when event_id % 9 = 0 then 'reject' else 'resolve' end as decision,
            case when event_id % 9 = 0 then null when event_id % 25 = 3 then 'nonsense' else {self.pick(roles, 'event_id')} end as assigned_role,
            case when event_id % 9 = 0 then null else concat('Title ', cast(event_id as varchar(20))) end as assigned_title_text,
            case when event_id % 5 = 1 then concat({paper}, '@2.9#', cast(event_id % 4 as varchar(20)))
                when event_id % 25 = 2 then concat({next_paper}, '@2.9#0') end as assigned_title_node,
            case when event_id % 27 = 0 then ' ' when event_id % 9 = 0 then 'please add headings' end as comment,
            case when event_id % 33 = 5 then '' else concat('r', cast(user_id % 7 as varchar(20))) end as reviewer_id from events"""

    def rejections(self) -> str:
        """Objections to whole runs, one for each event; most of them say nothing and so don't count."""
        return """select event_id as rejection_id, ts, concat(cast(event_id % (select count(*) from documents) as varchar(20)), '@2.9') as run_id,
            case when event_type = (select min(event_type) from events) and event_id % 4 = 1 then 'not a paper' when event_id % 2 = 0 then ' ' end as comment,
            concat('r', cast(user_id % 5 as varchar(20))) as reviewer_id from events"""

    def requests(self) -> str:
        """Requests to use a run's decisions, or to return the run to its author: one for each event, some of them later."""
        return """select event_id as request_id, case when event_id % 3 = 0 then ts + interval '20' day else ts end as ts,
            concat(cast((event_id * 3 + 1) % (select count(*) from documents) as varchar(20)), '@2.9') as run_id,
            concat('step', cast(user_id % 3 as varchar(20))) as asked_by, case when user_id % 2 = 0 then 'return' else 'consume' end as wants from events"""

    def mentions(self) -> str:
        """Places in papers that events point to, each a byte offset; a third of them lie in one paper."""
        return """select event_id, case when event_id % 3 = 0 then 3 else event_id % (select count(*) from documents) end as paper_id,
            case when event_id % 50 = 7 then null else (event_id * 7919 + user_id) % 9000 end as position from events"""


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated relation in Spark: papers, landed, responses, decisions, rejections, requests or mentions."""
    sql = getattr(SPARK, name)()
    tables = {t: read_table(spark, sf_dir, t) for t in ("documents", "events") if f" {t}" in sql}
    for t in tables:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(escape_braces(sql, tables), **tables)


def escape_braces(sql: str, tables: dict) -> str:
    """Braces of JSON doubled, those of table names kept."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace("{{" + t + "}}", "{" + t + "}")
    return sql
