"""How many studies a paper reports, and which of its sections belong to the study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.dimensions import SCOPE
from scriptorium.functions.text import ASCII_WORD, group_of, is_heading_line, let, looked_up, normalise_kind, sort_labels, trim_blank
from scriptorium.operators.ingest import upsert
from scriptorium.operators.segmentation import bound
from scriptorium.session import ship_package
from scriptorium.sources.markdown import detect_headings
from scriptorium.sources.papers import compact, publish, published

RULE_VERSION = "1.0"
STRONG = ("study", "experiment")
#: Fixed value: how the parts of a paper's empirical work are numbered.
LABELLED = rf"(?i)(?<!{ASCII_WORD})(stud(?:y|ies)|experiments?|phases?|samples?|datasets?|data sets?|waves?|rounds?)[\t\n\f\r ]+([0-9]{{1,2}}[A-Za-z]?|[IVX]{{1,4}})(?!{ASCII_WORD})"


def scan(text: Column) -> Column:
    """Every numbered part that a text names: array of (kind, label, study_group)."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(LABELLED), F.lit(1)).alias("k"),
        F.regexp_extract_all(text, F.lit(LABELLED), F.lit(2)).alias("l"),
    )
    return F.transform(
        pairs,
        lambda p: F.struct(normalise_kind(p["k"]).alias("kind"), F.upper(p["l"]).alias("label"), group_of(F.upper(p["l"])).alias("study_group")),
    )


EVIDENCE = "ordinal:int,kind:string,label:string,study_group:string,found_in:string"
NO_EVIDENCE = f"array<struct<{EVIDENCE}>>"


def evidence_of(text: Column, ordinal: Column) -> Column:
    """The evidence that a heading or line holds, as EVIDENCE."""
    return F.transform(
        scan(text),
        lambda e: F.struct(
            ordinal.alias("ordinal"), e["kind"].alias("kind"), e["label"].alias("label"), e["study_group"].alias("study_group"),
            trim_blank(text).alias("found_in"),
        ),
    )


def groups_of(evidence: str, strong: bool) -> Column:
    own = F.filter(evidence, lambda e: e["kind"].isin(*STRONG) if strong else ~e["kind"].isin(*STRONG))
    return F.array_distinct(F.transform(own, lambda e: e["study_group"]))


def unit_evidence(papers: DataFrame) -> DataFrame:
    """One row for each paper: evidence of headings and of the text, and the groups that decide.

    All of it is found in the paper's own row. The text of a paper whose headings name several studies is not scanned.
    """
    ship_package(papers.sparkSession)
    text = F.coalesce("markdown", F.lit("")).alias("markdown")
    rows = papers.select("paper_id", text, F.filter(detect_headings(F.col("markdown")), lambda h: h["level"] <= 4).alias("headings"))
    named = F.flatten(F.transform("headings", lambda h, i: evidence_of(h["text"], i)))
    # evidence comes out of generators: whoever explodes it has a filter put on it, which would scan headings and text again
    rows = bound(rows, "in_headings", named).drop("headings")
    rows = rows.withColumns({"strong_groups": groups_of("in_headings", True), "weak_groups": groups_of("in_headings", False)})
    lines = F.filter(F.split("markdown", "\n"), lambda x: ~is_heading_line(x) & F.regexp_like(x, F.lit(LABELLED)))
    body = F.flatten(F.transform(lines, lambda x: F.filter(evidence_of(x, F.lit(-1)), lambda e: e["kind"].isin(*STRONG))))
    rows = bound(rows, "_body", F.when(F.size("strong_groups") >= 2, F.array().cast(NO_EVIDENCE)).otherwise(body)).drop("markdown")
    firsts = let(
        F.col("_body"),
        lambda all_of: F.filter(all_of, lambda e, i: ~F.exists(F.slice(all_of, F.lit(1), i), lambda b: b["study_group"] == e["study_group"])),
    )
    return rows.select("paper_id", "in_headings", firsts.alias("in_text"), "strong_groups", "weak_groups")


def study_gate(papers: DataFrame) -> DataFrame:
    """Verdict of each paper: single, multi or uncertain, with the number of studies and the labels behind it.

    split_groups flags papers whose headings name one study and whose text names another one.
    """
    rows = unit_evidence(papers).withColumn("text_groups", F.transform("in_text", lambda e: e["study_group"]))
    several = F.size("strong_groups") >= 2
    text, weak = F.size("text_groups") >= 2, F.size("weak_groups") >= 2
    deciding = F.when(several, F.col("strong_groups")).when(text, F.col("text_groups")).when(weak, F.col("weak_groups"))
    united = F.size(F.array_union("strong_groups", "text_groups"))
    return rows.select(
        "paper_id",
        F.lit(RULE_VERSION).alias("rule_version"),
        F.when(several, "multi").when(text | weak, "uncertain").otherwise("single").alias("verdict"),
        F.size("strong_groups").alias("study_count"),
        F.array_join(sort_labels(F.coalesce(deciding, F.array().cast("array<string>"))), ", ").alias("labels"),
        F.when(several, "headings").when(text, "text").when(weak, "numbered parts").otherwise("none").alias("decided_by"),
        (united > F.greatest(F.size("strong_groups"), F.size("text_groups"))).alias("split_groups"),
    )


def study_evidence(papers: DataFrame) -> DataFrame:
    """Evidence rows in order: headings first, then the first strong mention of each group in the text."""
    rows = unit_evidence(papers).select("paper_id", F.posexplode(F.concat("in_headings", "in_text")).alias("position", "e"))
    return rows.select(
        "paper_id",
        "position",
        "e.kind",
        "e.label",
        "e.study_group",
        "e.found_in",
        F.col("e.ordinal").alias("heading_ordinal"),
    )


def current_gates(log: DataFrame) -> DataFrame:
    """The gates in force of an append-only log of them, keyed by paper, markdown hash and rule version.

    log: paper_id, markdown_hash, rule_version, verdict_id, ts, verdict, study_count, evidence (an array in the gate's
    order). A later write replaces verdict, count and the whole evidence; the id is the first one's.
    """
    return upsert(log, ["paper_id", "markdown_hash", "rule_version"], "ts", ["verdict_id"], "verdict_id")


def gate_evidence(gates: DataFrame) -> DataFrame:
    """Evidence rows of the gates in force, in the gate's order."""
    return gates.select("verdict_id", F.posexplode("evidence").alias("position", "e")).select("verdict_id", "position", "e.*")


GATE = ("paper_id", "markdown_hash", "rule_version")


def write_gates(path: str, gates: DataFrame) -> str:
    """Publish gates (see `current_gates`; each key once) with their evidence; a gate that is there is replaced whole.

    Readers see a gate's old or new evidence, never both; files of other gates stay as they are.
    """
    key = F.sha2(F.concat_ws("/", *(F.col(c).cast("string") for c in GATE)), 256)
    rows = gates.withColumn("gate_id", key)
    evidence = rows.select("gate_id", F.posexplode("evidence").alias("position", "e")).select("gate_id", "position", "e.*")
    return publish(path, "gate_id", "gates", gates=rows.drop("evidence"), evidence=evidence)


def stored_gates(spark: SparkSession, path: str, relation: str = "gates") -> DataFrame:
    """The gates, or the evidence, that a store holds now."""
    return published(spark, path, relation, "gate_id", "gates")


def compact_gates(spark: SparkSession, path: str) -> str:
    """Bring a store of gates down to one batch (see `compact`)."""
    return compact(spark, path, "gate_id", "gates", "evidence")


def scope_of(role: Column) -> Column:
    return F.coalesce(looked_up(role, SCOPE), F.lit("undetermined"))


def section_scope(nodes: DataFrame) -> DataFrame:
    """Scope of every section, the title included; sections of the study or of both belong to unit RU1."""
    rows = nodes.select("paper_id", "ordinal", "heading_raw", "role", scope_of(F.col("role")).alias("scope"))
    return rows.withColumn("unit_ref", F.when(F.col("scope").isin("study", "both"), "RU1"))


def scope_summary(nodes: DataFrame) -> DataFrame:
    return section_scope(nodes).groupBy("paper_id", "scope").agg(F.count(F.lit(1)).alias("sections"))


def research_units(gates: DataFrame) -> DataFrame:
    """The one unit of each paper that reports a single study."""
    return gates.filter("verdict = 'single'").select(
        "paper_id",
        F.lit("study").alias("unit_type"),
        F.lit(1).alias("unit_index"),
        F.lit("RU1").alias("unit_ref"),
        F.lit("Study 1").alias("label"),
        F.lit("accepted_single_study").alias("status"),
    )
