"""Registered queries over the generated corpus: one or more for each operator family."""

from __future__ import annotations

from functools import cached_property, reduce
from hashlib import md5
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions.text import contains_whole_word, excerpt, normalise_quote, normalize, parse_container, strip_identifiers
from scriptorium.operators import asof, exhibits, ingest, methodology, paper_types, research_units, review, segmentation
from scriptorium.operators import run_metrics as metering
from scriptorium.plans.corpus import relation
from scriptorium.plans.registry import query
from scriptorium.session import discard, materialise, read_table, written_root
from scriptorium.sources import lookup, versions
from scriptorium.sources.buckets import write_bucketed
from scriptorium.sources.papers import publish_runs, published
from scriptorium.streaming import landing


def papers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "papers")


def joined(c: str):
    return F.array_join(c, "|").alias(c)


def trees_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.paper_trees(papers_of(spark, sf_dir))


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.section_nodes(trees_of(spark, sf_dir))


# -- methodology ------------------------------------------------------------------------------------------------------


@query
def methodology_class(spark, sf_dir):
    return methodology.methodology(papers_of(spark, sf_dir))


@query
def methodology_terms(spark, sf_dir):
    return methodology.methodology_terms(papers_of(spark, sf_dir))


@query
def methodology_summary(spark, sf_dir):
    rows = methodology.methodology(papers_of(spark, sf_dir))
    return rows.groupBy(F.coalesce("methodology_class", F.lit("unresolved")).alias("methodology_class"), "mixed_flag").agg(
        F.count(F.lit(1)).alias("papers"),
        F.sum("total_occurrences").alias("occurrences"),
    )


# -- headings and scalars ---------------------------------------------------------------------------------------------


def _headings(spark, sf_dir):
    return segmentation.paper_headings(papers_of(spark, sf_dir))


@query
def detect_headings(spark, sf_dir):
    rows = _headings(spark, sf_dir).select("paper_id", F.explode("headings").alias("h"))
    return rows.select("paper_id", "h.level", "h.byte_start", "h.text_start", "h.text_stop", "h.span_start", "h.inferred", "h.text")


@query
def infer_references(spark, sf_dir):
    return detect_headings.plain(spark, sf_dir).filter("inferred").select("paper_id", "level", "byte_start", "text")


@query
def heading_counts(spark, sf_dir):
    return segmentation.heading_counts(_headings(spark, sf_dir))


def _texts(spark, sf_dir):
    return _headings(spark, sf_dir).select(F.explode("headings.text").alias("heading_raw")).distinct()


@query
def normalize_headings(spark, sf_dir):
    return _texts(spark, sf_dir).select("heading_raw", normalize(F.col("heading_raw")).alias("heading_normalized"))


@query
def strip_identifier(spark, sf_dir):
    return _texts(spark, sf_dir).select("heading_raw", strip_identifiers(normalize(F.col("heading_raw"))).alias("stripped"))


@query
def container_parse(spark, sf_dir):
    return (
        _texts(spark, sf_dir)
        .select("heading_raw", parse_container(strip_identifiers(normalize(F.col("heading_raw")))).alias("c"))
        .select("heading_raw", "c.container", "c.label", "c.remainder")
    )


def _matches(spark, sf_dir):
    rows = segmentation.heading_nodes(_headings(spark, sf_dir)).filter("structural_container is null")
    return (
        rows.select("paper_id", "ordinal", F.explode_outer("matches").alias("m"))
        .filter("m is not null")
        .select(
            "paper_id",
            "ordinal",
            "m.keyword",
            "m.role",
            F.col("m.start").alias("match_start"),
            F.col("m.end").alias("match_end"),
            "m.suppressed_by",
        )
    )


@query
def keyword_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


@query
def nested_suppression(spark, sf_dir):
    return (
        _matches(spark, sf_dir)
        .filter("suppressed_by is not null")
        .groupBy("keyword", "suppressed_by")
        .agg(F.count(F.lit(1)).alias("times"))
    )


@query
def heading_roles(spark, sf_dir):
    rows = segmentation.heading_nodes(_headings(spark, sf_dir))
    return rows.select(
        "paper_id",
        "ordinal",
        "semantic_heading",
        "role",
        "content_class",
        "status",
        "method",
        joined("candidate_roles"),
        joined("matched_keywords"),
    )


# -- the section tree -------------------------------------------------------------------------------------------------


@query
def section_nodes(spark, sf_dir):
    return nodes_of(spark, sf_dir).select(
        "paper_id", "ordinal", "parent_ordinal", "heading_level", "heading_source", "node_kind", "heading_raw", "semantic_heading", "structural_container", "appendix_label", "start_offset", "end_offset",
        "role", "content_class", "status", "method", joined("candidate_roles"), joined("matched_keywords"),
    )


@query
def parent_links(spark, sf_dir):
    return nodes_of(spark, sf_dir).select("paper_id", "ordinal", "parent_ordinal")


@query
def section_spans(spark, sf_dir):
    rows = segmentation.section_texts(papers_of(spark, sf_dir))
    return rows.select("paper_id", "ordinal", "start_offset", "end_offset", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def inherit_down(spark, sf_dir):
    return nodes_of(spark, sf_dir).filter("method = 'inherited'").select("paper_id", "ordinal", "role", "content_class")


@query
def child_consensus(spark, sf_dir):
    return nodes_of(spark, sf_dir).filter("method = 'child_consensus'").select("paper_id", "ordinal", "role", "content_class")


@query
def content_class_rollup(spark, sf_dir):
    rows = (
        nodes_of(spark, sf_dir)
        .groupBy("content_class", "role", "method")
        .agg(F.count(F.lit(1)).alias("sections"), F.sum(F.col("end_offset") - F.col("start_offset")).alias("bytes"))
    )
    return rows


@query
def headless_papers(spark, sf_dir):
    return nodes_of(spark, sf_dir).filter("heading_level = 0").select("paper_id", "heading_level", "end_offset", "role")


@query
def segmentation_runs(spark, sf_dir):
    runs = segmentation.segmentation_runs(trees_of(spark, sf_dir))
    return runs.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in ("supported_levels", "embedded_levels")})


@query
def published_runs(spark, sf_dir):
    """All runs and their nodes published at once; every third paper's again without its last node; then a batch that fails."""
    trees = materialise(trees_of(spark, sf_dir), "trees")
    runs = segmentation.segmentation_runs(trees).select("run_id", "paper_id", "markdown_hash", F.lit(1).alias("version"))
    nodes = segmentation.section_nodes(trees).select(segmentation.run_id().alias("run_id"), "paper_id", "ordinal", "heading_raw", "role")
    path = f"{written_root(spark)}/published-{uuid4().hex}"
    publish_runs(path, runs=runs, nodes=nodes)
    last = nodes.groupBy("run_id").agg(F.max("ordinal").alias("_last"))
    third = F.col("paper_id") % 3 == 0
    publish_runs(path, runs=runs.filter(third).withColumn("version", F.lit(2)), nodes=nodes.filter(third).join(last, "run_id").filter("ordinal < _last").drop("_last"))
    broken = F.when(F.col("paper_id") >= 0, F.raise_error(F.lit("stopped halfway"))).otherwise(F.lit(""))
    try:
        publish_runs(path, runs=runs.withColumn("version", F.lit(3)), nodes=nodes.withColumn("heading_raw", broken))
    except Exception as e:
        if "stopped halfway" not in str(e):
            raise
    counted = published(spark, path, "nodes").groupBy("run_id").agg(F.count(F.lit(1)).alias("nodes"), F.count("role").alias("resolved"))
    return published(spark, path).join(counted, "run_id", "left").fillna(0, ["nodes", "resolved"])


@query
def title_identification(spark, sf_dir):
    return segmentation.segmentation_runs(trees_of(spark, sf_dir)).select(
        "paper_id",
        "title_ordinal",
        "title_status",
        "title_method",
        "title_text",
        "title_candidate_ordinal",
    )


INVARIANT = ["paper_id", "ordinal", "heading_level", "parent_ordinal", "start_offset", "end_offset"]


@query
def invariant_violations(spark, sf_dir):
    """Breaches found among nodes of which every paper's third one has been damaged."""
    papers = papers_of(spark, sf_dir)
    nodes = segmentation.segment(papers).select(*INVARIANT)
    third = F.col("ordinal") == 2
    parent = F.when(third, 5).otherwise(F.col("parent_ordinal"))
    end = F.when(third & (F.col("paper_id") % 2 == 0), -1).otherwise(F.col("end_offset"))
    return segmentation.violations(nodes.withColumns({"parent_ordinal": parent, "end_offset": end}), papers)


@query
def lost_nodes(spark, sf_dir):
    """Breaches found where the last node of a paper has been lost, or all of them, or an offset has been moved."""
    papers = papers_of(spark, sf_dir)
    nodes = segmentation.segment(papers).select(*INVARIANT)
    last = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("ordinal")))
    lost = nodes.withColumn("_place", last).filter("not (_place = 1 and paper_id % 5 in (1, 2)) and paper_id % 7 <> 3")
    moved = F.when((F.col("paper_id") % 5 == 3) & (F.col("ordinal") == 1), F.col("start_offset") + 3).otherwise(F.col("start_offset"))
    return segmentation.violations(lost.withColumn("start_offset", moved).drop("_place"), papers)


# -- review -----------------------------------------------------------------------------------------------------------


class Review:
    """The relations of the review workflow, each derived at most once for a query, and only if it is asked for."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def trees(self):
        return materialise(trees_of(self.spark, self.sf_dir), "trees")

    @cached_property
    def nodes(self):
        return segmentation.section_nodes(self.trees)

    @cached_property
    def runs(self):
        return segmentation.segmentation_runs(self.trees)

    @cached_property
    def run_ids(self):
        """The ids of all runs: one for each paper, whatever its text, so no text is scanned for them."""
        return papers_of(self.spark, self.sf_dir).select(segmentation.run_id().alias("run_id"))

    @cached_property
    def tasks(self):
        return segmentation.review_tasks(self.trees)

    @cached_property
    def log(self):
        nodes = self.nodes.select(segmentation.node_id(F.col("ordinal")).alias("node_id"), segmentation.run_id().alias("run_id"))
        return review.decision_errors(relation(self.spark, self.sf_dir, "decisions"), self.tasks, nodes)

    @cached_property
    def valid(self):
        rows = self.log.filter("error is null").drop("error", "review_reason")
        return materialise(rows.join(self.tasks.select("task_id", "run_id"), "task_id"), "valid")

    @cached_property
    def rejections(self):
        return review.valid_rejections(relation(self.spark, self.sf_dir, "rejections"), self.run_ids)

    @cached_property
    def replayed(self):
        requests = relation(self.spark, self.sf_dir, "requests")
        return materialise(review.replay(self.runs, self.tasks, self.valid, self.rejections, requests), "replayed")

    @cached_property
    def frozen(self):
        return review.freezes(self.replayed)

    @cached_property
    def decisions(self):
        return review.latest_decisions(self.valid, self.frozen)

    @cached_property
    def gate(self):
        return review.gate(self.runs, self.tasks, self.decisions, self.rejections)


@query
def review_tasks(spark, sf_dir):
    tasks = segmentation.review_tasks(trees_of(spark, sf_dir))
    return tasks.select(
        "run_id",
        "task_ordinal",
        "task_id",
        "section_ordinal",
        "review_reason",
        joined("candidate_roles"),
        joined("matched_keywords"),
    )


@query
def decision_validation(spark, sf_dir):
    return Review(spark, sf_dir).log.select("decision_id", "task_id", F.coalesce("error", F.lit("valid")).alias("outcome"))


@query
def latest_decision(spark, sf_dir):
    return Review(spark, sf_dir).decisions.select("task_id", "decision_id", "decision", "assigned_role", "reviewer_id")


@query
def effective_roles(spark, sf_dir):
    r = Review(spark, sf_dir)
    return review.effective_roles(r.nodes, r.tasks, r.decisions)


@query
def effective_titles(spark, sf_dir):
    r = Review(spark, sf_dir)
    return review.effective_titles(r.runs, r.tasks, r.decisions)


@query
def effective_view(spark, sf_dir):
    r = Review(spark, sf_dir)
    return review.effective_view(r.nodes, r.runs, r.tasks, r.decisions, r.rejections)


@query
def gate_state(spark, sf_dir):
    return Review(spark, sf_dir).gate


@query
def consumed_runs(spark, sf_dir):
    return review.consumed_runs(Review(spark, sf_dir).frozen)


@query
def request_outcomes(spark, sf_dir):
    """What came of each request to consume or return a run, and the gate that it met."""
    rows = Review(spark, sf_dir).replayed.filter(F.col("kind").isin("consume", "return"))
    return rows.select(F.col("id").alias("request_id"), "run_id", "kind", "open", "rejected", "run_rejected", "state", "outcome")


@query
def freeze_check(spark, sf_dir):
    """Decisions made after their run was frozen are refused."""
    r = Review(spark, sf_dir)
    late = review.frozen_out(relation(spark, sf_dir, "decisions"), r.tasks, r.frozen)
    return late.select("decision_id", "task_id", "run_id", "refused")


@query
def run_superseded(spark, sf_dir):
    r = Review(spark, sf_dir)
    return review.superseded_runs(r.runs, r.rejections).select("run_id", "superseded_at")


def _returned(r, rejections=None):
    return review.author_return(r.runs, r.trees, r.tasks, r.decisions, r.rejections if rejections is None else rejections)


@query
def author_return(spark, sf_dir):
    return _returned(Review(spark, sf_dir)).select(
        "run_id",
        "position",
        "task_id",
        "review_reason",
        "heading_raw",
        joined("ancestors"),
        "comment",
    )


@query
def return_snapshot(spark, sf_dir):
    """Reports of the runs whose return was granted."""
    r = Review(spark, sf_dir)
    found = review.return_snapshot(_returned(r, review.rejections_by(r.rejections, r.frozen)), r.frozen)
    return found.select(
        "return_id",
        "run_id",
        "returned_by",
        "consumed_at",
        "position",
        "review_reason",
        "heading_raw",
        joined("ancestors"),
        "comment",
    )


@query
def review_run(spark, sf_dir):
    """Open questions with context and text; every seventh paper's markdown has changed since its run."""
    r = Review(spark, sf_dir)
    changed = F.when(F.col("paper_id") % 7 == 2, F.concat("markdown", F.lit("x"))).otherwise(F.col("markdown"))
    papers = papers_of(spark, sf_dir).withColumn("markdown", changed)
    rows = review.review_items(r.tasks, r.decisions, r.trees, r.runs, papers)
    text = F.md5(F.col("text").cast("binary")).alias("text_md5")
    return rows.select("run_id", "task_id", "review_reason", "decision", "heading_raw", joined("ancestors"), text)


@query
def run_rejection_first(spark, sf_dir):
    r = Review(spark, sf_dir)
    return review.first_rejections(r.rejections).select("run_id", "rejection_id", "reviewer_id")


@query
def review_context(spark, sf_dir):
    return segmentation.review_context(trees_of(spark, sf_dir)).select(
        "paper_id",
        "ordinal",
        "heading_raw",
        joined("ancestors"),
        "start_offset",
        "end_offset",
    )


@query
def assignable_roles(spark, sf_dir):
    r = Review(spark, sf_dir)
    return review.assignable_roles(r.tasks, r.decisions)


# -- research units ---------------------------------------------------------------------------------------------------


@query
def study_gate(spark, sf_dir):
    return research_units.study_gate(papers_of(spark, sf_dir))


@query
def study_evidence(spark, sf_dir):
    rows = research_units.study_evidence(papers_of(spark, sf_dir))
    counted = rows.groupBy("kind", "label", "study_group", F.col("heading_ordinal") >= 0).count()
    return counted.toDF("kind", "label", "study_group", "in_heading", "times")


def _gate_writes(spark, sf_dir, markdown_hash=None):
    """Gates written once with the headings' evidence, and again for every third paper, with all evidence; and the
    written table of evidence that both read, for each write would scan all papers again."""
    papers = papers_of(spark, sf_dir)
    rows = research_units.unit_evidence(papers)
    if markdown_hash is not None:
        rows = rows.join(papers.select("paper_id", markdown_hash.alias("_hash")), "paper_id")
    rows = materialise(rows.drop("weak_groups"), "evidence")
    whole = F.concat("in_headings", "in_text")
    key = ["paper_id", (F.lit("h") if markdown_hash is None else F.col("_hash")).alias("markdown_hash"), F.lit(research_units.RULE_VERSION).alias("rule_version")]
    kind = F.when(F.size("strong_groups") >= 2, "multi").otherwise("other").alias("verdict")
    studies = F.size("strong_groups").alias("study_count")
    first = rows.select(
        *key,
        (F.col("paper_id") * 2).alias("verdict_id"),
        F.lit(1).alias("ts"),
        F.lit("draft").alias("verdict"),
        studies,
        F.col("in_headings").alias("evidence"),
    )
    again = rows.filter("paper_id % 3 = 0").select(
        *key,
        (F.col("paper_id") * 2 + 1).alias("verdict_id"),
        F.lit(2).alias("ts"),
        kind,
        studies,
        whole.alias("evidence"),
    )
    return first, again, rows


@query
def gate_upsert(spark, sf_dir):
    """Gates in force of a log of both writes."""
    first, again, _ = _gate_writes(spark, sf_dir)
    gates = research_units.current_gates(first.union(again))
    shown = gates.select("paper_id", "verdict_id", "verdict", "study_count")
    evidence = research_units.gate_evidence(gates).select("verdict_id", "position", "kind", "label")
    return shown.join(evidence, "verdict_id", "left")


@query
def gate_store(spark, sf_dir):
    """Gates and evidence of a store after both writes, a third that fails, and compaction."""
    first, again, written = _gate_writes(spark, sf_dir, ingest.markdown_hash(F.col("markdown")))
    path = f"{written_root(spark)}/gates-{uuid4().hex}"
    research_units.write_gates(path, first)
    research_units.write_gates(path, again)
    broken = F.when(F.col("paper_id") >= 0, F.raise_error(F.lit("stopped halfway"))).otherwise(F.lit(""))
    try:
        research_units.write_gates(path, first.withColumn("verdict", broken))
    except Exception as e:
        if "stopped halfway" not in str(e):
            raise
    discard(written)
    research_units.compact_gates(spark, path)
    evidence = research_units.stored_gates(spark, path, "evidence").select("gate_id", "position", "kind", "label")
    gates = research_units.stored_gates(spark, path).select("gate_id", "paper_id", "markdown_hash", "verdict", "study_count")
    return gates.join(evidence, "gate_id", "left").drop("gate_id")


@query
def research_unit_rows(spark, sf_dir):
    return research_units.research_units(research_units.study_gate(papers_of(spark, sf_dir)))


@query
def section_scope(spark, sf_dir):
    return research_units.section_scope(nodes_of(spark, sf_dir)).select("paper_id", "ordinal", "role", "scope", "unit_ref")


@query
def scope_summary(spark, sf_dir):
    return research_units.scope_summary(nodes_of(spark, sf_dir))


# -- paper types ------------------------------------------------------------------------------------------------------


@query
def verdict_contract(spark, sf_dir):
    return paper_types.parse_verdicts(relation(spark, sf_dir, "responses")).select(
        "paper_id",
        F.coalesce("error", F.lit("valid")).alias("outcome"),
    )


def _verified(spark, sf_dir):
    return paper_types.route(paper_types.verify_verdicts(relation(spark, sf_dir, "responses"), papers_of(spark, sf_dir)))


@query
def quote_verification(spark, sf_dir):
    return _verified(spark, sf_dir).select("paper_id", "quotes_expected", "quotes_verified", "counter_verified", "all_verified")


def bucketed(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """df as a bucketed table of this application, in at least as many buckets as shuffles have partitions."""
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    unique = f"{name}_{uuid4().hex}"
    return write_bucketed(df, unique, f"{written_root(spark)}/{unique}", buckets)


@query
def bucketed_quotes(spark, sf_dir):
    """Quotes verified against papers in buckets: the responses go to them, the texts stay where they lie."""
    papers = bucketed(spark, "papers", papers_of(spark, sf_dir).select("paper_id", "markdown"))
    rows = paper_types.verify_verdicts(relation(spark, sf_dir, "responses"), papers)
    return rows.select("paper_id", "quotes_expected", "quotes_verified", "counter_verified", "all_verified")


@query
def paper_routing(spark, sf_dir):
    return _verified(spark, sf_dir).select("paper_id", F.col("verdict.primary_type").alias("primary_type"), "empirical", "route", "reason")


@query
def latest_verdict(spark, sf_dir):
    """The latest verdict of each paper as its markdown is; responses are folded onto few papers, so that many meet."""
    hashes = papers_of(spark, sf_dir).select("paper_id", ingest.markdown_hash(F.col("markdown")).alias("markdown_hash"))
    log = relation(spark, sf_dir, "responses").select("verdict_id", "created_at", (F.col("paper_id") % 97).alias("paper_id"))
    return paper_types.latest_verdicts(log.join(hashes, "paper_id"))


@query
def verdict_work_queue(spark, sf_dir):
    """Papers that no valid verdict covers as they are now; every seventh paper's markdown has changed since its verdict."""
    verdicts = paper_types.parse_verdicts(relation(spark, sf_dir, "responses")).filter("error is null")
    papers = papers_of(spark, sf_dir)
    judged = papers.select("paper_id", ingest.markdown_hash(F.col("markdown")).alias("markdown_hash")).join(verdicts.select("paper_id", "verdict_id", "created_at"), "paper_id")
    changed = F.when(F.col("paper_id") % 7 == 2, F.concat("markdown", F.lit("x"))).otherwise(F.col("markdown"))
    now = papers.select("paper_id", ingest.markdown_hash(changed).alias("markdown_hash"))
    return paper_types.work_queue(now, paper_types.latest_verdicts(judged))


@query
def model_input(spark, sf_dir):
    rows = papers_of(spark, sf_dir).select("paper_id", "markdown", segmentation.detect_headings(F.col("markdown")).alias("headings"))
    form = F.when(F.col("paper_id") % 2 == 0, "FULL").otherwise("SELECTION")
    return rows.select(
        "paper_id",
        F.md5(paper_types.build_input(form, F.col("headings.text"), F.col("markdown")).cast("binary")).alias("input_md5"),
    )


# -- ingest -----------------------------------------------------------------------------------------------------------


def _landed(spark, sf_dir):
    return relation(spark, sf_dir, "landed").join(
        papers_of(spark, sf_dir).withColumn("markdown", F.when(F.col("paper_id") % 29 != 7, F.col("markdown"))),
        "paper_id",
    )


@query
def pdf_dedupe(spark, sf_dir):
    return ingest.dedupe(relation(spark, sf_dir, "landed")).select("paper_id", "hash", "created_at")


@query
def markdown_hash(spark, sf_dir):
    return papers_of(spark, sf_dir).select("paper_id", ingest.markdown_hash(F.col("markdown")).alias("markdown_hash"))


@query
def paper_lifecycle(spark, sf_dir):
    return ingest.lifecycle(_landed(spark, sf_dir)).select("paper_id", "status", "title", "markdown_hash")


@query
def approved_source(spark, sf_dir):
    papers = ingest.lifecycle(_landed(spark, sf_dir)).withColumn(
        "markdown_hash",
        F.when(F.col("paper_id") % 7 == 2, "").when(F.col("paper_id") % 7 == 3, "stale").otherwise(F.col("markdown_hash")),
    )
    return ingest.approved(papers).select("paper_id", "refusal", "computed_hash")


@query
def paper_list(spark, sf_dir):
    return ingest.paper_list(ingest.lifecycle(_landed(spark, sf_dir))).select("paper_id", "url", "status", "created_at")


@query
def paper_upsert(spark, sf_dir):
    log = read_table(spark, sf_dir, "events").select(
        (F.col("user_id") % 200).alias("paper_id"),
        F.col("event_type").alias("status"),
        F.col("ts").alias("created_at"),
        "event_id",
        F.col("event_id").alias("first_event"),
    )
    return ingest.upsert(log, ["paper_id"], "created_at", ["created_at", "first_event"], "event_id").select(
        "paper_id",
        "status",
        "first_event",
        "event_id",
    )


@query
def insert_if_absent(spark, sf_dir):
    log = read_table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("paper_id"), "event_type", "ts", "event_id")
    return ingest.insert_if_absent(log, ["paper_id"], "ts", "event_id").select("paper_id", "event_type", "event_id")


@query
def latency_histogram(spark, sf_dir):
    return ingest.latency_histogram(read_table(spark, sf_dir, "events"), "value", ["event_type"]).withColumn("sum", F.round("sum", 4))


@query
def metrics_exposition(spark, sf_dir):
    """Lines of a counter, a gauge and a histogram over the events."""
    events = read_table(spark, sf_dir, "events")
    own = ["event_type"]
    counted = ingest.metric_lines(ingest.counters(events, own), "events_total", own)
    latest = ingest.gauges(events, own, "user_id", "ts", "event_id")
    sums = events.groupBy(*own).agg(F.sum(F.col("value").cast("decimal(18, 2)")).alias("sum"))  # exact, whatever the order
    timed = ingest.latency_histogram(events, "value", own).drop("sum").join(sums, own)
    lines = counted.unionByName(ingest.metric_lines(latest, "last_user", own))
    return lines.unionByName(ingest.metric_lines(timed, "event_seconds", own, ingest.LATENCY_BOUNDS))


@query
def run_metrics(spark, sf_dir):
    """Rows and endings of two runs of the engine, merged: three steps each, and one that fails in the second."""
    root = f"{written_root(spark)}/metered-{uuid4().hex}"
    for i in range(2):
        with metering.RunMetrics(spark, f"{root}/log") as run:
            trees = run.write("trees", trees_of(spark, sf_dir), f"{root}/trees{i}")
            run.write("nodes", segmentation.section_nodes(trees), f"{root}/nodes{i}")
            run.write("tasks", segmentation.review_tasks(trees), f"{root}/tasks{i}")
            if i == 1:
                broken = F.when(F.col("paper_id") >= 0, F.raise_error(F.lit("stopped halfway"))).otherwise(F.lit(""))
                try:
                    run.write("broken", trees.select(broken.alias("x")), f"{root}/broken")
                except Exception as e:
                    if "stopped halfway" not in str(e):
                        raise
    lines = [df for name, _, _, df in metering.run_lines(metering.logged(spark, f"{root}/log")) if name != "step_seconds"]
    return reduce(DataFrame.union, lines)


@query
def paper_lookup(spark, sf_dir):
    """A paper by its id and another by its hash."""
    landed = relation(spark, sf_dir, "landed")
    empty = md5(b"").hexdigest()
    found = [("id", ingest.paper_by_id(landed, 7)), ("hash", ingest.paper_by_hash(landed, empty))]
    return reduce(DataFrame.union, (df.select(F.lit(how).alias("found_by"), "paper_id", "hash") for how, df in found))


@query
def content_hashes(spark, sf_dir):
    """MD5 of content, here of the documents' bytes."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", ingest.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query
def whole_words(spark, sf_dir):
    """Headings that hold a word as a whole, and excerpts of them."""
    texts = _texts(spark, sf_dir)
    low = F.lower("heading_raw")
    words = [contains_whole_word(low, F.lit(w)).alias(f"has_{w}") for w in ("study", "data", "results", "a")]
    return texts.select("heading_raw", *words, excerpt(F.col("heading_raw"), 12).alias("excerpt"))


#: Identifiers that look like numerals but are words too; the roman pattern takes them all the same.
IDENTIFIED = (
    "civil. liberties",
    "mix) methods",
    "c. x",
    "iv) results",
    "2.1. design",
    "section 4b: data",
    "a) aims",
    "section 3: 2. b) all",
    "viii. 3 x",
    "no identifier",
)


@query
def identifier_vectors(spark, sf_dir):
    """Identified headings, one for each document, with its source behind them."""
    own = F.get(F.array(*map(F.lit, IDENTIFIED)), (F.col("doc_id") % len(IDENTIFIED)).cast("int"))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", own, F.lower("source")).alias("heading"))
    return rows.select("doc_id", "heading", strip_identifiers(F.col("heading")).alias("stripped"))


@query
def quote_folding(spark, sf_dir):
    return papers_of(spark, sf_dir).select("paper_id", F.md5(normalise_quote(F.col("markdown")).cast("binary")).alias("folded_md5"))


# -- exhibits ---------------------------------------------------------------------------------------------------------


@query
def pipe_blocks(spark, sf_dir):
    return exhibits.pipe_blocks(papers_of(spark, sf_dir)).select(
        "paper_id",
        "first_place",
        F.size("lines").alias("rows_in_block"),
        "continuation",
    )


@query
def pipe_rows(spark, sf_dir):
    return exhibits.pipe_rows(papers_of(spark, sf_dir))


@query
def table_captions(spark, sf_dir):
    rows = exhibits.tables(papers_of(spark, sf_dir))
    return rows.select(
        "paper_id",
        "kind",
        "label",
        "caption",
        "caption_source",
        F.size("rows").alias("n_rows"),
        "column_count",
        "has_latex",
        F.col("header").isNotNull().alias("has_header"),
        F.size("continuation_offsets").alias("continuations"),
        "start_offset",
        "end_offset",
    )


@query
def table_cells(spark, sf_dir):
    rows = exhibits.tables(papers_of(spark, sf_dir)).select("label", F.explode("rows").alias("cells"))
    return (
        rows.select(F.coalesce("label", F.lit("")).alias("label"), F.array_join("cells", "|").alias("cells"))
        .groupBy("label", "cells")
        .agg(F.count(F.lit(1)).alias("times"))
    )


@query
def figures(spark, sf_dir):
    return exhibits.figures(papers_of(spark, sf_dir))


@query
def dropped_blocks(spark, sf_dir):
    return exhibits.dropped_blocks(papers_of(spark, sf_dir))


@query
def section_asof(spark, sf_dir):
    return segmentation.tables_in_sections(papers_of(spark, sf_dir)).select("paper_id", "label", "start_offset", "section")


@query
def offsets_asof(spark, sf_dir):
    """The section that each place of another table stands in."""
    return asof.sections_at(relation(spark, sf_dir, "mentions"), nodes_of(spark, sf_dir))


# -- stores -----------------------------------------------------------------------------------------------------------


@query
def landed_batches(spark, sf_dir):
    """Which paper each arrival became: three batches of a stream that is stopped after each; the third holds the first once more."""
    landed = relation(spark, sf_dir, "landed").select("paper_id", "hash", "created_at")
    root = f"{written_root(spark)}/landing-{uuid4().hex}"
    repeats = landed.filter("paper_id % 3 = 0").withColumns({"paper_id": -F.col("paper_id") - 1, "created_at": F.lit(-1).cast("long")})
    batches = [landed.filter("paper_id % 3 = 0"), landed.filter("paper_id % 3 = 1"), landed.filter("paper_id % 3 = 2").union(repeats)]
    for number, batch in enumerate(batches):
        batch.write.parquet(f"{root}/arrivals/part{number}")
        arriving = spark.readStream.schema(batch.schema).parquet(f"{root}/arrivals/*")
        landing.land(arriving, f"{root}/papers", f"{root}/checkpoint").awaitTermination()
    arrivals = spark.read.parquet(f"{root}/arrivals/*")
    return landing.resolved(arrivals, landing.landed_papers(spark, f"{root}/papers")).select("paper_id", "hash", "kept_id")


@query
def migrated_papers(spark, sf_dir):
    """Papers and their hashes from batches of both versions of the table, half of the older ones migrated before."""
    papers = papers_of(spark, sf_dir).withColumn("markdown", F.when(F.col("paper_id") % 29 == 7, "").otherwise(F.col("markdown")))
    path = f"{written_root(spark)}/papers-{uuid4().hex}"
    versions.write_version(papers.filter("paper_id % 4 = 0"), path, versions.PAPERS, 1)
    versions.migrate(spark, path, versions.PAPERS)
    versions.write_version(papers.filter("paper_id % 4 = 2"), path, versions.PAPERS, 1)
    own = papers.filter("paper_id % 2 = 1").withColumn("markdown_hash", F.concat(F.lit("own "), F.col("paper_id").cast("string")))
    versions.write_version(own, path, versions.PAPERS, 2)
    return versions.read_versions(spark, path, versions.PAPERS).select("paper_id", "markdown_hash")


@query
def indexed_lookup(spark, sf_dir):
    """Papers by some ids and by some hashes from a layout that lookups skip through."""
    path = f"{written_root(spark)}/by-hash-{uuid4().hex}"
    lookup.write_by_hash(relation(spark, sf_dir, "landed"), path)
    by_id = lookup.find_ids(spark, path, [7, 11, 150, -1]).select(F.lit("id").alias("found_by"), "paper_id", "hash", "url")
    known = [r["hash"] for r in by_id.select("hash").collect()]
    by_hash = lookup.find_hashes(spark, path, [*known, md5(b"").hexdigest(), "", "no hash"])
    return by_id.union(by_hash.select(F.lit("hash"), "paper_id", "hash", "url"))
