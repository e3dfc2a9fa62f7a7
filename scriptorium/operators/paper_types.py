"""Paper-type verdicts: raw responses parsed, held against their contract, their quotes verified, and papers routed.

The model's calls are no part of this engine; its raw responses arrive in a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import between, let, normalise_quote, trim_blank, word_count

# The contract of a verdict.
TYPES = ("A", "B", "C", "D")
UNCLASSIFIED = "UNCLASSIFIED"
SUBTYPES = {"systematic_review": "B", "meta_analysis": "B", "mathematical_modelling": "D", "mathematical_proof": "D"}
CONFIDENCES = ("high", "medium", "low")
LEAST_QUOTES, MOST_QUOTES, QUOTE_WORDS = 2, 4, 25
PROMPT_VERSION = "type-1.0"

VERDICT = (
    "primary_type string, subtype string, secondary_type string, decision_rule int, confidence string, evidence array<struct<quote:string,signals:string>>, "
    "counter_evidence struct<quote:string,points_to:string>, boundary_case string, limits_from_selection string, rationale string, unclassified_reason string"
)

FIELDS = "primary_type subtype secondary_type decision_rule confidence evidence counter_evidence boundary_case limits_from_selection rationale unclassified_reason".split()


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """responses (raw_response) with verdict (a struct, null if it can't be read) and error (the first breach, or null)."""
    answer, tag = between(F.col("raw_response"), "<answer>", "</answer>"), trim_blank(
        between(F.col("raw_response"), "<verdict>", "</verdict>"),
    )
    body = trim_blank(F.regexp_replace(F.regexp_replace(trim_blank(answer), r"\A(?:```json|```)", ""), r"```\z", ""))

    def judged(v: Column) -> Column:
        broken = v.isNull() | v["_broken"].isNotNull() | ~F.coalesce(F.startswith(body, F.lit("{")), F.lit(False))
        error = (
            F.when(answer.isNull(), "no <answer> block")
            .when(tag.isNull(), "no <verdict> block")
            .when(broken, "invalid JSON")
            .when(tag != F.coalesce(v["primary_type"], F.lit("")), "verdict tag differs from primary_type")
            .otherwise(breach(v))
        )
        return F.struct(error.alias("error"), F.struct(*(v[c].alias(c) for c in FIELDS)).alias("verdict"))

    parsed = F.from_json(body, VERDICT + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    # out of a generator, so that a filter on the error does not parse again
    rows = responses.select("*", F.inline(F.array(let(parsed, judged))))
    return rows.select(*responses.columns, F.when(F.col("error").isNull(), F.col("verdict")).alias("verdict"), "error")


def breach(v: Column) -> Column:
    """The first rule of the contract that a verdict breaks, or null."""
    blank = lambda c: trim_blank(F.coalesce(c, F.lit(""))) == ""
    primary, subtype, secondary = (F.coalesce(v[c], F.lit("")) for c in ("primary_type", "subtype", "secondary_type"))
    typed = primary.isin("B", "D")
    family = F.coalesce(*(F.when(subtype == s, F.lit(t)) for s, t in SUBTYPES.items()))
    quotes = F.coalesce(v["evidence"], F.array().cast("array<struct<quote:string,signals:string>>"))
    return (
        F.when(~primary.isin(*TYPES, UNCLASSIFIED), "unknown primary_type")
        .when(~F.coalesce(v["decision_rule"], F.lit(0)).between(1, 5), "decision_rule out of range")
        .when(~F.coalesce(v["confidence"], F.lit("")).isin(*CONFIDENCES), "unknown confidence")
        .when(typed & (subtype == ""), "subtype missing")
        .when(~typed & (subtype != ""), "subtype not allowed")
        .when((subtype != "") & family.isNull(), "unknown subtype")
        .when((subtype != "") & (family != primary), "subtype of another type")
        .when((secondary != "") & ~secondary.isin(*TYPES), "unknown secondary_type")
        .when((secondary != "") & (secondary == primary), "secondary_type equals primary_type")
        .when((primary == UNCLASSIFIED) & blank(v["unclassified_reason"]), "unclassified_reason missing")
        .when((primary != UNCLASSIFIED) & ~blank(v["unclassified_reason"]), "unclassified_reason not allowed")
        .when(~F.size(quotes).between(LEAST_QUOTES, MOST_QUOTES), "number of quotes")
        .when(F.exists(quotes, lambda e: blank(e["quote"])), "empty quote")
        .when(F.exists(quotes, lambda e: word_count(e["quote"]) > QUOTE_WORDS), "quote too long")
        .when(v["counter_evidence"].isNotNull() & blank(v["counter_evidence"]["quote"]), "empty counter quote")
        .when(
            v["counter_evidence"].isNotNull() & ~F.coalesce(v["counter_evidence"]["points_to"], F.lit("")).isin(*TYPES),
            "unknown points_to",
        )
    )


def verify_verdicts(responses: DataFrame, papers: DataFrame) -> DataFrame:
    """Valid verdicts with quotes_expected, quotes_verified, counter_verified, empirical, all_verified and reason.

    Quotes are folded before they meet their paper. A folded quote that a text holds as it stands is held by the folded
    text too, so a text is folded only if some quote is not found in it at once.
    """
    counter = F.col("verdict.counter_evidence")
    quotes = F.transform("verdict.evidence", lambda e: normalise_quote(F.coalesce(e["quote"], F.lit(""))))
    folded = F.struct(quotes.alias("_own"), normalise_quote(counter["quote"]).alias("_counter"))
    valid = parse_verdicts(responses).filter("error is null").select("*", F.inline(F.array(folded)))
    text = F.coalesce("markdown", F.lit(""))

    def holds(text: Column, quote: Column) -> Column:
        return F.coalesce((quote != "") & F.contains(text, quote), F.lit(False))

    def held(text: Column) -> Column:
        found = F.size(F.filter("_own", lambda q: holds(text, q)))
        return F.struct(
            found.alias("quotes_verified"),
            F.when(counter.isNotNull(), holds(text, F.col("_counter"))).alias("counter_verified"),
        )

    plainly = F.forall("_own", lambda q: holds(text, q)) & (counter.isNull() | holds(text, F.col("_counter")))
    joined = valid.join(papers.select("paper_id", "markdown"), "paper_id")
    checked = let(F.when(plainly, text).otherwise(normalise_quote(text)), held)
    rows = joined.select(*valid.columns, F.inline(F.array(checked))).drop("_own", "_counter")
    rows = rows.withColumn("quotes_expected", F.size("verdict.evidence"))
    all_found = (F.col("quotes_expected") > 0) & (F.col("quotes_verified") == F.col("quotes_expected"))
    return rows.withColumns(
        {
            "empirical": (F.col("verdict.primary_type") == "A") | (F.coalesce("verdict.secondary_type", F.lit("")) == "A"),
            "all_verified": all_found & F.coalesce("counter_verified", F.lit(True)),
            "reason": reason(F.col("verdict")),
        }
    )


def reason(v: Column) -> Column:
    """One line on what a verdict means for the paper."""
    primary = v["primary_type"]
    means = (
        F.when(primary == "A", "empirical")
        .when(primary == "B", "synthesis of earlier studies")
        .when(primary == "C", "conceptual")
        .when(primary == "D", "formal")
        .otherwise("unclassified")
    )
    return F.concat_ws(
        ": ",
        means,
        F.nullif(F.coalesce(v["subtype"], F.lit("")), F.lit("")),
        F.when(primary == UNCLASSIFIED, v["unclassified_reason"]),
    )


def route(verified: DataFrame) -> DataFrame:
    """verified with route: unverified quotes are refused first, then papers that aren't empirical."""
    return verified.withColumn(
        "route",
        (
            F.when(F.col("quotes_verified") != F.col("quotes_expected"), "unverified_quotes")
            .when(~F.col("empirical"), "not_empirical")
            .otherwise("allowed")
        ),
    )


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """The latest verdict for each paper and markdown hash, by created_at, then verdict_id."""
    last = F.max_by(F.struct(*verdicts.columns), F.struct("created_at", "verdict_id"))
    return verdicts.groupBy(F.col("paper_id").alias("_paper"), F.col("markdown_hash").alias("_hash")).agg(last.alias("_last")).select("_last.*")


def work_queue(papers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Papers without a verdict for their present markdown."""
    return papers.select("paper_id", "markdown_hash").join(verdicts, ["paper_id", "markdown_hash"], "left_anti")


def build_input(form: Column, headings: Column, body: Column) -> Column:
    """The model's input: form, complete heading list, manuscript. Null without a body, or a selection without headings."""
    listed = F.array_join(F.transform(headings, lambda h: F.concat(F.lit("  "), trim_blank(h), F.lit("\n"))), "")
    section = F.when(F.size(headings) > 0, F.concat(F.lit("COMPLETE HEADING LIST (every heading in the document, in order):\n"), listed, F.lit("\n"))).otherwise(
        "",
    )
    whole = F.concat(F.lit("INPUT FORM: "), form, F.lit("\n\n"), section, F.lit("MANUSCRIPT:\n\n"), body)
    return F.when((trim_blank(body) != "") & ~((form == "SELECTION") & (F.coalesce(F.size(headings), F.lit(0)) <= 0)), whole)
