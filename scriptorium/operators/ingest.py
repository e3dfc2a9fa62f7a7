"""Papers on their way in: hashes, duplicates, status, approved markdown, and append-only upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import extract_title


def content_hash(content: Column) -> Column:
    """MD5 of a PDF's bytes, the key of duplicates."""
    return F.md5(content.cast("binary"))


def markdown_hash(markdown: Column) -> Column:
    return F.sha2(markdown.cast("binary"), 256)


def dedupe(landed: DataFrame) -> DataFrame:
    """The first paper of each hash, by created_at, then paper_id; a hot hash is aggregated before it is shuffled."""
    first = F.min_by(F.struct(*landed.columns), F.struct("created_at", "paper_id"))
    return landed.groupBy(F.col("hash").alias("_hash")).agg(first.alias("_first")).select("_first.*")


def lifecycle(landed: DataFrame) -> DataFrame:
    """landed (markdown, error, started) with status and title: failed with an error, ready with markdown, else on its way."""
    status = (
        F.when(F.coalesce("error", F.lit("")) != "", "failed")
        .when(F.coalesce("markdown", F.lit("")) != "", "ready")
        .when(F.col("started"), "processing")
        .otherwise("pending")
    )
    return landed.withColumns(
        {
            "status": status,
            "title": F.when(status == "ready", extract_title(F.col("markdown"))),
            "markdown_hash": F.when(status == "ready", markdown_hash(F.col("markdown"))),
        },
    )


def approved(papers: DataFrame) -> DataFrame:
    """Ready papers with markdown whose stored hash is absent or right, with the hash computed again; refusal tells why not.

    An absent hash is null or empty and equals nothing.
    """
    computed = markdown_hash(F.col("markdown"))
    stored = F.coalesce("markdown_hash", F.lit(""))
    refusal = (
        F.when(F.coalesce("status", F.lit("")) != "ready", "not ready")
        .when(F.coalesce("markdown", F.lit("")) == "", "no markdown")
        .when((stored != "") & (stored != computed), "hash differs")
    )
    return papers.withColumns({"refusal": refusal, "computed_hash": F.when(refusal.isNull(), computed)})


def paper_list(papers: DataFrame) -> DataFrame:
    """Newest first, without markdown."""
    return papers.drop("markdown").orderBy(F.desc("created_at"), F.desc("paper_id"))


def paper_by_id(papers: DataFrame, paper_id) -> DataFrame:
    """The paper of an id, if there is one: a filter that reaches the scan."""
    return papers.filter(F.col("paper_id") == F.lit(paper_id))


def paper_by_hash(papers: DataFrame, content: str) -> DataFrame:
    """The paper of a content hash, if there is one; an empty hash is no paper's."""
    return papers.filter((F.col("hash") == F.lit(content)) & (F.col("hash") != ""))


def upsert(log: DataFrame, key: Sequence[str], time: str, keep_first: Sequence[str] = ("created_at",), tie: str | None = None) -> DataFrame:
    """The present rows of an append-only log: the latest of each key, columns of keep_first from the earliest."""
    order = F.struct(time, *([tie] if tie else []))
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(*((F.min_by if c in keep_first else F.max_by)(c, order).alias(c) for c in rest))


def insert_if_absent(log: DataFrame, key: Sequence[str], time: str, tie: str | None = None) -> DataFrame:
    """The earliest row of each key."""
    return upsert(log, key, time, [c for c in log.columns if c not in key], tie)


#: Fixed value: upper bounds in seconds of the latency histogram.
LATENCY_BOUNDS = (0.05, 0.1, 0.5, 1, 2, 5, 10, 20, 30, 60)


def latency_histogram(events: DataFrame, seconds: str, labels: Sequence[str], bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts below each bound, with sum and count, for each combination of labels."""
    below = [F.count_if(F.col(seconds) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return events.groupBy(*labels).agg(*below, F.sum(seconds).alias("sum"), F.count(seconds).alias("count"))


def counters(events: DataFrame, labels: Sequence[str], amount: str | None = None) -> DataFrame:
    """How often, or how much of amount, was counted for each combination of labels."""
    return events.groupBy(*labels).agg((F.sum(amount) if amount else F.count(F.lit(1))).cast("double").alias("value"))


def gauges(events: DataFrame, labels: Sequence[str], value: str, time: str, tie: str) -> DataFrame:
    """The latest value of each combination of labels, by time, then tie."""
    return events.groupBy(*labels).agg(F.max_by(value, F.struct(time, tie)).cast("double").alias("value"))


def label_text(labels: Sequence[str]) -> Column:
    """Labels as name="value", joined by commas; quotes, backslashes and newlines in values are escaped."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat_ws(
        ",",
        *(F.concat(F.lit(f'{c}="'), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"')) for c in labels),
    )


def number_text(value: Column) -> Column:
    """A number as text: whole ones without a fraction."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def metric_lines(metrics: DataFrame, name: str, labels: Sequence[str], bounds: Sequence[float] | None = None) -> DataFrame:
    """The exposition lines of a metric: name, key (its labels), place (within the key), line.

    metrics: from `counters` or `gauges` (column value), or from `latency_histogram` if bounds are given. Written in the
    order of name, key and place, below the metric's HELP and TYPE lines, they are its text.
    """
    key = label_text(labels)
    around = lambda k: F.when(k == "", F.lit("")).otherwise(F.concat(F.lit("{"), k, F.lit("}")))
    if bounds is None:
        lines = [F.concat(F.lit(name), around(key), F.lit(" "), number_text(F.col("value")))]
    else:
        bucket = lambda le, count: F.concat(F.lit(f"{name}_bucket"), around(F.concat_ws(",", F.nullif(key, F.lit("")), F.lit(f'le="{le}"'))), F.lit(" "), count.cast("string"))
        lines = [bucket(f"{b:g}", F.col(f"le_{str(b).replace('.', '_')}")) for b in bounds] + [bucket("+Inf", F.col("count"))]
        lines += [F.concat(F.lit(f"{name}_sum"), around(key), F.lit(" "), number_text(F.coalesce("sum", F.lit(0))))]
        lines += [F.concat(F.lit(f"{name}_count"), around(key), F.lit(" "), F.col("count").cast("string"))]
    return metrics.select(F.lit(name).alias("name"), key.alias("key"), F.posexplode(F.array(*lines)).alias("place", "line"))


def metrics_text(metrics: Sequence[tuple[str, str, str, DataFrame]]) -> str:
    """The text of a registry: (name, help, kind, lines) by name, the lines of each by key and place.

    For a scrape: a line for each combination of labels, which are few by the nature of metrics.
    """
    out = []
    for name, help_text, kind, lines in sorted(metrics, key=lambda m: m[0]):
        out += [f"# HELP {name} {help_text}", f"# TYPE {name} {kind}"]
        out += [r["line"] for r in lines.orderBy("key", "place").collect()]
    return "".join(line + "\n" for line in out)
