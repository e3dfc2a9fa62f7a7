"""Tables and figures of markdown papers. One scan finds their lines; all else is a projection of that scan's row.

No exchange: tables and figures come out of their paper's own row, and the markdown is left behind there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import ASCII_WORD, contains_latex, is_separator_row, parse_crop, split_row, trim_blank
from scriptorium.session import ship_package
from scriptorium.sources.lines import LOOKBACK, detect_images, detect_table_blocks

# How captions, images and headings look.
SPACE = r"[\t\n\f\r ]"
NOTE = rf"\A{SPACE}*(?:\[\^\d+\])?{SPACE}*(?:\*\*)?{SPACE}*"
LABEL = rf"{SPACE}*\.?{SPACE}*([A-Z]?\d+|[IVXLC]+)(?!{ASCII_WORD})\.?{SPACE}*(?:\*\*)?{SPACE}*(.*)\z"
TABLE_CAPTION = rf"{NOTE}(Table|TABLE|Tab\.|Appendix|APPENDIX){LABEL}"
FIGURE_CAPTION = rf"{NOTE}(Figure|Fig|FIG){LABEL}"
IMAGE = rf"\A{SPACE}*!\[[^\]]*\]\(([^)]+)\)"
HEADING = rf"\A{SPACE}{{0,3}}#{{1,6}}{SPACE}"
NO_TEXTS = "array<string>"


def caption(line: Column, pattern: str) -> Column:
    """struct(word, label, text) of a caption line; null of any other line."""
    parts = [F.regexp_extract(line, pattern, i) for i in (1, 2, 3)]
    made = F.struct(parts[0].alias("word"), parts[1].alias("label"), trim_blank(parts[2]).alias("text"))
    return F.when(F.regexp_like(line, F.lit(pattern)), made)


def table_scan(papers: DataFrame) -> DataFrame:
    """paper_id and scan: see `sources.lines.TABLES`."""
    ship_package(papers.sparkSession)
    return papers.select("paper_id", detect_table_blocks(F.col("markdown")).alias("scan"))


def pipe_blocks(papers: DataFrame) -> DataFrame:
    """Maximal runs of pipe rows: paper_id, block, first_place, lines (place, line, start, stop), continuation, above."""
    rows = table_scan(papers).select("paper_id", F.explode(F.flatten("scan")).alias("b"))
    first = F.get("b.lines", F.lit(0))["place"].alias("first_place")
    return rows.select("paper_id", "b.block", first, "b.lines", "b.continuation", "b.above")


def pipe_rows(papers: DataFrame) -> DataFrame:
    """Every pipe row: paper_id, place, start, stop."""
    rows = pipe_blocks(papers).select("paper_id", F.explode("lines").alias("x"))
    return rows.select("paper_id", "x.place", "x.start", "x.stop")


def last_stop(lines: Column) -> Column:
    return F.try_element_at(lines, F.lit(-1))["stop"]


def cells_of(lines: Column) -> Column:
    """The cells of rows that are no separators."""
    return F.transform(F.filter(lines, lambda x: ~is_separator_row(x)), split_row)


def tables_of(scanned: DataFrame) -> DataFrame:
    """Rows with a scan: a row for each table; columns besides the scan are kept."""
    kept = [c for c in scanned.columns if c != "scan"]
    # array elements are got, not indexed: the optimizer may look at rows before they are filtered
    several = F.posexplode(F.slice("scan", F.lit(2), F.size("scan"))).alias("table_number", "_blocks")
    opening = F.get("_blocks", F.lit(0))
    rows = scanned.select(*kept, several).withColumn("table_number", F.col("table_number") + 1)
    rows = rows.withColumns({"_lines": opening["lines"], "_above": opening["above"]})
    cells = split_row(F.get("_lines", F.lit(0))["line"])
    alone = F.forall(F.slice(cells, F.lit(2), F.size(cells)), lambda c: c == "")
    first_cell = F.when(alone, caption(F.get(cells, F.lit(0)), TABLE_CAPTION))
    # upwards: nothing beyond a heading counts
    upward = F.reverse("_above")
    heading = F.array_position(F.transform(upward, lambda x: x["line"].rlike(HEADING)), F.lit(True))
    stop = F.coalesce(F.nullif(heading, F.lit(0)).cast("int"), F.lit(LOOKBACK + 1))
    named = F.transform(
        F.slice(upward, F.lit(1), stop - 1),
        lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), caption(x["line"], TABLE_CAPTION).alias("c")),
    )
    hit = F.get(F.filter(named, lambda x: x["c"].isNotNull()), F.lit(0))
    rows = rows.withColumns({"_first": first_cell, "_hit": hit, "_texts": F.transform("_lines", lambda x: x["line"])})
    after = F.filter("_above", lambda x: x["place"] > F.col("_hit.place"))
    below = F.array_join(F.transform(after, lambda x: trim_blank(x["line"])), " ")
    in_cell, above = F.col("_first").isNotNull(), F.col("_hit").isNotNull()
    rows = rows.withColumn("_body", F.when(in_cell, F.slice("_texts", F.lit(2), F.size("_texts"))).otherwise(F.col("_texts")))
    headed = (F.size("_body") >= 2) & is_separator_row(F.get("_body", F.lit(1)))
    chosen = F.coalesce("_first", "_hit.c")
    word = F.lower(F.rtrim(F.translate(chosen["word"], ".", " ")))
    rest = F.when(headed, F.slice("_body", F.lit(3), F.size("_body"))).otherwise(F.col("_body"))
    more = F.slice("_blocks", F.lit(2), F.size("_blocks"))
    further = F.flatten(F.transform(more, lambda b: cells_of(F.transform(b["lines"], lambda x: x["line"]))))
    parts = F.transform(more, lambda b: F.struct(F.get(b["lines"], F.lit(0))["start"].alias("start"), last_stop(b["lines"]).alias("end")))
    rows = rows.select(
        *kept,
        "table_number",
        F.when(word == "appendix", "appendix").otherwise("table").alias("kind"),
        chosen["label"].alias("label"),
        F.when(~in_cell & (F.col("_hit.c.text") == ""), below).otherwise(chosen["text"]).alias("caption"),
        F.when(in_cell, "first_cell").when(above, "above").otherwise("none").alias("caption_source"),
        F.when(headed, split_row(F.get("_body", F.lit(0)))).alias("header"),
        F.concat(cells_of(rest), further).alias("rows"),
        contains_latex(F.col("_body")).alias("has_latex"),
        F.when(~in_cell & above, F.col("_hit.start")).otherwise(F.get("_lines", F.lit(0))["start"]).alias("start_offset"),
        last_stop(F.try_element_at("_blocks", F.lit(-1))["lines"]).alias("end_offset"),
        parts.alias("continuation_offsets"),
    )
    widths = F.transform(F.concat(F.array(F.coalesce("header", F.array().cast(NO_TEXTS))), "rows"), F.size)
    return rows.withColumn("column_count", F.array_max(widths))


def tables(papers: DataFrame) -> DataFrame:
    """Tables with caption, header, rows, offsets and merged continuations."""
    return tables_of(table_scan(papers))


def dropped_blocks(papers: DataFrame) -> DataFrame:
    """Continuations before any table, which belong to none: a count for each paper that has them."""
    early = F.size(F.get("scan", F.lit(0))).cast("long")
    # out of a generator: a filter that reached the scan would have it done twice
    return table_scan(papers).select("paper_id", F.explode(F.array(early)).alias("dropped_blocks")).filter("dropped_blocks > 0")


def figures(papers: DataFrame) -> DataFrame:
    """Images with a caption on one of the two lines below or above them, in that order of preference."""
    ship_package(papers.sparkSession)
    rows = papers.select("paper_id", F.explode(detect_images(F.col("markdown"))).alias("i"))
    named = F.transform(
        "i.near",
        lambda x: F.struct(
            F.when(~x["line"].rlike(HEADING), caption(x["line"], FIGURE_CAPTION)).alias("c"), x["start"].alias("start"), x["stop"].alias(
                "stop",
            )
        ),
    )
    rows = rows.withColumn("_near", F.get(F.filter(named, lambda x: x["c"].isNotNull()), F.lit(0))).filter("_near is not null")
    url = trim_blank(F.regexp_extract("i.line", IMAGE, 1))
    return rows.select(
        "paper_id",
        F.col("_near.c.label").alias("label"),
        F.col("_near.c.text").alias("caption"),
        url.alias("url"),
        F.least("i.start", "_near.start").alias("start_offset"),
        F.greatest("i.stop", "_near.stop").alias("end_offset"),
        parse_crop(url).alias("crop"),
    ).select("paper_id", "label", "caption", "url", "start_offset", "end_offset", "crop.*")
