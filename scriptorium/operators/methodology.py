"""Glossary counts and the quantitative / qualitative decision for each paper: one pass over its text, no join."""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.dimensions import GLOSSARY
from scriptorium.functions.text import is_word, lower_simple
from scriptorium.session import ship_package
from scriptorium.sources.lines import scanned

LEAST_MARKERS, MARGIN = 4, 0.2
FIRED = "array<struct<hits:int,term:string,marker:string>>"


def folded(term: str) -> str:
    return term.replace("\u2019", "'").lower()


class TermCounter:
    """Counts all terms of a glossary in one pass over a text, however many they are: an Aho-Corasick automaton.

    An occurrence counts if no word character touches it, one plural s allowed; occurrences may overlap.
    """

    def __init__(self, glossary: list[tuple[str, str | None]]):
        self.glossary, places = glossary, {}
        for i, (term, _) in enumerate(glossary):
            places.setdefault(folded(term), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for own, at in places.items():
            if own:
                self.automaton.add_word(own, (len(own), at))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[dict]:
        """hits, term and marker of each term that occurs in a folded text, most hits first, then by term."""
        hits: dict[int, int] = {}
        for last, (size, places) in self.automaton.iter(text) if len(self.automaton) else ():
            first, after = last - size, text[last + 1 : last + 3]
            after = after[1:] if after[:1] == "s" else after[:1]
            if (first < 0 or not is_word(text[first])) and not (after and is_word(after)):
                for i in places:
                    hits[i] = hits.get(i, 0) + 1
        found = sorted(((-n, *self.glossary[i]) for i, n in hits.items()), key=lambda x: x[:2])
        return [{"hits": -n, "term": term, "marker": marker} for n, term, marker in found]


def term_counts(papers: DataFrame, glossary: list[tuple[str, str | None]] = GLOSSARY) -> DataFrame:
    """paper_id, size (bytes) and fired: array of (hits, term, marker), most hits first, then by term."""
    ship_package(papers.sparkSession)
    text = lower_simple(F.replace(F.coalesce("markdown", F.lit("")), F.lit("\u2019"), F.lit("'")))
    rows = papers.select("paper_id", F.coalesce(F.octet_length("markdown"), F.lit(0)).alias("size"), scanned(text, lambda: TermCounter(glossary), FIRED).alias("fired"))
    return bound_once(rows, "fired")


def bound_once(rows: DataFrame, name: str) -> DataFrame:
    """rows with a column that is not computed again at each of its uses."""
    rest = [c for c in rows.columns if c != name]
    return rows.select(*rest, F.explode(F.array(name)).alias(name))


def methodology_terms(papers: DataFrame) -> DataFrame:
    """One row for each paper and term that occurs; rank orders a paper's terms."""
    rows = term_counts(papers).select("paper_id", F.posexplode_outer("fired").alias("rank", "t")).filter("t is not null")
    return rows.select("paper_id", "rank", "t.term", "t.marker", F.col("t.hits").alias("hits"))


def methodology(papers: DataFrame) -> DataFrame:
    """Class, score and rates of each paper; unresolved below four markers or within the margin."""
    rows = term_counts(papers)

    def hits(marker: str):
        return F.aggregate(F.filter("fired", lambda t: t["marker"] == marker), F.lit(0), lambda a, t: a + t["hits"])

    rows = rows.select(
        "paper_id", "size", hits("qualitative").alias("qualitative_hits"), hits("quantitative").alias("quantitative_hits"),
        F.size(F.filter("fired", lambda t: t["marker"].isin("qualitative", "quantitative"))).alias("distinct_markers"),
        F.exists("fired", lambda t: F.coalesce(t["marker"] == "mixed", F.lit(False))).alias("mixed_flag"), F.size("fired").alias("distinct_terms"),
        F.aggregate("fired", F.lit(0), lambda a, t: a + t["hits"]).alias("total_occurrences"),
    )
    total = F.col("qualitative_hits") + F.col("quantitative_hits")
    rows = rows.withColumn("score", F.when(total > 0, (F.col("quantitative_hits") - F.col("qualitative_hits")) / total).otherwise(0.0))
    decided = (F.col("distinct_markers") >= LEAST_MARKERS) & (total > 0)
    rows = rows.withColumn(
        "methodology_class",
        F.when(decided & (F.col("score") > MARGIN), "quantitative").when(decided & (F.col("score") < -MARGIN), "qualitative"),
    )
    per = [
        F.when(F.col("size") > 0, F.col(f"{k}_hits") / F.col("size") * 10000).otherwise(0.0).alias(f"{k}_rate")
        for k in ("qualitative", "quantitative")
    ]
    return rows.select("*", *per, F.when(F.col("methodology_class").isNull(), "unresolved").otherwise("resolved").alias("status")).drop(
        "size",
    )
