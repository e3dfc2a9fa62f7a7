"""The corpus pipeline: language, quality, near duplicates, personal data, packing.

Each stage takes all documents that its predecessor kept; all but the last return the columns of documents. The first
stage predicts each text's language and rejects texts without a letter, predictions that are no better than chance, and
languages that LANGUAGES leaves out; the second rejects texts scored below its threshold; of each group of near
duplicates the row with the smallest id stays, a null id only where there is no other (rows are told apart by a key
of their own, so different texts under one id or under null ids all stay); personal data is replaced by its kind in the
text, and n_chars follows; the last stage packs token sequences. Null texts are rejected by the first stage. An empty
table goes through and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.language import UNKNOWN, identify, learn_languages
from scriptorium.llm.near_duplicates import near_duplicates
from scriptorium.llm.packing import pack_documents
from scriptorium.llm.pii import find_personal_data, learn_selector
from scriptorium.llm.quality import learn_quality, score_quality
from scriptorium.llm.queries import fold
from scriptorium.session import materialise, read_table

#: Names that no table of documents has.
JUDGED = ("_judged", "_judged_score")
ROW = "_row"


#: Languages that stay; None keeps every language that is learned from the corpus.
LANGUAGES: tuple[str, ...] | None = None
#: A prediction below this score is no better than a coin for the family and another one for the language within it.
LEAST_SCORE = 0.27


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of LANGUAGES by the classifier, with a score of at least LEAST_SCORE."""
    model = learn_languages(docs, fold("doc_id", 4) != 2)
    told = (F.col(JUDGED[0]) != UNKNOWN) & (F.col(JUDGED[1]) >= LEAST_SCORE)
    wanted = told if LANGUAGES is None else told & F.col(JUDGED[0]).isin(*LANGUAGES)
    return identify(docs, model, out=JUDGED).filter(wanted).drop(*JUDGED)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality 1 by the classifier."""
    trees = learn_quality(docs, read_table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return score_quality(docs, trees, out=JUDGED, keep_text=True).filter(F.col(JUDGED[1]) == 1).drop(*JUDGED).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    rows = materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    classes = near_duplicates(rows, row_key=ROW).select(ROW, "class_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW]
    kept = rows.select(ROW, "doc_id").join(classes, ROW).groupBy("class_row").agg(first.alias(ROW)).select(ROW)
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    redacted = find_personal_data(docs, learn_selector(), replace="<{}>")
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", one_of_each),
    ("personal_data", private),
    ("packing", packed),
]
#: No SQL expresses the classifiers; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
