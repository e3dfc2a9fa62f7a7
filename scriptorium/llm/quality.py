"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Null and empty texts have statistics of zero and are scored like any other. The trees are fitted on at most about
`sample` labelled rows, drawn by a hash of the id; rows without a label or outside the training fold are not learned
from. Without labels of both classes every score is the share of label 1, or 0.5. Repeated rows get the same score.
Whole texts of any length are read. Columns of the new names are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.columns import with_text_columns
from scriptorium.llm.gbdt import Trees, constant, fit

CLASSES = ("other", "lower", "upper", "digit", "space", "point", "symbol", "newline")
STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "lower", "upper", "digit", "space", "point", "symbol", "other",
    "log_lines", "line_length", "repeated_lines", "different_words", "commonest_word", "same_as_before", "capital_words",
    "words_ending_in_symbols", "words_of_symbols", "short_words", "long_words", "sentence_length", "letters_in_words", "repeated_pairs", "first_upper",
)


@cache
def char_classes() -> np.ndarray:
    """The class of every code point of the first planes; what lies beyond counts as other."""
    table = np.zeros(0x3000, np.uint8)
    for i in range(len(table)):
        c, kind = chr(i), unicodedata.category(chr(i))
        table[i] = 7 if c == "\n" else 4 if c.isspace() else 2 if kind in ("Lu", "Lt") else 1 if kind[0] == "L" else 3 if kind[0] == "N" else 5 if c in ".,;:!?'\"-()" else 6 if kind[0] in "PS" else 0
    return table


def statistics(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(STATISTICS)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    table = char_classes()
    kinds = np.bincount(np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 0), minlength=len(CLASSES)) / len(points)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    ends = Counter(w[-1] for w in words)
    symbols = sum(v for k, v in ends.items() if not k.isalnum() and k not in ".,;:!?'\")")
    pairs = Counter(zip(words, words[1:], strict=False))
    starts = Counter(w[0] for w in words)
    return [
        float(np.log1p(len(points))), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()),
        *(float(kinds[i]) for i in (1, 2, 3, 4, 5, 6, 0)),
        float(np.log1p(len(lines))), len(text) / len(lines), 1 - len(set(lines)) / len(lines), len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n, sum(map(str.isupper, words)) / n,
        symbols / n, sum(v for k, v in counts.items() if not any(map(str.isalnum, k))) / n if kinds[6] + kinds[5] > 0 else 0.0,
        float((lengths <= 3).mean()), float((lengths >= 12).mean()), n / max(1, sum(ends[c] for c in ".!?")),
        float(kinds[1] + kinds[2]) * len(text) / max(1.0, float(lengths.sum())), 1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0, sum(v for k, v in starts.items() if k.isupper()) / n,
    ]


def text_statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """docs without the text, with an array of its statistics."""
    return with_text_columns(
        docs,
        text,
        lambda texts: ([statistics(t) for t in texts],),
        (T.StructField(out, T.ArrayType(T.DoubleType())),),
        (text,),
    )


def learn_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", label: str = "quality", text: str = "text", sample: int = 20_000) -> Trees:
    """Trees fitted on a bounded sample of the labelled rows for which learn holds."""
    known = labels.filter(learn & F.col(label).isin(0, 1)).groupBy(id_column).agg(F.max(label).alias("_label"))
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64(id_column), F.lit(1_000_000)) < int(share * 1_000_000) + (share >= 1)).limit(2 * sample)
    rows = (
        text_statistics(
            docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(
                F.broadcast(drawn.withColumnRenamed(id_column, "_id")),
                "_id",
            ),
            "_text",
        )
        .orderBy("_id")
        .toPandas()
    )
    if not len(rows):
        return constant(0.5, len(STATISTICS))
    return fit(np.stack(rows["statistics"].to_numpy()), rows["_label"].to_numpy(np.float64))


def score_quality(docs: DataFrame, trees: Trees, threshold: float = 0.3, text: str = "text", out: tuple[str, str] = ("score", "predicted"), keep_text: bool = False) -> DataFrame:
    """docs with the probability of label 1 and 1 from the threshold on as columns out, without the text unless kept.

    Columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def scored(texts: list[str | None]) -> tuple:
        score = sent.value.probabilities(np.array([statistics(t) for t in texts]))
        return score, (score >= threshold).astype(np.int32)

    return with_text_columns(
        docs,
        text,
        scored,
        (T.StructField(out[0], T.DoubleType()), T.StructField(out[1], T.IntegerType())),
        () if keep_text else (text,),
    )
