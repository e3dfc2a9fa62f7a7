"""Language identification by hierarchical discrimination.

First the language family is told, then the language within it; each step is a set of one-versus-one linear support
vector machines over hashed letter bigrams and trigrams of the whole text, lower-cased, everything but letters being
one blank. Families are looked up by language code; a code without an entry is a family of its own. The machines are
fitted on at most about `sample` rows a language, drawn by a hash of the id, for the `most` languages that have the
most rows: a dirty column of codes brings no more than these to the driver, and their pairs bound the machines.

`und` (score 0) goes to null texts and texts without a letter. If only one language is learned every other text gets
it. Without any row to learn from all texts are `und`. Repeated rows get the same prediction. Nothing but the text is
an input of a prediction. Columns of the new names are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.columns import with_text_columns

#: Fixed: families of closely related languages, by ISO 639 code.
FAMILIES = {
    "germanic": "en de nl af da sv no nb nn is fo lb yi fy",
    "romance": "fr es it pt ro ca gl oc la sc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi ur bn mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue wuu",
    "austronesian": "id ms jv su tl mg",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BUCKETS = 1 << 12
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)])


def profile(text: str | None) -> np.ndarray:
    """Square roots of hashed bigram and trigram counts, of length 1; zeros for a text without letters."""
    out = np.zeros(BUCKETS, np.float32)
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return out
    points = np.where(is_letter, points, 32)
    points = np.concatenate([[32], points[(points != 32) | np.concatenate([[True], points[1:] != points[:-1]])], [32]]).astype(np.uint32)
    pairs = points[:-1] * np.uint32(0x9E3779B1) ^ points[1:] * np.uint32(0x85EBCA6B)
    triples = pairs[:-1] * np.uint32(0xC2B2AE35) ^ points[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.bincount(
        np.concatenate([(pairs * np.uint32(0x165667B1)) >> shift, (triples * np.uint32(0x165667B1)) >> shift]),
        minlength=BUCKETS,
    )
    out[:] = np.sqrt(counts)
    return out / np.linalg.norm(out)


def linear_machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights and bias (last) of a support vector machine with squared hinge loss; y is 1 or -1.

    Accelerated gradient descent on the primal; the classes weigh the same in sum.
    """
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1 / (1 + 4 * cost)
    w = ahead = np.zeros(x.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        before, w = w, ahead - step * (ahead - 2 * cost * (x.T @ (share * y * slack)))
        ahead = w + t / (t + 3) * (w - before)
    return w


class OneVersusOne:
    """Votes of all pairs of classes; each pair's vote is the logistic of its margin."""

    def __init__(self, x: np.ndarray, y: np.ndarray, sharpness: float = 3.0):
        self.classes, self.sharpness = sorted(set(y)), sharpness
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights = [linear_machine(x[own], np.where(y[own] == self.classes[a], 1.0, -1.0)) for a, b in self.pairs for own in [np.isin(y, (self.classes[a], self.classes[b]))]]

    def shares(self, x: np.ndarray) -> np.ndarray:
        """For each row and class the mean probability against the other classes, scaled to a sum of 1."""
        out = np.zeros((len(x), len(self.classes)))
        if not self.pairs:
            return out + 1
        margins = x.astype(np.float64) @ np.stack([w[:-1] for w in self.weights]).T + np.array([w[-1] for w in self.weights])
        votes = 1 / (1 + np.exp(-np.clip(self.sharpness * margins, -40, 40)))
        for (a, b), vote in zip(self.pairs, votes.T, strict=True):
            out[:, a] += vote
            out[:, b] += 1 - vote
        return out / len(self.pairs)


class Discriminator:
    """Family first, then the language within the family."""

    def __init__(self, x: np.ndarray, languages: np.ndarray):
        families = np.array([FAMILY_OF.get(c, c) for c in languages])
        self.families = OneVersusOne(x, families)
        self.within = {f: OneVersusOne(x[families == f], languages[families == f]) for f in self.families.classes}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of_family = self.families.shares(x)
        family = of_family.argmax(axis=1)
        names, scores = np.full(len(x), UNKNOWN, object), of_family.max(axis=1)
        for i, f in enumerate(self.families.classes):
            rows = np.flatnonzero(family == i)
            if len(rows):
                shares = self.within[f].shares(x[rows])
                names[rows] = np.array(self.within[f].classes, object)[shares.argmax(axis=1)]
                scores[rows] *= shares.max(axis=1)
        return names, scores


def learn_languages(
    docs: DataFrame, learn: Column, id_column: str = "doc_id", lang: str = "lang", text: str = "text", sample: int = 600, most: int = 200
) -> Discriminator | None:
    """A discriminator fitted on at most about sample rows for each language among the rows for which learn holds."""
    own = docs.filter(learn & F.col(lang).isNotNull()).select(
        F.col(id_column).alias("_id"),
        F.col(lang).alias("_lang"),
        F.col(text).alias("_text"),
    )
    known = own.filter(F.col("_text").rlike(r"\p{L}"))
    ranked = own.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_lang").limit(most)
    counts = {r["_lang"]: r["n"] for r in ranked.collect()}
    if not counts:
        return None
    share = F.coalesce(*(F.when(F.col("_lang") == c, F.lit(min(1.0, sample / n))) for c, n in counts.items()))
    drawn = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share * 1_000_000).limit(2 * sample * len(counts))

    def profiled(texts: list[str | None]) -> tuple:
        return ([profile(t).tobytes() for t in texts],)

    rows = (
        with_text_columns(drawn, "_text", profiled, (T.StructField("_profile", T.BinaryType()),), ("_text",))
        .toPandas()
        .sort_values(["_id", "_lang"])
    )
    if not len(rows):
        return None
    return Discriminator(np.frombuffer(b"".join(rows["_profile"]), np.float32).reshape(-1, BUCKETS), rows["_lang"].to_numpy())


def identify(docs: DataFrame, model: Discriminator | None, text: str = "text", out: tuple[str, str] = ("lang_pred", "score"), drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the language and the score as columns out; columns of these names are replaced, those of drop left out."""
    if model is None:
        return docs.drop(*out, *drop).select("*", F.lit(UNKNOWN).alias(out[0]), F.lit(0.0).alias(out[1]))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def identified(texts: list[str | None]) -> tuple:
        x = np.stack([profile(t) for t in texts])
        names, scores = sent.value.predict(x)
        blank = ~x.any(axis=1)
        names[blank], scores[blank] = UNKNOWN, 0.0
        return names.tolist(), scores

    return with_text_columns(docs, text, identified, (T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())), drop)
