"""Language-model scores, importance resampling and source divergence against brute force, and on odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import queries
from scriptorium.llm.divergence import divergence, shares, source_divergence
from scriptorium.llm.elias_fano import EliasFano, MappedArrays
from scriptorium.llm.ngram_model import PARTS, Model, Trie, build_trie, score_texts
from scriptorium.llm.resampling import importance_weights, resample
from scriptorium.llm.word_blocks import pack, pack_all, unpack, unpack_all
from scriptorium.session import read_table
from tests.compare import duck, rows

ODD = [
    (1, "Alpha beta ALPHA", "en", "a"), (1, "Alpha beta ALPHA", "en", "a"), (2, None, None, None), (None, "beta  gamma\tgamma\n", "en", "b"), (3, "", "de", "a"),
    (4, "été Été 9 x-y", "fr", "c"), (5, "beta alpha " * 3000, "en", "b"), (None, "gamma", "en", ""), (6, "\x85   ", "fr", "a"),
]


def odd(spark, kept=ODD):
    docs = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string")
    return docs.withColumns({"score": F.lit("x"), "doc": F.lit(1), "rank": F.lit(2), "block": F.lit(3), "term": F.lit(""), "count": F.lit(1)})


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_source_divergence"])
def test_query_equals_sql(name, spark, sf):
    df = queries.QUERIES[name](spark, sf)
    names, wanted = duck(queries.ORACLE_SQL[name], sf)
    assert sorted(df.columns) == names
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == wanted


@pytest.mark.parametrize("top", [1, 2, 70, 1 << 20, 1 << 45, (1 << 62) - 1])
@pytest.mark.parametrize("n", [1, 2, 63, 1000])
def test_elias_fano_finds_what_a_list_finds(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    found = EliasFano.build(values)
    assert (found.get(np.arange(n)) == values).all()
    asked = np.concatenate([values, np.minimum(values + 1, top), rng.integers(0, top, 50), [0, top]])
    place, same = found.successor(asked)
    assert (place == np.searchsorted(values, asked)).all()
    assert (same == np.isin(asked, values)).all()


def test_packed_numbers_come_back():
    for values in ([], [0], [0, 0], [255, 256], [1 << 62, 3]):
        assert unpack(pack(np.array(values, np.int64))).tolist() == values
    assert [x.tolist() for x in unpack_all(pack_all([np.arange(3), np.zeros(0, np.int64)]))] == [[0, 1, 2], []]


def test_trie_knows_its_pairs_and_no_others():
    rng = random.Random(5)
    pairs = Counter((rng.randrange(40), rng.randrange(60)) for _ in range(900))
    model = Model(5000, 100, 4)
    a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    times, contexts, counts = np.array(list(pairs.values())), a * 3 + 50, b + 7
    twice = lambda x: np.r_[x, x]  # noqa: E731  counts of one pair from two blocks are summed
    with MappedArrays(build_trie(twice(a), twice(b), np.r_[times, np.ones_like(times)], twice(contexts), twice(counts), model)) as arrays:
        trie = Trie(arrays)
        x, y = (v.ravel() for v in np.meshgrid(np.arange(45), np.arange(65)))
        codes, there = trie.look_up(x, y)
        del trie, arrays
    assert there.tolist() == [(i, j) in pairs for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    for i, j, code, known in zip(x.tolist(), y.tolist(), codes.tolist(), there.tolist(), strict=True):
        if known:
            assert code == round(-PARTS * math.log10(model.smoothed(pairs[i, j] + 1, np.array(i * 3 + 50), np.array(j + 7))))


def brute_scores(docs, mass):
    """docs: (key, held, tokens without the end); scores by the definition, unrounded but for the thousandths of each token."""
    count, pairs = Counter(), Counter()
    for _, held, tokens in docs:
        if not held:
            count.update([*tokens, None])
            pairs.update(zip([None, *tokens], [*tokens, None], strict=True))
    n, v = sum(count.values()), len(count)
    chance = lambda w: (count[w] + 0.5) / (n + 0.5 * (v + 1))
    for key, held, tokens in docs:
        whole = [*tokens, None]
        smooth = [(pairs[a, b] + mass * chance(b)) / (count[a] + mass) for a, b in zip([None, *tokens], whole, strict=True)]
        yield key, held, len(whole), sum(count[w] > 0 for w in whole), n, sum(math.log10(chance(w)) for w in whole), -sum(round(-PARTS * math.log10(p)) for p in smooth) / PARTS


def same_scores(got, wanted):
    assert len(got) == len(wanted)
    for a, b in zip(sorted(got, key=str), sorted(wanted, key=str), strict=True):
        assert tuple(a)[:5] == tuple(b)[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_scores_equal_brute_force(spark, sf):
    own = read_table(spark, sf, "documents").select("doc_id", "text").collect()
    docs = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 5 == 1, (r.text or "").encode().lower().split()) for r in own]
    got = queries.QUERIES["op11_ngram_trie"](spark, sf).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    same_scores([tuple(r) for r in got.collect()], list(brute_scores(docs, 64.0)))
    held = got.filter("held_out").agg(F.sum("score") - F.sum("base_score")).first()[0]
    assert held > 0


@pytest.mark.parametrize("shards", ["1", "8"])
def test_scores_of_odd_rows(spark, shards):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        order = ["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        got = score_texts(odd(spark), F.col("source") == "b").select(order).collect()
        docs = [(i, s == "b", (t or "").encode().lower().split()) for i, t, _, s in ODD]
        same_scores([tuple(r) for r in got], list(brute_scores(docs, 64.0)))
        assert score_texts(odd(spark, []), F.lit(False)).collect() == []
        unlearned = score_texts(odd(spark), F.lit(True)).select("base_score", "score", "train_tokens").distinct().collect()
        assert [tuple(r) for r in unlearned] == [(0.0, 0.0, 0)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_contexts_are_dealt_by_their_word():
    model = Model(1000, 10, 16)
    words = np.arange(500)
    assert len(set(model.shard(np.full(500, 7), words, np.full(500, 900)).tolist())) == 16
    assert len(set(model.shard(np.full(500, 7), words, np.full(500, 20)).tolist())) == 1


def features(text, low, high):
    table = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
    words = (text or "").encode().translate(table).split()
    return [b" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)], len(words)


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2), (2, 3)])
def test_weights_of_odd_rows(spark, ngrams):
    target = spark.createDataFrame([("beta gamma alpha",), (None,)], "text string")
    got = importance_weights(odd(spark), target, ngrams, 50).select("doc", "n_words", "n_features", "weight").collect()
    s, t = Counter(), Counter()
    for _, text, *_ in ODD:
        s.update(zlib.crc32(f) % 50 for f in features(text, *ngrams)[0])
    t.update(zlib.crc32(f) % 50 for f in features("beta gamma alpha", *ngrams)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 50) / ((s[b] + 1) * (sum(t.values()) + 50))))
    wanted = []
    for i, text, *_ in ODD:
        own, n = features(text, *ngrams)
        wanted.append((i, n, len(own), sum(gain(zlib.crc32(f) % 50) for f in own) // len(own) if own else 0))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))


def test_draws_of_odd_rows(spark):
    target = spark.createDataFrame([("beta",)], "text string")
    drawn = resample(odd(spark), target, share=(1, 2), least_words=1, ngrams=(1, 1)).collect()
    fit = sorted((r for r in drawn if r.n_words >= 1), key=lambda r: (-r.score, r.doc is None, r.doc or 0, r.block, r.place))
    assert [r["rank"] for r in fit] == [i + 1 if i < len(fit) // 2 else None for i in range(len(fit))]
    assert all(r["rank"] is None for r in drawn if not r.n_words)
    assert {r["rank"] for r in resample(odd(spark), target, least_words=10**9).collect()} == {None}
    assert resample(odd(spark, []), target).collect() == []
    assert {r.weight for r in importance_weights(odd(spark), target.limit(0), (1, 1), 1).collect()} == {0}


def brute_divergence(docs, least, ranks):
    count, documents, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    table = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256))
    for _, text, lang, source in docs:
        words = (text or "").encode().translate(table).split()
        count[lang or "", source or ""].update(words)
        documents[lang or ""].update(set(words))
        total[lang or ""].update(words)
    for (lang, source), own in count.items():
        kept = sorted(w for w, n in documents[lang].items() if n >= least)
        share = lambda c, w, kept=kept: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept))
        far = lambda p, q: (p - q) ** 2 // q
        pairs = [(sum(far(share(own, w), share(c, w)) for w in kept), other) for (la, other), c in count.items() if la == lang and other != source]
        terms = [(far(share(own, w), share(total[lang], w)), w.decode()) for w in kept if own[w] and share(own, w) > share(total[lang], w)]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                yield lang, source, part, item, value, rank


@pytest.mark.parametrize(("least", "ranks"), [(1, 200), (2, 1), (3, 200)])
def test_divergence_of_odd_rows(spark, least, ranks):
    order = ["lang", "source", "part", "item", "value", "rank"]
    got = source_divergence(odd(spark), least, ranks).select(order).collect()
    assert sorted(map(tuple, got)) == sorted(brute_divergence(ODD, least, ranks))
    assert source_divergence(odd(spark, []), least).collect() == []


def test_shares_are_exact_for_large_counts():
    counts, below = np.array([10**15, 3]), np.array([3 * 10**15 + 7, 11])
    assert shares(counts, below).tolist() == [1 + 10**9 * (c + 1) // b for c, b in zip(counts.tolist(), below.tolist(), strict=True)]
    assert divergence(np.array([10**9 + 1]), np.array([1])).tolist() == [10**18]
