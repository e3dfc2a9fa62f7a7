"""URL filter: a blocked Bloom filter over listed canonical URLs, then an exact hash join.

A rule is (host, path, verdict). It fits its host and every subdomain when the url's path starts with the rule's path;
the longest rule wins, then the longer host, then block. A url spells a candidate key for each shape (number of host
labels, length of path) that any rule has; the Bloom filter drops nearly all keys that no rule spells, and the join on
the keys themselves removes its false positives. The filter is a literal of at most `max_bits` bits; a longer list
only lets more keys through to the join.

A url with several possible keys comes back together by its ids and url; rows repeated in one partition are judged
once and counted, so that no task gathers or rebuilds all repeats of a row. A list that is too large to be broadcast is
joined by a shuffle, which urls without a possible key go past; adaptive execution splits the keys that many urls spell
(both sides have an exchange of their own).

Null urls and urls without `://` have an empty host and path and fit no rule. Repeated rows are returned as often as
they came. Ids may be null; columns beside ids and url are not looked at. An empty list lets everything pass, an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd multipliers below 2^31, one for each word of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x0824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31)
WORDS = len(SALTS)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there to `?`, `#` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and the bit that it sets in each of the block's words."""
    h = F.xxhash64(key)
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))
    return F.pmod(F.shiftrightunsigned(h, 31), F.lit(blocks)).cast("int"), [
        F.shiftright((low * s).bitwiseAND(F.lit(0x7FFFFFFF)), 26).cast("int") for s in SALTS
    ]


def _shift(one: Column, by: Column) -> Column:
    return F.call_function("shiftleft", one, by)


class BlockedBloom:
    """Blocks of eight words of 32 bits; a key sets one bit in each word of its block."""

    def __init__(self, keys: DataFrame, key: str, bits_per_key: int = 16, max_bits: int = 1 << 23):
        wanted = keys.count() * bits_per_key
        self.blocks = max(1, min(max_bits, wanted) // (32 * WORDS))
        block, bits = _bits(F.col(key), self.blocks)
        # one row for each block that has a key: at most max_bits / 256, whatever the list's size
        rows = (
            keys.select(block.alias("b"), *(_shift(F.lit(1).cast("long"), x).alias(f"w{i}") for i, x in enumerate(bits)))
            .groupBy("b")
            .agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
            .collect()
        )
        words = [0] * (self.blocks * WORDS)
        for r in rows:
            words[r["b"] * WORDS : (r["b"] + 1) * WORDS] = r[1:]
        self.words = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def may_hold(self, key: Column) -> Column:
        block, bits = _bits(key, self.blocks)
        found = F.lit(True)
        for i, bit in enumerate(bits):
            found = found & (F.call_function("shiftright", F.get(self.words, block * WORDS + i), bit).bitwiseAND(F.lit(1)) == 1)
        return found


def filter_urls(pages: DataFrame, rules: DataFrame, id_columns: Sequence[str], url: str = "url", default: str = "allow", broadcast_rows: int = 100_000) -> DataFrame:
    """Judge every url: id columns, host, path, rule (host and path of the rule that won, or null) and verdict.

    rules: columns host, path, verdict. A list of more than broadcast_rows keys is joined by a shuffle instead.
    """
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), F.col("verdict").alias("_v")).filter(
        "_h is not null and _h <> ''",
    )
    listed = (
        listed.groupBy(F.concat("_h", "_p").alias("_key"), "_h")
        .agg(F.max("_v").alias("_v"))
        .select(
            "_key",
            F.length("_h").alias("_hl"),
            "_v",
            F.size(F.split("_h", r"\.")).alias("_n"),
            (F.length("_key") - F.length("_h")).alias("_l"),
        )
    )
    shapes = [(r["_n"], r["_l"]) for r in listed.select("_n", "_l").distinct().collect()]
    ids = list(id_columns)
    # one row for each different page of a partition; repeated rows come back at the end
    rows = pages.select(*ids, F.col(url).alias("_url"), F.spark_partition_id().alias("_part"))
    different = rows.groupBy(*ids, "_url", "_part").agg(F.count(F.lit(1)).alias("_copies"))
    judged = different.withColumns(dict(zip(("host", "path"), host_and_path(F.col("_url")), strict=True)))
    out = [*ids, "_copies", "host", "path"]
    plain = [F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")]
    if not shapes:
        found = judged.select(*out, *plain)
    else:
        bloom = BlockedBloom(listed, "_key")
        labels = F.size(F.split("host", r"\."))
        spelled = F.array(
            *(
                F.when(
                    (labels >= n) & (F.length("path") >= l),
                    F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, l) if l else F.lit("")),
                )
                for n, l in shapes
            )
        )
        judged = judged.withColumn("_keys", F.filter(spelled, lambda k: k.isNotNull() & bloom.may_hold(k)))
        small = listed.limit(broadcast_rows + 1).count() <= broadcast_rows
        # in a shuffle, urls without a possible key would all meet under null: they go past it
        spelling = judged.withColumn("_key", F.explode_outer("_keys")) if small else judged.withColumn("_key", F.explode("_keys"))
        exact = spelling.join(F.broadcast(listed) if small else listed, "_key", "left")
        rank = F.when(F.col("_v").isNotNull(), F.struct(F.length("_key"), "_hl", F.col("_v") == "block"))
        own = F.concat(F.substring("_key", F.lit(1), F.col("_hl")), F.substring("_key", F.col("_hl") + 1, F.length("_key")))
        best = F.max_by(F.struct(own.alias("rule"), F.col("_v").alias("verdict")), rank).alias("_best")
        best = exact.groupBy(*ids, "_url", "_part", "_copies", "host", "path").agg(best)
        found = best.select(*out, F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
        found = found if small else found.union(judged.filter(F.size("_keys") == 0).select(*out, *plain))
    again = F.explode(F.array_repeat(F.struct("host", "path", "rule", "verdict"), F.col("_copies").cast("int")))
    return found.select(*ids, again.alias("_x")).select(*ids, "_x.*")
