"""Chat formatting by event sourcing, in DataFrame functions only.

A log holds events of conversations: `message` (a whole text), `start` (opens an empty message), `delta` (appends),
`edit` (replaces the text), `regenerate` (drops the text so far; deltas build it anew). Events name their message;
within it they apply in the order of seq. The fold of a message is the text of its last resetting event and of the
deltas after it, so it needs no accumulator that grows with every step. Events that name no message are messages of
their own, each as it stands; repeated rows are repeated messages.

Messages stand in the order of the first seq of their events, a null seq last; messages of the same seq stand by role,
then text. A conversation is rendered in chunks of CHUNK sequence numbers, so that a hot one spreads over many tasks,
or, where its whole text is wanted, at once.

Null text counts as empty, a null role too; a conversation id may be null and is then one conversation. Texts of any
length are kept whole; a rendered chunk is one string and so bounded by 2 GB. An empty log gives no rows. Other columns
are not looked at.

The template marks a turn as START role newline text END newline. Inside roles and texts `&` becomes `&amp;` and `<|`
becomes `&lt;|`; in roles a newline becomes `&#10;`. No control string is left inside, and the way back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
CHUNK = 64
RESETS = ("message", "start", "edit", "regenerate")
#: Where a null seq stands.
LAST = (1 << 63) - 1


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages of a log with columns conv_id, seq, kind, message, role, text.

    Returns conv_id, seq (of the message's first event), role (the last that an event names), text.
    """
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(LAST))
    event = F.struct(
        seq.alias("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # events without a message meet by their seq, which spreads them as messages are spread
    alone = F.when(F.col("message").isNull(), seq).alias("_alone")
    log = events.groupBy("conv_id", "message", alone).agg(F.array_sort(F.collect_list(event)).alias("log"))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*RESETS), i + 1).otherwise(1)))
    live = F.slice("log", last, F.size("log"))
    texts = F.transform(live, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"]))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    role = F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit(""))
    folded = F.array(F.struct(F.col("log")[0]["seq"].alias("seq"), role.alias("role"), F.array_join(texts, "").alias("text")))
    whole = F.transform(
        "log",
        lambda e: F.struct(e["seq"].alias("seq"), F.coalesce(e["role"], F.lit("")).alias("role"), e["text"].alias("text")),
    )
    return log.select("conv_id", F.inline(F.when(F.col("message").isNull(), whole).otherwise(folded)))


def render(messages: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """Chunks of formatted conversations: conv_id, chunk, formatted, loss (spans of assistant texts, in code points).

    chunk: sequence numbers of a chunk; None makes each conversation one chunk.
    """
    turn = F.struct("seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["conv_id"] if chunk is None else ["conv_id", F.floor(F.col("seq") / chunk).alias("chunk")]
    chunks = messages.groupBy(*keys).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    chunks = chunks.withColumn("chunk", F.lit(0).cast("long")) if chunk is None else chunks
    marked = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("learn"),
        ),
    )
    spans = F.aggregate(
        "marked",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            (
                F.when(
                    t["learn"],
                    F.concat(
                        s["spans"],
                        F.array(F.struct((s["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))),
                    ),
                )
                .otherwise(s["spans"])
                .alias("spans")
            ),
        ),
    )["spans"]
    formatted = F.array_join(F.transform("marked", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return chunks.select("conv_id", "chunk", marked.alias("marked")).select(
        "conv_id",
        "chunk",
        formatted.alias("formatted"),
        spans.alias("loss"),
    )


def read_back(chunks: DataFrame) -> DataFrame:
    """Turns and learnt text parsed from formatted chunks: conv_id, chunk, turns (role, text), loss_text, formatted."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.replace(F.substring(F.substring_index(p, "\n", 1), len(START) + 1, F.length(p)), F.lit("&#10;"), F.lit("\n"))).alias(
                "role",
            ),
            unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text"),
        ),
    )
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    return chunks.select("conv_id", "chunk", "formatted", "loss", turns.alias("turns"), learnt.alias("loss_text"))


def conversations(chunks: DataFrame) -> DataFrame:
    """Whole conversations from chunks: conv_id, formatted and loss spans over the whole text.

    One value for each conversation: what a writer of training files needs.
    """
    parts = F.array_sort(F.collect_list(F.struct("chunk", "formatted", "loss")))
    return chunks.groupBy("conv_id").agg(parts.alias("parts")).select(
        "conv_id",
        F.array_join(F.col("parts.formatted"), "").alias("formatted"),
        F.aggregate(
            "parts",
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
            lambda s, p: F.struct((s["at"] + F.length(p["formatted"])).alias("at"), F.concat(s["loss"], F.transform(p["loss"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), x["length"].alias("length")))).alias("loss")),
        )["loss"].alias("loss"),
    )


def digests(messages: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations, a row for each.

    A digest needs a conversation's whole text in one row, so each is rendered as one chunk: no exchange follows.
    """
    part = read_back(render(messages, chunk=None))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return part.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
