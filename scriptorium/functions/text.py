"""Scalar text functions as Column expressions (normalisation, identifiers, word matching, quotes, labels).

Patterns spell their character classes out, for Java's \\s, \\b, \\w and $ differ from what is meant here. Null in
gives null out unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.dimensions import APPENDIX_ALIASES, APPENDIX_TRIGGERS

#: Unicode White_Space, the ASCII space class, and the characters of a word.
BLANK = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE = r"[\t\n\f\r ]"
WORD = r"[\p{L}\p{Nd}_]"
NOT_AFTER_WORD, NOT_BEFORE_WORD = rf"(?<!{WORD})", rf"(?!{WORD})"
ASCII_WORD = "[A-Za-z0-9_]"


def is_word(c: str) -> bool:
    """Whether a character of Python text is a letter, a decimal digit or the underscore; as WORD for columns."""
    return c.isalpha() or c.isdecimal() or c == "_"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once: a column that lambdas use would be computed at each of their steps,
    for the optimizer puts its expression in its place."""
    return F.transform(F.array(value), body)[0]


def trim_blank(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A[{BLANK}]+|[{BLANK}]+\z", "")


def trim_chars(s: Column, chars: str, left: bool = True) -> Column:
    """Strip any of chars from the end and, if left, from the start."""
    own = "[" + "".join("\\" + c for c in chars) + "]+"
    return F.regexp_replace(s, (rf"\A{own}|" if left else "") + rf"{own}\z", "")


def replaced(s: Column, characters: str, by: Sequence[str]) -> Column:
    """Each of a few rare characters replaced: faster on long texts than a look at every character."""
    for c, to in zip(characters, by, strict=True):
        s = F.replace(s, F.lit(c), F.lit(to))
    return s


def lower_simple(s: Column) -> Column:
    """Lower case one character at a time: no dotless combination for I with dot, no final sigma."""
    return F.lower(replaced(s, "\u0130\u03A3", "i\u03c3"))


def normalize(raw: Column) -> Column:
    """Trimmed, lower-cased, single-spaced, without trailing colons, dots and spaces."""
    return trim_chars(F.regexp_replace(lower_simple(trim_blank(raw)), rf"{SPACE}+", " "), ":. ", left=False)


#: Section identifiers, stripped in this order.
IDENTIFIERS = (
    rf"\Asection{SPACE}+\d+[a-z]?{SPACE}*[:.\-]{SPACE}*",
    rf"\A\d+(\.\d+)*{SPACE}*[.:\-]?{SPACE}+",
    rf"\A[ivxlcdm]+{SPACE}*[.)]{SPACE}+",
    rf"\A[a-z]{SPACE}*[.)]{SPACE}+",
)


def strip_identifiers(s: Column) -> Column:
    """A normalised heading without its leading number, letter or section word."""
    for pattern in IDENTIFIERS:
        s = F.regexp_replace(s, pattern, "")
    return trim_blank(trim_chars(s, ":. "))


LABELLED = rf"\A([A-Za-z0-9]{{1,3}})(?!{ASCII_WORD}){SPACE}*(?:[:.\-]{SPACE}*)?([^\n]*)\z"


def parse_container(s: Column) -> Column:
    """struct(container, label, remainder): `appendix` and its label, or null and the heading itself."""
    s = trim_blank(s)
    trigger = F.coalesce(*(F.when(F.startswith(s, F.lit(t)), F.lit(t)) for t in APPENDIX_TRIGGERS))
    rest = trim_blank(F.substring(s, F.length(trigger) + 1, F.length(s)))
    labelled = F.regexp_like(rest, F.lit(LABELLED))
    nothing = F.lit(None).cast("string")

    def outcome(container: Column, label: Column, remainder: Column) -> Column:
        return F.struct(container.alias("container"), label.alias("label"), remainder.alias("remainder"))

    return (
        F.when(s.isin(*APPENDIX_ALIASES), outcome(F.lit("appendix"), nothing, F.lit("")))
        .when(trigger.isNull(), outcome(nothing, nothing, s))
        .when(rest == "", outcome(F.lit("appendix"), nothing, F.lit("")))
        .when(
            labelled,
            outcome(
                F.lit("appendix"),
                F.upper(F.regexp_extract(rest, LABELLED, 1)),
                trim_chars(F.regexp_extract(rest, LABELLED, 2), " :.-"),
            ),
        )
        .otherwise(outcome(F.lit("appendix"), nothing, trim_chars(rest, " :.-")))
    )


def byte_offset(s: Column, place: Column) -> Column:
    """The byte offset of the 1-based character place."""
    return F.octet_length(F.substring(s, F.lit(1), place - 1))


def whole_word_places(s: Column, word: Column) -> Column:
    """The 1-based places of every occurrence of word, overlapping ones too, that no word character touches."""
    n = F.length(word)
    last = F.length(s) - n + 1
    places = F.when((n > 0) & (last > 0), F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))

    def free(i: Column) -> Column:
        return (
            (F.substring(s, i, n) == word)
            & ~F.substring(s, i + n, F.lit(1)).rlike(WORD)
            & ~F.when(i > 1, F.substring(s, i - 1, F.lit(1))).otherwise(F.lit("")).rlike(WORD)
        )

    return F.filter(places, free)


def contains_whole_word(s: Column, word: Column) -> Column:
    return F.size(whole_word_places(s, word)) > 0


def count_pattern(word: str) -> str:
    """A pattern that matches at every whole occurrence of word, one plural s allowed.

    A word that can't overlap itself is consumed, so that the pattern begins with a literal and is searched for fast.
    """
    if any(word[:k] == word[-k:] for k in range(1, len(word))):
        return rf"{NOT_AFTER_WORD}(?=\Q{word}\Es?+{NOT_BEFORE_WORD})"
    return rf"\Q{word}\E(?<={NOT_AFTER_WORD}\Q{word}\E)(?=s?+{NOT_BEFORE_WORD})"


def count_whole_word(s: Column, word: str) -> Column:
    return F.when(F.contains(s, F.lit(word)), F.regexp_count(s, F.lit(count_pattern(word)))).otherwise(0) if word else F.lit(0)


#: Typographic characters and what they are folded to; the zero-width ones are dropped.
APOSTROPHES, QUOTES, DASHES = "\u2018\u2019\u02BC\u00B4`", "\u201C\u201D\u201E", "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
ZERO_WIDTH, ELLIPSIS = "\u200B\u200C\u200D\uFEFF", "\u2026"


def normalise_quote(s: Column) -> Column:
    """Typography folded, white space collapsed, case kept."""
    folded = replaced(
        s,
        APOSTROPHES + QUOTES + DASHES + ZERO_WIDTH,
        [*"'" * len(APOSTROPHES), *'"' * len(QUOTES), *"-" * len(DASHES), *[""] * len(ZERO_WIDTH)],
    )
    return F.trim(F.regexp_replace(F.replace(folded, F.lit(ELLIPSIS), F.lit("...")), rf"[{BLANK}]+", " "))


def quote_found(normalised_text: Column, quote: Column) -> Column:
    own = normalise_quote(quote)
    return F.coalesce((own != "") & F.contains(normalised_text, own), F.lit(False))


def between(s: Column, start: str, end: str) -> Column:
    """The text between the first start and the first end after it; null where either is missing."""
    rest = F.when(F.contains(s, F.lit(start)), F.substring(s, F.locate(start, s) + len(start), F.length(s)))
    return F.when(F.contains(rest, F.lit(end)), F.substring_index(rest, end, 1))


def group_of(label: Column) -> Column:
    """The leading digits of a study label, or all of it."""
    return F.coalesce(F.nullif(F.regexp_extract(label, r"\A[0-9]+", 0), F.lit("")), label)


#: What a kind of study part begins with.
KIND_PREFIXES = (
    ("stud", "study"),
    ("experiment", "experiment"),
    ("phase", "phase"),
    ("sample", "sample"),
    ("dataset", "dataset"),
    ("data set", "dataset"),
    ("wave", "wave"),
    ("round", "round"),
)


def normalise_kind(s: Column) -> Column:
    low = F.lower(s)
    return F.coalesce(*(F.when(F.startswith(low, F.lit(p)), F.lit(k)) for p, k in KIND_PREFIXES), low)


def is_heading_line(line: Column) -> Column:
    return F.startswith(F.ltrim(line), F.lit("#"))


def sort_labels(labels: Column) -> Column:
    """Numbers first in their order, then the rest by text."""
    keyed = F.transform(
        labels,
        lambda x: F.struct(F.when(x.try_cast("int").isNull(), 1).otherwise(0).alias("kind"), F.coalesce(x.try_cast("int"), F.lit(0)).alias("n"), x.alias("label")),
    )
    return F.transform(F.array_sort(keyed), lambda x: x["label"])


def is_pipe_row(line: Column) -> Column:
    s = trim_blank(line)
    return (F.octet_length(s) > 2) & F.startswith(s, F.lit("|")) & F.endswith(s, F.lit("|"))


def split_row(line: Column) -> Column:
    """The trimmed cells of a pipe row."""
    s = F.regexp_replace(F.regexp_replace(trim_blank(line), r"\A\|", ""), r"\|\z", "")
    return F.transform(F.split(s, r"\|"), trim_blank)


def is_separator_row(line: Column) -> Column:
    return is_pipe_row(line) & F.forall(split_row(line), lambda c: F.regexp_like(c, F.lit(r"\A[:\- ]*\z")))


def contains_latex(lines: Column) -> Column:
    return F.exists(lines, lambda x: F.contains(x, F.lit("$")) | F.contains(x, F.lit("\\mathrm")))


def parse_crop(url: Column) -> Column:
    """struct(page, crop_x, crop_y, crop_width, crop_height) of an image url; 0 for what is missing."""
    path = F.regexp_extract(url, r"\A([^?#]*)", 1)
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)

    def number(name: str) -> Column:
        return F.coalesce(F.regexp_extract(query, rf"(?:\A|&){name}=([+-]?[0-9]+)(?:&|\z)", 1).try_cast("int"), F.lit(0))

    page = F.coalesce(F.regexp_extract(path, r"-([0-9]+)\.[A-Za-z]+\z", 1).try_cast("int"), F.lit(0))
    return F.struct(
        page.alias("page"),
        number("top_left_x").alias("crop_x"),
        number("top_left_y").alias("crop_y"),
        number("width").alias("crop_width"),
        number("height").alias("crop_height"),
    )


def extract_title(markdown: Column, lines: int = 10) -> Column:
    """The first of the first lines that is a heading of level one, without its mark; null if none is."""
    heads = F.filter(F.transform(F.slice(F.split(markdown, "\n"), 1, lines), trim_blank), lambda x: F.startswith(x, F.lit("# ")))
    return trim_blank(F.substring(F.try_element_at(heads, F.lit(1)), F.lit(3), F.length(markdown)))


def excerpt(s: Column, length: int) -> Column:
    """At most length characters, never half of one."""
    return F.when(F.length(s) > length, F.concat(F.left(s, F.lit(length)), F.lit("..."))).otherwise(s)


def word_count(s: Column) -> Column:
    return F.size(F.filter(F.split(s, rf"[{BLANK}]+"), lambda w: w != ""))


def literal_array(values: Sequence[str]) -> Column:
    """An array that the optimizer folds from one literal, however many values it has. No value may hold a newline."""
    return F.split(F.lit("\n".join(values)), "\n") if values else F.array().cast("array<string>")


def looked_up(key: Column, table: dict[str, str]) -> Column:
    """The value of key in a small literal table; null of any other key."""
    return F.get(literal_array(list(table.values())), (F.array_position(literal_array(list(table)), key) - 1).cast("int"))
