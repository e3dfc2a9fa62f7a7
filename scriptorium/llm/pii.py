"""Personal data by candidate gradient boosting.

Generators of high recall propose overlapping spans; boosted trees judge each by its format and its surroundings;
a threshold for each kind, calibrated on held-out rows, selects what is redacted. The strict base patterns always
count; the trees add spans that those patterns miss: spelled-out addresses, national phone numbers, grouped card
numbers with other separators, addresses of six groups. Added spans overlap neither base spans nor each other: the
likelier one stays, of equally likely ones the first by start, kind and end. Generators propose every start with every
end (of the parts of a spelled address, of the numbers in a row), so that the trees choose among overlapping spans.

The trees learn from a synthetic corpus that is made here from a seed: planted data in many formats and look-alikes
(dates, sums, versions, serial numbers, measurements, hex digests), in invented words.

Null and empty texts have no spans, an empty table gives no rows. Whole texts are searched; the time grows with the
text and its candidates, for overlaps are looked up in sorted spans. Repeated rows get the same spans. Columns whose
names clash with the new ones are replaced. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scriptorium.llm.columns import with_text_columns
from scriptorium.llm.gbdt import Trees, fit

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Strict matches, leftmost and non-overlapping within a kind."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


HEX = "[0-9A-Fa-f]{1,4}"
LABEL = "[A-Za-z0-9-]{1,63}+"
#: What stands between the parts of an address that is written around: in place of a dot, and in place of the at sign.
DOT = r"(?:\.| \. |\s?[(\[{](?:dot|DOT)[)\]}]\s?| (?:dot|DOT) )"
AT = re.compile(rf"(?:\s?[(\[{{](?:at|AT)[)\]}}]\s?| (?:at|AT) |\s?@\s?)(?={LABEL}{DOT}{LABEL})")
PART = re.compile(rf"{DOT}{LABEL}")
#: A local part, read backwards from its end, and what may join it to one more word before it.
WORD_BACK = re.compile(r"[\w%+-][\w.%+-]{0,63}")
DOT_BACK = re.compile(r" (?:tod|TOD) |\s?[)\]}](?:tod|TOD)[(\[{]\s?")
HOST_PARTS, LOCAL_WORDS = 4, 3
#: Addresses of six groups: a part of one is none, so whole runs are proposed only.
GROUPED = (
    ((":",), re.compile(rf"(?<![0-9A-Fa-f:])(?:{HEX}:){{3,7}}:?{HEX}(?![0-9A-Fa-f:])")),
    (("::",), re.compile(rf"(?<![0-9A-Za-z:]){HEX}(?::{HEX}){{0,6}}::(?:{HEX}(?::{HEX}){{0,6}})?(?![0-9A-Za-z:])")),
    (("::",), re.compile(rf"(?<![0-9A-Za-z:])::{HEX}(?::{HEX}){{0,6}}(?![0-9A-Za-z:])")),
)
NUMBER = re.compile(r"(?:\(|(?<![0-9A-Za-z]))[0-9]{1,12}+(?:\)|(?![0-9A-Za-z]))")
WITHIN = re.compile("[0-9A-Za-z]")
BETWEEN = re.compile(r"[ ./_-]{1,2}")
NUMBERS, SCORED = 6, 20_000
#: Endings of hosts that are told from other words.
ENDINGS = frozenset("com org net edu gov io co uk de fr es it nl eu info example".split())


def spelled_addresses(text: str) -> set[Span]:
    """E-mail addresses that are written around: every local part of up to 3 words before a sign, every host after it."""
    found = set()
    for sign in AT.finditer(text):
        back = text[max(0, sign.start() - 270) : sign.start()][::-1]
        starts, at = [], 0
        while len(starts) < LOCAL_WORDS and (m := WORD_BACK.match(back, at)):
            starts.append(sign.start() - m.end())
            joint = DOT_BACK.match(back, m.end())
            if joint is None:
                break
            at = joint.end()
        end = re.compile(LABEL).match(text, sign.end()).end()
        for _ in range(HOST_PARTS):
            if (m := PART.match(text, end)) is None:
                break
            end = m.end()
            found.update((start, 0, end) for start in starts)
    return found


def numbers(text: str) -> set[Span]:
    """Cards and phones: every run of up to 6 neighbouring numbers that has the digits of one, whatever lies around it."""
    tokens = [(m.start(), m.end()) for m in NUMBER.finditer(text)]
    found = set()
    for i, (start, _) in enumerate(tokens):
        if start and WITHIN.match(text, start - 1):
            continue
        for j in range(i, min(i + NUMBERS, len(tokens))):
            if j > i:
                gap = text[tokens[j - 1][1] : tokens[j][0]]
                if not (BETWEEN.fullmatch(gap) or gap == "" and (text[tokens[j - 1][1] - 1] == ")" or text[tokens[j][0]] == "(")):
                    break
            own = text[start : tokens[j][1]]
            digits = "".join(DIGITS.findall(own))
            if len(digits) > 19:
                break
            if own.count("(") == own.count(")") and not WITHIN.match(text, tokens[j][1]):
                if len(digits) >= 12 and j > i and luhn(digits):
                    found.add((start, 2, start + len(own)))
                if (9 if i == j else 7) <= len(digits) <= 15:
                    found.add((start, 3, start + len(own)))
    return found


WORDS_NEAR = (
    ("call", "phone", "tel", "fax", "mobile", "cell", "dial", "sms", "whatsapp", "ring", "my number"),
    ("mail", "contact", "write", "reach"),
    ("card", "visa", "credit", "payment", "pay", "debit"),
    ("ip", "server", "host", "addr", "client", "login"),
    ("order", "invoice", "no.", "number", "id", "ref", "serial", "version", "isbn", "page", "date", "model", "total", "sum"),
)


class Taken:
    """Disjoint stretches of a text, in order; spans that overlap are one stretch."""

    def __init__(self, spans: Sequence[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: Span) -> bool:
        i = bisect_right(self.ends, span[0])
        return i < len(self.starts) and self.starts[i] < span[2]

    def add(self, span: Span) -> None:
        """A span that meets none."""
        i = bisect_left(self.starts, span[0])
        self.starts.insert(i, span[0])
        self.ends.insert(i, span[2])


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans that the generators propose and no base span overlaps; they may overlap each other."""
    found = spelled_addresses(text) | numbers(text)
    for needed, pattern in GROUPED:
        if any(n in text for n in needed):
            found.update((m.start(), 1, m.end()) for m in pattern.finditer(text))
    taken = Taken(base)
    return [c for c in sorted(found) if not taken.meets(c)] if base else sorted(found)


#: That a candidate is a part of something longer: numbers, a dot, a sign before it or after it.
CONTINUED_BEFORE = tuple(map(re.compile, (r"[0-9]\)?[ ./_-]{1,2}\(?$", r"(?:\.|\bdot[)\]}]?) ?$", r"(?:@|\bat[)\]}]?) ?$", r"[0-9a-z_+(]$")))
CONTINUED_AFTER = tuple(map(re.compile, (r"\)?[ ./_-]{1,2}\(?[0-9]", r"(?:\.| ?[(\[{]?dot[)\]}]? ?)[a-z0-9]", r" ?(?:@|[(\[{]at[)\]}]|at ) ?[a-z0-9]", r"[0-9a-z_)]")))


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    own = text[start:end]
    groups = DIGITS.findall(own)
    digits = "".join(groups)
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    near = before[-14:]
    own_end = re.split(r"[^A-Za-z0-9]+", own.lower().rstrip(")]}"))[-1]
    lengths = [len(g) for g in groups] or [0]
    first, last = text[start - 1 : start], text[end : end + 1]
    return [
        kind, len(own), len(digits), len(groups), max(lengths), min(lengths), lengths[0], lengths[-1],
        float(len(digits) >= 12 and luhn(digits)) if digits else 0.0, sum(map(str.isalpha, own)), own.count("."), own.count("-"), own.count(" "), own.count("/"), own.count(":"),
        own.count("::"), len(own.split(":")), float(any(map(str.isdigit, own)) and any(map(str.isalpha, own))), float("(" in own), float("@" in own), float("at" in own.lower()), float(own[:1] == "0"), float(own[:2] == "00"), float(
            own[:1] == "(",
        ),
        float(len(groups) > 0 and lengths[0] == 4 and groups[0][:2] in ("19", "20")), float(
            len(groups) == 3 and max(map(int, (g[-4:] for g in groups[:2]))) <= 31,
        ),
        float(len(groups) > 1 and len(set(lengths)) == 1), float(first.isspace() or not first), float(last.isspace() or not last), float(first in "$€£#"), float(
            last in "%€$",
        ),
        *(float(any(w in near for w in words)) for words in WORDS_NEAR), *(float(any(w in before for w in words)) for words in WORDS_NEAR), float(
            any(w in after for w in ("kg", "km", "cm", "mb", "eur", "usd", "am", "pm")),
        ),
        *(float(bool(p.search(before))) for p in CONTINUED_BEFORE), *(float(bool(p.match(after))) for p in CONTINUED_AFTER), float(own_end in ENDINGS),
        float(" AT " in own or "@" in own), float(any(b in own for b in "([{")), float(len(re.findall("dot|DOT|[.]", own))), *lengths[1:4], *([0] * (3 - len(lengths[1:4]))),
    ]


def synthetic_text(rng: random.Random) -> tuple[str, list[Span]]:
    """Invented words with planted personal data (whose spans are returned) and look-alikes."""
    syllables = "ka lo mi ren sta tor ve zu an el in ou ber sch tion que ado".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    sep = rng.choice(" -.")
    some = lambda *xs: rng.choice(xs)
    groups = lambda n: [f"{rng.randrange(1, 65536):x}" for _ in range(n)]

    def card(between: str) -> str:
        body = some("4", "5") + d(14)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        return between.join(digits[i : i + 4] for i in range(0, 16, 4))

    def planted() -> tuple[int, str, str]:
        kind = rng.randrange(4)
        name, host, tld = f"{word()}{some('', '.', '_')}{word()}", word(), some(*sorted(ENDINGS))
        a, b, up = word(), word(), some(str.upper, str)
        return kind, *(
            (
                some("mail ", "contact ", "write to ", "reach me at ", "mail us at ", "me at ", f"{word()} is ", ""),
                some(
                    f"{a} dot {b} at {host} dot {tld}",
                    f"{up(a)} DOT {up(b)} AT {up(host)} DOT {up(tld)}",
                    f"{a}(dot){b}(at){host}(dot){tld}",
                    f"{a} [dot] {b} [at] {host} [dot] {tld}",
                    f"{name} AT {host}.{tld}",
                    f"{name} AT {host} DOT {tld}",
                    f"{name} at {word()} dot {host} dot {tld}",
                    f"{name}{{at}}{word()}.{host}.{tld}",
                    f"{name} (at) {host} (dot) {tld}",
                    f"{name}[at]{host}.{tld}",
                    f"{name} at {host} dot {tld}",
                    f"{name} @ {host}.{tld}",
                    f"{name}(at){host}.{tld}",
                ),
            ),
            (
                some("server ", "host ", "ip ", ""),
                some(
                    ":".join(groups(8)),
                    ":".join(groups(8)),
                    f"{':'.join(groups(rng.randint(2, 4)))}::{':'.join(groups(rng.randint(1, 3)))}",
                    f"fe80::{':'.join(groups(rng.randint(1, 4)))}",
                    f"2001:db8::{groups(1)[0]}",
                    f"{':'.join(groups(4))}::",
                ),
            ),
            (some("card ", "visa ", "pay with ", ""), card(some(".", "/", "  ", "_"))),
            (
                some("call ", "tel ", "phone: ", "fax ", "mobile ", "ring ", "my number is ", "sms ", "reach me on ", "or ", ""),
                some(
                    f"1-{d(3)}-{d(3)}-{d(4)}",
                    f"1{sep}({d(3)}){some(' ', '')}{d(3)}-{d(4)}",
                    f"(0){d(2)} {d(4)} {d(4)}",
                    f"{d(3)}.{d(3)}.{d(4)}",
                    f"({d(3)}) {d(3)}{sep}{d(4)}",
                    f"{d(3)}{sep}{d(3)}{sep}{d(4)}",
                    f"0{d(3)}{some(' ', '/', '-')}{d(7)[:4]}{sep}{d(3)}",
                    f"0049 {d(3)} {d(4)} {d(3)}",
                    f"0{d(2)} {d(4)} {d(4)}",
                    f"{some('2', '5', '7')}{d(9)}",
                    f"0{d(rng.randint(8, 10))}",
                ),
            ),
        )[kind]

    def look_alike() -> str:
        return some(
            f"{some('order', 'invoice', 'ref', 'serial', 'id', 'model')} {d(rng.randint(3, 6))}{some('-', '.', '/', ' ')}{d(rng.randint(3, 5))}{some('-', '.', '/')}{d(rng.randint(3, 5))}", f"{some('on', 'date', 'since')} {some('19', '20')}{d(2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{d(2)}",
            f"version {d(1)}.{d(2)}.{d(3)}", f"{d(3)} {d(3)} {d(3)} {some('eur', 'usd', 'kg', 'km')}", f"{d(2)}:{d(2)}:{d(2)}", f"isbn 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{word()} at {word()} on dot {word()}", f"{d(3)}.{d(3)}.{d(3)}", f"pages {d(3)}-{d(3)}", f"{d(8)}-{d(4)}", f"{d(3)}-{d(4)}",
            f"{d(4)} {d(4)} {d(4)}", f"at (at) {word()}", f"{some('visit us', 'see', 'look', 'more', 'found', word())} at {word()}.{some(*sorted(ENDINGS))}", f"{word()} at {word()} dot {word()}",
            f"{word()} at {word()}.{word()}", f"{d(3)} {d(4)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(4)}-{d(4)}", f"{some('figures', 'of', 'values')} {d(2)} {d(3)} {d(4)} {d(2)} {d(3)}", f"{rng.getrandbits(48):x}:{rng.getrandbits(8):x}", f"{d(4)} {d(3)} {d(4)}", f"{d(2)} {d(3)}", f"{d(3)} {d(4)} {d(3)} {d(3)}",
            f"{some('order', 'invoice', 'ref', 'serial', 'id', 'isbn', 'page', 'model', 'total')} {d(rng.randint(9, 11))}", f"{d(rng.randint(9, 11))} {some('eur', 'usd', 'kg', 'mb')}", d(
                rng.randint(9, 11),
            ),
            f"{some('add', 'dead', 'face', 'a', 'bad')}::{some('beef', 'cafe', 'b', 'c')}", f"{word()}::{some('add', 'b', 'f')}", f"{rng.randint(1, 23)}::{d(2)}", f"::{some('add', 'c')}",
        )

    parts, spans, at = [], [], 0
    for _ in range(rng.randint(2, 6)):
        lead = " ".join(word() for _ in range(rng.randint(2, 12))) + " "
        if rng.random() < 0.5:
            kind, intro, own = planted()
            spans.append((at + len(lead) + len(intro), kind, at + len(lead) + len(intro) + len(own)))
            lead += intro + own
        else:
            lead += look_alike()
        lead += some(" ", ", ", ". ", "\n")
        parts.append(lead)
        at += len(lead)
    return "".join(parts), spans


@dataclass
class Selector:
    trees: Trees
    thresholds: np.ndarray

    def scores(self, texts: Sequence[str], proposed: Sequence[list[Span]]) -> list[np.ndarray]:
        """The likelihoods of each text's candidates; features are held for SCORED candidates at a time."""
        pairs, flat = [(t, c) for t, cs in zip(texts, proposed, strict=True) for c in cs], [np.zeros(0)]
        for at in range(0, len(pairs), SCORED):
            flat.append(self.trees.probabilities(np.array([features(t, c) for t, c in pairs[at : at + SCORED]])))
        return np.split(np.concatenate(flat), np.cumsum([len(cs) for cs in proposed])[:-1])

    def added(self, proposed: list[Span], scores: np.ndarray) -> list[Span]:
        """The likeliest spans first, none that overlaps one chosen before."""
        chosen, taken = [], Taken()
        for i in np.argsort(-scores, kind="stable"):
            c = proposed[i]
            if scores[i] >= self.thresholds[c[1]] and not taken.meets(c):
                taken.add(c)
                chosen.append(c)
        return chosen


def learn_selector(texts: int = 4000, seed: int = 11, precision: float = 0.995) -> Selector:
    """Trees on one half of the synthetic corpus; thresholds from the other half.

    A kind's threshold is the lowest from which on its candidates hold the wanted precision, and at least 0.5.
    """
    rng, rows, right, of_text = random.Random(seed), [], [], []
    for t in range(texts):
        text, spans = synthetic_text(rng)
        for c in candidates(text, base_spans(text)):
            rows.append(features(text, c))
            right.append(float(c in spans))
            of_text.append(t)
    x, y, first = np.array(rows), np.array(right), np.array(of_text) % 2 == 0
    trees = fit(x[first], y[first], trees=60, depth=4)
    scores, thresholds = trees.probabilities(x[~first]), np.full(len(KINDS), 0.5)
    for k in range(len(KINDS)):
        own = x[~first, 0] == k
        order = np.argsort(-scores[own])
        hits = np.cumsum(y[~first][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(hits >= precision)
        thresholds[k] = max(0.5, scores[own][order][good[-1]]) if len(good) else 1.1
    return Selector(trees, thresholds)


def find_personal_data(docs: DataFrame, selector: Selector, text: str = "text", replace: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with counts of base spans, base_sha256, spans and n_spans, or, with replace, with the spans replaced in the text.

    replace: a pattern for str.format, given the kind in capitals, such as `<{}>`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(selector)
    counts = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    new = [*counts, *(T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")), T.StructField("n_spans", T.LongType())]

    def all_spans(texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
        base = [base_spans(t) for t in texts]
        proposed = [candidates(t, b) for t, b in zip(texts, base, strict=True)]
        scores = sent.value.scores(texts, proposed) if texts else []
        return base, [sorted([*b, *sent.value.added(cs, own)]) for b, cs, own in zip(base, proposed, scores, strict=True)]

    def described(texts: list[str | None]) -> tuple:
        base, spans = all_spans([t or "" for t in texts])
        kinds = [[k for _, k, _ in b] for b in base]
        return *([ks.count(i) for ks in kinds] for i in range(len(KINDS))), [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], [joined(s) for s in spans], list(
            map(len, spans),
        )

    def replaced(texts: list[str | None]) -> tuple:
        return ([t if not s else redacted(t, s, replace) for t, s in zip(texts, all_spans([t or "" for t in texts])[1], strict=True)],)

    if replace is None:
        return with_text_columns(docs, text, described, new, drop)
    return with_text_columns(docs, text, replaced, (docs.schema[text],), drop)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[Span], replace: str) -> str:
    """text with spans replaced; where spans of two kinds overlap, the first names what stands for both."""
    out, last = [], 0
    for start, kind, end in spans:
        if start >= last:
            out.append(text[last:start])
            out.append(replace.format(KINDS[kind].upper()))
        last = max(last, end)
    out.append(text[last:])
    return "".join(out)
