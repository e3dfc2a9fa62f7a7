"""Headings of markdown documents: a block scan of ATX headings, and an inferred references heading.

The scan is the one step that needs Python; it runs once for each document, in Arrow batches, and returns an array of
small structs, so that everything after it is native and the text is left behind.

Null and empty markdown has no headings. Offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
from pyspark.sql import Column

from scriptorium.functions.dimensions import APPENDIX_ALIASES, APPENDIX_TRIGGERS, KEYWORD_ROLE
from scriptorium.functions.text import is_word
from scriptorium.sources.lines import WHITE, scanned

HEADINGS = "array<struct<level:int,byte_start:int,text_start:int,text_stop:int,span_start:int,inferred:boolean,text:string,parent:int,stop:int,matches:array<struct<keyword:string,role:string,start:int,end:int,suppressed_by:string>>>>"
Heading = tuple[int, int, int, int, int, bool, str]

ATX = re.compile(rb"(#{1,6})(?:[ \t]+|$)")
FENCE = re.compile(rb"(`{3,}|~{3,})(.*)$")
BREAK = re.compile(rb"(?:(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|(?:\*[ \t]*){3,})$")
# The block elements of CommonMark's sixth kind of HTML block.
BLOCK_TAGS = """address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div
dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link
main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr
track ul""".split()
HTML_STARTS = (
    (re.compile(rb"<(?:script|pre|style|textarea)(?:[ \t>]|$)", re.I), re.compile(rb"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(rb"<!--"), re.compile(rb"-->")),
    (re.compile(rb"<\?"), re.compile(rb"\?>")),
    (re.compile(rb"<![A-Za-z]"), re.compile(rb">")),
    (re.compile(rb"<!\[CDATA\["), re.compile(rb"\]\]>")),
    (re.compile(rb"</?(?:" + "|".join(BLOCK_TAGS).encode() + rb")(?:[ \t]|/?>|$)", re.I), None),
)
LONE_TAG = re.compile(
    rb"(?:<[A-Za-z][A-Za-z0-9-]*(?:[ \t]+[A-Za-z_:][\w.:-]*(?:[ \t]*=[ \t]*(?:[^ \t\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*[ \t]*/?>|</[A-Za-z][A-Za-z0-9-]*[ \t]*>)[ \t]*$",
)


def indent_of(line: bytes) -> tuple[int, int]:
    """Columns of leading white space (a tab goes to the next stop of four) and its bytes."""
    columns = at = 0
    for at, c in enumerate(line):
        if c == 32:
            columns += 1
        elif c == 9:
            columns += 4 - columns % 4
        else:
            return columns, at
    return columns, len(line)


def scan_headings(source: bytes) -> list[Heading]:
    """ATX headings outside fences, display mathematics, indented code and HTML blocks, in the order of the text."""
    found: list[Heading] = []
    mode, closer, paragraph, start = "", None, False, 0
    for raw in source.split(b"\n"):
        at, start = start, start + len(raw) + 1
        line = raw.rstrip(b"\r")
        columns, lead = indent_of(line)
        body = line[lead:]
        blank = not body.strip()
        if mode == "math":
            mode = "" if b"$$" in raw else mode
            continue
        if mode == "fence":
            if columns <= 3 and body.rstrip() and body.rstrip() == body[:1] * len(body.rstrip()) and body[:1] == closer[:1] and len(body.rstrip()) >= len(closer):
                mode = ""
            continue
        if mode == "html":
            if closer is None and blank or closer is not None and closer.search(line):
                mode = ""
            continue
        if blank:
            paragraph = False
            continue
        if columns >= 4:
            continue  # code, or the continuation of a paragraph
        if BREAK.match(body):
            paragraph = False
            continue
        if body.startswith(b"$$"):
            mode, paragraph = ("" if b"$$" in body[2:] else "math"), False
            continue
        if m := ATX.match(body):
            first = at + lead
            text = body[m.end() :].rstrip(b" \t\r")
            closing = text.rstrip(b"#")
            if closing != text and (not closing or closing[-1:] in b" \t"):
                text = closing.rstrip(b" \t")
            begin = first + m.end() if text else first
            end = source.find(b"\n", begin + len(text))
            found.append(
                (len(m[1]), first, begin, begin + len(text), len(source) if end < 0 else end, False, text.decode("utf-8", "replace")),
            )
            paragraph = False
            continue
        if (m := FENCE.match(body)) and not (m[1][:1] == b"`" and b"`" in m[2]):
            mode, closer, paragraph = "fence", m[1], False
            continue
        if body[:1] == b"<":
            opened = next(((s, e) for s, e in HTML_STARTS if s.match(body)), None)
            if opened or not paragraph and LONE_TAG.match(body):
                closer = opened[1] if opened else None
                mode = "" if closer is not None and closer.search(body[2:]) else "html"
                paragraph = False
                continue
        paragraph = True
    return found


REFERENCE_TITLES = sorted((k for k, r in KEYWORD_ROLE.items() if r == "references"), key=lambda k: (-len(k), k))
REFERENCES_LINE = re.compile(
    r"[\t\n\f\r ]*(?:[0-9]+\.?[\t\n\f\r ]*)?(?:" + "|".join(REFERENCE_TITLES) + r")[\t\n\f\r ]*:?[\t\n\f\r ]*\Z",
    re.I,
)
ENTRY = re.compile(r"\((?:19|20)[0-9]{2}[a-z]?\)|(?<![A-Za-z0-9_])(?:19|20)[0-9]{2}[a-z]?\.")
LEAST_ENTRIES, ENTRY_LINES = 3, 25
IDENTIFIER_PATTERNS = tuple(
    re.compile(p)
    for p in (r"section[\t\n\f\r ]+[0-9]+[a-z]?[\t\n\f\r ]*[:.\-][\t\n\f\r ]*", r"[0-9]+(?:\.[0-9]+)*[\t\n\f\r ]*[.:\-]?[\t\n\f\r ]+", r"[ivxlcdm]+[\t\n\f\r ]*[.)][\t\n\f\r ]+", r"[a-z][\t\n\f\r ]*[.)][\t\n\f\r ]+")
)


def semantic_form(text: str) -> str:
    """The heading as the classifier sees it, for the test whether a references heading is there already.

    It says the same as `functions.text` does in columns; a test holds the two together.
    """
    low = text.strip(WHITE).replace("\u0130", "i").replace("\u03a3", "\u03c3").lower()
    s = re.sub(r"[\t\n\f\r ]+", " ", low).rstrip(":. ")
    for p in IDENTIFIER_PATTERNS:
        s = p.sub("", s, count=1) if p.match(s) else s
    s = s.strip(":. ").strip(WHITE)
    if s in APPENDIX_ALIASES:
        return ""
    for trigger in APPENDIX_TRIGGERS:
        if s.startswith(trigger):
            rest = s[len(trigger) :].strip(WHITE)
            m = re.match(r"([A-Za-z0-9]{1,3})(?![A-Za-z0-9_])[\t\n\f\r ]*(?:[:.\-][\t\n\f\r ]*)?(.*)\Z", rest)
            return (m[2] if m else rest).strip(" :.-")
    return s


def infer_references(source: bytes, found: list[Heading]) -> Heading | None:
    """The last plain line that reads like a references heading with enough dated entries below it."""
    if any(KEYWORD_ROLE.get(semantic_form(h[6])) == "references" for h in found):
        return None
    level = min((h[0] for h in found if 2 <= h[0] <= 4), default=2)
    lines = source.split(b"\n")
    texts = [x.decode("utf-8", "replace") for x in lines]
    full = [i for i, t in enumerate(texts) if t.strip()]
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    for place in range(len(full) - 1, -1, -1):
        i = full[place]
        if not REFERENCES_LINE.match(texts[i]) or any(h[1] <= starts[i] < h[3] for h in found):
            continue
        if sum(1 for j in full[place + 1 : place + 1 + ENTRY_LINES] if ENTRY.search(texts[j])) < LEAST_ENTRIES:
            continue
        begin = starts[i] + len(lines[i]) - len(lines[i].lstrip(b" \t"))
        end = starts[i] + len(lines[i].rstrip(b" \t\r"))
        newline = source.find(b"\n", end)
        return level, begin, begin, end, len(source) if newline < 0 else newline, True, source[begin:end].decode("utf-8", "replace")
    return None


def document_headings(markdown: str | None) -> list[Heading]:
    source = (markdown or "").encode("utf-8", "replace")
    found = scan_headings(source)
    inferred = infer_references(source, found)
    return sorted([*found, inferred], key=lambda h: (h[1], not h[5])) if inferred else found


class KeywordScan:
    """Every whole occurrence of a keyword in a semantic heading, by an Aho-Corasick automaton: one pass for all keywords."""

    def __init__(self, roles: dict[str, str]):
        self.roles, self.automaton = roles, ahocorasick.Automaton()
        for keyword in roles:
            self.automaton.add_word(keyword, keyword)
        self.automaton.make_automaton()

    def __call__(self, s: str) -> list[dict]:
        """keyword, role, start and end (bytes), and the first longer one around it: suppressed_by; in scan order."""
        found = []
        for last, keyword in self.automaton.iter(s):
            first = last + 1 - len(keyword)
            if not (first and is_word(s[first - 1])) and not is_word(s[last + 1 : last + 2]):
                start = len(s[:first].encode("utf-8", "replace"))
                found.append((start, -start - len(keyword.encode()), keyword))
        found.sort()
        out = []
        for start, end, keyword in found:
            around = next((k for a, b, k in found if a <= start and b <= end and -b - a > -end - start), None)
            out.append({"keyword": keyword, "role": self.roles[keyword], "start": start, "end": -end, "suppressed_by": around})
        return out


#: Distinct headings whose matches a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 20_000, 200


@functools.lru_cache(maxsize=1)
def keyword_scan() -> KeywordScan:
    return KeywordScan(KEYWORD_ROLE)


def heading_matches(text: str) -> list[dict]:
    """The keywords in a heading as the classifier sees it; none in one that is a keyword itself."""
    s = semantic_form(text)
    return [] if s in KEYWORD_ROLE or not s else keyword_scan()(s)


remembered_matches = functools.lru_cache(maxsize=REMEMBERED)(heading_matches)


def matches_of(text: str) -> list[dict]:
    return (remembered_matches if len(text) <= LONGEST else heading_matches)(text)


#: The deepest level that makes sections.
DEEPEST = 4


def linked(found: list[Heading]) -> list[tuple]:
    """Headings with parent, the place of the last one above of a lower level, and stop, that of the next one that isn't
    below it; places count headings of levels 1 to 4, others have null. One pass with the open headings on a stack. With the
    keywords that a heading holds."""
    links, above = [], []
    for h in found:
        if h[0] > DEEPEST:
            continue
        while above and links[above[-1]][0] >= h[0]:
            links[above.pop()][2] = len(links)
        links.append([h[0], above[-1] if above else -1, None])
        above.append(len(links) - 1)
    own = iter((parent, len(links) if stop is None else stop) for _, parent, stop in links)
    return [(*h, *(next(own) if h[0] <= DEEPEST else (None, None)), matches_of(h[6]) if h[0] <= DEEPEST else []) for h in found]


FIELDS = ("level", "byte_start", "text_start", "text_stop", "span_start", "inferred", "text", "parent", "stop", "matches")


def linked_headings(markdown: str | None) -> list[dict]:
    return [dict(zip(FIELDS, h, strict=True)) for h in linked(document_headings(markdown))]


def detect_headings(markdown: Column) -> Column:
    """Array of headings of a markdown column, the inferred references heading included, linked to those above them."""
    return scanned(markdown, lambda: linked_headings, HEADINGS)
