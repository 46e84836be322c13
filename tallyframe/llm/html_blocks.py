"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element; lines of navigation, headers and footers of the page,
sidebars, notices, adverts, forms and comments are stripped with it, and so are such parts within a line. A line's
weight is its text's length, links not counted. On a page with an article or main element the lines outside weigh
nothing. Weights are summed over sliding windows of ``window`` lines. The text surges where the sum rises from nothing,
and dives where it falls back to nothing; the lines of weight between a surge and its dive are kept, in page order, with
single linked lines between them. A surge outside an article that has no sentence in a paragraph has to pass a threshold
taken from the page's own largest sum.

Two kinds of containers are judged by what they hold, when the page has been read: a form is text if it holds an article
or most of the page's text (some frameworks put the whole page in one), and inside an article a container with a name
that only may be a notice's or a link box's is text unless its lines are short or mostly links. Fall-back text of
objects is text, that of missing scripts inside an article.

Cases: null or empty html, and a page without a line of weight, give an empty text; unclosed and cut-off markup ends
with the page, except that list items, table parts and paragraphs end where the next one begins; pages and lines of any
length are read whole; repeated pages get the same answer; ties in the largest sum change nothing; an empty table gives
an empty result; a null url stays null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the page.
_RAW = "script|style|template|textarea|iframe|svg|canvas|audio|video|select|title|option|annotation|annotation-xml"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S | re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr object math semantics mrow mi mo mn ms mtext mspace mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mpadded mphantom menclose mfenced".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOISE = frozenset("nav aside footer menu dialog button head".split())
_MAIN = frozenset("article main".split())
#: Names of containers that are noise anywhere, and those that need further evidence inside an article; in it a container is noise if so much of its text is links, or if all its lines are shorter.
_STRONG = r"nav(?:bar|igation)?|side-?bar|footer|masthead|ads?|adverts?|advertisement|promo|sponsor(?:ed)?|cookies?|gdpr|popup|overlay|comments?|disqus|breadcrumbs?|subscribe|newsletter|pagination|pager|toolbar"
_WEAK = r"menu|header|banner|consent|notice|modal|replies|respond|share|social|related|recommended|login|signup|search|widget|skip"
_NOISE_WORD, _STRONG_WORD = (re.compile(rf"(?:^|[\s_-])(?:{w})(?=$|[\s_-])", re.I) for w in (f"{_STRONG}|{_WEAK}", _STRONG))
LINKED, SHORT = 0.5, 60
#: Elements whose sentences are text wherever they stand outside noise.
_PARAGRAPH = frozenset("p blockquote pre".split())
#: What a paragraph has to be for that: some words and the end of a sentence.
_SENTENCE = re.compile(r"\S+\s+\S+\s+\S.*[.!?…。！？][\"'”’»)\]]*$", re.S)
#: Elements whose end tag may be left out: what a start tag ends, and what shields an open one from it.
_SECTIONS = frozenset("article main section aside nav header footer form body table".split())
_IMPLIED = [
    (frozenset(["li"]), _SECTIONS | {"ul", "ol", "menu", "dir", "td", "th"}),
    (frozenset(["dt", "dd"]), _SECTIONS | {"dl", "td", "th"}),
    (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    (frozenset(["tr"]), frozenset(["table", "thead", "tbody", "tfoot"])),
    (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
]
_ENDS = {name: k for k, (items, _) in enumerate(_IMPLIED) for name in items}
_TRACKED = {name: [(k, name in items) for k, (items, shields) in enumerate(_IMPLIED) if name in items or name in shields] for name in {n for i, s in _IMPLIED for n in i | s}}
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())


def _noise_of(name: str, rest: str, in_main: bool, in_form: bool) -> str:
    """noise, "" for text, or what is to be judged by its content: form, named."""
    if name in _NOISE or (name == "header" and not in_main) or (name == "noscript" and not in_main) or (in_form and name in ("label", "legend")):
        return "noise"
    named = False
    for m in _ATTRIBUTE.finditer(rest) if rest and name not in ("body", "html", "article", "main") else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and name != "form":
            if (_STRONG_WORD if in_main else _NOISE_WORD).search(value):
                return "noise"
            named = named or _NOISE_WORD.search(value) is not None
        if key == "role" and name != "form" and value.lower() in _NOISE_ROLE or key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "noise"
    return "form" if name == "form" else "named" if named else ""


class _Line:
    __slots__ = ("held", "in_main", "linked", "paragraph", "text")

    def __init__(self, text, linked, in_main, paragraph, held):
        self.text, self.linked, self.in_main, self.paragraph, self.held = text, linked, in_main, paragraph, held


def _judged(lines: list[_Line], kinds: list[str], with_main: set[int]) -> list[_Line]:
    """The lines without those in containers that prove to be noise."""
    text, linked, longest = ([0] * len(kinds) for _ in range(3))
    for x in lines:
        for k in x.held:
            text[k] += len(x.text)
            linked[k] += x.linked
            longest[k] = max(longest[k], len(x.text) - x.linked)
    every = sum(len(x.text) for x in lines) - sum(x.linked for x in lines)

    def noise(k: int) -> bool:
        if kinds[k] == "form":
            return k not in with_main and 2 * (text[k] - linked[k]) < every
        return linked[k] >= LINKED * text[k] or longest[k] < SHORT

    gone = {k for k in range(len(kinds)) if noise(k)}
    return [x for x in lines if not gone.intersection(x.held)] if gone else lines


def lines_of(html: str) -> tuple[list[str], list[int], list[bool]]:
    """The page's lines outside noise containers, their weights, and whether each is text wherever it stands."""
    lines: list[_Line] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open block elements: name, is noise, is main, is judged by its content
    n_open: dict[str, int] = {}  # how many of each name are in the stack
    tracked: list[list[tuple[int, bool]]] = [[] for _ in _IMPLIED]  # places of items and shields in the stack, and whether it is an item
    text: list[str] = []
    held: list[int] = []  # the open containers that are judged by their content
    kinds: list[str] = []
    with_main: set[int] = set()
    hidden: list | None = None  # an inline element of noise: name, how deep, how many block elements are open around it
    noise = main = in_link = linked = 0
    any_main = False

    def end_line() -> None:
        nonlocal linked
        if text:
            line = "" if noise else " ".join(unescape("".join(text)).split())
            if line:
                lines.append(_Line(line, min(linked, len(line)), main > 0, any(n_open.get(n) for n in _PARAGRAPH), tuple(held)))
            text.clear()
        linked = 0

    def close() -> str:
        nonlocal noise, main, hidden
        name, was_noise, was_main, was_held = stack.pop()
        noise, main = noise - was_noise, main - was_main
        if was_held:
            held.pop()
        n_open[name] -= 1
        for k, _ in _TRACKED.get(name, ()):
            tracked[k].pop()
        if hidden and len(stack) < hidden[2]:
            hidden = None
        return name

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at and not hidden:
            text.append(html[at : m.start()])
            if in_link:
                linked += len(text[-1].strip())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if hidden and name == hidden[0]:
            hidden[1] += -1 if m["end"] else 1
            if not hidden[1]:
                hidden = None
        if name == "a":
            in_link = 0 if m["end"] else 1
        if name == "br":
            text.append(" ")
        elif name in _INLINE or name == "noscript" and main > 0:
            if not m["end"] and not hidden and name not in _VOID and _noise_of(name, m["rest"], True, False) == "noise":
                hidden = [name, 1, len(stack)]
        else:
            end_line()
            if name in _VOID:
                continue
            if not m["end"]:
                if name == "p":
                    if stack and stack[-1][0] == "p":
                        close()
                elif name in _ENDS and (places := tracked[_ENDS[name]]) and places[-1][1]:
                    for _ in range(len(stack) - places[-1][0]):
                        close()
                kind, is_main = _noise_of(name, m["rest"], main > 0, n_open.get("form", 0) > 0), name in _MAIN
                for k, is_item in _TRACKED.get(name, ()):
                    tracked[k].append((len(stack), is_item))
                if kind in ("form", "named"):
                    held.append(len(kinds))
                    kinds.append(kind)
                stack.append((name, kind == "noise", is_main, kind in ("form", "named")))
                n_open[name] = n_open.get(name, 0) + 1
                noise, main = noise + (kind == "noise"), main + is_main
                if is_main and not noise:
                    any_main = True
                    with_main.update(held)
            elif n_open.get(name):
                while close() != name:
                    pass
    if at < len(html) and not hidden:
        text.append(html[at:])
    end_line()
    lines = _judged(lines, kinds, with_main)
    weights = [max(int(x.in_main), len(x.text) - x.linked) if x.in_main or not any_main else 0 for x in lines]
    return [x.text for x in lines], weights, [x.in_main or (x.paragraph and _SENTENCE.search(x.text) is not None) for x in lines]


def kept_lines(weights: list[int], sure: list[bool] | None = None, window: int = 3, share: float = 0.2, most: int = 80) -> np.ndarray:
    """Which lines lie between a surge and its dive. A surge without a line that is ``sure`` has to pass ``share`` of the page's largest sum, or ``most`` if that is less; where lines may be sure, single ones without weight between two of weight are text."""
    w = np.asarray(weights, dtype=np.int64)
    if not w.any():
        return np.zeros(len(w), dtype=bool)
    total = np.concatenate([[0], np.cumsum(w)])
    at = np.arange(len(w))
    sums = total[np.minimum(at + window // 2 + 1, len(w))] - total[np.maximum(at - window // 2, 0)]
    threshold = min(most, share * sums.max())
    certain = np.zeros(len(w), dtype=bool) if sure is None else np.asarray(sure, dtype=bool) & (w > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], sums > 0, [False]])))
    keep = np.zeros(len(w), dtype=bool)
    for rise, dive in zip(edges[::2], edges[1::2]):
        keep[rise:dive] = sums[rise:dive].max() > threshold or certain[rise:dive].any()
    heavy = w > 0
    between = np.zeros(len(w), dtype=bool)
    if sure is not None:
        between[1:-1] = heavy[:-2] & heavy[2:]
    return keep & (heavy | between)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    lines, weights, sure = lines_of(html)
    return " ".join(x for x, k in zip(lines, kept_lines(weights, sure)) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
