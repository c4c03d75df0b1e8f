"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is read as a sequence of tokens, text runs and tags. Words score
positive and tags negative; the contiguous stretch of tokens with the largest sum
(one linear scan) is the content region. How much a word in a context (its block,
in a link or not) and a tag score comes from labelled pages: those that mark
their content with ``<article>`` or ``<main>`` say for every word and tag whether
it is inside. Scores are smoothed log odds, clipped so that words of ordinary
blocks stay positive (only links in lists may score negative) and tags negative.
On pages with such a mark, being inside or outside of it is part of a word's and
a tag's context, with scores learned like all others. The fit reads a bounded
sample, at most ``SAMPLE`` distinct marked pages, those of the least hash.
Words that are no content by their markup say nothing about their block, except
for links in lists, which menus are made of.

Text that is no content by its markup never scores positive and is left out of
the result even inside the region: scripts, styles, forms, menus, headers and
footers of the page, asides, hidden elements, and containers of which a class or
id has one of ``HINTS`` and beside it only such words, ``LAYOUT`` words or numbers
(``related-posts``, but not ``related-work``), or whose role says so. Such
elements score nothing, so they do not end the region either.

Result: character references decoded, white space in a block made one space,
blocks joined by one space in page order. Nothing else is dropped or capped.

Defined results: a null or empty page, or one without text, has the empty text.
Unclosed tags, comments, quotes and cut-off pages are read as far as they go.
Equal sums: the first stretch wins, and of those the longest. Pages are read
row by row, so repeated rows, null ids and further columns don't matter. Without
labelled pages the default scores are used.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe math noframes noscript object script select style svg template textarea title xmp".split())
NEVER = frozenset("aside button dialog fieldset footer form head header menu nav".split())
UNCLOSED = frozenset("head header menu nav".split())
MARKS = frozenset(("article", "main"))
BLOCKS = frozenset("article blockquote body caption center dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header footer nav aside li main ol p pre section table tbody td tfoot th thead tr ul".split())
HINTS = frozenset(
    "ad ads adsbygoogle advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related search share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
LAYOUT = frozenset(
    "area article bar block body bottom box button col column container content div element entry field fixed floating form global group head heading inline inner item items "
    "layer left link links list main module outer overlay page panel post posts primary right row secondary section site slot small sticky strip tab text title top unit wrap wrapper zone".split()
)
COMMENTS = frozenset(("comment", "comments"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile("[\"'>]")
SAMPLE = 4096
#: Score of a word and of a tag that was never seen, on unmarked pages, inside and outside of a mark.
DEFAULTS = {"": (0.5, -0.5), "in ": (0.5, -0.05), "out ": (-1.0, -0.5)}
WORD_FLOOR = 0.5
LIST_LINKS = frozenset(("li a", "ul a", "ol a", "dl a", "dt a", "dd a"))


@dataclass
class Token:
    """A text run or a tag. ``kind``: text, open, close.

    ``place``: plain, dropped (no content), marked (in marked content), aside
    (no content, but within the mark) or outside (of the page's mark).
    """

    kind: str
    name: str
    text: str = ""
    place: str = "plain"
    context: str = ""
    words: int = 0


def _tag_end(page: str, at: int) -> int:
    """Position after the tag that starts at ``at``; a ``>`` within quotes doesn't end it."""
    end = page.find(">", at)
    if end < 0:
        return len(page)
    inner = page[at:end]
    if inner.count('"') % 2 or inner.count("'") % 2:
        stop = _TAG_STOP.search(page, at)
        while stop:
            i = stop.start()
            if page[i] == ">":
                return i + 1
            if page[i - 1] in "= \t\n\r":
                i = page.find(page[i], i + 1)
                if i < 0:
                    break  # the quote never closes
            stop = _TAG_STOP.search(page, i + 1)
    return end + 1


def _pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text): text runs, and tags with their attributes as text. Comments and raw content are skipped."""
    at, n, start = 0, len(page), 0
    while at < n:
        at = page.find("<", at)
        if at < 0:
            break
        after = page[at + 1 : at + 2]
        if after == "!" or after == "?":
            if start < at:
                yield "text", "", page[start:at]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            start = at
            continue
        closing = after == "/"
        name = _NAME.match(page, at + 1 + closing)
        if not name:
            at += 1
            continue
        if start < at:
            yield "text", "", page[start:at]
        low = name[0].lower()
        end = _tag_end(page, at)
        yield ("close" if closing else "open"), low, page[name.end() : end]
        at = end
        if not closing and low in RAW and not page[at - 2 : at] == "/>":
            stop = re.compile(rf"</{low}(?=[\s/>]|$)", re.I).search(page, at)
            at = n if stop is None else stop.start()
        start = at
    if start < n:
        yield "text", "", page[start:]


def _dropped(name: str, attributes: str, in_mark: bool) -> bool:
    """Whether an element holds no content, by its name, class, id, role or a hidden mark."""
    if name in NEVER:
        return not (name == "header" and in_mark)
    if name in ("body", "html") or not attributes or attributes in (">", "/>"):
        return False
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if found.get("role") in ROLES:
        return True
    named = [[x for x in re.split(r"[^a-z0-9]+", one) if x] for one in f"{found.get('class', '')} {found.get('id', '')}".split()]
    if name in MARKS:
        return any(set(words) & COMMENTS and set(words) <= COMMENTS | LAYOUT for words in named)
    hints = HINTS if in_mark else HINTS | {"header"}
    return any(set(words) & hints and all(x in hints or x in LAYOUT or x.isdigit() for x in words) for words in named)


class _Open:
    """The open elements of a page, found by name without a walk: (name, dropped, within a mark, nearest block, within a link)."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, str, bool]] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.marks: list[int] = []

    def push(self, name: str, *rest) -> None:
        self.at[name].append(len(self.stack))
        if name in MARKS:
            self.marks.append(len(self.stack))
        self.stack.append((name, *rest))

    def cut(self, size: int) -> None:
        """Close all but the outermost ``size`` elements."""
        while len(self.stack) > size:
            name = self.stack.pop()[0]
            self.at[name].pop()
            if name in MARKS:
                self.marks.pop()

    def close(self, name: str) -> None:
        """Close the innermost element of a name; a stray end tag does not close the content."""
        if not self.at[name]:
            return
        last = self.at[name][-1]
        if name in ("body", "html") or not self.marks or self.marks[-1] <= last:
            self.cut(last)

    def first_dropped(self) -> int:
        # All within a dropped element is dropped.
        return bisect_left(self.stack, True, key=lambda s: s[1])


def tokens(page: str) -> list[Token]:
    """Tokens of a page with their places, in time linear in the page (but for a logarithm) however deep it nests."""
    out: list[Token] = []
    opened = _Open()
    stack = opened.stack
    marked = False
    for kind, name, text in _pieces(page):
        dropped, in_mark = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        place = ("aside" if in_mark else "dropped") if dropped else "marked" if in_mark else "plain"
        if kind == "text":
            if not text.strip():
                out.append(Token("text", "", text, place))
                continue
            block, link = stack[-1][3:] if stack else ("body", False)
            out.append(Token("text", "", text, place, f"{block}{' a' if link else ''}", len(text.split())))
        elif kind == "open":
            if name in MARKS or name == "body":
                # An unclosed menu or header does not swallow the content.
                open_ = opened.first_dropped()
                if open_ < len(stack) and stack[open_][0] in UNCLOSED:
                    opened.cut(open_)
                dropped, in_mark = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            out.append(Token("open", name, place=place))
            if name not in VOID and name not in RAW and not (text.endswith("/>") and name not in BLOCKS):
                lost = dropped or _dropped(name, text, in_mark)
                if lost and not in_mark:
                    out[-1].place = "dropped"
                is_mark = name in MARKS and not lost
                marked |= is_mark
                block, link = stack[-1][3:] if stack else ("body", False)
                opened.push(name, lost, in_mark or is_mark, name if name in BLOCKS else block, link or name == "a")
        else:
            out.append(Token("close", name, place=place))
            opened.close(name)
    if marked:
        for t in out:
            if t.place == "plain":
                t.place = "outside"
    return out


#: How a token's place shows in its context.
_SIDE = {"plain": "", "marked": "in ", "outside": "out "}


@dataclass
class Scores:
    """Score of a word by context and of a tag by name, both with their side of a mark; ``DEFAULTS`` for what isn't listed."""

    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)

    def of(self, t: Token) -> float:
        if t.place in ("aside", "dropped"):
            return 0.0  # neither content nor its end
        side = _SIDE[t.place]
        if t.kind != "text":
            return self.tag.get(side + t.name, DEFAULTS[side][1])
        return t.words * self.word.get(side + t.context, DEFAULTS[side][0])


def counts(page: str) -> Counter:
    """Of a page that marks its content: words by (context, inside) and tags by (name, inside), with and without their side of the mark."""
    found: Counter = Counter()
    toks = tokens(page)
    if not any(t.place == "marked" and t.words for t in toks):
        return found
    for t in toks:
        inside, side = t.place == "marked", _SIDE.get(t.place)
        if t.kind == "text":
            if t.words and (side or t.context in LIST_LINKS):
                found["w " + t.context, inside] += t.words
                if side:
                    found[f"w {side}{t.context}", inside] += t.words
        else:
            name = t.name if t.name in INLINE | BLOCKS | NEVER | RAW | VOID else "other"
            found["t " + name, t.place in ("marked", "aside")] += 1
            if side:
                found[f"t {side}{name}", inside] += 1
    return found


def labelled(pages: DataFrame, sample: int) -> DataFrame:
    """(html): at most ``sample`` distinct pages that may mark their content, those of the least hash. Only hashes are sorted."""
    marks = [F.contains("html", F.lit(f"<{name}")) for mark in sorted(MARKS) for name in (mark, mark.upper())]
    some = pages.where(reduce(Column.__or__, marks)).select("html", F.xxhash64("html").alias("h"))
    last = some.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    return some.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("html").alias("html")).select("html")


def fit(pages: DataFrame, *, sample: int = SAMPLE) -> Scores:
    """Scores from labelled pages; each task counts its own, a few hundred sums meet on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                total.update(counts(page.as_py()))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["key", "inside", "n"])

    rows = labelled(pages, sample).mapInArrow(count, "key string, inside boolean, n long").groupBy("key").agg(F.sum(F.expr("if(inside, n, 0)")).alias("inside"), F.sum(F.expr("if(inside, 0, n)")).alias("outside")).collect()
    scores = Scores()
    for r in rows:
        kind, name = r.key[:2], r.key[2:]
        odds = math.log((r.inside + 1) / (r.outside + 1)) / 2
        if kind == "t ":
            scores.tag[name] = min(max(odds, -2.0), -0.05)
        elif name.startswith("out "):
            scores.word[name] = min(max(odds, -2.0), -WORD_FLOOR)
        else:
            scores.word[name] = min(max(odds, -1.0 if name in LIST_LINKS else WORD_FLOOR), 2.0)
    return scores


def best_stretch(values: list[float]) -> tuple[int, int]:
    """[a, b) with the largest sum, in one scan; (0, 0) if no sum is positive."""
    best, a, b = 0.0, 0, 0
    total, start = 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best or (total == best and start == a and best > 0):
            best, a, b = total, start, i + 1
    return a, b


def extract(page: str | None, scores: Scores) -> str:
    """The main text of a page."""
    if not page:
        return ""
    toks = tokens(page)
    a, b = best_stretch([scores.of(t) for t in toks])
    parts: list[str] = []
    for t in toks[a:b]:
        if t.kind == "text":
            if t.place in ("plain", "marked"):
                parts.append(html.unescape(t.text))
        elif t.name not in INLINE:
            parts.append("\n")
    return " ".join("".join(parts).split())


def main_texts(pages: DataFrame, scores: Scores | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    scores = scores or fit(pages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [extract(p.as_py(), scores) for p in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")
