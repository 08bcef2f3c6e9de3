"""Main text of HTML pages by line-block distribution.

Markup is taken off and every block element starts a line. Lines inside elements that never hold the article
(menus, headers, footers, asides, forms, scripts, adverts and comments, by element, role, class and id) are
noise and leave the page first, so that an advert between two paragraphs parts nothing. The others count
with their characters outside links, and these lengths are summed over windows of `width` lines. Article text
shows as a plateau of that curve: it begins at a surge point, where a sum passes the surge threshold, with
the lines before it that have text of their own, and ends at a dive point, where all lines of a window are
without. Every line between the two is kept, also one of links only.

Article and main elements are evidence: where they hold at least as much text as the rest of the page, the
curve is that of their lines, each counted whole, and the rest is noise. Else they count like any element.

A page works on its own: one pass over its characters in a task, no shuffle. The pass is linear in the page,
whatever is left open in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.llm.common import map_texts, slices

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
TAG_STOP = re.compile("[>\"']")
#: elements whose content is not markup; it ends at their own end tag
OPAQUE = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "noembed", "xmp", "svg", "math", "object"}
ASIDE = {"nav", "footer", "aside", "form", "header", "menu", "button", "select", "dialog", "figure", "label", "fieldset"}
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary
table tbody td tfoot th thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
             "tr": {"tr"}, "option": {"option"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
#: words of class and id names that mark what is not the article
NOISE = set("""ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent
cookie cookies copyright disclaimer disqus alert footer gdpr header login masthead menu meta modal nav navbar navigation newsletter notice notices
outbrain pager pagination popup promo promoted promotion related replies reply respond rss search share sharing sidebar signup
skip social sponsor sponsored subscribe subscription tags taboola toolbar topbar widget widgets""".split())
#: names with one of these belong to the article unless they also have one of STRONG
BODY = set("article post entry content story main body text page document".split())
STRONG = set("""ad ads advert advertisement comment comments commentlist disqus reply replies respond sidebar footer nav navbar navigation
menu breadcrumb breadcrumbs share sharing social related promo promoted sponsor sponsored newsletter cookie cookies notice notices
widget widgets pagination pager subscribe subscription signup consent gdpr popup modal banner advertising promotion alert disclaimer
outbrain taboola""".split())
#: names of an article element that only points to another page
PREVIEWS = set("teaser teasers preview card snippet excerpt".split())
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


def _noise(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in ASIDE and not (in_article and tag in ("header", "figure", "label", "fieldset")):
        return True
    if not attributes:
        return False
    for name, *values in NAMES.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id") and tag not in ("body", "html"):
            words = {w.lower() for w in WORDS.findall(value)}
            if tag in ("article", "main"):
                if words & (STRONG | PREVIEWS):
                    return True
                continue
            marks = STRONG if in_article or words & BODY else NOISE
            if words & marks:
                return True
    return False


def tag_end(page: str, at: int) -> int:
    """The place of the tag's `>`, which quotes may hide; -1 if a quote or the tag stays open."""
    while found := TAG_STOP.search(page, at):
        if found[0] == ">":
            return found.start()
        at = page.find(found[0], found.end()) + 1
        if not at:
            return -1
    return -1


class Lines:
    """Gathers the lines of a page: (text, characters outside links, inside noise, inside article or main)."""

    def __init__(self):
        self.out, self.parts, self.outside = [], [], 0
        self.stack: list[tuple[str, bool, bool]] = []  # open elements: tag, noise, article
        self.block_at: list[int] = []  # places of block elements in the stack
        self.open: Counter = Counter()

    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.out.append((text, self.outside, *self.state()))
        self.parts, self.outside = [], 0

    def add(self, text: str) -> None:
        if text:
            text = html.unescape(text)
            self.parts.append(text)
            if not self.open["a"]:
                self.outside += len(SPACE.sub("", text))

    def cut(self, size: int) -> None:
        """Closes what was opened from a place of the stack on."""
        for tag, _, _ in self.stack[size:]:
            self.open[tag] -= 1
        del self.stack[size:]
        while self.block_at and self.block_at[-1] >= size:
            self.block_at.pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            if self.block_at and tag in CLOSED_BY.get(self.stack[self.block_at[-1]][0], ()):
                self.cut(self.block_at[-1])
        if tag in VOID or attributes.rstrip().endswith("/"):
            return
        noise, article = self.state()
        article = article or tag in ("article", "main")
        if tag in BLOCK:
            self.block_at.append(len(self.stack))
        self.open[tag] += 1
        self.stack.append((tag, noise or _noise(tag, attributes, article), article))

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.open[tag]:
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self.cut(at)


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """Lines of a page in order: text, characters outside links, whether inside noise, whether inside article or main.

    A tag without an end is text if no `>` follows; else it ends there, and from then on quotes hide nothing,
    as one of them is open.
    """
    lines, at, quotes = Lines(), 0, True
    while (begin := page.find("<", at)) >= 0:
        lines.add(page[at:begin])
        if page.startswith("<!--", begin):
            close = page.find("-->", begin + 4)
            at = close + 3 if close >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", begin):
            close = page.find("]]>", begin)
            lines.add(page[begin + 9:close if close >= 0 else len(page)])
            at = close + 3 if close >= 0 else len(page)
            continue
        name = NAME.match(page, begin + 1)
        if not name and page[begin + 1:begin + 2] not in ("!", "?"):
            lines.add("<")
            at = begin + 1
            continue
        after = name.end() if name else begin + 2
        stop = tag_end(page, after) if quotes and name else page.find(">", after)
        if stop < 0:
            quotes, stop = False, page.find(">", after)
            if stop < 0:
                at = begin
                break
        at = stop + 1
        if not name:
            continue
        tag, attributes = name[2].lower(), page[after:stop]
        if tag in OPAQUE:
            if not name[1] and not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
        elif tag == "br":
            lines.parts.append(" ")
        elif name[1]:
            lines.end(tag)
        else:
            lines.start(tag, attributes)
    lines.add(page[at:])
    lines.flush()
    return lines.out


def plateaus(size: list[int], width: int, surge: int) -> list[tuple[int, int]]:
    """[from, to) ranges of lines from a surge point, and the text lines before it, to the next dive point.

    If no window passes the surge threshold, the range with the largest sum.
    """
    upto = [0, *accumulate(size)]
    sums = [upto[min(i + width, len(size))] - upto[i] for i in range(len(size))]
    ranges, at = [], 0
    while at < len(size):
        if not size[at]:
            at += 1
            continue
        dive = at
        while dive < len(size) and sums[dive]:
            dive += 1
        last = dive
        while not size[last - 1]:
            last -= 1
        ranges.append((max(sums[at:last]), at, last))
        at = dive
    kept = [r for r in ranges if r[0] > surge] or sorted(ranges, key=lambda r: (-r[0], r[1]))[:1]
    return [(a, b) for _, a, b in kept]


def main_text(page: str | None, width: int = 3, surge: int = 86) -> str:
    """The main text: lines joined by two line ends; empty where the page has none."""
    if not page:
        return ""
    lines = [(text, chars, article) for text, chars, noise, article in blocks(page) if not noise]
    inside = [(text, len(text)) for text, _, article in lines if article]
    if inside and sum(n for _, n in inside) >= sum(chars for _, chars, article in lines if not article):
        lines = inside
    else:
        lines = [(text, chars) for text, chars, _ in lines]
    found = plateaus([n for _, n in lines], width, surge)
    return "\n\n".join(lines[i][0] for a, b in found for i in range(a, b))


def extract(pages: DataFrame, keys: list[str], html_col: str = "html", **how) -> DataFrame:
    """The key columns and `text`, the main text of each page.

    Null and empty pages have an empty text. Repeated rows and null keys stay. Other columns are not read. A
    very long page takes time and memory in proportion, also one of open tags and quotes.
    """
    rows = pages.select(*keys, F.col(html_col).alias("__html"))
    schema = rows.select(*keys, F.lit("").alias("text")).schema

    def run(batches):
        for batch in slices(batches, len(keys)):
            found = [main_text(p, **how) for p in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*keys, "text"])

    return map_texts(rows, run, schema)
