"""The main content of web pages: blocks with their text and links, and the part of a page that holds the most of its prose."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .text import WS, col, let

_BLOCK = S.StructType([S.StructField("kind", S.StringType()), S.StructField("text", S.StringType()), S.StructField("link_chars", S.IntegerType())])

_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_PARTS = {"article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "figure", "footer", "form", "header", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "thead", "tr", "ul", *_HEADINGS}
_UNSEEN = {"script", "style", "noscript", "template", "svg", "title", "select", "button"}
_AROUND = {"nav", "footer", "aside", "form"}
_AROUND_CLASSES = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comments", "cookie", "menu", "navbar", "promo", "related", "share", "sidebar"}
#: What a start of one of these closes, up to the parts in which another may be open.
_CLOSES = {"li": ({"li", "p"}, {"ul", "ol"}), "tr": ({"tr", "p"}, {"table"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"})}


class _Page(HTMLParser):
    """Parts of a page as a tree in arrays, and the runs of text in them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.around = [-1], ["html"], [False]
        self.blocks: list[tuple[int, str, str, int]] = []
        self.at, self.unseen, self.text, self.links, self.href, self.label = 0, 0, [], 0, None, []

    def flush(self) -> None:
        self.end_link()
        if words := " ".join("".join(self.text).split()):
            tag = next((t for t in self._up() if t in _HEADINGS or t in ("li", "tr", "p", "pre")), "p")
            self.blocks.append((self.at, tag, words.removesuffix(" |"), self.links))
        self.text, self.links = [], 0

    def _up(self):
        i = self.at
        while i > 0 and self.tag[i] not in ("div", "section", "article", "main", "body"):
            yield self.tag[i]
            i = self.parent[i]

    def end_link(self) -> None:
        if self.href is not None:
            label = " ".join("".join(self.label).split())
            self.text.append(f"[{label}]({self.href})" if label and self.href else label)
            self.links += len(label)
            self.href = None

    def handle_starttag(self, tag, attrs):
        if tag in _UNSEEN:
            self.unseen += 1
        elif tag == "a":
            self.end_link()
            self.href, self.label = (dict(attrs).get("href") or "").strip(), []
        elif tag == "br":
            self.handle_data(" ")
        elif tag in _PARTS:
            self.flush()
            closes, within = _CLOSES.get(tag, ({"p"}, _PARTS - {"p"}))
            i = self.at
            while i > 0 and self.tag[i] not in within:
                if self.tag[i] in closes:
                    self.at = self.parent[i]
                i = self.parent[i]
            classes = (dict(attrs).get("class") or "").lower().split()
            self.around.append(self.around[self.at] or tag in _AROUND or not _AROUND_CLASSES.isdisjoint(classes))
            self.parent.append(self.at)
            self.tag.append(tag)
            self.at = len(self.tag) - 1

    def handle_endtag(self, tag):
        if tag in _UNSEEN:
            self.unseen = max(self.unseen - 1, 0)
        elif tag == "a":
            self.end_link()
        elif tag in ("td", "th"):
            self.handle_data(" | ")
        elif tag in _PARTS:
            i = self.at
            while i > 0 and self.tag[i] != tag:
                i = self.parent[i]
            if i > 0:
                self.flush()
                self.at = self.parent[i]

    def handle_data(self, data):
        if not self.unseen:
            (self.label if self.href is not None else self.text).append(data)


def blocks_of(html: str | None) -> list[dict]:
    """The blocks of the part of a page that holds the most text outside links, less twice that in links and all that lies around the content.

    Of parts that hold as much the innermost counts. Pages without such text have no blocks. A tag or comment that doesn't end is left out with what follows it.
    """
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    worth = [0] * len(page.tag)
    for at, _, text, links in page.blocks:
        worth[at] += -len(text) if page.around[at] else len(text) - 3 * links
    for i in range(len(worth) - 1, 0, -1):  # parents come before their parts
        worth[page.parent[i]] += worth[i]
    best = max(range(len(worth)), key=lambda i: (worth[i], i))
    if worth[best] <= 0:
        return []
    inside = [False] * len(worth)
    for i in range(best, len(worth)):
        inside[i] = i == best or (page.parent[i] >= best and inside[page.parent[i]])
    return [{"kind": kind, "text": text, "link_chars": links} for at, kind, text, links in page.blocks if inside[at] and not page.around[at]]


@F.pandas_udf(S.ArrayType(_BLOCK))
def main_blocks(html: pd.Series) -> pd.Series:
    """An array of structs (kind, text, link_chars) in the order of the page; null and empty pages have none."""
    return html.map(blocks_of)


def markdown_of(blocks) -> Column:
    """Blocks as Markdown: headings, list items, rows of tables and paragraphs."""
    def line(b: Column) -> Column:
        marks = [F.when(b["kind"] == h, "#" * i + " ") for i, h in enumerate(_HEADINGS, 1)] + [F.when(b["kind"] == "li", "- "), F.when(b["kind"] == "tr", "| ")]
        return F.concat(F.coalesce(*marks, F.lit("")), b["text"], F.when(b["kind"] == "tr", " |").otherwise(""))

    return F.array_join(F.transform(col(blocks), line), "\n\n")


def capped(text, words: int) -> Column:
    """A text of at most ``words`` words, with a note where it was cut. The limit is the feature; null gives ''."""
    note = F.lit(f"\n\n[Content truncated at {words} words]")
    body = F.coalesce(col(text), F.lit(""))
    return let(F.array_remove(F.split(body, WS), ""), lambda w: F.when(F.size(w) > words, F.concat(F.array_join(F.slice(w, 1, words), " "), note)).otherwise(body))


def main_text(html, words: int | None = None) -> Column:
    """A page's main content as Markdown, of at most ``words`` words where a number is given."""
    whole = markdown_of(main_blocks(col(html)))
    return capped(whole, words) if words else whole
