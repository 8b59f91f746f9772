"""Main text of web pages by consensus of their host.

Every page scores its containers by the text that stands in them, links
counted against it, and votes for their generalised paths (tags and classes,
numbers blotted out). Spark sums the votes per host and path and takes the
winner of each host. Each page is then read again by the winning path; a page
that lacks it, or has next to nothing there, adds its own best container and
those of the same path. What is chosen grows: the whole article or main element
around it, else the blocks and containers beside it that are poor in links, up
to the containers right under the body. Other containers there stay out.

Votes are summed in the tasks first, so a hot host is only many partial sums;
the winners, one row per host, join back without a hint, so adaptive execution
broadcasts them where they are few and splits a hot host where they are not.

Defined results: null or empty html has an empty text; html without tags is one
block. Pages without a host vote together. Repeated pages are returned one by
one. An element that is never closed ends with its parent; text after an
unclosed comment, script or style belongs to that. Of containers with equal
scores the first one is chosen, of paths with equal votes the last by name. Pages
of any length are read whole. An empty table gives no rows. Kept columns lie
inside `row` and may have any name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from causalrisk.llm.common import bounded_batches, stored
from causalrisk.llm.url_reputation import url_host

#: Share of the score that a parent inherits, levels that inherit, steps of a path that are compared, least share of the best container's score.
HEIR, LEVELS, STEPS, LEAST = 0.7, 6, 12, 0.25

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("body div article main section td center".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
LEFT_OUT = frozenset(
    "nav footer aside form button select option label input dialog menu search svg canvas audio video object applet head map datalist".split()
)
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login comment comments respond reply replies disqus discussion share sharing social related recommended "
    "recommendations widget widgets toolbar pagination pager skip hidden".split()
)
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Things in which a whole article may stand; in all others an article is a sign of an element that was not closed.
HOLDS_ARTICLES = frozenset("aside sidebar comment comments respond reply replies disqus discussion related recommended recommendations form widget widgets hidden".split())
NEGATED = frozenset("with has no without non".split())
ARTICLE_TAGS, ARTICLE_WORDS = {"article": 1.6, "main": 1.4}, frozenset("article articlebody content entry post story maincontent".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}

_TAG = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+|[0-9]+")
_NUMBER = re.compile(r"[0-9]+")


@dataclass
class Element:
    tag: str
    container: int
    left_out: str  # the word for which it and all in it is left out, or empty
    in_article: bool
    link: bool


@dataclass
class Page:
    """Containers (path, parent, weight) and blocks (text, container, characters in links)."""

    paths: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    weights: list[float] = field(default_factory=lambda: [1.0])
    blocks: list[tuple[str, int, int]] = field(default_factory=list)

    def scores(self) -> list[float]:
        out = [0.0] * len(self.paths)
        for text, container, linked in self.blocks:
            share = float(max(0, len(text) - 2 * linked))
            for _ in range(LEVELS):
                out[container] += share * self.weights[container]
                container, share = self.parents[container], share * HEIR
                if container < 0:
                    break
        return out

    def best(self) -> int:
        scores = self.scores()
        return max(range(len(scores)), key=lambda i: (scores[i], -i))

    def text(self, chosen: set[int], open_: frozenset[int] = frozenset()) -> str:
        """The blocks under the chosen containers, and those right in the open ones that are poor in links."""
        inside: dict[int, bool] = {-1: False}

        def within(c: int) -> bool:
            way = []
            while c not in inside and c not in chosen:
                way.append(c)
                c = self.parents[c]
            known = c in chosen or inside[c]
            for w in way:
                inside[w] = known
            return known

        return "\n".join(text for text, c, linked in self.blocks if within(c) or c in open_ and 2 * linked <= len(text))

    def grown(self, chosen: set[int]) -> tuple[set[int], frozenset[int]]:
        """The chosen containers with what belongs to them (see the module), and the containers around them."""
        tags = [p.rpartition(">")[2].split(".")[0] for p in self.paths]
        size, linked = [0] * len(tags), [0] * len(tags)
        for text, c, links in self.blocks:
            size[c] += len(text)
            linked[c] += links
        for c in range(len(tags) - 1, 0, -1):  # parents come before their children
            size[self.parents[c]] += size[c]
            linked[self.parents[c]] += linked[c]
        around: set[int] = set()
        out = set(chosen)
        for c in chosen:
            c = self.parents[c]
            while c >= 0 and c not in around:
                around.add(c)
                if tags[c] in ARTICLE_TAGS:
                    out.add(c)
                c = self.parents[c]
        for c in range(len(tags)):
            above = self.parents[c]
            if above in around and tags[above] not in ("", "body") and c not in around and 2 * linked[c] <= size[c]:
                out.add(c)
        return out, frozenset(around)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def _left_out(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    if tag in ("html", "body", "main", "article"):
        return ""
    if tag in LEFT_OUT:
        return tag
    if tag == "header":
        return "" if in_article else tag
    if not attributes:
        return ""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return "hidden"
    if attributes.get("role", "").lower() in LEFT_OUT_ROLES:
        return attributes["role"].lower()
    for name in ("class", "id"):
        words = _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", attributes.get(name, "")).lower())
        for before, word in zip(["", *words], words, strict=False):
            if word in LEFT_OUT_WORDS and before not in NEGATED and not (word == "header" and in_article):
                return word
    return ""


def read_page(source: str) -> Page:
    """Blocks and containers of a page, in one pass over its tags."""
    page = Page()
    stack = [Element("", 0, "", False, False)]
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                page.blocks.append((text, stack[-1].container, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(to: int) -> None:
        if any(e.tag in BLOCK for e in stack[to:]):
            flush()
        del stack[to:]

    def add(text: str) -> None:
        nonlocal linked
        if not stack[-1].left_out:
            pieces.append(text)
            if stack[-1].link:
                linked += len(text)

    at, size = 0, len(source)
    while at < size:
        start = source.find("<", at)
        if start < 0:
            add(source[at:])
            break
        if start > at:
            add(source[at:start])
        m = _TAG.match(source, start) or _LOOSE_TAG.match(source, start)
        if not m:
            add("<")
            at = start + 1
            continue
        at = m.end()
        if m.group() == "<!--":
            end = source.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = size if end is None else end.end()
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in CONTAINER:
                    break
            flush()
        ends, scope = CLOSED_BY.get(tag, (None, None))
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in scope:
                    break
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        above = stack[-1]
        attributes = _attributes(m.group(3)) if m.group(3).strip(" /\n\t") else {}
        left_out = above.left_out or _left_out(tag, attributes, above.in_article)
        if above.left_out and (tag == "main" or tag == "article" and above.left_out not in HOLDS_ARTICLES):
            left_out = ""
        container = above.container
        if tag in CONTAINER and not left_out:
            label = ".".join([tag, *sorted(_NUMBER.sub("#", c) for c in attributes.get("class", "").split())])
            path = ">".join([*page.paths[container].split(">"), label][-STEPS:])
            words = {w for name in ("class", "id", "itemprop", "role") for w in _PART.findall(attributes.get(name, "").lower())}
            page.paths.append(path)
            page.parents.append(container)
            page.weights.append(ARTICLE_TAGS.get(tag, 1.2 if words & ARTICLE_WORDS else 1.0))
            container = len(page.paths) - 1
        stack.append(Element(tag, container, left_out, above.in_article or tag in ("article", "main"), above.link or tag == "a"))
    close(1)
    flush()
    return page


def page_votes(source: str) -> dict[str, float]:
    """Share of the page's score per path."""
    page = read_page(source)
    scores = page.scores()
    total = sum(scores)
    votes: dict[str, float] = {}
    for path, score in zip(page.paths, scores, strict=True):
        if score > 0:
            votes[path] = votes.get(path, 0.0) + score / total
    return votes


def page_text(source: str, path: str | None) -> str:
    """The blocks under the containers of the winning path, under the page's own best where that holds too little, and what belongs to them."""
    page = read_page(source)
    scores = page.scores()
    best = page.best()
    chosen = {i for i, p in enumerate(page.paths) if path is not None and p == path}
    if not chosen or sum(scores[i] for i in chosen) < LEAST * scores[best]:
        chosen |= {i for i, p in enumerate(page.paths) if p == page.paths[best]}
    return page.text(*page.grown(chosen))


def _vote_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], float] = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            for path, share in page_votes(source.as_py() or "").items():
                votes[host, path] = votes.get((host, path), 0.0) + share
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.float64())],
            names=["host", "path", "votes"],
        )


def _text_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [page_text(s.as_py() or "", p) for s, p in zip(part.column("html"), part.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning path of each host; pages: `host`, `html`."""
    votes = pages.select("host", "html").mapInArrow(_vote_scan, "host string, path string, votes double")
    # rounding makes the sum, and so the winner, the same in any order of the tasks
    summed = votes.groupBy("host", "path").agg(F.sum(F.col("votes").cast("decimal(20,6)")).alias("votes"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extract_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """`row` (the columns `keep`) and `text` of every page (`url`, `html`)."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), url_host(F.col("url")).alias("host"), "html")
    winners = stored(host_paths(rows), "winners")
    kind = rows.schema["row"].dataType.simpleString()
    return rows.join(winners, "host", "left").select("row", "html", "path").mapInArrow(_text_scan, f"row {kind}, text string")
