"""Main text of web pages by tree scoring.

A tokenizer that never fails reads tags, comments and text; open elements close
as browsers close them where end tags are missing. Each paragraph earns points
for being one, for its length and for its commas, and passes them to its parent
in full and to further ancestors in shrinking shares. Containers also have points
for what their tag and class say: an article or main element is worth some
paragraphs and no more. Points are discounted by link density, and the best
container is kept. Then its siblings, its parent's siblings and so on up to the
body are each kept or not by the same discounted points, those in an article or
another container of good standing with that container's points as well.

Menus, headers, footers, sidebars, forms, scripts and hidden elements that their
tags, roles or attributes name are left out wherever they stand. Elements whose
class or id has a word of OUT_WORDS (adverts, notices, sidebars, reader comments
and so on) are left out too, unless the words name a wrapper or a state
("content-sidebar-wrap", "post comments-open"): that is so where a class has
content words and no such word, where the element holds a main element, or where
it has more points than all that is left outside, if these are its articles' or its
words also have a content word. Words that often name content too (UNSURE_WORDS:
"related-work", "warning") leave an element out only if its text is short, full
of links or made of further articles, or stands outside of what is kept. Where
little or no text is left, words leave nothing out except reader comments.

Defined cases: null or empty html, and pages without text outside what is left
out, give an empty text; a script, style, title or textarea without an end runs
to the end of the page, as in browsers, and other elements without an end as far
as their parent; repeated rows give repeated results, null ids and urls stay null;
other columns pass only if they are page_id or url.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Set
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fractile.llm.common import map_frames

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

#: Kinds of elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
#: Of these, those that may lack an end without swallowing the page.
OPEN_RAW = {"iframe", "xmp", "noembed", "noframes"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p",
    "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "option", "select", "button",
}
SPACES = {"br", "hr", "img", "input", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "td", "pre", "blockquote", "li", "dd"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "svg", "canvas", "object", "audio", "video", "fieldset", "search", "datalist", "noscript", "template", *RAW}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
OUT_WORDS = {
    "nav", "navbar", "navigation", "menu", "menus", "sidebar", "sidebars", "footer", "masthead", "ad", "ads", "advert", "adverts", "advertisement", "advertising",
    "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal",
    "overlay", "subscribe", "subscription", "newsletter", "signup", "login", "comment", "comments", "commentlist", "disqus", "respond", "replies",
    "reply", "share", "sharing", "social", "related", "recommended", "recommendations", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar",
    "widget", "hidden", "skip", "alert", "warning", "disclaimer", "paywall",
}
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "respond", "replies", "reply"}
CONTENT_WORDS = {"article", "content", "entry", "main", "post", "story", "text", "body", "page", "blog"}
#: Words that name content as often, alone or in a class with other words.
UNSURE_ALONE = {"warning", "alert", "disclaimer"}
UNSURE_WORDS = UNSURE_ALONE | {"related", "recommended", "recommendations", "notice", "notices", "share", "sharing", "social", "promotion", "banner", "skip", "hidden", "subscription", "menu", "menus", "navigation", "toolbar", "widget"}
#: A text of fewer characters is little, and what replaces it has so many at least and so many times its length.
LITTLE, ENOUGH, TIMES = 140, 240, 4
#: Characters of the shortest paragraph with points, and points that a container gives or loses by its words.
SHORTEST, WORDS_WEIGHT = 25, 25.0
TAG_WEIGHT = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 3.0, "td": 3.0, "pre": 3.0, "blockquote": 3.0}
#: Points that keep a sibling: this share of the best container's, within these bounds.
SIBLING_SHARE, SIBLING_LEAST, SIBLING_MOST = 0.2, 10.0, 20.0
#: An element with unsure words has at least so many points and at most so many links.
UNSURE_POINTS, MOST_LINKS = 2.0, 0.25
#: An end tag of this kind of element on the left closes an open one on the right.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
BARRIERS = {"html", "body", "article", "section", "main", "div", "table", "ul", "ol", "dl", "aside", "nav", "header", "footer", "form", "blockquote", "td", "th", "li", "figure"}


_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.IGNORECASE) for t in (*RAW, "noscript", "template")}


class Node:
    __slots__ = ("tag", "parent", "hard", "words", "worded", "unsure", "main", "weight", "points", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, hard: bool = False, words: frozenset[str] = frozenset(), worded: bool = False, unsure: bool = False, main: bool = False, weight: float = 0.0) -> None:
        """hard: left out whatever the words say; worded: its own words may leave it out; unsure: those words are all unsure ones."""
        self.tag, self.parent, self.hard, self.words, self.worded, self.unsure, self.main, self.weight = tag, parent, hard, words, worded, unsure, main, weight
        self.points, self.chars, self.linked = None, 0, 0


@dataclass
class Block:
    """A run of text without block boundaries, white space made single; linked: its characters in links."""

    owner: Node
    text: str
    linked: int


def _said(attrs: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(attrs)}


def _open(tag: str, attrs: str, parent: Node) -> Node:
    hard, weight, worded, unsure, main, words = parent.hard or tag in DROPPED, TAG_WEIGHT.get(tag, 0.0), False, False, tag == "main", frozenset()
    if tag == "header" and not hard:
        hard = not any(x.tag in ("article", "main") for x in _ancestors(parent))
    if attrs.strip(" /\t\r\n"):
        said = _said(attrs)
        names = [frozenset(w.lower() for w in _PART.findall(x)) for x in (*said.get("class", "").split(), said.get("id", ""))]
        words = frozenset().union(*names)
        good, bad = bool(words & CONTENT_WORDS), words & OUT_WORDS
        if bad and not words & {"has", "with", "no"} and tag not in ("html", "body", "article", "main"):
            worded = not any(x & CONTENT_WORDS and not x & OUT_WORDS for x in names)
            unsure = all(x & OUT_WORDS <= UNSURE_ALONE or (x & OUT_WORDS <= UNSURE_WORDS and x - OUT_WORDS) for x in names)
        main |= said.get("role") == "main"
        if said.get("role") in DROPPED_ROLES or "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said.get("style", "")):
            hard = True
        weight += WORDS_WEIGHT * good - WORDS_WEIGHT * bool(bad)
    return Node(tag, parent, hard, words, worded, unsure, main, weight)


def parse(page: str, named: list[Node] | None = None) -> list[Block]:
    """Blocks in page order outside of what tags, roles and attributes leave out; named gets the open elements with words that may leave them out, articles and main elements."""
    root = Node("#root", None)
    stack, blocks, run = [root], [], []
    anchors, at, n = 0, 0, len(page)

    def flush() -> None:
        if run:
            text = " ".join("".join(t for t, _ in run).split())
            if text:
                owner = next(x for x in reversed(stack) if x.tag in BLOCKS or x.parent is None)
                blocks.append(Block(owner, text, min(len(text), sum(len(t) for t, a in run if a))))
            run.clear()

    def close_to(k: int) -> None:
        nonlocal anchors
        if any(x.tag in BLOCKS for x in stack[k:]):
            flush()
        anchors -= sum(x.tag == "a" for x in stack[k:])
        del stack[k:]

    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not stack[-1].hard:
            run.append((entities.unescape(text), anchors > 0))
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m["data"] and not stack[-1].hard:
                run.append((m["data"], anchors > 0))
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in BLOCKS and tag != "p":
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
                if tag not in BLOCKS and stack[k].tag in BARRIERS:
                    break
                if tag == "p" and stack[k].tag in BARRIERS:
                    flush()
                    break
            continue
        if tag in SPACES:
            run.append((" ", False))
        if tag in VOID:
            continue
        if tag in BLOCKS:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block begins
                if stack[k].tag == "p":
                    close_to(k)
                    break
                if stack[k].tag in BARRIERS:
                    break
            closes = CLOSED_BY.get(tag)
            if closes:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in closes:
                        close_to(k)
                        if tag != "tr" and tag != "tbody":
                            break
                    elif stack[k].tag in ("ul", "ol", "dl", "table", "select") or (tag not in ("tr", "tbody") and stack[k].tag in BARRIERS):
                        break
        attrs = m["attrs"] or ""
        if tag in RAW:
            if not attrs.endswith("/") or tag not in OPEN_RAW:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else at if tag in OPEN_RAW else n
            continue
        if attrs.endswith("/") and tag not in BLOCKS or tag in ("noscript", "template") and not _RAW_END[tag].search(page, at):
            continue
        stack.append(_open(tag, attrs, stack[-1]))
        if named is not None and not stack[-1].hard and (stack[-1].worded or stack[-1].main or tag == "article"):
            named.append(stack[-1])
        anchors += tag == "a"
    flush()
    return blocks


def prose(block: Block, shortest: int = SHORTEST) -> float:
    """Points of a paragraph: for being one, for its commas, for its length."""
    if len(block.text) < shortest or not (block.owner.tag in PARAGRAPHS or block.owner.tag in ("div", "section", "article", "main", "body", "#root")):
        return 0.0
    return 1.0 + block.text.count(",") + min(len(block.text) / 100.0, 3.0)


def _ancestors(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def left_out(blocks: list[Block], named: list[Node]) -> set[int]:
    """Of the elements with words (by id()) those that are left out; of unsure ones all, as `main_text` looks at them again."""
    worded = [n for n in named if n.worded]
    wraps = {id(x) for n in named if n.main for x in _ancestors(n)}
    articles = {id(n) for n in named if n.tag == "article" and not n.words & OUT_WORDS}
    holders = {id(x) for n in named if id(n) in articles for x in _ancestors(n)}
    own, left = {id(n): 0.0 for n in worded}, 0.0
    for b in blocks:
        points, article, outside = prose(b) * (1 - b.linked / len(b.text)), False, True
        for x in _ancestors(b.owner):
            article |= id(x) in articles
            if x.worded and id(x) not in wraps:
                outside = False
                if article or x.words & CONTENT_WORDS:
                    own[id(x)] += points
                break  # what lies in two such elements counts for the inner one
        left += points * outside
    spared = lambda n: id(n) in wraps or (not n.words & COMMENT_WORDS and (n.words & CONTENT_WORDS or id(n) in holders) and own[id(n)] > max(left, UNSURE_POINTS))
    return {id(n) for n in worded if not spared(n)}


def score(blocks: list[Block], out: Set[int] = frozenset(), shortest: int = SHORTEST) -> list[Node]:
    """Points, characters and linked characters of all containers of the blocks; the containers in page order. What is in an element of out adds to no container, and containers in it have no points but those that words lose."""
    seen: dict[int, Node] = {}
    for b in blocks:
        for x in _ancestors(b.owner):
            if id(x) not in seen:
                seen[id(x)] = x
                x.points, x.chars, x.linked = x.weight, 0, 0
        path = list(_ancestors(b.owner))
        if last := max((k for k, x in enumerate(path, 1) if id(x) in out), default=0):
            for x in path[:last]:
                x.points = -WORDS_WEIGHT
            continue
        for x in path:
            x.chars += len(b.text)
            x.linked += b.linked
        points, share, up = prose(b, shortest), 1.0, b.owner
        if b.owner.tag in PARAGRAPHS and b.owner.parent:
            up = b.owner.parent
        for level in range(1, 6):
            if points == 0 or up is None:
                break
            up.points += points * share
            share = 0.5 if level == 1 else 1.0 / (3 * level)
            up = up.parent
    return list(seen.values())


def worth(node: Node) -> float:
    """Points discounted by link density."""
    return node.points * (1 - _density(node))


def kept_containers(blocks: list[Block], out: Set[int] = frozenset()) -> set[int]:
    """The best container and the siblings, on every level up to the body, that are kept with it (by id())."""
    inside = [b for b in blocks if not any(id(x) in out for x in _ancestors(b.owner))]
    nodes = score(blocks, out, SHORTEST if any(prose(b) for b in inside) else 1)
    candidates = [x for x in nodes if x.tag != "p" and x.tag not in HEADINGS and x.tag in BLOCKS] or nodes
    best = max(candidates, key=worth)  # of equal ones the first
    least = min(max(SIBLING_LEAST, SIBLING_SHARE * worth(best)), SIBLING_MOST)
    texts: dict[int, int] = {id(b.owner): len(b.text) for b in inside if ". " in b.text + " " or len(b.text) > 80}
    kept, at, below = {id(best)}, best, {}
    for x in nodes:
        below.setdefault(id(x.parent), []).append(x)
    while at.parent and at.tag != "body":
        for x in below[id(at.parent)]:
            if x is at:
                continue
            standing = max(0.0, at.parent.weight) * (1 - _density(x))
            plain = at is best and _density(x) < MOST_LINKS and (x.tag == "h1" or (x.tag in PARAGRAPHS and id(x) in texts))
            if plain or max(0.0, worth(x) - max(0.0, x.weight)) + standing >= least or (x.weight >= WORDS_WEIGHT and worth(x) - x.weight * (1 - _density(x)) > 0 and worth(x) >= least):
                kept.add(id(x))
        at = at.parent
    return kept


def _best(blocks: list[Block], out: Set[int]) -> str:
    """The text of the kept containers, if the elements in out are left out."""
    inside, unsure = set(), {}
    for b in blocks:
        names = [x for x in _ancestors(b.owner) if id(x) in out]
        if not names:
            inside.add(id(b))
        elif all(x.unsure for x in names):
            unsure[id(b)] = names
    if not inside:
        return ""
    kept = kept_containers(blocks, out)
    own: dict[int, list[float]] = {}
    for b in blocks:
        for x in unsure.get(id(b), ()):
            at = own.setdefault(id(x), [0.0, 0, 0])
            at[0] += prose(b) if not any(y.tag == "article" for y in _until(b.owner, x)) else -1e9
            at[1] += len(b.text)
            at[2] += b.linked
    good = lambda x: own[id(x)][0] >= UNSURE_POINTS and own[id(x)][2] <= MOST_LINKS * own[id(x)][1]
    chosen = inside | {k for k, names in unsure.items() if all(map(good, names))}
    return " ".join(b.text for b in blocks if id(b) in chosen and any(id(x) in kept for x in _ancestors(b.owner)))


def _until(node: Node, end: Node) -> Iterator[Node]:
    for x in _ancestors(node):
        if x is end:
            return
        yield x


def main_text(page: str | None) -> str:
    named: list[Node] = []
    blocks = parse(page or "", named)
    out = left_out(blocks, named) if any(n.worded for n in named) else set()
    text = _best(blocks, out)
    if out and len(text) < LITTLE:
        strict = {id(n) for n in named if id(n) in out and n.words & COMMENT_WORDS}
        more = _best(blocks, strict) if strict != out else ""
        if len(more) >= max(ENOUGH, TIMES * len(text)):
            return more
    return text


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h) for h in frame["html"].tolist()]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    return map_frames(rows, task, "page_id", "url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    from fractile.llm.common import table

    return extract(table(spark, sf_dir, "pages"))
