"""Main text of web pages by tag-path ratios.

Every block of a page has a path of tags from the root to its leaf. Per path the text lengths
and punctuation marks of its blocks are summed and divided by the number of blocks, and the
share of text in links is taken off; each block gets the ratios of its path. Both ratios are
smoothed over the blocks in page order and multiplied, and a path's score is the mean of its
blocks'. Tags and words of class, id or role that name parts beside an article (menus, forms,
adverts, comments ...) are marked in the path and only weigh: each makes the scores below it
smaller, an article or main element larger. Paths above a share of the deviation of all scores
are content. The container is the deepest element that holds most of the content's score; the main
text is its blocks but for those in marked parts within it whose paths are not content. So a
marked wrapper around everything changes nothing, and a marked part beside the article is left.

A page is parsed by a linear pass over its tags, in time that doesn't depend on the depth of its
elements. Unclosed elements end with their parent, unclosed tags with the page. Hidden elements,
scripts, styles and choices have no text.

Defined cases: a null, empty or text-less page has an empty text. Text outside of any tag is a
block. Pages are whole: nothing is cut. Repeated rows are read one by one; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Share of the deviation of the blocks' scores, from 0, above which a path is content.
THRESHOLD = 0.4
#: Share of the content's score that the container must hold.
HELD = 0.7
#: What a mark in a path, and an article or main element, multiply its score by.
MARKED, LEADING = 0.05, 4.0
#: Weights of a block and its neighbours when ratios are smoothed.
KERNEL = np.array([0.25, 0.5, 0.25])

# Tags by their meaning in HTML, and words that name parts beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
NO_TEXT = frozenset(
    "script style textarea title xmp iframe noembed noframes template select option svg object canvas audio video".split()
)
BESIDE = frozenset("head nav footer header aside form noscript button dialog menu".split())
ARTICLE = frozenset(("article", "main"))
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pagination popup promo promoted promotion related remark remarks respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget alert complementary contentinfo".split()
)
#: Words that say nothing beside those: "comment list" names comments, "share price" nothing.
NEUTRAL_WORDS = frozenset(
    "area bar block bottom box col column container content footer group inner item items left link links list main "
    "outer page post posts primary region right secondary section site slot top unit wrap wrapper zone".split()
)
#: Elements that can't be parts of a page.
_SMALL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead caption figure figcaption blockquote pre hr".split())
#: Elements that a new block ends.
_CLOSED_BY_BLOCK = "p"
_CLOSED_BY_SELF = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
_SCOPE = frozenset("ul ol dl table article section div main body".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？]")


class Element:
    """An open or closed element. ``number`` is its place among the page's elements, parents first."""

    __slots__ = ("tag", "number", "none", "inline", "within", "linked", "marks", "path", "block")

    def __init__(self, tag: str, parent: Element | None, number: int, path: int, marked: bool, none: bool):
        self.tag, self.number, self.path, self.inline = tag, number, path, tag in INLINE
        self.none = none or tag in NO_TEXT or (parent is not None and parent.none)
        #: Whether it is within an article or main element, and within a link.
        self.within = parent is not None and (parent.within or parent.tag in ARTICLE)
        self.linked = tag == "a" or (parent is not None and parent.linked)
        self.marks = marked + (parent.marks if parent is not None else 0)
        #: The nearest element that isn't inline.
        self.block = parent.block if self.inline and parent is not None else self


class Block:
    """Text between two block borders, with the element that holds it."""

    __slots__ = ("owner", "path", "text", "linked")

    def __init__(self, owner: Element, path: int, text: str, linked: int):
        self.owner, self.path, self.text, self.linked = owner, path, text, linked


def _attributes(more: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(more):
        found.setdefault(name.lower(), "".join(values))
    return found


def _is_hidden(attributes: dict[str, str]) -> bool:
    return (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").strip().lower() == "true"
        or _NO_DISPLAY.search(attributes.get("style", "")) is not None
    )


def _is_marked(tag: str, attributes: dict[str, str], within: bool) -> bool:
    """Whether an element's tag or words name a part beside an article; ``within`` one, headers are its own."""
    if tag in BESIDE:
        return not (within and tag == "header")
    if tag in ARTICLE and not within or tag in INLINE or tag in _SMALL or tag in ("html", "body"):
        return False
    own = BESIDE_WORDS - {"header"} if within else BESIDE_WORDS
    for name in ("class", "id", "role"):
        for value in attributes.get(name, "").lower().split():
            words = set(_SPLIT.split(value)) - {""}
            if words & own and not words - own - NEUTRAL_WORDS:
                return True
    return False


class Page:
    """A parsed page: its blocks, the parent of every element, and what each path weighs."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.parents: list[int] = [-1]
        self.weights: list[float] = [1.0]
        self._paths: dict[tuple[int, str, bool], int] = {}
        self._read(html)

    def _path(self, parent: int, tag: str, marked: bool) -> int:
        key = (parent, tag, marked)
        known = self._paths.get(key)
        if known is None:
            known = self._paths[key] = len(self.weights)
            self.weights.append(self.weights[parent] * (MARKED if marked else LEADING if tag in ARTICLE else 1.0))
        return known

    def _read(self, html: str) -> None:
        root = Element("", None, 0, 0, False, False)
        stack = [root]
        open_tags: defaultdict[str, int] = defaultdict(int)
        pieces: list[str] = []
        linked = path = 0

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(pieces).split())
            if text:
                self.blocks.append(Block(stack[-1].block, path, text, min(linked, len(text))))
            pieces.clear()
            linked = 0

        def say(text: str) -> None:
            nonlocal linked, path
            top = stack[-1]
            if not text or top.none:
                return
            if not pieces:
                path = top.path
            decoded = unescape(text)
            pieces.append(decoded)
            if top.linked:
                linked += len(decoded.strip())

        def close(depth: int) -> None:
            if any(not e.inline for e in stack[depth:]):
                flush()
            cut(depth)

        def cut(depth: int) -> None:
            for element in stack[depth:]:
                open_tags[element.tag] -= 1
            del stack[depth:]

        at, size = 0, len(html)
        while at < size:
            match = _TOKEN.search(html, at)
            if match is None:
                say(html[at:])
                break
            say(html[at : match.start()])
            at = match.end()
            tag = match["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if match["end"]:
                if not open_tags[tag]:
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close(depth)
                        break
                    if stack[depth].tag in _SCOPE and tag in INLINE | {"p", "li"}:
                        break
                continue
            if tag not in INLINE:
                flush()
                _end_implied(stack, open_tags, tag, cut)
            if tag in VOID:
                if tag == "br":
                    pieces.append(" ")
                continue
            more = match["more"] or ""
            top = stack[-1]
            attributes = _attributes(more) if more else {}
            marked = not top.none and _is_marked(tag, attributes, top.within or top.tag in ARTICLE)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.IGNORECASE).search(html, at)
                at = end.end()
                continue
            if more.endswith("/") and tag in ("path", "circle", "rect", "use"):
                continue
            number = len(self.parents)
            self.parents.append(top.number)
            none = bool(attributes) and _is_hidden(attributes)
            stack.append(Element(tag, top, number, self._path(top.path, tag, marked), marked, none))
            open_tags[tag] += 1
        flush()


def _end_implied(stack: list[Element], open_tags: dict[str, int], tag: str, cut) -> None:
    """End an open paragraph before a block, and an item before its next."""
    ends = _CLOSED_BY_SELF.get(tag, frozenset())
    if not open_tags[_CLOSED_BY_BLOCK] and not any(open_tags[end] for end in ends):
        return
    for depth in range(len(stack) - 1, 0, -1):
        open_tag = stack[depth].tag
        if open_tag == _CLOSED_BY_BLOCK or open_tag in ends:
            cut(depth)
            if open_tag != _CLOSED_BY_BLOCK or not ends:
                return
        elif open_tag in _SCOPE or (not stack[depth].inline and not ends):
            return


def _smoothed(values: np.ndarray) -> np.ndarray:
    weight = np.convolve(np.ones(len(values)), KERNEL, "same")
    return np.convolve(values, KERNEL, "same")[: len(values)] / weight[: len(values)] if len(values) >= 3 else values


def path_scores(page: Page) -> dict[int, float]:
    """Fused score of every path: smoothed ratios of text and punctuation, weighed by its marks."""
    text, marks, links, count = (defaultdict(float) for _ in range(4))
    for block in page.blocks:
        text[block.path] += len(block.text)
        marks[block.path] += 1 + len(_MARKS.findall(block.text))
        links[block.path] += block.linked
        count[block.path] += 1
    plain = {p: (text[p] - links[p]) / count[p] for p in text}
    pointed = {p: marks[p] / count[p] * (1 - links[p] / text[p]) for p in text}
    weight = np.array([page.weights[b.path] for b in page.blocks])
    by_text = _smoothed(np.array([plain[b.path] for b in page.blocks]))
    by_marks = _smoothed(np.array([pointed[b.path] for b in page.blocks]))
    fused = defaultdict(float)
    for block, value in zip(page.blocks, by_text * by_marks * weight, strict=True):
        fused[block.path] += value / count[block.path]
    return dict(fused)


def content_paths(page: Page, scores: dict[int, float]) -> set[int]:
    """Paths whose score is above the threshold."""
    each = np.array([scores[b.path] for b in page.blocks])
    least = THRESHOLD * np.sqrt((each**2).mean())
    return {p for p, value in scores.items() if value >= least}


def _container(page: Page, scores: dict[int, float], content: set[int]) -> int:
    """Deepest element, above the single blocks, that holds most of the content's score."""
    held = np.zeros(len(page.parents))
    below: dict[int, list[int]] = defaultdict(list)
    there = np.zeros(len(page.parents), bool)
    for block in page.blocks:
        there[block.owner.number] = True
        if block.path in content:
            held[block.owner.number] += scores[block.path]
    for number in range(len(page.parents) - 1, 0, -1):
        if there[number]:
            parent = page.parents[number]
            there[parent] = True
            held[parent] += held[number]
            below[parent].append(number)
    at = 0
    while below[at]:
        best = max(below[at], key=lambda n: held[n])
        if held[best] < HELD * held[at] or not below[best]:
            break
        at = best
    return at


def main_text(html: str | None, scored=path_scores) -> str:
    """The main text of a page: its container's blocks, joined by one space.

    ``scored`` gives the score of every path.
    """
    page = Page(html or "")
    if not page.blocks:
        return ""
    scores = scored(page)
    content = content_paths(page, scores)
    holder = _container(page, scores, content)
    inside = [False] * len(page.parents)
    inside[holder] = True
    for number in range(holder + 1, len(page.parents)):
        inside[number] = inside[page.parents[number]]
    within = [b for b in page.blocks if inside[b.owner.number]]
    least = min(b.owner.marks for b in within)
    return " ".join(b.text for b in within if b.owner.marks == least or b.path in content)


@F.arrow_udf(StringType())
def _extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([main_text(page) for page in pages.to_pylist()], pa.string())


def extract_text(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    return pages.select("page_id", "url", _extracted(F.col(html)).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
