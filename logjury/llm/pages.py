"""Operator 3: main text of web pages by a maximum-scoring subsequence.

A page is a row of words and tags. Elements that never hold article text by their tag (scripts, styles,
forms, menus and the like) are cut out first. An element that is hidden, or that role or a word of class
or id marks as side bar, advert, reader comments or the like, is a row of its own. Its best stretch
counts ``MARKED`` of its sum, none if hidden, and wins only if that is more than the best stretch around
it, and never on a page that marks its content. If all content (``article``, ``main``) of a page stands
in such elements, these belong to the page's own row; a mark on the content itself counts for nothing. Then every word scores positive and every tag negative, with weights learned
from labelled pages, and one linear scan finds the contiguous stretch of the largest sum
(Pasternack and Roth, 2009). The blocks of that stretch are the text.

Weights: pages that mark their content by ``article`` or ``main`` are labels. A word's weight is
higher the more often words below that tag are content, a tag's penalty is larger the more often it
stands outside the content. Learned from are at most about ``TRAINING`` such pages, by a hash of the
id; the weights are one number for each of the most frequent ``TAGS`` tags.

Scale: one narrow pass over the sample to count, one narrow pass over all pages.

Defined cases: a null page is empty and has no text; unclosed elements end with the element around
them or with the page; unknown and broken tags are tags; a page of text without tags is its text;
ties in the scan go to the first and shortest stretch; text that is only white space gives no block;
repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from logjury.llm.shared import in_batches, of_texts, table

TRAINING = 2000
TAGS = 256
SMOOTH = 1.0
WORD_LEAST, WORD_MOST = 0.2, 2.0
TAG_LEAST, TAG_MOST = 0.02, 3.0
# Penalty of a tag the labelled pages lack outside what is cut out.
TAG_UNKNOWN = 0.1
# Share of its sum that a stretch within a marked element counts.
MARKED = 0.2

_PARTS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|title|textarea)\b(?P<raw_rest>[^>]*)>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_RAW_ENDS = {raw: re.compile(rf"</{raw}\b[^>]*>", re.IGNORECASE) for raw in ("script", "style", "title", "textarea")}
_NO_TEXT = re.compile(r"<[!?]")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAMED = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+")

# Elements that never hold article text.
DROPPED = frozenset(
    "script style noscript template iframe object embed svg math canvas head title nav footer aside form "
    "button select textarea input dialog menu".split()
)
# Words of class, id or role that mark such elements.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices alert "
    "comment comments commentlist commentbox disqus respond replies share sharing social related recommended "
    "newsletter subscribe signup login popup modal overlay widget toolbar pagination pager skip complementary "
    "contentinfo search gdpr privacy disclaimer paywall adbox adslot adsense adunit aside topbar".split()
)
# Words that mark the head of a page, unless they stand inside its content.
HEAD_MARKS = frozenset("header top logo brand".split())
# Elements that have no content and no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that stand within a line; all others part blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr td th".split()
)
# Elements that the next one of their kind ends.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
# Drawings, and elements that cannot stand in one.
DRAWINGS = frozenset(["svg", "math"])
HTML_ONLY = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 li ol p pre table ul article main section".split())
CONTENT = frozenset(["article", "main"])
# Their class and id tell of the whole page.
NEVER_MARKED = frozenset(["html", "body", "main"])


def _is_hidden(rest: str) -> bool:
    """True if the attributes hide the element; the word in a value does not."""
    low = rest.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for match in _NAMED.finditer(rest):
        name, value = match[1].lower(), match[2] or match[3] or match[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
        if name == "style" and _NOT_SHOWN.search(value):
            return True
    return False


def _is_marked(rest: str, in_content: bool) -> bool:
    """True for the attributes of an element that tells to hold no article text."""
    if "=" not in rest:
        return False
    for match in _ATTRIBUTE.finditer(rest):
        value = (match[2] or match[3] or match[4] or "").lower()
        parts = [part for part in _SPLIT.split(value) if part]
        parts += [a + b for a, b in zip(parts, parts[1:], strict=False)]  # side-bar
        if not MARKS.isdisjoint(parts) or (not in_content and not HEAD_MARKS.isdisjoint(parts)):
            return True
    return False


class Region:
    """The page, or a marked or hidden element; ``depth`` is that of the element, ``content`` if it has any."""

    __slots__ = ("content", "depth", "inside", "parent", "weight")

    def __init__(self, parent: Region | None, depth: int, weight: float, inside: bool):
        self.parent, self.depth, self.weight, self.inside, self.content = parent, depth, weight, inside, False


class Token:
    """A tag (``words`` 0) or a piece of text; ``block`` counts the blocks begun before it."""

    __slots__ = ("block", "content", "region", "tag", "text", "words")

    def __init__(self, tag: str, text: str, words: int, block: int, content: bool, region: Region):
        self.tag, self.text, self.words, self.block, self.content = tag, text, words, block, content
        self.region = region


def tokens(page: str) -> list[Token]:
    """Tags and texts outside the dropped elements. Texts have their references decoded."""
    found: list[Token] = []
    stack: list[str] = []
    open_tags: Counter = Counter()
    dropped_from = None  # depth of the element being dropped
    regions = [Region(None, 0, 1.0, False)]
    content = block = at = 0
    closes = EndTags(page)
    last = page.rfind(">")  # beyond it nothing is a tag
    while at <= last:
        match = _PARTS.match(page, at)
        at = match.end()
        text = match["text"]
        if text is not None:
            if dropped_from is None:
                plain = references.unescape(text)
                found.append(Token(stack[-1] if stack else "", plain, len(plain.split()), block, content > 0, regions[-1]))
            continue
        raw = match["raw"]
        if raw:
            close = _RAW_ENDS[raw.lower()].search(page, at, last + 1)
            at = close.end() if close else len(page)
            if dropped_from is None:
                found.append(Token(raw.lower(), "", 0, block, content > 0, regions[-1]))
            continue
        tag = (match["tag"] or match["tag2"] or "").lower()
        if not tag:
            continue  # a comment or declaration
        rest = match["rest"] or match["rest2"] or ""
        if match["end"] or match["end2"]:
            if not open_tags[tag]:
                continue
            while True:
                closed = stack.pop()
                open_tags[closed] -= 1
                content -= closed in CONTENT
                if closed == tag:
                    break
            if dropped_from is not None and len(stack) < dropped_from:
                dropped_from = None
                block += 1
                continue
            if regions[-1].depth > len(stack):
                while regions[-1].depth > len(stack):
                    regions.pop()
                block += 1
                continue
        elif tag not in VOID and not rest.endswith("/"):
            if dropped_from is not None and tag in HTML_ONLY and stack[dropped_from - 1] in DRAWINGS and "foreignobject" not in stack:
                # Such an element ends a drawing around it, whose end tag is missing.
                for closed in stack[dropped_from - 1 :]:
                    open_tags[closed] -= 1
                    content -= closed in CONTENT
                del stack[dropped_from - 1 :]
                dropped_from = None
                block += 1
            if tag in CONTENT and dropped_from is not None and not closes.after(at, stack[dropped_from - 1]):
                # The element being dropped has no end tag, so the content must have ended it.
                for closed in stack[dropped_from - 1 :]:
                    open_tags[closed] -= 1
                del stack[dropped_from - 1 :]
                dropped_from = None
                block += 1
            if tag in CONTENT and dropped_from is None and not content and regions[-1].depth:
                outer = regions[-1]
                if not closes.after(at, stack[outer.depth - 1]):  # as above
                    for closed in stack[outer.depth - 1 :]:
                        open_tags[closed] -= 1
                    del stack[outer.depth - 1 :]
                    regions.pop()
                    block += 1
            if tag in SELF_CLOSING and stack and stack[-1] == tag and dropped_from != len(stack):
                stack.pop()
                open_tags[tag] -= 1
                if regions[-1].depth > len(stack):
                    regions.pop()
                    block += 1
            stack.append(tag)
            open_tags[tag] += 1
            if dropped_from is None:
                is_head = tag == "header" and not content
                is_whole = tag in NEVER_MARKED or (tag in CONTENT and not content)
                if tag in DROPPED or is_head:
                    dropped_from = len(stack)
                    found.append(Token(tag, "", 0, block, content > 0, regions[-1]))
                    block += 1
                elif not is_whole and ((hidden := _is_hidden(rest)) or _is_marked(rest, content > 0)):
                    found.append(Token(tag, "", 0, block, content > 0, regions[-1]))
                    block += 1
                    weight = 0.0 if hidden else MARKED * regions[-1].weight
                    regions.append(Region(regions[-1], len(stack), weight, content > 0))
                elif tag in CONTENT and not content:
                    regions[-1].content = True
            content += tag in CONTENT
        if dropped_from is None:
            if tag not in INLINE:
                block += 1
            found.append(Token(tag, " " if tag in ("br", "td", "th") else "", 0, block, content > 0, regions[-1]))
    if at < len(page) and dropped_from is None:
        plain = references.unescape(_NO_TEXT.split(page[at:], maxsplit=1)[0])
        found.append(Token(stack[-1] if stack else "", plain, len(plain.split()), block, content > 0, regions[-1]))
    return found


class EndTags:
    """Whether an element's end tag comes later in a page; the page is searched once per name asked for."""

    def __init__(self, page: str):
        self.page = page
        self.last: dict[str, int] = {}

    def after(self, at: int, tag: str) -> bool:
        if tag not in self.last:
            found = re.compile(rf"</{re.escape(tag)}\b", re.IGNORECASE).finditer(self.page)
            self.last[tag] = max((match.start() for match in found), default=-1)
        return self.last[tag] >= at


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First index and the one behind the last of the stretch of the largest positive sum."""
    best, first, stop = 0.0, 0, 0
    total, begin = 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += score
        if total > best:
            best, first, stop = total, begin, k + 1
    return first, stop


class Weights:
    """Scores of words by the tag they stand in, and penalties of tags."""

    def __init__(self, counts: dict[tuple[str, bool], tuple[int, int]]):
        def odds(inside: int, outside: int) -> float:
            return math.log((inside + SMOOTH) / (outside + SMOOTH))

        self.word, self.tag = {}, {}
        for (tag, is_word), (inside, outside) in counts.items():
            if is_word:
                self.word[tag] = min(WORD_MOST, max(WORD_LEAST, 1 + odds(inside, outside) / 4))
            else:
                self.tag[tag] = min(TAG_MOST, max(TAG_LEAST, -odds(inside, outside)))

    def scores(self, row: list[Token]) -> list[float]:
        return [
            t.words * self.word.get(t.tag, 1.0) if t.words else -self.tag.get(t.tag, TAG_UNKNOWN) if not t.text.strip() else 0.0
            for t in row
        ]


def by_region(found: list[Token]) -> dict[Region, list[Token]]:
    """The tokens of every region, the page first, which takes in the regions of all its content if it has none."""
    rows: dict[Region, list[Token]] = {}
    if not found:
        return rows
    page = found[0].region
    while page.parent:
        page = page.parent
    own = {page}
    if not page.content:
        for region in {t.region for t in found if t.region.content and not t.region.inside}:
            page.content = True
            while region:
                own.add(region)
                region = region.parent
    rows[page] = []
    for token in found:
        rows.setdefault(page if token.region in own else token.region, []).append(token)
    return rows


def main_text(page: str | None, weights: Weights) -> str:
    rows = by_region(tokens(page or ""))
    best, chosen = 0.0, []
    for region, row in rows.items():
        scores = weights.scores(row)
        first, stop = best_stretch(scores)
        total = sum(scores[first:stop]) * region.weight
        if total > best:
            best, chosen = total, row[first:stop]
        if region.content:
            break  # the page's own row comes first
    blocks: dict[int, list[str]] = {}
    for token in chosen:
        blocks.setdefault(token.block, []).append(token.text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(text for text in joined if text)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside: Counter = Counter()
    outside: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            for token in next(iter(by_region(tokens(page)).values()), []):
                key = (token.tag, token.words > 0)
                (inside if token.content else outside)[key] += max(1, token.words)
    keys = sorted(inside.keys() | outside.keys())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.bool_()),
            pa.array([inside[k] for k in keys], pa.int64()),
            pa.array([outside[k] for k in keys], pa.int64()),
        ],
        names=["tag", "is_word", "inside", "outside"],
    )


def learn(pages: DataFrame, page_id: str = "page_id", html: str = "html", limit: int = TRAINING) -> Weights:
    """Weights from about ``limit`` pages that mark their content."""
    marked = pages.where(F.col(html).rlike(r"(?i)<(article|main)[\s>]"))
    rows = marked.count()
    share = F.pmod(F.xxhash64(F.lit(3), F.col(page_id)), F.lit(1 << 20)) < (limit / max(rows, 1)) * (1 << 20)
    counted = in_batches(
        marked.where(share).select(html), _count_batches, "tag string, is_word boolean, inside long, outside long"
    )
    sums = counted.groupBy("tag", "is_word").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    common = sums.orderBy(F.desc(F.col("inside") + F.col("outside")), "tag", "is_word").limit(2 * TAGS).collect()
    return Weights({(r["tag"], r["is_word"]): (r["inside"], r["outside"]) for r in common})


def extract(pages: DataFrame, weights: Weights, keep: list[str], html: str = "html", name: str = "text") -> DataFrame:
    """The columns ``keep`` and the main text under ``name``."""

    def run(found: list) -> list[pa.Array]:
        return [pa.array([main_text(page, weights) for page in found], pa.string())]

    return of_texts(pages, keep, html, {name: StringType()}, run)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
