"""Main text of web pages by tag-path ratios.

Every text node hangs on a root-to-leaf path of tags. Over each path of a page the length of
the text outside links and its punctuation are summed up, and divided by the nodes of the path.
Both ratios are smoothed twice, with the paths before and after in page order and with the
containers above (a heading or a list beside long paragraphs takes part of their ratio), and
fused by their product. Paths are content by two thresholds, shares of the page's mean weighted
by text: the higher one selects content nodes anywhere; the smallest element that holds most
of their text is the root of the content, and under it the lower threshold is enough. Links are
judged block by block: one that is nothing but links is left out where its path is mostly links
or it has no punctuation, unless it is a heading or a paragraph of an article; and where that
would leave nothing of what has a score, links do not count.

Forms and elements with a word in class or id that marks side matter (adverts, notices, comments and
so on) are no content, however much of the page they hold. Only a wrapper is forgiven its class: one
that holds the title or main part and at least half of the text; and, where a page has no other text, one
whose class does not name comments, adverts or notices. Text outside articles is weighed down where articles
hold at least half of the text. What HTML itself declares to be no content (head, navigation, footers,
asides, controls, scripts, hidden parts and such roles, and headers outside the main part) is left out before.

The block elements of content paths are the blocks of the text. A page is one row, so all of
this is a narrow step; pages are never shuffled. The work is linear in the page, however deep
its elements are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm._common import map_slices, utf8

#: Shares of the page's mean score: content anywhere, and content under the root.
HIGH, LOW = 0.2, 0.002
#: Share of the content's text that the root holds.
ROOT = 0.8
#: The weight of a container one level up, against the path itself.
UP = 0.5
#: Articles with this share of the text weigh the text outside by OUTSIDE.
MOST, OUTSIDE = 0.5, 0.25
#: A marked element with the title that holds this share of the text is a wrapper.
WRAPPER = 0.5
#: A block with this share of its text in links is nothing but links; a path with this share is mostly links.
LINKED, MOSTLY = 0.9, 0.5

#: Fixed values of HTML: elements without an end tag, with raw text, that end a block, that close an open paragraph.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_OPTIONAL = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
_CLOSES_P = _BLOCK - {"body", "html", "button", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "select"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Block elements of one line of thought: never the root of the content.
_LEAVES = _HEADINGS | frozenset("p pre li dt dd blockquote caption figcaption".split())
#: What no class or id marks: a heading, and what holds the main text.
_NEVER_BY_WORD = _HEADINGS | frozenset("html body main article".split())
#: An open element of these kinds keeps elements around it from being closed by a start tag inside.
_HOLDS = frozenset("table ul ol dl body html article section main div aside nav header footer form".split())
#: Elements and roles that are no main text.
_AWAY = frozenset("head nav footer aside button select dialog menu".split())
_AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
#: Words in a class or id that mark side matter: of adverts, notices and comments, and of other parts.
_OTHERS_WORDS = r"ads?|advert\w*|adbox|sponsor\w*|promo\w*|comments?|commentlist|disqus|discussions?|replies|responses?|cookies?|consent|gdpr|notice\w*|newsletter|subscribe|popup|modal|overlay"
_PARTS_WORDS = r"banner|nav\w*|menu\w*|header|masthead|footer|sidebar\w*|side|aside|breadcrumbs?|signup|login|share|sharing|social|related|recommended|widget\w*|toolbar|pagination|pager|search(?![\s_-]*results?)\w*|tags|copyright|disclaimer|hidden"
_OTHERS = re.compile(rf"(?:^|[\s_-])(?:{_OTHERS_WORDS})(?:$|[\s_-])")
_SIDE_WORDS = re.compile(rf"(?:^|[\s_-])(?:{_OTHERS_WORDS}|{_PARTS_WORDS})(?:$|[\s_-])")
#: A class that begins so says what a wrapper has, not what it is.
_TELLS = ("has-", "no-", "with-", "without-", "show-", "hide-", "is-")
#: Class names that make an article a reader's comment.
_COMMENT = frozenset("comment reply".split())

# An attribute's name runs up to white space, a slash, "=" or ">"; quotes count only right after "=". Possessive, so that no input is read twice.
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+))?"
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:{_VALUE})?+")
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE.replace('(', '(?:').replace('(?:?:', '(?:')})?+)*+)(?:>|\Z)", re.S)
_PUNCTUATION = re.compile(r"[,.;:!?…。、，！？؛،।]")
_SPACE = re.compile(r"\s+")


class Page:
    """The blocks of a page, each a run of text without a block border, with the paths, elements and marks they hang on."""

    def __init__(self) -> None:
        self.paths: dict[tuple[int, str], int] = {}  # (path above, tag) to path
        self.above: list[int] = []  # of each path; a path's number is higher than that of the one above
        self.outer: list[int] = []  # the element around each block element, numbered as they open
        self.holder: list[int] = []  # each element itself, or for a paragraph and the like the element around it
        self.tags: list[str] = []  # of each path
        self.marks: list[int] = []  # the marked element around each marked element
        self.others: list[bool] = []  # whether its mark is one of adverts, notices or comments
        self.titled: list[bool] = []  # whether a marked element has an h1 or main, or, if it is not one of those, an article
        self.blocks: list[Block] = []

    def path(self, above: int, tag: str) -> int:
        found = self.paths.setdefault((above, tag), len(self.above))
        if found == len(self.above):
            self.above.append(above)
            self.tags.append(tag)
        return found


class Block:
    __slots__ = ("article", "element", "link", "mark", "path", "text")

    def __init__(self, path: int, element: int, mark: int, article: bool) -> None:
        self.path, self.element, self.mark, self.article, self.text, self.link = path, element, mark, article, [], 0


class _Open:
    """An open element: what text inside hangs on."""

    __slots__ = ("article", "away", "element", "ended", "mark", "path", "tag")

    def __init__(self, tag: str, path: int, element: int, mark: int, away: bool, article: bool) -> None:
        self.tag, self.path, self.element, self.mark, self.away, self.article, self.ended = tag, path, element, mark, away, article, False


def _kind(tag: str, attributes: str, in_main: bool) -> tuple[bool, int]:
    """Whether an element is no main text by its kind, role or style, and whether it is side matter (1; 2: by a word of adverts, notices or comments)."""
    if tag in _AWAY or tag == "header" and not in_main:
        return True, 0
    side = int(tag == "form")
    if not attributes:
        return False, side
    seen = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name in seen:  # of several attributes of one name HTML takes the first
            continue
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _AWAY_ROLES:
            return True, 0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, 0
        if name not in ("class", "id"):
            continue
        if tag not in _NEVER_BY_WORD:
            named = " ".join(c for c in value.split() if not c.startswith(_TELLS))
            side = 2 if _OTHERS.search(named) else max(side, int(_SIDE_WORDS.search(value) is not None))
        elif tag == "article" and name == "class" and not _COMMENT.isdisjoint(value.split()):
            side = 2
    return False, side


def _self_closed(attributes: str) -> bool:
    """Whether a start tag ends in "/>"; the slash of an unquoted value is the value's."""
    if not attributes.endswith("/"):
        return False
    return not any(m[4] is not None and m.end() == len(attributes) for m in _ATTRIBUTE.finditer(attributes))


def parse(page: str) -> Page:
    """The blocks of a page in order, without what HTML declares to be no content. Unclosed elements end with their parent, or with the page."""
    out = Page()
    stack = [_Open("", -1, -1, -1, False, False)]
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are
    holds: list[int] = []  # where those of _HOLDS are
    shut_blocks: list[int] = []  # where block elements are
    links = 0
    now: Block | None = None
    ends: dict[str, re.Pattern[str]] = {}

    def text(raw: str) -> None:
        nonlocal now
        top = stack[-1]
        if not raw or top.away or now is None and not raw.strip():
            return
        if now is None:
            now = Block(top.path, top.element, top.mark, top.article)
            out.blocks.append(now)
        said = html.unescape(raw)
        now.text.append(said)
        if links:
            now.link += len(said.strip())

    def cut(k: int) -> None:
        """End the open elements from place k on."""
        nonlocal links, now
        if stack[-1].away != stack[k - 1].away or stack[-1].mark != stack[k - 1].mark:
            now = None
        while len(stack) > k:
            gone = stack.pop()
            if not gone.ended:
                places[gone.tag].pop()
                links -= gone.tag == "a"
            if gone.tag in _HOLDS:
                holds.pop()
            if gone.tag in _BLOCK:
                shut_blocks.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if tag in _BLOCK:
            now = None
        if m[1]:
            mine = places.get(tag)
            if mine:
                k = mine[-1]
                if tag not in _BLOCK and shut_blocks and shut_blocks[-1] > k:
                    # Blocks inside stay open; the element itself has ended.
                    stack[k].ended = True
                    mine.pop()
                    links -= tag == "a"
                else:
                    cut(k)
            continue
        if tag in ("svg", "math") and _self_closed(m[3]):
            continue
        if tag in _RAW:
            end = ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}[\s/>]", re.I)).search(page, at)
            close = page.find(">", end.end() - 1) if end else -1
            at = n if end is None or close < 0 else close + 1
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                text(" ")
            continue
        shut = max((places[t][-1] for t in (*_OPTIONAL.get(tag, ()), *(("p",) if tag in _CLOSES_P else ())) if places.get(t)), default=0)
        if shut and shut > (holds[-1] if holds else 0):
            cut(shut)
        top = stack[-1]
        away, side = _kind(tag, m[3], top.article) if not top.away else (True, 0)
        block = tag in _BLOCK
        path, element, mark = top.path, top.element, top.mark
        if block and not away:
            path = out.path(top.path, tag)
            element = len(out.outer)
            out.outer.append(top.element)
            out.holder.append(element if tag not in _LEAVES else out.holder[top.element] if top.element >= 0 else -1)
        if side:
            now = None
            mark = len(out.marks)
            out.marks.append(top.mark)
            out.others.append(side == 2)
            out.titled.append(False)
        if away != top.away:
            now = None
        if mark >= 0 and not away and (tag in ("h1", "main") or tag == "article" and not out.others[mark] and not side):
            out.titled[mark] = True
        k = len(stack)
        places.setdefault(tag, []).append(k)
        if tag in _HOLDS:
            holds.append(k)
        if block:
            shut_blocks.append(k)
        links += tag == "a"
        stack.append(_Open(tag, path, element, mark, away, top.article or tag in ("article", "main")))
    return out


def _smooth(own: np.ndarray, weight: np.ndarray, leaf: np.ndarray, plain: np.ndarray, above: np.ndarray, n_paths: int) -> np.ndarray:
    """The ratio of each leaf (in page order) by its neighbours and by the containers above it, whichever is more.

    leaf: its path; weight: its text; plain: whether no mark weighs it down by half, as only such are neighbours. A container's ratio is the mean of the leaves right in it, by their text.
    """
    line = own.copy()
    if plain.any():
        line[plain] = np.convolve(np.pad(own[plain], 1, mode="edge"), np.full(3, 1 / 3), "valid")
    mass, total = np.zeros(n_paths + 1), np.zeros(n_paths + 1)  # the last is the page itself
    np.add.at(mass, above[leaf], weight)
    np.add.at(total, above[leaf], weight * own)
    ratio = np.full(n_paths + 1, np.nan)
    if mass[-1]:
        ratio[-1] = total[-1] / mass[-1]
    for p in range(n_paths):  # containers come before what they hold
        up = ratio[above[p]]
        mine = total[p] / mass[p] if mass[p] else np.nan
        ratio[p] = up if mine != mine else mine if up != up else (mine + UP * up) / (1 + UP)
    up = ratio[above[leaf]]
    return np.maximum(np.maximum(own, line), np.where(np.isnan(up), own, (own + UP * up) / (1 + UP)))


def _add_up(values: np.ndarray, outer: list[int]) -> np.ndarray:
    """The sum over each element and all inside it."""
    out = values.copy()
    for k in range(len(outer) - 1, -1, -1):
        if outer[k] >= 0:
            out[outer[k]] += out[k]
    return out


def main_text(page: str | None) -> str:
    """The main text of one page: its content blocks, white space made one space, joined by an empty line."""
    found = parse(page or "")
    shown = [(b, t) for b in found.blocks if (t := _SPACE.sub(" ", "".join(b.text)).strip())]
    if not shown:
        return ""
    size = np.array([len(t) for _, t in shown], float)
    link = np.minimum([b.link for b, _ in shown], size)
    punctuation = np.array([len(_PUNCTUATION.findall(t)) for _, t in shown], float)
    element = np.array([b.element for b, _ in shown])
    mark = np.array([b.mark for b, _ in shown])
    marked = _unmarked(found, mark, size)
    inside = np.array([b.article for b, _ in shown])
    said = size - link
    weight = marked
    if inside.any() and said[inside].sum() >= MOST * said.sum():
        weight = np.where(inside, marked, OUTSIDE * marked)
    # Paths: marked text has its own, so that neither sways the other.
    order: dict[tuple[int, int], int] = {}
    at = np.array([order.setdefault((b.path, b.mark), len(order)) for b, _ in shown])
    nodes, length, marks, linked = (np.bincount(at, x, len(order)) for x in (np.ones(len(shown)), size, punctuation, link))
    leaf, plain = np.array([p for p, _ in order], int), np.ones(len(order), bool)
    plain[at] = marked > 0
    above = np.append(np.array(found.above, int), -1)
    n_paths = len(found.above)
    smooth = (_smooth(x / nodes, length, leaf, plain, above, n_paths) for x in (length - linked, marks))
    fused = next(smooth) * (1 + next(smooth))
    score = fused[at] * weight
    mean = (score * size).sum() / size.sum()
    text_like = score > 0
    heading = np.array([b.path >= 0 and (found.tags[b.path] in _HEADINGS or b.article and found.tags[b.path] == "p") for b, _ in shown])
    links = (link >= LINKED * size) & ~heading & ((linked >= MOSTLY * length)[at] | (punctuation == 0))
    if (text_like & ~links).any():
        text_like &= ~links
    high = text_like & (score >= HIGH * mean)
    content = high
    if high.any() and len(found.outer):
        mass = np.zeros(len(found.outer) + 1)
        np.add.at(mass, np.append(np.array(found.holder, int), -1)[element[high]], size[high])
        root = _root(_add_up(mass[:-1], found.outer), found.outer, ROOT * size[high].sum())
        under = np.zeros(len(found.outer) + 1, bool)
        for k, outer in enumerate(found.outer):
            under[k] = k == root or under[outer] or root < 0
        under[-1] = root < 0
        content = high | text_like & under[element] & (score >= LOW * mean)
    return "\n\n".join(t for (_, t), c in zip(shown, content.tolist(), strict=True) if c)


def _unmarked(found: Page, mark: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 for each block that no marked element holds but forgiven wrappers, else 0. mark: the innermost marked element around each block; size: its text."""
    if not found.marks:
        return np.ones(len(mark))
    held = np.zeros(len(found.marks))
    np.add.at(held, mark[mark >= 0], size[mark >= 0])
    held = _add_up(held, found.marks)
    titled = found.titled[:]
    for k in range(len(found.marks) - 1, -1, -1):
        outer = found.marks[k]
        if titled[k] and outer >= 0 and (found.others[k] or not found.others[outer]):
            titled[outer] = True

    def kept(forgiven: list[bool]) -> np.ndarray:
        factor = np.ones(len(found.marks) + 1)  # the last is what no mark holds
        for k, outer in enumerate(found.marks):
            factor[k] = factor[outer] * forgiven[k]
        return factor[mark]

    wrapper = [t and h >= WRAPPER * size.sum() for t, h in zip(titled, held.tolist(), strict=True)]
    out = kept(wrapper)
    return out if out.any() else kept([w or not o for w, o in zip(wrapper, found.others, strict=True)])


def _root(held: np.ndarray, outer: list[int], least: float) -> int:
    """The innermost element that holds at least so much; -1, the page, if none does."""
    enough = np.flatnonzero(held >= least)
    return int(enough[-1]) if len(enough) else -1


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points): one row for each row of ``pages``. Null html gives an empty text."""

    def read(name: str, kind: str) -> Column:
        return F.col(f"`{name}`").cast(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.decode("utf-8", "replace")) for x in utf8(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_slices(pages.select(read(id_col, "long").alias("page_id"), read(url_col, "string").alias("url"), read(html_col, "string").alias("html")), work, "page_id long, url string, text string, n_chars long")
