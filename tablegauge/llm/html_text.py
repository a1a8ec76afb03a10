"""The main text of web pages by the distribution of their line blocks.

Markup is stripped to lines, one per block of text; what the markup itself names as furniture (menus, headers, footers, adverts,
forms, scripts) leaves empty lines, as does the space between containers. The lengths of lines are summed over sliding windows. A
stretch of text begins where the sum surges from nothing and ends where it dives to nothing; stretches that reach the
threshold are the main text. An article's border is a gap, and its lines weigh more; they are chosen by the same sums as all others.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and characters that one window of a stretch must reach; half of the fullest window is enough in a short page.
WINDOW = 3
THRESHOLD = 80
#: A character of an article counts as so many.
WEIGHT = 80

#: Elements of HTML by their role.
_RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "title", "select")
_FURNITURE = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "figcaption"}
_MAIN = {"article", "main"}
#: Raw or furniture outside an article only; inside, their text is text: captions, formulas, buttons.
_TEXT_INSIDE = {"textarea", "svg", "math", "object", "canvas", "select", "dialog", "button", "figcaption"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
           "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "body", "html", "article", "main", "header"}
_CLOSED_BY_BLOCK = {"p"}
#: Words in class, id or role that name furniture.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|advertising|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|disqus|footer|"
    r"masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|promoted|related|share|sharing|sidebar|"
    r"social|sponsor|sponsored|subscribe|toolbar|widget|contentinfo|complementary|search|site-?header|page-?header|replies|reply)(?:$|[\s_-])",
    re.IGNORECASE,
)

#: Words in class, id or role that name what is not the article's even inside it: comments, adverts, notices, menus and the like.
_FOREIGN = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert|advertisement|advertising|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|disqus|footer|menu|modal|nav|navbar|"
    r"navigation|newsletter|notice|pagination|popup|promo|promoted|replies|reply|sidebar|sponsor|sponsored|subscribe|toolbar)(?:$|[\s_-])",
    re.IGNORECASE,
)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.DOTALL)
_MARKED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for name in _RAW}
_SPACE = re.compile(r"\s+")


def _is_furniture(name: str, attributes: str, inside_main: bool) -> bool:
    if name in _FURNITURE and not (inside_main and name in _TEXT_INSIDE) or name == "header" and not inside_main:
        return True
    return bool(_HIDDEN.search(attributes)) or not inside_main and _is_named(name, attributes)


def _is_named(name: str, attributes: str, names: re.Pattern = _NAMES) -> bool:
    return name not in ("html", "body", *_MAIN) and any(names.search(next(filter(None, m.groups()), "")) for m in _MARKED.finditer(attributes))


class _Due:
    """How many more ends than starts of an element follow in a page; each name's tags are found once."""

    def __init__(self, page: str):
        self.page = page
        self.known: dict[str, tuple[list[int], list[int]]] = {}

    def after(self, at: int, name: str) -> int:
        if name not in self.known:
            tags = [(m.start(), 1 if m[1] else -1) for m in re.finditer(rf"<(/?){name}(?=[\s/>])", self.page, re.IGNORECASE)]
            self.known[name] = [p for p, _ in tags], [*reversed(list(accumulate(s for _, s in reversed(tags)))), 0]
        places, ends = self.known[name]
        return ends[bisect.bisect_left(places, at)]


class _Open:
    """The open elements of a page: found by name, and the nearest furniture or article, without looking through all of them."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.borders: list[int] = []
        self.furniture: Counter[str] = Counter()

    def push(self, name: str, furniture: bool, main: bool, *more) -> None:
        self.places[name].append(len(self.stack))
        if furniture or main:
            self.borders.append(len(self.stack))
        if furniture:
            self.furniture[name] += 1
        self.stack.append((name, furniture, main, *more))

    def pop(self) -> tuple:
        top = self.stack.pop()
        self.places[top[0]].pop()
        if top[1] or top[2]:
            self.borders.pop()
        if top[1]:
            self.furniture[top[0]] -= 1
        return top

    def closed_by(self, name: str) -> int:
        """How many elements the end of ``name`` closes: up to the nearest of that name, but small ones reach over no article or furniture."""
        if not self.places[name]:
            return 0
        at = self.places[name][-1]
        if name in ("p", "li", "span", "b", "i", "a", "em", "strong") and self.borders and self.borders[-1] > at:
            return 0
        return len(self.stack) - at


def lines_of(page: str) -> tuple[list[str], np.ndarray]:
    """The lines of a page, empty ones where furniture or containers lie, and what a character of each weighs.

    A block inside an article that is named as foreign, such as comments, adverts or notices, is furniture unless it is the article's
    main stretch: without such blocks the article does not reach the threshold.
    """
    lines: list[str] = []
    weights: list[int] = []
    owners: list[tuple[int, int]] = []  # article, or 0, and foreign block in it, or 0
    current: list[str] = []
    opened, due = _Open(), _Due(page)
    dropped = mains = weak = 0
    article = foreign = n_articles = n_foreign = 0

    def end_line() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(current))).strip()
        current.clear()
        if text:
            lines.append(text)
            weights.append(WEIGHT if mains and not weak else 1)
            owners.append((article, foreign))

    def gap() -> None:
        end_line()
        lines.extend([""] * WINDOW)
        weights.extend([1] * WINDOW)
        owners.extend([(0, 0)] * WINDOW)

    def pop() -> None:
        nonlocal dropped, mains, weak, article, foreign
        # furniture around an article that is taken none the less; a gap and no weight; the first border of a foreign block
        _, furniture, main, around, light, strange = opened.pop()
        if furniture or main or light:
            gap()
        dropped += around - furniture
        mains -= main
        weak -= light
        foreign = 0 if strange else foreign
        article = article if mains else 0

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not dropped:
            current.append(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA[") and not dropped:
            current.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
        if not m[2]:
            continue
        name, closing, attributes = m[2].lower(), m[1], m[3].strip()
        if name not in _INLINE and not dropped:
            end_line()
        if closing:
            for _ in range(opened.closed_by(name)):
                pop()
            continue
        if name in _RAW_END and not (mains and not dropped and name in _TEXT_INSIDE):
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID or attributes.endswith("/") and name in _INLINE:
            continue
        if name not in _INLINE and opened.stack and opened.stack[-1][0] in _CLOSED_BY_BLOCK:
            pop()
        if name == "body":
            while opened.stack and opened.stack[-1][0] in ("head", "title"):
                pop()
        furniture = _is_furniture(name, attributes, mains > 0)
        # a form may be around the whole page, and a menu may lack its end: the sums decide on an article in them, without its weight
        around = dropped if name in _MAIN and all(
            o == "form" or due.after(at, o) < len(opened.places[o]) for o, n in opened.furniture.items() if n
        ) else 0
        dropped -= around
        # inside an article a container's name is weak evidence: its lines stand alone and without weight
        light = around > 0 or mains > 0 and not dropped and not furniture and name in _CONTAINERS and _is_named(name, attributes)
        main = name in _MAIN and not dropped
        strange = bool(light and mains and not foreign and _is_named(name, attributes, _FOREIGN))
        if furniture or main or light:
            if not dropped:
                gap()
            weak += light
            dropped += furniture
            if main and not mains:
                n_articles += 1
                article = n_articles
            mains += main
            if strange:
                n_foreign += 1
                foreign = n_foreign
        opened.push(name, furniture, main, around, light, strange)
    if not dropped:
        end_line()
    if n_foreign:
        own = Counter()
        for text, (a, f) in zip(lines, owners):
            own[a] += len(text) * (not f)
        lines = ["" if f and own[a] >= THRESHOLD else text for text, (a, f) in zip(lines, owners)]
    return lines, np.array(weights, np.int64)


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The main text of one page; blocks in page order, each with its white space made single spaces, joined by a line break."""
    if not page:
        return ""
    lines, weights = lines_of(page)
    lengths = np.array([len(t) for t in lines], np.int64) * weights
    if not lengths.any():
        return ""
    sums = np.convolve(lengths, np.ones(window, np.int64))[window - 1:]  # of the line and those after it
    threshold = min(threshold, (int(sums.max()) + 1) // 2)
    full = np.concatenate([[False], sums > 0, [False]])
    surges = np.flatnonzero(~full[:-1] & full[1:])
    dives = np.flatnonzero(full[:-1] & ~full[1:])
    kept: list[str] = []
    for a, b in zip(surges.tolist(), dives.tolist()):
        if sums[a:b].max() >= threshold:
            kept += [t for t in lines[a:b] if t]
    return "\n".join(kept)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, ``text`` and its length ``n_chars`` in code points.

    One row per row. A null, empty or blank page has an empty text; null ids and urls stay null; repeated rows each give a row; a
    page cut off anywhere is read to its end. Extra columns are ignored; an empty table gives an empty one.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        _run, "page_id long, url string, text string, n_chars long"
    )
