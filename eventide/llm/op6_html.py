"""Main text of HTML pages: flat text blocks and a decision tree over shallow features.

A page becomes a flat list of text blocks, cut at block-level tags. A block knows
its number of words, the share of them inside links, the same two of its
neighbours, and where it stands: inside an article, inside a boilerplate container
(by tag, role, class or id), in a heading, in a run of short linked blocks or of unlinked ones. A small classification tree, grown on the labelled
table below, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from eventide.llm.common import pick, read

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)""", re.S)
_RAW = frozenset("script style noscript template title textarea select iframe object svg video audio canvas".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
_CONTAINER = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul "
    "li td span".split())
_BOILER_TAG = frozenset("nav footer aside form menu dialog fieldset".split())
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id values that mark what is not the article.
_BOILER_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disclaimer disqus footer footers gdpr header headers login masthead menu "
    "menus modal nav navbar navigation newsletter notice notices notification pagination pager paywall popup privacy promo "
    "promotion promoted recommended related replies reply respond search share sharing sidebar sidebars signin signup skip "
    "social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets".split())
#: Of these, words that an article may be about: there they mark a block only if it is short or linked.
_TOPIC = frozenset("copyright disclaimer header headers privacy search skip tags".split())
DENSE_WORDS, DENSE_LINKED = 16, 0.2
#: Scripts written without spaces: two characters count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Words after which a name says what a page has or lacks, not what the element is.
_OF_PAGE = frozenset("no not has with without".split())
#: A menu's entry: at most so many words, this share of them linked.
SHORT_WORDS, MOSTLY = 8, 0.5
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("br hr img input meta link wbr area base col embed source track".split())

#: The labelled table. Columns: words and link share of the block, of the block before
#: and of the one after; inside an article; inside a boilerplate container; a heading;
#: blocks in the run of short linked ones around it; main text; words of the run of unlinked
#: blocks around it, if that is more than the block and its neighbours.
LABELLED = (
    # articles: long, short and one-word paragraphs, headings, lists, quotes, inline links
    (80, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0, 0, 1), (120, 0.05, 8, 0.0, 90, 0.0, 1, 0, 0, 0, 1),
    (1, 0.0, 50, 0.0, 60, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 3, 0.0, 0, 0.0, 1, 0, 0, 0, 1),
    (4, 0.0, 90, 0.0, 9, 0.0, 1, 0, 0, 0, 1), (6, 0.0, 1, 1.0, 60, 0.0, 1, 0, 1, 0, 1),
    (9, 0.0, 12, 0.0, 1, 0.0, 1, 0, 1, 0, 1), (3, 0.0, 40, 0.0, 30, 0.0, 1, 0, 1, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 1), (30, 0.3, 40, 0.0, 40, 0.1, 1, 0, 0, 0, 1),
    (12, 0.4, 30, 0.0, 25, 0.0, 1, 0, 0, 0, 1), (200, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 1),
    (7, 0.0, 7, 0.0, 7, 0.0, 1, 0, 0, 0, 1), (5, 0.0, 6, 1.0, 4, 1.0, 1, 0, 0, 0, 1),
    # linked paragraphs, list items and headings of articles
    (9, 0.9, 30, 0.0, 30, 0.0, 1, 0, 0, 0, 1), (3, 1.0, 40, 0.0, 50, 0.0, 1, 0, 0, 1, 1), (14, 1.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0, 1),
    (12, 1.0, 11, 1.0, 13, 1.0, 1, 0, 0, 0, 1), (5, 1.0, 4, 1.0, 60, 0.0, 1, 0, 0, 2, 1), (2, 1.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1, 1),
    (5, 1.0, 30, 0.0, 40, 0.0, 1, 0, 1, 0, 1), (4, 1.0, 2, 1.0, 50, 0.0, 1, 0, 1, 0, 1), (3, 1.0, 40, 0.0, 6, 1.0, 1, 0, 1, 0, 1),
    # link lists within articles
    (4, 1.0, 60, 0.0, 5, 1.0, 1, 0, 0, 3, 0), (6, 1.0, 5, 1.0, 3, 1.0, 1, 0, 0, 5, 0),
    (2, 1.0, 2, 1.0, 40, 0.0, 1, 0, 0, 3, 0),
    # boilerplate containers, in and out of articles: adverts, notices, sidebars, comments, footers
    (60, 0.0, 70, 0.0, 80, 0.0, 1, 1, 0, 0, 0), (12, 0.0, 4, 1.0, 9, 0.0, 0, 1, 0, 0, 0),
    (45, 0.0, 3, 0.0, 6, 1.0, 0, 1, 0, 0, 0), (150, 0.0, 40, 0.0, 60, 0.0, 0, 1, 0, 0, 0),
    (3, 0.0, 50, 0.0, 30, 0.0, 1, 1, 1, 0, 0), (6, 0.0, 2, 1.0, 80, 0.0, 0, 1, 1, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 3, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 5, 0),
    (10, 0.1, 70, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (25, 0.5, 10, 0.0, 10, 0.9, 0, 1, 0, 0, 0),
    # pages without an article element: dense paragraphs and what stands between them
    (70, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (45, 0.1, 5, 0.0, 80, 0.0, 0, 0, 0, 0, 1),
    (30, 0.0, 1, 1.0, 45, 0.0, 0, 0, 0, 0, 1), (25, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (18, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 0, 1), (16, 0.0, 20, 0.0, 30, 0.0, 0, 0, 0, 0, 1),
    (5, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 45, 0.0, 50, 0.0, 0, 0, 0, 0, 1),
    (7, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 0, 1), (5, 0.0, 40, 0.0, 45, 0.0, 0, 0, 1, 0, 1),
    (6, 0.0, 2, 1.0, 30, 0.0, 0, 0, 1, 0, 1), (40, 0.0, 6, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (22, 0.0, 22, 0.0, 1, 1.0, 0, 0, 0, 0, 1), (22, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (17, 0.1, 22, 0.0, 17, 0.0, 0, 0, 0, 0, 1),
    (20, 0.0, 9, 0.0, 4, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 1),
    (5, 0.0, 22, 0.0, 22, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 25, 0.0, 1, 1.0, 0, 0, 0, 0, 1),
    # their short last paragraphs and linked headings
    (4, 0.0, 50, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (8, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 45, 0.0, 1, 1.0, 0, 0, 0, 0, 1),
    (6, 1.0, 2, 1.0, 60, 0.0, 0, 0, 1, 0, 1), (4, 1.0, 6, 0.0, 40, 0.0, 0, 0, 1, 0, 1), (5, 1.0, 50, 0.0, 70, 0.0, 0, 0, 1, 0, 1),
    # and the short or linked blocks around them
    (1, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0, 3, 0), (2, 1.0, 0, 0.0, 80, 0.0, 0, 0, 0, 1, 0), (9, 0.8, 40, 0.0, 50, 0.0, 0, 0, 0, 0, 0),
    (6, 1.0, 2, 1.0, 45, 0.0, 0, 0, 0, 3, 0), (4, 0.0, 9, 0.0, 3, 0.0, 0, 0, 0, 0, 0), (6, 0.0, 10, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (8, 0.0, 4, 0.0, 5, 0.0, 0, 0, 0, 0, 0), (9, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (12, 0.0, 6, 1.0, 4, 0.0, 0, 0, 0, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 3, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 5, 0),
    (3, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (5, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0, 0, 0),
    (3, 1.0, 6, 1.0, 4, 1.0, 0, 0, 1, 0, 0), (5, 1.0, 3, 1.0, 9, 0.0, 0, 0, 1, 0, 0),
    (6, 0.0, 4, 0.0, 5, 0.0, 0, 0, 0, 0, 0), (9, 0.8, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 0),
    (30, 0.9, 3, 1.0, 12, 1.0, 0, 0, 0, 0, 0), (20, 0.7, 40, 0.0, 6, 1.0, 0, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 5, 1.0, 0, 0, 1, 0, 0), (3, 0.0, 6, 1.0, 2, 1.0, 0, 0, 1, 0, 0),
    # short blocks in a run with dense ones: dialogue, lists, tables, lines of verse
    (4, 0.0, 5, 0.0, 3, 0.0, 0, 0, 0, 0, 1, 90), (2, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 0, 1, 45), (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 0, 1, 60),
    (5, 0.0, 6, 0.0, 0, 0.0, 0, 0, 0, 0, 1, 70), (3, 0.0, 0, 0.0, 4, 0.0, 0, 0, 0, 0, 1, 40), (6, 0.0, 7, 0.0, 2, 1.0, 0, 0, 0, 0, 1, 33),
    (2, 0.0, 4, 0.0, 3, 0.0, 0, 0, 1, 0, 1, 50), (4, 0.0, 2, 1.0, 6, 0.0, 0, 0, 1, 0, 1, 30),
    # and in runs of short ones alone
    (2, 0.0, 1, 0.0, 3, 0.0, 0, 0, 0, 0, 0, 9), (3, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 0, 0, 14), (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 0, 0, 6),
)


def table() -> np.ndarray:
    """The labelled rows with all columns, the label last."""
    rows = []
    for *row, in LABELLED:
        features, label, rest = row[:10], row[10], row[11:]
        run = sum(w for w, linked in zip(row[0:6:2], row[1:6:2]) if linked < MOSTLY) if row[1] < MOSTLY and not row[6] and not row[7] else 0
        rows.append([*features, *(rest or [run]), label])
    return np.array(rows, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | int:
    """A classification tree: (feature, cut, tree up to the cut, tree above it), or the class."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return int(2 * y.sum() >= len(y))
    best = None
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for cut in ((values[:-1] + values[1:]) / 2).tolist():
            low = x[:, feature] <= cut
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, feature, cut, low
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, feature, cut, low = best
    return feature, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@lru_cache(maxsize=1)
def tree() -> tuple | int:
    """The tree of the labelled table: what a block is comes before how it looks, so the sides of
    boilerplate, article, headings and the rest are grown each on its own rows. A feature that splits
    equally well stands before later ones."""
    rows = table()
    order = [10, 9, 1, 8, 0, 2, 3, 5, 4]

    def named(node: tuple | int) -> tuple | int:
        return node if isinstance(node, int) else (order[node[0]], node[1], named(node[2]), named(node[3]))

    def side(which: np.ndarray) -> tuple | int:
        return named(grow(rows[which][:, order], rows[which][:, -1]))

    boiler, article, heading = rows[:, 7] == 1, rows[:, 6] == 1, rows[:, 8] == 1
    other = ~boiler & ~article
    plain = 8, 0.5, side(other & ~heading), side(other & heading)
    return 7, 0.5, (6, 0.5, plain, side(~boiler & article)), side(boiler)


@dataclass
class Block:
    text: str
    words: int
    linked: float
    article: bool
    boiler: bool
    heading: bool


def _marks(value: str) -> set[str]:
    """Words of a class or id value that mark boilerplate; ``no-sidebar`` or ``page-with-comments`` mark nothing."""
    found = set()
    for one in value.split():
        words = [w.lower() for w in _NAME.findall(one)]
        found.update(words[:next((i for i, w in enumerate(words) if w in _OF_PAGE), len(words))])
    return found & _BOILER_NAME


def count_words(text: str) -> int:
    """Words between spaces, and one for two characters of a script without spaces."""
    words = len(text.split())
    return words if text.isascii() else max(words, words + len(_UNSPACED.findall(text)) // 2 - 1) if words else 0


NOT, TOPIC, BOILER = 0, 1, 2


def _boilerplate(name: str, attributes: str, article: bool, named: bool = True) -> int:
    """Whether an element is boilerplate: not, if its text is not dense (``TOPIC``), or at any rate.
    ``named``: class and id say what the element is; those of a body, main or article speak of the whole page."""
    if name in _BOILER_TAG or name == "header" and not article:
        return BOILER
    if not attributes or attributes.isspace():
        return NOT
    mark = NOT
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id") and named:
            marks = _marks(value)
            if marks - _TOPIC or marks and not article:
                return BOILER
            if marks - {"header", "headers"}:  # an article may have a header of its own
                mark = TOPIC
        if key == "role" and value.lower() in _BOILER_ROLE or key == "hidden":
            return BOILER
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return BOILER
    return mark


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order; character references are decoded, white space is folded."""
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open containers: tag, inside an article, mark
    parts: list[str] = []
    linked = pressed = link = button = at = 0
    article = heading = False
    boiler = own = NOT  # marks of the containers and of the block itself

    def close() -> None:
        nonlocal linked, pressed
        text = " ".join("".join(parts).split())
        if text:
            words, mark = count_words(text), max(boiler, own)
            share = min(1.0, linked / words)
            dense = words >= DENSE_WORDS and share < DENSE_LINKED
            # what is nothing but buttons is a control, within a sentence a button is a word
            found.append(Block(text, words, share, article, mark == BOILER or mark == TOPIC and not dense or pressed >= words, heading))
        parts.clear()
        linked = pressed = 0

    def say(text: str) -> None:
        nonlocal linked, pressed
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += count_words(text) if link else 0
            pressed += count_words(text) if button else 0

    end = len(page)
    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            say(page[at:])
            break
        say(page[at:tag.start()])
        at, name = tag.end(), tag.group(2)
        if name is None:
            continue
        name, closing, attributes = name.lower(), tag.group(1), tag.group(3)
        if name in _RAW:
            if not closing and not attributes.endswith("/"):
                over = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = over.end() if over else end
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name == "button":
            button = 0 if closing else 1
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name in _BLOCK:
            close()
            link = button = 0
            own = NOT if closing or name in _CONTAINER else _boilerplate(name, attributes, article)
            heading = not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if name in _CONTAINER:
            if closing:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        if name == "span" and stack[depth][2] != (depth > 0 and stack[depth - 1][2]):
                            close()
                        del stack[depth:]
                        break
            elif name not in _VOID and not attributes.endswith("/"):
                inside = article or name in ("article", "main")
                # an article within an article, as comments are, is not the page's
                named = name not in ("body", "main", "article") or name == "article" and any(x[0] == name for x in stack)
                marked = _boilerplate(name, attributes, inside, named)
                if name == "span" and marked and not boiler:
                    close()
                stack.append((name, inside, max(boiler, marked)))
            _, article, boiler = stack[-1] if stack else ("", False, NOT)
    close()
    return found


def runs(found: list[Block]) -> list[int]:
    """Of every block, how many short linked ones stand in a row with it in the same surroundings; 0 if it is no such block."""
    out = [0] * len(found)
    first = None
    for i in range(len(found) + 1):
        b = found[i] if i < len(found) else None
        like = b is not None and b.words <= SHORT_WORDS and b.linked >= MOSTLY and not b.heading
        if first is not None and not (like and (b.article, b.boiler) == (found[first].article, found[first].boiler)):
            out[first:i] = [i - first] * (i - first)
            first = None
        if like and first is None:
            first = i
    return out


def text_runs(found: list[Block]) -> list[int]:
    """Of every unlinked block outside articles and boilerplate, the words of the row of such blocks that it stands in; else 0."""
    out, first, words = [0] * len(found), 0, 0
    for i in range(len(found) + 1):
        b = found[i] if i < len(found) else None
        if b is not None and b.linked < MOSTLY and not b.article and not b.boiler:
            words += b.words
            continue
        out[first:i] = [words] * (i - first)
        first, words = i + 1, 0
    return out[:len(found)]


def main_text(page: str | None) -> str:
    """Main text of a whole page: its blocks in page order, joined by an empty line. A page where nothing is
    dense enough gives all that is neither linked nor marked as boilerplate."""
    found = blocks(page)
    size = [(b.words, b.linked) for b in found]
    run, texts = runs(found), text_runs(found)
    kept = []
    for i, b in enumerate(found):
        before = size[i - 1] if i else (0, 0.0)
        after = size[i + 1] if i + 1 < len(size) else (0, 0.0)
        row = (b.words, b.linked, *before, *after, b.article, b.boiler, b.heading, run[i], texts[i])
        node = tree()
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node:
            kept.append(b.text)
    return "\n\n".join(kept or [b.text for i, b in enumerate(found) if texts[i]])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``page_id``, ``url``, ``text`` (empty if none), ``n_chars``.

    One row per input row; null, empty and broken pages give what text they have,
    null ids and urls and repeated rows stay, other columns are not read. Nothing
    is capped. Rows are independent: no shuffle.
    """
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [main_text(page) for page in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint"
    return pick(pages, page_id=id_col, url=url_col, html=html_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
