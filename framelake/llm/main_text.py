"""Main text of web pages: flat blocks, classified by a decision tree.

A page is read once from front to back into flat text blocks, which end at block-level tags. A block knows its number of
words, the share of them inside links, the same of the blocks before and after it, whether it is a heading, and what the
elements around it say of themselves by their tags, roles, classes and ids: that they hold what is no article (menu, footer,
advert, form, comments and the like) or that they hold the article, in three degrees of certainty (an article element, a main
element or a class such as "post", a class such as "content"), compared with the highest degree on the page.

A binary decision tree takes these features (Gini splits, grown until its leaves are pure or DEPTH deep). It is fitted on
the driver to a labelled table: at most LABELLED pages whose elements of the article carry the attribute data-main, by
default the written pages of page_labels. Every page is then judged whole, in one pass without a shuffle.

Character references are decoded, white space inside a block becomes one space, line breaks too; blocks are joined by two
newlines in page order. Scripts, styles, comments, titles and what only programs or forms show (option, button, textarea,
template, noscript, svg, canvas...) are no text. Unclosed tags, comments and scripts end where the HTML rules say, at the
latest with the page.

Null or empty html: an empty text. Null ids and urls pass through; repeated rows each give a row; an empty table gives an
empty result. A page of any length is read in time linear in it. Other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .page_labels import LABELLED_PAGES

LABELLED, DEPTH = 2_000, 10

_MARKUP = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
_REST = re.compile(r"""(?:[\s/]++|[^\s/>="'][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|[="'])*+>""")
_SAID = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden|itemprop|data-main)(?=[\s=/>]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSED = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes")}

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre"
    " section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_UNSEEN = frozenset("select button template svg canvas object audio video map datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}

_OTHER_TAGS = frozenset("nav footer aside dialog menu fieldset".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_OTHER_WORDS = frozenset(
    "nav navbar navigation topnav sidenav subnav mainnav menu submenu mainmenu topbar breadcrumb breadcrumbs masthead banner footer foot sidebar aside widget widgets ad ads adv advert adverts advertisement advertising"
    " adsense adbox adslot adunit sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay newsletter subscribe subscription"
    " signup signin login register form search searchbox share sharing social related recommended recommendations trending popular comment comments commentlist respond reply replies disqus discussion copyright legal"
    " pagination pager paging toolbar skip tagcloud outbrain taboola werbung anzeige kommentar kommentare publicidad comentarios publicite commentaires".split()
)
_SURE_WORDS = frozenset("article post entry story articlebody articlecontent postcontent postbody entrycontent storybody".split())
_LIKELY_WORDS = frozenset("content main maincontent".split())
_AROUND = frozenset("body text page site inner wrap wrapper container single full blog news the area primary section detail details view node field column col copy hentry".split())
_ABOUT_PAGE = frozenset("has with without no is not js category tag format type status author".split())


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    heading: bool
    other: bool  # inside something that is no article
    degree: int  # 0 to 3: how surely it stands inside the article
    marked: bool


def _names(value: str) -> Iterator[list[str]]:
    for name in value.split():
        words = [w.lower() for w in _PARTS.findall(name)]
        if words and words[0] not in _ABOUT_PAGE:
            yield words


def _element(tag: str, said: dict[str, str], other: int, degree: int) -> tuple[int, int]:
    """What an element inside (other, degree) makes of them. other: 1 for good, 2 in a form, which an article may lie in."""
    role = said.get("role", "").strip().lower()
    own, sure = 0, 0
    if tag == "article" or role == "article" or "articlebody" in said.get("itemprop", "").lower():
        sure = 3
    elif tag == "main" or role == "main":
        sure = 2
    if tag in _OTHER_TAGS or role in _OTHER_ROLES or (tag == "header" and not degree):
        own = 1
    elif tag == "form":
        own = 2
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said.get("style", ""), re.IGNORECASE):
        own = 1
    if tag not in ("html", "body", "main"):
        for words in (*_names(said.get("class", "")), *_names(said.get("id", ""))):
            if not _OTHER_WORDS.isdisjoint(words) or ("header" in words and not degree):
                own = 2 if tag == "form" else 1
            elif tag in ("div", "section", "td") and not sure and all(w in _SURE_WORDS or w in _LIKELY_WORDS or w in _AROUND for w in words):
                sure = 2 if not _SURE_WORDS.isdisjoint(words) else 1 if not _LIKELY_WORDS.isdisjoint(words) else 0
    if (other == 2 and sure >= 2) or tag == "main":
        other = 0
    return (1 if 1 in (own, other) else own or other), max(degree, sure)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in its order."""
    found: list[Block] = []
    pieces: list[str] = []
    words = linked = 0
    # What holds at this place, and the same for every open block element below it.
    tag, other, degree, link, unseen, marked = "", 0, 0, False, 0, False
    stack: list[tuple] = []
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal pieces, words, linked
        if words:
            heading = tag in _HEADINGS or any(s[0] in _HEADINGS for s in stack[-3:])
            found.append(Block(" ".join("".join(pieces).split()), words, linked, heading, other > 0, degree, marked))
        pieces, words, linked = [], 0, 0

    def close() -> None:
        nonlocal tag, other, degree, link, unseen, marked
        opened[tag] -= 1
        tag, other, degree, link, unseen, marked = stack.pop()

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        until = m.start() if m else end
        if until > at and not unseen:
            piece = references.unescape(page[at:until])
            n = len(piece.split())
            pieces.append(piece)
            words += n
            linked += n if link else 0
        if not m:
            break
        name = m[2]
        if name is None:
            if m[0] == "<!--":
                closed = m.end() if page.startswith((">", "->"), m.end()) else page.find("-->", m.end())
                at = page.find(">", closed) + 1 if closed >= 0 else end
            else:
                at = page.find(">", m.end()) + 1 or end
            continue
        rest = _REST.match(page, m.end())
        if not rest:
            break  # the page ends inside a tag
        at = rest.end()
        name = name.lower()
        if m[1]:
            if name in _BLOCKS:
                flush()
                if opened[name]:
                    while tag != name:
                        close()
                    close()
            elif name == "a":
                link = False
            elif name in _UNSEEN:
                unseen = max(0, unseen - 1)
            elif name == "br":
                pieces.append(" ")
            continue
        if name in _CLOSED:
            last = _CLOSED[name].search(page, at)
            at = last.start() if last else end
        elif name in _BLOCKS:
            flush()
            if tag == "p":
                close()
            like = _ENDS_LIKE.get(name)
            while like and tag in like:
                close()
            stack.append((tag, other, degree, link, unseen, marked))
            opened[name] += 1
            tag = name
            attributes = rest[0]
            said = {s[1].lower(): s[2] or s[3] or s[4] or "" for s in _SAID.finditer(attributes)} if len(attributes) > 2 else {}
            other, degree = _element(name, said, other, degree)
            marked = marked or "data-main" in said
        elif name == "a":
            link = True
        elif name == "hr":
            flush()
        elif name in _UNSEEN:
            unseen += not rest[0].endswith("/>")
        elif name in _VOID:
            pieces.append(" " if name == "br" else "")
    flush()
    return found


FEATURES = ("other", "surest", "any_degree", "heading", "words", "link_share", "words_before", "share_before", "words_after", "share_after")


def features(page: list[Block]) -> np.ndarray:
    """One row for each block, by the names of FEATURES."""
    out = np.zeros((len(page), len(FEATURES)))
    if page:
        top = max((b.degree for b in page if not b.other), default=0)
        words = np.array([b.words for b in page], np.float64)
        share = np.array([b.linked for b in page]) / words
        out[:, 0] = [b.other for b in page]
        out[:, 1] = [b.degree == top > 0 for b in page]
        out[:, 2] = top > 0
        out[:, 3] = [b.heading for b in page]
        out[:, 4], out[:, 5] = words, share
        out[1:, 6], out[1:, 7] = words[:-1], share[:-1]
        out[:-1, 8], out[:-1, 9] = words[1:], share[1:]
    return out


class Tree(NamedTuple):
    """Nodes as arrays: a node sends a row left if its feature is at most the cut; leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    main: np.ndarray

    def judge(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[node]
            if not (f >= 0).any():
                return self.main[node]
            down = np.where(x[rows, f] <= self.cut[node], self.left[node], self.right[node])
            node = np.where(f >= 0, down, node)


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> Tree:
    """A binary tree by Gini impurity; of equal splits the first feature and the lowest cut win."""
    nodes: list[list] = []

    def impurity(good: np.ndarray, n: np.ndarray) -> np.ndarray:
        return good * (n - good) / np.maximum(n, 1)

    def grow(rows: np.ndarray, level: int) -> int:
        me, labels = len(nodes), y[rows]
        nodes.append([-1, 0.0, -1, -1, 2 * labels.sum() > len(labels)])
        best = (float(impurity(labels.sum(), len(labels))) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]) if level < depth else ():
            order = np.argsort(x[rows, f], kind="stable")
            v, good = x[rows[order], f], np.cumsum(labels[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if len(at):
                n = at + 1
                cost = impurity(good[at], n) + impurity(good[-1] - good[at], len(v) - n)
                i = int(np.argmin(cost))
                if cost[i] < best[0]:
                    best = (float(cost[i]), f, float(v[at[i]] + v[at[i] + 1]) / 2)
        if best[1] >= 0:
            goes = x[rows, best[1]] <= best[2]
            nodes[me][:4] = best[1], best[2], grow(rows[goes], level + 1), grow(rows[~goes], level + 1)
        return me

    grow(np.arange(len(y)), 0)
    return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


def labelled_tree(pages: list[str], depth: int = DEPTH) -> Tree:
    """The tree of pages whose article is marked."""
    found = [blocks(p) for p in pages]
    return fit_tree(np.concatenate([features(b) for b in found]), np.array([x.marked for b in found for x in b], np.int64), depth)


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, tree.judge(features(found)), strict=True) if keep) if found else ""


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _texts(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            texts = [main_text(p, tree) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_TEXTS)


def extract(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page. labelled: pages with marked articles, of which LABELLED are taken at
    most, those with the least digests; the written ones if there are none."""
    marked = LABELLED_PAGES
    if labelled is not None:
        page = F.col(f"`{labelled_col}`").cast("string").alias("page")
        marked = [r.page for r in labelled.select(page).where("page is not null").orderBy(F.sha2("page", 256)).limit(LABELLED).collect()] or marked
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(partial(_texts, tree=labelled_tree(marked)), "page_id long, url string, text string, n_chars long")


def op12_main_text(pages: DataFrame) -> DataFrame:
    return extract(pages)
