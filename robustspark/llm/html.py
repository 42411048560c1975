"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: the text between block-level tags, with the tags open there. Features are the ancestor
tags, words of their classes, ids and roles, whether the nearest named ancestor's name is usual for a text or for what surrounds
one, and the text's length, links, marks and place. The field is trained once per
process on labelled pages (``labelled_pages``), by gradient ascent on the exact log likelihood, and decodes a page by
Viterbi. Kept blocks are joined in page order by an empty line.

Null and empty pages, and pages cut off anywhere, give what there is; character references are decoded; white space in a
block is one space; script, style, title and the like are never text, and neither is a form, unless it holds a main or
article element or all text of the page; null and repeated ids are kept row by row; no rows give no rows; extra columns are ignored. Pages of any
size are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustspark.llm import labelled_pages

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style title noscript template iframe textarea svg select button object".split())
#: Start tags that end an open element of the same kind, up to the container named.
CLOSES = {
    "p": (("p",), ("div", "article", "section", "td", "th", "li", "blockquote", "body", "main", "aside", "form")), "li": (("li", "p"), ("ul", "ol", "menu")),
    "tr": (("tr", "td", "th", "p"), ("table",)), "td": (("td", "th", "p"), ("tr",)), "th": (("td", "th", "p"), ("tr",)),
    "dt": (("dt", "dd", "p"), ("dl",)), "dd": (("dt", "dd", "p"), ("dl",)), "option": (("option",), ("select",)),
}
ENDS_P = BLOCK - {"p", "li", "td", "th", "tr", "dd", "dt", "option", "tbody", "thead", "tfoot", "body", "html", "head", "legend", "caption", "summary", "figcaption"}
#: A quoted attribute value may hold any character.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*>?|[^<]+|<""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+|\d+")
#: Names that begin alike share a feature.
STEM = 5
#: Whole words in classes, ids and roles that are commonly given to what surrounds a text, and to texts.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising alert alerts announce announcement announcements banner banners bottom breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog "
    "discuss discussion disqus feedback foot footer gdpr hero legal login masthead menu menus menubar modal most nav navbar navi navigation newsletter notice notices notification pager pagination paginator popular popup popups privacy promo promos "
    "promotion read recommend recommended recommendation recommendations related replies reply respond responses search searchbar searchform share shares sharing sharebar sidebar sidebars signup site social sponsor sponsored sponsors subscribe "
    "subscription tags toolbar top topbar warning widget widgets".split()
)
TEXTUAL = frozenset("article articlebody articles blog body content entry main page post postbody posts story text textbody".split())
#: First words of names that say what a page or text is about or how it looks, not what a block is for.
ABOUT = frozenset("category cat tag topic has is no with without type format status layout template theme lang single".split())
#: Names on these elements are about the page.
WHOLE = frozenset({"html", "body"})
KINDS = frozenset({"near around", "near textual"})


@dataclass
class Leaf:
    """A leaf block: its text, its ancestors' features and how much of it is link text."""

    text: str
    path: frozenset[str]
    tag: str
    linked: int
    label: int


def leaves(page: str) -> list[Leaf]:
    """The leaf blocks of a page in order."""
    out: list[Leaf] = []
    in_form: list[Leaf] = []
    stack: list[tuple[str, frozenset[str], bool]] = []
    path, known = [frozenset()], {}
    buffer: list[str] = []
    linked, links, at, n = 0, 0, 0, len(page)
    label = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                tag = next((t for t, _, _ in reversed(stack) if t in BLOCK), "")
                inner = next((t for t, _, _ in reversed(stack) if t in ("form", "main", "article")), "")
                (in_form if inner == "form" else out).append(Leaf(text, path[-1], tag, linked, int(any(y for _, _, y in stack))))
        linked = 0

    def pop(to: int) -> None:
        nonlocal links
        for t, _, _ in stack[to:]:
            links -= t == "a"
        del stack[to:], path[to + 1 :]

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                buffer.append(m[0])
                linked += len(m[0]) if links else 0
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag in SKIP:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            if tag not in ("button", "select", "textarea"):
                continue
            flush()
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
            ends, stop = CLOSES.get(tag, (("p",), CLOSES["p"][1]) if tag in ENDS_P else ((), ()))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in ends:
                    pop(k)
        if tag in VOID:
            continue
        key = (tag, m[3])
        if key not in known:
            tokens = [WORD.findall(x) for v in NAMES.findall(m[3]) for x in v.lower().split()] if tag not in WHOLE else []
            names = {w for x in tokens if x and x[0] not in ABOUT for w in x}
            kind = {"near around"} if names & AROUND else {"near textual"} if names & TEXTUAL else set()
            known[key] = frozenset(kind | {f"in {tag}"} | {f"name {w}" for w in names} | {f"stem {w[:STEM]}" for w in names}), "data-y" in m[3]
        own, y = known[key]
        stack.append((tag, own, y))
        path.append((path[-1] - KINDS if own & KINDS else path[-1]) | own if tag in BLOCK or len(own) > 1 else path[-1])
        links += tag == "a"
    flush()
    return out or in_form  # a form around the whole page is no form of it


def observed(blocks: list[Leaf]) -> list[list[str]]:
    """The features of each block."""
    out = []
    for k, b in enumerate(blocks):
        size, share = len(b.text), b.linked / max(1, len(b.text))
        wide, links = f"size {min(6, size.bit_length() // 2)}", f"links {0 if share < 0.1 else 1 if share < 0.6 else 2}"
        near = next(iter(b.path & KINDS), "near none")
        f = [*b.path, f"tag {b.tag}", wide, links, f"ends {b.text[-1] if b.text[-1] in '.!?:;' else 'other'}", near, f"{near} {wide}", f"{near} {links}", "bias"]
        f += ["copyright"] if "\xa9" in b.text else []
        f += ["first"] if k == 0 else []
        f += ["last"] if k == len(blocks) - 1 else []
        out.append(f)
    return out


class Field:
    """A linear-chain field with two labels."""

    def __init__(self, pages: list[str], steps: int = 150, shrink: float = 0.01) -> None:
        # half of the pages go without the names themselves, so that what names have in common is learned too
        drop = lambda b, k: [f for f in b if k % 2 == 0 or not f.startswith(("name ", "stem "))]
        rows = [([drop(b, k) for b in observed(x)], np.array([b.label for b in x])) for k, x in enumerate(map(leaves, pages)) if x]
        self.index = {f: k for k, f in enumerate(sorted({f for x, _ in rows for b in x for f in b}))}
        size = np.array([len(y) for _, y in rows])
        x, y = self._matrix([b for blocks, _ in rows for b in blocks]), np.eye(2)[np.concatenate([y for _, y in rows])]
        inner = np.arange(size.max())[None] < size[:, None]
        self.weights, self.moves = np.zeros((len(self.index), 2)), np.zeros((2, 2))
        gold = np.zeros((*inner.shape, 2))
        gold[inner] = y
        m = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        v = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        for step in range(1, steps + 1):
            local = np.zeros((*inner.shape, 2))
            local[inner] = x @ self.weights
            one, two = self.expected(local, size)
            grads = [x.T @ (y - one[inner]) - shrink * self.weights, np.einsum("pki,pkj->ij", gold[:, :-1], gold[:, 1:]) - two.sum(0) - shrink * self.moves]
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                move = 0.05 * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                if k:
                    self.moves = self.moves + move
                else:
                    self.weights = self.weights + move
        self.by_name = {f: (float(self.weights[k, 0]), float(self.weights[k, 1])) for f, k in self.index.items()}

    def _matrix(self, blocks: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(blocks), len(self.index)))
        for k, b in enumerate(blocks):
            x[k, [self.index[f] for f in b if f in self.index]] = 1
        return x

    def expected(self, local: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per page (of ``size`` blocks with ``local`` scores) the expected labels and moves, by forward and backward sums."""
        pages, n, _ = local.shape
        ahead, back, two = np.zeros_like(local), np.zeros_like(local), np.zeros((pages, 2, 2))
        ahead[:, 0] = local[:, 0]
        for k in range(1, n):
            ahead[:, k] = local[:, k] + np.logaddexp(ahead[:, k - 1, :1] + self.moves[0], ahead[:, k - 1, 1:] + self.moves[1])
        for k in range(n - 2, -1, -1):
            after = local[:, k + 1] + back[:, k + 1]
            own = np.logaddexp(self.moves[:, 0] + after[:, :1], self.moves[:, 1] + after[:, 1:])
            back[:, k] = np.where((k + 1 < size)[:, None], own, 0.0)
        total = np.logaddexp(*ahead[np.arange(pages), size - 1].T)
        for k in range(n - 1):
            move = np.exp(ahead[:, k, :, None] + self.moves + (local[:, k + 1] + back[:, k + 1])[:, None] - total[:, None, None])
            two += np.where((k + 1 < size)[:, None, None], move, 0.0)
        return np.exp(ahead + back - total[:, None, None]), two

    def decode(self, blocks: list[Leaf]) -> list[int]:
        """The best labels by Viterbi."""
        known, (s00, s01), (s10, s11) = self.by_name, self.moves[0].tolist(), self.moves[1].tolist()
        a = b = 0.0
        back = []
        for f in observed(blocks):
            zero = one = 0.0
            for name in f:
                w = known.get(name)
                if w:
                    zero += w[0]
                    one += w[1]
            if not back:
                back.append((0, 0))
                a, b = zero, one
                continue
            back.append((int(b + s10 > a + s00), int(b + s11 > a + s01)))
            a, b = max(a + s00, b + s10) + zero, max(a + s01, b + s11) + one
        out, label = [], int(b > a)
        for step in reversed(back):
            out.append(label)
            label = step[label]
        return out[::-1]


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field of this process; training is deterministic."""
    return Field(labelled_pages.pages())


def main_text(page: str | None, field: Field) -> tuple[str, int, int]:
    """The main text of a page, its number of blocks, and how many of them are kept."""
    blocks = leaves(page or "")
    kept = [b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y] if blocks else []
    return "\n\n".join(kept), len(blocks), len(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars, n_blocks, n_kept."""
    shipped = pages.sparkSession.sparkContext.broadcast(trained())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                part = whole.slice(lo, 500)
                got = [main_text(x, shipped.value) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array([t for t, _, _ in got], pa.string()), pa.array([len(t) for t, _, _ in got], pa.int64()), pa.array([b for _, b, _ in got], pa.int64()), pa.array([k for _, _, k in got], pa.int64())], ["id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(read, "id long, url string, text string, n_chars long, n_blocks long, n_kept long").withColumnRenamed("id", id_col)
