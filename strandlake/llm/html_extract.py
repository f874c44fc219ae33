"""Main-text extraction by a maximum-scoring subsequence.

A page is read as a sequence of tokens. Words score positive and tags negative, each by the log odds, learnt from labelled pages, of
lying in the article: a word by the innermost named container around it, a tag by its name. One linear scan finds the contiguous
region of the largest score. Inside the region, containers whose names the labelled pages have mostly around other text (menus, notices,
adverts, forms, reader comments ...) stay out, with scripts and styles, and the rest is joined block by block.

Defined cases: null or empty html gives an empty text; a page without words, or whose best score isn't positive, gives an empty text; of
equal regions the first one counts; unclosed and stray tags, cut-off pages, unknown references and very long pages
are read to their end; white space is Python's (Unicode) white space; ``br`` is white space inside a block; other columns
are ignored; repeated rows are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_map
from strandlake.llm.labelled_pages import LABELLED

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "canvas"}
#: Elements that make a part of a page; what they hold is learnt, like that of the words of class, id and role.
SECTIONS = {"article", "main", "nav", "header", "footer", "aside", "form", "head", "button", "dialog", "menu", "label"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"p", "div", "article", "section", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "hr", "details", "summary", "fieldset", "body", "html", "center", "nav", "header", "footer", "aside", "form", "head", "title", "dialog", "menu", "hgroup", "option"}
CLOSES_P = BLOCKS - {"body", "html", "head"}


@dataclass
class Token:
    """A tag (``words`` 0) or a run of text.

    ``where``: ``main`` in a container named as the article, ``inner`` in a part of it that is no article text, ``boiler`` in such a part
    elsewhere, and else ``beside`` on a page with a ``main`` and ``bare`` on one without (with ``/a`` in a link). ``out``: never article text."""

    kind: str
    words: int
    text: str
    where: str
    out: bool
    block: int


def names_of(tag: str, attributes: str) -> set[str]:
    """What a container is called: its element, if that makes a part of a page, and the words of class, id and role."""
    if tag in ("html", "body"):
        return set()
    words = {w.lower() for m in NAMED.finditer(attributes) for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", m[1] or m[2] or m[3] or "")}
    return words | ({tag} & SECTIONS)


def _kind(tag: str, attributes: str, parts: dict[str, str]) -> str:
    """``boiler`` (``form`` for a form), ``main`` or empty, by what is learnt of a container's names: one that stands for no article text decides."""
    if tag in RAW or (tag not in ("html", "body") and HIDDEN.search(attributes)):
        return "boiler"
    known = {parts.get(x) for x in names_of(tag, attributes)}
    return ("form" if tag == "form" else "boiler") if "boiler" in known else "main" if "main" in known else ""


def tokens(page: str, parts: dict[str, str], around: list[set[str]] | None = None) -> list[Token]:
    """The page as tags and text runs, in page order. ``parts``: boiler or main by container name. ``around``: takes for each
    token the names of its innermost container that has any."""
    out: list[Token] = []
    stack: list[tuple[str, str]] = []
    called: list[set[str]] = []  # as long as ``stack``

    def put(token: Token) -> None:
        out.append(token)
        if around is not None:
            around.append(next((x for x in reversed(called) if x), set()))

    block, at, end = 0, 0, len(page)

    def where() -> str:
        kinds = [k for _, k in stack if k]
        if "main" in kinds and "form" in kinds[: kinds.index("main")]:  # a form around the whole page says nothing
            kinds = [k for k in kinds if k != "form"]
        bad = next((i for i, k in enumerate(kinds) if k != "main"), len(kinds))
        if bad < len(kinds):
            return "inner" if bad else "boiler"
        return "main" if kinds else "none/a" if any(t == "a" for t, _ in stack) else "none"

    def text(a: int, b: int) -> None:
        if b > a:
            run = page[a:b]
            inside = where()
            put(Token("text", len(run.split()), run, inside, inside in ("inner", "boiler"), block))

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue  # a comment, doctype or instruction: no token of its own
        inside = where()
        if m[1]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                del called[len(stack) :]
        elif tag not in VOID:
            if tag in CLOSES_P:  # an unclosed paragraph ends where a block begins
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in CLOSES_P), -1)
                if k >= 0 and stack[k][0] == "p":
                    del stack[k:], called[k:]
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                stack.pop()
                called.pop()
            kind = _kind(tag, m[3] or "", parts)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)|\Z", re.I).search(page, at)
                at = close.end()
            elif not (m[3] or "").rstrip().endswith("/") or tag in BLOCKS:
                stack.append((tag, kind))
                called.append(names_of(tag, m[3] or ""))
                inside = where()
        if tag in BLOCKS:
            block += 1
        put(Token(tag, 0, " " if tag == "br" else "", inside, inside in ("inner", "boiler"), block))
    plain = "beside" if any(t.where == "main" for t in out) else "bare"
    for t in out:
        t.where = t.where.replace("none", plain)
    return out


@dataclass
class Weights:
    word: dict[str, float]
    tag: dict[str, float]
    parts: dict[str, str]
    other_word: float = -1.0
    other_tag: float = -1.0


def _blocks(seen: list[Token], main: str) -> set[int]:
    """The blocks of a labelled page that are lines of its main text."""
    lines = {" ".join(x.split()) for x in main.split("\n")} - {""}
    rows: dict[int, list[str]] = {}
    for t in seen:
        rows.setdefault(t.block, []).append(t.text)
    return {b for b, texts in rows.items() if " ".join(html.unescape("".join(texts)).split()) in lines}


def learn_parts(pages: list[tuple[str, str]], smooth: float = 0.5, clear: float = 0.5) -> dict[str, str]:
    """Container names with clear log odds: ``main`` where their words are mostly article text, ``boiler`` where they mostly aren't."""
    inside, outside = Counter(), Counter()
    for page, main in pages:
        around: list[set[str]] = []
        seen = tokens(page, {}, around)
        good = _blocks(seen, main)
        for t, names in zip(seen, around, strict=True):
            if t.words:
                (inside if t.block in good else outside).update(dict.fromkeys(names, t.words))
    odds = {x: math.log((inside[x] + smooth) / (outside[x] + smooth)) for x in inside | outside}
    return {x: "main" if o > 0 else "boiler" for x, o in odds.items() if abs(o) >= clear}


def learn(pages: list[tuple[str, str]], smooth: float = 0.5) -> Weights:
    """Weights from labelled pages (html, main text): what container names stand for, then log odds of a word's container, and of a tag's
    name less one.

    A tag never adds to a region: its weight is capped at a small negative value."""
    parts = learn_parts(pages, smooth)
    inside: dict[str, Counter] = {"word": Counter(), "tag": Counter()}
    outside: dict[str, Counter] = {"word": Counter(), "tag": Counter()}
    for page, main in pages:
        seen = tokens(page, parts)
        good = _blocks(seen, main)
        first = next((i for i, t in enumerate(seen) if t.block in good), 0)
        last = max((i for i, t in enumerate(seen) if t.block in good), default=-1)
        for i, t in enumerate(seen):
            if t.kind == "text" and not t.words:
                continue
            to = inside if first <= i <= last else outside
            to["word" if t.words else "tag"][t.where if t.words else t.kind] += t.words or 1
    score = lambda kind, x: math.log((inside[kind][x] + smooth) / (outside[kind][x] + smooth))
    words = {x: score("word", x) for x in inside["word"] | outside["word"]}
    tags = {x: min(score("tag", x) - 1, -0.1) for x in inside["tag"] | outside["tag"]}
    return Weights(words, tags, parts)


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous run with the largest positive sum, the first of equals; (0, 0) if there is none."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def extract(page: str | None, weights: Weights) -> str:
    """The main text of a page: blocks of the best region in page order, joined by one line feed."""
    if not page:
        return ""
    seen = tokens(page, weights.parts)
    first, last = best_region([t.words * weights.word.get(t.where, weights.other_word) if t.kind == "text" else weights.tag.get(t.kind, weights.other_tag) for t in seen])
    rows: dict[int, list[str]] = {}
    for t in seen[first:last]:
        if t.text and not t.out:
            rows.setdefault(t.block, []).append(t.text)
    blocks = (" ".join(html.unescape("".join(x)).split()) for x in rows.values())
    return "\n".join(b for b in blocks if b)


def main_text(pages: DataFrame, labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """The result of the query: page_id, url, text, n_chars."""
    weights = learn(LABELLED if labelled is None else labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long")
