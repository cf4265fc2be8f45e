"""HTML main-text extraction by tag-path ratios.

Text blocks are grouped by their root-to-leaf path of block tags. Per path the text length and the
punctuation of a block, less what stands in links, make two ratios; both are smoothed over the order
in which paths first appear, fused, and compared with a threshold taken from their spread. All steps
take time in proportion to the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismata.llm.scratch import small_batches

# A quoted value runs over > but not over what looks like the next tag; a tag whose quote is never closed ends at its first >.
_QUOTED = r"\"(?:[^\"<]|<(?![a-zA-Z/!]))*\"|'(?:[^'<]|<(?![a-zA-Z/!]))*'"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|{_QUOTED}|<(?![a-zA-Z/!]))*(?:>|\Z)|[^>]*(?:>|\Z))", re.S)
_CLASS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?¡¿…、。，！？]")
_WORD = re.compile(r"[a-z]+")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas video audio xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
# Elements and words of class, id or role that mark what isn't the article.
ASIDE_TAGS = frozenset("nav footer aside form button select option datalist fieldset dialog menu head noscript".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navigation navbar menu breadcrumb breadcrumbs footer foot sidebar aside widget cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies disqus discussion social share sharing related recommended recommendations masthead topbar toolbar pagination pager search skip copyright legal disclaimer contentinfo complementary".split())
# Words that say what a page has or lacks, where they begin a name; elements whose names say something of the page or of a part of the article.
STATE_WORDS = frozenset("no has have with without is not hide hides show shows".split())
ROOTS = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
# Words that mark only where they are a whole name: search-result-item or legal-news may well be the article.
WHOLE_WORDS = frozenset("search social header legal notice alert discussion promo promotion related recommended login popup widget copyright disclaimer notification reply response".split())
CLOSES = {  # an opening tag ends these open ones
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre td dd dt th figcaption".split())
SCOPE = frozenset("ul ol dl table div section article body html blockquote".split())


def _marked(tag: str, names: list[tuple[str, str]]) -> bool:
    """Whether an element's class, id or role marks it as no part of the article.

    Names of roots and headings don't, nor do a section's ids, which title it, nor names like no-sidebar and has-comments.
    """
    if tag in ROOTS:
        return False
    for kind, value in names:
        if kind == "id" and tag == "section":
            continue
        for name in value.split():
            parts = _WORD.findall(name)
            if parts and parts[0] not in STATE_WORDS and any(w in ASIDE_WORDS and (len(parts) == 1 or w not in WHOLE_WORDS) for w in parts):
                return True
    return False


class Block(NamedTuple):
    path: int  # a number for the root-to-leaf path
    text: str
    linked: int  # characters inside links
    aside: bool
    article: bool  # inside an article or main element
    soft: bool = False  # aside by a word of class, id or role only


class Paths:
    """Paths of block tags by number; a path's parent has a smaller number than the path."""

    def __init__(self):
        self.parent, self.tag = [-1], [""]
        self.number: dict[tuple[int, str], int] = {}

    def below(self, parent: int, tag: str, label: str) -> int:
        k = self.number.setdefault((parent, label), len(self.tag))
        if k == len(self.tag):
            self.parent.append(parent)
            self.tag.append(tag)
        return k


def blocks(page: str) -> tuple[list[Block], Paths]:
    """The text blocks of a page in order, and their paths. Tags that are cut off at the end of the page are dropped."""
    out: list[Block] = []
    paths = Paths()
    stack: list[tuple[str, int, bool, bool, bool]] = []  # tag, path, aside, article, aside by an element or header
    opened: dict[str, int] = {}  # how many of a tag are in the stack
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def cut(k: int) -> None:
        for tag, *_ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if in_link:
                linked += len(raw)

    def end() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                _, path, aside, article, hard = stack[-1] if stack else ("", 0, False, False, False)
                out.append(Block(path, text, min(linked, len(text)), aside, article, aside and not hard))
            parts.clear()
            linked = 0

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = m[3] and m[3].lower()
        if not name:
            if m[1]:
                put(m[1])
            continue
        if m[2]:  # an end tag
            if name == "a":
                in_link = 0
            if name == "br":
                parts.append(" ")
            elif name not in INLINE:
                end()
                for k in range(len(stack) - 1, -1, -1) if opened.get(name) else ():
                    if stack[k][0] == name:
                        cut(k)
                        break
                    if name == "p" and stack[k][0] in SCOPE:
                        break
            continue
        if name in RAW and not m[4].rstrip().endswith("/"):
            if name not in INLINE:
                end()
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name in VOID or name in INLINE:
            if name == "a":
                in_link = 1
            elif name == "hr":
                end()
            elif name == "br":
                parts.append(" ")
            continue
        end()
        if stack and stack[-1][0] == "p":  # a block ends an open paragraph
            cut(len(stack) - 1)
        if name in CLOSES and any(opened.get(x) for x in CLOSES[name]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[name]:
                    cut(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        in_link = in_link if name in ("div", "h1", "h2", "h3", "h4", "p", "li") else 0
        _, path, aside, article, hard = stack[-1] if stack else ("", 0, False, False, False)
        names = [(c[0].lower(), "".join(c[1:]).lower()) for c in _CLASS.findall(m[4])]
        words = {w for _, value in names for w in _WORD.findall(value)}
        label = name + "".join(f".{w}" for w in sorted(words))
        article = article or name in ("article", "main") or "articlebody" in words
        hard = hard or name in ASIDE_TAGS or (name == "header" and not article)
        aside = aside or hard or _marked(name, names) or ("header" in words and name not in ROOTS and not article)
        stack.append((name, paths.below(path, name, label), aside, article, hard))
        opened[name] = opened.get(name, 0) + 1
    end()
    return out, paths


def _smooth(v: np.ndarray) -> np.ndarray:
    if len(v) < 3:
        return v
    padded = np.pad(v, 1, mode="edge")
    return padded[:-2] * 0.25 + padded[1:-1] * 0.5 + padded[2:] * 0.25


class Ratios(NamedTuple):
    """Of each path, in the order of its first block."""

    score: np.ndarray  # the fused ratio: unlinked text a block by punctuation a block, each smoothed over neighbours
    plain: np.ndarray  # unlinked share of the text
    weight: np.ndarray  # characters


def path_ratios(found: list[Block]) -> tuple[dict[int, int], Ratios]:
    """Where each path stands, and the ratios."""
    place = {p: k for k, p in enumerate(dict.fromkeys(b.path for b in found))}
    at = np.array([place[b.path] for b in found])
    size = np.array([len(b.text) for b in found], float)
    bare = size - np.array([b.linked for b in found])
    n, weight = np.bincount(at), np.bincount(at, size)
    length = np.bincount(at, bare) / n
    marks = np.bincount(at, np.array([len(_PUNCT.findall(b.text)) for b in found]) * bare / size) / n
    score = np.sqrt((length + _smooth(length)) * (1 + marks + _smooth(marks))) / 2 * (np.bincount(at, bare) / weight)
    return place, Ratios(score, np.bincount(at, bare) / weight, weight)


def main_blocks(page: str) -> list[Block]:
    """The blocks of the article, in page order.

    Blocks inside menus, adverts, forms and the like are out before the ratios are taken; where no sentence would
    remain, those stay that only a class, id or role marks. Candidates are the blocks of article and main elements
    where those hold sentences, else all. Paths whose fused ratio reaches the threshold, set from the mean and the
    spread of the ratios by text, are content. Of the others those stay that are more text than links: in an
    article anywhere, else where they are headings, paragraphs or lists below what holds content.
    """
    found, paths = blocks(page)
    heading = lambda b: re.fullmatch(r"h[1-6]", paths.tag[b.path]) is not None
    plain_text = lambda its: sum(len(b.text) - b.linked for b in its if not heading(b))
    prose = [b for b in found if b.linked * 2 < len(b.text) and not heading(b) and _PUNCT.search(b.text)]
    rest = [b for b in found if not b.aside]
    if all(b.aside for b in prose) and any(b.soft for b in prose) and not plain_text(b for b in rest if b.article):
        rest = [b for b in found if not b.aside or b.soft]
    if not rest:
        return []
    inside = [b for b in rest if b.article]
    if plain_text(inside) * 4 < plain_text(b for b in rest if not b.article):  # a card or a headline only, the text stands elsewhere
        inside = []
    place, r = path_ratios(inside or rest)
    mean = float((r.score * r.weight).sum() / r.weight.sum())
    spread = float(np.sqrt((r.weight * (r.score - mean) ** 2).sum() / r.weight.sum()))
    content = r.score >= min(mean - 0.5 * spread, 0.5 * mean)
    plain = r.plain >= 0.5
    if inside:
        return [b for b in inside if content[place[b.path]] or plain[place[b.path]]]
    holds = [False] * len(paths.tag)
    for p, k in place.items():
        if content[k] and paths.parent[p] > 0:
            holds[paths.parent[p]] = True
    for k in range(1, len(holds)):  # parents come first
        holds[k] = holds[k] or holds[paths.parent[k]] and paths.parent[k] > 0
    loose = any(content[k] and paths.parent[p] <= 0 for p, k in place.items())
    beside = lambda p: (loose or holds[paths.parent[p]]) and paths.tag[p] in TEXT_TAGS
    return [b for b in rest if content[place[b.path]] or plain[place[b.path]] and beside(b.path)]


def extract_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in main_blocks(page or ""))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Returns per row: all columns but ``html_col``, and text (main text, blocks joined by an empty line).

    A null or empty page, and one without article text, has the empty text. An input column named text
    is replaced. Whole pages are read; ids are not looked at, so nulls and repeats pass through.
    """
    own = [c for c in pages.columns if c.lower() not in ("text", html_col.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(t) for t in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(own).columns, pa.array(texts, pa.string())], names=[*own, "text"])

    small_batches(pages.sparkSession)
    rows = pages.select(*own, F.col(html_col).cast("string").alias("__html"))
    schema = rows.select(*own, F.lit("").alias("text")).schema
    return rows.mapInArrow(run, schema)
