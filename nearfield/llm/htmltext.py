"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of block elements (class and id words
included). Per path the text length, punctuation marks, link text and blocks are added up. The two ratios
(characters outside links and marks for each block) are smoothed along the page, averaged for each path, joined
with the path's own by geometric means and fused into one score, which counts less the more of the path's text is links. Names are a prior: the score is
multiplied by MARKED inside an article or main element, by NAMED inside a block whose class or id says as much, and by
DENIED inside boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments). Paths whose
score reaches SHARE of the page's highest, and LEAST, are content. So a path without names, or with the wrong ones, is judged
by its text, and text in an article element still has to be as dense as a twentieth of what lies outside.

What the threshold leaves out of the article's own element is filled in, so that short items and captions are not
lost: all blocks below the common ancestor of the content paths (inside article or main elements, where content lies in
such) that are not boilerplate; blocks made of links only there only inside an article or main element.

Each step takes time in proportion to the page, whatever its markup: paths are numbers with parents, open elements
of a name are found by an index, and a tag's end is looked for only where there is one.

Defined results: null and empty pages, and pages without content, give an empty text; character
references are decoded; white space in a block becomes one space; blocks are joined by one space in page
order; nothing else is dropped or cut, however long; a tag that never ends is text; where quotes in tags don't
match, a tag ends at its first ">"; repeated rows give repeated results; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
INSIDE_TAG = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
RAW = frozenset("script style noscript template iframe svg math object textarea select title".split())
RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

# Fixed values of HTML: elements without content, inline elements, and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl article section div body html td th".split())

#: Elements and class or id words that hold no article text.
BOILERPLATE_TAGS = frozenset("head nav footer aside form button menu dialog header".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer "
    "sidebar aside widget related recommended share sharing social comment comments reply replies discussion disqus respond notice notices cookie cookies consent gdpr popup modal "
    "newsletter subscribe subscription signup login form search pagination pager copyright legal toolbar skip".split()
)
COMMENT_WORDS = frozenset(["comment", "comments", "reply"])
#: Names that tell how a page is laid out, such as has-sidebar, not what an element holds.
LAYOUT = ("has-", "with-", "no-", "without-")
MAIN_TAGS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article content main post entry story text body maincontent postcontent".split())
MARKS = re.compile(r"[.,;:!?¿¡…。，、；：！？]")
#: Neighbours on each side that a block's ratios are smoothed over, with Gaussian weights.
SMOOTH = 2
#: A content path's least score, as a share of the page's highest and by itself.
SHARE = 0.1
LEAST = 1.0
#: What a score is multiplied by for names: article and main elements, blocks named so, boilerplate.
MARKED, NAMED, DENIED = 20.0, 2.0, 0.01
#: Elements that are parts of a text and hold no whole one.
WITHIN = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr dt dd blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Groups of elements of which one ends another, by group number, and the elements in which they are looked for.
GROUPS = ({"p"}, {"li"}, {"dt", "dd"}, {"tr", "td", "th"}, {"td", "th"}, {"option"})
ENDED_BY = {tag: next(i for i, g in enumerate(GROUPS) if g == ends) for tag, ends in ENDS_SAME.items()}
LISTS = frozenset(["ul", "ol", "dl", "table"])


@lru_cache(maxsize=20_000)
def _label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """A path step, whether it is boilerplate, whether it is named as the main text."""
    words: list[str] = []
    if attributes and "=" in attributes:
        for m in NAMES.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                if not name.startswith(LAYOUT):
                    words += re.split(r"[^a-z0-9]+", name)
    words = [w for w in words if w]
    bad = tag in BOILERPLATE_TAGS or (tag not in ("html", "body", "article", "main") and not BOILERPLATE_WORDS.isdisjoint(words)) or (tag == "article" and not COMMENT_WORDS.isdisjoint(words))
    named = not bad and not MAIN_WORDS.isdisjoint(words) and tag in ("div", "section", "td")
    return (tag + "." + ".".join(words) if words else tag), bad, named


class Paths:
    """Paths of block elements as numbers; 0 is the page. A parent's number is below its children's."""

    def __init__(self):
        self.parent, self.tag, self.step = [0], [""], [""]
        # inside: article or main, a block named so, a header of an article, a heading, other boilerplate
        self.marked, self.named, self.head, self.title, self.bad = [False], [False], [False], [False], [False]
        self.known: dict[tuple[int, str], int] = {}

    def below(self, parent: int, tag: str, attributes: str) -> int:
        step, bad, named = _label(tag, attributes)
        at = self.known.get((parent, step))
        if at is None:
            at = self.known[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.step.append(step)
            head = bad and tag == "header" and self.marked[parent]
            self.marked.append(self.marked[parent] or tag in MAIN_TAGS)
            self.named.append(self.named[parent] or named)
            self.head.append(self.head[parent] or head)
            self.title.append(self.title[parent] or tag in HEADINGS)
            self.bad.append(self.bad[parent] or (bad and not head))
        return at

    def denied(self, path: int) -> bool:
        """Whether it is boilerplate; the headings in an article's own header are not."""
        return self.bad[path] or (self.head[path] and not self.title[path])

    def prior(self, path: int) -> float:
        return (MARKED if self.marked[path] else NAMED if self.named[path] else 1.0) * (DENIED if self.denied(path) else 1.0)

    def steps(self, path: int) -> tuple[str, ...]:
        out = []
        while path:
            out.append(self.step[path])
            path = self.parent[path]
        return tuple(reversed(out))


class Block:
    __slots__ = ("linked", "marks", "path", "size", "texts")

    def __init__(self, path: int):
        self.path, self.texts, self.size, self.linked, self.marks = path, [], 0, 0, 0


def blocks_of(page: str) -> tuple[Paths, list[Block]]:
    """A page's blocks of text in order."""
    paths, out = Paths(), []
    stack: list[str] = []  # open elements
    at: list[int] = [0]  # for each depth the path
    links: list[bool] = [False]
    ends: list[tuple[int, ...]] = [(-1,) * len(GROUPS)]  # for each depth and group the depth of the open element that it would end
    places: dict[str, list[int]] = {}
    fresh = True
    last_end = page.rfind(">")
    patience = 4 * len(page) + 1_000  # characters that may be read in vain for quotes that don't match

    def cut(depth: int) -> None:
        for tag in reversed(stack[depth:]):
            places[tag].pop()
        del stack[depth:], at[depth + 1 :], links[depth + 1 :], ends[depth + 1 :]

    def text(raw: str) -> None:
        nonlocal fresh
        if "&" in raw:
            raw = entities.unescape(raw)
        if fresh:
            if raw.isspace():
                return
            out.append(Block(at[-1]))
            fresh = False
        block = out[-1]
        block.texts.append(raw)
        size = len(raw) if not raw[:1].isspace() and not raw[-1:].isspace() else len(raw.strip())
        block.size += size
        if links[-1]:
            block.linked += size
        block.marks += len(MARKS.findall(raw))

    pos, n = 0, len(page)
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            text(page[pos:])
            break
        if lt > pos:
            text(page[pos:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            pos = n if end < 0 else end + 3
            continue
        m = NAME.match(page, lt + 1)
        if lt > last_end or (m is None and page[lt + 1 : lt + 2] not in ("/", "!", "?")):
            text("<")
            pos = lt + 1
            continue
        if m is None:
            pos = page.find(">", lt) + 1
            continue
        inside = INSIDE_TAG.match(page, m.end()) if patience > 0 else None
        if inside is None:
            patience -= n - m.end()
            end = page.find(">", m.end())
        else:
            end = inside.end() - 1
        attributes, tag = page[m.end() : end], m[0].lower()
        pos = end + 1
        if tag[0] == "/":
            tag = tag[1:]
            if tag not in INLINE:
                fresh = True
            if places.get(tag):
                cut(places[tag][-1])
            continue
        if tag in RAW:
            stop = RAW_END[tag].search(page, pos)
            pos = stop.end() if stop else n
            if tag in ("textarea", "select", "title"):
                fresh = True
            continue
        if tag not in INLINE:
            fresh = True
        if tag in VOID:
            continue
        group = 0 if tag in ENDS_P else ENDED_BY.get(tag, -1)
        if group >= 0 and ends[-1][group] >= 0:
            cut(ends[-1][group])
        if attributes.endswith("/"):
            continue
        depth = len(stack)
        open_ = list(ends[-1])
        if tag in SCOPE:
            open_[0] = -1
        if tag in LISTS:
            open_[1:] = [-1] * (len(GROUPS) - 1)
        for i, g in enumerate(GROUPS):
            if tag in g:
                open_[i] = depth
        places.setdefault(tag, []).append(depth)
        stack.append(tag)
        at.append(at[-1] if tag in INLINE else paths.below(at[-1], tag, attributes))
        links.append(links[-1] or tag == "a")
        ends.append(tuple(open_))
    return paths, [b for b in out if b.size]


def smoothed(values: list[float], width: int = SMOOTH) -> list[float]:
    """Gaussian weights over the neighbours on each side."""
    weights = [math.exp(-(d * d) / 2) for d in range(width + 1)]
    out = []
    for i in range(len(values)):
        total = norm = 0.0
        for j in range(max(0, i - width), min(len(values), i + width + 1)):
            w = weights[abs(i - j)]
            total += w * values[j]
            norm += w
        out.append(total / norm)
    return out


def path_scores(paths: Paths, blocks: list[Block]) -> dict[int, float]:
    """The score of each path that has text: smoothed and fused ratios, the share of text outside links, and the prior of its names."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        s[0] += b.size - b.linked
        s[1] += b.marks
        s[2] += 1
        s[3] += b.size
    lengths = smoothed([sums[b.path][0] / sums[b.path][2] for b in blocks])
    marks = smoothed([sums[b.path][1] / sums[b.path][2] for b in blocks])
    along: dict[int, list[float]] = {p: [0.0, 0.0] for p in sums}
    for b, x, y in zip(blocks, lengths, marks, strict=True):
        along[b.path][0] += x
        along[b.path][1] += y
    out = {}
    for p, (own, points, count, size) in sums.items():
        x, y = math.sqrt(along[p][0] * own) / count, math.sqrt(along[p][1] * points) / count
        out[p] = math.log(2 + x) * (1 + math.log1p(y)) * (own / size) * paths.prior(p)
    return out


def content_paths(scores: dict[int, float]) -> set[int]:
    """Paths that reach the threshold."""
    least = max(LEAST, SHARE * max(scores.values(), default=0.0))
    return {p for p, s in scores.items() if s >= least}


def filled(paths: Paths, content: set[int]) -> set[int]:
    """Paths below the common ancestor of the content paths that are no boilerplate, inside article or main elements if content lies in such."""
    count = [0] * len(paths.parent)
    for p in content:
        count[p] = 1
    for p in range(len(count) - 1, 0, -1):
        count[paths.parent[p]] += count[p]
    root = max((p for p in range(len(count)) if count[p] == len(content)), default=0)
    while root and paths.tag[root] in WITHIN:
        root = paths.parent[root]
    marked = any(paths.marked[p] for p in content)
    below = [False] * len(count)
    out = set()
    for p in range(root, len(count)):
        below[p] = p == root or (p > 0 and below[paths.parent[p]])
        if below[p] and not paths.denied(p) and (paths.marked[p] or not marked):
            out.add(p)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    paths, blocks = blocks_of(page)
    content = content_paths(path_scores(paths, blocks))
    if not content:
        return ""
    more = filled(paths, content)
    out = []
    for b in blocks:
        if b.path in content or (b.path in more and (b.linked < b.size or paths.marked[b.path])):
            out.append(" ".join("".join(b.texts).split()))
    return " ".join(out)


def extract(pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """keep columns, text and n_chars (code points) of every row of pages."""
    light = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html_col).alias("html"))
    kinds = [light.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*[f"k{i}" for i in range(len(keep))], "text", "n_chars"]
            )

    out = light.mapInArrow(run, ", ".join([*[f"k{i} {k}" for i, k in enumerate(kinds)], "text string", "n_chars long"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
