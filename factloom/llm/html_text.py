"""Main text of web pages by tag-path ratios.

A page becomes a list of text nodes, each on a root-to-leaf tag path; paths are numbers, interned by their parent's number,
their last tag and whether that element's class speaks against it. Per path, over the whole page, two ratios are
aggregated: characters of text for each node, and punctuation marks for each node (text of links counts for neither). Each
is smoothed along the page by a Gaussian, the two are fused by multiplication, evidence against a path (a class, or that it
is outside of the article elements that hold most of the text) lowers it by a factor, and the paths whose fused mean passes
a threshold from the page's own spread are content, in an article element as outside of one.

A block is returned if text of it is on a content path. Of the others, paragraphs, list items, cells, quotes, captions and
code are returned where they stand beside content (in its section, or between blocks of it), headings where a returned
block follows before the next heading of their rank, and nothing else: text that stands straight in a container goes, and
so do blocks of links alone, unless they are in a section with content, and theirs is a content path or they follow content
within the article element (lists of sources, of downloads: a menu has a section, role or class of its own, or comes first).

What never counts: scripts, styles and hidden elements; nav, footer, aside and dialog elements, the same roles, and headers
outside of an article. A form doesn't count, and a class or id speaks against its element, unless under LEAST_LEFT of the
page's text would be left outside: so a wrapper around the article sends nothing away, whatever it is called.

Edge cases: null and empty pages, and pages without text, give an empty text; broken markup is closed as browsers do
for blocks, an unfinished tag at the end is dropped, an unfinished comment or script reaches to the end; repeated rows
are treated each; an empty table gives an empty result; no length is capped, and the time is linear in it, however deep
elements nest; further columns are dropped, and one called `text` or `n_chars` doesn't clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Of the mean of fused ratios, less its spread: a path above it is content.
THRESHOLD = 0.5
#: Nodes by which the ratios are smoothed.
SIGMA = 1.0
#: By how much a class or an id that speaks against an element lowers the ratio of paths through it, and by how much those
#: outside of article elements are lowered where these hold most of the text.
EVIDENCE, OUTSIDE = 0.1, 0.4
#: A class doesn't speak against an element, and a form counts, if the page has so small a share of its text outside.
LEAST_LEFT = 0.1
ARTICLE = frozenset(["article", "main"])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*)(>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup"
    " hr html legend li main menu nav ol optgroup option p pre section summary table tbody td template tfoot th thead title tr ul".split()
)
#: Blocks that are part of the section around them.
_PARTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup p pre blockquote address center ul ol li dl dt dd dir table caption thead tbody tfoot tr td th figure figcaption details summary".split())
DROP = frozenset("head nav footer aside script style textarea iframe noembed noframes noscript template button select menu dialog svg math object canvas audio video title".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: What an opening tag closes, up to the elements in the second set.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_KEEPS_P = ("td", "th", "table", "button", "object")
_CELLS = ("table", "td", "th")
_NOT_OUT_OF_CELLS = frozenset("p li div b i a span em strong".split())
_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar form toolbar".split())
#: Parts of class names that speak against an element, for it, and of its looks alone.
AGAINST = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar"
    " navigation menu breadcrumb breadcrumbs sidebar rail footer header masthead comment comments commentlist respond replies reply disqus share sharing social related recommended newsletter"
    " subscribe signup login search pagination pager toolbar skip legal copyright disclaimer".split()
)
FOR = frozenset("article content contents body main page post posts entry story text prose wrapper container layout".split())
LOOKS = frozenset("no not non without with has have is in fixed sticky left right top bottom open closed wide hidden visible enabled disabled".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…¿¡]")
_NONE, _CLASS, _FORM = 0, 1, 2


def speaks_against(names: str) -> bool:
    """Whether the words of a class or id speak more against an element than for it. The last part of a word tells what
    the element is, the first what it belongs to; words of looks (no-sidebar, header-fixed) say nothing."""
    balance = 0
    for name in names.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if not parts or len(parts) > 1 and not LOOKS.isdisjoint(parts):
            continue
        if parts[-1] in AGAINST or parts[0] in AGAINST and (parts[-1] not in FOR or parts[0].startswith("comment")):
            balance -= 1
        elif parts[-1] in FOR:
            balance += 1
    return balance < 0


class Page:
    """Elements (parent, tag, hint; a parent's number is the lesser), and runs of text: element, block, text, in a link."""

    def __init__(self, html: str):
        self.parent, self.tag, self.hint = [0], [""], [_NONE]
        self.at: list[int] = []
        self.block: list[int] = []
        self.text: list[str] = []
        self.link: list[bool] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, opened = [0], {}  # open elements; of each tag, their places in the stack
        dead = len(html) + 1  # where the outermost element stands that never counts
        blocks = at = 0

        def text(raw: str) -> None:
            if raw and dead > len(stack):
                self.at.append(stack[-1])
                self.block.append(blocks)
                self.text.append(unescape(raw) if "&" in raw else raw)
                self.link.append(bool(opened.get("a")))

        def last(tags: tuple[str, ...]) -> int:
            return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

        def close(place: int) -> None:
            nonlocal blocks, dead
            while len(stack) > place:
                tag = self.tag[stack.pop()]
                opened[tag].pop()
                blocks += tag in BLOCK
            if dead >= len(stack):
                dead = len(html) + 1

        for m in iter(lambda: _TOKEN.search(html, at), None):
            text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    text(m[0][9:].removesuffix("]]>"))
                continue
            if not m[4]:  # the page ends within a tag
                break
            tag = m[2].lower()
            if m[1]:
                place = last((tag,))
                if place and not (tag in _NOT_OUT_OF_CELLS and last(_CELLS) > place):
                    close(place)
                elif tag in ("p", "br"):
                    blocks += 1
                continue
            if tag in BLOCK:
                blocks += 1
                if last(("p",)) > last(_KEEPS_P):  # a block ends an open paragraph
                    close(last(("p",)))
            if tag in _CLOSES:
                ends, stops = _CLOSES[tag]
                stop = last(stops)
                first = min((o[i] for t in ends if (o := opened.get(t)) and (i := bisect_right(o, stop)) < len(o)), default=0)
                if first:
                    close(first)
            if tag == "br":
                text("\n")
            if tag in VOID:
                continue
            if tag in RAW:
                at = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(html, at).end()
                blocks += tag in BLOCK
                continue
            if m[3].endswith("/") and tag in ("svg", "path", "use", "circle", "rect", "g"):
                continue
            away, hint = self._judge(tag, m[3], bool(opened.get("article") or opened.get("main"))) if dead > len(stack) else (True, _NONE)
            if away:
                dead = min(dead, len(stack))
            opened.setdefault(tag, []).append(len(stack))
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.hint.append(hint)
            stack.append(len(self.tag) - 1)
        else:
            text(html[at:])

    @staticmethod
    def _judge(tag: str, attrs: str, in_article: bool) -> tuple[bool, int]:
        """Whether an element never counts; else what speaks against it."""
        if tag in DROP or tag == "header" and not in_article:
            return True, _NONE
        hint = _FORM if tag == "form" else _NONE
        if not attrs or tag in ("html", "body"):
            return False, hint
        names = []
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "itemprop", "data-role"):
                names.append(value)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in _ROLES:
                return True, _NONE
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, _NONE
        return False, hint or (_CLASS if names and speaks_against(" ".join(names)) else _NONE)

    def sums(self, of_elements: np.ndarray) -> list[float]:
        """What each element holds, with all in it: one pass from the leaves."""
        held = of_elements.tolist()
        for e in range(len(held) - 1, 0, -1):
            held[self.parent[e]] += held[e]
        return held

    def paths(self, sizes: np.ndarray) -> tuple[list[int], list[float]]:
        """The number of each element's path (-1 in a form that doesn't count); of each path, the factor by which evidence lowers it."""
        held = self.sums(np.bincount(self.at, sizes, len(self.tag)) if self.at else np.zeros(len(self.tag)))
        inside = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            inside[e] = inside[self.parent[e]] or self.tag[e] in ARTICLE
        outside = OUTSIDE if 2 * sum(n for e, n in zip(self.at, sizes.tolist(), strict=True) if inside[e]) > held[0] else 1.0
        found: dict[tuple[int, str, bool], int] = {}
        path, against, believed = [0], [False], [outside]
        for e in range(1, len(self.tag)):
            up = path[self.parent[e]]
            away = self.hint[e] != _NONE and held[0] - held[e] >= LEAST_LEFT * held[0]
            if up < 0 or away and self.hint[e] == _FORM:
                path.append(-1)
                continue
            key = up, self.tag[e], away
            if key not in found:
                found[key] = len(believed)
                against.append(against[up] or away)
                believed.append((EVIDENCE if against[-1] else 1.0) * (1.0 if inside[e] else outside))
            path.append(found[key])
        return path, believed


def _smooth(x: np.ndarray) -> np.ndarray:
    reach = np.arange(-int(3 * SIGMA), int(3 * SIGMA) + 1)
    kernel = np.exp(-0.5 * (reach / SIGMA) ** 2)
    middle = slice(len(reach) // 2, len(reach) // 2 + len(x))
    return np.convolve(x, kernel, "full")[middle] / np.convolve(np.ones(len(x)), kernel, "full")[middle]


def content_paths(of: np.ndarray, length: np.ndarray, marks: np.ndarray, believed: np.ndarray) -> np.ndarray:
    """Of each path, whether it is content. of, length, marks: the path of each node, in the page's order, its characters and its marks;
    believed: the factor of each path."""
    n = len(believed)
    count = np.maximum(np.bincount(of, minlength=n), 1)
    smooth = [_smooth((np.bincount(of, x, n) / count)[of]) for x in (length, marks)]
    mean = np.bincount(of, np.sqrt(smooth[0] * smooth[1]), n) / count * believed
    held = np.bincount(of, length, n)
    weigh = held * believed
    if not held.any():
        return np.zeros(n, bool)
    typical = (mean * weigh).sum() / weigh.sum()
    spread = np.sqrt((weigh * (mean - typical) ** 2).sum() / weigh.sum())
    return (held > 0) & (mean >= THRESHOLD * max(typical - spread, 0.5 * typical))


def extract(html: str | None) -> str:
    page = Page(html or "")
    if not page.at:
        return ""
    here = [i for i, t in enumerate(page.text) if t and not t.isspace()]
    sizes = np.zeros(len(page.text))
    sizes[here] = [0 if page.link[i] else len(page.text[i].strip()) for i in here]
    path, believed = page.paths(sizes)
    here = [i for i in here if path[page.at[i]] >= 0]
    if not here:
        return ""
    of = np.array([path[page.at[i]] for i in here])
    marks = np.array([0 if page.link[i] else len(_PUNCTUATION.findall(page.text[i])) for i in here], float)
    good = content_paths(of, sizes[here], marks, np.array(believed))
    sure = {i for i, p in zip(here, of.tolist(), strict=True) if good[p] and not page.link[i]}

    blocks: list[list[int]] = []
    for i in range(len(page.text)):
        if path[page.at[i]] >= 0:
            if not blocks or page.block[blocks[-1][-1]] != page.block[i]:
                blocks.append([])
            blocks[-1].append(i)
    texts = [" ".join("".join(page.text[i] for i in b).split()) for b in blocks]
    blocks, texts = [b for b, t in zip(blocks, texts, strict=True) if t], [t for t in texts if t]
    content = [not sure.isdisjoint(b) for b in blocks]
    if not any(content):
        return ""
    return "\n".join(t for t, keep in zip(texts, _chosen(page, blocks, content, path, believed, good, sizes, sure), strict=True) if keep)


def _chosen(page: Page, blocks: list[list[int]], content: list[bool], path: list[int], believed: list[float], good: np.ndarray, sizes: np.ndarray, sure: set[int]) -> list[bool]:
    """Which blocks are returned: those with content, and those beside it."""
    n = len(page.tag)
    block, section, heading = [0] * n, [0] * n, [0] * n  # of each element, the nearest around it
    for e in range(1, n):
        tag, up = page.tag[e], page.parent[e]
        block[e] = e if tag in BLOCK else block[up]
        section[e] = e if tag in BLOCK and tag not in _PARTS else section[up]
        heading[e] = HEADINGS.get(tag) or heading[up]
    holders = {section[page.at[i]] for i in sure}
    mine = np.zeros(n)
    for i in sure:
        mine[page.at[i]] += sizes[i]
    held = page.sums(mine)
    top = section[next(e for e in range(n - 1, -1, -1) if held[e] >= held[0])]  # the smallest section around all content, or the article
    up = top
    while up and page.tag[up] not in ARTICLE:
        up = page.parent[up]
    top = up or top
    beside = [top == 0 and 0 in holders] + [False] * (n - 1)
    within = [top == 0] + [False] * (n - 1)
    for e in range(1, n):
        within[e] = e == top or within[page.parent[e]]
        beside[e] = within[e] and (e in holders or beside[page.parent[e]])
    in_article = [False] * n
    for e in range(1, n):
        in_article[e] = within[e] and (page.tag[e] in ARTICLE or in_article[page.parent[e]])
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)

    kept = list(content)
    for k, b in enumerate(blocks):
        e = page.at[next(i for i in b if page.text[i].strip())]
        own = block[e]
        if kept[k] or heading[e] or page.tag[own] not in _PARTS or believed[path[e]] <= EVIDENCE:
            continue
        if all(page.link[i] for i in b if page.text[i].strip()):
            kept[k] = section[e] in holders and (bool(good[path[own]]) or k > first and in_article[e])
        else:
            kept[k] = first < k < last or beside[e]
    after = [False] * 8  # by rank: whether a block is returned before the next heading of it, or of a higher one
    for k in range(len(blocks) - 1, -1, -1):
        e = page.at[next(i for i in blocks[k] if page.text[i].strip())]
        if rank := heading[e]:
            kept[k] = kept[k] or after[rank] and within[e] and believed[path[e]] > EVIDENCE
            after[rank:] = [False] * (8 - rank)
            if kept[k]:
                after[:rank] = [True] * rank
        elif kept[k]:
            after = [True] * 8
    return kept


def main_text(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """keep, text, n_chars."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, html_col):
            got = [extract(x) for x in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], [*keep, "text", "n_chars"])

    return common.pick(pages, *dict.fromkeys([*keep, html_col])).mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"), ["page_id", "url"])
