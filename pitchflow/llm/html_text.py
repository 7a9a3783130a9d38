r"""The main text of web pages by composite text density.

A page becomes a tree of elements. Elements that are no text of an article by their tag, role or class (scripts,
menus, site headers, footers, sidebars, notices, adverts, forms, reader comments) are taken out first. Every other
element has a density: its characters a tag, times the logarithm of characters against link characters and tags against
link tags, to a base that grows with its links and with the page's share of link text. Of all block elements the one
whose children's densities sum up highest is the middle of the article; that is widened to the <article> or <main>
around it. Where there is none, the lowest density on the path from there to the body is the threshold: other
parts of the body that reach it, by density and by the sum over their children, belong to the article too, and so does a heading h1 beside
that path. Lists and divisions of the article that are nearly only links are menus and go.

Blocks are what block elements part; white space inside a block, line breaks included, becomes one space, character
references are decoded, and blocks are joined in page order by an empty line. Nothing else is dropped or cut.

Nulls, ties and edges: a null or empty page, and one without text, has an empty text. Of equal sums the outer element
wins, then the first. Unclosed, crossing and unknown tags are borne as browsers do, near enough; a script that never
ends goes on to the end. Pages are judged alone, in memory of a few times their size; repeated rows repeat their
result. Other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import small_slices

# Elements of HTML and words that sites use for parts that are not their articles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
NEVER = frozenset(
    "head script style noscript template textarea title iframe noembed noframes object canvas svg math audio video button select option input "
    "datalist nav aside footer menu dialog search".split()
)
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NO_TEXT_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices "
    "notification popup modal overlay newsletter subscribe subscription signup login sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager toolbar topbar share sharing social related recommended widget widgets skip".split()
)
FRAME_WORDS = frozenset("header masthead footer comment comments commentlist reply replies respond discussion disqus nav navbar navigation menu".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]), "tbody": frozenset(["tr", "td", "th", "tbody", "thead"]), "body": frozenset(["head"]),
}
SCOPES = frozenset("table ul ol dl div section article body html td th blockquote".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]{0,2000}+"|'[^']{0,2000}+'|["'])*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
LINKS_ONLY = 0.8


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether attributes name a part that is no text of an article, and whether even a heading in it does not save it."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, False
    out = frame = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" and not value.startswith("until") or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            out = frame = True
        elif name == "role" and value in NO_TEXT_ROLES:
            out = True
        elif name in ("class", "id"):
            for one in value.split():
                # The first and the last word of a name say what it is: side-menu, comment_list; has-sidebar says it of its page.
                words = _WORDS.findall(one)
                if words and words[0] not in ("has", "no", "with", "without", "is"):
                    ends = {words[0], words[-1]}
                    frame |= not ends.isdisjoint(FRAME_WORDS)
                    out |= frame or not ends.isdisjoint(NO_TEXT_WORDS)
    return out, frame


class Page:
    """The tree: for each element its tag, parent and marks; and what is read in order, texts as (element, text), starts and ends of blocks as None."""

    def __init__(self, source: str):
        self.tags, self.parents, self.marks, self.read = ["#page"], [-1], [(False, False)], []
        self._parse(source)

    def _open(self, tag: str, attributes: str, stack: list[int]) -> int:
        self.tags.append(tag)
        self.parents.append(stack[-1])
        self.marks.append((False, False) if tag in ("html", "body", "main") else _marks(tag, attributes))
        return len(self.tags) - 1

    def _parse(self, source: str) -> None:
        tags, read, stack, at = self.tags, self.read, [0], 0
        end_of_tags = source.rfind(">") + 1
        while m := _TOKEN.search(source, at, end_of_tags):
            if m.start() > at:
                read.append((stack[-1], source[at : m.start()]))
            at, tag = m.end(), m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._close(tag, stack)
                continue
            if tags[stack[-1]] == "head" and tag not in IN_HEAD:
                stack.pop()
            if tag in BLOCK:
                self._end_open({"p"}, stack)
                read.append(None)
            if tag in CLOSED_BY:
                self._end_open(CLOSED_BY[tag], stack)
            node = self._open(tag, m[3], stack)
            if tag == "br":
                read.append((node, " "))
            if tag in RAW:
                close = re.compile(f"</{tag}[\\s/>]", re.IGNORECASE).search(source, at)
                at = close.start() if close else len(source)
                end_of_tags = max(end_of_tags, at)
            if tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK and tag not in RAW):
                stack.append(node)
        if at < len(source):
            read.append((stack[-1], source[at:]))

    def _end_open(self, these: set | frozenset, stack: list[int]) -> None:
        """Ends the open elements of these tags that no scope stands around."""
        while True:
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[k]]
                if tag in these:
                    del stack[k:]
                    self.read.append(None)
                    break
                if tag in SCOPES:
                    return
            else:
                return

    def _close(self, tag: str, stack: list[int]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == tag:
                del stack[k:]
                break
            if tag not in BLOCK and self.tags[stack[k]] in BLOCK:
                return  # an inline end does not close a block
        if tag in BLOCK:
            self.read.append(None)

    def _dropped(self) -> list[bool]:
        """Which elements are out with all in them."""
        n, tags, parents = len(self.tags), self.tags, self.parents
        holds = [0] * n  # 1: a heading h1, 2: an article or the main part
        inside = [False] * n
        for i in range(n - 1, 0, -1):
            own = 2 if tags[i] in ("article", "main") and not self.marks[i][1] else 1 if tags[i] == "h1" else 0
            holds[parents[i]] |= holds[i] | own
        out = [False] * n
        for i in range(1, n):
            up = parents[i]
            inside[i] = inside[up] or tags[i] in ("article", "main")
            marked, frame = self.marks[i]
            if tags[i] == "header" and not inside[up]:
                marked = frame = True
            elif tags[i] == "form":
                marked = True
            saved = holds[i] >= (2 if frame else 1)
            out[i] = out[up] or tags[i] in NEVER or marked and not saved
            if tags[up] == "header" and inside[up] and tags[i] not in HEADINGS and not holds[i]:
                out[i] = True  # of the header of an article its headings stay
        return out

    def main_text(self) -> str:
        n, tags, parents = len(self.tags), self.tags, self.parents
        out = self._dropped()
        chars, linked, n_tags, n_links, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parents[i]] or tags[i] == "a"
        texts = []
        for piece in self.read:
            if piece is None:
                texts.append(None)
            elif not out[piece[0]]:
                node, text = piece[0], html.unescape(piece[1]) if "&" in piece[1] else piece[1]
                texts.append((node, text))
                size = len(_SPACE.sub(" ", text).strip())
                chars[node] += size
                linked[node] += size if in_link[node] else 0
        for i in range(n - 1, 0, -1):
            if not out[i]:
                up = parents[i]
                chars[up] += chars[i]
                linked[up] += linked[i]
                n_tags[up] += n_tags[i] + 1
                n_links[up] += n_links[i] + (tags[i] == "a")
        if not chars[0]:
            return ""
        share, density, sums = linked[0] / chars[0], [0.0] * n, [0.0] * n
        for i in range(n):
            c = chars[i]
            if c and not out[i]:
                links, tag, link_tag = max(linked[i], 1), max(n_tags[i], 1), max(n_links[i], 1)
                base = math.log(c / max(c - linked[i], 1) * links + share * c + math.e)
                density[i] = c / tag * max(0.0, math.log(c / links * tag / link_tag)) / math.log(base)
                if i and tags[i] in BLOCK:
                    sums[parents[i]] += density[i]
        top = max(range(n), key=lambda i: (sums[i], -i))
        if not sums[top]:
            top = 0  # nothing but inline text
        whole = self._widened(top, chars, density, sums, out)
        part, keep = [False] * n, [False] * n
        for i in range(n):
            menu = i not in whole and tags[i] in BLOCK and tags[i] != "p" and n_links[i] > 2 and linked[i] > LINKS_ONLY * chars[i]
            part[i] = i in whole or i > 0 and part[parents[i]] and not menu
            keep[i] = part[i] and not out[i]
        blocks, now = [], []
        for piece in [*texts, None]:
            if piece is None:
                if block := " ".join("".join(now).split()):
                    blocks.append(block)
                now = []
            elif keep[piece[0]]:
                now.append(piece[1])
        return "\n\n".join(blocks)

    def _widened(self, top: int, chars: list, density: list, sums: list, out: list) -> set[int]:
        """The elements whose trees make up the article."""
        path = [top]
        while self.parents[path[-1]] >= 0:
            path.append(self.parents[path[-1]])
        for tag in ("article", "main"):
            if found := [i for i in path if self.tags[i] == tag]:
                return {found[-1]}
        threshold = min(density[i] for i in path if i and self.tags[i] != "html") if len(path) > 1 and self.tags[top] not in ("body", "html") else 0.0
        whole, on_path = {top}, set(path)
        for i in range(1, len(self.tags)):
            up = self.parents[i]
            if up in on_path and up != top and i not in on_path and not out[i] and chars[i]:
                if self.tags[i] == "h1" or density[i] >= threshold and sums[i] >= max(threshold, sums[top] / 10):
                    whole.add(i)
        return whole


def main_text(source: str | None) -> str:
    """The main text of one page."""
    return Page(source).main_text() if source else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in small_slices(batch, 2):
            texts = [main_text(page.as_py()) for page in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")
