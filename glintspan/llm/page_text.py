"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to their ancestors, fewer the farther up. A container's
points are discounted by its share of link text. The best container is kept, and siblings that score
or read like it. Parts that tags, roles or plain words of classes and ids mark as anything else than the article are
left out wherever they are. Words that an article's own parts bear as well (header, notice, search) leave a part
out only where it is outside of the best container or mostly links.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import with_arrow

#: A text of fewer characters gives no points; it is kept if its container is.
PARAGRAPH_CHARS = 25
#: A list or division with a larger share of link text is a menu.
MENU_SHARE = 0.6
#: A sibling of the best container is kept from this share of its score on.
SIBLING_SHARE = 0.2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noframes", "noembed", "xmp", "template", "svg", "math", "select", "object", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_OUT = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label", "search", "option"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_WALL = {"table", "ul", "ol", "dl", "td", "th", "article", "body", "html", "div", "section", "blockquote"}
_KEEP = {"html", "body", "article", "main"}
#: Words of classes and ids that mark what is no article, those that an article's parts may bear too, and those of articles. Fixed values of this extractor.
_BAD = set("ad ads adv advert adverts advertisement advertising adslot adbox bio breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter outbrain overlay pager pagination paywall popup promo promoted promotion recommended recommendations related replies respond share sharing sidebar sidenav signup sponsor sponsored subscribe subscription taboola teaser toc widget widgets".split())
_DOUBTFUL = set("banner byline copyright dialog disclaimer dropdown foot form header notice notices notification reply search skip social tags toolbar tooltip".split())
_GOOD = set("article articlebody body content entry main maincontent post story text".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


#: Marks of an element: none, doubtful, bad but with a good word beside, bad, and out whatever else is there.
CLEAN, DOUBTFUL, MIXED, BAD, OUT = range(5)


def _mark(attrs: str) -> int:
    """How attributes mark an element: as hidden, or by the words of its class and id."""
    mark, good = CLEAN, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in _ROLES:
            return OUT
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return OUT
        if name in ("class", "id"):
            words = {w.lower() for w in _WORD.findall(value)} | {w.lower() for w in re.split(r"[\s_-]+", value)}
            mark = max(mark, BAD if words & _BAD else DOUBTFUL if words & _DOUBTFUL else CLEAN)
            good = good or bool(words & _GOOD)
    return MIXED if mark == BAD and good else mark


class _Page:
    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.mark = ["#"], [-1], [False], [CLEAN]
        self.unclosed: set[str] = set()  # raw elements that are never closed from here on
        self.blocks: list[tuple[int, str, int]] = []  # block element, text, characters in links
        self.stack, self.open = [0], {"#": 1}
        self.buffer: list[str] = []
        self.linked = self.links = 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                node = next(n for n in reversed(self.stack) if self.tag[n] in _BLOCK or n == 0)
                self.blocks.append((node, text, min(self.linked, len(text))))
            self.buffer, self.linked = [], 0

    def _push(self, tag: str, out: bool, mark: int) -> None:
        top = self.stack[-1]
        self.tag.append(tag)
        self.parent.append(top)
        self.out.append(self.out[top] or out or mark == OUT)
        self.mark.append(mark)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"

    def _pop(self) -> str:
        tag = self.tag[self.stack.pop()]
        self.open[tag] -= 1
        self.links -= tag == "a"
        return tag

    def _close(self, tags: set[str], wall: set[str]) -> None:
        """Close the nearest open element of `tags`, and what it holds, unless one of `wall` is in between."""
        if not any(self.open.get(t) for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[at]]
            if t in tags:
                while len(self.stack) > at:
                    self._pop()
                return
            if t in wall:
                return

    def _text(self, text: str) -> None:
        if text and not self.out[self.stack[-1]]:
            text = html.unescape(text)
            self.buffer.append(text)
            if self.links:
                self.linked += len(" ".join(text.split()))

    def _read(self, source: str) -> None:
        at = 0
        while (m := _TOKEN.search(source, at)) is not None:
            self._text(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag, attrs = tag.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                if tag in _BLOCK:
                    self._flush()
                if tag in _BLOCK or tag in _RAW:
                    self._close({tag}, {"#"} if tag in _WALL else {"table", "article", "body"} - {tag})
                else:
                    self._close({tag}, _BLOCK)
                if tag == "p" and not attrs and not self.open.get("p"):
                    self._flush()
                continue
            if tag in _RAW:
                if not attrs.endswith("/") or tag not in ("svg", "math"):
                    end = None if tag in self.unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                    if end is None:
                        self.unclosed.add(tag)
                    if end is not None:
                        close = source.find(">", end.end())
                        at = len(source) if close < 0 else close + 1
                    elif tag in ("script", "style", "title", "textarea", "iframe", "xmp"):
                        at = len(source)
                continue
            if tag == "br":
                self._text(" ")
            if tag in _BLOCK:
                self._flush()
                if tag not in ("html", "body", "head"):
                    if self.open.get("head"):
                        self._close({"head"}, {"body"})
                    self._close({"p"}, _WALL)
                if tag in _HEADINGS:
                    self._close(_HEADINGS, _WALL)
            if tag == "body":
                self._close({"head"}, {"#"})
            if tag in _CLOSES:
                self._close(_CLOSES[tag], {"table", "ul", "ol", "dl", "menu"})
            if tag not in _VOID:
                inline = tag in ("button", "label") and bool(self.open.get("p")) and not self.open.get("form")
                out = tag in _OUT and not inline or tag == "header" and not self.open.get("article")
                self._push(tag, out, _mark(attrs) if attrs and tag not in _KEEP else CLEAN)
        self._text(source[at:])

    def _bad(self) -> list[bool]:
        """Which elements are in parts that are marked as no article. A mark on what holds an article element is none."""
        n, parent, tag = len(self.tag), self.parent, self.tag
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            holds[parent[i]] |= holds[i] or tag[i] in ("article", "main")

        def spread(least: int) -> list[bool]:
            bad = [False] * n
            for i in range(1, n):
                bad[i] = bad[parent[i]] or self.mark[i] >= least and not holds[i]
            return bad

        bad = spread(MIXED)
        if all(bad[node] or len(text) < PARAGRAPH_CHARS for node, text, _ in self.blocks):
            bad = spread(BAD)  # nothing else to read: good words beside bad ones count
        return bad

    def text(self) -> list[str]:
        n, parent, tag = len(self.tag), self.parent, self.tag
        bad = self._bad()
        blocks = [x for x in self.blocks if not bad[x[0]]]
        size, linked, score = [0] * n, [0] * n, [0.0] * n
        for node, text, links in blocks:
            size[node] += len(text)
            linked[node] += links
            if len(text) >= PARAGRAPH_CHARS and tag[node] not in _HEADINGS:
                points = (1 + text.count(",") + text.count("，") + min(len(text) // 100, 3)) * (1 - links / len(text))
                at, share = (node if tag[node] in ("div", "section", "article", "main", "body", "td") or parent[node] < 0 else parent[node]), 1.0
                for far in range(6):
                    if at < 0:
                        break
                    score[at] += points * share
                    at, share = parent[at], 0.5 if far == 0 else 1 / (3 * (far + 1))
        for i in range(n - 1, 0, -1):
            size[parent[i]] += size[i]
            linked[parent[i]] += linked[i]
        final = [s * (1 - linked[i] / size[i]) if size[i] else 0.0 for i, s in enumerate(score)]
        best = max(range(n), key=lambda i: (final[i], -i))
        if final[best] <= 0:
            whole = [i for i in range(n) if tag[i] in ("article", "main") and size[i]]
            best = max(whole, key=lambda i: (size[i], -i)) if whole else 0
        up = best
        while up > 0 and tag[up] not in ("article", "main"):
            up = parent[up]
        best = up if up > 0 else best
        above, up = set(), best
        while up >= 0:
            above.add(up)
            up = parent[up]
        keep = {best}
        if best > 0 and tag[best] not in _KEEP:
            for i in range(1, n):
                if parent[i] == parent[best] and i != best and not self.out[i] and size[i]:
                    share = linked[i] / size[i]
                    if final[i] >= SIBLING_SHARE * final[best] > 0 or tag[i] == "p" and (size[i] > 80 and share < 0.25 or share == 0 and size[i]) or tag[i] in ("h1", "h2") and i < best:
                        keep.add(i)
        # Where the text begins and ends: lists of links in its middle are its own, those around it are menus.
        inside, menu, doubtful = [False] * n, [False] * n, [False] * n
        inside[0] = 0 in keep
        for i in range(1, n):
            inside[i] = i in keep or inside[parent[i]]
        read = [k for k, (node, text, links) in enumerate(blocks) if inside[node] and len(text) >= PARAGRAPH_CHARS and links <= MENU_SHARE * len(text)]
        first, last = (read[0], read[-1]) if read else (0, -1)
        begin, end = [len(blocks)] * n, [-1] * n
        for k, (node, _, _) in enumerate(blocks):
            begin[node], end[node] = min(begin[node], k), max(end[node], k)
        for i in range(n - 1, 0, -1):
            begin[parent[i]], end[parent[i]] = min(begin[parent[i]], begin[i]), max(end[parent[i]], end[i])
        for i in range(1, n):
            dense = size[i] and linked[i] > MENU_SHARE * size[i]
            around = dense and tag[i] in ("ul", "ol", "dl", "div", "section", "table", "header") and i not in keep and inside[parent[i]] and not (first < begin[i] and end[i] < last)
            menu[i] = menu[parent[i]] or bool(around)
            own = best > 0 and tag[best] not in ("html", "body") and i not in keep and inside[i]
            doubtful[i] = doubtful[parent[i]] or self.mark[i] == DOUBTFUL and i not in above and (dense or not own)
        return [text for node, text, _ in blocks if inside[node] and not menu[node] and not doubtful[node]]


def main_text(source: str | None) -> str:
    """Blocks of a page's main text, in page order, joined by a blank line; empty for a null or empty page."""
    return "\n\n".join(_Page(source).text()) if source else ""


def extract_text(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """`pages` with `out_col`: the main text of each whole page.

    Character references are decoded, white space in a block is one space, blocks are joined by a blank line. Null,
    empty and textless pages give an empty text. Unclosed and misnested tags are read as browsers mostly
    do. Each row gives one row; a column that is named like `out_col` is replaced.
    """

    return with_arrow(pages, lambda batch: [pa.array([main_text(x) for x in batch.column("r0").to_pylist()], pa.string())], [F.coalesce(F.col(html_col).cast("string"), F.lit(""))], f"`{out_col}` string")
