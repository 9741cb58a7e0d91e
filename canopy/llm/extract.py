"""Main text of web pages by composite text density.

**DOM.** A page is read by one pass of a tag pattern: comments, declarations and raw-text
elements are skipped, ``svg`` and ``math`` end where HTML elements start (the text of ``math`` is text of what holds it), void elements hold nothing, a block that starts closes an open paragraph, items close items,
an end tag closes all that was opened inside it.

**Noise.** Elements that hardly ever hold an article (``NOISE_TAGS``) and those whose class, id or role has a
name made of ``NOISE_WORDS`` (and ``PLAIN_WORDS``) only are candidates; a ``header`` inside an article is none, as it holds its title. When
the whole page is read, a candidate is taken out with all it holds if it holds no article or main with text, and not most of the page's characters
outside links, and is not an element of blocks whose end tag is missing. If there is just one innermost article or main, candidates outside it go
whatever their size. The rest is left to the densities.

**Composite text density.** Elements that mark phrases (``PHRASE``) count as text. For every other node, with C characters, T tags, LC characters in links and LT link tags in its
subtree (each at least 1), and LCb, Cb of the body:

    density = C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e))

A node's density sum is the sum of its children's densities. The node with the largest sum is the main content.
The lowest density on the path from it to the body is the threshold: in every other node that reaches
it the largest-sum node is content too, so an article in several parts is found whole.

**Text.** The content's text in page order: character references decoded, white space inside a block one space, blocks joined by
a line feed. An article is never cut.

Defined cases: a null or empty page, and one without any text, gives an empty text; repeated rows and null ids get a row each;
unclosed or stray tags are tolerated; an empty table gives an empty result. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Where markup begins: a comment, another declaration, or a tag with its name.
OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+))")
LATE = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?]))")
#: The rest of a tag: its attributes, whose quoted values may hold a ">".
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
SPECIAL = re.compile("[>\"']")
# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noframes xmp".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul "
            "caption button select head".split())
CLOSES_P = BLOCK - set("li dd dt td th tr tbody thead tfoot option optgroup caption legend summary figcaption button select".split())
#: Content of another kind, the elements in it that hold HTML again, and the HTML elements whose start ends it elsewhere.
FOREIGN = {"svg", "math"}
INTEGRATION = set("foreignobject desc mi mo mn ms mtext annotation-xml".split())
LEAVES_FOREIGN = BLOCK | set("b big br code em embed i img meta nobr ruby s small span strong strike sub sup tt u var".split())
#: Elements that may be left without an end tag.
MAY_END = set("html head body p li dt dd tr td th thead tbody tfoot option optgroup colgroup caption rp rt".split())
#: Elements that mark phrases of a text; they are no nodes of the tree and no tags of a density.
PHRASE = set("abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
             "time tt u var wbr".split())
#: A start tag of the first kind closes an open element of the second kind, up to the third.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
NOISE_TAGS = set("head nav menu footer aside form script style noscript iframe button select textarea input dialog template svg object title".split())
NOISE_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
                  "sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login share sharing social "
                  "related recommended comment comments respond replies disqus widget toolbar pagination pager skip complementary contentinfo "
                  "search form".split())
#: Words that may stand with those in a name without a change of its sense; any other word ("content-sidebar-wrap", "has-sidebar") makes it another name.
PLAIN_WORDS = set("container wrapper wrap holder box block area section list item items inner outer left right top bottom main site page global primary "
                  "secondary slot unit bar panel links icons buttons".split())
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=4096)
def noisy(name: str, more: str) -> bool:
    """Whether an element with attributes ``more`` is one that could be taken out."""
    if name in NOISE_TAGS:
        return True
    if not more or name in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(more):
        if m[1].lower() in ("class", "id", "role") and m[2]:
            for token in m[2].strip("\"'").split():
                words = {w.lower() for w in WORD.findall(token)}
                if words & NOISE_WORDS and words <= NOISE_WORDS | PLAIN_WORDS:
                    return True
    return False


class TagEnds:
    """Ends of tags: behind the first ">" outside quotes or, if the quotes never come out even, behind the very next ">".

    A tag whose quotes are open would be scanned to the end of the page. After the first such tag all ends are looked up in
    a table made from the page's end backwards, so that a page costs one pass however many there are.
    """

    def __init__(self, source: str) -> None:
        self.source, self.at = source, None

    def __call__(self, start: int) -> int:
        if self.at is None:
            m = REST.match(self.source, start)
            if m:
                return m.end()
            self._table()
        found = self.plain[bisect_left(self.at, start)]
        return (found if found >= 0 else self.source.index(">", start)) + 1

    def _table(self) -> None:
        marks = [(m.start(), m[0]) for m in SPECIAL.finditer(self.source)]
        self.at = [p for p, _ in marks]
        plain, double, single = -1, -1, -1  # where a tag ends that is outside quotes, or within either kind, from here on
        self.plain = [-1] * (len(marks) + 1)
        for i in range(len(marks) - 1, -1, -1):
            p, c = marks[i]
            if c == ">":
                plain = p
            elif c == '"':
                plain, double = double, plain
            else:
                plain, single = single, plain
            self.plain[i] = plain


class Page:
    """The elements of a page without its noise, as parallel lists in document order."""

    def __init__(self, source: str) -> None:
        self.name, self.parent, self.chars, self.tags, self.link_chars, self.link_tags = ["#"], [-1], [0], [0], [0], [0]
        self.noise, self.phrase, self.closed = [False], [False], [True]  # could be taken out; marks a phrase; ended where it should
        self.texts: list[tuple[int, int, str]] = []  # (element, block, text)
        self.stack, self.links, self.foreign = [(0, "#", False)], 0, 0  # (element, name, own element); open links, open svg and math
        self.depths: dict[str, list[int]] = {}  # where in the stack elements of a name are open
        self._read(source)
        self._take_noise_out()

    def _read(self, source: str) -> None:
        stack, block, at, end = self.stack, 0, 0, len(source)
        last = source.rfind(">")
        tag_end = TagEnds(source)
        while at < end:
            # behind the last ">" no tag ends any more, and what looks like one is text
            m = OPEN.search(source, at)
            if m and m["name"] and m.start() > last:
                m = LATE.search(source, m.start())
            stop = m.start() if m else end
            if stop > at:
                self._text(stack[-1][0], block, source[at:stop])
            if not m:
                break
            if m["comment"] or m["other"]:
                mark = "-->" if m["comment"] else ">"
                found = source.find(mark, m.end())
                at = end if found < 0 else found + len(mark)
                continue
            name = m["name"].lower()
            at = tag_end(m.end())
            more = source[m.end():at - 1]
            block += name in BLOCK
            if m["end"]:
                if depth := self._open({name}):
                    self._close(depth, stack[depth][1] == name)
                continue
            if self.foreign and name in LEAVES_FOREIGN:
                # html inside an integration point stays there; elsewhere it ends svg and math
                while (depth := self._open(FOREIGN | INTEGRATION)) and stack[depth][1] in FOREIGN:
                    self._close(depth, True)
            if name in CLOSES_P:
                depth = self._open({"p", "td", "th", "li", "button", "table"})
                if depth and stack[depth][1] == "p":
                    self._close(depth, True)
            if name == "body" and (depth := self._open({"head"})):
                self._close(depth, True)
            if name in SIBLINGS:
                closes, until = SIBLINGS[name]
                depth = self._open(closes | until)
                if depth and stack[depth][1] in closes:
                    self._close(depth, True)
            alone = name in VOID or self.foreign > 0 and more.endswith("/")
            if name in RAW and not more.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if name == "br":
                self.texts.append((stack[-1][0], block, " "))
            noise = noisy(name, more) or name == "header" and not self._open({"article", "main"})
            phrase = name in PHRASE or name == "math" or self.foreign > 0 and self._open({"math"}) > 0 and name not in BLOCK
            if phrase and not noise:
                if not alone:
                    self._push(stack[-1][0], name, False)
                    self.foreign += name in FOREIGN
                continue
            node = len(self.name)
            for values, v in ((self.name, name), (self.parent, stack[-1][0]), (self.chars, 0), (self.tags, 0), (self.link_chars, 0), (self.link_tags, 0),
                              (self.noise, noise), (self.phrase, phrase), (self.closed, alone or name in MAY_END)):
                values.append(v)
            if not alone:
                self._push(node, name, True)
                self.links += name == "a"
                self.foreign += name in FOREIGN

    def _push(self, node: int, name: str, own: bool) -> None:
        self.depths.setdefault(name, []).append(len(self.stack))
        self.stack.append((node, name, own))

    def _open(self, names: set[str]) -> int:
        """Depth of the innermost open element with one of these names, 0 if there is none."""
        return max((own[-1] for own in map(self.depths.get, names) if own), default=0)

    def _close(self, depth: int, own: bool) -> None:
        node, _, itself = self.stack[depth]
        if own and itself:
            self.closed[node] = True
        for _, name, _ in self.stack[depth:]:
            self.links -= name == "a"
            self.foreign -= name in FOREIGN
            self.depths[name].pop()
        del self.stack[depth:]

    def _text(self, node: int, block: int, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.texts.append((node, block, text))
        n = len(text.strip())
        self.chars[node] += n
        self.link_chars[node] += n if self.links else 0

    def _take_noise_out(self) -> None:
        """Leave only the elements that count: not the noise, and phrases as a part of what holds them."""
        if not any(self.noise):
            return
        n, name, parent = len(self.name), self.name, self.parent
        plain = [c - lc for c, lc in zip(self.chars, self.link_chars)]  # characters outside links in each subtree
        single, blocks = [0] * n, [False] * n  # innermost article and main elements with text; whether a block is inside
        innermost = [False] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            if name[i] in ("article", "main") and plain[i] and not single[i]:
                single[i], innermost[i] = 1, True
            plain[p] += plain[i]
            single[p] += single[i]
            blocks[p] |= blocks[i] or name[i] in BLOCK
        out, within, at = [False] * n, [False] * n, [0] * n
        kept = [0]
        for i in range(1, n):
            p = parent[i]
            within[i] = within[p] or innermost[i]
            out[i] = out[p] or self.noise[i] and not single[i] and (
                single[0] == 1 and not within[p] or 2 * plain[i] <= plain[0] and (self.closed[i] or not blocks[i]))
            if out[i] or self.phrase[i]:
                at[i] = at[p]
            else:
                at[i] = len(kept)
                kept.append(i)
        self.texts = [(at[i], block, text) for i, block, text in self.texts if not out[i]]
        chars, link_chars = [0] * len(kept), [0] * len(kept)
        for i in range(n):
            if not out[i]:
                chars[at[i]] += self.chars[i]
                link_chars[at[i]] += self.link_chars[i]
        self.parent = [-1, *(at[parent[i]] for i in kept[1:])]
        self.name, self.chars, self.link_chars = [name[i] for i in kept], chars, link_chars
        self.tags, self.link_tags = [0] * len(kept), [0] * len(kept)


def density(c: int, t: int, lc: int, lt: int, body_c: int, body_lc: int) -> float:
    """Composite text density of a subtree."""
    if not c:
        return 0.0
    t, plain, lc1, lt1 = max(t, 1), max(c - lc, 1), max(lc, 1), max(lt, 1)
    base = math.log(math.log(c / plain * lc + body_lc / max(body_c, 1) * c + math.e))
    # with no link at all the base of the logarithm is e^0, and its limit is not finite: take the text's plain ratio then
    return c / t * math.log(max(c / lc1 * t / lt1, 1.0)) / max(base, 1e-3) if base > 1e-3 else c / t * math.log(max(c / lc1 * t / lt1, math.e))


def content_nodes(page: Page) -> set[int]:
    """The elements whose subtrees are the main content."""
    n = len(page.name)
    c, t, lc, lt = page.chars, page.tags, page.link_chars, page.link_tags
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        c[p] += c[i]
        lc[p] += lc[i]
        t[p] += t[i] + 1
        lt[p] += lt[i] + (page.name[i] == "a")
    body = next((i for i in range(n) if page.name[i] == "body"), 0)
    if not c[0]:
        return set()
    d = [density(c[i], t[i], lc[i], lt[i], c[body], lc[body]) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        sums[page.parent[i]] += d[i]
    best = list(range(n))  # the element of the largest density sum in each subtree, the first of equals
    for i in range(n - 1, 0, -1):
        p, b = page.parent[i], best[i]
        if sums[b] > sums[best[p]] or sums[b] == sums[best[p]] and best[p] != p:
            best[p] = b
    low, i = d[best[0]], best[0]
    while i > 0:
        i = page.parent[i]
        low = min(low, d[i])
    return {best[i] for i in range(n) if c[i] and d[i] >= low}


def main_text(source: str | None) -> str:
    """The main text of one whole page."""
    page = Page(source or "")
    chosen = content_nodes(page)
    inside = [False] * len(page.name)
    for i in range(len(page.name)):
        inside[i] = i in chosen or i > 0 and inside[page.parent[i]]
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.texts:
        if inside[node]:
            blocks.setdefault(block, []).append(text)
    return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks.values()) if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text``, ``n_chars`` (code points)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=[id_col, url_col, "text", "n_chars"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars long")
