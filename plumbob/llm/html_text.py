"""The main text of web pages by composite text density.

Every node of a page's tree has a density: its characters per tag, lowered where
they are links; marks of words, such as ``b``, are no tags in this count. The
subtree whose children's densities have the largest sum is the main content; the
smallest density on the way from it to the body is the threshold that the blocks
beside that way must reach to belong to it (Sun, Song and Liao, 2011), and they
must hold as much as the subtree's usual child. What markup names as no part of
an article is left out first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbob.functions.columns import ref
from plumbob.llm.common import as_long, text_blocks

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset(
    "abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag ends open elements of these kinds.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"},
}
#: Within these an open element outside is not ended by a start tag.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

#: Elements that are no part of an article, and words that say so in a class, id or role.
ASIDE = frozenset("head script style noscript template nav footer aside form button select iframe svg canvas object dialog menu title textarea".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices "
    "alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar "
    "footer colophon copyright sidebar sidebars aside widget related recommended share sharing social comment comments reply replies disqus "
    "respond contentinfo complementary search pagination pager".split()
)
KEPT = frozenset(("html", "body", "article", "main"))
#: Headings that belong to an article beside which they stand.
TITLES = frozenset(("h1",))
#: The word after one of these says what a layout lacks or has beside the article, not what the element is.
LAYOUT = frozenset("no not non without with has have hide hides hidden show shows".split())
#: Words that also name layouts. What the others name may be longer than an article beside it.
PARTS = frozenset("nav navbar navigation menu menus header masthead topbar footer sidebar sidebars aside search pagination pager".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


def _words(named: str) -> frozenset[str]:
    """The words of names, less those that only follow a word of :data:`LAYOUT` within a name."""
    words = set()
    for name in named.split():
        parts = [w.lower() for w in SPLIT.split(name) if w]
        words.update(w for before, w in zip(["", *parts], parts) if before not in LAYOUT)
    return frozenset(words)


class Tree:
    """Nodes in page order: kind, parent, named words, and per node its texts and children in order."""

    def __init__(self, html: str):
        self.kind, self.parent, self.words = ["#root"], [-1], [frozenset()]
        self.content: list[list] = [[]]  # a text, or the number of a child
        self._read(html)

    def _open(self, kind: str, parent: int, attributes: str) -> int:
        node = len(self.kind)
        named = " ".join(a or b or c for _, a, b, c in NAMED.findall(attributes)) if attributes else ""
        self.kind.append(kind)
        self.parent.append(parent)
        self.words.append(_words(named) if named else frozenset())
        self.content.append([])
        self.content[parent].append(node)
        return node

    def _read(self, html: str) -> None:
        stack, opened, place, n, tag = [0], {}, 0, len(html), TAG
        last, endless = html.rfind(">"), set()

        def close() -> None:
            opened[self.kind[stack.pop()]] -= 1

        def close_within(kinds: set, scope: set) -> None:
            """End open elements of these kinds, up to one of the scope."""
            i = len(stack) - 1
            while i > 0 and any(opened.get(k) for k in kinds):
                kind = self.kind[stack[i]]
                if kind in scope:
                    return
                if kind in kinds:
                    while len(stack) > i:
                        close()
                i -= 1

        def say(text: str) -> None:
            if text:
                self.content[stack[-1]].append(unescape(text) if "&" in text else text)

        while place < n:
            at = html.find("<", place)
            if at < 0 or at > last and not html.startswith("<!", at):
                say(html[place:])  # no tag ends here
                return
            say(html[place:at])
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                place = n if end < 0 else end + 3
                continue
            if html[at + 1 : at + 2] in ("!", "?"):
                end = html.find(">", at)
                place = n if end < 0 else end + 1
                continue
            found = tag.match(html, at)
            if not found and tag is TAG and (found := PLAIN_TAG.match(html, at)):
                tag = PLAIN_TAG  # a quote without its end: from here on tags end at the next bracket
            if not found:
                say("<")
                place = at + 1
                continue
            place, kind = found.end(), found[2].lower()
            if found[1]:
                if opened.get(kind):
                    while self.kind[stack[-1]] != kind:
                        close()
                    close()
                continue
            if kind in ENDS and any(opened.get(k) for k in ENDS[kind]):
                close_within(ENDS[kind], SCOPE.get(kind, set()))
            if kind in BLOCK and opened.get("p"):
                close_within({"p"}, {"table", "td", "th", "button"})
            node = self._open(kind, stack[-1], found[3])
            if kind in VOID or found[3].endswith("/") and kind not in BLOCK:
                continue
            if kind in RAW:
                end = None if kind in endless else re.compile(f"</{re.escape(kind)}", re.I).search(html, place)
                if end:
                    place = html.find(">", end.start())
                    place = n if place < 0 else place + 1
                elif kind in ("script", "style"):
                    place = n
                else:
                    endless.add(kind)
                continue
            stack.append(node)
            opened[kind] = opened.get(kind, 0) + 1


def _wrappers(tree: Tree, own: list[int]) -> list[bool]:
    """Whether each node holds the page's main element, its longest article, or most of its characters outside links.

    Beside an article or main element, most of the characters count for names of layouts only.
    """
    n = len(tree.kind)
    aside, plain = [False] * n, [0] * n
    for i in range(1, n):
        aside[i] = aside[tree.parent[i]] or tree.kind[i] in ASIDE
    for i in range(n - 1, 0, -1):
        if not aside[i] and tree.kind[i] != "a":
            plain[i] += own[i]
            plain[tree.parent[i]] += plain[i]
    plain[0] += own[0]
    articles = [i for i in range(n) if tree.kind[i] == "article" and not aside[i]]
    held = [i for i in range(n) if tree.kind[i] == "main" and not aside[i]]
    if articles:
        held.append(max(articles, key=lambda i: (plain[i], -i)))
    holds = [False] * n
    for i in held:
        while i > 0 and not holds[i]:
            holds[i], i = True, tree.parent[i]
    within, wraps = [False] * n, [False] * n
    for i in range(1, n):
        within[i] = within[tree.parent[i]] or tree.kind[i] in ("article", "main")
        alone = not held or within[i] or tree.words[i] & WORDS <= PARTS
        wraps[i] = holds[i] or 2 * plain[i] > plain[0] and alone
    return wraps


def _left_out(tree: Tree, own: list[int]) -> list[bool]:
    """Whether each node is no part of an article, by itself or by what it lies in."""
    out, within, wraps = [False], [False], None
    for i in range(1, len(tree.kind)):
        kind, parent = tree.kind[i], tree.parent[i]
        article = within[parent] or kind in ("article", "main")
        header = kind == "header" and not within[parent]
        named = kind not in KEPT and not tree.words[i].isdisjoint(WORDS if not within[parent] else WORDS - {"header"})
        if named and not out[parent]:
            wraps = wraps or _wrappers(tree, own)
            named = not wraps[i]
        out.append(out[parent] or kind in ASIDE or header or named)
        within.append(article)
    return out


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: int, body_chars: int) -> float:
    """Characters per tag, lowered by the share of links; zero denominators count as one."""
    if not chars:
        return 0.0
    per_tag = chars / max(1, tags)
    inner = chars / max(1, chars - link_chars) * max(1, link_chars) + body_links / max(1, body_chars) * chars + math.e
    ratio = chars / max(1, link_chars) * (max(1, tags) / max(1, link_tags))
    return per_tag * math.log(max(ratio, 1.0)) / math.log(math.log(inner))


def main_text(html: str, titles: frozenset[str] = TITLES) -> str:
    """The blocks of a page's main content, joined by empty lines; empty if there is none.

    The subtree of the largest density sum is chosen, with the article or main
    element that holds it. A block beside the way from there to the body belongs
    to it if its density reaches the least on that way, and its own density, or a
    density sum within it, the mean density of the chosen subtree's children, by their characters.
    Elements of the kinds in ``titles`` on that way are short by nature and stay.
    """
    tree = Tree(html)
    n = len(tree.kind)
    own = [sum(len("".join(c.split())) for c in content if isinstance(c, str)) for content in tree.content]
    out = _left_out(tree, own)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    inline = [k in INLINE for k in tree.kind]  # marks of words, which say nothing of blocks
    for i in range(n - 1, -1, -1):  # children follow their parents
        if out[i]:
            continue
        if i and not inline[i] and tree.kind[i] != "a":
            inline[tree.parent[i]] = False
        chars[i] += own[i]
        if tree.kind[i] == "a":
            link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
        if i:
            p = tree.parent[i]
            chars[p] += chars[i]
            tags[p] += tags[i] + (not inline[i])
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i]
    body = next((i for i in range(n) if tree.kind[i] == "body"), 0)
    if not chars[body]:
        body = 0
    if not chars[body]:
        return ""
    of = [density(chars[i], tags[i], link_chars[i], link_tags[i], link_chars[body], chars[body]) for i in range(n)]
    sums, below = [0.0] * n, [False] * n
    for i in range(n):
        below[i] = i == body or (i > 0 and below[tree.parent[i]])
        if i and not out[i] and not inline[i]:
            sums[tree.parent[i]] += of[i]
    best = max((i for i in range(n) if below[i] and not out[i] and not inline[i] and chars[i]), key=lambda i: (sums[i], of[i], -i))
    path, node = [], best
    while node != body:
        path.append(node)
        node = tree.parent[node]
    path.append(body)
    threshold = min(of[i] for i in path)
    # Nothing of an article is lost to a part of it, if the article is no thinner than the page.
    top = next((i for i in reversed(path) if tree.kind[i] in ("article", "main") and of[i] >= of[body]), best)
    # A footer's line is as dense as a line of the article, but there is no more of it.
    parts = [i for i in range(1, n) if tree.parent[i] == best and chars[i] and not out[i]]
    usual = sum(of[i] * chars[i] for i in parts) / max(1, sum(chars[i] for i in parts))
    most = [max(s, d) for s, d in zip(sums, of)]
    for i in range(n - 1, 0, -1):
        if not out[i]:
            most[tree.parent[i]] = max(most[tree.parent[i]], most[i])
    chosen = [False] * n
    way = set(path[path.index(top) :])
    for i in range(1, n):
        p = tree.parent[i]
        part = of[i] >= threshold and most[i] >= usual
        beside = i not in way and (part or tree.kind[i] in titles and p in way and p != top)
        chosen[i] = not out[i] and below[i] and (chosen[p] or i == top or beside)
    chosen[0] = top == 0
    if top == body or body == 0 and top == 0:
        chosen = [not o for o in out]
    return "\n\n".join(_blocks(tree, chosen, out))


def _blocks(tree: Tree, chosen: list[bool], out: list[bool]) -> Iterator[str]:
    held: list[str] = []
    todo: list[tuple[int, int]] = [(0, 0)]

    def flush() -> str:
        text = " ".join("".join(held).split())
        held.clear()
        return text

    while todo:
        node, k = todo.pop()
        if k == 0 and tree.kind[node] in BLOCK and (text := flush()):
            yield text
        content = tree.content[node]
        while k < len(content) and isinstance(content[k], str):
            if chosen[node]:
                held.append(content[k])
            k += 1
        if k < len(content):
            todo.append((node, k + 1))
            child = content[k]
            if tree.kind[child] == "br":
                held.append(" ")
            if not out[child]:
                todo.append((child, 0))
            elif tree.kind[child] in BLOCK and (text := flush()):
                yield text
        elif tree.kind[node] in BLOCK and (text := flush()):
            yield text
    if text := flush():
        yield text


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, block in text_blocks(batches, "html"):
        found = [main_text(h) for h in block]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null or empty page, or one without text, gives an empty text. Every row is
    read for itself and as a whole, so repeated rows and null ids stay; a task
    holds one page at a time. White space within a block is one blank.
    """
    slim = pages.select(as_long(id_column).alias("page_id"), ref(url_column).cast("string").alias("url"), ref(html_column).cast("string").alias("html"))
    return slim.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
