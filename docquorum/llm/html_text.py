"""Main text of web pages by scoring the tree of the page.

1. *Tree.* Markup is cut into tags and text in one pass. Only tags that make blocks become nodes; end tags that HTML
   leaves out are added (a block ends an open paragraph, an item the item before it). Tags inside a line only count
   what is linked.
2. *Leaving out.* Scripts, styles, menus, sidebars, footers, forms and the like are known by their tag, role or state;
   adverts, notices, comments and further menus by the words of their class and id.
3. *Scores.* Every block of text earns points for its length and its commas, less its share of linked text. The points
   go to the node that holds it (lists and rows pass them on whole), half of them to the one above, and a falling share
   to those further up. Article and main elements and nodes named like content have a start; a node loses the share of
   its text that is linked.
4. *Choice.* The best node is the container, or the article it stands in. Siblings of the container that are like it,
   or score a fifth as much, are kept, as are headings before it and paragraphs beside it without links. Lists of links
   within go.

Scoring a page takes time in proportion to its length. Pages are independent, so Spark deals them out as rows.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements of the HTML standard by the part they play here. All others stand inside a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search "
    "section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
NEVER = frozenset(
    "applet aside audio button canvas datalist dialog fieldset footer frameset head label legend map menu meter nav "
    "noscript object optgroup option output progress search select svg template video".split())
ENDED_BY_SAME = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot"),
}
BOUNDS = frozenset("dir dl menu ol table ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
HOLDS_LINES = HEADINGS | frozenset("dd dt figcaption li p pre td th".split())
PARTS = HEADINGS | frozenset("blockquote dl dir figure ol p tbody tfoot thead tr ul".split())
BARRED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
# Words of class and id that name what is not the article, and words that name the article.
APART = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising sponsor sponsored sponsors "
    "promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal "
    "toast nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager sidebar sidebars sidenav rail "
    "masthead topbar footer footers foot colophon copyright comment comments commentlist disqus respond reply replies "
    "share sharing sharebar social subscribe subscription newsletter signup login signin search searchbox form related "
    "recommended recommendations outbrain taboola toolbar".split())
CONTENT = frozenset("article articlebody blog body content entry main page post prose story text".split())
OF_ANOTHER = frozenset("category format has is no status tag tags type with without".split())
# Headings above the words of readers and above further articles.
OTHERS = re.compile(
    r"\A(\d+ )?(comments?|reader comments|replies|responses|leave a (comment|reply)|kommentare?|commentaires?|"
    r"comentarios?|related (articles|posts|stories)|you (may|might) also like)( \(\d+\))?:?\Z", re.I)

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
COMMAS = re.compile("[,،、，;]")
LEFT_OUT = ("display:none", "visibility:hidden")


class Node:
    __slots__ = ("tag", "above", "named", "left_out", "by_name", "score", "length", "linked", "links", "in_article")

    def __init__(self, tag: str, above: int, named: str = ""):
        self.tag, self.above, self.named = tag, above, named
        self.left_out = self.by_name = self.in_article = False
        self.score = 0.0
        self.length = self.linked = self.links = 0


@functools.lru_cache(10_000)
def name_words(named: str) -> frozenset[str]:
    """The words of the names in a class and id, each up to a word that says the name is about something else."""
    found: set[str] = set()
    for name in named.split():
        words = [w.lower() for w in NAME_PART.findall(name)]
        found.update(words[:next((i for i, w in enumerate(words) if w in OF_ANOTHER), len(words))])
    return frozenset(found)


def is_apart(named: str) -> bool:
    return not APART.isdisjoint(name_words(named))


class Page:
    """Nodes in the order they open, each with the number of the one above, and blocks of text with their node."""

    def __init__(self, html: str):
        self.nodes = [Node("#page", -1)]
        self.blocks: list[tuple[int, str, int]] = []
        self._open = [0]
        self._count: dict[str, int] = {}
        self._inline: list[tuple[str, int]] = []  # elements inside a line that are left out, with the depth they opened at
        self._text: list[str] = []
        self._linked = self._in_link = 0
        self._read(html)
        self._block()
        self._add_up()

    # -- reading ----------------------------------------------------------------------------

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            less = html.find("<", at)
            if less < 0:
                self._say(html[at:])
                return
            if less > at:
                self._say(html[at:less])
            tag = TAG.match(html, less)
            if tag:
                at = self._tag(html, tag)
            elif html.startswith("<!--", less):
                close = html.find("-->", less + 2)
                at = end if close < 0 else close + 3
            elif html.startswith(("<!", "<?", "</"), less):
                close = html.find(">", less)
                at = end if close < 0 else close + 1
            else:
                self._say("<")
                at = less + 1

    def _tag(self, html: str, tag: re.Match) -> int:
        """Handle the tag that begins here; the position behind it. A tag that never ends ends the page."""
        at = html.find(">", tag.end())
        quoted = html[tag.end():at] if at >= 0 else ""
        if '"' in quoted or "'" in quoted:
            found = self._end_of_tag(html, tag.end())
            at = at if found < 0 else found
        if at < 0:
            return len(html)
        name = tag.group(2).lower()
        if tag.group(1):
            self._ends(name)
            return at + 1
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at + 1)
            return len(html) if close is None else close.start()
        inside = html[tag.end():at]
        self._begins(name, inside, inside.endswith("/"))
        return at + 1

    @staticmethod
    def _end_of_tag(html: str, at: int) -> int:
        """Position of the first ``>`` outside quoted values, or -1."""
        while True:
            more = html.find(">", at)
            if more < 0:
                return -1
            single, double = html.find("'", at, more), html.find('"', at, more)
            first = min((q for q in (single, double) if q >= 0), default=-1)
            if first < 0:
                return more
            close = html.find(html[first], first + 1)
            if close < 0:
                return -1
            at = close + 1

    # -- building ---------------------------------------------------------------------------

    def _say(self, text: str) -> None:
        if self._inline:
            return
        if self._count.get("head") and not text.isspace():
            self._close("head")
        if "&" in text:
            text = entities.unescape(text)
        self._text.append(text)
        if self._in_link:
            self._linked += len(text.strip())

    def _block(self) -> None:
        """End the block that the text so far makes."""
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._open[-1], text, min(self._linked, len(text))))
            self._text = []
        self._linked = 0

    def _begins(self, tag: str, inside: str, closed: bool) -> None:
        given = self._attributes(inside) if inside and not inside.isspace() else {}
        named = f"{given.get('class', '')} {given.get('id', '')}".strip()
        left_out = self._barred(tag, given)
        if tag not in BLOCKS:
            self._within_line(tag, left_out or named != "" and tag != "a" and is_apart(named), closed)
            return
        self._block()
        if tag != "head" and self._count.get("head"):
            self._close("head")
        if tag in ("html", "head", "body") and self._count.get(tag):  # a second one says nothing new
            return
        if self._count.get("p"):
            self._close("p")
        if tag in ENDED_BY_SAME:
            self._close_same(tag)
        elif tag in HEADINGS and self.nodes[self._open[-1]].tag in HEADINGS:
            self._close(self.nodes[self._open[-1]].tag)
        node = Node(tag, self._open[-1], named)
        above = self.nodes[node.above]
        node.in_article = above.in_article or tag in ("article", "main")
        node.left_out = left_out
        if tag not in ("html", "body", "main"):
            is_header = tag == "header" or "header" in name_words(named)
            node.left_out |= is_header and not node.in_article and tag not in HEADINGS
            node.by_name = named != "" and tag not in HEADINGS and is_apart(named)
        self.nodes.append(node)
        if tag not in VOID:
            self._open.append(len(self.nodes) - 1)
            self._count[tag] = self._count.get(tag, 0) + 1

    def _within_line(self, tag: str, left_out: bool, closed: bool) -> None:
        if tag == "br":
            self._text.append(" ")
        elif tag == "a" and not left_out:
            self._in_link = len(self._open)
            self.nodes[self._open[-1]].links += 1
        elif tag not in VOID and not closed and (left_out or self._inline and self._inline[-1][0] == tag):
            self._inline.append((tag, len(self._open)))

    def _ends(self, tag: str) -> None:
        if tag not in BLOCKS:
            if self._inline and self._inline[-1][0] == tag:
                self._inline.pop()
            elif tag == "a":
                self._in_link = 0
            return
        self._block()
        if self._count.get(tag) and tag not in ("html", "body"):
            self._close(tag)

    def _close(self, tag: str) -> None:
        """Close the open nodes up to the last one of this tag, of which there is one."""
        while True:
            closed = self.nodes[self._open.pop()].tag
            self._count[closed] -= 1
            if closed == tag:
                break
        while self._inline and self._inline[-1][1] > len(self._open):
            self._inline.pop()
        if self._in_link > len(self._open):
            self._in_link = 0

    def _close_same(self, tag: str) -> None:
        """End the item, cell or row that an open one of its kind in the same list or table leaves open."""
        alike = ENDED_BY_SAME[tag]
        if not any(self._count.get(t) for t in alike):
            return
        for number in reversed(self._open):
            name = self.nodes[number].tag
            if name in alike:
                self._close(name)
                return
            if name in BOUNDS or name == "tr" and tag in ("td", "th"):
                return

    @staticmethod
    def _attributes(inside: str) -> dict[str, str]:
        found: dict[str, str] = {}
        for name, value in ATTRIBUTE.findall(inside):
            found.setdefault(name.lower(), entities.unescape(value.strip("\"'")) if value else "")
        return found

    @staticmethod
    def _barred(tag: str, given: dict[str, str]) -> bool:
        if tag in NEVER:
            return True
        if not given or tag in ("html", "body"):
            return False
        return (
            "hidden" in given or given.get("aria-hidden", "").lower() == "true"
            or given.get("role", "").lower() in BARRED_ROLES
            or any(s in given.get("style", "").lower().replace(" ", "") for s in LEFT_OUT))

    # -- choosing ---------------------------------------------------------------------------

    def _add_up(self) -> None:
        """What is left out, and the text and links of what stays, from each node to those above it."""
        nodes = self.nodes
        self._forms()
        seen = set()
        for number, text, _ in self.blocks:
            at = nodes[number]
            if at.above not in seen and at.tag in HEADINGS and OTHERS.match(text):
                nodes[at.above].by_name |= nodes[at.above].tag in ("div", "section")
            seen.add(at.above)
        out, named = [node.left_out for node in nodes], [node.by_name for node in nodes]
        for n in range(1, len(nodes)):
            out[n] |= out[nodes[n].above]
            named[n] |= named[nodes[n].above]
        # Names may mislead: where they leave nothing, and no element says where the article is, they do not count.
        says = any(node.tag in ("article", "main") for node in nodes)
        if says or any(not out[n] and not named[n] for n, _, _ in self.blocks):
            out = [a or b for a, b in zip(out, named)]
        self.out = out
        for number, text, linked in self.blocks:
            if not out[number]:
                nodes[number].length += len(text)
                nodes[number].linked += linked
        for n in range(len(nodes) - 1, 0, -1):
            if not out[n]:
                above = nodes[nodes[n].above]
                above.length += nodes[n].length
                above.linked += nodes[n].linked
                above.links += nodes[n].links

    def _forms(self) -> None:
        """A form goes, unless it holds most of the page's text outside what goes anyway."""
        nodes = self.nodes
        if not any(node.tag == "form" for node in nodes):
            return
        total, held, inner = 0, [0] * len(nodes), [False] * len(nodes)
        for n, node in enumerate(nodes):
            inner[n] = node.left_out or node.by_name or n > 0 and inner[node.above]
        for number, text, _ in self.blocks:
            if not inner[number]:
                held[number] += len(text)
                total += len(text)
        for n in range(len(nodes) - 1, 0, -1):
            held[nodes[n].above] += held[n]
        for n, node in enumerate(nodes):
            if node.tag == "form" and 2 * held[n] <= total:
                node.left_out = True

    def _score(self) -> None:
        nodes = self.nodes
        for n, node in enumerate(nodes):
            if self.out[n]:
                continue
            if node.tag in ("article", "main"):
                node.score += 25
            elif node.tag not in ("html", "body", "#page") and not CONTENT.isdisjoint(name_words(node.named)):
                node.score += 15
        for number, text, linked in self.blocks:
            if self.out[number]:
                continue
            points = (1 + len(COMMAS.findall(text)) + len(text) / 100) * (1 - linked / len(text))
            at = nodes[number]
            if at.tag in HOLDS_LINES:
                at = nodes[at.above]
            while at.tag in PARTS:
                at = nodes[at.above]
            for level in range(6):
                at.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                if at.above < 0:
                    break
                at = nodes[at.above]
        for node in nodes:
            if node.length and node.score > 0:
                node.score *= 1 - node.linked / node.length

    def text(self) -> str:
        """The blocks of the container and its kept siblings in page order, one a line."""
        nodes, out = self.nodes, self.out
        if not any(not out[number] for number, _, _ in self.blocks):
            return ""
        self._score()
        best = max((n for n in range(len(nodes)) if not out[n] and nodes[n].tag not in PARTS),
                   key=lambda n: (nodes[n].score, -n))
        if not nodes[best].length:
            return ""
        for whole in ("article", "main"):
            at = best
            while at > 0 and nodes[at].tag != whole:
                at = nodes[at].above
            if at > 0:
                best = at
                break
        kept = {best}
        top = nodes[best]
        if top.above >= 0:
            for n, node in enumerate(nodes):
                if n != best and node.above == top.above and not out[n] and node.length and self._belongs(n, best):
                    kept.add(n)
        inside = [False] * len(nodes)
        for n, node in enumerate(nodes):
            inside[n] = not out[n] and (n in kept or n > 0 and inside[node.above] and not self._menu(node))
        return "\n".join(text for number, text, _ in self.blocks if inside[number])

    def _belongs(self, n: int, best: int) -> bool:
        node, top = self.nodes[n], self.nodes[best]
        free = 1 - node.linked / node.length
        if node.tag in HEADINGS:
            return n < best and free > 0.5
        if node.tag == "p":
            return top.tag not in ("article", "main") and (free == 1 or node.length > 80 and free > 0.75)
        if self._menu(node):
            return False
        if node.tag == top.tag and (node.named == top.named != "" or top.tag == "article"):
            return True
        if top.tag in ("article", "main"):
            return False
        return node.score >= max(2.0, 0.2 * top.score) and free > 0.5

    @staticmethod
    def _menu(node: Node) -> bool:
        """A list or box of links and hardly anything else."""
        return node.tag not in ("article", "main", "body", "html", "p") and node.links >= 3 and (
            2 * node.linked > node.length)


def main_text(html: str | None) -> str:
    """The article of a page; empty for null and for pages without text."""
    return Page(html).text() if html else ""


@F.pandas_udf(StringType())
def _main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(main_text)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All rows and columns, and ``main_text``; a column of the input with that name is replaced.

    A null or empty page gives an empty text. Text without markup is an article of its own, line breaks being blanks.
    Pages of any length are read whole; markup that breaks off keeps what came before. Repeated rows get the same
    text; an empty table gives an empty result.
    """
    return pages.withColumn("main_text", _main_text(F.col(html)))
