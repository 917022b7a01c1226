"""Main text of web pages by tree scoring.

A page is read once into a tree (implied end tags, void and raw-text elements as browsers have them; end tags that
match nothing are ignored; what is open at the end is closed) and into blocks: runs of text that no block
element interrupts.  Parts that are never the article go: by element (menus, forms, scripts, asides, footers ...), by
role, by being hidden, and by the words of class and id (adverts, notices, sidebars, reader comments ...).
Each paragraph that is left gives points for itself, its commas and its length to its parent, half as many to the
next ancestor and fewer further up; a container's points are discounted by the share of its text that stands in links.
The best container wins, or the article element that it lies in.  Siblings stay if their score is near the
best, if they look like it, or if they are plain paragraphs beside it.  Lists of links inside go; nothing else does.

Character references are decoded, white space (as Unicode has it) in a block becomes one space, blocks are joined by a newline
in page order.  One ``br`` is white space, two in a row end the block.  Null and empty pages, and
pages without text outside the dropped parts, have the text ''.  A page without any paragraph gives the text
of its article element, else of its body.  Ties go to the first container of the page.  Repeated rows are read alike.  Pages are
read one by one in Arrow batches: memory is a few times the longest page, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# --- fixed values --------------------------------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element, and the elements beyond which they do not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: End tags and paragraphs' implied ends do not reach beyond these.
SCOPE = set("html table caption td th button object template".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = set("p pre td th blockquote li dd dt figcaption summary address".split())
LISTS = set("ul ol dl div section table menu".split())
MAIN = {"article", "main"}
#: Elements whose text is never the article's.
DROPPED = set(
    "head title script style noscript template iframe noembed noframes object applet svg canvas audio video "
    "button select option datalist textarea nav aside footer menu dialog search".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class names and ids: reader comments, and page furniture.
COMMENT_WORDS = set("comment comments commentlist commentarea commentsection disqus respond reply replies discussion responses".split())
LAYOUT_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox banner banners sponsor sponsored sponsors promo promos "
    "promotion promotions promoted sidebar sidebars sidenav aside rail nav navbar navigation menu menus menubar submenu footer foot "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications alert alerts disclaimer popup popups modal overlay "
    "newsletter subscribe subscription signup signin login share sharing social related recommended recommendations teaser teasers "
    "breadcrumb breadcrumbs pagination pager widget widgets skip search copyright hidden".split())
HEADER_WORDS = {"header", "masthead", "banner"}
#: A word after one of these says what the page has, not what the element is.
WITH_WORDS = {"has", "with", "no", "without", "is"}
FIRST_POINTS = {**dict.fromkeys(MAIN, 25.0), "div": 5.0, "section": 5.0, **dict.fromkeys(("pre", "td", "blockquote"), 3.0),
                **dict.fromkeys(("address", "ol", "ul", "dl", "dd", "dt", "li", "form"), -3.0)}
GOOD_WORDS = set("article body content entry main page post story text blog".split())
# -------------------------------------------------------------------------------

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(?:\A|[\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/>]|\Z))""", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[a-z0-9]+")
COMMA = re.compile("[,،、，]")
SENTENCE_END = re.compile(r"[.!?。](?:\s|\Z)")


def _words(name: str) -> set[str]:
    """Words of a class name or id; ``has-sidebar`` has none that names the element."""
    found = WORD.findall(CAMEL.sub(" ", name).lower())
    return {w for k, w in enumerate(found) if not k or found[k - 1] not in WITH_WORDS}


class Page:
    """Elements by number (a parent before its children) and blocks of (element, text) pieces in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attributes = ["#page"], [0], [""]
        self.blocks: list[tuple[int, list[tuple[int, str | None]]]] = []
        self._pieces: list[tuple[int, str | None]] = []
        self._breaks = 0
        self._open, self._counts = [0], Counter()
        self._owner = [0]
        at, end = 0, len(html)
        while at < end:
            found = TOKEN.search(html, at)
            if not found:
                self._text(html[at:])
                break
            if found.start() > at:
                self._text(html[at: found.start()])
            at = found.end()
            if found[2]:
                name = found[2].lower()
                self._start(name, found[3])
                if name in RAW:
                    stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
                    inside, at = (html[at: stop.start()], stop.start()) if stop else (html[at:], end)
                    if name == "xmp":
                        self._text(inside)
            elif found[1]:
                self._end(found[1].lower())
        self._flush()

    def _text(self, text: str) -> None:
        if self._breaks and not text.isspace():
            if self._breaks > 1:
                self._flush()
            else:
                self._pieces.append((self._open[-1], " "))
            self._breaks = 0
        self._pieces.append((self._open[-1], unescape(text) if "&" in text else text))

    def _flush(self) -> None:
        if self._pieces:
            self.blocks.append((self._owner[-1], self._pieces))
            self._pieces = []
        self._breaks = 0

    def _pop(self) -> None:
        node = self._open.pop()
        self._counts[self.tag[node]] -= 1
        if node == self._owner[-1]:
            self._flush()
            self._owner.pop()

    def _close(self, names: set[str], stops: set[str]) -> None:
        """Close the nearest open element of ``names`` that no element of ``stops`` shields."""
        if not any(self._counts[n] > 0 for n in names):
            return
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in names:
                while len(self._open) > depth:
                    self._pop()
                return
            if tag in stops:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._breaks += 1
            return
        if name in BLOCK:
            self._close({"p"}, SCOPE)
            if name in ENDS:
                names, stops = ENDS[name]
                for _ in range(3 if name in ("thead", "tbody", "tfoot") else 2 if name == "tr" else 1):
                    self._close(names, stops)
            self._flush()
        elif name == "a":
            self._close({"a"}, BLOCK | SCOPE)
        if name in VOID:
            return
        self.tag.append(name)
        self.parent.append(self._open[-1])
        self.attributes.append(attributes)
        self._open.append(len(self.tag) - 1)
        self._counts[name] += 1
        if name in BLOCK:
            self._owner.append(self._open[-1])

    def _end(self, name: str) -> None:
        if name == "br":
            self._breaks += 1
        elif name in SCOPE:
            self._close({name}, {"table"} - {name})
        elif name in HEADINGS:
            self._close(HEADINGS, SCOPE)
        else:
            # an inline end tag does not close blocks
            self._close({name}, SCOPE if name in BLOCK else BLOCK | SCOPE)

    def dropped(self) -> list[bool]:
        """Whether an element, or one that it lies in, is never part of the article."""
        n = len(self.tag)
        comment, layout, header, gone = ([False] * n for _ in range(4))
        for k in range(1, n):
            tag = self.tag[k]
            if tag in ("html", "body"):
                continue
            gone[k] = tag in DROPPED
            header[k] = tag == "header"
            layout[k] = tag == "form"
            if not self.attributes[k] or gone[k]:
                continue
            for name, value in ATTRIBUTE.findall(self.attributes[k]):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    for one in value.split():
                        words = _words(one)
                        comment[k] |= bool(words & COMMENT_WORDS)
                        header[k] |= bool(words & HEADER_WORDS) and tag not in HEADINGS
                        # an article is furniture only by its plain name, not as "post-with-sidebar"
                        layout[k] |= bool(words & LAYOUT_WORDS - HEADER_WORDS) and (tag not in MAIN or len(words) == 1)
                elif name == "role":
                    gone[k] |= value.lower() in DROPPED_ROLES - {"banner"}
                    header[k] |= value.lower() == "banner"
                elif name == "style":
                    gone[k] |= "display:none" in value.replace(" ", "").lower()
                else:
                    gone[k] |= name == "hidden" or value.lower() == "true"
        holds, titled = [False] * n, [False] * n
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            holds[up] |= holds[k] or (self.tag[k] in MAIN and not (comment[k] or layout[k]))
            titled[up] |= titled[k] or self.tag[k] == "h1"
        inside = [False] * n
        for k in range(1, n):
            up = self.parent[k]
            inside[k] = inside[up] or self.tag[k] in MAIN
            # a header inside an article, or with the headline, is the article's; a frame around the article is not furniture
            gone[k] = gone[up] or gone[k] or comment[k] or (layout[k] and not holds[k]) or (
                header[k] and not (inside[up] or titled[k] or holds[k]))
        return gone


def _plain(pieces: list[tuple[int, str | None]], gone: list[bool]) -> str:
    return " ".join("".join([text for node, text in pieces if not gone[node]]).split())


def extract(html: str | None) -> tuple[str, str]:
    """The main text of a page and the element that it was found in."""
    if not html:
        return "", ""
    page = Page(html)
    tag, parent, n = page.tag, page.parent, len(page.tag)
    gone = page.dropped()
    linked = [False] * n
    for k in range(1, n):
        linked[k] = linked[parent[k]] or tag[k] == "a"
    blocks = [(owner, pieces, text) for owner, pieces in page.blocks if not gone[owner] and (text := _plain(pieces, gone))]

    # text, linked text, links and paragraphs of each element's whole content
    chars, link_chars, links, paragraphs = ([0] * n for _ in range(4))
    for owner, pieces, text in blocks:
        chars[owner] += len(text)
        link_chars[owner] += min(len(text), sum(len(" ".join(t.split())) for node, t in pieces if linked[node] and not gone[node]))
        paragraphs[owner] += tag[owner] == "p"
    for k in range(n - 1, 0, -1):
        up = parent[k]
        links[k] += tag[k] == "a" and not gone[k]
        for sums in (chars, link_chars, links, paragraphs):
            sums[up] += sums[k]
    density = [link / size if size else 0.0 for link, size in zip(link_chars, chars)]

    points: dict[int, float] = {}
    for owner, _, text in blocks:
        if tag[owner] in HEADINGS:
            continue
        node = parent[owner] if tag[owner] in PARAGRAPHS else owner
        given = 1 + len(COMMA.findall(text)) + min(len(text) / 100, 3)
        for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
            if not node:
                break
            if node not in points:
                words = set().union(*(_words(value.strip("\"'")) for name, value in ATTRIBUTE.findall(page.attributes[node]) if name.lower() in ("class", "id")))
                points[node] = FIRST_POINTS.get(tag[node], 0.0) + (25.0 if words & GOOD_WORDS and tag[node] not in ("html", "body") else 0.0)
            points[node] += given * share
            node = parent[node]
    score = {k: p * (1 - density[k]) for k, p in points.items()}
    if score:
        best = min(score, key=lambda k: (-score[k], k))
        around = best
        while around and tag[around] not in MAIN:
            around = parent[around]
        best = around or best
    else:
        best = next((k for k in range(n) if tag[k] == "article" and chars[k]), next((k for k in range(n) if tag[k] in ("main", "body") and chars[k]), 0))

    kept = [False] * n
    kept[best] = True
    if best:
        enough = max(10.0, 0.2 * score.get(best, 0.0))
        has_title = any(tag[owner] == "h1" and _within(owner, best, parent) for owner, _, _ in blocks)
        whole = {}
        for owner, _, text in blocks:
            whole.setdefault(owner, []).append(text)
        for k in range(1, n):
            if k == best or parent[k] != parent[best] or gone[k]:
                continue
            text = " ".join(whole.get(k, ()))
            plain = tag[k] == "p" and tag[best] not in MAIN and (
                (len(text) > 80 and density[k] < 0.25) or (density[k] == 0 and bool(SENTENCE_END.search(text))))
            like = tag[k] == tag[best] and tag[best] not in MAIN and page.attributes[k] == page.attributes[best] and density[k] < 0.25
            kept[k] = score.get(k, 0.0) >= enough or plain or like or (tag[k] == "h1" and k < best and not has_title)
    for k in range(1, n):
        menu = tag[k] in LISTS and links[k] >= 3 and density[k] >= 0.8 and not paragraphs[k] and not kept[k]
        kept[k] = kept[k] or (kept[parent[k]] and not menu)
    if best == 0:
        kept = [True] * n
    return "\n".join(text for owner, _, text in blocks if kept[owner]), tag[best] if best else ""


def _within(node: int, container: int, parent: list[int]) -> bool:
    while node > container:
        node = parent[node]
    return node == container


_RESULT = pa.struct([("text", pa.string()), ("container", pa.string())])


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("container", StringType())]))
def _extracted(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        yield pa.array([dict(zip(("text", "container"), extract(html))) for html in batch.to_pylist()], _RESULT)


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """struct ``row`` (the input row), text, n_chars (its code points) and container (the element that the text was found in)."""
    rows = pages.select(F.struct("*").alias("row"), _extracted(F.col(html)).alias("found"))
    return rows.select("row", "found.text", F.length("found.text").cast("long").alias("n_chars"), "found.container")
