"""Main text of web pages by scoring the tree of their elements.

Paragraphs earn points for their length and their commas and pass them to their ancestors, less
with every step; the share of text inside links takes points away again. The best container
is kept with those of its siblings that look like text, and within it everything but
boilerplate elements.
"""

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.llm.common import map_rows

# Elements by kind (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|noscript|textarea|iframe"
# Elements of other languages, which may close themselves and end where a block begins.
FOREIGN = frozenset(("svg", "math"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
# An element of a group ends one of the same group that is open in its list or table.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}),
        "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"})}
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
# Elements, roles and words of class or id that mark what is not the article.
BOILERPLATE = frozenset(
    "head title nav aside footer form button select option input dialog menu svg".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu "
                  "menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert advertisement advertisements adsense sponsor sponsored sponsors promo "
    "promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "header cookie cookies consent notice notices disclaimer gdpr popup modal overlay share sharing "
    "social related recommended recommendations trending newsletter subscribe subscription signup "
    "login comment comments commentlist respond reply replies disqus discussion pagination pager "
    "widget widgets toolbar skip tags outbrain taboola".split())
ARTICLE = frozenset("article main".split())
# Words that say a container has, or lacks, what comes next; it is not that itself.
ABOUT = frozenset("has have with no not non without hide hides show shows is".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    rf"|<(?P<raw>{RAW})\b[^>]*+>(?:(?!</(?P=raw)\b).)*+(?:</(?P=raw)\b[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attributes2>[^>]*+)>"
    r"|<[!?/][^>]*+>|(?P<text>[^<]++|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?",
                        re.I)
_WORD = re.compile("[a-z]+")


class Tree:
    """Elements in page order as parallel lists, and runs of text with their element."""

    def __init__(self, page: str):
        self.tag, self.parent, self.junk = ["#root"], [-1], [False]
        # Elements with a word of boilerplate in class or id, which may still hold the article.
        self.marked = [False]
        # Events in page order: (element, text) and (element, None) at a block's edge.
        self.events: list[tuple[int, str | None]] = []
        open_elements = [0]
        for match in _TOKEN.finditer(page):
            text = match["text"]
            if text is not None:
                self.events.append((open_elements[-1], text))
                continue
            tag = match["tag"] or match["tag2"]
            if tag is None:
                if match["raw"] is None:
                    continue
                self.events.append((open_elements[-1], " "))
                continue
            tag = tag.lower()
            if match["end"] or match["end2"]:
                self._close(tag, open_elements)
                continue
            self._imply_ends(tag, open_elements)
            if tag == "br":
                self.events.append((open_elements[-1], "\n"))
            elif tag in VOID:
                if tag == "hr":
                    self.events.append((open_elements[-1], None))
            else:
                attributes = match["attributes"] or match["attributes2"] or ""
                if attributes.endswith("/") and (tag in FOREIGN or any(
                        self.tag[k] in FOREIGN for k in open_elements[-8:])):
                    continue
                hidden, marked = self._kind(tag, attributes) if attributes else (False, False)
                junk = tag in BOILERPLATE or hidden
                if tag == "header":  # an article's own head holds its title
                    junk = not any(self.tag[k] in ARTICLE for k in open_elements)
                    marked = marked and junk
                self.tag.append(tag)
                self.parent.append(open_elements[-1])
                self.junk.append(junk)
                self.marked.append(marked)
                open_elements.append(len(self.tag) - 1)
                if tag in BLOCK:
                    self.events.append((open_elements[-1], None))

    def _close(self, tag: str, open_elements: list[int]) -> None:
        for depth in range(len(open_elements) - 1, 0, -1):
            name = self.tag[open_elements[depth]]
            if name == tag:
                if any(self.tag[k] in BLOCK for k in open_elements[depth:]):
                    self.events.append((open_elements[depth - 1], None))
                del open_elements[depth:]
                return
            if name in BLOCK and tag not in BLOCK:
                return  # an inline end does not close a block

    def _imply_ends(self, tag: str, open_elements: list[int]) -> None:
        if tag in BLOCK and tag != "title":
            for depth in range(len(open_elements) - 1, 0, -1):
                name = self.tag[open_elements[depth]]
                if name in FOREIGN:
                    del open_elements[depth:]
                    break
                if name in BLOCK:
                    break
        if tag in BLOCK:
            for depth in range(len(open_elements) - 1, 0, -1):
                name = self.tag[open_elements[depth]]
                if name == "p" or (name == "head" and tag != "title"):
                    del open_elements[depth:]
                    break
                if name in BLOCK:
                    break
        if tag in ENDS:
            closes, within = ENDS[tag]
            for depth in range(len(open_elements) - 1, 0, -1):
                name = self.tag[open_elements[depth]]
                if name in within:
                    break
                if name in closes:
                    del open_elements[depth:]
                    if tag != "tr":
                        break

    @staticmethod
    def _kind(tag: str, attributes: str) -> tuple[bool, bool]:
        """Whether attributes hide an element or give it a role that is no article, and whether
        they name boilerplate in its class or id."""
        hidden = marked = False
        if tag in ("html", "body"):
            return hidden, marked
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (
                    name == "role" and value in ROLES):
                hidden = True
            if name in ("class", "id") and tag not in ARTICLE:
                marked = marked or any(_names_boilerplate(v) for v in value.split())
        return hidden, marked


def _names_boilerplate(name: str) -> bool:
    """Whether a class or id holds a word of boilerplate that is not only talked about."""
    about = False
    for word in _WORD.findall(name):
        if word in WORDS and not about:
            return True
        about = word in ABOUT
    return False


def _junk(tree: Tree, points: list[float]) -> list[bool]:
    """Elements that are dropped, with all they hold.

    A marked container is dropped unless it holds an article or main element. If that leaves no
    paragraph, the marked container with the most points outside other marked ones is taken back,
    until one is left or there is none.
    """
    n, parent = len(tree.tag), tree.parent
    holds = [t in ARTICLE and not j for t, j in zip(tree.tag, tree.junk)]
    for k in range(n - 1, 0, -1):
        holds[parent[k]] = holds[parent[k]] or holds[k]
    marked = [m and not h for m, h in zip(tree.marked, holds)]
    while True:
        # The nearest marked element of each: itself, or that of its parent; -2 below junk.
        owner, junk = [-1] * n, list(tree.junk)
        for k in range(1, n):
            owner[k] = k if marked[k] else owner[parent[k]]
            junk[k] = junk[k] or marked[k] or junk[parent[k]]
        hard = list(tree.junk)
        by_owner: dict[int, float] = {}
        for k in range(1, n):
            hard[k] = hard[k] or hard[parent[k]]
            if points[k] and not hard[k]:
                by_owner[owner[k]] = by_owner.get(owner[k], 0.0) + points[k]
        if -1 in by_owner or not by_owner:
            return junk
        back = max(by_owner, key=lambda k: (by_owner[k], -k))
        while back > 0:  # with all that is around it
            marked[back] = False
            back = parent[back]


def main_text(page: str | None) -> str:
    """Blocks of the main text in page order, joined by newlines; empty if there is none."""
    if not page:
        return ""
    tree = Tree(page)
    n = len(tree.tag)
    parent, tag = tree.parent, tree.tag
    points = _paragraph_points(tree, [False] * n)[0]
    junk = _junk(tree, points)
    points, length, links = _paragraph_points(tree, junk)
    score: dict[int, float] = {}
    for k in range(1, n):
        if points[k] and not junk[k]:
            at = parent[k]
            for step in range(6):
                if at < 0:
                    break
                score[at] = score.get(at, 0) + points[k] / (1 if step == 0 else 2 if step == 1
                                                            else 3 * step)
                at = parent[at]
    best, most = None, 0.0
    for k, value in score.items():
        value *= 1 - links[k] / max(1, length[k])
        score[k] = value
        if value > most and not junk[k]:
            best, most = k, value
    if best is None:  # no paragraph counts: the article if there is one, else all
        longest = max((k for k in range(1, n) if tag[k] in ARTICLE and not junk[k]),
                      key=lambda k: length[k], default=0)
        keep = {longest}
    else:
        keep = _with_siblings(best, most, score, tree, junk, length, links)
    inside = [False] * n
    for k in range(n):
        inside[k] = not junk[k] and (k in keep or (k > 0 and inside[parent[k]]))
    blocks, held = [], []
    for k, text in tree.events:
        if text is None:
            blocks.append("".join(held))
            held = []
        elif inside[k]:
            held.append(text)
    blocks.append("".join(held))
    out = (" ".join(html.unescape(block).split()) for block in blocks)
    return "\n".join(block for block in out if block)


def _paragraph_points(tree: Tree, junk: list[bool]) -> tuple[list[float], list[int], list[int]]:
    """Points of paragraphs, length of text and of text in links of all elements, without junk."""
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    linked = [False] * n
    for k in range(1, n):  # parents come before their children
        linked[k] = linked[parent[k]] or tag[k] == "a"
    length, links, commas = [0] * n, [0] * n, [0] * n
    for k, text in tree.events:
        if text is not None and not junk[k]:
            size = len(text) if not text.isspace() else 0
            length[k] += size
            commas[k] += text.count(",") + text.count("、") + text.count("，")
            if linked[k]:
                links[k] += size
    for k in range(n - 1, 0, -1):
        length[parent[k]] += length[k]
        links[parent[k]] += links[k]
        commas[parent[k]] += commas[k]
    points = [1 + commas[k] + min(length[k] / 100, 3)
              if tag[k] in PARAGRAPHS and length[k] >= 25 else 0.0 for k in range(n)]
    return points, length, links


def _with_siblings(best, most, score, tree, junk, length, links) -> set[int]:
    """The best container, or the article around it, and siblings that look like its text."""
    tag, parent = tree.tag, tree.parent
    core, at = best, best
    while at > 0:
        if tag[at] in ARTICLE:
            core = at
            break
        at = parent[at]
    keep = {core}
    if tag[core] in ("#root", "html", "body"):
        return keep
    # What stands beside an article directly in the page need not belong to it, but another one.
    around = tag[core] in ARTICLE and tag[parent[core]] in ("#root", "html", "body")
    for k in range(1, len(tag)):
        if parent[k] != parent[core] or junk[k]:
            continue
        density = links[k] / max(1, length[k])
        if tag[k] in ARTICLE and score.get(k, 0) > 0 and density < 0.25:
            keep.add(k)
        elif not around and (
                score.get(k, 0) >= max(10, 0.2 * most) or (
                    tag[k] in PARAGRAPHS and length[k] and density < 0.25) or (
                    tag[k] in ("h1", "h2", "h3", "h4", "h5", "h6") and density < 0.5)):
            keep.add(k)
    return keep


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url",
            page: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points).

    The whole page is read. A null or empty page, or one without text, has an empty text;
    repeated rows each get a row; a null id or url stays null; other columns are not looked
    at; an empty table gives no rows.
    """
    def run(batches):
        for ids, urls, sources in batches:
            for i, link, source in zip(ids, urls, sources):
                text = main_text(source)
                yield i, link, text, len(text)

    return map_rows(pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"),
                                 F.col(f"`{url}`").cast("string").alias("url"),
                                 F.col(f"`{page}`").cast("string").alias("html")), run,
                    "page_id long, url string, text string, n_chars long", batch_rows=256)
