"""Main text of web pages by composite text density.

For every DOM node: characters and tags below it, those inside links, and from them a link-adjusted
density of characters per tag. A node's sum is that of its children's densities; the node with the
largest sum is the core, and the smallest density on its path to the body is the threshold. The main
text is the core's subtree and, beside its path, every subtree that reaches the threshold, with the
headings that stand right before one.

Tags and names only add to that. What is no content whatever its density leaves before counting: by
element (scripts, menus, forms ...), role, being hidden, or as a list of reader comments (COMMENTS, and
names with such a part, as in post-comments), which is as dense as an article. A word of boilerplate in a class or id makes a node's density count
HINTED of what it is, and beside the path it is never taken; article and main count 1 / HINTED, and in
one that holds the core what lies below the threshold stays, unless it is mostly links. Within the main
text a node leaves if a whole class or id names boilerplate and it is mostly links or holds a form, or
names an advert or the like (ADVERTS) and stays below the threshold.

Null or empty html, and pages without text, give an empty text. Of equal sums the outer node counts,
of these the first on the page. Comments end as HTML has it: <!--> and <!---> are empty ones, and --!> ends
one too. Only void elements close themselves, whatever slash a tag ends with. Unclosed tags end with their parents or the page; a tag cut off at the
end of the page is dropped. Work grows with the length of a page, not with its depth. Equal pages give
equal texts, repeated rows repeated ones, an empty table an empty table. Extra columns stay; if the
new column's name is taken it gets a _ behind it.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from civicframe.llm.common import free_name, table

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag ends open elements of these kinds, up to the given borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: What ends the search for an open paragraph, and for other elements that an opening tag ends.
SCOPES, STOPS = frozenset("table td th button object".split()), frozenset("div section article body".split())
ROOTS = frozenset("html body article main".split())
#: What is never main text.
DROP_TAGS = frozenset("script style noscript template nav footer aside form button select textarea iframe object svg canvas dialog menu head title".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "subscription paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies respond share sharing social related "
    "recommended widget popup modal overlay login signup masthead copyright disclaimer toolbar pagination pager skip".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CONTROLS = frozenset("form input button select textarea".split())
#: Names (whole classes or ids) of reader comments, and of what is left out where it is thin.
COMMENTS = frozenset("comments commentlist comment-list comments-area comments-section comment-section disqus disqus_thread replies respond".split())
ADVERTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr newsletter subscribe subscription "
    "paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs footer widget popup modal overlay login signup toolbar pagination pager skip".split()
)
#: Parts of such names that say the same in longer ones, those that do so only outside an article, and first parts that say otherwise.
COMMENT_PARTS, COMMENT_OUTSIDE, COMMENT_DENIED = frozenset("comments commentlist disqus".split()), frozenset(["comment"]), frozenset("no has with without".split())
#: What the density of a node with a word of boilerplate in its class or id counts.
HINTED = 0.25
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|template|noscript|textarea|iframe|svg)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "up", "kids", "chars", "link_chars", "tags", "link_tags", "density", "drop", "hint", "named", "advert", "control", "linked", "inside", "open_p")

    def __init__(self, tag: str, up: "Node | None", drop: bool):
        self.tag, self.up, self.kids, self.drop = tag, up, [], drop
        self.hint = self.named = self.advert = False  # class or id holds a word of boilerplate; is one; is an advert's
        self.control = tag in CONTROLS  # is or holds one
        self.linked = tag == "a" or up is not None and up.linked
        self.inside = tag in ("article", "main") or up is not None and up.inside
        self.open_p = self if tag == "p" else None if up is None or tag in SCOPES else up.open_p
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = 0.0


def _dropped(tag: str, attrs: str, up: Node) -> bool:
    if up.drop and not (up.tag == "header" and tag in HEADINGS):
        return True
    if tag in DROP_TAGS:
        return True
    if tag == "header":
        return True  # headings inside an article's header come back above
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role" and value in DROP_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True
            if name in ("class", "id") and tag not in ROOTS and any(_of_comments(w, up.inside) for w in value.split()):
                return True
    return False


def _of_comments(word: str, inside: bool) -> bool:
    """Whether a class or id names reader comments, whole or by a part of it."""
    if word in COMMENTS:
        return True
    if "comment" not in word and "disqus" not in word:
        return False
    parts = re.split(r"[-_]+", word)
    return parts[0] not in COMMENT_DENIED and (not COMMENT_PARTS.isdisjoint(parts) or not inside and not COMMENT_OUTSIDE.isdisjoint(parts))


def _hints(node: Node, attrs: str) -> None:
    """What class and id say about a node; it only weighs with the densities."""
    for m in ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id") and node.tag not in ROOTS:
            value = (m[2] or m[3] or m[4] or "").lower()
            node.hint = node.hint or any(w in DROP_WORDS for w in re.split(r"[^a-z]+", value))
            node.named = node.named or any(w in DROP_WORDS for w in value.split())
            node.advert = node.advert or any(w in ADVERTS for w in value.split())


def parse(page: str) -> tuple[Node, list[tuple[Node, str | None]]]:
    """The DOM's root, and in page order each piece of text with its node; None marks a block's border."""
    root = now = Node("#root", None, False)
    out: list[tuple[Node, str | None]] = []
    at, opened = 0, Counter()  # how many of a tag are open, so that an end tag without one costs nothing

    def close(to: Node) -> Node:
        node = now
        while node is not to:
            opened[node.tag] -= 1
            node = node.up
        opened[to.tag] -= 1
        return to.up

    for m in TOKEN.finditer(page):
        if m.start() > at:
            out.append((now, page[at : m.start()]))
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            out.append((now, None))
        if m[2]:
            if opened[tag]:
                node = now
                while node.tag != tag:
                    node = node.up
                now = close(node)
            continue
        ended = _implied(now, tag, root) if tag in BLOCK or tag in CLOSES else None
        if ended is not None:
            now = close(ended)
        drop = _dropped(tag, m[4], now)
        if tag in HEADINGS and now.tag == "header" and not now.inside:
            drop = True
        node = Node(tag, now, drop)
        if m[4] and not m[4].isspace():
            _hints(node, m[4])
        now.kids.append(node)
        if tag == "br":
            out.append((now, " "))
        if tag not in VOID:
            now = node
            opened[tag] += 1
    if at < len(page):
        out.append((now, page[at:]))
    return root, out


def _implied(now: Node, tag: str, root: Node) -> Node | None:
    """The outermost element that the opening of tag ends."""
    if tag not in CLOSES:
        return now.open_p
    ends, borders = CLOSES[tag]
    node = now
    while node is not root and node.tag not in borders and node.tag not in STOPS:
        if node.tag in ends:
            return node
        node = node.up
    return node if node is not root and node.tag in ends else None


def measure(root: Node, pieces: list[tuple[Node, str | None]]) -> Node:
    """Fills the counts and densities; gives the body (or root). What a hinted node holds counts HINTED for those above."""
    for node, text in pieces:
        if text and not node.drop:
            n = 0 if text.isspace() else len(text) - text.count(" ")
            node.chars += n
            node.link_chars += n * node.linked
    body, order, stack = root, [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if not k.drop or k.kids]
        if node.tag == "body":
            body = node
    for node in reversed(order):
        for k in node.kids:
            weight = HINTED if k.hint else 1
            node.chars += k.chars * weight
            node.link_chars += k.link_chars * weight
            node.control = node.control or k.control
            if not k.drop:
                node.tags += 1 + k.tags
                node.link_tags += (k.tag == "a") + k.link_tags
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, share) * (HINTED if node.hint else 1)
    return body


def composite(chars: float, tags: int, link_chars: float, link_tags: int, share: float) -> float:
    """Characters per tag, less where links hold much of them; share is that of links in the whole body."""
    if not chars:
        return 0.0
    tags, link_tags = max(1, tags), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / max(1, link_chars) * tags / link_tags) + 1) / math.log(base + 1)


def core_of(body: Node) -> Node | None:
    """The node with the largest sum of its children's densities, text of its own counting like a child's."""
    core, best, stack = None, 0.0, [(body, 1.0)]
    while stack:
        node, weight = stack.pop()
        weight *= HINTED if node.hint else 1.0
        kids = [k for k in node.kids if not k.drop]
        total = sum(k.density for k in kids) if kids else node.density
        total *= weight / (HINTED if node.tag in ("article", "main") and not node.drop else 1.0)
        if total > best:
            core, best = node, total
        stack += [(k, weight) for k in reversed(node.kids) if not k.drop or k.kids]
    return core


def main_nodes(body: Node) -> tuple[list[Node], float]:
    """The subtrees with the main text, and the threshold that chose them."""
    core = core_of(body)
    if core is None:
        return [body], 0.0
    path = [core]
    while path[-1] is not body and path[-1].up is not None:
        path.append(path[-1].up)
    threshold = min(n.density for n in path)
    chosen, on_path = [core], {id(n) for n in path}
    for node in path[1:]:
        follows = False  # whether the next subtree with text is chosen, for the headings before it
        for k in reversed(node.kids):
            if not k.chars or k.drop and not k.kids:
                continue
            if id(k) in on_path:
                follows = True
                continue
            declared = node.inside or k.tag in ("article", "main") and k.density >= HINTED * threshold
            follows = not k.hint and (follows and k.tag in HEADINGS or k.link_chars * 2 <= k.chars and (declared or k.density >= threshold))
            if follows:
                chosen.append(k)
    return chosen, threshold


def _left_out(node: Node, threshold: float) -> bool:
    """Whether a node within the main text is boilerplate: by its name and by what it holds."""
    if not node.named or node.drop:
        return False
    return node.link_chars * 2 > node.chars or node.control or node.advert and node.density < threshold


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, pieces = parse(page)
    chosen, threshold = main_nodes(measure(root, pieces))
    inside, out, now = {id(n): True for n in chosen}, [], []
    stack = list(chosen)
    while stack:
        for k in stack.pop().kids:
            if _left_out(k, threshold):
                inside[id(k)] = False
            else:
                stack.append(k)

    def within(node: Node | None) -> bool:
        chain = []
        while node is not None and id(node) not in inside:
            chain.append(node)
            node = node.up
        hit = node is not None and inside[id(node)]
        for n in chain:
            inside[id(n)] = hit
        return hit

    for node, text in pieces:
        if text is None:
            out.append("".join(now))
            now = []
        elif not node.drop and within(node):
            now.append(text)
    out.append("".join(now))
    blocks = (" ".join((_html.unescape(b) if "&" in b else b).split()) for b in out)
    return "\n\n".join(b for b in blocks if b)


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extracted(html: Column) -> Column:
    """The main text of a page column."""
    return _main_text(html)


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text as column out."""
    return pages.withColumn(*free_name(pages, out), extracted(F.col(html_col)))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
