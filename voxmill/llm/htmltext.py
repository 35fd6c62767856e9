"""Main text of web pages by composite text density.

A page becomes a tree.  For each node, characters per tag are counted and
adjusted for the share of linked characters and link tags; a node's density sum
adds up its children's densities.  The node of the greatest sum holds the main
text.  The least density on the path from it to the body is the threshold: every
node that reaches it gives the node of greatest sum within it.

Menus, footers, scripts and the like go by their tags.  Names (class, id, role)
only weigh: in the sums, what is within an element that names itself a notice,
an advert or comments counts for a fifth.  So a name alone never takes the text
away that density finds; what is named so and isn't around the node of the
greatest sum is left out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Tags with HTML's attribute states: a quote opens a value only right behind "=".
_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z) | <!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z) | <[!?][^>]*+(?:>|\Z)
      | <(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+)(?:>|\Z)
      | </[^>]*+(?:>|\Z)""",
    re.X | re.S,
)
_ATTR = re.compile(r"""([^\s=/>]++)\s*+(?:=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?""")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: The text of these runs to their end tag, whatever is in it.
_RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
_END_OF = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}
_DROP = frozenset(
    "script style textarea title noscript xmp iframe noembed noframes head nav footer aside template svg math "
    "button select option datalist object embed applet canvas audio video map dialog menu input label fieldset legend".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag closes an open one of these, as far as a scope goes.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",)}
_ENDS_P = _BLOCK - {"tbody", "td", "tfoot", "th", "thead", "tr", "caption", "body", "html"}
_FORMATS = frozenset("a b big code em font i nobr s small strike strong tt u span abbr cite dfn kbd mark q samp sub sup var time label ins del".split())

_WORDS = re.compile(r"[a-z]+|\d+")
_HUMP = re.compile(r"([a-z])([A-Z])")
#: Words of class, id, role or aria-label that name what isn't the article.
_AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adslot adbox adbanner adunit adwrap banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navbars navigation navi menu menus submenu breadcrumb breadcrumbs crumbs crumb topbar toolbar pagination pager paging toc "
    "sidebar sidebars sidenav aside complementary rail widget widgets footer footers foot colophon contentinfo masthead header headers "
    "notice notices cookie cookies consent gdpr popup popups modal overlay newsletter subscribe subscription signup signin login paywall alert alerts disclaimer "
    "comment comments commentlist commentary respond replies reply disqus discussion reactions "
    "share sharing social socials related recommended recommendations trending popular search searchbox form forms skip copyright legal tags taglist hidden".split()
)
#: Words that say the opposite, in another name of the same element.
_CONTENT = frozenset("article articles articlebody content main post posts entry story body text page column primary prose hentry".split())
#: Names that tell of a state or a layout, not of the element.
_STATE_FIRST = frozenset("has no with without is js hide show wp".split())
_STATE_LAST = frozenset("visible enabled disabled active open closed collapsed expanded on off true false".split())
_KEEP_TAGS = frozenset("html body main article".split())
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_LINKED = frozenset(["a", "button", "select"])
#: What the text in an element that is named as something else counts for in the sums.
WEIGHT = 0.2


class Node:
    __slots__ = ("tag", "parent", "parts", "weight", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, tag: str, parent: Node | None, weight: float = 1.0):
        self.tag, self.parent, self.parts, self.weight = tag, parent, [], weight


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _suspect(tag: str, raw: str, inside_article: bool) -> bool:
    """Whether the element names itself something beside the article: by a header or form tag, its names, or being hidden."""
    if tag == "form" or (tag == "header" and not inside_article):
        return True
    if not raw or tag in _KEEP_TAGS:
        return False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return True
    if inside_article and tag in ("h1", "header"):
        return False
    away = False
    for k in ("class", "id", "role", "aria-label", "itemprop", "data-role"):
        v = a.get(k)
        for name in v.split() if v and k == "class" else [v] if v else []:
            words = _WORDS.findall(_HUMP.sub(r"\1 \2", name).lower())
            if not words or not _STATE_FIRST.isdisjoint(words[:-1]) or words[-1] in _STATE_LAST:
                continue
            if not _AWAY.isdisjoint(words):
                away = True
            elif not _CONTENT.isdisjoint(words):
                return False
    return away


def parse(page: str) -> Node:
    """A tree of the page's body, without the elements that tell by tag that they are no article.

    Each step looks at the top of a stack of open tags, kept for each name, so
    the time is linear whatever is left open.
    """
    root = body = Node("html", None)
    stack, blocks_open, article = [root], [0], 0
    open_: dict[str, list[int]] = {"html": [0]}  # where in the stack each tag is open

    def last(tags) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=-1)

    def close_from(i: int) -> None:
        nonlocal article
        while len(stack) > i:
            x = stack.pop()
            open_[x.tag].pop()
            article -= x.tag in ("article", "main")
            if x.tag in _BLOCK:
                blocks_open.pop()

    def push(x: Node) -> None:
        nonlocal article
        open_.setdefault(x.tag, []).append(len(stack))
        if x.tag in _BLOCK:
            blocks_open.append(len(stack))
        article += x.tag in ("article", "main")
        stack.append(x)

    at, n = 0, len(page)
    skip, depth = "", 0  # the left-out element that is open, and how many of its name
    while at < n:
        m = _TOKEN.search(page, at)
        if not skip:
            text = page[at : m.start() if m else n]
            if text:
                stack[-1].parts.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if m["cdata"] and not skip:
            stack[-1].parts.append(m["cdata"])
        if not m["tag"]:
            continue
        tag, close = m["tag"].lower(), m["close"]
        if skip:
            if tag == skip:
                depth += -1 if close else 1
                if not depth:
                    skip = ""
            elif tag in _RAW and not close:
                end = _END_OF[tag].search(page, at)
                at = end.end() if end else n
            elif close and tag in ("body", "html", "article", "main") and open_.get(tag):
                skip, at = "", m.start()  # it was never closed
            continue
        if close:
            i = open_[tag][-1] if open_.get(tag) else -1
            if i > 0 and not (tag in _FORMATS and blocks_open[-1] > i):
                close_from(i)
            continue
        raw = m["attrs"]
        if tag in ("html", "body"):
            if tag == "body" and body is root:
                body = Node("body", stack[-1])
                stack[-1].parts.append(body)
                push(body)
            continue
        if tag in _ENDS_P and open_.get("p") and open_["p"][-1] == blocks_open[-1]:
            close_from(open_["p"][-1])
        if tag in _CLOSES:
            i = last(_CLOSES[tag])
            if i > last(_SCOPE.get(tag, ("table",))):
                # as far as they follow each other, all of them
                j = min((open_[t][-1] for t in _CLOSES[tag] if open_.get(t) and open_[t][-1] > last(_SCOPE.get(tag, ("table",)))))
                close_from(j)
        if tag in _RAW:
            end = _END_OF[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            stack[-1].parts.append("\n")
            continue
        if tag in _DROP:
            stack[-1].parts.append(Node("hr", stack[-1], stack[-1].weight) if tag in _BLOCK else "")
            if tag not in _VOID and not raw.endswith("/"):
                skip, depth = tag, 1
            continue
        weight = stack[-1].weight * (WEIGHT if _suspect(tag, raw, article > 0) else 1.0)
        node = Node(tag, stack[-1], weight)
        stack[-1].parts.append(node)
        if tag not in _VOID:
            push(node)
    return body


def _order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out = [root]
    for node in out:
        out.extend(p for p in node.parts if type(p) is Node)
    return out


def wrap(body: Node) -> None:
    """Puts runs of text and inline elements beside block elements into nodes of their own, which have no tag."""
    blocky = set()
    for node in reversed(_order(body)):
        inner = any(p in blocky for p in node.parts if type(p) is Node)
        if inner or node.tag in _BLOCK:
            blocky.add(node)
        if not inner:
            continue
        parts, run = [], []

        def close(run: list, parts: list, node: Node) -> None:
            if any(type(r) is Node or not r.isspace() for r in run):
                box = Node("", node, node.weight)
                box.parts = list(run)
                for r in run:
                    if type(r) is Node:
                        r.parent = box
                parts.append(box)
            run.clear()

        for p in node.parts:
            if type(p) is Node and p in blocky:
                close(run, parts, node)
                parts.append(p)
            elif p != "":
                run.append(p)
        close(run, parts, node)
        node.parts = parts


def _length(text: str) -> int:
    return len("".join(text.split()))


def densities(body: Node) -> None:
    """Counts characters, tags, linked characters and link tags; sets each node's density, sum and best node."""
    nodes = _order(body)
    for node in reversed(nodes):
        chars = tags = lc = lt = 0
        for p in node.parts:
            if type(p) is Node:
                chars += p.chars
                tags += p.tags + (p.tag != "")
                lc += p.link_chars
                lt += p.link_tags
            else:
                chars += _length(p)
        if node.tag in _LINKED:
            lc, lt = chars, lt + 1
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, lc, lt
    per_char = body.link_chars / (body.chars or 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, node.tags or 1, node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(c - lc, 1) * lc + per_char * c + math.e)
            node.density = c / t * math.log(max(c / (lc or 1) * t / (lt or 1), 1.0000001)) / base
        else:
            node.density = 0.0
        own, total, best = 0, 0.0, node
        for p in node.parts:
            if type(p) is Node:
                total += p.density * p.weight
                if best is node or p.best.total > best.total:
                    best = p.best
            else:
                own += _length(p)
        if own:  # text of its own counts like a child that holds nothing else
            total += node.weight * own * math.log(max(own, 1.0000001)) / math.log(per_char * own + math.e)
        node.total = total
        node.best = best if best is not node and best.total > total else node


def main_nodes(body: Node) -> list[Node]:
    """The nodes that hold the main text, in page order, none within another.

    What is of less weight than the node of the greatest sum is in an element
    within or beside it that names itself something else.
    """
    densities(body)
    best = body.best
    if not body.chars:
        return []
    threshold, x = math.inf, best
    while x is not None and x is not body.parent:
        threshold = min(threshold, x.density)
        x = x.parent
    chosen, todo = {best}, [body]
    while todo:
        x = todo.pop()
        if x.chars and x.weight >= best.weight and x.density >= threshold - 1e-12:
            if x.best.weight >= best.weight:
                chosen.add(x.best)
            todo.extend(p for p in x.parts if type(p) is Node)
    out, todo = [], [body]
    while todo:
        x = todo.pop()
        if x in chosen:
            out.append(x)
        else:
            todo.extend(p for p in reversed(x.parts) if type(p) is Node)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the nodes' blocks: white space one space, trimmed, none empty; without what is of less weight than the lightest node."""
    out, line = [], []
    least = min((x.weight for x in nodes), default=0.0)

    def end() -> None:
        if line:
            text = _SPACE.sub(" ", "".join(line)).strip()
            if text:
                out.append(text)
            line.clear()

    for top in nodes:
        end()
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif type(x) is str:
                line.append(x)
            elif x.weight >= least:
                if x.tag in _BLOCK or not x.tag:
                    end()
                    todo.append(None)
                todo.extend(reversed(x.parts))
        end()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null and for pages without any."""
    if not page:
        return ""
    body = parse(page)
    wrap(body)
    return "\n".join(blocks(main_nodes(body)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with main_text added.  Null html: the empty text.  Each row depends on its html alone."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(main_text, na_action=None).astype(object)

    return pages.withColumn("main_text", run(F.col(html_col)))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
