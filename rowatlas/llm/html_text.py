"""Main text of web pages by composite text density.

A tolerant parser builds the tree of a page in one pass. For every node the density is its
characters per tag, lowered by the share of characters and tags in links; a run of bare text between
two tags is a node of one tag. The density sum of a node adds up the densities of its
children. The node with the largest sum (of a paragraph or a line, its parent below the body) is the core and belongs to the text whole; the smallest density
on its path to the body is the threshold: of what lies beside the path, elements at or above it, headings, and
bare text of path nodes with what is in its lines belong to the text, too. Inside an article or main that
holds the core, whatever is beside the path does. Lists and boxes of links go, unless they lie in an article
or in the running text.

Elements that are never part of an article by their tag or ARIA role (menus, headers, footers, sidebars,
forms, scripts) do not count. The words of a class or id are a prior only: an element so marked
stays if it holds the core and more of the page's text than all unmarked elements, a main, or the only articles; inside an
article, headings stay, sections do whatever their id (but comments), and so does what is marked by words that can
name a subject ("discussion", "legal") unless it is links.

Defined cases: a null or empty page gives an empty text; a page without a body, or
without any markup, is its own body; unclosed and crossed tags end where their
parent ends; a tag or comment cut by the end of the page is dropped, and so is what follows a quote of an attribute that is
never closed; pages nest up to any depth and every pass is linear in the page; repeated rows give repeated rows;
other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
NEVER = frozenset("script style noscript template head nav footer aside form button select option textarea input iframe svg canvas object embed audio video dialog menu title annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag of the first kind ends an open element of the second.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(), frozenset({"p"})),
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
    "tbody": frozenset({"tr", "td", "th", "thead", "tbody", "p"}), "tfoot": frozenset({"tr", "td", "th", "thead", "tbody", "p"}), "body": frozenset({"head"}),
}
#: Elements over which such an end does not reach.
SCOPE = frozenset("html body table td th ul ol dl div section article main aside nav header footer form blockquote fieldset figure details button".split())
SCOPE_OF = {"li": frozenset({"ul", "ol", "menu", "dir"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), **dict.fromkeys(("tr", "td", "th", "tbody", "tfoot"), frozenset({"table"}))}
#: Boundaries over which an end tag of another element does not reach.
CELLS = frozenset("td th table article".split())
#: ARIA roles of what is no part of an article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar tablist".split())
#: Words of a class or id that mark what is no part of an article.
AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav rail footer masthead "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus respond widget widgets toolbar pagination pager skip contentinfo "
    "complementary searchbox paywall topbar toc taboola outbrain lightbox".split()
)
#: Words that may as well name what a part of an article is about: they mark if nothing but such words and HELPERS is in the name.
SUBJECTS = frozenset("discussion related privacy legal notice notices notification notifications disclaimer copyright alert search reply replies recommended recommendations hidden".split())
HELPERS = frozenset("site page box bar block area section list container wrapper wrap inner outer link links text message msg posts articles stories item items header title top bottom left right".split())
#: Words of readers' comments.
COMMENTS = frozenset("comment comments disqus reply replies respond discussion".split())
_STATE = re.compile(r"(?:has|no|with|without)[-_]")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_BARE = re.compile(r"\s*>")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\s>]+)|(["'])?))?)""")
_COMMENT_END = re.compile(r"--!?>")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A core of these is one paragraph of the text of its parent.
_PARAGRAPHS = frozenset(("p", "pre", "blockquote", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6"))
_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Node:
    __slots__ = ("tag", "parent", "children", "gone", "header", "named", "by_id", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, gone: bool = False, header: str = ""):
        self.tag, self.parent, self.children, self.gone, self.header = tag, parent, [], gone, header
        self.named, self.by_id = frozenset(), False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _away(tag: str, marks: dict[str, str]) -> bool:
    """Whether an element is no part of any article, or not shown."""
    if tag in NEVER:
        return True
    if tag in ("html", "body") or not marks:
        return False
    return "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(marks.get("style", "")))


def _said(name: str) -> set[str]:
    """Words that mark in the value of a class, id or role."""
    out: set[str] = set()
    for part in name.split():
        if not _STATE.match(part):
            words = {w.lower() for w in _WORD.findall(part)}
            out |= words & AWAY
            if words <= AWAY | SUBJECTS | HELPERS:
                out |= words & SUBJECTS
    return out


def _named(tag: str, marks: dict[str, str]) -> tuple[frozenset[str], bool]:
    """Words that mark an element, and whether its id alone has them."""
    if tag in ("html", "body") or not marks:
        return frozenset(), False
    by_id, other = _said(marks.get("id", "")), _said(marks.get("class", ""))
    if (role := marks.get("role", "").strip().lower()) in ROLES:
        other = other | {role}
    if tag in ("article", "main"):
        only = {"comment", "comments", "reply", "advert", "advertisement", "sponsored"}
        by_id, other = by_id & only, other & only
    return frozenset(by_id | other), not other


def _header(tag: str, marks: dict[str, str]) -> str:
    """"page" for what a name or class calls a header, "text" if it is called that of a text, else ""."""
    if tag in ("html", "body", "article", "main") or (tag != "header" and not marks):
        return ""
    said = {w.lower() for name in ("class", "id") for w in _WORD.findall(marks.get(name, ""))}
    if tag != "header" and "header" not in said:
        return ""
    return "text" if said & {"article", "post", "entry", "story", "content", "news"} else "page"


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """Attributes of a tag from behind its name, whether it ends in a slash, and where it ends; None if it never does."""
    if m := _BARE.match(page, at):
        return {}, False, m.end()
    found: dict[str, str] = {}
    while m := _ATTRIBUTE.match(page, at):
        if m[1]:
            return found, "/" in page[at : m.end()], m.end()
        if m[6]:  # a quote that is never closed
            return None
        value = m[3] or m[4] or m[5] or ""
        found.setdefault(m[2].lower(), html.unescape(value) if "&" in value else value)
        at = m.end()
    return None


class _Open:
    """The open elements, with the places of each tag, of scopes and of cells."""

    def __init__(self, top: Node):
        self.stack, self.of, self.scopes, self.cells = [top], defaultdict(list), [0], [0]

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        self.of[node.tag].append(k)
        if node.tag in SCOPE:
            self.scopes.append(k)
        if node.tag in CELLS:
            self.cells.append(k)

    def close(self, k: int) -> None:
        """End the element at place k and all in it."""
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.of[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            if tag in CELLS:
                self.cells.pop()

    def end(self, tag: str) -> None:
        """An end tag; without such an element in reach it is ignored."""
        if (at := self.of[tag]) and (at[-1] >= self.cells[-1] or tag in SCOPE or tag in ("p", "li")):
            self.close(at[-1])

    def implied(self, tag: str) -> None:
        """End what an opening tag ends: the outermost such row, cell or item inside of its list or table, else the nearest."""
        ends = CLOSES[tag]
        if tag in SCOPE_OF:
            wall = max((self.of[t][-1] for t in SCOPE_OF[tag] if self.of[t]), default=0)
            inside = [at[k] for t in ends if (at := self.of[t]) and (k := bisect(at, wall)) < len(at)]
            if inside:
                self.close(min(inside))
        elif (k := max((self.of[t][-1] for t in ends if self.of[t]), default=0)) > self.scopes[-1]:
            self.close(k)


def parse(page: str) -> Node:
    """The tree of a page; children are nodes and strings (decoded)."""
    top = Node("#", None)
    opened, at, size = _Open(top), 0, len(page)
    while at < size:
        now = opened.stack[-1]
        m = _NAME.match(page, at) if page[at] == "<" else None
        if m is None:
            if page.startswith("<!--", at):
                end = _COMMENT_END.search(page, at + 2)
                at = end.end() if end else size
            elif page.startswith(("<!", "<?"), at):
                mark = "]]>" if page.startswith("<![CDATA[", at) else ">"
                end = page.find(mark, at)
                at = end + len(mark) if end >= 0 else size
            else:
                end = page.find("<", at + 1)
                end = end if end >= 0 else size
                raw = page[at:end]
                now.children.append(html.unescape(raw) if "&" in raw else raw)
                at = end
            continue
        if (read := _attributes(page, m.end())) is None:
            break
        marks, slash, at = read
        tag = m[2].lower()
        if m[1]:
            opened.end(tag)
            continue
        if tag in CLOSES:
            opened.implied(tag)
            now = opened.stack[-1]
        node = Node(tag, now, _away(tag, marks), _header(tag, marks))
        node.named, node.by_id = _named(tag, marks)
        now.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            inside = page[at : end.start()] if end else page[at:]
            if tag in ("title", "textarea"):
                node.children.append(html.unescape(inside))
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else size
        elif tag not in VOID and (not slash or tag in BLOCKS):  # a slash does not close a block of HTML
            opened.push(node)
    return top


def _order(top: Node) -> list[Node]:
    """Nodes that stay, parents before children."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.gone)
    return out


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, lowered by links; ``share`` is the share of the page's characters that are in links."""
    if not chars:
        return 0.0
    plain = chars / max(1, tags)
    # The more of a node is links, the larger the base and the smaller its logarithm.
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    inner = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return max(0.0, plain * math.log(inner) / math.log(base)) if inner > 1 and base > 1 else plain * (1 - link_chars / chars)


def _size(text: str) -> int:
    """Characters besides white space."""
    return len("".join(text.split()))


def _weigh(nodes: list[Node]) -> None:
    """Counts, densities and density sums, from the leaves up."""
    runs: list[list[int]] = []  # sizes of the runs of bare text of each node
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        own, open_ = [], False
        for c in node.children:
            if isinstance(c, str):
                if n := _size(c):
                    if open_:
                        own[-1] += n
                    else:
                        own.append(n)
                        open_ = True
            else:
                open_ = False
                if not c.gone:
                    node.chars, node.tags = node.chars + c.chars, node.tags + c.tags + 1
                    node.link_chars, node.link_tags = node.link_chars + c.link_chars, node.link_tags + c.link_tags
        node.chars += sum(own)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        runs.append(own)
    whole = nodes[0]
    share = whole.link_chars / whole.chars if whole.chars else 0.0
    for node, own in zip(reversed(nodes), runs, strict=True):
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.sum = sum(c.density for c in node.children if not isinstance(c, str) and not c.gone)
        node.sum += sum(_density(n, 1, n if node.tag == "a" else 0, node.tag == "a", share) for n in own)


@dataclass
class Choice:
    """The core of a page, the threshold of its path, and the roots of its text in page order, each with whether it lies in an article."""

    core: Node
    threshold: float
    roots: list[tuple[Node, bool]]


def choose(nodes: list[Node]) -> Choice:
    """Roots of the main text among weighed nodes."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    core = max(_order(body), key=lambda n: n.sum)
    while core is not body and core.parent is not body and (core.tag in _PARAGRAPHS or core.tag not in BLOCKS):
        core = core.parent
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    # The outermost article around the core, else the outermost main.
    held = [k for k, n in enumerate(path) if n.tag == "article"] or [k for k, n in enumerate(path) if n.tag == "main"]
    inside = held[-1] if held else -1
    before, after = [], []
    for k, (node, parent) in enumerate(zip(path, path[1:], strict=False), 1):
        at = next(i for i, c in enumerate(parent.children) if c is node)
        before.append([(n, k <= inside) for n in _beside(parent.children[:at], threshold, k <= inside)])
        after.append([(n, k <= inside) for n in _beside(parent.children[at + 1 :], threshold, k <= inside)])
    return Choice(core, threshold, [*chain(*reversed(before)), (core, inside >= 0), *chain(*after)])


def _beside(children: list, threshold: float, all_: bool) -> list[Node]:
    """What belongs to the text of the children of a path node beside the path: dense nodes, headings, and its own text with what is in its lines; ``all_``: everything."""
    out: list[Node] = []
    run: list = []

    def close() -> None:
        line = Node("#line", None)
        line.children = list(run)
        nodes = [c for c in run if not isinstance(c, str)]
        run.clear()
        own = sum(_size(c) for c in line.children if isinstance(c, str))
        links, chars = sum(c.link_chars for c in nodes), sum(c.chars for c in nodes)
        if own or all_:
            if own + chars and (all_ or links * 2 < own + chars):
                out.append(line)
        else:
            out.extend(c for c in nodes if c.link_chars * 2 < c.chars and c.density >= threshold)

    for c in children:
        if isinstance(c, str) or (not c.gone and c.tag not in BLOCKS):
            run.append(c)
            continue
        close()
        if not c.gone and c.chars and (all_ or (c.link_chars * 2 < c.chars and (c.density >= threshold or c.tag in _HEADS))):
            out.append(c)
    close()
    return out


def _menus(children: list) -> set[int]:
    """Places of lists and boxes of links that are not in running text: between two texts, or behind a heading."""
    found = {k for k, c in enumerate(children) if not isinstance(c, str) and not c.gone and c.tag in ("ul", "ol", "div", "section", "table", "dl") and c.link_tags >= 3 and c.link_chars > 0.7 * c.chars}
    if not found:
        return found
    texts = [k for k, c in enumerate(children) if (c.strip() if isinstance(c, str) else not c.gone and c.link_chars * 2 < c.chars)]
    if not texts:
        return found
    last = None
    for k, c in enumerate(children):
        if isinstance(c, str) and not c.strip():
            continue
        if k in found and (texts[0] < k < texts[-1] or (last is not None and not isinstance(last, str) and last.tag in _HEADS)):
            found.discard(k)
        last = c
    return found


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order, one line each."""
    if not page:
        return ""
    top = parse(page)
    drop_named(top)
    drop_headers(top)
    nodes = _order(top)
    _weigh(nodes)
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        if said := " ".join("".join(line).split()):
            blocks.append(said)
        line.clear()

    for root, inside in choose(nodes).roots:
        close()
        stack: list[tuple] = [(root, inside)]
        while stack:
            item, inside = stack.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                line.append(item)
            elif item.gone:
                if item.tag in BLOCKS:
                    close()
            elif item.tag == "br":
                line.append(" ")
            else:
                if item.tag in BLOCKS:
                    close()
                    stack.append((None, False))
                inside = inside or item.tag in ("article", "main")
                away = set() if inside else _menus(item.children)
                stack.extend((None if k in away else c, inside) for k, c in reversed(list(enumerate(item.children))))
        close()
    return "\n".join(blocks)


def drop_named(top: Node) -> None:
    """Elements whose names are of no article go, unless what they hold speaks against it."""
    nodes = _order(top)
    if not any(n.named for n in nodes):
        return
    talk = [n for n in nodes if n.named & COMMENTS]
    for n in talk:  # comments are the core only if there is nothing else
        n.gone = True
    left = _order(top)
    for n in talk:
        n.gone = False
    _weigh(nodes)
    plain = {id(n): 0 for n in nodes}  # characters outside links and marked elements
    arts, mains = dict(plain), dict(plain)
    for n in reversed(nodes):
        plain[id(n)] += sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        if n.tag == "a" or n.header == "page":
            plain[id(n)] = 0
        if (up := n.parent) is not None:
            if not n.named:
                plain[id(up)] += plain[id(n)]
            if not (n.named and n.tag in ("article", "main")):
                arts[id(up)] += arts[id(n)] + (n.tag == "article")
                mains[id(up)] += mains[id(n)] + (n.tag == "main")
    _weigh(left)
    core = max(left, key=lambda n: n.sum)
    if not core.sum:
        _weigh(nodes)
        core = max(nodes, key=lambda n: n.sum)
    _weigh(nodes)
    holds, node = {id(core)}, core
    while (node := node.parent) is not None:
        holds.add(id(node))
    outside, free = plain[id(top)], 0
    stack: list[tuple[Node, bool]] = [(top, False)]
    while stack:  # articles outside marked elements
        node, _ = stack.pop()
        free += node.tag == "article"
        stack.extend((c, False) for c in node.children if not isinstance(c, str) and not c.gone and not c.named)
    stack = [(top, False)]
    while stack:
        node, inside = stack.pop()
        if node.named:
            links = node.link_chars * 2 >= node.chars
            if id(node) in holds and (inside or plain[id(node)] > outside):
                stays = True
            elif inside:
                stays = node.tag in _HEADS or (node.tag == "section" and node.by_id and not node.named & {"comment", "comments", "disqus"}) or (node.named <= SUBJECTS and not links)
            else:
                stays = bool(mains[id(node)] or (arts[id(node)] and not free))
            if not stays:
                node.gone = True
                continue
            if not inside:
                outside += plain[id(node)]
        inside = inside or node is core or node.tag == "article" or (node.tag == "main" and not arts[id(node)])
        stack.extend((c, inside) for c in reversed(node.children) if not isinstance(c, str) and not c.gone)


def drop_headers(top: Node) -> None:
    """Headers go, unless they are the heading of a text: with a heading and few links, inside an article or called so."""
    nodes = _order(top)
    if not any(n.header for n in nodes):
        return
    heads, links, held = Counter(), Counter(), set()
    for n in reversed(nodes):
        heads[id(n)] += n.tag in _HEADS
        links[id(n)] += n.tag == "a"
        if n.parent is not None:
            heads[id(n.parent)] += heads[id(n)]
            links[id(n.parent)] += links[id(n)]
    for n in nodes:
        if n.parent is not None and (n.parent.tag in ("article", "main") or id(n.parent) in held):
            held.add(id(n))
        if n.header:
            n.gone = not ((n.header == "text" or id(n) in held) and heads[id(n)] and links[id(n)] < 3)


def _extracting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; no shuffle."""
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return cut.mapInArrow(_extracting, "page_id long, url string, text string, n_chars long")
