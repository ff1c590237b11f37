"""Main text of pages by wrapper induction over the DOM trees of each host."""

from __future__ import annotations

import html
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.base import materialize

#: Constant text is template where it stands in pages of so many different articles, and in this share of the pages.
AGREE, SHARE = 4, 0.9
#: A text that several merged pages share is template where it stands on this share of all pages.
OFTEN = 0.5
#: Pages of a host and layout whose trees are merged into the reference, at most.
MERGED = 8
#: Marks what a merged page added to the reference, and what stands on several of the merged pages.
ADDED, SHARED = "data-added", "data-shared"
#: The content is the deepest node that holds this share of the varying text.
MAIN = 0.9
#: Pairs of runs of siblings from which their alignment is made by rows of numpy, which is faster there and finds the same.
RUN_PAIRS = 4096

# Fixed values of the HTML language and of page conventions.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and is never shown.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in "script style noscript iframe textarea title noembed noframes xmp".split()}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TABLE = {"table", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
OUTSIDE = set("nav footer aside form button select input option menu dialog head template svg canvas object audio video datalist header".split())
WORDS_OUTSIDE = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar rail widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus replies respond related recommended trending tags pagination pager copyright disclaimer search skip".split()
)
#: Words that may stand beside those in a class, as in comments-area or related-posts.
WORDS_BESIDE = set("area bar box block list section container wrapper wrap inner outer site page global main top bottom left right item items link links button buttons form posts articles stories inline panel row col column secondary primary header legal side popular reply".split())
ROLES_OUTSIDE = set("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
LANDMARKS = r"(?i)<(article|aside|footer|form|header|main|nav|section)[\s/>]"

#: Markup: comments, declarations and tags.  A quoted value begins only after an equals sign.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[^=>]++)*+)>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MARKED = re.compile(r"class|id|role|hidden|style", re.I)


def boilerplate(mark: str) -> bool:
    """Whether a class or id names something outside the content: all its parts do, or stand beside such a word."""
    parts = [p for p in re.split(r"[-_]", mark) if p]
    return any(p in WORDS_OUTSIDE for p in parts) and all(p in WORDS_OUTSIDE or p in WORDS_BESIDE for p in parts)


class Tree:
    """A DOM in document order: lists of nodes' tags, names (tag and classes), parents, and children (text or node)."""

    def __init__(self):
        self.tag, self.name, self.parent, self.outside, self.in_article = ["#page"], ["#page"], [0], [False], [False]
        self.children: list[list] = [[]]
        self.attributes, self.added, self.shared = [""], [False], [False]
        #: Texts in document order, each with its node, and the block that a node's text is part of (-1: none).
        self.texts: list[tuple[int, str]] = []
        self.block = [0]

    def say(self, text: str, node: int) -> None:
        self.children[node].append(text)
        self.texts.append((node, text))

    def add(self, tag: str, attributes: str, parent: int) -> int:
        name, outside = tag, tag in OUTSIDE
        if attributes and MARKED.search(attributes):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            classes = found.get("class", "").lower().split()
            name = ".".join([tag, *sorted(set(classes))])
            if tag not in ("html", "body", "article", "main"):
                outside = outside or any(map(boilerplate, {*classes, *found.get("id", "").lower().split()}))
            outside = outside or found.get("role", "").lower() in ROLES_OUTSIDE or "hidden" in found or "display:none" in found.get("style", "").lower().replace(" ", "")
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.added.append(ADDED in attributes)
        self.shared.append(SHARED in attributes)
        self.name.append(name)
        self.parent.append(parent)
        self.in_article.append(tag == "article" or self.in_article[parent])
        # an article's own header holds its title
        self.outside.append(outside and not (tag == "header" and self.in_article[parent]))
        self.children.append([])
        node = len(self.tag) - 1
        self.block.append(node if tag in BLOCKS else -1 if self.outside[-1] else self.block[parent])
        self.children[parent].append(node)
        if tag == "br":
            self.texts.append((parent, " "))
        return node

    def finish(self) -> Tree:
        """The blocks' own texts, with the phrases in them; child nodes; and a hash of every subtree, from the last node up."""
        self.kids = [[c for c in x if isinstance(c, int)] for x in self.children]
        pieces: list[list[str]] = [[] for _ in self.tag]
        for node, text in self.texts:
            if self.block[node] >= 0:
                pieces[self.block[node]].append(text)
        self.own = [squeezed(x) if x else "" for x in pieces]
        self.shape = [0] * len(self.tag)
        for i in range(len(self.tag) - 1, -1, -1):
            self.shape[i] = hash((self.name[i], self.own[i], *[self.shape[k] for k in self.kids[i]]))
        return self


def squeezed(pieces: list[str]) -> str:
    return " ".join("".join(html.unescape(x) if "&" in x else x for x in pieces).split())


#: What the open elements of a kind are for the next ones: places in the stack of the nearest block, paragraph, list item,
#: definition, cell, row, row group and of the nearest table or cell.
NONE = (-1,) * 8


def scope_of(tag: str, above: tuple, at: int) -> tuple:
    if tag not in BLOCKS:
        return above
    block, p, li, dd, cell, row, group, fence = above
    block, p = at, at if tag == "p" else -1
    if tag not in ("address", "div", "p"):
        li, dd = at if tag == "li" else -1, at if tag in ("dd", "dt") else -1
    if tag in TABLE:
        if tag in ("td", "th"):
            cell = fence = at
        elif tag == "tr":
            row, cell = at, -1
        elif tag in ("tbody", "thead", "tfoot"):
            group, row, cell = at, -1, -1
        else:
            cell, row, group, fence = -1, -1, -1, at
    return block, p, li, dd, cell, row, group, fence


def closed_at(tag: str, scope: tuple) -> int:
    """The place in the stack from which an opening tag closes what is open; -1: nothing."""
    _, p, li, dd, cell, row, group, _ = scope
    if tag == "li":
        return li if li >= 0 else p
    if tag in ("dd", "dt"):
        return dd if dd >= 0 else p
    if tag in ("td", "th"):
        return cell
    if tag == "tr":
        return row
    if tag in ("tbody", "thead", "tfoot"):
        return group if group >= 0 else row
    return p if tag in BLOCKS and tag not in ("html", "body", "caption") else -1


def parse(page: str) -> Tree:
    """A forgiving DOM: unclosed and stray tags are repaired as browsers do, in time linear in the page's length."""
    tree = Tree()
    size = page.rfind(">") + 1
    stack, scopes, places, at = [0], [NONE], {}, 0

    def cut(place: int) -> None:
        for i in range(len(stack) - 1, place - 1, -1):
            places[tree.tag[stack[i]]].pop()
        del stack[place:], scopes[place:]

    while at < size:
        m = TOKEN.search(page, at, size)
        text = page[at : m.start()] if m else page[at:size]
        if text:
            tree.say(text, stack[-1])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_ := places.get(tag):
                block, fence = scopes[-1][0], scopes[-1][-1]
                # the end of a phrase doesn't close blocks inside it, and nothing ends beyond its table cell
                if open_[-1] >= (fence if tag in BLOCKS and tag not in TABLE else -1 if tag in TABLE else block):
                    cut(open_[-1])
            elif tag == "br":
                tree.add("br", "", stack[-1])
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag == "body" and places.get("head"):
            cut(places["head"][-1])
        if (place := closed_at(tag, scopes[-1])) > 0:
            cut(place)
        if tag in HEADINGS and tree.tag[stack[-1]] in HEADINGS:
            cut(len(stack) - 1)
        node = tree.add(tag, m[3], stack[-1])
        if tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            scopes.append(scope_of(tag, scopes[-1], len(stack)))
            stack.append(node)
    # after the last markup: text, up to a tag that never ends
    if at <= size and (rest := re.split(r"<[a-zA-Z/!?]", page[size:], maxsplit=1)[0]):
        tree.say(rest, stack[-1])
    return tree.finish()


def rising(places: list[int]) -> list[int]:
    """Indexes of a longest rising subsequence."""
    tops, ends, before = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        before.append(ends[k - 1] if k else -1)
        tops[k : k + 1], ends[k : k + 1] = [p], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def runs_of(names: list[str]) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for i, n in enumerate(names):
        if out and out[-1][0] == n:
            out[-1] = (n, out[-1][1], i + 1)
        else:
            out.append((n, i, i + 1))
    return out


def aligned_runs(xs: list[tuple], ys: list[tuple]) -> list[tuple[int, int]]:
    """Runs of siblings of equal names, matched in order so that most siblings have a partner, by dynamic programming.

    Long lists are gone through by rows of numpy, of which every few are kept and the others made again on the way back: the
    same sums and the same way.
    """
    return _by_rows(xs, ys) if len(xs) * len(ys) > RUN_PAIRS else _by_cells(xs, ys)


def _by_cells(xs: list[tuple], ys: list[tuple]) -> list[tuple[int, int]]:
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, (n, a, b) in enumerate(xs):
        for j, (o, c, d) in enumerate(ys):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + min(b - a, d - c) if n == o else 0)
    out: list[tuple[int, int]] = []
    way_back(best, 0, len(xs), len(ys), out)
    return out


def way_back(best, i0: int, i: int, j: int, out: list[tuple[int, int]]) -> int:
    """The pairs of rows above ``i0``, from cell (i, j) on, and the column reached; ``best`` begins with row ``i0``."""
    while i > i0 and j:
        if best[i - i0][j] == best[i - i0 - 1][j]:
            i -= 1
        elif best[i - i0][j] == best[i - i0][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return j


def _by_rows(xs: list[tuple], ys: list[tuple]) -> list[tuple[int, int]]:
    code = {n: k for k, n in enumerate(dict.fromkeys(y[0] for y in ys))}
    names, sizes = np.array([code[y[0]] for y in ys]), np.array([d - c for _, c, d in ys])

    def after(row: np.ndarray, i: int) -> np.ndarray:
        n, a, b = xs[i]
        if n not in code:
            return row
        new = row.copy()
        hit = np.flatnonzero(names == code[n])
        new[hit + 1] = np.maximum(row[hit + 1], row[hit] + np.minimum(b - a, sizes[hit]))
        return np.maximum.accumulate(new)

    step = math.isqrt(len(xs)) + 1
    kept, row = [], np.zeros(len(ys) + 1, np.int64)
    for i in range(len(xs)):
        if i % step == 0:
            kept.append(row)
        row = after(row, i)
    out, j = [], len(ys)
    for k in range(len(kept) - 1, -1, -1):
        first, last = k * step, min((k + 1) * step, len(xs))
        rows = [kept[k]]
        for i in range(first, last):
            rows.append(after(rows[-1], i))
        j = way_back(rows, first, last, j, out)
    return out


def aligned(a: Tree, b: Tree, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
    """An order-keeping match of siblings: equal subtrees first, then siblings of equal names between these."""
    out, lo = [], 0
    while lo < min(len(xs), len(ys)) and a.shape[xs[lo]] == b.shape[ys[lo]]:
        lo += 1
    ends = len(xs), len(ys)
    while min(ends) > lo and a.shape[xs[ends[0] - 1]] == b.shape[ys[ends[1] - 1]]:
        ends = ends[0] - 1, ends[1] - 1
    out += list(zip(xs[:lo], ys[:lo], strict=True)) + list(zip(xs[ends[0] :], ys[ends[1] :], strict=True))
    xs, ys = xs[lo : ends[0]], ys[lo : ends[1]]
    if not xs or not ys:
        return out
    once = Counter(a.shape[x] for x in xs), Counter(b.shape[y] for y in ys)
    at = {b.shape[y]: j for j, y in enumerate(ys) if once[1][b.shape[y]] == 1}
    both = [(i, at[a.shape[x]]) for i, x in enumerate(xs) if once[0][a.shape[x]] == 1 and a.shape[x] in at]
    fixed = [both[k] for k in rising([j for _, j in both])]
    i0 = j0 = 0
    for i, j in [*fixed, (len(xs), len(ys))]:
        if i > i0 and j > j0:
            rx, ry = runs_of([a.name[x] for x in xs[i0:i]]), runs_of([b.name[y] for y in ys[j0:j]])
            for k, m in aligned_runs(rx, ry):
                # in a list, another text isn't evidence against a text that pages share
                run = xs[i0 + rx[k][1] : i0 + rx[k][2]]
                out += zip([x for x in run if not a.shared[x]] or run, ys[j0 + ry[m][1] : j0 + ry[m][2]], strict=False)
        if i < len(xs):
            out.append((xs[i], ys[j]))
        i0, j0 = i + 1, j + 1
    return out


def matching(a: Tree, b: Tree) -> Iterator[tuple[int, int]]:
    """Simple tree matching of two pages from the root down: pairs of nodes, children only below matched parents.

    Siblings that repeat one name are aligned as one run, so a page with a longer list or text costs time in proportion
    to its length.
    """
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        yield x, y
        if a.kids[x] and b.kids[y]:
            todo += zip(a.kids[x], b.kids[y], strict=True) if a.shape[x] == b.shape[y] else aligned(a, b, a.kids[x], b.kids[y])


def union(pages: list[str]) -> str:
    """The trees of some pages of one host and layout in one, as html."""
    trees = [parse(p) for p in pages]
    shared = Counter(t for tree in trees for t in {x for x in tree.own if x})
    first, whole = trees[0], pages[0]
    for tree in trees[1:]:
        whole = merged(first, tree, {t for t, n in shared.items() if n > 1})
        first = parse(whole)
    return whole


def merged(a: Tree, b: Tree, shared: set[str] = frozenset()) -> str:
    """The union of two pages as html: the first one, with the nodes of the second that have no partner in it.

    These stand behind the partner of the sibling before them, and are marked; a block without text gets that of its partner.
    A block with a ``shared`` text, which stands on several pages, has none but a block of that text, so that it isn't
    lost in a list of others of its name.
    """
    partner, own, alone = {}, set(a.own), set()
    for x, y in matching(a, b):
        text = b.own[y]
        if b.parent[y] in alone or text in shared and text not in own and not any(b.tag[k] in BLOCKS for k in b.kids[y]):
            alone.add(y)
        else:
            partner[x] = y
    back = {y: x for x, y in partner.items()}
    out: list[str] = []
    todo: list = [(a, 0)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        tree, x = item
        children = [c if isinstance(c, str) else (tree, c) for c in tree.children[x]]
        if tree is a and x in partner:
            y, last, behind = partner[x], None, {}
            for k in b.kids[y]:
                if k in back:
                    last = back[k]
                else:
                    behind.setdefault(last, []).append((b, k))
            children = [*behind.get(None, []), *[c for child in children for c in ([child] if isinstance(child, str) else [child, *behind.get(child[1], [])])]]
            if not a.own[x] and b.own[y]:
                children += [t for t in b.children[y] if isinstance(t, str)]
        if x:
            mark = f' {ADDED}=""' * (tree is b) + f' {SHARED}=""' * (tree.own[x] in shared and not tree.shared[x])
            out.append(f"<{tree.tag[x]}{tree.attributes[x].rstrip('/ ')}{mark}>")
            if tree.tag[x] in VOID:
                continue
            children.append(f"</{tree.tag[x]}>")
        todo += reversed(children)
    return "".join(out)


def compared(reference: Tree, page: Tree) -> tuple[int, list[tuple[int, bool, int]]]:
    """What a page tells about its reference's blocks with text: a bit for its article, and (node, same text, characters).

    The bit, one of 64, stands for the longest text that the reference hasn't.  A page of which half stands in the
    reference's first page is a copy of it and tells nothing (bit 0).
    """
    found, same = [], set()
    for x, y in matching(reference, page):
        if reference.own[x] and not reference.outside[x]:
            found.append((x, reference.own[x] == page.own[y], len(page.own[y])))
            if found[-1][1] and not reference.added[x]:
                same.add(y)
    shown = [(t, i in same) for i, (t, o) in enumerate(zip(page.own, page.outside, strict=True)) if t and not o]
    own = [t for t, s in shown if not s]
    if sum(map(len, own)) * 2 < sum(len(t) for t, _ in shown) or not own:
        return 0, []
    bit = 1 << zlib.crc32(max(own, key=len).encode("utf-8", "surrogatepass")) % 64
    return bit - (1 << 64) if bit >> 63 else bit, found


class Wrapper:
    """What a host's pages of one layout have in common, on the merged tree of some of them.

    ``counts`` are of its blocks with text: (node, pages, same, articles, varying).  Blocks whose text is the same in SHARE of the pages, over AGREE
    different articles, are template; the others are slots.  The content is the deepest node that holds MAIN of
    the slots' text.  Node -1 counts the pages; with fewer articles than AGREE, the
    reference's own included, nothing is known.
    """

    def __init__(self, reference: str, counts: list[tuple[int, int, int, int, int]]):
        self.tree = t = parse(reference)
        self.template, self.root = set(), None
        about = next((x[3] for x in counts if x[0] == -1), 0)
        if (about & (1 << 64) - 1).bit_count() < AGREE - 1:
            return
        # what a merged page added counts that page, too
        enough = [AGREE if added else AGREE - 1 for added in t.added]
        pages = max((x[1] for x in counts if x[0] == -1), default=0)
        counts = [x for x in counts if x[0] >= 0]
        held = [OFTEN * pages if shared else 0 for shared in t.shared]
        self.template = {i for i, n, same, articles, _ in counts if same >= max(SHARE * n, held[i]) and (articles & (1 << 64) - 1).bit_count() >= enough[i]}
        mass = [0] * len(t.tag)
        for i, _, _, _, varying in counts:
            if i not in self.template:
                mass[i] += varying
        for i in range(len(mass) - 1, 0, -1):
            if not t.outside[i]:
                mass[t.parent[i]] += mass[i]
        if total := mass[0]:
            self.root = 0
            while inner := next((k for k in t.kids[self.root] if t.tag[k] in BLOCKS - HEADINGS - {"p", "li", "ul", "ol", "dl", "dd", "dt", "blockquote", "pre", "tr", "td", "th", "tbody"} and not t.outside[k] and mass[k] >= MAIN * total), None):
                self.root = inner

    @classmethod
    def known(cls, reference: str, template: Iterable[int], root: int | None) -> Wrapper:
        """The wrapper whose template nodes and content node are already found."""
        out = cls(reference, [])
        out.template, out.root = set(template), root
        return out


def enclosing(tree: Tree, node: int) -> int:
    """The article around a node; without one, the nearest node below the body that also holds the page's first heading."""
    up, article = node, None
    while up:
        if tree.tag[up] == "article":
            article = up
        up = tree.parent[up]
    if article is not None:
        return article
    title = next((i for i, t in enumerate(tree.tag) if t == "h1"), None)
    above = set()
    while title:
        if tree.outside[title]:
            return node
        title = tree.parent[title]
        above.add(title)
    up = node
    while above and up and up not in above:
        up = tree.parent[up]
    return up if above and tree.tag[up] not in ("#page", "html", "body") else node


def content_nodes(tree: Tree, chosen: int | None) -> list[int]:
    """The chosen node; without one, outermost articles, else main, the body, or all."""
    if chosen is not None and tree.tag[chosen] not in ("#page", "html"):
        node = enclosing(tree, chosen)
        if tree.tag[node] == "article":
            return [k for k in tree.kids[tree.parent[node]] if tree.name[k] == tree.name[node]]
        if tree.tag[node] != "body":
            return [node]
    inside = [False] * len(tree.tag)
    for i in range(1, len(inside)):
        inside[i] = inside[tree.parent[i]] or tree.tag[tree.parent[i]] == "article"
    found = [i for i, t in enumerate(tree.tag) if t == "article" and not inside[i]]
    return found or [i for i, t in enumerate(tree.tag) if t == "main"][:1] or [i for i, t in enumerate(tree.tag) if t == "body"][:1] or [0]


def text_blocks(tree: Tree, top: int, template: set[int]) -> Iterator[str]:
    """The text blocks below a node in page order, without template texts and marked elements."""
    line: list[str] = []
    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            if text := squeezed(line):
                yield text
            line.clear()
        elif isinstance(x, str):
            line.append(x)
        elif tree.tag[x] == "br":
            line.append(" ")
        elif x == top or not tree.outside[x]:
            inner = tree.kids[x] if tree.block[x] in template else tree.children[x]
            if tree.tag[x] in BLOCKS:
                todo += [None, *reversed(inner), None]
            else:
                todo += reversed(inner)
    if text := squeezed(line):
        yield text


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of one page under its host's wrapper."""
    if not page:
        return ""
    tree = parse(page)
    template, chosen = set(), None
    if wrapper is not None and (wrapper.template or wrapper.root is not None):
        for x, y in matching(wrapper.tree, tree):
            if x in wrapper.template and wrapper.tree.own[x] == tree.own[y]:
                template.add(y)
            if x == wrapper.root:
                chosen = y
    return "\n\n".join(b for node in content_nodes(tree, chosen) for b in text_blocks(tree, node, template))


class Remembered(dict):
    """Values of keys met lately; emptied when large, which bounds memory only."""

    def get_or(self, key, make):
        if key not in self:
            if len(self) >= 500:
                self.clear()
            self[key] = make()
        return self[key]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def layout_of(page: Column) -> Column:
    """Which landmark elements a page has, as a text: pages that differ in them are built by different templates."""
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(page, F.lit(LANDMARKS), F.lit(1)), F.lower))), " "), F.lit(""))


def dealt(pages: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """All pages with what is known of their host and layout: one exchange of the pages serves every such join of a query."""
    return pages.join(known, ["_host", "_layout"], "left").select("page_id", "url", "html", "_host", "_layout", *columns)


COUNTS = "_host string, _layout string, node int, n long, same long, articles long, varying long"


def wrappers(pages: DataFrame) -> DataFrame:
    """Rows (_host, _layout, reference, template, root): of each host and layout a reference tree, its template nodes and its content node.

    The reference is the page with the least hash, with the trees of ``MERGED`` - 1 others, least by other hashes, merged into it one by
    one, so that what stands on a good part of the pages is in it.  Every page is aligned with its reference, and the counts of
    its nodes are summed on the map side, so no host is gathered in one task.  The pages are joined with all their columns and rows, as
    ``main_text`` joins them again, so that Spark deals the whole html out once for both.
    """
    some = pages.where("html <> ''").select("_host", "_layout", "html")
    hashes = [F.xxhash64("html"), *[F.xxhash64("html", F.lit(k)) for k in range(1, MERGED)]]
    picked = some.groupBy("_host", "_layout").agg(*[F.min(F.struct(h.alias("h"), "html")).alias(f"p{k}") for k, h in enumerate(hashes)])
    picked = picked.select("_host", "_layout", F.array_distinct(F.array(*[F.col(f"p{k}.html") for k in range(MERGED)])).alias("pages"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = pd.Series([union(list(p)) for p in batch["pages"]], dtype=object)
            yield pd.DataFrame({"_host": batch["_host"].astype(object), "_layout": batch["_layout"].astype(object), "reference": whole})

    references = materialize(picked.mapInPandas(merge, "_host string, _layout string, reference string"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = Remembered()
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for host, layout, page, reference in zip(batch["_host"], batch["_layout"], batch["html"], batch["reference"], strict=True):
                if not page or not isinstance(reference, str):
                    continue
                bit, found = compared(trees.get_or((host, layout), lambda r=reference: parse(r)), parse(page))
                for node, same, chars in [(-1, True, 0), *found] if bit else ():
                    at = sums.setdefault((host, layout, node), [0, 0, 0, 0])
                    at[0] += 1
                    if same:
                        at[1] += 1
                        at[2] |= bit
                    else:
                        at[3] += chars
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["_host", "_layout", "node", "n", "same", "articles", "varying"])

    counts = dealt(pages, references, "reference").mapInPandas(count, COUNTS)
    counts = counts.groupBy("_host", "_layout", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.bit_or("articles").alias("articles"), F.sum("varying").alias("varying"))
    # a list is as long as its reference page has nodes
    lists = counts.groupBy("_host", "_layout").agg(F.sort_array(F.collect_list(F.struct("node", "n", "same", "articles", "varying"))).alias("counts"))

    def induce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, layout, reference, about in zip(batch["_host"], batch["_layout"], batch["reference"], batch["counts"], strict=True):
                wrapper = Wrapper(reference, [(x["node"], x["n"], x["same"], x["articles"], x["varying"]) for x in about])
                rows.append((host, layout, reference, sorted(wrapper.template), -1 if wrapper.root is None else wrapper.root))
            yield pd.DataFrame(rows, columns=["_host", "_layout", "reference", "template", "root"])

    return references.join(lists, ["_host", "_layout"]).mapInPandas(induce, "_host string, _layout string, reference string, template array<int>, root int")


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of whole pages: (page_id, url, text, n_chars), a row for each row of ``pages``.

    Of each host and layout (the landmark elements of a page) some pages are merged into a reference tree and every page is
    aligned with it by simple tree matching.  Blocks whose text stays the same over pages of different articles are
    template and dropped, also inside articles; the content is where the text varies.  Among varying nodes those that tags,
    roles and class names mark as menus, adverts, notices, forms or comments are left out.  Copies of one article count once, so
    they don't become template; a host with fewer than AGREE articles of a layout has no template.

    Null and empty html has an empty text; pages with a null or odd url share one host; null ids stay; repeated
    rows are extracted alike; of equal hashes the lesser html is the reference; a very long page takes time in proportion to its
    length, and any depth of nesting; an empty table gives no rows; other columns are not used.
    """
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_host"), layout_of(F.col("html")).alias("_layout"))
    found = wrappers(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Remembered()
        for batch in batches:
            texts = []
            for host, layout, page, reference, template, root in zip(*[batch[c] for c in ("_host", "_layout", "html", "reference", "template", "root")], strict=True):
                wrapper = None
                if isinstance(reference, str):
                    wrapper = known.get_or((host, layout), lambda r=reference, t=template, x=root: Wrapper.known(r, t, None if x < 0 else int(x)))
                texts.append(extract(page, wrapper))
            yield batch[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    return dealt(pages, found, "reference", "template", "root").mapInPandas(run, "page_id long, url string, text string, n_chars long")
