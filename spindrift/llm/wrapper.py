"""Main text of pages by wrapper induction over the pages of a host.

Each page is parsed to a DOM tree, of which block elements and the runs of text between them are slots. Trees of one
host are aligned by simple tree matching (ordered, top-down, the most matching slots). The host's tree is
induced from all its pages, form by form (pages of the same labels and nesting are one form), merged in an order that doesn't depend on how rows are
dealt. All its pages are then aligned with it, and counted per slot are its characters and, for each text in it, the pages
that hold this text, and per slot the pages that hold an element or run of this label and text anywhere among its children: sums
that no order changes. Texts of half the host's pages at one slot, or anywhere below one parent, are template, varying slots
are content. Last, each page is aligned again and its text taken from content slots. Names of the markup (article, nav, ad,
comments ...) are a second vote, where the tree leaves it open which of a page's varying parts is the article, and the only
one on a page without a tree.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import kept_table

# Names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_NO_TEXT = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object svg canvas audio video menu dialog title".split())
_CLOSES_P = _BLOCK - frozenset("html body li dd dt td th tr tbody thead tfoot option optgroup legend summary".split())
_CLOSED_BY = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
_HOLDS = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "option": frozenset(("select",))}
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements whose content is never shown as text of the page.
_NEVER = _NO_TEXT - frozenset("nav footer aside menu dialog".split())
#: Words in class, id or role that name what isn't main text.
_ASIDE = frozenset("ad ads advert adverts advertisement banner banners breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disclaimer disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar widget".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|(?:^|\s)aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_WORD = re.compile(r"[A-Za-z]+")


#: Elements nested deeper are children of the one at this depth; their text and its boundaries stay.
MOST_DEPTH = 100


def _told(text: str) -> str:
    """A run's text as trees hold it: a long one as its beginning and the digest of all of it."""
    return text if len(text) <= 200 else text[:160] + digest(text)


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


class Node:
    """An element: ``label`` is its tag with class names; text of its own is a child of tag ``#``.

    ``aside`` is what its names say, ``never`` that its content isn't text, ``drop`` what the host's tree says (None: nothing),
    ``said`` the digest of its labels and texts, made once.
    """

    __slots__ = ("aside", "children", "drop", "items", "label", "never", "said", "tag", "text")

    def __init__(self, tag: str, label: str, aside: bool = False, never: bool = False, text: str = ""):
        self.tag, self.label, self.aside, self.never, self.text = tag, label, aside, never, text
        self.children: list[Node] = []
        self.items: list | None = None
        self.drop: bool | None = None
        self.said: str | None = None


def parse(page: str, names: bool = True) -> Node:
    """The DOM tree. Missing end tags are supplied where HTML does; stray ones are passed over. Without ``names`` nothing is an aside."""
    root = Node("#root", "#root")
    stack, into, held, at = [root], [root], {"#root": 1}, 0  # open elements; where their content goes; how many of each tag

    def say(raw: str) -> None:
        if raw:
            into[-1].children.append(Node("#", "#", text=html.unescape(raw) if "&" in raw else raw))

    def close(i: int) -> None:
        deep = len(stack) > MOST_DEPTH
        for n in stack[i:]:
            held[n.tag] -= 1
        ended = stack[i]
        del stack[i:], into[i:]
        if deep and ended.tag in _BLOCK and into[-1] is not ended:
            into[-1].children.append(Node(ended.tag, ended.tag))  # the boundary at its end

    def close_p() -> None:
        if held.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    return
                if stack[i].tag not in _INLINE:
                    return

    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if held.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if tag in _INLINE and stack[i].tag in _BLOCK:
                        break
        elif m[2]:
            tag, attributes = m[2].lower(), m[3] or ""
            if tag in _CLOSES_P:
                close_p()
            if tag in _CLOSED_BY and any(held.get(x) for x in _CLOSED_BY[tag]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in _CLOSED_BY[tag]:
                        close(i)
                        break
                    if stack[i].tag in _HOLDS[tag]:
                        break
            said = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
            label = f"{tag}.{said}" if said else tag
            never = tag in _NEVER or bool(attributes and _HIDDEN.search(attributes))
            node = Node(tag, label, names and (never or aside_label(label)), never)
            into[-1].children.append(node)
            if tag in _RAW:
                end = re.compile(rf"</{tag}[\s/>]|\Z", re.I).search(page, at)
                if tag == "textarea" or tag == "title":
                    node.children.append(Node("#", "#", text=html.unescape(page[at : end.start()])))
                at = page.find(">", end.start()) + 1 or len(page)
            elif tag not in _VOID and not attributes.endswith("/"):
                inside = into[-1] if len(stack) > MOST_DEPTH and (not (node.aside or node.never) or into[-1].aside or into[-1].never) else node
                stack.append(node)
                into.append(inside)
                held[tag] = held.get(tag, 0) + 1
    say(page[at:])
    return root


@lru_cache(10_000)
def aside_label(label: str) -> bool:
    """Whether names say that an element isn't main text."""
    tag, _, names = label.partition(".")
    return tag in _NO_TEXT or (tag not in ("html", "body", "article", "main") and bool(names) and not _ASIDE.isdisjoint(w.lower() for w in _WORD.findall(names)))


# ---------------------------------------------------------------- trees
# A slot is [label, pages, text or None (varying), children, chars, consts, members]. Slots are block elements and, labelled
# "#", runs of text between them. ``consts`` of a finished run slot are the digests of its constant texts with their characters
# (``None`` before counting), ``members`` the page's own elements or runs that were folded into the slot; in a host's counted tree,
# which has no members, the digests of what stands anywhere among the slot's children on half the pages.
MOST_NODES, FEWEST = 400, 4
#: Forms of pages that are merged in one go.
FORMS = 64
_ITEMS = frozenset("# p li dt dd tr td th option h2 h3 h4".split())
_ROW = 8
_CONTAINERS = frozenset("address article aside body center details div footer header hgroup html main menu nav section".split())
#: Over so many pairs of children the same alignment is computed by numpy, with few rows of scores in memory.
_CELLS = 2_000


class Run:
    """Text between two block boundaries."""

    __slots__ = ("constant", "drop", "text")

    def __init__(self, text: str):
        self.text, self.constant, self.drop = text, False, None


def content(node: Node) -> list:
    """Block elements and runs of ``node`` in order, made once; inline elements are transparent, what is never text goes."""
    if node.items is None:
        part: list[str] = []
        node.items = []
        _collect(node, part, node.items)
        _flush(part, node.items)
    return node.items


def _flush(part: list[str], out: list) -> None:
    if part:
        if s := " ".join("".join(part).split()):
            out.append(Run(s))
        part.clear()


def _collect(n: Node, part: list[str], out: list) -> None:  # no closures that hold themselves: pages are to be freed at once
    for c in n.children:
        if c.tag == "#":
            part.append(c.text)
        elif c.tag == "br":
            part.append(" ")
        elif c.tag in _BLOCK:
            _flush(part, out)
            if not c.never:
                out.append(c)
        elif not c.never and not c.aside:
            _collect(c, part, out)


def shape(node: Node) -> list:
    """A page's tree as slots. Items that repeat in a row are one slot, and so are long rows of any one label."""
    children: list = []
    row = 0
    for c in content(node):
        if isinstance(c, Run):
            s = ["#", 1, _told(c.text), [], len(c.text), None, [c]]
        else:
            s = shape(c)
        row = row + 1 if children and children[-1][0] == s[0] else 1
        if row > 1 and ((s[0] == "#" or c.tag in _ITEMS) or row > _ROW):
            children[-1] = _join(children[-1], s, children[-1][1])
        else:
            children.append(s)
    return [node.label, 1, None, children, 0, None, [node]]


def _size(t: list) -> int:
    return 1 + sum(map(_size, t[3]))


def _match(a: list, b: list, known: dict | None = None) -> tuple[int, list]:
    """Simple tree matching of two slots of one label: matched slots, and the aligned children."""
    known = {} if known is None else known
    key = (id(a), id(b))
    if key in known:
        return known[key]
    x, y = a[3], b[3]
    if not x or not y:
        known[key] = (1, [])
        return known[key]
    xs, ys = [c[0] for c in x], [c[0] for c in y]
    if xs == ys and (len(xs) == 1 or len(set(xs)) == len(xs)):
        pairs = [(i, i) for i in range(len(x))]
    elif len(x) * len(y) > _CELLS:
        pairs = _best_of_many(x, y, known)
    else:
        pairs = _best(x, y, known)
    known[key] = (1 + sum(_match(x[i], y[j], known)[0] for i, j in pairs), pairs)
    return known[key]


def _best(x: list, y: list, known: dict) -> list[tuple[int, int]]:
    """The ordered alignment of most matched slots."""
    score = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    got: dict[tuple[int, int], int] = {}
    for i in range(len(x) - 1, -1, -1):
        below, own = score[i + 1], score[i]
        for j in range(len(y) - 1, -1, -1):
            best = max(below[j], own[j + 1])
            if x[i][0] == y[j][0]:
                got[i, j] = _match(x[i], y[j], known)[0]
                best = max(best, below[j + 1] + got[i, j])
            own[j] = best
    pairs, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if (i, j) in got and score[i][j] == score[i + 1][j + 1] + got[i, j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif score[i][j] == score[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs


def _form(t: list, forms: dict[tuple, int]) -> int:
    """A number for a slot's labels and their nesting, which are all that its matches depend on."""
    return forms.setdefault((t[0], *[_form(c, forms) for c in t[3]]), len(forms))


def _best_of_many(x: list, y: list, known: dict) -> list[tuple[int, int]]:
    """What ``_best`` gives, for long rows: slots of one form are matched once, and of the scores every so many rows are kept and those between made again."""
    forms: dict[tuple, int] = {}
    own, others = [_form(c, forms) for c in x], [_form(c, forms) for c in y]
    first = {f: y[j] for j, f in reversed(list(enumerate(others)))}
    place = {f: k for k, f in enumerate(first)}
    column = np.array([place[f] for f in others])
    like: dict[str, list[list]] = {}
    for f, d in first.items():
        like.setdefault(d[0], []).append([place[f], d])
    worth: dict[int, dict[int, int]] = {}  # by form, the matches with each form of its label
    for c, f in zip(x, own, strict=True):
        if f not in worth:
            worth[f] = {k: _match(c, d, known)[0] for k, d in like.get(c[0], [])}

    def above(i: int, below: np.ndarray) -> np.ndarray:
        table = np.zeros(len(first), np.int64)
        table[list(worth[own[i]])] = list(worth[own[i]].values())
        w = table[column]
        row = below.copy()
        np.maximum(row[:-1], np.where(w > 0, below[1:] + w, 0), out=row[:-1])
        return np.maximum.accumulate(row[::-1])[::-1]

    step = int(len(x) ** 0.5) + 1
    below = np.zeros(len(y) + 1, np.int64)
    kept = {len(x): below}
    for i in range(len(x) - 1, -1, -1):
        below = above(i, below)
        if i % step == 0:
            kept[i] = below
    pairs, i, j = [], 0, 0
    for start in range(0, len(x), step):
        end = min(len(x), start + step)
        rows = {end: kept[end]}
        for k in range(end - 1, start - 1, -1):
            rows[k] = above(k, rows[k + 1])
        while i < end and j < len(y):
            w = worth[own[i]].get(int(column[j]), 0)
            if w and rows[i][j] == rows[i + 1][j + 1] + w:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif rows[i][j] == rows[i + 1][j]:
                i += 1
            else:
                j += 1
    return pairs


def _join(a: list, b: list, pages: int | None = None, known: dict | None = None) -> list:
    """Both trees aligned and merged; ``pages`` for equal siblings of one page, whose members stay."""
    known = {} if known is None else known
    if pages is not None and len(a[3]) == len(b[3]) == 1 and a[3][0][0] == b[3][0][0] == "#":
        pairs = [(0, 0)]
    elif not a[3] and not b[3]:
        pairs = []
    else:
        pairs = _match(a, b, known)[1]
    children, i, j = [], 0, 0
    for p, q in [*pairs, (len(a[3]), len(b[3]))]:
        children += a[3][i:p] + b[3][j:q]
        if p < len(a[3]):
            children.append(_join(a[3][p], b[3][q], None if pages is None else max(a[3][p][1], b[3][q][1]), known))
        i, j = p + 1, q + 1
    members = [] if pages is None else a[6]
    if pages is not None:
        members += b[6]
    return [a[0], a[1] + b[1] if pages is None else pages, a[2] if a[2] == b[2] else None, children, a[4] + b[4], None, members]


def merge(a: list | None, b: list) -> list:
    """Two hosts' trees in one; over MOST_NODES slots those on the fewest pages go (they are content anyway).

    Only slots on fewer than one in FEWEST of the merged pages go, so that a tree has FEWEST times the slots of a page at most.
    """
    t = b if a is None else _join(a, b)
    least = 2
    while least * FEWEST <= t[1] and _size(t) > MOST_NODES:
        t = _pruned(t, least)
        least *= 2
    return t


def _pruned(t: list, least: int) -> list:
    return [*t[:3], [_pruned(c, least) for c in t[3] if c[1] >= least], *t[4:]]


def _bare(t: list) -> list:
    """What is kept of a page's tree: labels and their nesting."""
    return [t[0], 1, None, [_bare(c) for c in t[3]], 0, None, []]


def _times(t: list, n: int) -> list:
    """A tree of so many times the pages."""
    return t if n == 1 else [t[0], t[1] * n, t[2], [_times(c, n) for c in t[3]], *t[4:]]


def _counted(t: list, chars: dict[int, int], consts: dict[int, dict[str, int]], moved: dict[int, list[str]], pages: int, at: list[int]) -> list:
    """A host's tree with counts from all its pages, by preorder number."""
    k = at[0]
    at[0] += 1
    return [t[0], pages if k == 0 else t[1], t[2], [_counted(c, chars, consts, moved, pages, at) for c in t[3]], chars.get(k, 0), consts.get(k, {}), moved.get(k, [])]


def _said(m: Node | Run) -> str:
    """The digest of an element's labels and texts, or of a run."""
    if isinstance(m, Run):
        return digest("#" + m.text)
    if m.said is None:
        m.said = digest("\0".join([m.label, *map(_said, content(m))]))
    return m.said


def _among(c: list, t: list) -> Iterator[Node | Run]:
    """The elements and runs among the children of a page's slot, if its place ``t`` has more than one slot for them."""
    if len(t[3]) > 1:
        for s in c[3]:
            yield from s[6]


def _made_constant(m: Node | Run) -> None:
    if isinstance(m, Run):
        m.constant = True
    else:
        for c in content(m):
            _made_constant(c)


# ---------------------------------------------------------------- what a host's tree says
def _weigh(t: list, pages: int, found: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """``found[id(slot)]``: characters of a slot's texts that vary, and of all."""
    total = t[4]
    if t[5] is not None:
        varying = total - sum(t[5].values())
    elif t[0] == "#" and t[2] and t[1] >= max(4, 0.5 * pages):
        varying = 0
    else:
        varying = total
    for c in t[3]:
        v, n = _weigh(c, pages, found)
        varying, total = varying + v, total + n
    found[id(t)] = (varying, total)
    return found[id(t)]


def _titles(t: list) -> bool:
    return any(_tag(c) in ("h1", "h2") or _titles(c) for c in t[3])


def _tag(t: list) -> str:
    return t[0].split(".", 1)[0]


class Wrapper:
    """A host's tree with its judgement: ``dropped`` slots hold no content, the others do."""

    def __init__(self, tree: list, names: bool = True, judged: bool = True):
        self.tree, self.names = tree, names
        self.weights: dict[int, tuple[int, int]] = {}
        self.dropped: set[int] = set()
        self.beside: dict[int, set[int]] = {}  # dropped slots that only go beside one of these siblings
        if judged:
            _weigh(tree, tree[1], self.weights)
            self._judge(tree)

    def _judge(self, t: list) -> None:
        """The tree's vote is a slot's share of the varying text of its parent; names decide between what it leaves open.

        Constant containers are template (constant texts elsewhere are told apart run by run). Beside one that holds four fifths of what varies, containers with under a tenth go, unless they
        hold a title. Elements named as asides go unless nine tenths are in them; if a quarter is in an article or main, its
        untitled siblings go. What goes for its sibling's sake stays on pages without that sibling, as those of a rarer layout.
        """
        varying = self.weights[id(t)][0]
        if not varying:
            return
        share = {id(c): self.weights[id(c)][0] / varying for c in t[3]}
        large = {id(c) for c in t[3] if share[id(c)] >= 0.8 and _tag(c) in _CONTAINERS}
        articles = {id(c) for c in t[3] if _tag(c) in ("article", "main")}
        named = self.names and any(share[c] >= 0.25 for c in articles)
        for c in t[3]:
            tag, s = _tag(c), share[id(c)]
            titled = tag in ("h1", "h2") or _titles(c)
            gone = False
            if c[0] != "#" and not self.weights[id(c)][0]:
                gone = (tag in _CONTAINERS and 0 < self.weights[id(c)][1] <= 4 * varying) or (self.names and aside_label(c[0]))
            elif self.names and (aside_label(c[0]) or (tag == "header" and not titled)):
                gone = s < 0.9
            elif named and tag not in ("article", "main"):
                gone = not titled
                self.beside[id(c)] = articles
            elif large and tag in _CONTAINERS:
                gone = s < 0.1 and not titled
                self.beside[id(c)] = large
            if gone:
                self.dropped.add(id(c))
            else:
                self._judge(c)

    def constant(self, t: list, text: str) -> bool:
        if t[5] is not None:
            return bool(t[5]) and digest(text) in t[5]
        return t[2] is not None and t[1] >= max(4, 0.5 * self.tree[1]) and t[2] == _told(text)

    def places(self, page: list, alone: set[int] | None = None) -> Iterator[tuple[list, list]]:
        """Each slot of a page's tree that has a place in the host's, and that place; below dropped ones none. ``alone`` is given the page's slots, and all below them, that only go beside siblings this page lacks."""
        known: dict = {}
        alone = set() if alone is None else alone
        todo = [(page, self.tree)]
        while todo:
            a, b = todo.pop()
            pairs = _match(a, b, known)[1]
            here = {id(b[3][j]) for _, j in pairs} if self.beside else ()
            for i, j in pairs:
                c, t = a[3][i], b[3][j]
                if id(a) in alone or (id(t) in self.dropped and id(t) in self.beside and self.beside[id(t)].isdisjoint(here)):
                    alone.add(id(c))
                yield c, t
                if id(t) not in self.dropped or id(c) in alone:
                    todo.append((c, t))

    def mark(self, page: list) -> None:
        """Marks the elements and runs of a page's tree that hold no content. Where it has no place in the host's, or stands alone, names decide."""
        alone: set[int] = set()
        for c, t in [(page, self.tree), *self.places(page, alone)]:
            gone = id(t) in self.dropped and id(c) not in alone
            for m in c[6]:
                m.drop = gone if c is not page and id(c) not in alone else m.drop
                if c[0] == "#" and not gone and self.constant(t, m.text):
                    m.constant = True
            if t[6] and not gone:
                moved = frozenset(t[6])
                for m in _among(c, t):
                    if _said(m) in moved:
                        _made_constant(m)


def _runs(node: Node, names: bool, out: list[Run]) -> list[Run]:
    for c in content(node):
        if isinstance(c, Run):
            if not c.drop:
                out.append(c)
        elif not (c.drop if c.drop is not None else names and (c.aside or (c.tag == "header" and not _titled(c)))):
            _runs(c, names, out)
    return out


def _titled(n: Node) -> bool:
    return any(c.tag in ("h1", "h2") or _titled(c) for c in n.children)


def _named_tops(root: Node) -> list[Node]:
    """The articles of a page; if none, its main element; if none, all of it."""
    for tag in ("article", "main"):
        tops, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.tag == tag:
                tops.append(n)
            else:
                todo += [c for c in reversed(n.children) if not c.aside and c.tag != "#"]
        if tops:
            return tops if tag == "article" else tops[:1]
    return [root]


def main_text(page: str, template: list | Wrapper | None = None, names: bool = True) -> str:
    """The page's main text: content blocks joined by a line feed, white space within as one space.

    With a host's tree its votes decide, and names are second (none without ``names``); without a tree names decide alone. If
    constant texts are over half of what the votes leave, the page is a copy of others, and they stay.
    """
    root = parse(page, names)
    if template is None:
        return "\n".join(r.text for top in (_named_tops(root) if names else [root]) for r in _runs(top, names, []))
    wrapper = template if isinstance(template, Wrapper) else Wrapper(template, names)
    if not wrapper.weights[id(wrapper.tree)][0]:  # nothing varies: there is nothing to learn from
        return main_text(page, None, names)
    wrapper.mark(shape(root))
    runs = _runs(root, names, [])
    if 2 * sum(len(r.text) for r in runs if r.constant) <= sum(len(r.text) for r in runs):
        runs = [r for r in runs if not r.constant]
    return "\n".join(r.text for r in runs)


# ---------------------------------------------------------------- on DataFrames
def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


_AT_ONCE, _FORMS_BYTES = 200_000, 32 << 20


def templates(pages: DataFrame) -> DataFrame:
    """``host, tree`` (JSON): the merged trees of all pages of each host.

    Pages whose slots have the same labels and nesting are one form, with its number of pages. A host's forms are merged, those of most pages first; where it
    has more than FORMS, in parts of about so many by their hash, and then the parts, so that neither a host nor a task is long.
    """

    def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], int] = {}
        held = 0
        for b in batches:
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if page:
                    at = _host(url), json.dumps(_bare(shape(parse(page))))
                    held += len(at[1]) if at not in found else 0
                    found[at] = found.get(at, 0) + 1
            if held > _FORMS_BYTES:
                yield rows(found)
                found, held = {}, 0
        yield rows(found)

    def rows(found: dict[tuple[str, str], int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["host", "tree", "pages"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for b in batches:
            done: dict[tuple, list] = {}
            for host, part, text, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (host, part) != at:
                    if at is not None:
                        done[at] = tree
                    at, tree = (host, part), None
                t = json.loads(text)
                tree = merge(tree, _times(t, n // t[1]))
            yield merged(done)
        if at is not None:
            yield merged({at: tree})

    def merged(done: dict[tuple, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in done], pa.string()), pa.array([json.dumps(t) for t in done.values()], pa.string()), pa.array([t[1] for t in done.values()], pa.int64())], ["host", "tree", "pages"])

    trees = pages.select("url", "html").mapInArrow(formed, "host string, tree string, pages long").groupBy("host", "tree").agg(F.sum("pages").alias("pages"))
    while True:
        trees = kept_table(trees, "forms")
        forms = trees.groupBy("host").agg(F.count("*").alias("n"))
        last = (forms.agg(F.max("n")).first()[0] or 0) <= FORMS
        dealt = trees.withColumn("part", F.lit(0).cast("long")) if last else trees.join(forms, "host").withColumn("part", F.pmod(F.xxhash64("tree"), F.ceil(F.col("n") / FORMS)))
        trees = dealt.select("host", "part", "tree", "pages").repartition("host", "part").sortWithinPartitions("host", "part", F.desc("pages"), "tree").mapInArrow(fold, "host string, tree string, pages long")
        if last:
            return trees.select("host", "tree")


class _Trees:
    """Hosts' trees at the executors: from a broadcast, or from a column of the rows."""

    def __init__(self, shared=None, judged: bool = True):
        self.shared, self.judged, self.made = shared, judged, {}

    def of(self, host: str, given: str | None) -> Wrapper | None:
        if host not in self.made:
            if len(self.made) > 5000:
                self.made.clear()
            text = self.shared.value.get(host) if self.shared is not None else given
            self.made[host] = None if text is None else Wrapper(json.loads(text), judged=self.judged)
        return self.made[host]


def _with_trees(pages: DataFrame, known: DataFrame, most_bytes: int) -> tuple[DataFrame, object | None]:
    """``page_id, url, html, tree`` and, while the trees take up to ``most_bytes``, their broadcast (then ``tree`` is null)."""
    chosen = pages.select("page_id", "url", "html")
    total = known.agg(F.sum(F.length("host") + F.length("tree")).alias("n")).first()["n"] or 0
    if total <= most_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["tree"] for r in known.collect()})
        return chosen.withColumn("tree", F.lit(None).cast("string")), shared
    return chosen.withColumn("host", F.expr(r"lower(regexp_extract(coalesce(url, ''), r'^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))")).join(known, "host", "left").select("page_id", "url", "html", "tree"), None


def counted(pages: DataFrame, known: DataFrame, most_bytes: int) -> DataFrame:
    """``host, tree``: each host's tree with the characters of its slots and their constant texts, counted over all its pages."""
    given, shared = _with_trees(pages, known, most_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, found, number = _Trees(shared, judged=False), {}, {}
        for b in batches:
            for url, page, tree in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if not page:
                    continue
                h = _host(url)
                w = trees.of(h, tree)
                if w is None:
                    continue
                if id(w) not in number:
                    number[id(w)] = _numbers(w.tree), w
                own: dict[tuple[int, str], int] = {}
                whole = shape(parse(page))
                for c, t in [(whole, w.tree), *w.places(whole)]:
                    k = number[id(w)][0][id(t)]
                    for m in _among(c, t):
                        own[-2 - k, _said(m)] = 0
                    if c[0] == "#":
                        for m in c[6]:
                            d = digest(m.text)
                            own[k, d] = own.get((k, d), 0) + len(m.text)
                own[-1, ""] = 0
                for (k, d), n in own.items():
                    was = found.get((h, k, d), (0, 0))
                    found[h, k, d] = (was[0] + 1, was[1] + n)
            if len(found) > _AT_ONCE:
                yield rows(found)
                found = {}
        yield rows(found)

    def rows(found: dict) -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())],
            ["host", "slot", "digest", "pages", "chars"],
        )

    texts = given.mapInArrow(count, "host string, slot int, digest string, pages long, chars long").groupBy("host", "slot", "digest").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"))
    texts = kept_table(texts, "slot-texts")
    sizes = texts.where("slot = -1").select("host", F.col("pages").alias("of"))
    chars = texts.where("slot >= 0").groupBy("host", "slot").agg(F.sum("chars").alias("chars"))
    often = texts.where("slot <> -1 and pages >= 4").join(sizes, "host").where("2 * pages >= of")
    # A text of half the host's pages, at a slot or (with slot -2 - k) among the children of slot k: no more of them than twice the texts and elements of a page.
    consts = often.groupBy("host").agg(F.collect_list(F.struct("slot", "digest", "chars")).alias("consts"))
    totals = chars.groupBy("host").agg(F.collect_list(F.struct("slot", "chars")).alias("totals"))
    joined = known.join(sizes, "host", "left").join(totals, "host", "left").join(consts, "host", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                const: dict[int, dict[str, int]] = {}
                moved: dict[int, list[str]] = {}
                for c in r["consts"] or []:
                    if c["slot"] >= 0:
                        const.setdefault(c["slot"], {})[c["digest"]] = c["chars"]
                    else:
                        moved.setdefault(-2 - c["slot"], []).append(c["digest"])
                out.append(json.dumps(_counted(json.loads(r["tree"]), {c["slot"]: c["chars"] for c in r["totals"] or []}, const, moved, r["of"] or 0, [0])))
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(out, pa.string())], ["host", "tree"])

    return joined.select("host", "tree", "of", "totals", "consts").mapInArrow(finish, "host string, tree string")


def _numbers(t: list) -> dict[int, int]:
    """Preorder numbers by slot."""
    out, todo = {}, [t]
    while todo:
        x = todo.pop()
        out[id(x)] = len(out)
        todo += reversed(x[3])
    return out


def extract(pages: DataFrame, most_template_bytes: int = 64 << 20) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages`` (``page_id, url, html``).

    Null and empty pages have the empty text. Pages with a null or odd url share the host "". Hosts of under four pages have no
    constant texts. Repeated rows stay, and count as pages; other columns are ignored; an empty table stays empty. Elements nested
    deeper than MOST_DEPTH count as children of the one at that depth. Trees go to the tasks by broadcast while they take
    up to ``most_template_bytes``, else by a join.
    """
    induced = kept_table(templates(pages), "templates")
    known = kept_table(counted(pages, induced, most_template_bytes), "counted")
    given, shared = _with_trees(pages, known, most_template_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees(shared)
        for b in batches:
            texts = [main_text(p, trees.of(_host(u), t)) if p else "" for u, p, t in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
