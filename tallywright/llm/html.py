"""Main-text extraction by wrapper induction.

Pages of one host and layout share a template. A page's DOM tree is cut to its blocks: elements that start a block, and between them runs of
text, whatever inline markup they hold. It is aligned with a typical page of its kind by simple tree matching; a block that stands unchanged at the same
node on nearly all distinct pages is template, what varies there is a content slot. Slots are judged too: one whose blocks are links for the most
part is a menu, one with the same few texts again and again is a notice, though no two pages agree in it. The few slots that hold most of what varies
are the main ones; the smallest element around a page's main blocks is its story, and of what varies outside it only headings stay. Whole blocks go, never a
part of one, and headings and lists of links between blocks of content stay. An article or main element, where the page has one, says itself what its content is: it bounds the
text, and nothing in it is template. Before all that a page is freed of its landmarks (menus, headers, footers, sidebars, notices, adverts, forms, comments).
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, pick

#: A block is template if it is constant on this share of the host's distinct pages, of at least so many.
TEMPLATE_SHARE = 0.8
TEMPLATE_PAGES = 5

#: A slot with blocks on enough pages is template if links hold this share of its text, or if its texts are distinct to no more than this share.
LINK_SHARE = 0.6
DISTINCT_SHARE = 0.35
#: The main slots: the largest ones that hold this share of the text that varies, each text counted once.
MAIN_SHARE = 0.9
#: An element that can be a story by itself; a list, a table or a paragraph is a part of the one around it.
STORIES = frozenset("#root html body div section td center".split())
#: Depth to which the tags of a page make its layout.
LAYOUT_DEPTH = 3
#: Cells of an alignment that are held at a time; of larger ones some rows are, and the others are worked out again.
HELD_CELLS = 4_000_000
#: A constant block in one of these stays if content stands before and after it.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 th dt caption summary".split())
#: Text of no more links than this is prose.
PROSE_LINKS = 0.5

#: Elements nested deeper stand beside each other, as in browsers. No text is lost there; a block that deep begins a new one, as any, but text
#: after its end goes on with its last run.
MAX_DEPTH = 500

_set = lambda s: frozenset(s.split())
#: Fixed values of the HTML standard.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title iframe noembed noframes xmp")
CLOSES_P = _set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul"
)
FORMATTING = _set("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup tt u var")
BLOCK = CLOSES_P | _set("body html li dt dd tr td th caption tbody thead tfoot option optgroup legend br-none article iframe")
#: An opening tag ends an open element of these names, up to the nearest boundary.
ENDS = {
    "li": (_set("li"), _set("ul ol menu")), "dt": (_set("dt dd"), _set("dl")), "dd": (_set("dt dd"), _set("dl")),
    "tr": (_set("tr td th"), _set("table")), "td": (_set("td th"), _set("tr table")), "th": (_set("td th"), _set("tr table")),
    "tbody": (_set("tbody thead tfoot tr td th"), _set("table")), "thead": (_set("tbody thead tfoot tr td th"), _set("table")),
    "tfoot": (_set("tbody thead tfoot tr td th"), _set("table")), "option": (_set("option"), _set("select datalist")),
}
SCOPE = _set("table td th caption button html template")

#: What is never content: elements, ARIA roles, and words of class or id.
DROP_TAGS = _set(
    "head script style noscript template nav footer aside form button select option textarea input iframe object embed "
    "svg math canvas audio video map dialog menu title noembed noframes xmp datalist"
)
DROP_ROLES = _set("navigation banner contentinfo complementary search dialog alertdialog alert status menu menubar toolbar form")
DROP_WORDS = _set(
    "nav navbar navigation menu menubar topbar breadcrumb breadcrumbs sidebar footer masthead ad ads advert adverts "
    "advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices "
    "notification popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations widget comment comments commentlist disqus respond replies reply pagination pager skip toolbar"
)
#: Within an article only these whole classes and ids count: a "share-price" or a "related-work" is content.
DROP_CLASSES = _set(
    "ad ads advert adverts advertisement adsense sponsored comments commentlist comment-list comment-form disqus_thread respond newsletter "
    "newsletter-signup cookie-notice cookie-banner share share-buttons social social-share sharing related related-posts related-articles "
    "sidebar breadcrumb breadcrumbs pagination post-navigation nav navigation menu footer"
)
#: A class that begins so says what stands beside an element, as in "with-sidebar".
SAYS_LAYOUT = _set("with without has no")

_TAG = re.compile(r"""<!--(?:(?!-->).)*+(?:-->|\Z)|</?[a-zA-Z][^\s/>]*+(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[!?/][^>]*+>|</?[a-zA-Z][^>]*+>""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s>/]|$)""", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("children", "drop", "label", "tag")

    def __init__(self, tag: str, drop: bool = False, label: str = "") -> None:
        self.tag, self.drop, self.label, self.children = tag, drop, label or tag, []  # children: nodes, and texts as str


def clean(text: str) -> str:
    return " ".join(text.split())


_CLASS = re.compile(r"""\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _label(tag: str, markup: str) -> str:
    """The tag with its classes, as slots are told apart."""
    found = _CLASS.search(markup) if "lass" in markup or "LASS" in markup else None
    return f"{tag}.{clean(found[1] or found[2] or found[3] or '').lower()}" if found else tag


def _dropped(tag: str, markup: str, inside: bool) -> bool:
    """inside: within an article or main element, where a header belongs to the text."""
    if tag in DROP_TAGS or tag == "header" and not inside:
        return True
    if "=" not in markup and "hidden" not in markup:
        return False
    if tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTR.findall(markup, len(tag) + 1):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.strip() in DROP_ROLES:
            return True
        if name in ("class", "id"):
            for token in value.split():
                if inside:
                    if token in DROP_CLASSES:
                        return True
                    continue
                words = _WORD.findall(token)
                if words and words[0] not in SAYS_LAYOUT and (not DROP_WORDS.isdisjoint(words) or "header" in words):
                    return True
    return False


def parse(html: str | None) -> Node:
    """DOM tree of tag soup: implied and missing end tags are supplied, stray ones ignored."""
    root = Node("#root")
    stack = [root]
    text, at, end = html or "", 0, len(html or "")
    inside = 0

    def pop_to(k: int) -> None:
        nonlocal inside
        for node in stack[k:]:
            inside -= node.tag in ("article", "main")
        del stack[k:]

    while at < end:
        lt = text.find("<", at)
        if lt < 0:
            lt = end
        m = _TAG.match(text, lt) if lt < end else None
        stop = lt if m or lt == end else lt + 1
        if stop > at:
            raw = text[at:stop]
            if not raw.isspace() or len(raw) and stack[-1].children:
                stack[-1].children.append(entities.unescape(raw) if "&" in raw else raw)
        if not m:
            at = stop
            continue
        at = m.end()
        markup = m[0]
        if not (name := _NAME.match(markup)):
            continue
        tag = name[1].lower()
        if markup[1] == "/":
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            k = len(stack) - 1
            while k > 0 and stack[k].tag != tag:
                if stack[k].tag in ("td", "th", "table") and tag not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "body", "html"):
                    k = 0
                    break
                k -= 1
            if k > 0:
                if tag in FORMATTING and any(n.tag in BLOCK for n in stack[k + 1 :]):
                    del stack[k]  # misnested: the blocks opened inside stay open
                else:
                    pop_to(k)
            continue
        if tag in ("html", "body") and len(stack) > 1 and any(n.tag == tag for n in stack):
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in ENDS:
            names, bounds = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in names:
                    pop_to(k)
        if tag == "body" or tag not in DROP_TAGS and stack[-1].tag == "head":
            for k in range(1, len(stack)):
                if stack[k].tag == "head":
                    if tag not in VOID:
                        pop_to(k)
                    break
        node = Node(tag, _dropped(tag, markup, inside > 0), _label(tag, markup))
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
            at = text.find(">", close.start()) + 1 or end if close else end
        elif tag not in VOID and len(stack) < MAX_DEPTH and not (markup.endswith("/>") and tag in ("svg", "path")):
            stack.append(node)
            inside += tag in ("article", "main")
    return root


def text_key(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\x00{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def slot_key(slot: str) -> int:
    return text_key(slot, "")


class Outline:
    """A page's blocks in pre-order: `tags` and `depths` of the elements and of the runs of text ('#'); and for each run its text, characters in links, key of its
    text and tag path, key of its slot (tags and classes), and whether an article or main element holds it. `bounded`: there is such an element."""

    __slots__ = ("areas", "bounded", "depths", "keys", "links", "slots", "tags", "texts")

    def __init__(self, root: Node) -> None:
        self.tags, self.depths, self.bounded = [], [], False
        self.texts, self.links, self.keys, self.slots, self.areas = [], [], [], [], []
        run: list[tuple[str, bool]] = []
        open_: list[tuple[str, str, bool]] = []  # tag path, slot and area of the blocks around

        def flush() -> None:
            if run and (text := clean("".join(t for t, _ in run))):
                path, slot, area = open_[-1]
                self.tags.append("#")
                self.depths.append(len(open_))
                self.texts.append(text)
                self.links.append(sum(len(t.strip()) for t, linked in run if linked))
                self.keys.append(text_key(path, text))
                self.slots.append(slot_key(slot))
                self.areas.append(area)
            run.clear()

        todo: list[tuple] = [(root, False, False)]
        while todo:
            node, linked, done = todo.pop()
            if done:
                flush()
                open_.pop()
            elif isinstance(node, str):
                run.append((node, linked))
            elif node.drop:
                if node.tag in BLOCK or node.tag in DROP_TAGS:
                    flush()
            elif node.tag == "br":
                run.append((" ", linked))
            else:
                if node.tag in BLOCK or node is root:
                    if open_:
                        flush()
                    path, slot, area = open_[-1] if open_ else ("", "", False)
                    area = area or node.tag in ("article", "main")
                    self.bounded = self.bounded or area
                    self.tags.append(node.tag)
                    self.depths.append(len(open_))
                    open_.append((f"{path}/{node.tag}", f"{slot}/{node.label}", area))
                    todo.append((node, linked, True))
                linked = linked or node.tag == "a"
                todo += [(c, linked, False) for c in reversed(node.children)]


def layout(root: Node) -> int:
    """Hash of the page's upper tags in order, without repeats beside each other."""
    out, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if not isinstance(node, str) and node.tag not in ("head", "script", "style"):
            if not out or out[-1] != (depth, node.tag):
                out.append((depth, node.tag))
            if depth < LAYOUT_DEPTH:
                todo += [(c, depth + 1) for c in reversed(node.children)]
    return text_key("layout", str(out))


class Forms:
    """Shapes of subtrees by number (equal shapes have one), and how well two shapes match."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def number(self, tag: str, kids: tuple[int, ...]) -> int:
        found = self.numbers.setdefault((tag, kids), len(self.tag))
        if found == len(self.tag):
            self.tag.append(tag)
            self.kids.append(kids)
            self.size.append(1 + sum([self.size[k] for k in kids]))
        return found

    def score(self, i: int, j: int) -> int:
        """Nodes that simple tree matching pairs in two shapes."""
        return int(self.scores([i], [j])[0, 0])

    def weights(self, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the distinct shapes of `x` and `y`, and the place of each member's shape among them."""
        kinds_x, at_x = np.unique(x, return_inverse=True)
        kinds_y, at_y = np.unique(y, return_inverse=True)
        return self.scores(kinds_x.tolist(), kinds_y.tolist()), at_x, at_y

    def scores(self, xs: list[int], ys: list[int]) -> np.ndarray:
        """The score of each of `xs` with each of `ys`: shapes of one tag by the scores of their children, all pairs of like numbers of children at once."""
        out = np.zeros((len(xs), len(ys)), np.int32)
        if len(xs) == len(ys) == 1 and (xs[0], ys[0]) in self.known:
            out[0, 0] = self.known[xs[0], ys[0]]
            return out
        for tag in {self.tag[u] for u in xs} & {self.tag[v] for v in ys}:
            rows, cols = [r for r, u in enumerate(xs) if self.tag[u] == tag], [c for c, v in enumerate(ys) if self.tag[v] == tag]
            us, vs = [xs[r] for r in rows], [ys[c] for c in cols]
            equal = np.array(us)[:, None] == np.array(vs)
            part = np.where(equal, np.array([self.size[u] for u in us], np.int32)[:, None], 1)
            if not equal.all() and tag != "#":
                kids_x, kids_y = (sorted({k for u in shapes for k in self.kids[u]}) for shapes in (us, vs))
                if kids_x and kids_y:
                    below = np.pad(self.scores(kids_x, kids_y), ((0, 1), (0, 1)))  # what fills up a list of children matches nothing
                    lists_x, lists_y = self._lists(us, kids_x), self._lists(vs, kids_y)
                    for at_u, list_x in lists_x:
                        for at_v, list_y in lists_y:
                            _fill(part, equal, below, at_u, list_x, at_v, list_y)
            out[np.ix_(rows, cols)] = part
        if len(xs) == len(ys) == 1:
            self.known[xs[0], ys[0]] = int(out[0, 0])
        return out

    def _lists(self, shapes: list[int], kids: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The shapes by like numbers of children: (places, places of their children in `kids`, filled up to one length)."""
        place, by_length = {k: i for i, k in enumerate(kids)}, {}
        for i, u in enumerate(shapes):
            by_length.setdefault(len(self.kids[u]).bit_length(), []).append(i)
        out = []
        for members in by_length.values():
            longest = max(len(self.kids[shapes[i]]) for i in members)
            rows = [[*[place[k] for k in self.kids[shapes[i]]], *[len(kids)] * (longest - len(self.kids[shapes[i]]))] for i in members]
            out.append((np.array(members), np.array(rows, np.int64).reshape(len(members), longest)))
        return out


def _fill(part: np.ndarray, equal: np.ndarray, below: np.ndarray, at_u, list_x: np.ndarray, at_v, list_y: np.ndarray) -> None:
    """Write the scores of unequal pairs into `part`: rows of many tables of best scores are worked out side by side."""
    which_u, which_v = np.nonzero(~equal[np.ix_(at_u, at_v)])
    width = list_y.shape[1]
    step = max(1, HELD_CELLS // (width + 1))
    for k in range(0, len(which_u), step):
        u, v = which_u[k : k + step], which_v[k : k + step]
        row, mine = np.zeros((len(u), width + 1), np.int32), list_y[v]
        for r in range(list_x.shape[1]):
            row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], row[:, :-1] + below[list_x[u, r][:, None], mine]), axis=1)
        part[at_u[u], at_v[v]] = 1 + row[:, -1]


def _equal_ends(x, y) -> tuple[int, int]:
    """How many members at the start, and then at the end, are equal. Those match whole, which no other alignment betters."""
    lo, tail = 0, 0
    while lo < len(x) and lo < len(y) and x[lo] == y[lo]:
        lo += 1
    while tail < min(len(x), len(y)) - lo and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    return lo, tail


def _next_row(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of the table of best scores, the row below `row`."""
    return np.concatenate([row[:1], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights))])


def _aligned(weights: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a best alignment, last one first. Every so many rows of the table are held, all others worked out again when the way back needs them."""
    n, m = len(at_x), len(at_y)
    step = 1 + int(n**0.5) if n * m > HELD_CELLS else n
    starts, row = [np.zeros(m + 1, np.int32)], np.zeros(m + 1, np.int32)
    for r in range(n):
        row = _next_row(row, weights[at_x[r]][at_y])
        if (r + 1) % step == 0:
            starts.append(row)
    r, c, first, rows, out = n, m, n, [], []
    while r and c:
        if r - 1 < first:
            first = (r - 1) // step * step
            rows = [starts[first // step]]
            for k in range(first, r):
                rows.append(_next_row(rows[-1], weights[at_x[k]][at_y]))
        here, above = rows[r - first], rows[r - 1 - first]
        if here[c] == above[c]:
            r -= 1
        elif here[c] == here[c - 1]:
            c -= 1
        else:
            r, c = r - 1, c - 1
            out.append((r, c))
    return out


class _Tree:
    """A tree of positions in an outline, with the shape of each subtree. Trees that are matched share their forms."""

    def __init__(self, tags: list[str], depths: list[int], keys: list[int], forms: Forms) -> None:
        n = len(tags)
        texts = iter(keys)
        self.tags, self.keys, self.kids = tags, [next(texts) if t == "#" else 0 for t in tags], [[] for _ in range(n)]
        open_at: list[int] = []
        for i in range(n):
            del open_at[depths[i] :]
            if open_at:
                self.kids[open_at[-1]].append(i)
            open_at.append(i)
        self.forms, self.shape = forms, [0] * n
        for i in range(n - 1, -1, -1):
            self.shape[i] = forms.number(tags[i], tuple([self.shape[k] for k in self.kids[i]]))


def tree_match(a: _Tree, b: _Tree) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: number of matched nodes, and the matched texts. Children are aligned in order by dynamic programming."""
    forms, pairs, todo = a.forms, [], [(0, 0)]
    total = forms.score(a.shape[0], b.shape[0])
    if not total:
        return 0, []
    while todo:
        i, j = todo.pop()
        if a.tags[i] == "#":
            pairs.append((i, j))
        elif a.shape[i] == b.shape[j]:
            pairs += [(i + k, j + k) for k in range(forms.size[a.shape[i]]) if a.tags[i + k] == "#"]
        else:
            x, y = a.kids[i], b.kids[j]
            shapes_x, shapes_y = tuple([a.shape[k] for k in x]), tuple([b.shape[k] for k in y])
            lo, tail = _equal_ends(shapes_x, shapes_y)
            hx, hy = len(x) - tail, len(y) - tail
            middle = _aligned(*forms.weights(shapes_x[lo:hx], shapes_y[lo:hy])) if lo < hx and lo < hy else []
            todo += [*zip(x[hx:], y[hy:]), *((x[lo + r], y[lo + c]) for r, c in middle), *zip(x[:lo], y[:lo])]
    return total, pairs


#: Of a template.
PARTS = ("constant", "links", "few", "main")


class Template:
    """What is template on pages of one kind: texts by key, slots of links and slots of few texts; and the main slots of content."""

    def __init__(self, constant=(), links=(), few=(), main=()) -> None:
        self.constant, self.links, self.few, self.main = frozenset(constant), frozenset(links), frozenset(few), frozenset(main)


def _verdicts(page, template: Template) -> list[str]:
    """keep, gone, or maybe for each run of text of an unbounded page."""
    out, parents, at = [], [], 0
    for tag, depth in zip(page.tags, page.depths):
        del parents[depth:]
        if tag == "#":
            key, slot, share = page.keys[at], page.slots[at], page.links[at] / len(page.texts[at])
            if slot in template.few or key in template.constant:
                out.append("maybe" if parents[-1] in HEADINGS else "gone")
            else:
                out.append("maybe" if slot in template.links and share >= LINK_SHARE else "keep")
            at += 1
        parents.append(tag)
    return out


def _outside_story(page, verdicts: list[str], template: Template) -> list[str]:
    """The verdicts, but gone for what is kept outside the smallest element around the main blocks, of those that can be a story, and is no heading.

    A block that is one run of text, as a paragraph, belongs to the element around it, so that a lone paragraph is not a story by itself.
    """
    runs = [i for i, tag in enumerate(page.tags) if tag == "#"]
    main = [i for i, slot, v in zip(runs, page.slots, verdicts) if v == "keep" and slot in template.main]
    if not main:
        return verdicts
    depths, n = page.depths, len(page.depths)
    alone = lambda i: depths[i - 1] < depths[i] and (i + 1 == n or depths[i + 1] < depths[i])
    depth = min([depths[i] - 1 - alone(i) for i in main] + [d - 1 for d in depths[main[0] : main[-1] + 1]])
    start = end = main[0]
    while start and (depths[start] > depth or page.tags[start] not in STORIES):
        if depths[start] <= depth:  # the element at that depth, and no story: look for the one around it
            depth = depths[start] - 1
        start -= 1
    while end < n and depths[end] > depths[start]:
        end += 1
    out = []
    for i, v in zip(runs, verdicts):
        out.append("gone" if v == "keep" and not start <= i < end and page.tags[i - 1] not in HEADINGS else v)
    return out


def _between_prose(page, verdicts: list[str]) -> list[bool]:
    """Whether the run, or an element around it, has blocks of prose that are kept on both sides under the same parent."""
    n = len(page.tags)
    parent, place, kids, leaf, open_at, at = [-1] * n, [0] * n, [0] * n, [-1] * n, [], 0
    for i, (tag, depth) in enumerate(zip(page.tags, page.depths)):
        del open_at[depth:]
        if open_at:
            parent[i] = open_at[-1]
            place[i] = kids[parent[i]]
            kids[parent[i]] += 1
        if tag == "#":
            leaf[i], at = at, at + 1
        open_at.append(i)
    first, last = [n] * n, [-1] * n  # places of the prose blocks among the children of each element
    for i in range(n):
        k = leaf[i]
        if k >= 0 and verdicts[k] == "keep" and page.links[k] <= PROSE_LINKS * len(page.texts[k]):
            for block in (i, parent[i]) if kids[parent[i]] == 1 else (i,):
                if (p := parent[block]) >= 0:
                    first[p], last[p] = min(first[p], place[block]), max(last[p], place[block])
    out = []
    for i in range(n):
        if leaf[i] >= 0:
            node, found = i, False
            while verdicts[leaf[i]] == "maybe" and not found and parent[node] >= 0:
                found = first[parent[node]] < place[node] < last[parent[node]]
                node = parent[node]
            out.append(found)
    return out


def main_text(page, template: Template | None = None) -> str:
    """Blocks of content of an `Outline` (or what has its fields) in page order, joined by a blank line."""
    if page.bounded:
        kept = page.areas
    elif template is None or not page.texts:
        kept = [True] * len(page.texts)
    else:
        verdicts = _outside_story(page, _verdicts(page, template), template)
        between = _between_prose(page, verdicts) if "maybe" in verdicts else verdicts
        kept = [v == "keep" or v == "maybe" and b for v, b in zip(verdicts, between)]
    return "\n\n".join([t for t, k in zip(page.texts, kept) if k])


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


_FIELDS = {
    "page_id": None, "url": ("string", pa.string()), "host": ("string", pa.string()), "layout": ("bigint", pa.int64()), "sig": ("bigint", pa.int64()),
    "shape": ("bigint", pa.int64()), "bounded": ("boolean", pa.bool_()), "tags": ("string", pa.string()), "depths": ("array<int>", pa.list_(pa.int32())),
    "texts": ("array<string>", pa.list_(pa.string())), "links": ("array<int>", pa.list_(pa.int32())), "keys": ("array<bigint>", pa.list_(pa.int64())),
    "slots": ("array<bigint>", pa.list_(pa.int64())), "areas": ("array<boolean>", pa.list_(pa.bool_())),
}
#: Pages that are parsed before what they hold is passed on.
SLICE = 64


def outlines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its outline, host, layout, and hashes of its HTML (sig) and of its tree (shape). The only parse of a page."""
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host_of(F.col("url")))
    rows = rows.select("page_id", "url", "html", "host")
    id_type = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b, out = whole.slice(k, SLICE), []
                for host, page in zip(b.column(3).to_pylist(), b.column(2).to_pylist()):
                    root = parse(page)
                    o = Outline(root)
                    tags = " ".join(o.tags)
                    shape = text_key(tags, str(o.depths))
                    out.append((host, layout(root), text_key("", page or ""), shape, o.bounded, tags, o.depths, o.texts, o.links, o.keys, o.slots, o.areas))
                kinds = [t for t in _FIELDS.values() if t][1:]
                columns = [pa.array([r[c] for r in out], t) for c, (_, t) in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], list(_FIELDS))

    return rows.mapInArrow(run, ", ".join(f"{name} {kind[0] if kind else id_type}" for name, kind in _FIELDS.items()))


def induce_templates(parsed: DataFrame) -> DataFrame:
    """(host, layout, constant, links, few, main): the template of each kind of page, from `outlines`. Kinds without any are left out.

    Pages of equal HTML count once for a host; layouts of fewer than five distinct pages have no template. A host with very many
    pages is split over tasks: both sides of the join with its typical page are tables.
    """
    kind = ["host", "layout"]
    sizes = F.transform("texts", lambda t: F.length(t))
    trees = parsed.select(*kind, "sig", "shape", "tags", "depths", "keys", "slots", "links", sizes.alias("sizes")).dropDuplicates(["host", "sig"])
    trees = materialize(trees, "skeletons")
    forms = trees.groupBy(*kind, "shape").agg(F.count(F.lit(1)).alias("n"), F.min("sig").alias("sig"))
    typical = forms.groupBy(*kind).agg(F.max(F.struct("n", "shape", "sig")).alias("t"), F.sum("n").alias("pages"))
    typical = typical.where(F.col("pages") >= TEMPLATE_PAGES).select(*kind, F.col("t.sig").alias("sig"), "pages")
    typical = materialize(typical, "typical")
    reference = trees.join(typical.select(*kind, "sig"), [*kind, "sig"]).select(
        *kind, F.col("tags").alias("ref_tags"), F.col("depths").alias("ref_depths"), F.col("keys").alias("ref_keys")
    )
    reference = materialize(reference, "reference")

    def align(batches):
        last, tree = None, None
        for b in batches:
            own_kind, found = [], []
            for r in b.to_pylist():
                if last != (r["host"], r["layout"]) or len(tree.forms.tag) > 100_000:
                    last, tree = (r["host"], r["layout"]), _Tree(r["ref_tags"].split(" "), r["ref_depths"], r["ref_keys"], Forms())
                own = _Tree(r["tags"].split(" "), r["depths"], r["keys"], tree.forms)
                same = {own.keys[j] for i, j in tree_match(tree, own)[1] if tree.keys[i] == own.keys[j]}
                own_kind += [last] * len(same)
                found += same
            columns = [pa.array([h for h, _ in own_kind], pa.string()), pa.array([x for _, x in own_kind], pa.int64()), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "layout", "key"])

    constant = trees.select(*kind, "tags", "depths", "keys").join(reference, kind).mapInArrow(align, "host string, layout bigint, key bigint")
    counts = constant.groupBy(*kind, "key").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(typical.select(*kind, "pages"), "kinds")
    texts = counts.join(sizes, kind).where(F.col("n") >= TEMPLATE_SHARE * F.col("pages")).select(*kind, F.lit("constant").alias("what"), "key")
    template = texts.unionByName(_template_slots(trees, kind)).join(sizes, kind, "left_semi")
    of = lambda what: F.collect_set(F.when(F.col("what") == what, F.col("key"))).alias(what)
    return template.groupBy(*kind).agg(*[of(what) for what in PARTS])


def _template_slots(trees: DataFrame, kind: list[str]) -> DataFrame:
    """(host, layout, what, key) of slots with five blocks or more: those that are mostly links, those with the same few texts, and of the rest the main ones."""
    one = trees.select(*kind, F.explode(F.arrays_zip("keys", "slots", "links", "sizes")).alias("t"))
    one = one.groupBy(*kind, F.col("t.slots").alias("key"), F.col("t.keys").alias("text")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("t.sizes").alias("chars"), F.sum("t.links").alias("linked")
    )
    slots = one.groupBy(*kind, "key").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.sum((F.col("chars") / F.col("n")).cast("bigint")).alias("varies"),
    )
    found = slots.where(F.col("n") >= TEMPLATE_PAGES)
    links, few = F.col("linked") >= LINK_SHARE * F.col("chars"), F.col("texts") <= DISTINCT_SHARE * F.col("n")
    larger = Window.partitionBy(*kind).orderBy(F.desc("varies"), "key").rowsBetween(Window.unboundedPreceding, -1)  # over a kind's slots, not its pages
    rest = found.where(~(links | few)).withColumn("before", F.coalesce(F.sum("varies").over(larger), F.lit(0)))
    rest = rest.withColumn("all", F.sum("varies").over(Window.partitionBy(*kind)))
    what = lambda df, name: df.select(*kind, F.lit(name).alias("what"), "key")
    main = what(rest.where(F.col("before") < MAIN_SHARE * F.col("all")), "main")
    return what(found.where(links), "links").unionByName(what(found.where(few), "few")).unionByName(main)


class _Page:
    """The fields of an outline from a row of a record batch."""

    def __init__(self, row: dict) -> None:
        for name in ("bounded", "depths", "texts", "links", "keys", "slots", "areas"):
            setattr(self, name, row[name])
        self.tags = row["tags"].split(" ")


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_limit: int = BROADCAST_ROWS
) -> DataFrame:
    """One row per row of `pages`: page_id, url, text ('' if none).

    Null or empty HTML has no text; a null URL or one without a host belongs to the host ''. Repeated
    rows get equal results each. An empty table gives an empty result. Each page is parsed once. Templates are broadcast while they have at most
    `broadcast_limit` keys in all, else joined by host and layout.
    """
    parsed = materialize(outlines(pages, id_col, url_col, html_col), "outlines")
    templates = induce_templates(parsed).select("host", "layout", F.struct(*PARTS).alias("template"))
    templates = materialize(templates, "templates")
    keys = templates.agg(F.sum(sum(F.size(f"template.{n}") for n in PARTS)).alias("n")).first().n or 0
    columns = ["page_id", "url", "bounded", "tags", "depths", "texts", "links", "keys", "slots", "areas", "template"]
    rows = parsed.join(F.broadcast(templates) if keys <= broadcast_limit else templates, ["host", "layout"], "left").select(*columns)

    def run(batches):
        for b in batches:
            out = []
            for row in b.select(columns[2:]).to_pylist():
                template = row["template"]
                out.append(main_text(_Page(row), Template(**template) if template and not row["bounded"] else None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    id_type = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {id_type}, url string, text string")
