"""A small tree of an HTML page, and the alignment of two trees by simple tree matching."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np

_MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: A start tag of the first kind ends an open element of the second.
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = frozenset("article aside body div table ul ol dl section main nav header footer form td th blockquote fieldset".split())


@dataclass(eq=False)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)  # text and nodes in page order
    children: list[Node] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.kind = (self.tag, self.attributes.get("id"), self.attributes.get("class"))
        self.shape, self.size = 0, 1  # see _shaped
        self._said: str | None = None

    def text(self) -> str:
        """All text below, white space as one blank."""
        if self._said is None:
            self._said = " ".join("".join(_strings(self)).split())
        return self._said


def _strings(node: Node):
    todo = [iter(node.parts)]
    while todo:
        for p in todo[-1]:
            if isinstance(p, str):
                yield p
            else:
                if p.tag not in INLINE:
                    yield " "
                todo.append(iter(p.parts))
                break
        else:
            todo.pop()


def parse(page: str) -> Node:
    """The page as a tree. Ends that the page leaves out are put where the next start implies them; end tags of
    nothing open are skipped; character references in text are decoded. Contents of raw elements stay out."""
    root = Node("#root")
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        if m is None:
            stack[-1].parts.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _HOLDERS:
                    break
        if tag in _SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SIBLINGS[tag]:
                    del stack[k:]
                    if tag != "tr":
                        break
                elif stack[k].tag in _HOLDERS and stack[k].tag not in ("td", "th"):
                    break
        node = Node(tag, {a[0].lower(): entities.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(m[3])} if m[3] else {})
        stack[-1].parts.append(node)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag == "title":
                node.parts.append(entities.unescape(page[at : end.start() if end else size]))
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def numbered(root: Node) -> list[Node]:
    """All nodes in page order; a node's place in the list is its number."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


_SHAPES: dict[tuple, int] = {}
_SCORES: dict[tuple[int, int], int] = {}
_LAST = [0]


def _shaped(root: Node) -> None:
    """Give each node below the number of its shape, the kinds of its subtree, and the subtree's size."""
    if root.shape:
        return
    if len(_SHAPES) > 200_000:
        _SHAPES.clear()  # numbers are not given twice
    for node in reversed(numbered(root)):
        key = (node.kind, *(c.shape for c in node.children))
        if key not in _SHAPES:
            _LAST[0] += 1
            _SHAPES[key] = _LAST[0]
        node.shape, node.size = _SHAPES[key], 1 + sum(c.size for c in node.children)


def _score(a: Node, b: Node) -> int:
    """The most nodes of two trees that pair up; it depends on their shapes alone."""
    if a.kind != b.kind:
        return 0
    if a.shape == b.shape:
        return a.size
    x, y = a.children, b.children
    if not x or not y:
        return 1
    key = (a.shape, b.shape)
    if key not in _SCORES:
        kind = x[0].kind
        if all(c.kind == kind and not c.children for c in (*x, *y)):
            found = min(len(x), len(y))
        elif len(x) * len(y) > 3600:
            found = int(_last_row(_weights(x, y, 0))[-1])
        else:
            best = [0] * (len(y) + 1)
            for c in x:
                before, left = best, 0
                best = [0]
                for j, d in enumerate(y):
                    left = max(before[j + 1], left, before[j] + _score(c, d))
                    best.append(left)
            found = best[-1]
        if len(_SCORES) > 1_000_000:
            _SCORES.clear()
        _SCORES[key] = 1 + found
        return 1 + found
    return _SCORES[key]


def _weights(x: list[Node], y: list[Node], bonus: int) -> list[np.ndarray]:
    """For each of ``x`` what pairing it with each of ``y`` is worth: nodes that pair up, and ``bonus`` for equal text.
    Equal rows are one array."""
    shapes = [d.shape for d in y]
    by_shape: dict[int, np.ndarray] = {}
    by_text: dict[tuple, list[int]] = {}
    if bonus:
        for j, d in enumerate(y):
            by_text.setdefault((d.kind, d.text()), []).append(j)
    out = []
    for c in x:
        if c.shape not in by_shape:
            known = {d.shape: _score(c, d) for d in y}
            by_shape[c.shape] = np.array([known[s] for s in shapes], np.int64)
        row = by_shape[c.shape]
        if bonus and c.text() and (c.kind, c.text()) in by_text:
            row = row.copy()
            row[by_text[c.kind, c.text()]] += bonus
        out.append(row)
    return out


def _last_row(weights: list[np.ndarray]) -> np.ndarray:
    """Worth of the best pairing in order with the first j of the other list, for each j."""
    best = np.zeros(len(weights[0]) + 1, np.int64) if weights else np.zeros(1, np.int64)
    for w in weights:
        best[1:] = np.maximum(best[1:], best[:-1] + w)
        np.maximum.accumulate(best, out=best)
    return best


def _chosen(weights: list[np.ndarray], i: int, j: int, out: list[tuple[int, int]]) -> None:
    """Pairs of the best pairing in order, in memory that is linear in the lists: the first list is halved and the second
    cut where the halves' worths add up to the most."""
    if not weights or not len(weights[0]):
        return
    if len(weights) == 1:
        k = int(weights[0].argmax())
        if weights[0][k] > 0:
            out.append((i, j + k))
        return
    half = len(weights) // 2
    front, back = _last_row(weights[:half]), _last_row([w[::-1] for w in reversed(weights[half:])])
    cut = int((front + back[::-1]).argmax())
    _chosen([w[:cut] for w in weights[:half]], i, j, out)
    _chosen([w[cut:] for w in weights[half:]], i + half, j + cut, out)


def _in_order(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """Pairs of two lists in order with the most pairs of equal text and, of these, the most nodes."""
    same = lambda c, d: c.shape == d.shape and c.text() == d.text()
    head, tail, least = 0, 0, min(len(x), len(y))
    while head < least and same(x[head], y[head]):
        head += 1
    while tail < least - head and same(x[-1 - tail], y[-1 - tail]):
        tail += 1
    out = [(k, k) for k in range(head)]
    left, right = x[head : len(x) - tail], y[head : len(y) - tail]
    if left and right:
        alike = all(c.shape == left[0].shape for c in (*left, *right))
        texts = {c.text() for c in left} - {""}
        if alike and not any(d.text() in texts for d in right):
            out += [(head + k, head + k) for k in range(min(len(left), len(right)))]
        else:
            _chosen(_weights(left, right, 1 + sum(c.size for c in (*left, *right))), head, head, out)
    return out + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None, most: int = 60) -> int:
    """Simple tree matching: the most nodes of two trees that pair up keeping order and ancestry.

    ``pairs`` gets them. Of leaves that are all alike, and of lists of over ``most`` children on each side, those of equal
    text pair up first, by an exact longest common subsequence, as a constant block keeps its text and not its place.
    ``pairs`` can hold fewer than the most nodes for it.
    """
    _shaped(a)
    _shaped(b)
    if pairs is None:
        return _score(a, b)
    if a.kind != b.kind:
        return 0
    pairs.append((a, b))
    x, y = a.children, b.children
    if not x or not y:
        return _score(a, b)
    kind = x[0].kind
    if all(c.kind == kind and not c.children for c in (*x, *y)) or len(x) > most and len(y) > most:
        for i, j in _in_order(x, y):
            match(x[i], y[j], pairs, most)
        return _score(a, b)
    scores = [[_score(c, d) for d in y] for c in x]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + scores[i][j])
    i, j, chosen = len(x), len(y), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            chosen.append((i, j))
    for i, j in reversed(chosen):
        match(x[i], y[j], pairs, most)
    return _score(a, b)
