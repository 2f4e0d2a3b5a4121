"""A small tolerant DOM, simple tree matching, and the text of a subtree."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

#: HTML elements without content, with raw text, and with text blocks of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: An open element (left) that a start tag (right) ends.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "li", "dd", "dt", "caption", "tbody", "tfoot", "thead", "tr"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot", "thead"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot", "thead"}), "head": frozenset({"body"}),
    "thead": frozenset({"tbody", "tfoot"}), "tbody": frozenset({"tbody", "tfoot"}),
}
#: Where the search for an element to end stops.
_SCOPE = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "option": frozenset({"select"}),
          "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "tbody": frozenset({"table"}), "thead": frozenset({"table"}),
          "p": frozenset({"li", "td", "th", "table", "ul", "ol"}) | (BLOCK - {"p"}), "head": frozenset()}
#: Elements that never hold main text.
DROPPED = frozenset("nav footer aside form script style noscript template button select textarea iframe svg canvas menu dialog head title object "
                    "audio video datalist".split())
#: Class names, ids or roles (or all words of one, beside ``NEUTRAL``) that mark what is not main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended comment comments commentlist reply replies disqus respond search login widget pagination pager toolbar "
    "contentinfo complementary skip topbar".split())
#: Words that only say what kind of box a marked one is.
NEUTRAL = frozenset("box block bar list item wrap wrapper container inner outer area top bottom left right main site page global button buttons links form".split())
_WORDS = re.compile(r"[a-z]+")
KEPT = frozenset({"html", "body", "article", "main"})
#: Text of the page's own; a mark on it says what it is about, not that it is clutter.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li td th dd dt figure figcaption b i em strong span a code".split())

#: Nested nodes at most; deeper elements are not nodes, but their content and the ends of their blocks are kept.
DEEPEST = 200


def marks_of(names: str) -> frozenset:
    """Marks among the class names, ids or roles of an attribute's value."""
    found = set()
    for name in names.split():
        words = _WORDS.findall(name)
        marks = [w for w in words if w in MARKS]
        if marks and all(w in MARKS or w in NEUTRAL for w in words):
            found.update(marks)
    return frozenset(found)


class Node:
    __slots__ = ("tag", "marks", "kids", "size", "text")

    def __init__(self, tag: str, marks: frozenset = frozenset()):
        self.tag, self.marks, self.kids, self.size, self.text = tag, marks, [], 0, None

    def label(self) -> str:
        return f"{self.tag}.{'.'.join(sorted(self.marks))}"


def parse(source: str) -> Node:
    """The tree of a page; kids are nodes and text strings (character references still encoded)."""
    root = Node("#root")
    stack = [root]
    pos, n = 0, len(source)

    def close(k: int):
        for node in stack[:k - 1:-1]:
            if node.size < 0 and node.tag in BLOCK:  # an element that is no node: its block ends here
                node.kids.append(Node("div"))
        del stack[k:]

    while pos < n:
        m = _TOKEN.search(source, pos)
        if m is None:
            stack[-1].kids.append(source[pos:])
            break
        if m.start() > pos:
            stack[-1].kids.append(source[pos: m.start()])
        pos = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # a stray inline end tag does not end a block
            continue
        for k in range(len(stack) - 1, 0, -1):
            closing = CLOSED_BY.get(stack[k].tag)
            if closing and tag in closing:
                close(k)
                break
            if stack[k].tag in _SCOPE.get(tag, ()) or (tag in BLOCK and stack[k].tag in BLOCK):
                break
        marks = frozenset()
        if m[3]:
            found = [(a.lower(), b or c or d) for a, b, c, d in _ATTR.findall(m[3])]
            marks = frozenset(w for a, v in found if a in ("class", "id", "role") for w in marks_of(html.unescape(v).lower()))
        node = Node(tag, marks)
        if len(stack) > DEEPEST and tag not in RAW and tag not in VOID and not is_clutter(node, True):
            node.kids, node.size = stack[-1].kids, -1  # its content goes where its parent's goes
            if tag in BLOCK:
                node.kids.append(Node("div"))
            stack.append(node)
            continue
        stack[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path", "g"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, pos)
            node.kids.append(source[pos: end.start() if end else n])
            pos = end.end() if end else n
            continue
        stack.append(node)
    unwrap(root)
    return root


def unwrap(root: Node) -> None:
    """Elements that look like clutter but hold the page's article, or a form around most of its text, become plain blocks."""
    order: list[tuple[Node, Node | None]] = [(root, None)]
    for node, _ in order:
        order += [(k, node) for k in node.kids if not isinstance(k, str)]
    above = {id(n): p for n, p in order}
    outside: set[int] = set()  # in clutter
    for node, parent in order:
        if parent is not None and (id(parent) in outside or is_clutter(node, False)):
            outside.add(id(node))
    articles = [n for n, _ in order if n.tag in ("article", "main")]
    if articles and all(id(a) in outside for a in articles):
        for a in articles:
            chain = []
            while (a := above[id(a)]) is not None:
                chain.append(a)
            if not any(n.tag in DROPPED and n.tag != "form" for n in chain):
                for n in chain:
                    n.marks, n.tag = frozenset(), "div" if n.tag == "form" else n.tag
    elif not articles:
        size: dict[int, int] = {}
        for node, _ in reversed(order):
            hidden = node.tag in DROPPED and node.tag != "form"
            size[id(node)] = 0 if hidden else sum(len(k.strip()) if isinstance(k, str) else size[id(k)] for k in node.kids)
        for node, _ in order:
            if id(node) in outside and node.tag not in DROPPED - {"form"} and 2 * size[id(node)] > size[id(root)]:
                node.marks, node.tag = frozenset(), "div" if node.tag == "form" else node.tag


def is_clutter(node: Node, inside_article: bool) -> bool:
    """Menus, page headers, footers, side bars, notices, adverts, forms, scripts, styles, comments."""
    if node.tag in DROPPED:
        return True
    if node.tag in KEPT:
        return False
    if node.tag == "header":
        return not inside_article
    if node.tag in PROSE:
        return False
    return bool(node.marks - {"header"} if inside_article else node.marks)


def text_blocks(node: Node, out: list[str], inside_article: bool, constant: frozenset = frozenset()) -> None:
    """Append the decoded text blocks of a subtree without clutter to ``out``."""
    piece: list[str] = []

    def flush():
        s = " ".join(html.unescape("".join(piece)).split())
        if s:
            out.append(s)
        piece.clear()

    todo: list = [iter([node])]
    closes = [False]
    first = True
    while todo:
        try:
            kid = next(todo[-1])
        except StopIteration:
            todo.pop()
            if closes.pop():
                flush()
            continue
        if isinstance(kid, str):
            piece.append(kid)
            continue
        if not first and (is_clutter(kid, inside_article) or id(kid) in constant):
            if kid.tag in BLOCK:
                flush()
            else:
                piece.append(" ")
            continue
        first = False
        block = kid.tag in BLOCK
        if block:
            flush()
        elif kid.tag in ("br", "td", "th"):
            piece.append(" ")
        todo.append(iter(kid.kids))
        closes.append(block)
    flush()


def nodes(node: Node) -> list[Node]:
    return [k for k in node.kids if not isinstance(k, str)]


def tree_match(a: Node, b: Node, depth: int = 12) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the largest order-preserving top-down matching of equal labels.

    Returns its size and the pairs of matched children of the two roots.
    """
    if a.label() != b.label():
        return 0, []
    if depth == 0:
        return 1, []
    x, y = nodes(a), nodes(b)
    score = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    weight = [[0] * len(y) for _ in x]
    for i, p in enumerate(x):
        above, row = score[i], score[i + 1]
        for j, q in enumerate(y):
            w = weight[i][j] = tree_match(p, q, depth - 1)[0] if p.label() == q.label() else 0
            row[j + 1] = max(above[j + 1], row[j], above[j] + w)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if weight[i - 1][j - 1] and score[i][j] == score[i - 1][j - 1] + weight[i - 1][j - 1]:
            pairs.append((x[i - 1], y[j - 1]))
            i, j = i - 1, j - 1
        elif score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + score[-1][-1], pairs[::-1]
