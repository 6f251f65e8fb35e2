"""HTML trees and CSS selectors, one parse for all selectors of a page.

Covered: void, raw-text and RCDATA elements, entities, implied ends of p, li, dd, dt, option, table
parts, synthesis of html, head, body, tbody and tr, reconstruction of unclosed formatting elements, foster
parenting of what a table can't hold, and in svg and math self-closing elements and the HTML elements that end
them. A template's content is its children; upper-case letters of svg names are not restored.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset(("title", "textarea"))
HEAD = frozenset("base link meta script style title noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
#: A start tag ends an open element of these, unless one of the fences is nearer.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("td", "th", "tr"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",)),
    "thead": (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",)),
}
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
CELLS = frozenset(("td", "th", "caption"))
#: What stays where it is in a table part.
IN_TABLE = frozenset("caption colgroup col tbody thead tfoot tr td th script style template".split())
FOREIGN = frozenset(("svg", "math"))
#: What can be in no foreign element and ends it; inside these two HTML goes on.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INTEGRATION = frozenset(("foreignobject", "desc", "title", "annotation-xml", "mtext", "mi", "mo", "mn", "ms"))
_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|$)|(?P<other>[!?][^>]*)>?|/(?P<end>[A-Za-z][^\s/>]*)[^>]*>?|(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        stack = self.elements()[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += n.elements()[::-1]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += n.children[::-1]
        return "".join(out)

    def outer(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, tuple):
                out.append(n[0])
            elif isinstance(n, str):
                out.append(_escape(n))
            else:
                out.append("<" + n.tag + "".join(f' {k}="{_escape(v, True)}"' for k, v in n.attrs.items()) + ">")
                if n.tag not in VOID:
                    stack.append((f"</{n.tag}>",))
                    stack += [(c,) if n.tag in RAW and isinstance(c, str) else c for c in n.children[::-1]]
        return "".join(out)


def _escape(s: str, attribute: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("\xa0", "&nbsp;")
    return s.replace('"', "&quot;") if attribute else s.replace("<", "&lt;").replace(">", "&gt;")


class _Builder:
    def __init__(self) -> None:
        self.root = Node("#document", {})
        self.html = self._append(self.root, Node("html", {}))
        self.head = self._append(self.html, Node("head", {}))
        self.body: Node | None = None
        self.stack = [self.html, self.head]
        self.active: list[Node] = []

    def _append(self, parent: Node, node: Node) -> Node:
        node.parent = parent
        parent.children.append(node)
        return node

    def place(self, node) -> None:
        """Put a node or a text where it belongs: as the last of the open element or, if that is a table part that
        can't hold it, before the table."""
        top = self.stack[-1]
        text = isinstance(node, str)
        if top.tag not in TABLE_PARTS or (not node.strip() if text else node.tag in IN_TABLE or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden")):
            parent, at = top, len(top.children)
        else:
            table = next(n for n in reversed(self.stack) if n.tag == "table" or n is self.html)
            parent = table.parent if table.tag == "table" else top
            at = next((i for i, c in enumerate(parent.children) if c is table), len(parent.children))
        if text:
            if at and isinstance(parent.children[at - 1], str):
                parent.children[at - 1] += node
            else:
                parent.children.insert(at, node)
        else:
            node.parent = parent
            parent.children.insert(at, node)

    def table_part(self, tag: str) -> None:
        """Back to the table part that tag is to be in, making those that are left out."""
        for i in range(len(self.stack) - 1, 1, -1):
            if self.stack[i].tag in TABLE_PARTS:
                del self.stack[i + 1 :]
                break
            if self.stack[i].tag in ("td", "th"):
                return
        wanted = ["tbody", "tr"] if tag in ("td", "th") else ["tbody"] if tag == "tr" else []
        for part in wanted:
            if self.stack[-1].tag == "table" if part == "tbody" else self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                made = Node(part, {})
                self.place(made)
                self.stack.append(made)

    def foreign(self) -> bool:
        """Whether the open element is in svg or math."""
        for n in reversed(self.stack):
            if n.tag in FOREIGN:
                return True
            if n.tag in INTEGRATION or n is self.body:
                return False
        return False

    def in_body(self) -> None:
        if self.body is None:
            self.body = self._append(self.html, Node("body", {}))
            self.stack = [self.html, self.body]

    def text(self, s: str) -> None:
        if not s:
            return
        if self.body is None and self.stack[-1] is self.head:
            if not s.strip():
                return
            self.in_body()
        if self.body is not None:
            self.reconstruct()
        self.place(s)

    def bounded(self) -> int:
        """Where the formatting elements of the open cell or caption begin; those of closed ones are forgotten."""
        begin = 0
        for i, n in enumerate(self.active):
            if n.tag in CELLS:
                if n not in self.stack:
                    del self.active[i:]
                    break
                begin = i + 1
        return begin

    def reconstruct(self) -> None:
        for i in range(self.bounded(), len(self.active)):
            if self.active[i] not in self.stack:
                for j in range(i, len(self.active)):
                    clone = Node(self.active[j].tag, dict(self.active[j].attrs))
                    self.place(clone)
                    self.stack.append(clone)
                    self.active[j] = clone
                return

    def pop_to(self, tags, fences=()) -> None:
        for i in range(len(self.stack) - 1, 1, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in fences:
                return

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> Node | None:
        if tag in ("html", "head", "body"):
            target = {"html": self.html, "head": self.head}.get(tag)
            if tag == "body":
                self.in_body()
                target = self.body
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            return None
        if self.body is None and tag not in HEAD:
            self.in_body()
        if self.foreign():
            if tag in BREAKOUT:
                while self.foreign():
                    self.stack.pop()
            else:
                node = Node(tag, attrs)
                self.place(node)
                if not closed:
                    self.stack.append(node)
                return None
        if tag in IMPLIED:
            tags, fences = IMPLIED[tag]
            for _ in range(3 if len(tags) > 2 else 1):
                self.pop_to(tags, fences)
        if tag in IN_TABLE and tag not in HEAD:
            self.table_part(tag)
        if tag in CLOSES_P:
            self.pop_to(("p",), ("button", "td", "th", "table", "caption", "object"))
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.stack[-1].tag):
            self.stack.pop()
        if tag == "a":
            self.end("a") if any(n.tag == "a" for n in self.active[self.bounded() :]) else None
        if self.body is not None and tag not in CLOSES_P and tag not in IMPLIED and tag not in HEAD:
            self.reconstruct()
        node = Node(tag, attrs)
        self.place(node)
        if tag in VOID or (closed and tag in FOREIGN):
            return None
        self.stack.append(node)
        if tag in FORMATTING or tag in CELLS:  # a cell bounds what is begun anew in it
            self.active.append(node)
        return node

    def end(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            if tag == "head" and self.body is None:
                self.stack = [self.html, self.head]
            return
        if tag == "br":
            self.start("br", {}, True)
            return
        if tag in FORMATTING:
            for i in range(len(self.active) - 1, self.bounded() - 1, -1):
                if self.active[i].tag == tag:
                    node = self.active.pop(i)
                    if node in self.stack:
                        at = self.stack.index(node)
                        inner = self.stack[at + 1 :]
                        del self.stack[at:]
                        if any(n.tag in CLOSES_P for n in inner):  # the block goes on without it
                            self.stack += inner
                    return
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag and self.stack[i] not in (self.body, self.head):
                del self.stack[i:]
                return
        if tag == "p":
            self.start("p", {}, False)
            self.end("p")


def parse_html(source: str) -> Node:
    b, at = _Builder(), 0
    while at < len(source):
        lt = source.find("<", at)
        if lt < 0:
            b.text(html.unescape(source[at:]))
            break
        m = _TAG.match(source, lt)
        if not m:
            b.text(html.unescape(source[at : lt + 1]))
            at = lt + 1
            continue
        b.text(html.unescape(source[at:lt]))
        at = m.end()
        if m["end"]:
            b.end(m["end"].lower())
        elif m["start"]:
            tag = m["start"].lower()
            attrs: dict[str, str] = {}
            for a in _ATTR.finditer(m["attrs"] or ""):
                attrs.setdefault(a[1].lower(), html.unescape(next((v for v in a.groups()[1:] if v is not None), "")))
            node = b.start(tag, attrs, (m["attrs"] or "").endswith("/"))
            if node is not None and tag in RAW | RCDATA:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                inner = source[at : close.start() if close else len(source)]
                inner = html.unescape(inner) if tag in RCDATA else inner
                if inner:
                    node.children.append(inner)
                b.stack.pop()
                at = close.end() if close else len(source)
    if b.body is None:
        b.in_body()
    return b.root


# --- selectors -----------------------------------------------------------------------------------

_COMPOUND = re.compile(r"(?P<tag>\*|[A-Za-z_][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<q>[^\"]*)\"|'(?P<s>[^']*)'|(?P<v>[^\s\]]+))\s*(?P<flag>[iI])?\s*)?\]|:(?P<pseudo>[a-z-]+)(?P<paren>\()?")


class Unsupported(ValueError):
    pass


def _nth(arg: str):
    arg = arg.strip().lower()
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+)", arg)
    if not m:
        raise Unsupported(arg)
    if m[4]:
        return lambda i, k=int(m[4]): i == k
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    c = int((m[2] or "+") + (m[3] or "0"))
    return lambda i: (i - c) == 0 if a == 0 else (i - c) % a == 0 and (i - c) // a >= 0


def _index(n: Node, same: bool, last: bool) -> int:
    around = [x for x in (n.parent.elements() if n.parent else [n]) if not same or x.tag == n.tag]
    i = next(k for k, x in enumerate(around) if x is n)
    return len(around) - i if last else i + 1


def _simple(m: re.Match, argument: str):
    if m["tag"]:
        return (lambda n: True) if m["tag"] == "*" else (lambda n, t=m["tag"].lower(): n.tag == t)
    if m["id"]:
        return lambda n, i=m["id"]: n.attrs.get("id") == i
    if m["cls"]:
        return lambda n, c=m["cls"]: c in n.attrs.get("class", "").split()
    if m["attr"]:
        name, op = m["attr"].lower(), m["op"]
        value = next((m[g] for g in "qsv" if m[g] is not None), "")
        if not op:
            return lambda n: name in n.attrs
        low = (lambda s: s.lower()) if m["flag"] else (lambda s: s)
        value = low(value)
        test = {"=": lambda x: x == value, "~=": lambda x: value in x.split() if value else False, "|=": lambda x: x == value or x.startswith(value + "-"), "^=": lambda x: bool(value) and x.startswith(value), "$=": lambda x: bool(value) and x.endswith(value), "*=": lambda x: bool(value) and value in x}[op]
        return lambda n: name in n.attrs and test(low(n.attrs[name]))
    p = m["pseudo"]
    if p in ("not", "is", "where"):
        inner = compile_selector(argument)
        return lambda n: matches(n, inner) == (p != "not")
    nth = {"nth-child": (False, False), "nth-last-child": (False, True), "nth-of-type": (True, False), "nth-last-of-type": (True, True)}
    if p in nth:
        test_i, (same, last) = _nth(argument), nth[p]
        return lambda n: test_i(_index(n, same, last))
    fixed = {"first-child": (False, False), "last-child": (False, True), "first-of-type": (True, False), "last-of-type": (True, True)}
    if p in fixed:
        return lambda n, a=fixed[p]: _index(n, *a) == 1
    if p in ("only-child", "only-of-type"):
        return lambda n, s=p == "only-of-type": _index(n, s, False) == 1 == _index(n, s, True)
    if p == "empty":
        return lambda n: not n.children
    if p == "root":
        return lambda n: n.parent is not None and n.parent.tag == "#document"
    raise Unsupported(p)


def _split(text: str, at: int) -> tuple[str, int]:
    """Text up to the parenthesis that closes the one before ``at``."""
    depth, i = 1, at
    while i < len(text):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if not depth:
            return text[at:i], i + 1
        i += 1
    raise Unsupported(text)


@functools.lru_cache(maxsize=1000)
def compile_selector(text: str) -> tuple:
    """A group of chains, each [(combinator, tests), ...] from left to right."""
    groups, chain, tests, comb, at = [], [], [], " ", 0
    text = text.strip()
    if not text:
        raise Unsupported(text)

    def close() -> None:
        nonlocal tests
        if not tests:
            raise Unsupported(text)
        chain.append((comb, tests))
        tests = []

    while at < len(text):
        m = re.compile(r"\s*([,>+~])\s*|(\s+)").match(text, at)
        if m:
            close()
            at = m.end()
            if m[1] == ",":
                groups.append(tuple(chain))
                chain, comb = [], " "
            else:
                comb = m[1] or " "
            continue
        m = _COMPOUND.match(text, at)
        if not m or (m["tag"] and tests):
            raise Unsupported(text)
        at, argument = m.end(), ""
        if m["paren"]:
            argument, at = _split(text, at)
        tests.append(_simple(m, argument))
    close()
    groups.append(tuple(chain))
    return tuple(groups)


def _chain(n: Node, chain: tuple, i: int) -> bool:
    if not all(t(n) for t in chain[i][1]):
        return False
    if i == 0:
        return True
    comb, parent = chain[i][0], n.parent
    if comb == ">":
        return parent is not None and parent.tag != "#document" and _chain(parent, chain, i - 1)
    if comb == " ":
        while parent is not None and parent.tag != "#document":
            if _chain(parent, chain, i - 1):
                return True
            parent = parent.parent
        return False
    around = parent.elements() if parent else [n]
    before = around[: next(k for k, x in enumerate(around) if x is n)]
    return any(_chain(x, chain, i - 1) for x in (before[-1:] if comb == "+" else before))


def matches(n: Node, group: tuple) -> bool:
    return any(_chain(n, c, len(c) - 1) for c in group)


def select(root: Node, selector: str) -> list[Node]:
    """In document order; a selector that can't be read selects nothing."""
    try:
        group = compile_selector(selector)
    except Unsupported:
        return []
    return [n for n in root.walk() if matches(n, group)]
