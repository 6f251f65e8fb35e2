"""XPath 1.0 over strict XML. Input that is not well-formed, and expressions that can't be read, give
nothing. Results are strings in document order."""

from __future__ import annotations

import functools
import math
import re
import xml.parsers.expat


class XNode:
    __slots__ = ("kind", "name", "value", "parent", "children", "attrs", "order")

    def __init__(self, kind: str, name: str = "", value: str = "", parent=None, order: int = 0):
        self.kind, self.name, self.value, self.parent, self.order = kind, name, value, parent, order
        self.children: list[XNode] = []
        self.attrs: list[XNode] = []

    def string(self) -> str:
        if self.kind in ("text", "attribute", "comment"):
            return self.value
        return "".join(c.string() for c in self.children if c.kind in ("text", "element"))


def parse_xml(source: str) -> XNode | None:
    root = XNode("root")
    stack, count = [root], [0]

    def node(*a) -> XNode:
        count[0] += 1
        return XNode(*a, parent=stack[-1], order=count[0])

    def start(name, attrs):
        n = node("element", name)
        stack[-1].children.append(n)
        stack.append(n)
        n.attrs = [node("attribute", k, attrs[i + 1]) for i, k in enumerate(attrs) if not i % 2]

    def chars(s):
        last = stack[-1].children[-1:]
        if last and last[0].kind == "text":
            last[0].value += s
        else:
            stack[-1].children.append(node("text", "", s))

    p = xml.parsers.expat.ParserCreate()
    p.ordered_attributes = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, lambda name: stack.pop(), chars
    p.CommentHandler = lambda s: stack[-1].children.append(node("comment", "", s))
    try:
        p.Parse(source, True)
    except (xml.parsers.expat.ExpatError, ValueError):
        return None
    return root


_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>\.\.|//|::|!=|<=|>=|[()\[\].@,/|+\-=<>*$])|(?P<name>[A-Za-z_][\w.-]*(?::(?!:)(?:[A-Za-z_][\w.-]*|\*))?))")


class _Parser:
    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(text)
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def peek(self, k: int = 0):
        return self.tokens[self.i + k] if self.i + k < len(self.tokens) else ("", "")

    def take(self, value: str) -> bool:
        if self.peek()[1] == value and self.peek()[0] != "str":
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise ValueError(value)

    def binary(self, level: int = 0):
        ops = (("or",), ("and",), ("=", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "div", "mod"))
        if level == len(ops):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek()[1] in ops[level] and self.peek()[0] in ("op", "name"):
            op = self.peek()[1]
            self.i += 1
            left = ("op", op, left, self.binary(level + 1))
        return left

    def unary(self):
        if self.take("-"):
            return ("neg", self.unary())
        left = self.path()
        while self.take("|"):
            left = ("union", left, self.path())
        return left

    def path(self):
        kind, value = self.peek()
        if kind in ("num", "str"):
            self.i += 1
            return self.tail(("lit", float(value) if kind == "num" else value[1:-1]))
        if value == "(":
            self.i += 1
            inner = self.binary()
            self.need(")")
            return self.tail(inner)
        if kind == "name" and self.peek(1)[1] == "(" and value not in ("text", "node", "comment"):
            self.i += 2
            args = []
            while not self.take(")"):
                args.append(self.binary())
                if self.peek()[1] != ")":
                    self.need(",")
            return self.tail(("call", value, args))
        steps, absolute = [], False
        if self.take("//"):
            absolute = True
            steps.append(("descendant-or-self", "node()", []))
        elif self.take("/"):
            absolute = True
            if self.peek()[0] not in ("name",) and self.peek()[1] not in (".", "..", "@", "*"):
                return ("path", True, [], None)
        steps += self.steps()
        return ("path", absolute, steps, None)

    def tail(self, base):
        predicates = []
        while self.take("["):
            predicates.append(self.binary())
            self.need("]")
        if predicates:
            base = ("filter", base, predicates)
        if self.peek()[1] in ("/", "//"):
            steps = [("descendant-or-self", "node()", [])] if self.take("//") else (self.need("/"), [])[1]
            return ("path", False, steps + self.steps(), base)
        return base

    def steps(self):
        out = [self.step()]
        while self.peek()[1] in ("/", "//"):
            if self.take("//"):
                out.append(("descendant-or-self", "node()", []))
            else:
                self.need("/")
            out.append(self.step())
        return out

    def step(self):
        if self.take("."):
            return ("self", "node()", [])
        if self.take(".."):
            return ("parent", "node()", [])
        axis = "attribute" if self.take("@") else "child"
        kind, value = self.peek()
        if kind == "name" and self.peek(1)[1] == "::":
            axis = value
            self.i += 2
            kind, value = self.peek()
        if kind != "name" and value != "*":
            raise ValueError(value)
        self.i += 1
        if self.take("("):
            self.need(")")
            value += "()"
        predicates = []
        while self.take("["):
            predicates.append(self.binary())
            self.need("]")
        return (axis, value, predicates)


@functools.lru_cache(maxsize=1000)
def compile_xpath(text: str):
    p = _Parser(text)
    tree = p.binary()
    if p.i != len(p.tokens):
        raise ValueError(text)
    return tree


def _axis(n: XNode, axis: str) -> list[XNode]:
    def below(x):
        for c in x.children:
            yield c
            yield from below(c)

    if axis == "child":
        return n.children
    if axis == "attribute":
        return n.attrs
    if axis == "self":
        return [n]
    if axis == "parent":
        return [n.parent] if n.parent else []
    if axis == "descendant":
        return list(below(n))
    if axis == "descendant-or-self":
        return [n, *below(n)]
    up = []
    x = n if axis == "ancestor-or-self" else n.parent
    while x:
        up.append(x)
        x = x.parent
    if axis in ("ancestor", "ancestor-or-self"):
        return up
    around = n.parent.children if n.parent and n.kind != "attribute" else []
    i = next((k for k, c in enumerate(around) if c is n), 0)
    if axis == "following-sibling":
        return around[i + 1 :]
    if axis == "preceding-sibling":
        return around[:i][::-1]
    if axis in ("following", "preceding"):
        out = []
        for a in [n, *up]:
            for s in _axis(a, f"{axis}-sibling"):
                out += _axis(s, "descendant-or-self")[:: 1 if axis == "following" else -1]
        return out
    raise ValueError(axis)


def _test(n: XNode, test: str, axis: str) -> bool:
    if test.endswith("()"):
        return test == "node()" or n.kind == test[:-2]
    if n.kind != ("attribute" if axis == "attribute" else "element"):
        return False
    return test == "*" or n.name == test or (test.endswith(":*") and n.name.startswith(test[:-1]))


def _number(v) -> float:
    if isinstance(v, list):
        v = _string(v)
    if isinstance(v, str):
        return float(v) if re.fullmatch(r"\s*-?(\d+(\.\d*)?|\.\d+)\s*", v) else math.nan
    return float(v)


def _string(v) -> str:
    if isinstance(v, list):
        return min(v, key=lambda n: n.order).string() if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "Infinity" if v > 0 else "-Infinity"
        return str(int(v)) if v == int(v) else repr(v)
    return v


def _bool(v) -> bool:
    return not math.isnan(v) and v != 0 if isinstance(v, float) else bool(v)


def _compare(op: str, a, b) -> bool:
    if isinstance(a, list) or isinstance(b, list):
        if isinstance(a, bool) or isinstance(b, bool):
            return _compare(op, _bool(a), _bool(b))
        return any(_compare(op, x, y) for x in ([n.string() for n in a] if isinstance(a, list) else [a]) for y in ([n.string() for n in b] if isinstance(b, list) else [b]))
    if op in ("=", "!="):
        if isinstance(a, bool) or isinstance(b, bool):
            same = _bool(a) == _bool(b)
        elif isinstance(a, float) or isinstance(b, float):
            same = _number(a) == _number(b)
        else:
            same = a == b
        return same == (op == "=")
    x, y = _number(a), _number(b)
    return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def _round(x: float) -> float:
    return x if math.isnan(x) or math.isinf(x) else math.floor(x + 0.5)


def _substring(s: str, start: float, length: float = math.inf) -> str:
    lo = _round(start)
    hi = lo + _round(length)
    return "".join(c for i, c in enumerate(s, 1) if lo <= i < hi)


def _evaluate(e, n: XNode, pos: int, size: int, root: XNode):
    kind = e[0]
    if kind == "lit":
        return e[1]
    if kind == "neg":
        return -_number(_evaluate(e[1], n, pos, size, root))
    if kind == "union":
        both = {id(x): x for side in e[1:] for x in _evaluate(side, n, pos, size, root)}
        return sorted(both.values(), key=lambda x: x.order)
    if kind == "op":
        op = e[1]
        a = _evaluate(e[2], n, pos, size, root)
        if op in ("or", "and"):
            return _bool(a) or _bool(_evaluate(e[3], n, pos, size, root)) if op == "or" else _bool(a) and _bool(_evaluate(e[3], n, pos, size, root))
        b = _evaluate(e[3], n, pos, size, root)
        if op in ("+", "-", "*", "div", "mod"):
            x, y = _number(a), _number(b)
            if op in ("div", "mod") and y == 0:
                return math.nan if x == 0 or op == "mod" else math.copysign(math.inf, x)
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "div": lambda: x / y, "mod": lambda: math.fmod(x, y)}[op]()
        return _compare(op, a, b)
    if kind == "filter":
        return _filter(_evaluate(e[1], n, pos, size, root), e[2], root)
    if kind == "path":
        nodes = [root] if e[1] else [n] if e[3] is None else _evaluate(e[3], n, pos, size, root)
        for axis, test, predicates in e[2]:
            found: dict[int, XNode] = {}
            for x in nodes:
                for y in _filter([y for y in _axis(x, axis) if _test(y, test, axis)], predicates, root):
                    found[id(y)] = y
            nodes = sorted(found.values(), key=lambda x: x.order)
        return nodes
    name, args = e[1], [_evaluate(a, n, pos, size, root) for a in e[2]]
    own = lambda i=0: args[i] if len(args) > i else [n]
    calls = {
        "position": lambda: float(pos),
        "last": lambda: float(size),
        "count": lambda: float(len(args[0])),
        "contains": lambda: _string(args[1]) in _string(args[0]),
        "starts-with": lambda: _string(args[0]).startswith(_string(args[1])),
        "normalize-space": lambda: " ".join(_string(own()).split()),
        "string": lambda: _string(own()),
        "string-length": lambda: float(len(_string(own()))),
        "not": lambda: not _bool(args[0]),
        "boolean": lambda: _bool(args[0]),
        "number": lambda: _number(own()),
        "true": lambda: True,
        "false": lambda: False,
        "concat": lambda: "".join(map(_string, args)),
        "sum": lambda: float(sum(_number(x.string()) for x in args[0])),
        "name": lambda: own()[0].name if own() else "",
        "local-name": lambda: own()[0].name.rpartition(":")[2] if own() else "",
        "substring": lambda: _substring(_string(args[0]), *map(_number, args[1:])),
        "substring-before": lambda: _string(args[0]).partition(_string(args[1]))[0] if _string(args[1]) in _string(args[0]) else "",
        "substring-after": lambda: _string(args[0]).partition(_string(args[1]))[2],
        "translate": lambda: _string(args[0]).translate({ord(c): (_string(args[2])[i] if i < len(_string(args[2])) else None) for i, c in reversed(list(enumerate(_string(args[1]))))}),
        "floor": lambda: float(math.floor(_number(args[0]))),
        "ceiling": lambda: float(math.ceil(_number(args[0]))),
        "round": lambda: float(_round(_number(args[0]))),
    }
    return calls[name]()


def _filter(nodes: list[XNode], predicates: list, root: XNode) -> list[XNode]:
    for p in predicates:
        kept = []
        for i, x in enumerate(nodes, 1):
            v = _evaluate(p, x, i, len(nodes), root)
            if v == i if isinstance(v, float) else _bool(v):
                kept.append(x)
        nodes = kept
    return nodes


def xpath_strings(root: XNode | None, expression: str) -> list[str]:
    if root is None:
        return []
    try:
        v = _evaluate(compile_xpath(expression), root, 1, 1, root)
    except (ValueError, KeyError, IndexError, AttributeError, TypeError, RecursionError):
        return []
    return [x.string() for x in v] if isinstance(v, list) else [_string(v)]
