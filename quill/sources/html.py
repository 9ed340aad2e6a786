"""Small HTML tree and selector helpers used inside the page-extraction task.

Per-row helper only (stdlib ``html.parser``); the distributed work — one parse
per page, batched through Arrow — is ``sources.pages``.
"""
from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr", "param", "keygen"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent=None):
        self.tag = tag
        self.attrs = attrs
        self.children = []
        self.parent = parent

    def text(self) -> str:
        out = []
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def iter(self):
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack.extend(reversed(n.children))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {})
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur)
        self.cur.children.append(n)
        if tag not in VOID:
            self.cur = n

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:  # close up to the matching open tag
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


_SIMPLE = re.compile(r"^(?P<tag>[a-zA-Z0-9*]+)?(?P<rest>(?:[.#][\w-]+|\[[^\]]+\])*)$")


class Simple:
    """One compound selector: ``tag.class#id[attr=value][attr]``."""

    def __init__(self, text: str):
        m = _SIMPLE.match(text)
        if not m:
            raise ValueError(f"unsupported selector {text!r}")
        self.tag = None if m.group("tag") in (None, "*") else m.group("tag").lower()
        self.classes, self.id, self.attrs = [], None, []
        for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m.group("rest") or ""):
            if part[0] == ".":
                self.classes.append(part[1:])
            elif part[0] == "#":
                self.id = part[1:]
            else:
                body = part[1:-1]
                if "=" in body:
                    k, v = body.split("=", 1)
                    self.attrs.append((k.strip(), v.strip().strip("'\"")))
                else:
                    self.attrs.append((body.strip(), None))

    def match(self, n: Node) -> bool:
        if self.tag and n.tag != self.tag:
            return False
        if self.classes:
            have = n.attrs.get("class", "").split()
            if any(c not in have for c in self.classes):
                return False
        if self.id is not None and n.attrs.get("id") != self.id:
            return False
        for k, v in self.attrs:
            if k not in n.attrs or (v is not None and n.attrs[k] != v):
                return False
        return True


def chain(selector: str) -> list[Simple]:
    """The steps of a selector; an unsupported one raises."""
    steps = [Simple(p) for p in selector.split()]
    if not steps:
        raise ValueError("empty selector")
    return steps


def find(root: Node, steps: list[Simple]) -> Node | None:
    """First match of each step inside the previous step's first match
    (``find(a).find(b)``)."""
    cur = root
    for s in steps:
        cur = next((n for n in cur.iter() if s.match(n)), None)
        if cur is None:
            return None
    return cur


def find_all(root: Node, steps: list[Simple]) -> list[Node]:
    """All matches of the last step inside the first match of the steps before."""
    cur = find(root, steps[:-1]) if len(steps) > 1 else root
    return [] if cur is None else [n for n in cur.iter() if steps[-1].match(n)]


def select(root: Node, steps: list[Simple]) -> list[Node]:
    """All nodes that match as a CSS descendant selector, in document order:
    the last step matches the node, the others match ancestors in order."""
    found = []
    for n in root.iter():
        if steps[-1].match(n):
            left, up = len(steps) - 1, n.parent
            while left and up is not None:
                if steps[left - 1].match(up):
                    left -= 1
                up = up.parent
            if not left:
                found.append(n)
    return found
