"""The query language: a tree of fuzzy and temporal operators over (expert, query) leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

from cuesift.config import EXPERTS

OPERATORS = ("AND", "OR", "SEQ", "RIGHT_AFTER", "LEAF")


class TreeError(ValueError):
    """A tree that breaks the rules of the language."""


class MissingLeaf(ValueError):
    """A leaf without a signal."""


@dataclass(frozen=True)
class Leaf:
    """A leaf's number (leaves only, left to right from 0) and where it stands in the tree."""

    node_id: int
    expert: str
    query: str
    depth: int
    path: str


@dataclass(frozen=True)
class Node:
    op: str
    children: tuple[Node, ...] = ()
    expert: str | None = None
    query: str | None = None

    @staticmethod
    def leaf(expert: str, query: str) -> Node:
        return Node("LEAF", (), expert, query)

    @staticmethod
    def of(op: str, *children: Node) -> Node:
        return Node(op, tuple(children))

    @property
    def is_leaf(self) -> bool:
        return self.op == "LEAF"

    @staticmethod
    def from_dict(data: object) -> Node:
        """Read and validate a tree; keys that are null count as absent."""
        if not isinstance(data, dict):
            raise TreeError(f"a node has to be an object, not {type(data).__name__}")
        children = data.get("children") or []
        if not isinstance(children, list):
            raise TreeError("children have to be a list")
        node = Node(data.get("op"), tuple(Node.from_dict(c) for c in children), data.get("expert"), data.get("query"))
        node._check()
        return node

    @staticmethod
    def from_json(text: str) -> Node:
        try:
            return Node.from_dict(json.loads(text))
        except json.JSONDecodeError as e:
            raise TreeError(f"not JSON: {e}") from e

    def to_dict(self) -> dict:
        if self.is_leaf:
            return {"op": "LEAF", "expert": self.expert, "query": self.query}
        return {"op": self.op, "children": [c.to_dict() for c in self.children]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    def _check(self) -> None:
        if self.op not in OPERATORS:
            raise TreeError(f"unknown operator {self.op!r}")
        if self.is_leaf:
            if not self.expert or not self.query:
                raise TreeError("a leaf needs an expert and a query")
            if self.expert not in EXPERTS:
                raise TreeError(f"unknown expert {self.expert!r}")
            if self.children:
                raise TreeError("a leaf has no children")
        elif not self.children:
            raise TreeError(f"{self.op} needs children")
        elif self.op == "SEQ" and len(self.children) < 2:
            raise TreeError("SEQ needs two children or more")
        elif self.op == "RIGHT_AFTER" and len(self.children) != 2:
            raise TreeError("RIGHT_AFTER needs exactly two children")

    def validate(self) -> Node:
        self._check()
        for child in self.children:
            child.validate()
        return self

    def leaves(self) -> list[Leaf]:
        def walk(node: Node, depth: int, path: str) -> Iterator[tuple[Node, int, str]]:
            if node.is_leaf:
                yield node, depth, path
            for i, child in enumerate(node.children):
                yield from walk(child, depth + 1, f"{path}.{i}")

        return [Leaf(i, n.expert, n.query, depth, path) for i, (n, depth, path) in enumerate(walk(self, 0, "0"))]

    def height(self) -> int:
        return 0 if self.is_leaf else 1 + max(c.height() for c in self.children)


def leaves_by_expert(node: Node) -> dict[str, list[tuple[int, str]]]:
    """(node id, query) of each expert, experts in the order in which they first occur."""
    out: dict[str, list[tuple[int, str]]] = {}
    for leaf in node.leaves():
        out.setdefault(leaf.expert, []).append((leaf.node_id, leaf.query))
    return out


def repair(data: object) -> object:
    """A tree's JSON value with every RIGHT_AFTER of three or more children nested to the right.

    RIGHT_AFTER(A, B, C) becomes RIGHT_AFTER(A, RIGHT_AFTER(B, C)). The input stays as it is; what
    isn't an object is returned unchanged.
    """
    if not isinstance(data, dict):
        return data
    children = data.get("children")
    if not isinstance(children, list):
        return dict(data)
    fixed = [repair(c) for c in children]
    if data.get("op") == "RIGHT_AFTER" and len(fixed) > 2:
        last = fixed.pop()
        while len(fixed) > 1:
            last = {"op": "RIGHT_AFTER", "children": [fixed.pop(), last]}
        fixed.append(last)
    return {**data, "children": fixed}


def prune(node: Node, enabled: set[str]) -> Node | None:
    """The tree without leaves of other experts; an inner node left without enough children gives way to its child."""
    if node.is_leaf:
        return node if node.expert in enabled else None
    left = [c for c in (prune(c, enabled) for c in node.children) if c is not None]
    if not left:
        return None
    if len(left) == 1 and len(node.children) > 1:
        return left[0]
    return replace(node, children=tuple(left))


def simplified(node: Node, and_mode: str = "product") -> Node:
    """An equal tree for plain evaluation: lone children of AND and OR lifted, nested OR and AND merged.

    Only plain evaluation allows it: under rescaling every child counts on its own. The
    geometric mean isn't associative, so its ANDs stay.
    """
    if node.is_leaf:
        return node
    children = [simplified(c, and_mode) for c in node.children]
    if node.op in ("AND", "OR"):
        if node.op == "OR" or and_mode != "geometric_mean":
            children = [g for c in children for g in (c.children if c.op == node.op else (c,))]
        if len(children) == 1:
            return children[0]
    return replace(node, children=tuple(children))


def explain(node: Node) -> str:
    """The tree as text, a node per line."""

    def lines(n: Node, lead: str, last: bool, top: bool) -> Iterator[str]:
        name = f'{n.expert}("{n.query}")' if n.is_leaf else n.op
        yield name if top else f"{lead}{'└── ' if last else '├── '}{name}"
        deeper = "" if top else lead + ("    " if last else "│   ")
        for i, child in enumerate(n.children):
            yield from lines(child, deeper, i == len(n.children) - 1, False)

    return "\n".join(lines(node, "", True, True))
