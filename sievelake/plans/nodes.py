"""What a query says: predicates, boolean nodes and the final ordering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import StrEnum
from typing import Any


class Kind(StrEnum):
    EQUALS = "equals"
    RANGE = "range"
    PREFIX = "prefix"
    CONTAINS = "contains"
    FUZZY = "fuzzy"
    SUBSTRING = "substring"
    WITHIN_BOX = "within_box"
    NEAR = "near"


@dataclass(frozen=True)
class Predicate:
    """One test of one attribute. `args` are the kind's operands in the builder's order."""

    kind: Kind
    attribute: str
    args: tuple[Any, ...]


@dataclass(frozen=True)
class And:
    """All children hold; without children, everything does."""

    children: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Or:
    """Some child holds; without children, nothing does."""

    children: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Not:
    """The child doesn't hold, which includes rows that lack its attribute. Without a child, everything holds."""

    child: Node | None = None


type Node = Predicate | And | Or | Not


@dataclass(frozen=True)
class TopK:
    attribute: str
    k: int
    descending: bool = True


@dataclass(frozen=True)
class Query:
    where: Node | None = None
    top_k: TopK | None = None


def predicates(node: Node | None) -> Sequence[Predicate]:
    """All predicates of a tree, in written order."""
    if node is None:
        return ()
    if isinstance(node, Predicate):
        return (node,)
    inner = (node.child,) if isinstance(node, Not) else node.children
    return tuple(p for c in inner for p in predicates(c))


@dataclass
class Shape:
    """How attributes map to columns: a name to its column's type, and points that are kept as two columns."""

    types: dict[str, Any]
    points: dict[str, tuple[str, str]] = field(default_factory=dict)
