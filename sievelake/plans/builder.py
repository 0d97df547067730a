"""The chained query builder. Builders are values: each call gives a new one."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from sievelake.plans.nodes import And, Kind, Node, Not, Or, Predicate, Query, TopK

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from sievelake.store import Store


@dataclass(frozen=True)
class QueryBuilder:
    """An implicit AND of what is chained. Nodes given to any_of() and exclude() may be builders themselves."""

    store: Store | None = None
    children: tuple[Node, ...] = ()
    order: TopK | None = None

    def _with(self, node: Node) -> QueryBuilder:
        return replace(self, children=(*self.children, node))

    def _test(self, kind: Kind, attribute: str, *args: Any) -> QueryBuilder:
        return self._with(Predicate(kind, attribute, args))

    def equals(self, attribute: str, value: Any) -> QueryBuilder:
        return self._test(Kind.EQUALS, attribute, value)

    def range(self, attribute: str, low: Any, high: Any) -> QueryBuilder:
        """Both ends belong to it."""
        return self._test(Kind.RANGE, attribute, low, high)

    def prefix(self, attribute: str, prefix: str) -> QueryBuilder:
        return self._test(Kind.PREFIX, attribute, prefix)

    def contains(self, attribute: str, word: str) -> QueryBuilder:
        """A whole word, whatever its case."""
        return self._test(Kind.CONTAINS, attribute, word)

    def fuzzy(self, attribute: str, target: str, threshold: float = 0.5) -> QueryBuilder:
        """Jaccard similarity of padded trigrams of at least the threshold."""
        return self._test(Kind.FUZZY, attribute, target, threshold)

    def substring(self, attribute: str, text: str) -> QueryBuilder:
        return self._test(Kind.SUBSTRING, attribute, text)

    def within_box(self, attribute: str, min_x: float, min_y: float, max_x: float, max_y: float) -> QueryBuilder:
        return self._test(Kind.WITHIN_BOX, attribute, min_x, min_y, max_x, max_y)

    def near(self, attribute: str, x: float, y: float, radius: float) -> QueryBuilder:
        return self._test(Kind.NEAR, attribute, x, y, radius)

    def any_of(self, nodes: Iterable[Node | QueryBuilder]) -> QueryBuilder:
        given = [n.to_node() if isinstance(n, QueryBuilder) else n for n in nodes]
        return self._with(Or(tuple(And() if n is None else n for n in given)))

    def exclude(self, node: Node | QueryBuilder | None) -> QueryBuilder:
        return self._with(Not(node.to_node() if isinstance(node, QueryBuilder) else node))

    def top_k(self, attribute: str, k: int, descending: bool = True) -> QueryBuilder:
        """The last call counts; rows without the attribute are left out."""
        return replace(self, order=TopK(attribute, k, descending))

    def to_node(self) -> Node | None:
        """The AND of what was chained; the ordering isn't part of it."""
        return None if not self.children else self.children[0] if len(self.children) == 1 else And(self.children)

    def query(self) -> Query:
        return Query(self.to_node(), self.order)

    def execute(self, with_id: bool = False) -> DataFrame:
        if self.store is None:
            raise ValueError("this builder belongs to no store; use Store.execute(builder.query())")
        return self.store.execute(self.query(), with_id=with_id)
