"""Type-directed operators over tagged unions: a tag column names a row's type, a hierarchy its supertypes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinql.plans.index import Indexes
from skeinql.plans.query import Among, Query


class Hierarchy:
    """Of (child, parent) names, as a program's types are declared; may have several parents."""

    def __init__(self, edges: Iterable[tuple[str, str]]):
        self.parents: dict[str, set[str]] = {}
        for child, parent in edges:
            self.parents.setdefault(child, set()).add(parent)
            self.parents.setdefault(parent, set())
        self.children: dict[str, list[str]] = {}
        for child, parents in self.parents.items():
            for parent in parents:
                self.children.setdefault(parent, []).append(child)

    def subtypes(self, name: str) -> list[str]:
        """The type itself and all below it."""
        out, todo = {name}, [name]
        while todo:
            new = set(self.children.get(todo.pop(), ())) - out
            out |= new
            todo += new
        return sorted(out)

    def is_subtype(self, child: str, name: str) -> bool:
        return child in self.subtypes(name)

    def is_instance(self, tag: Column, name: str) -> Column:
        """False for a null tag."""
        return F.coalesce(tag.isin(*self.subtypes(name)), F.lit(False))

    def if_instance(self, tag: Column, name: str, payload: Column) -> Column:
        """The payload, or null where the row is of another type."""
        out = F.when(self.is_instance(tag, name), payload)
        out.__dict__["_instance"] = self.is_instance(tag, name)
        return out

    def as_instance(self, tag: Column, name: str, payload: Column) -> Column:
        """The payload; an error where the row is of another type. A null tag passes as null."""
        wrong = F.raise_error(F.concat(F.lit("not a "), F.lit(name), F.lit(": "), tag))
        return F.when(tag.isNull() | self.is_instance(tag, name), payload).otherwise(wrong)


def type_filter(q: Query, tag: str, name: str, types: Hierarchy) -> Query:
    """Rows of the type or one below it, as told by a tag (SQL text): a filter that reaches the scan,
    and that a type index answers."""
    return q.filter(Among(tag, tuple(types.subtypes(name))))


def type_case(q: Query, tag: str, types: Hierarchy, *cases: tuple[str, Column, Column], name: str = "value") -> Query:
    """cases: (type, guard, result). The first case that fits a row gives its result; rows that none
    fits are dropped, and the results are a set."""
    out, fits = F, F.lit(False)
    for kind, guard, result in cases:
        here = types.is_instance(F.col(tag), kind) & F.coalesce(guard, F.lit(False))
        out, fits = out.when(here, result), fits | here
    return Query(q.filter(fits).df.select(out.alias(name)).distinct(), "set")


class TypeIndex:
    """Rows stored by their tag: get() reads those of a type and the types below it. It is an index on
    the tag, so that Indexes.optimize() puts one of its own in place of a type filter likewise."""

    def __init__(self, q: Query, tag: str, types: Hierarchy, path: str):
        self.q, self.tag, self.types, self.indexes = q, tag, types, Indexes(path)
        self.indexes.add("types", q, tag)

    def get(self, name: str) -> Query:
        return self.indexes.optimize(type_filter(self.q, self.tag, name, self.types))
