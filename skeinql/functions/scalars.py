"""Scalar functions with the host language's semantics: equality that nulls satisfy, 0-based places, guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def same(a: Column | str, b: object) -> Column:
    """a == b where two nulls are equal; never unknown."""
    return col(a).eqNullSafe(b)


def differ(a: Column | str, b: object) -> Column:
    return ~same(a, b)


def index_of(s: Column | str, part: str) -> Column:
    """Place of the first occurrence, -1 if absent."""
    return F.instr(col(s), part) - 1


def last_index_of(s: Column | str, char: str) -> Column:
    """Place of a character's last occurrence, -1 if absent."""
    back = F.instr(F.reverse(col(s)), char)
    return F.when(back == 0, -1).otherwise(F.length(col(s)) - back)


def char_at(s: Column | str, i: int) -> Column:
    """The character at place i; null beyond the end."""
    return F.when(F.length(col(s)) > i, F.substring(col(s), i + 1, 1))


def is_digit(c: Column | str) -> Column:
    return F.rlike(col(c), F.lit(r"^\p{Nd}$"))


def finds(s: Column | str, pattern: str) -> Column:
    """Whether the pattern matches somewhere in s."""
    return F.rlike(col(s), F.lit(pattern))


def concat(*parts: Column | str) -> Column:
    """Null parts read "null"."""
    return F.concat(*(F.coalesce(col(p).cast("string"), F.lit("null")) for p in parts))


def to_text(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit("null"))


def larger(a: Column | str, b: Column | str) -> Column:
    return F.greatest(col(a), col(b))


def divide(a: Column | str, b: Column | str) -> Column:
    """Fractional division; by zero gives an infinity or NaN, not an error."""
    a, b = col(a).cast("double"), col(b).cast("double")
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def if_else(*branches: tuple[Column, object], default: object) -> Column:
    """The value of the first condition that holds; conditions that are unknown don't."""
    out = F
    for condition, value in branches:
        out = out.when(condition, value)
    return out.otherwise(default)


def guarded(condition: Column, then: Column, otherwise: object = False) -> Column:
    """then, evaluated only where condition holds."""
    return F.when(condition, then).otherwise(F.lit(otherwise))


def letting(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body takes it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Options are nullable columns.


def is_defined(c: Column | str) -> Column:
    return col(c).isNotNull()


def get_or_else(c: Column | str, default: object) -> Column:
    return F.coalesce(col(c), default if isinstance(default, Column) else F.lit(default))


or_else = get_or_else


def option_fold(c: Column | str, none: object, some: Callable[[Column], Column]) -> Column:
    return F.when(col(c).isNotNull(), some(col(c))).otherwise(none)


def option_map(c: Column | str, f: Callable[[Column], Column]) -> Column:
    return F.when(col(c).isNotNull(), f(col(c)))


def option_filter(c: Column | str, p: Callable[[Column], Column]) -> Column:
    return F.when(col(c).isNotNull() & p(col(c)), col(c))


# Collections in a column are arrays. Folds of a named array remember it, so that those of a group's
# elements can be aggregates instead (Query.map).


def _folds(c: Column, over: Column | str, fold: Callable[[Column, bool], Column]) -> Column:
    """c, marked as a fold of the array of that name. fold: the aggregate of an element, of different
    elements only if so said."""
    if isinstance(over, str):
        c.__dict__["_fold"] = over, fold
    return c


def _unless_null(v: Column, of: Column) -> Column:
    """An aggregate that is null if an element is, as a fold over a list is."""
    return F.when(F.count(v) == F.count(F.lit(1)), of)


def size(a: Column | str) -> Column:
    return _folds(F.size(col(a)), a, lambda v, distinct: (F.count_distinct(F.struct(v)) if distinct else F.count(F.lit(1))).cast("int"))


def exists(a: Column | str, p: Callable[[Column], Column]) -> Column:
    """Stops at the first element that satisfies p; an empty or null array has none."""
    return _folds(F.coalesce(F.exists(col(a), p), F.lit(False)), a, lambda v, _: F.coalesce(F.bool_or(p(v)), F.lit(False)))


def forall(a: Column | str, p: Callable[[Column], Column]) -> Column:
    return _folds(F.coalesce(F.forall(col(a), p), F.lit(True)), a, lambda v, _: F.coalesce(F.bool_and(p(v)), F.lit(True)))


def filtered(a: Column | str, p: Callable[[Column], Column]) -> Column:
    out = F.filter(col(a), p)
    out.__dict__["_filtered"] = a, p
    return out


def is_empty(a: Column | str) -> Column:
    """Of a filtered array: stops at the first element that is left."""
    if isinstance(a, Column) and (parts := a.__dict__.get("_filtered")):
        return ~exists(*parts)
    return _folds(F.coalesce(F.size(col(a)), F.lit(0)) <= 0, a, lambda v, _: F.count(F.lit(1)) == 0)


#: Comparisons by their signs.
COMPARE: dict[str, Callable] = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def asks_emptiness(op: str, n: int) -> bool | None:
    """Whether a comparison of a size with n holds for empty collections alone (True) or for all others
    alone (False); None if it asks for more."""
    if (op, n) in ((">", 0), (">=", 1), ("!=", 0)):
        return False
    return True if (op, n) in (("==", 0), ("<", 1), ("<=", 0)) else None


def sized(a: Column | str, op: str, n: int) -> Column:
    """A comparison of an array's size, by emptiness where that is all it asks."""
    empty = asks_emptiness(op, n)
    if empty is None:
        return COMPARE[op](F.greatest(F.coalesce(F.size(col(a)), F.lit(0)), F.lit(0)), n)
    return is_empty(a) if empty else ~is_empty(a)


def sorted_(a: Column | str) -> Column:
    """Ascending, nulls first."""
    out = F.sort_array(col(a))
    out.__dict__["_sorted"] = a
    return out


def at(a: Column | str, i: int) -> Column:
    return F.get(col(a), F.lit(i))


def head(a: Column | str) -> Column:
    """An error where the array is empty."""
    return F.element_at(col(a), 1)


def last(a: Column | str) -> Column:
    return F.element_at(col(a), -1)


def head_option(a: Column | str) -> Column:
    """Of a sorted group's elements: their minimum."""
    over = a.__dict__.get("_sorted") if isinstance(a, Column) else None
    return _folds(F.get(col(a), F.lit(0)), over, lambda v, _: _unless_null(v, F.min(v)))


def last_option(a: Column | str) -> Column:
    over = a.__dict__.get("_sorted") if isinstance(a, Column) else None
    return _folds(F.try_element_at(col(a), F.lit(-1)), over, lambda v, _: F.max(v))


def fold_left(a: Column | str, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(col(a), zero, op)


def array_sum(a: Column | str, kind: str = "long") -> Column:
    total = lambda v, distinct: _unless_null(v, (F.sum_distinct if distinct else F.sum)(v.cast(kind)).cast(kind))
    return _folds(F.aggregate(col(a), F.lit(0).cast(kind), lambda x, y: x + y.cast(kind)), a, total)


def array_product(a: Column | str, kind: str = "double") -> Column:
    out = F.aggregate(col(a), F.lit(1).cast(kind), lambda x, y: x * y.cast(kind))
    if kind != "double":
        return out
    return out if not isinstance(a, str) else _folds(out, a, lambda v, distinct: F.aggregate(F.collect_set(v), F.lit(1.0), lambda x, y: x * y.cast(kind)) if distinct else _unless_null(v, F.product(v.cast(kind))))


def sliding(a: Column | str, n: int) -> Column:
    """All runs of n elements; a shorter array has one, itself, and an empty one none."""
    a = col(a)
    starts = F.sequence(F.lit(1), F.greatest(F.size(a) - n + 1, F.lit(1)))
    return F.when(F.size(a) > 0, F.transform(starts, lambda i: F.slice(a, i, n))).otherwise(F.slice(F.array(a), 1, 0))


def zip_with_index(a: Column | str) -> Column:
    return F.transform(col(a), lambda x, i: F.struct(x.alias("_1"), i.alias("_2")))


def unzip(a: Column | str) -> Column:
    a = col(a)
    return F.struct(F.transform(a, lambda x: x["_1"]).alias("_1"), F.transform(a, lambda x: x["_2"]).alias("_2"))


def int_range(a: Column, b: Column) -> Column:
    """a until b; empty unless a < b."""
    return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.slice(F.sequence(a, a), 1, 0))


def wrapped(c: Column | str, kind: str = "int") -> Column:
    """A long sum or product as a machine integer of the host language keeps it: its low bits."""
    bits = 32 if kind == "int" else 64
    return col(c) if bits == 64 else (F.pmod(col(c) + (1 << 31), F.lit(1 << 32)) - (1 << 31)).cast("int")


def to_iterable(c: Column | str) -> Column:
    """An option as a collection of none or one."""
    return F.when(col(c).isNull(), F.slice(F.array(col(c)), 1, 0)).otherwise(F.array(col(c)))
