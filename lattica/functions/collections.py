"""Collections inside a record: Spark's higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.scalars import col


class Fields:
    """A record-valued column whose fields are attributes, as plain columns; use() hears which are read."""

    def __init__(self, column: Column, use: Callable[[str], None] = lambda name: None):
        self._inner, self._use = column, use

    @property
    def _column(self) -> Column:
        self._use("*")
        return self._inner

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        self._use(name)
        return self._inner[name]

    __getitem__ = __getattr__


class Items:
    """An array of records from a join. What lambdas read of its records is heard, so that no more need be gathered.

    Where only the number of records, and sums and extremes of their fields are read, the join makes these instead of the
    array; the column is then a record of them, named as COUNT and figure() say.
    """

    def __init__(self, column: Column, use: Callable[[str], None], figures: bool = False):
        self._inner, self._use, self._figures = column, use, figures

    @property
    def _column(self) -> Column:
        self._use("*")
        return self._inner


#: The names of figures of a joined array begin so; no field's name does.
MARK = "#"
COUNT = "#count"
#: What is heard where the array itself is gone over, whichever fields are read.
WHOLE = ""


def figure(kind: str, field: str) -> str:
    return f"{MARK}{kind}:{field}"


class Mapped:
    """map_ of an array from a join, until it is known whether a figure of it is asked for or the array. Anything but the
    functions of this library takes it as the array's column."""

    def __init__(self, items: Items, f: Callable):
        self._items, self._f = items, f

    @property
    def _column(self) -> Column:
        items, f = self._items, self._f
        items._use(WHOLE)
        return F.transform(items._inner, lambda e: col(f(Fields(e, items._use))))

    def __getitem__(self, i) -> Column:
        return self._column[i]

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._column, name)

    def _field(self) -> str | None:
        """The field that f gives as it is, if it does so."""
        met: dict[str, object] = {}

        class Met:
            def __getattr__(self, name: str) -> object:
                return met.setdefault(name, F.lit(name))

            __getitem__ = __getattr__

        try:
            told = self._f(Met())
        except Exception:  # f does more with its argument than reading a field
            return None
        return next((k for k, v in met.items() if v is told), None)


def _figure(x, kind: str, plain: Callable[[Column], Column]) -> Column:
    """plain of an array, or the join's figure of it."""
    if isinstance(x, Mapped) and (name := x._field()) is not None:
        told = figure(kind, name)
        x._items._use(told)
        if x._items._figures:
            return x._items._inner[told]
        return plain(F.transform(x._items._inner, lambda e: e[name]))
    return plain(col(x))


def _over(items, f: Callable) -> tuple[Column, Callable[[Column], Column]]:
    """The array, and f over its elements as columns."""
    if isinstance(items, Items):
        items._use(WHOLE)
        return items._inner, lambda e: col(f(Fields(e, items._use)))
    return col(items), lambda e: col(f(e))


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once: what a lambda names from outside is computed again for each element."""
    return F.get(F.transform(F.array(x), f), 0)


def length(x) -> Column:
    """Of an array or map."""
    if isinstance(x, Mapped):
        x = x._items
    if isinstance(x, Items):
        x._use(COUNT)
        return x._inner[COUNT] if x._figures else F.size(x._inner).cast("bigint")
    return F.size(col(x)).cast("bigint")


def text_length(s) -> Column:
    return F.length(col(s)).cast("bigint")


def bytes_length(s) -> Column:
    return F.octet_length(col(s)).cast("bigint")


def empty(x) -> Column:
    return length(x) == 0


def text_empty(s) -> Column:
    return F.length(col(s)) == 0


def contains(array, x) -> Column:
    return F.coalesce(F.array_contains(col(array), col(x)), F.lit(False))


in_ = lambda x, array: contains(array, x)


def contains_key(m, key) -> Column:
    return F.coalesce(F.map_contains_key(col(m), key), F.lit(False))


def to_array(x) -> Column:
    return col(x)


def map_to_array(m) -> Column:
    return F.map_entries(col(m))


def flatten(x) -> Column:
    return F.flatten(col(x))


collect = flatten


def to_set(x) -> Column:
    return F.array_distinct(col(x))


def map_(items, f) -> Column | Mapped:
    if isinstance(items, Items):
        return Mapped(items, f)
    array, g = _over(items, f)
    return F.transform(array, g)


def filter_(items, f) -> Column:
    array, g = _over(items, f)
    return F.filter(array, g)


def to_map(items, key, value) -> Column:
    """The last of equal keys wins. Sorted by key, so that a long array doesn't meet itself."""
    array, k = _over(items, key)
    _, v = _over(items, value)
    pairs = F.transform(array, lambda e: F.struct(k(e).alias("k"), v(e).alias("v")))
    ranked = F.sort_array(F.transform(array, lambda e, i: F.struct(k(e).alias("k"), i.alias("i"))))
    last = lambda s: F.filter(s, lambda e, i: ~F.coalesce(F.get(s, i + 1)["k"] == e["k"], F.lit(False)))
    places = F.sort_array(F.transform(_bound(ranked, last), lambda e: e["i"]))
    return F.map_from_entries(_bound(pairs, lambda p: F.transform(places, lambda i: F.get(p, i))))


def zip_(*arrays) -> Column:
    """Structs _1, _2 ... as long as the shortest array."""
    cols = [col(a) for a in arrays]
    n = F.least(*(F.size(c) for c in cols)) if len(cols) > 1 else F.size(cols[0])
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(*(F.get(c, i).alias(f"_{k}") for k, c in enumerate(cols, 1))))


def aggregate_to_array(items, key, value) -> Column:
    """Structs (_1 key, _2 values): keys ascending, null last, values in their order. Elements are sorted by key once, and
    each group is a slice of them."""
    array, k = _over(items, key)
    _, v = _over(items, value)
    ranked = F.sort_array(F.transform(array, lambda e, i: F.struct(k(e).isNull().alias("n"), k(e).alias("k"), i.alias("i"))))
    values = F.transform(array, v)

    def grouped(s: Column, vs: Column) -> Column:
        first = F.transform(s, lambda e, i: F.when((i == 0) | ~F.get(s, i - 1)["k"].eqNullSafe(e["k"]), i))
        own = lambda b, e: F.transform(F.slice(s, b + 1, e - b), lambda x: F.get(vs, x["i"]))
        made = lambda at: F.transform(at, lambda b, j: F.struct(F.get(s, b)["k"].alias("_1"), own(b, F.coalesce(F.get(at, j + 1), F.size(s))).alias("_2")))
        return _bound(F.filter(first, lambda i: i.isNotNull()), made)

    return _bound(ranked, lambda s: _bound(values, lambda vs: grouped(s, vs)))


def aggregate_to_set(items, key, value) -> Column:
    return F.transform(aggregate_to_array(items, key, value), lambda g: F.struct(g["_1"].alias("_1"), F.array_distinct(g["_2"]).alias("_2")))


def sort(items, key, reverse: bool = False) -> Column:
    """Stable, also in reverse."""
    array, k = _over(items, key)
    up = F.lit(1 if reverse else -1)

    def order(a: Column, b: Column) -> Column:
        return F.when(k(a) < k(b), up).when(k(a) > k(b), -up).otherwise(F.lit(0))

    return F.array_sort(array, order)


def front(items) -> Column:
    return F.get(col(items), 0)


def shuffle(items, seed: int | None = None) -> Column:
    return F.shuffle(col(items), seed)


def total(items) -> Column:
    """Sum; 0 of nothing. Integers sum as Int, others as Float64."""
    return _figure(items, "total", lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x))


def total_int(items) -> Column:
    return _figure(items, "total_int", lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x))


def reduce_(items, start, f) -> Column:
    array = col(items)
    return F.aggregate(array, col(start), lambda a, x: col(f(a, x)))


def greatest(items) -> Column:
    return _figure(items, "greatest", F.array_max)


def least(items) -> Column:
    return _figure(items, "least", F.array_min)


def _ranked(items, f, pick: Callable[[Column], Column]) -> Column:
    array, k = _over(items, f)
    if isinstance(items, Items):
        items._use("*")
    return pick(F.transform(array, lambda e: F.struct(k(e).alias("k"), e.alias("e"))))["e"]


def max_by(items, f) -> Column:
    """Ties: the larger element. Null of nothing."""
    return _ranked(items, f, F.array_max)


def min_by(items, f) -> Column:
    """Ties: the smaller element. Null of nothing."""
    return _ranked(items, f, F.array_min)


def range_(start, stop, step: int = 1) -> Column:
    """stop isn't in it."""
    if step == 0:
        raise ValueError("range: step 0")
    a, b = col(start).cast("bigint"), col(stop).cast("bigint")
    some = a < b if step > 0 else a > b
    last = b - 1 if step > 0 else b + 1
    return F.when(some, F.sequence(a, last, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def at(array, i) -> Column:
    """Null out of range."""
    return F.get(col(array), col(i).cast("int"))


def value_of(m, key) -> Column:
    """Null if there is no such key."""
    return F.try_element_at(col(m), col(key))


def nth(record, i: int) -> Column:
    """Field i of a tuple, from 0."""
    return col(record)[f"_{i + 1}"]


def array(*xs) -> Column:
    return F.array(*map(col, xs))


def set_(*xs) -> Column:
    return F.array_distinct(array(*xs))


def dict_(pairs: dict) -> Column:
    return F.create_map(*(col(x) for kv in pairs.items() for x in kv))


def tuple_(*xs, **named) -> Column:
    parts = [col(x).alias(f"_{i}") for i, x in enumerate(xs, 1)]
    return F.struct(*parts, *(col(x).alias(n) for n, x in named.items()))
