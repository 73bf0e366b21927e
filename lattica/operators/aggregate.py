"""The aggregation builder: agg(row).group_by(...).sum(...)..., checked against the input's schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica import types as L
from lattica.functions.scalars import col

#: Aggregates: how, and what they take.
_MADE = {
    "sum": (F.sum, L.is_numeric), "mean": (F.avg, L.is_numeric), "min": (F.min, L.is_sortable), "max": (F.max, L.is_sortable),
    "count": (F.count, None), "count_distinct": (F.countDistinct, None), "to_set": (F.collect_set, None), "to_array": (F.collect_list, None),
}


@dataclass
class Agg:
    """Named values keep their names; the k-th value overall without one is arg_k, from 0."""

    row: object
    specs: list[tuple[str, str, object]] = field(default_factory=list)

    def _with(self, kind: str, values: tuple, named: dict) -> Agg:
        specs = list(self.specs)
        for v in values:
            specs.append((kind, f"arg_{len(specs)}", v))
        for name, v in named.items():
            specs.append((kind, name, v))
        return Agg(self.row, specs)

    def group_by(self, *values, **named) -> Agg:
        return self._with("group_by", values, named)

    def sum(self, *values, **named) -> Agg:
        return self._with("sum", values, named)

    def min(self, *values, **named) -> Agg:
        return self._with("min", values, named)

    def max(self, *values, **named) -> Agg:
        return self._with("max", values, named)

    def count(self, *values, **named) -> Agg:
        return self._with("count", values, named)

    def count_distinct(self, *values, **named) -> Agg:
        return self._with("count_distinct", values, named)

    def mean(self, *values, **named) -> Agg:
        return self._with("mean", values, named)

    def to_set(self, *values, **named) -> Agg:
        return self._with("to_set", values, named)

    def to_array(self, *values, **named) -> Agg:
        return self._with("to_array", values, named)

    def join(self, other: Agg) -> Agg:
        """Both specs, one after the other."""
        out = self
        for kind, name, v in other.specs:
            unnamed = name.startswith("arg_") and name[4:].isdigit()
            out = out._with(kind, (v,) if unnamed else (), {} if unnamed else {name: v})
        return out

    def columns(self, types: dict[str, T.DataType]) -> tuple[list[Column], list[Column], list[str]]:
        """Keys, aggregates and the names in declared order. types: of each value, by name."""
        names = [n for _, n, _ in self.specs]
        if not any(k != "group_by" for k, _, _ in self.specs):
            raise L.TypeError_("aggregate: no aggregation is given")
        if len(set(names)) < len(names):
            raise L.TypeError_(f"aggregate: repeated names in {names}")
        keys, made = [], []
        for kind, name, v in self.specs:
            if kind == "group_by":
                keys.append(col(v).alias(name))
                continue
            how, takes = _MADE[kind]
            if takes and not takes(types[name]):
                raise L.TypeError_(f"aggregate: {kind}({name}) doesn't take {types[name].simpleString()}")
            out = how(col(v))
            if kind == "sum" and not isinstance(types[name], T.DecimalType):
                out = out.cast(types[name] if isinstance(types[name], T.DoubleType) else T.DoubleType() if isinstance(types[name], T.FloatType) else T.LongType())
            made.append(out.alias(name))
        return keys, made, names
