"""Datasets: lazy, typed plans over Spark DataFrames.

A plan is a tree of steps. Lowering it asks each step for the fields that the steps above read, so that a nesting join
gathers no more of its right records than that (Catalyst can't narrow an array of records once it is gathered), and
leaves a join out where nothing of it is read and rows can't multiply. Where the steps above read only figures of the
right records (their number, sums, extremes), the join aggregates these and gathers no records. All else is left to
Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica import types as L
from lattica.functions.collections import COUNT, MARK, WHOLE, Fields, Items, Mapped, figure
from lattica.functions.scalars import col
from lattica.operators.aggregate import Agg
from lattica.operators.join import RightSpec

#: Fields read of a step's output, with the fields read of a nested one ("*": all). None: everything.
Need = dict[str, set[str]] | None

#: Whether steps are asked for the fields that are read only, or for all.
_pruning: ContextVar[bool] = ContextVar("pruning", default=True)


class Row:
    """What a lambda gets: fields as attributes. Fields with records inside are Fields or Items; the row as a column is a
    struct of all its fields."""

    def __init__(self, df: DataFrame, read: dict[str, set[str]]):
        self._df, self._read = df, read

    def __getattr__(self, name: str) -> Column | Fields | Items:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._df.columns:
            raise L.TypeError_(f"no field {name} in {self._df.columns}")
        use = self._read.setdefault(name, set()).add
        column, kind = self._df[name], self._df.schema[name].dataType
        if isinstance(kind, T.StructType):
            return Items(column, use, True) if kind.names and kind.names[0].startswith(MARK) else Fields(column, use)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return Items(column, use)
        use("*")
        return column

    __getitem__ = __getattr__

    @property
    def _column(self) -> Column:
        for name in self._df.columns:
            self._read.setdefault(name, set()).add("*")
        return F.struct(*(self._df[c].alias(c) for c in self._df.columns))


def _projected(made: object) -> list[Column]:
    """The columns of a record that a lambda made: a dict, a Row, or a struct column."""
    if isinstance(made, dict):
        return [col(v).alias(k) for k, v in made.items()]
    if isinstance(made, Row):
        return [col(getattr(made, c)).alias(c) for c in made._df.columns]
    raise L.TypeError_("map: the function must give a record, as a dict of fields")


@dataclass
class Dataset:
    """Built by the sources; every method gives a new one, and nothing runs before collect()."""

    _lower: Callable[[Need], DataFrame]
    _memo: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def frame(self, need: Need = None) -> DataFrame:
        """The plan as a DataFrame; equal requests give the same one, so that Spark reuses exchanges."""
        if not _pruning.get():
            need = None
        told = repr((_pruning.get(), need and sorted((k, sorted(v)) for k, v in need.items())))
        if told not in self._memo:
            self._memo[told] = self._lower(need)
        return self._memo[told]

    @property
    def schema(self) -> T.StructType:
        return self.frame().schema

    def _reads(self, f: Callable) -> dict[str, set[str]]:
        """What f reads of this dataset's rows."""
        read: dict[str, set[str]] = {}
        made = f(Row(self.frame(), read))
        if isinstance(made, Agg):
            made = [v for _, _, v in made.specs]
        elif isinstance(made, dict):
            made = list(made.values())
        for v in made if isinstance(made, list) else [made]:
            if isinstance(v, Row | Fields | Items | Mapped):
                col(v)
        return read

    def filter(self, f: Callable) -> Dataset:
        reads = self._reads(f)
        kind = self.frame().select(col(f(Row(self.frame(), {}))).alias("x")).schema["x"].dataType
        if not isinstance(kind, T.BooleanType):
            raise L.TypeError_(f"filter: the function must give Bool, not {kind.simpleString()}")

        def lower(need: Need) -> DataFrame:
            df = self.frame(need if need is None else _union(need, reads))
            return df.filter(col(f(Row(df, {}))))

        return Dataset(lower)

    def map(self, f: Callable) -> Dataset:
        reads = self._reads(f)

        def lower(need: Need) -> DataFrame:
            df = self.frame(reads)
            return df.select(*_projected(f(Row(df, {}))))

        return Dataset(lower)

    def flat_map(self, f: Callable) -> Dataset:
        """f gives an array of records (of values: the field is value); empty and null ones vanish."""
        reads = self._reads(f)

        def lower(need: Need) -> DataFrame:
            df = self.frame(reads)
            array = col(f(Row(df, {})))
            kind = df.select(array.alias("x")).schema["x"].dataType
            if not isinstance(kind, T.ArrayType):
                raise L.TypeError_(f"flat_map: the function must give an array, not {kind.simpleString()}")
            return df.select(F.inline(array) if isinstance(kind.elementType, T.StructType) else F.explode(array).alias("value"))

        return Dataset(lower)

    def limit(self, n: int) -> Dataset:
        """Any n rows."""
        return Dataset(lambda need: self.frame(need).limit(n))

    def sort_asc(self, key: Callable) -> Dataset:
        return self._sorted(key, lambda k: k.asc())

    def sort_desc(self, key: Callable) -> Dataset:
        return self._sorted(key, lambda k: k.desc())

    def _sorted(self, key: Callable, way: Callable[[Column], Column]) -> Dataset:
        reads = self._reads(key)

        def lower(need: Need) -> DataFrame:
            df = self.frame(need if need is None else _union(need, reads))
            return df.orderBy(way(col(key(Row(df, {})))))

        return Dataset(lower)

    def aggregate(self, build: Callable[[Row], Agg]) -> Dataset:
        reads = self._reads(build)
        df = self.frame()
        spec = build(Row(df, {}))
        if not isinstance(spec, Agg):
            raise L.TypeError_("aggregate: the function must give agg(row) with aggregates")
        values = [col(v).alias(f"v{i}") for i, (_, _, v) in enumerate(spec.specs)]
        kinds = [f.dataType for f in df.select(*values).schema.fields] if values else []
        types = {name: kind for (_, name, _), kind in zip(spec.specs, kinds, strict=True)}
        spec.columns(types)

        def lower(need: Need) -> DataFrame:
            own = self.frame(reads)
            keys, made, names = build(Row(own, {})).columns(types)
            out = own.groupBy(*keys).agg(*made) if keys else own.agg(*made)
            return out.select(*names)

        return Dataset(lower)

    def join_by(self, key: Callable) -> RightSpec:
        return RightSpec([self], key, True)

    def join_multi_by(self, key: Callable) -> RightSpec:
        return RightSpec([self], key, False)

    def join_left(self, key: Callable, **rights: RightSpec) -> Dataset:
        """Each row with a field for each right side: see RightSpec. Null keys match null keys."""
        left_reads = self._reads(key)
        names = list(self.schema.names)
        for name, spec in rights.items():
            if not isinstance(spec, RightSpec):
                raise L.TypeError_(f"join_left: {name} must be made by join_by or join_multi_by")
            for own in (name, f"{name}_index") if spec.indexed else (name,):
                if own in names:
                    raise L.TypeError_(f"join_left: there is a field {own} already")
                names.append(own)
            kinds = [_key(d.frame(), spec.key)[0] for d in spec.datasets]
            wanted = _key(self.frame(), key)[0]
            if any(k != wanted for k in kinds):
                raise L.TypeError_(f"join_left: {name}'s key is {kinds[0].simpleString()}, the left one {wanted.simpleString()}")
            if len({d.schema.simpleString() for d in spec.datasets}) > 1:
                raise L.TypeError_(f"join_left: the datasets of {name} have different schemas")

        def lower(need: Need) -> DataFrame:
            own = None if need is None else _union({k: v for k, v in need.items() if k in self.schema.names}, left_reads)
            df = self.frame(own)
            kept = [c for c in df.columns if need is None or c in need]
            df = df.select("*", col(key(Row(df, {}))).alias("__key"))
            for name, spec in rights.items():
                used = None if need is None else need.get(name, set()) or {COUNT}
                index = need is None or f"{name}_index" in need
                if need is not None and not spec.one and name not in need and not (spec.indexed and index):
                    continue
                if need is not None and name not in need:
                    used = set()
                df = _joined(df, name, spec, None if used is None or "*" in used else used, index)
                kept += [c for c in (name, f"{name}_index") if c in df.columns]
            return df.select(*kept)

        return Dataset(lower)

    def collect(self, disable_column_pruning: bool = False) -> list[T.Row]:
        """The action. Without pruning, all fields of all steps are read, and joins gather whole records."""
        return (self.unpruned() if disable_column_pruning else self.frame()).collect()

    def unpruned(self) -> DataFrame:
        """The plan in which every step has all its fields. Catalyst itself may still leave columns out."""
        told = _pruning.set(False)
        try:
            return self.frame()
        finally:
            _pruning.reset(told)

    def explain(self) -> None:
        self.frame().explain("formatted")

    def write(self, path: str, kind: str = "parquet", mode: str = "error") -> None:
        self.frame().write.mode(mode).format(kind).save(path)


def agg(row: Row) -> Agg:
    return Agg(row)


def of(df: DataFrame) -> Dataset:
    """A dataset of any DataFrame; what isn't needed of it is left out."""
    return Dataset(lambda need: df if need is None else df.select(*[c for c in df.columns if c in need] or df.columns[:1]))


def union_need(*needs: dict[str, set[str]]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for n in needs:
        for k, v in n.items():
            out.setdefault(k, set()).update(v)
    return out


_union = union_need


def _key(df: DataFrame, key: Callable) -> tuple[T.DataType, bool]:
    told = df.select(col(key(Row(df, {}))).alias("k")).schema["k"]
    return told.dataType, told.nullable


def _matches(df: DataFrame, other: DataFrame) -> Column:
    """Null-safe only where both keys may be null: plain equality lets Catalyst do more."""
    nulls = df.schema["__key"].nullable and other.schema["__rkey"].nullable
    return df["__key"].eqNullSafe(other["__rkey"]) if nulls else df["__key"] == other["__rkey"]


def declared(column: T.StructField) -> T.DataType:
    """A column's type; of a join's figures, that of the array whose they are."""
    return T._parse_datatype_json_string(column.metadata[MARK]) if MARK in (column.metadata or {}) else column.dataType


def _fields(used: set[str]) -> set[str]:
    """The fields that are read, in figures too."""
    return {u.split(":", 1)[1] if u.startswith(MARK) else u for u in used if u not in (COUNT, WHOLE)}


def _joined(df: DataFrame, name: str, spec: RightSpec, used: set[str] | None, index: bool) -> DataFrame:
    """df with the field of spec, and its index if that is read; used: the fields and figures of its records that are read
    (None: all; empty: none)."""
    wanted = None if used is None else _fields(used)
    parts = []
    for i, d in enumerate(spec.datasets):
        key_reads = d._reads(spec.key)
        own = d.frame(None if wanted is None else _union({u: {"*"} for u in wanted}, key_reads))
        fields = [c for c in d.schema.names if wanted is None or c in wanted]
        record = F.struct(*(own[c].alias(c) for c in fields)) if fields else F.struct(F.lit(True).alias("__row"))
        parts.append(own.select(col(spec.key(Row(own, {}))).alias("__rkey"), record.alias(name), F.lit(i).cast("long").alias("__source")))
    right = parts[0]
    if spec.one:
        out = df.join(right.select("__rkey", name), _matches(df, right), "left")
        return out.drop("__rkey")
    for p in parts[1:]:
        right = right.unionByName(p)
    sources = range(len(parts))
    if used is not None and all(u.startswith(MARK) for u in used):
        counts = [F.count_if(F.col("__source") == i).alias(f"__n{i}") for i in sources]
        right = right.groupBy("__rkey").agg(*counts, *(_aggregated(name, u).alias(u) for u in sorted(used - {COUNT})))
        out = df.join(right, _matches(df, right), "left")
        n = [F.coalesce(f"__n{i}", F.lit(0)).cast("long") for i in sources]
        told = [_of_none(u, F.col(f"`{u}`")).alias(u) for u in sorted(used - {COUNT})]
        # What the array would be stands beside the figures, for those who ask for the field's type.
        array = T.ArrayType(spec.datasets[0].schema, False).json()
        out = out.select("*", F.struct(sum(n[1:], n[0]).alias(COUNT), *told).alias("__figures", metadata={MARK: array}))
        if spec.indexed and index:
            out = out.withColumn(f"{name}_index", F.flatten(F.array(*(F.array_repeat(F.lit(i).cast("long"), k.cast("int")) for i, k in zip(sources, n, strict=True)))))
        out = out.drop("__rkey", *(f"__n{i}" for i in sources), *(used - {COUNT}))
        return out.withColumnRenamed("__figures", name) if used else out.drop("__figures")
    lists = [F.collect_list(F.when(F.col("__source") == i, F.col(name)) if spec.indexed else name).alias(f"__l{i}") for i in sources]
    right = right.groupBy("__rkey").agg(*lists)
    out = df.join(right, _matches(df, right), "left")
    own = [F.coalesce(f"__l{i}", F.array().cast(right.schema[f"__l{i}"].dataType)) for i in sources]
    out = out.withColumn(name, F.concat(*own) if spec.indexed else own[0])
    if spec.indexed:
        out = out.withColumn(f"{name}_index", F.flatten(F.array(*(F.array_repeat(F.lit(i).cast("long"), F.size(x)) for i, x in zip(sources, own, strict=True)))))
    return out.drop("__rkey", *(f"__l{i}" for i in sources))


def _aggregated(name: str, told: str) -> Column:
    """A figure of a group's records, as functions of arrays have it: a sum with a null is null."""
    kind, field = told[len(MARK) :].split(":", 1)
    x = F.col(name)[field]
    if kind in ("greatest", "least"):
        return F.max(x) if kind == "greatest" else F.min(x)
    summed = F.sum(x).cast("double" if kind == "total" else "bigint")
    return F.when(F.count(x) == F.count(F.lit(1)), summed)


def _of_none(told: str, x: Column) -> Column:
    """The figure where there may be no records at all."""
    nothing = F.col("__n0").isNull()
    if told.startswith(figure("total", "")):
        return F.when(nothing, F.lit(0.0)).otherwise(x)
    return F.when(nothing, F.lit(0).cast("long")).otherwise(x) if told.startswith(figure("total_int", "")) else x
