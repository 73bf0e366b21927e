"""Types of records: a name for each Spark type, schemas with nullability, and the rules between types.

Integers without a sign are kept in the next wider signed type. Sets are arrays without repeats.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Type names and what they are in Spark.
SCALARS: dict[str, T.DataType] = {
    "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int": T.LongType(),
    "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(), "UInt": T.LongType(),
    "Float32": T.FloatType(), "Float64": T.DoubleType(), "String": T.StringType(), "Bytes": T.BinaryType(),
    "Bool": T.BooleanType(), "Timestamp": T.TimestampType(), "DateTime": T.TimestampType(), "Date": T.DateType(),
    "TimeInterval": T.DayTimeIntervalType(), "Null": T.NullType(),
}

Int8, Int16, Int32, Int = (SCALARS[k] for k in ("Int8", "Int16", "Int32", "Int"))
UInt8, UInt16, UInt32, UInt = (SCALARS[k] for k in ("UInt8", "UInt16", "UInt32", "UInt"))
Float32, Float64, String, Bytes, Bool = (SCALARS[k] for k in ("Float32", "Float64", "String", "Bytes", "Bool"))
Timestamp, DateTime, Date, TimeInterval = (SCALARS[k] for k in ("Timestamp", "DateTime", "Date", "TimeInterval"))


class TypeError_(TypeError):
    """A plan that can't be typed; raised when it is built, before anything runs."""


class Nullable:
    """A type that also has null. Only fields, elements and values of containers can be so."""

    def __init__(self, inner: T.DataType | Nullable):
        self.inner = inner.inner if isinstance(inner, Nullable) else inner

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Nullable) and self.inner == other.inner

    def __hash__(self) -> int:
        return hash(("Nullable", self.inner.simpleString()))


Kind = T.DataType | Nullable


def bare(kind: Kind) -> tuple[T.DataType, bool]:
    return (kind.inner, True) if isinstance(kind, Nullable) else (kind, False)


def Array(kind: Kind) -> T.ArrayType:  # noqa: N802
    return T.ArrayType(*bare(kind))


Set = Array


def Map(key: T.DataType, value: Kind) -> T.MapType:  # noqa: N802
    return T.MapType(bare(key)[0], *bare(value))


def Decimal(precision: int, scale: int) -> T.DecimalType:  # noqa: N802
    if not 1 <= precision <= 38 or not 0 <= scale <= precision:
        raise TypeError_(f"Decimal<{precision}, {scale}>: precision must be 1 to 38, scale 0 to precision")
    return T.DecimalType(precision, scale)


def Tuple(*kinds: Kind, **named: Kind) -> T.StructType:  # noqa: N802
    """A product; fields without a name are _1, _2 ..."""
    return schema(**{f"_{i}": k for i, k in enumerate(kinds, 1)}, **named)


def schema(_options: dict[str, dict] | None = None, /, **fields: Kind) -> T.StructType:
    """A record type. Options of a field become its metadata."""
    options = _options or {}
    return T.StructType([T.StructField(n, *bare(k), options.get(n, {})) for n, k in fields.items()])


def tuple_join(*parts: Kind) -> T.StructType:
    """Fields of tuples one after another; what isn't a tuple becomes a field."""
    fields: list[T.StructField] = []
    for part in parts:
        kind, null = bare(part)
        own = kind.fields if isinstance(kind, T.StructType) else [T.StructField("", kind, null)]
        fields += [T.StructField(f.name if f.name and not f.name.startswith("_") else f"_{len(fields) + i + 1}", f.dataType, f.nullable) for i, f in enumerate(own)]
    if len({f.name for f in fields}) < len(fields):
        raise TypeError_(f"tuple_join: repeated names in {[f.name for f in fields]}")
    return T.StructType(fields)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_sortable(kind: T.DataType) -> bool:
    return not isinstance(kind, T.MapType | T.NullType | T.StructType | T.ArrayType)


_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 4, T.FloatType: 5, T.DoubleType: 6}


def is_convertible(source: Kind, target: Kind) -> bool:
    """Whether a value of source may stand where target is asked for; records by structure, field by field."""
    (s, s_null), (t, t_null) = bare(source), bare(target)
    if s_null and not t_null:
        return False
    if isinstance(s, T.NullType):
        return t_null or isinstance(t, T.NullType)
    if isinstance(s, T.StructType) and isinstance(t, T.StructType):
        pairs = zip(s.fields, t.fields, strict=False)
        return len(s) == len(t) and all(
            a.name == b.name and is_convertible(Nullable(a.dataType) if a.nullable else a.dataType, Nullable(b.dataType) if b.nullable else b.dataType) for a, b in pairs
        )
    if isinstance(s, T.ArrayType) and isinstance(t, T.ArrayType):
        wrap = lambda a: Nullable(a.elementType) if a.containsNull else a.elementType
        return is_convertible(wrap(s), wrap(t))
    if isinstance(s, T.DateType) and isinstance(t, T.TimestampType):
        return True
    if type(s) in _WIDTH and type(t) in _WIDTH:
        return _WIDTH[type(s)] <= _WIDTH[type(t)]
    return s == t


def default_of(kind: Kind):
    """What a field holds when a constructor isn't given it."""
    import datetime as d

    t, null = bare(kind)
    if null:
        return None
    if isinstance(t, T.StructType):
        return {f.name: default_of(Nullable(f.dataType) if f.nullable else f.dataType) for f in t.fields}
    plain = {
        T.StringType: "", T.BinaryType: b"", T.BooleanType: False, T.FloatType: 0.0, T.DoubleType: 0.0, T.DateType: d.date(1970, 1, 1),
        T.TimestampType: d.datetime(1970, 1, 1), T.DayTimeIntervalType: d.timedelta(0), T.ArrayType: [], T.MapType: {}, T.NullType: None,
    }
    return plain.get(type(t), 0)
