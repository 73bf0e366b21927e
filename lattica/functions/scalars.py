"""Operators, null handling, casts, dates and strings."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica import types as L

EPOCH = dt.date(1970, 1, 1)
_BLANK = " \t\n\r\x0b\x0c"


def col(x) -> Column:
    """x as a column: columns and wrapped ones as they are, anything else as a literal."""
    inner = x if isinstance(x, Column) else getattr(x, "_column", x)
    return inner if isinstance(inner, Column) else F.lit(inner)


# Operators


def floor_mod(x, y) -> Column:
    """Remainder with the divisor's sign."""
    x, y = col(x), col(y)
    return (x % y + y) % y


def if_(cond, yes, no) -> Column:
    return F.when(col(cond), col(yes)).otherwise(col(no))


def between(v, low, high) -> Column:
    return col(v).between(col(low), col(high))


def equals(x, y) -> Column:
    """Null equals null."""
    return col(x).eqNullSafe(col(y))


def differs(x, y) -> Column:
    return ~equals(x, y)


def xor(x, y) -> Column:
    return col(x) != col(y)


def and_(x, y) -> Column:
    """y is looked at only where x holds."""
    return F.when(col(x), col(y)).otherwise(F.lit(False))


def or_(x, y) -> Column:
    return F.when(col(x), F.lit(True)).otherwise(col(y))


def shift_left(x, n: int) -> Column:
    return F.shiftleft(col(x), n)


def shift_right(x, n: int) -> Column:
    return F.shiftright(col(x), n)


def date_add(d, interval) -> Column:
    return (col(d) + col(interval)).cast("date")


def date_sub(d, interval) -> Column:
    return (col(d) - col(interval)).cast("date")


def date_diff(x, y) -> Column:
    return (col(x) - col(y)).cast("interval day to second")


# Null handling


def is_null(x) -> Column:
    return F.isnull(col(x))


def ensured(x) -> Column:
    """x, which isn't null: not checked."""
    return col(x)


def ensure(x, default=None) -> Column:
    """x, or where it is null the default."""
    if default is None:
        raise L.TypeError_("ensure: give a default of x's type (0, '', b'', False, or ensure_date for dates)")
    return F.coalesce(col(x), col(default))


def ensure_date(x, default: dt.date = EPOCH) -> Column:
    return F.coalesce(col(x), F.lit(default))


def ensure_datetime(x, default=None) -> Column:
    return F.coalesce(col(x), default_timestamp() if default is None else col(default))


def ensured_run(x, f) -> Column:
    """f(x), or null where x is null."""
    return F.when(col(x).isNotNull(), col(f(col(x))))


# Casts


def to_int(x, default=None) -> Column:
    """Numbers and booleans, towards zero."""
    return col(x).cast("bigint")


def parse_int(s, default=None) -> Column:
    """Null, or default if given, where s isn't an integer."""
    got = col(s).try_cast("bigint")
    return got if default is None else F.coalesce(got, col(default))


def to_uint(x) -> Column:
    """Negative numbers become 0."""
    n = col(x).cast("bigint")
    return F.when(n > 0, n).otherwise(F.lit(0).cast("bigint"))


def number_to_bool(x) -> Column:
    return F.coalesce(col(x) != 0, F.lit(False))


def text_to_bool(x) -> Column:
    return F.coalesce(F.length(col(x)) > 0, F.lit(False))


def to_string(x) -> Column:
    return col(x).cast("string")


def default(kind: T.DataType) -> Column:
    """A type's default: 0, '', false, the epoch, empty containers."""
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.StructType):
        return construct(kind)
    if isinstance(kind, T.TimestampType):
        return default_timestamp()
    value = L.default_of(kind)
    return F.lit(value).cast(kind)


def construct(kind: T.StructType, copy=None, **fields) -> Column:
    """A record; fields not given are copied from another record, or have their defaults."""
    if unknown := set(fields) - set(kind.names):
        raise L.TypeError_(f"no field {sorted(unknown)} in {kind.names}")
    made = []
    for f in kind.fields:
        if f.name in fields:
            value = col(fields[f.name])
        elif copy is not None:
            value = col(copy)[f.name]
        else:
            value = F.lit(None) if f.nullable else default(f.dataType)
        made.append(value.cast(f.dataType).alias(f.name))
    return F.struct(*made)


# Dates


def set_timezone(spark: SparkSession, name: str) -> bool:
    import zoneinfo

    try:
        zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        return False
    spark.conf.set("spark.sql.session.timeZone", name)
    return True


def default_timestamp() -> Column:
    return F.timestamp_seconds(F.lit(0))


def timestamp_now() -> Column:
    return F.current_timestamp()


def timestamp_ms(n) -> Column:
    return F.timestamp_millis(col(n))


def timestamp_sec(n) -> Column:
    return F.timestamp_seconds(col(n))


def date_now() -> Column:
    return F.current_date()


def date(y, m, d) -> Column:
    """Null if there is no such day."""
    zero = F.lit(0)
    return F.try_make_timestamp(col(y).cast("int"), col(m).cast("int"), col(d).cast("int"), zero, zero, zero.cast("decimal(16,6)")).cast("date")


def date_of(ts) -> Column:
    return F.to_date(col(ts))


def parse_date(s) -> Column:
    """ISO dates; null for anything else."""
    return F.when(col(s).rlike(r"^\d{4}-\d{2}-\d{2}$"), col(s).try_cast("date"))


def date_ensured(*args) -> Column:
    return ensure_date(date(*args) if len(args) == 3 else parse_date(*args))


def datetime_of(ts) -> Column:
    return col(ts).cast("timestamp")


def datetime(y, m, d, h=0, mi=0, s=0) -> Column:
    whole = [col(x).cast("int") for x in (y, m, d, h, mi)]
    return F.try_make_timestamp(*whole, col(s).cast("decimal(16,6)"))


def parse_datetime(s) -> Column:
    return col(s).try_cast("timestamp")


def datetime_ensured(*args) -> Column:
    return ensure_datetime(datetime(*args) if len(args) > 1 else parse_datetime(*args))


def year(d) -> Column:
    return F.year(col(d)).cast("bigint")


def month(d) -> Column:
    return F.month(col(d)).cast("bigint")


def day(d) -> Column:
    return F.dayofmonth(col(d)).cast("bigint")


def weekday(d) -> Column:
    """0 is Monday."""
    return F.weekday(col(d)).cast("bigint")


def isoformat(d) -> Column:
    return F.date_format(col(d), "yyyy-MM-dd")


#: C directives and Spark's patterns for the same.
_DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "j": "DDD", "p": "a", "I": "hh", "A": "EEEE", "a": "EEE"}


def strftime(d, fmt: str) -> Column:
    out = []
    for directive, plain in re.findall(r"%(.)|([^%]+)", fmt):
        if directive == "%" or plain:
            out.append("'" + (plain or "%").replace("'", "''") + "'")
        elif directive in _DIRECTIVES:
            out.append(_DIRECTIVES[directive])
        else:
            raise L.TypeError_(f"strftime: %{directive} isn't supported")
    return F.date_format(col(d), "".join(out))


def interval(weeks=0, days=0, hours=0, minutes=0, seconds=0) -> Column:
    return F.lit(dt.timedelta(weeks=weeks, days=days, hours=hours, minutes=minutes, seconds=seconds))


# Strings


def strip(s) -> Column:
    return F.btrim(col(s), F.lit(_BLANK))


def concat(parts, joiner) -> Column:
    return F.array_join(col(parts), joiner)
