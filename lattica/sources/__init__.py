"""Sources of datasets, and generators of synthetic files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.plans.dataset import Dataset, of


def empty_dataset(spark: SparkSession, schema: T.StructType) -> Dataset:
    return of(spark.createDataFrame([], schema))


def read_csv(spark: SparkSession, schema: T.StructType, path: str, header: bool = True, delimiter: str = ",") -> Dataset:
    """Rows that don't fit the schema have nulls where they don't."""
    return of(spark.read.schema(schema).option("header", header).option("sep", delimiter).option("mode", "PERMISSIVE").csv(path))


def read_parquet(spark: SparkSession, schema: T.StructType | None, path: str) -> Dataset:
    """With a schema, its fields only; without, those of the files."""
    if schema is None:
        return of(spark.read.parquet(path))
    return of(spark.read.parquet(path).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields)))


def table(spark: SparkSession, name: str) -> Dataset:
    return of(spark.table(name))


def sql(spark: SparkSession, text: str, sample: float | None = None, max_rows: int | None = None) -> DataFrame:
    """SQL as it is; with sample, a fraction of the rows, with max_rows, so many at most."""
    out = spark.sql(text)
    out = out if sample is None else out.sample(False, sample)
    return out if max_rows is None else out.limit(max_rows)


def local_csv(spark: SparkSession, schema: T.StructType, path: str) -> Iterator[T.Row]:
    """Rows one after another on the driver."""
    return read_csv(spark, schema, path).frame().toLocalIterator()


#: A generator makes a column from the row's number and how many rows there are.
Generator = Callable[[Column, int], Column]


def _dice(i: Column, salt: str, sides: int) -> Column:
    return F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(sides))


def gen_str(length: int, alphabet: str = "abcdefghijklmnopqrstuvwxyz", salt: str = "str") -> Generator:
    def made(i: Column, n: int) -> Column:
        letters = F.lit(list(alphabet))
        die = lambda k: F.pmod(F.xxhash64(i, k, F.lit(salt)), F.lit(len(alphabet))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda k: F.get(letters, die(k))), "")

    return made


def gen_inc(start: int = 0) -> Generator:
    return lambda i, n: i + start


def gen_choice(options: list, salt: str = "choice") -> Generator:
    return lambda i, n: F.get(F.lit(options), _dice(i, salt, len(options)).cast("int"))


def gen_exp(scale: float, salt: str = "exp") -> Generator:
    """Whole numbers with an exponential distribution."""
    return lambda i, n: (-F.log((_dice(i, salt, 1 << 30) + 1) / float(1 << 30)) * scale).cast("bigint")


#: Made-up values for kinds of personal data; choices and lengths that look like the real ones.
_MADE_UP: dict[str, Generator] = {
    "first_name": gen_choice(["Ada", "Ben", "Chloe", "Dan", "Eva", "Femi", "Gita", "Hugo"], "first"),
    "last_name": gen_choice(["Abel", "Brandt", "Costa", "Diaz", "Evans", "Fischer", "Gupta", "Haddad"], "last"),
    "city": gen_choice(["Aston", "Brook", "Clayton", "Dover", "Easton"], "city"),
    "state": gen_choice(["AL", "CA", "NY", "OH", "TX", "WA"], "state"),
    "zipcode": gen_str(5, "0123456789", "zip"), "phone_number": gen_str(10, "0123456789", "phone"), "ssn": gen_str(9, "0123456789", "ssn"),
    "street_address": gen_choice(["1 High Street", "22 Mill Lane", "7 Park Road", "305 Station Way"], "street"),
}


def generator(spec: list | tuple) -> Generator:
    """The generator that a program's (kind, arguments) tells: str (length, alphabet), inc start, choice (options,), exp
    scale, toint of another, or faker with the kind of personal data."""
    if not isinstance(spec, list | tuple) or len(spec) != 2:
        raise ValueError(f"generator: {spec} isn't a kind and its arguments")
    kind, told = spec
    args = list(told) if isinstance(told, list | tuple) else [told]
    if kind == "toint":
        inner = generator(told)
        return lambda i, n: inner(i, n).cast("bigint")
    if kind == "faker":
        if args[0] not in _MADE_UP:
            raise ValueError(f"generator: no personal data of the kind {args[0]}")
        return _MADE_UP[args[0]]
    kinds = {"str": gen_str, "inc": gen_inc, "exp": gen_exp, "choice": lambda options: gen_choice(list(options))}
    if kind not in kinds:
        raise ValueError(f"generator: no kind {kind}")
    return kinds[kind](*args)


#: By field name, the first that matches.
DEFAULT_GENERATORS: list[tuple[str, Generator]] = [(r".*_?id", gen_inc(1)), (r".*(cents|amount|price|count)", gen_exp(1000.0)), (r".*", gen_str(10))]


def generate(spark: SparkSession, schema: T.StructType, count: int, generators: list[tuple[str, Generator]] | None = None) -> DataFrame:
    """count rows, the same each time; fields of the same name in several schemas have the same values."""
    i = F.col("id")
    columns = []
    for f in schema.fields:
        made = next(g for pattern, g in [*(generators or []), *DEFAULT_GENERATORS] if re.fullmatch(pattern, f.name))
        columns.append(made(i, count).cast(f.dataType).alias(f.name))
    return spark.range(count).select(*columns)


def generate_files(spark: SparkSession, schemas: dict[str, T.StructType], folder: str, count: int, kind: str, generators: list[tuple[str, Generator]] | None = None) -> list[str]:
    """A file folder for each schema; the paths."""
    out = []
    for name, schema in schemas.items():
        path = f"{folder.rstrip('/')}/{name}.{kind}"
        writer = generate(spark, schema, count, generators).write.mode("overwrite")
        writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
        out.append(path)
    return out


def generate_csv(spark: SparkSession, schemas: dict[str, T.StructType], folder: str, count: int, generators: list[tuple[str, Generator]] | None = None) -> list[str]:
    return generate_files(spark, schemas, folder, count, "csv", generators)


def generate_parquet(spark: SparkSession, schemas: dict[str, T.StructType], folder: str, count: int, generators: list[tuple[str, Generator]] | None = None) -> list[str]:
    return generate_files(spark, schemas, folder, count, "parquet", generators)
