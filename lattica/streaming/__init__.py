"""Datasets of growing folders: the same row-wise steps and aggregations, run as files come, by Structured Streaming.

A dataset read here is lowered like any other, so filters, maps, flat maps and aggregates are the same plans. Joins
nest against batch datasets on the right, as a single record; array joins of a stream have no bound and are refused by
Spark. Sorts and limits need a whole input and so a complete result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lattica import types as L
from lattica.functions.scalars import col
from lattica.operators.aggregate import Agg
from lattica.plans.dataset import Dataset, Row, of


def read_folder(
    spark: SparkSession, schema: T.StructType, path: str, kind: str = "parquet", files_at_once: int | None = None,
    late: tuple[str, str] | None = None, **options: object,
) -> Dataset:
    """Rows of the files in a folder, now and later. files_at_once bounds a micro-batch. late: (field, delay) of the
    watermark; rows that come later than the delay may be left out of windows that are closed by then."""
    reader = spark.readStream.schema(schema).format(kind).options(**options)
    if files_at_once is not None:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    df = reader.load(path)
    return of(df if late is None else df.withWatermark(*late))


def is_streaming(ds: Dataset) -> bool:
    return ds.frame().isStreaming


def windowed(ds: Dataset, at: Callable[[Row], Column], length: str, build: Callable[[Row], Agg], slide: str | None = None) -> Dataset:
    """ds's aggregate within each window of the time that at gives: two more fields, window_start and window_end.

    Windows are half-open and begin at multiples of slide (length, if not given) since the epoch. Rows without a time are
    in none. The state of a window is kept until the watermark passes its end.
    """

    def lower(need: object) -> DataFrame:
        df = ds.frame()
        spec, time = build(Row(df, {})), at(Row(df, {}))
        if not isinstance(spec, Agg):
            raise L.TypeError_("windowed: the function must give agg(row) with aggregates")
        kinds = [f.dataType for f in df.select(*(col(v).alias(f"v{i}") for i, (_, _, v) in enumerate(spec.specs))).schema.fields]
        keys, made, names = spec.columns({name: kind for (_, name, _), kind in zip(spec.specs, kinds, strict=True)})
        if {"window_start", "window_end"} & set(names):
            raise L.TypeError_("windowed: window_start and window_end are given by the window")
        out = df.groupBy(F.window(time, length, slide).alias("__window"), *keys).agg(*made)
        return out.select(F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"), *names)

    return Dataset(lower)


def first_of_each(ds: Dataset, keys: list[str], within_watermark: bool = False) -> Dataset:
    """One row of each key. within_watermark forgets keys once the watermark is past, so that the state stays bounded."""

    def lower(need: object) -> DataFrame:
        df = ds.frame()
        return df.dropDuplicatesWithinWatermark(keys) if within_watermark else df.dropDuplicates(keys)

    return Dataset(lower)


def write_folder(ds: Dataset, path: str, checkpoint: str, kind: str = "parquet", every: str | None = None) -> StreamingQuery:
    """Append ds's rows to a folder, each once, also over restarts with the same checkpoint. Without every, all that is
    there by now is processed and the query ends."""
    writer = ds.frame().writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def write_batches(ds: Dataset, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", every: str | None = None) -> StreamingQuery:
    """Give each micro-batch's rows (mode update: the changed groups; complete: all groups) to each(frame, number), which
    should be safe to repeat for a number."""
    writer = ds.frame().writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


__all__ = ["first_of_each", "is_streaming", "read_folder", "windowed", "write_batches", "write_folder"]
