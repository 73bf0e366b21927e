"""Streams against the same steps over the same rows as a batch."""

import datetime as dt

import pytest

from lattica import functions as f
from lattica import sources, streaming
from lattica import types as L
from lattica.plans.dataset import agg

EVENT = L.schema(id=L.Int, at=L.Nullable(L.Timestamp), kind=L.Nullable(L.String), value=L.Float64)
START = dt.datetime(2024, 1, 1)


def rows(begin, end):
    return [(i, None if i % 17 == 0 else START + dt.timedelta(minutes=i), None if i % 13 == 0 else "ab"[i % 2], float(i)) for i in range(begin, end)]


def add(spark, folder, own):
    spark.createDataFrame(own, EVENT).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def folder(spark, tmp_path):
    told = f"{tmp_path}/in"
    for begin in (0, 40, 80):
        add(spark, told, rows(begin, begin + 40))
    return told


def by_kind(ds):
    return ds.filter(lambda r: r.value > 5.0).aggregate(lambda r: agg(r).group_by(kind=r.kind).count(n=r.id).sum(total=r.value))


def test_rows_once_over_restarts(spark, tmp_path, folder):
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"

    def step(ds):
        return ds.filter(lambda r: r.value % 2.0 == 0.0).map(lambda r: {"id": r.id, "twice": r.value * 2})

    for begin in (120, 160):
        ds = streaming.read_folder(spark, EVENT, folder, files_at_once=2)
        assert streaming.is_streaming(ds)
        assert streaming.write_folder(step(ds), out, check).awaitTermination(120)
        add(spark, folder, rows(begin, begin + 40))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(0, 160, 2))


def test_groups_are_those_of_a_batch(spark, tmp_path, folder):
    got = {}

    def keep(df, number):
        got.update({r.kind: (r.n, r.total) for r in df.collect()})

    ds = by_kind(streaming.read_folder(spark, EVENT, folder, files_at_once=1))
    assert streaming.write_batches(ds, keep, f"{tmp_path}/check").awaitTermination(120)
    batch = by_kind(sources.read_parquet(spark, None, folder))
    assert got == {r.kind: (r.n, r.total) for r in batch.collect()} and None in got


def test_join_with_a_batch(spark, tmp_path, folder):
    kinds = sources.empty_dataset(spark, L.schema(kind=L.String, told=L.String))
    ds = streaming.read_folder(spark, EVENT, folder).join_left(lambda r: r.kind, told=kinds.join_by(lambda r: r.kind))
    ds = ds.map(lambda r: {"id": r.id, "missing": f.is_null(r.told.told)})
    assert streaming.write_folder(ds, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 120 and all(r.missing for r in got)


@pytest.mark.parametrize("slide", [None, "15 minutes"])
def test_windows(spark, tmp_path, folder, slide):
    def windows(ds):
        return streaming.windowed(ds, lambda r: r.at, "30 minutes", lambda r: agg(r).group_by(kind=r.kind).count(n=1), slide)

    got = {}

    def keep(df, number):
        got.update({(r.window_start, r.kind): r.n for r in df.collect()})

    stream = streaming.read_folder(spark, EVENT, folder, late=("at", "10 minutes"), files_at_once=1)
    assert streaming.write_batches(windows(stream), keep, f"{tmp_path}/check").awaitTermination(120)
    batch = {(r.window_start, r.kind): r.n for r in windows(sources.read_parquet(spark, None, folder)).collect()}
    assert got == batch and sum(got.values()) == (1 if slide is None else 2) * sum(i % 17 != 0 for i in range(120))
    with pytest.raises(L.TypeError_, match="window_start"):
        streaming.windowed(stream, lambda r: r.at, "1 hour", lambda r: agg(r).count(window_start=1)).frame()


def test_first_of_each(spark, tmp_path, folder):
    add(spark, folder, rows(0, 40))
    ds = streaming.first_of_each(streaming.read_folder(spark, EVENT, folder, files_at_once=1), ["id"])
    assert streaming.write_folder(ds, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(120))
