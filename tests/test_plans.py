"""Plans, checks when plans are built, and null and duplicate keys."""

import pytest
from pyspark.sql import functions as F

from lattica import functions as f
from lattica import sources
from lattica import types as L
from lattica.operators.join import join_multi_by
from lattica.plans.dataset import agg, of


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("plans"))
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, name string").write.parquet(f"{at}/l")
    spark.createDataFrame([(1, 10, "x"), (1, 11, "y"), (None, 12, "z")], "k long, v long, wide string").write.parquet(f"{at}/r")
    return sources.read_parquet(spark, None, f"{at}/l"), sources.read_parquet(spark, None, f"{at}/r")


def plan(ds):
    return ds.frame()._jdf.queryExecution().executedPlan().toString()


def test_join_cardinality(sides):
    left, right = sides
    one = left.join_left(lambda r: r.k, o=right.join_by(lambda r: r.k))
    assert sorted((r.name, r.o and r.o.v) for r in one.collect()) == [("a", 10), ("a", 11), ("b", 10), ("b", 11), ("c", None), ("d", 12)]
    many = left.join_left(lambda r: r.k, o=right.join_multi_by(lambda r: r.k))
    assert sorted((r.name, sorted(x.v for x in r.o)) for r in many.collect()) == [("a", [10, 11]), ("b", [10, 11]), ("c", []), ("d", [12])]
    both = left.join_left(lambda r: r.k, o=join_multi_by([right, right.filter(lambda r: r.v > 10)], lambda r: r.k))
    assert sorted((r.name, r.o_index, [x.v > 10 for x in r.o][-1:]) for r in both.collect())[:2] == [("a", [0, 0, 1], [True]), ("b", [0, 0, 1], [True])]


def test_only_read_fields_are_gathered(sides):
    left, right = sides
    many = left.join_left(lambda r: r.k, o=right.join_multi_by(lambda r: r.k))
    assert "wide" not in plan(many.map(lambda r: {"t": f.total_int(f.map_(r.o, lambda o: o.v))}))
    counted = plan(many.aggregate(lambda r: agg(r).sum(n=f.length(r.o))))
    assert "wide" not in counted and "v#" not in counted and "name" not in counted
    assert "Join" not in plan(many.map(lambda r: {"name": r.name}))
    assert "wide" in plan(many)


def figures(r):
    v = f.map_(r.o, lambda o: o.v)
    return {"name": r.name, "n": f.length(r.o), "no": f.empty(r.o), "t": f.total(v), "i": f.total_int(v), "hi": f.greatest(v), "lo": f.least(f.map_(r.o, lambda o: o["v"]))}


def test_figures_of_a_join_need_no_arrays(sides):
    """The same figures with and without the records themselves."""
    left, right = sides
    for rights in (right.join_multi_by(lambda r: r.k), join_multi_by([right, right.filter(lambda r: r.v > 10)], lambda r: r.k)):
        many = left.join_left(lambda r: r.k, o=rights)
        lean, whole = many.map(figures), many.map(lambda r: figures(r) | {"s": f.map_(r.o, lambda o: o.v + 1)})
        assert "collect_list" not in plan(lean) and "collect_list" in plan(whole) and "wide" not in plan(lean)
        names = lean.schema.names
        assert [f_.dataType for f_ in lean.schema] == [f_.dataType for f_ in whole.schema if f_.name != "s"]
        rows = lambda ds: sorted(repr([r[c] for c in names]) for r in ds.collect())
        assert rows(lean) == rows(whole)
        assert rows(many.filter(lambda r: f.length(r.o) > 0).map(figures)) == [x for x in rows(lean) if ", 0, True" not in x]
    n = lambda r, i: f.length(f.filter_(r.o_index, lambda k: k == i))
    told = many.map(lambda r: {"name": r.name, "one": n(r, 0), "two": n(r, 1), "all": f.total_int(r.o_index)})
    assert "collect_list" not in plan(told)
    assert sorted(map(tuple, told.collect())) == [("a", 2, 1, 1), ("b", 2, 1, 1), ("c", 0, 0, 0), ("d", 1, 1, 1)]


def test_a_sum_with_a_null_is_null(spark):
    left = of(spark.createDataFrame([(1,), (2,), (3,)], "k long"))
    right = of(spark.createDataFrame([(1, 5.0), (1, None), (2, 2.0)], "k long, v double"))
    many = left.join_left(lambda r: r.k, o=right.join_multi_by(lambda r: r.k))
    v = lambda r: f.map_(r.o, lambda o: o.v)
    lean, whole = many.map(lambda r: {"k": r.k, "t": f.total(v(r)), "hi": f.greatest(v(r))}), many.map(lambda r: {"k": r.k, "t": f.total(v(r)), "hi": f.greatest(v(r)), "a": f.at(v(r), 0)})
    assert sorted(map(tuple, lean.collect())) == sorted(tuple(r)[:3] for r in whole.collect()) == [(1, None, 5.0), (2, 2.0, 2.0), (3, 0.0, None)]


def test_headline_joins_gather_no_arrays(spark):
    import pathlib

    from lattica import queries as Q

    if not pathlib.Path("/root/testdata/sf0.001").exists():
        pytest.skip("no driver tables here")
    for name in ("join_multi", "join_multi_array", "join_mixed", "join_mixed_totals"):
        assert "collect_list" not in Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_without_pruning_all_is_gathered(sides):
    left, right = sides
    many = left.join_left(lambda r: r.k, o=right.join_multi_by(lambda r: r.k)).map(lambda r: {"name": r.name, "n": f.length(r.o)})
    analysed = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "collect_list" in analysed(many.unpruned()) and "wide" in analysed(many.unpruned()) and "collect_list" not in analysed(many.frame())
    assert sorted(map(tuple, many.collect(disable_column_pruning=True))) == sorted(map(tuple, many.collect()))


def test_filter_reaches_the_scan(spark, sides):
    left, _ = sides
    told = plan(left.filter(lambda r: r.name == "a").map(lambda r: {"name": r.name}))
    assert "EqualTo(name,a)" in told and "ReadSchema: struct<name:string>" in told and "Python" not in told


@pytest.mark.parametrize(
    "make, told",
    [
        (lambda l, r: l.filter(lambda x: x.k), "must give Bool"), (lambda l, r: l.map(lambda x: {"a": x.nope}), "no field nope"),
        (lambda l, r: l.map(lambda x: x.k).frame(), "must give a record"), (lambda l, r: l.aggregate(lambda x: agg(x).sum(a=x.name)), "doesn't take"),
        (lambda l, r: l.aggregate(lambda x: agg(x).sum(a=x.k).count(a=1)), "repeated names"), (lambda l, r: l.aggregate(lambda x: agg(x).group_by(a=x.k)), "no aggregation"),
        (lambda l, r: l.aggregate(lambda x: x.k), "must give agg"), (lambda l, r: l.join_left(lambda x: x.name, o=r.join_by(lambda y: y.k)), "key is"),
        (lambda l, r: l.join_left(lambda x: x.k, name=r.join_by(lambda y: y.k)), "already"), (lambda l, r: l.join_left(lambda x: x.k, o=3), "must be made by"),
        (lambda l, r: l.join_left(lambda x: x.k, o=join_multi_by([l, r], lambda y: y.k)), "different schemas"), (lambda l, r: l.flat_map(lambda x: x.k).frame(), "must give an array"),
    ],
)
def test_checked_when_built(sides, make, told):
    with pytest.raises(L.TypeError_, match=told):
        make(*sides)


def test_flat_map_and_empty(spark):
    ds = of(spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k long, a array<long>"))
    assert sorted(r.value for r in ds.flat_map(lambda r: r.a).collect()) == [1, 2]
    assert sources.empty_dataset(spark, L.schema(a=L.Int)).aggregate(lambda r: agg(r).sum(s=r.a).count(n=1)).collect() == [(None, 0)]


def test_types():
    assert L.is_convertible(L.Int32, L.Int) and not L.is_convertible(L.Int, L.Int32) and not L.is_convertible(L.Nullable(L.Int), L.Int)
    assert L.is_convertible(L.Date, L.Timestamp) and L.is_convertible(L.SCALARS["Null"], L.Nullable(L.Int))
    assert L.tuple_join(L.Tuple(a=L.Int), L.String).names == ["a", "_2"]
    with pytest.raises(L.TypeError_):
        L.Decimal(39, 2)


def test_scalar_edges(spark):
    one = spark.range(1)
    got = one.select(
        f.floor_mod(-7, 3).alias("a"), f.floor_mod(7, -3).alias("b"), f.date(2022, 2, 30).alias("c"), f.parse_int(F.lit(" 12 ")).alias("d"), f.parse_int(F.lit("x1")).alias("e"),
        f.strip(F.lit("\t a b\n")).alias("g"), f.range_(5, 0, -2).alias("h"), f.to_map(f.array(1, 2, 3), lambda x: x % 2, lambda x: x).alias("i"),
        f.max_by(f.default(L.Array(L.Int)), lambda x: x).alias("j"), f.to_uint(-3).alias("k"), f.text_to_bool(F.lit(None).cast("string")).alias("l"),
        f.isoformat(f.date_add(f.date(2024, 2, 28), f.interval(days=2))).alias("m"),
    ).first()
    assert tuple(got) == (2, -2, None, 12, None, "a b", [5, 3, 1], {1: 3, 0: 2}, None, 0, False, "2024-03-01")
    assert f.set_timezone(spark, "Not/AZone") is False
