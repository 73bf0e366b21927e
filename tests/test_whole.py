"""Queries over long texts and all customers, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lattica import functions as f
from lattica import queries as Q


def grouped(words):
    out = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return sorted(out.items())


WANT = {
    "arr_len": len,
    "arr_sort": lambda a: " ".join(sorted(a)),
    "arr_sort_reverse": lambda a: " ".join(sorted(a, reverse=True)),
    "arr_max_by": lambda a: max(a, key=lambda w: (len(w), w)),
    "arr_to_map": lambda a: " ".join(f"{n}={ws[-1]}" for n, ws in grouped(a)),
    "arr_to_set": lambda a: " ".join(sorted(set(a))),
    "arr_range_down": lambda a: " ".join(map(str, range(len(a), 2, -1))),
    "arr_to_map_last": lambda a: [w for w in a if len(w) == 3][-1],
    "arr_aggregate_to_array": lambda a: " ".join(f"{n}:{'+'.join(ws)}" for n, ws in grouped(a)),
    "arr_aggregate_to_set": lambda a: " ".join(f"{n}:{'+'.join(sorted(set(ws)))}" for n, ws in grouped(a)),
}


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 6))) for _ in range(n)) for n in (20_000, 300)]
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at, texts


@pytest.mark.parametrize("name", sorted(WANT))
def test_whole_texts(spark, documents, name):
    at, texts = documents
    got = {r.doc_id: r.x for r in Q.QUERIES[name](spark, at).collect()}
    assert got == {i: WANT[name](t.split(" ")) for i, t in enumerate(texts)}


def test_map_has_the_last_of_equal_keys_in_their_order(spark):
    pairs = [("b", 1), ("a", 2), ("b", 3), ("c", 4), ("a", 5)]
    df = spark.createDataFrame([(pairs,), ([],), (None,)], "x array<struct<k:string,v:int>>")
    made = F.map_entries(f.to_map(F.col("x"), lambda e: e["k"], lambda e: e["v"]))
    got = [r.m and list(map(tuple, r.m)) for r in df.select(made.alias("m")).collect()]
    assert got == [[("b", 3), ("c", 4), ("a", 5)], [], None]


def test_groups_have_null_last_and_values_in_order(spark):
    df = spark.createDataFrame([([("b", 1), (None, 2), ("a", 3), ("b", 4), (None, 5)],), ([],), (None,)], "x array<struct<k:string,v:int>>")
    made = f.aggregate_to_array(F.col("x"), lambda e: e["k"], lambda e: e["v"])
    got = [r.g and [(g[0], g[1]) for g in r.g] for r in df.select(made.alias("g")).collect()]
    assert got == [[("a", [3]), ("b", [1, 4]), (None, [2, 5])], [], None]


def test_many_distinct_keys_of_a_long_array(spark):
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(59_999)).alias("x"))
    groups = f.aggregate_to_array(F.col("x"), lambda e: e % 30_000, lambda e: e)
    got = df.select(F.size(groups).alias("n"), F.get(groups, 7).alias("g")).first()
    assert got.n == 30_000 and tuple(got.g) == (7, [7, 30_007])


def test_null_keys_of_all_customers(spark, tmp_path):
    rows = [(k, 3 if k > 60 else k % 5) for k in range(1, 301)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.k: r.n for r in Q.QUERIES["join_null_key"](spark, str(tmp_path)).collect()}
    assert got == {None: 252**2} | {k: 12**2 for k in (0, 1, 2, 4)}
