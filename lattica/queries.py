"""Every operator of the engine as a query on the driver tables, next to the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica import functions as f
from lattica import sources
from lattica import types as L
from lattica.operators.join import join_multi_by
from lattica.plans.dataset import Dataset, agg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> Dataset:
        return sources.read_parquet(self.spark, None, f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None) -> Callable:
    def add(made: Callable[[Tables], Dataset | DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = made(Tables(spark, sf_dir))
            return out.frame() if isinstance(out, Dataset) else out

        QUERIES[made.__name__] = run
        if sql:
            ORACLE[made.__name__] = sql
        return made

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a file that a query writes, where driver and executors both see it."""
    import uuid

    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        told = f"file:/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{told}/lattica/{name}-{uuid.uuid4().hex}"


# Sources


@query("SELECT 0::BIGINT AS n")
def empty_dataset(t):
    return sources.empty_dataset(t.spark, L.schema(id=L.Int, name=L.String)).aggregate(lambda r: agg(r).count(n=r.id))


@query("SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS keys, min(n_name) AS first FROM nation")
def read_csv_roundtrip(t):
    path = scratch(t.spark, "nation")
    t.nation.frame().write.option("header", True).csv(path)
    schema = L.schema(n_nationkey=L.Int, n_name=L.String, n_regionkey=L.Int32)
    return sources.read_csv(t.spark, schema, path).aggregate(lambda r: agg(r).count(n=1).sum(keys=r.n_nationkey).min(first=r.n_name))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def read_parquet_scan(t):
    schema = L.schema(o_orderkey=L.Int, o_totalprice=L.Float64, o_orderstatus=L.String)
    return sources.read_parquet(t.spark, schema, f"{t.sf_dir}/orders.parquet")


@query("SELECT 200::BIGINT AS n, 20100::BIGINT AS ids, 10::BIGINT AS len, 3::BIGINT AS kinds")
def generate_parquet_join(t):
    schema = L.schema(thing_id=L.Int, name=L.String, kind=L.String)
    [path] = sources.generate_parquet(t.spark, {"thing": schema}, scratch(t.spark, "made"), 200, [("kind", sources.gen_choice(["a", "b", "c"]))])
    made = sources.read_parquet(t.spark, schema, path)
    return made.aggregate(lambda r: agg(r).count(n=1).sum(ids=r.thing_id).max(len=f.text_length(r.name)).count_distinct(kinds=r.kind))


@query("SELECT 100::BIGINT AS n, 50::BIGINT AS joined")
def generate_csv_pair(t):
    left, right = L.schema(l_id=L.Int, left=L.String), L.schema(l_id=L.Int, right=L.String)
    a, b = sources.generate_csv(t.spark, {"left": left, "right": right}, scratch(t.spark, "pair"), 100)
    others = sources.read_csv(t.spark, right, b).filter(lambda r: f.floor_mod(r.l_id, 2) == 0)
    joined = sources.read_csv(t.spark, left, a).join_left(lambda r: r.l_id, right_one=others.join_by(lambda r: r.l_id))
    return joined.aggregate(lambda r: agg(r).count(n=1, joined=r.right_one.right))


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def sql_passthrough(t):
    t.nation.frame().createOrReplaceTempView("nation_view")
    return sources.sql(t.spark, "SELECT n_name, n_regionkey FROM nation_view WHERE n_regionkey = 2")


@query("SELECT count(*) AS n FROM region")
def named_table(t):
    t.region.frame().createOrReplaceTempView("region_view")
    return sources.table(t.spark, "region_view").aggregate(lambda r: agg(r).count(n=1))


# Rows


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def filter_native(t):
    return t.lineitem.filter(lambda r: f.between(r.l_discount, 0.05, 0.07) & (r.l_quantity < 24)).map(
        lambda r: {"l_orderkey": r.l_orderkey, "l_linenumber": r.l_linenumber, "l_discount": r.l_discount}
    )


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F') AND (o_totalprice > 100000 OR (o_orderpriority = '1-URGENT') <> (o_orderkey % 2 = 0))")
def filter_compound(t):
    return t.orders.filter(
        lambda r: ~(r.o_orderstatus == "F") & f.or_(r.o_totalprice > 100000, f.xor(r.o_orderpriority == "1-URGENT", r.o_orderkey % 2 == 0))
    ).map(lambda r: {"o_orderkey": r.o_orderkey})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, -l_quantity AS minus, l_extendedprice / l_quantity AS unit FROM lineitem")
def map_project(t):
    return t.lineitem.map(
        lambda r: {"l_orderkey": r.l_orderkey, "l_linenumber": r.l_linenumber, "revenue": r.l_extendedprice * (1 - r.l_discount), "minus": -r.l_quantity, "unit": r.l_extendedprice / r.l_quantity}
    )


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def flat_map_words(t):
    from pyspark.sql import functions as F

    words = t.documents.flat_map(lambda r: F.split(r.text, " "))
    return words.filter(lambda r: r.value != "").aggregate(lambda r: agg(r).group_by(word=r.value).count(n=1))


@query("SELECT o_orderkey AS key, i AS i FROM orders, (VALUES (1::BIGINT), (2::BIGINT)) v(i) WHERE o_orderkey % 2 = 0")
def flat_map_drop_empty(t):
    return t.orders.flat_map(lambda r: f.map_(f.range_(1, f.if_(r.o_orderkey % 2 == 0, 3, 1)), lambda i: f.tuple_(key=r.o_orderkey, i=i)))


@query("SELECT 100::BIGINT AS n")
def limit_count(t):
    return t.lineitem.limit(100).aggregate(lambda r: agg(r).count(n=1))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def ext_sort_limit(t):
    return t.orders.sort_desc(lambda r: f.tuple_(r.o_totalprice, -r.o_orderkey)).limit(25).map(lambda r: {"o_orderkey": r.o_orderkey, "o_totalprice": r.o_totalprice})


@query("SELECT count(*) AS n, min(p_size)::INTEGER AS least FROM part WHERE p_size > 10")
def ext_write_read(t):
    path = scratch(t.spark, "part")
    t.part.filter(lambda r: r.p_size > 10).write(path)
    return sources.read_parquet(t.spark, None, path).aggregate(lambda r: agg(r).count(n=1).min(least=r.p_size))


# Aggregates


@query("SELECT count(*) AS n, sum(l_quantity) AS quantity, round(avg(l_discount), 8) AS discount FROM lineitem")
def agg_global(t):
    out = t.lineitem.aggregate(lambda r: agg(r).count(n=1).sum(quantity=r.l_quantity).mean(discount=r.l_discount))
    return out.map(lambda r: {"n": r.n, "quantity": r.quantity, "discount": _round(r.discount, 8)})


def _round(x, n):
    from pyspark.sql import functions as F

    return F.round(f.col(x), n)


@query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS discount, count(*) AS n "
    "FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2"
)
def agg_group_named(t):
    kept = t.lineitem.filter(lambda r: r.l_quantity > 10)
    out = kept.aggregate(
        lambda r: agg(r).group_by(l_returnflag=r.l_returnflag, l_linestatus=r.l_linestatus).sum(price=r.l_extendedprice).mean(discount=r.l_discount).count(n=1)
    )
    return out.map(lambda r: {"l_returnflag": r.l_returnflag, "l_linestatus": r.l_linestatus, "price": _round(r.price, 2), "discount": _round(r.discount, 6), "n": r.n})


@query("SELECT o_orderstatus AS arg_0, count(*) AS arg_1, max(o_totalprice) AS arg_2 FROM orders GROUP BY 1")
def agg_group_unnamed(t):
    return t.orders.aggregate(lambda r: agg(r).group_by(r.o_orderstatus).count(1).max(r.o_totalprice))


@query("SELECT event_type, min(value) AS low, max(value) AS high, min(ts) AS first FROM events GROUP BY 1")
def agg_min_max(t):
    return t.events.aggregate(lambda r: agg(r).min(low=r.value).max(high=r.value).min(first=r.ts).group_by(event_type=r.event_type))


@query("SELECT user_id, count(*) FILTER (WHERE value > 50) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def agg_count_nonnull(t):
    from pyspark.sql import functions as F

    return t.events.aggregate(lambda r: agg(r).group_by(user_id=r.user_id).count(n=F.when(r.value > 50, 1)).count_distinct(kinds=r.event_type))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS names FROM orders GROUP BY 1")
def agg_to_set(t):
    out = t.orders.aggregate(lambda r: agg(r).group_by(o_custkey=r.o_custkey).to_set(s=r.o_orderpriority))
    return out.map(lambda r: {"o_custkey": r.o_custkey, "kinds": f.length(r.s), "names": f.concat(f.sort(r.s, lambda x: x), "|")})


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
def agg_to_array(t):
    out = t.orders.aggregate(lambda r: agg(r).group_by(o_custkey=r.o_custkey).to_array(a=r.o_orderkey))
    return out.map(lambda r: {"o_custkey": r.o_custkey, "keys": f.concat(f.map_(f.sort(r.a, lambda x: x), f.to_string), ",")})


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS high FROM orders GROUP BY 1")
def agg_to_array_records(t):
    out = t.orders.aggregate(lambda r: agg(r).group_by(o_custkey=r.o_custkey).to_array(all=r))
    return out.map(lambda r: {"o_custkey": r.o_custkey, "n": f.length(r.all), "high": f.greatest(f.map_(r.all, lambda o: o.o_totalprice))})


@query("SELECT count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders")
def agg_spec_join(t):
    return t.orders.aggregate(lambda r: agg(r).count(n=1).join(agg(r).sum(s=r.o_custkey)))


# Joins


@query("SELECT o_orderkey, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_single(t):
    return t.orders.join_left(lambda r: r.o_custkey, c=t.customer.join_by(lambda r: r.c_custkey)).map(lambda r: {"o_orderkey": r.o_orderkey, "name": r.c.c_name})


@query("SELECT d.doc_id, l.quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_single_missing(t):
    joined = t.documents.join_left(lambda r: r.doc_id, label=t.labels.join_by(lambda r: r.doc_id))
    return joined.map(lambda r: {"doc_id": r.doc_id, "quality": r.label.quality, "missing": f.is_null(r.label)})


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_single_dup(t):
    joined = t.customer.join_left(lambda r: r.c_custkey, o=t.orders.join_by(lambda r: r.o_custkey))
    return joined.aggregate(lambda r: agg(r).group_by(c_custkey=r.c_custkey).count(n=r.o.o_orderkey))


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_multi(t):
    joined = t.customer.join_left(lambda r: r.c_custkey, orders=t.orders.join_multi_by(lambda r: r.o_custkey))
    return joined.map(lambda r: {"c_custkey": r.c_custkey, "n": f.length(r.orders), "total": _round(f.total(f.map_(r.orders, lambda o: o.o_totalprice)), 2)})


@query(
    "SELECT c_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS done "
    "FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"
)
def join_multi_array(t):
    open_, done = (t.orders.filter(lambda r, s=s: r.o_orderstatus == s) for s in "OF")
    joined = t.customer.join_left(lambda r: r.c_custkey, o=join_multi_by([open_, done], lambda r: r.o_custkey))
    of = lambda r, i: f.length(f.filter_(r.o_index, lambda k: k == i))
    return joined.map(lambda r: {"c_custkey": r.c_custkey, "open": of(r, 0), "done": of(r, 1)})


def stocked(t):
    """Suppliers with their nation, all their lines, and those sent back or taken."""
    back, taken = (t.lineitem.filter(lambda r, s=s: r.l_returnflag == s) for s in "RA")
    return t.supplier.filter(lambda r: r.s_acctbal > 0).join_left(
        lambda r: r.s_suppkey, lines=t.lineitem.join_multi_by(lambda r: r.l_suppkey), settled=join_multi_by([back, taken], lambda r: r.l_suppkey)
    ).join_left(lambda r: r.s_nationkey, home=t.nation.join_by(lambda r: r.n_nationkey))


STOCK = """
WITH l AS (SELECT l_suppkey AS k, count(*) AS n, sum(l_quantity) AS q, count(*) FILTER (WHERE l_returnflag = 'R') AS back, count(*) FILTER (WHERE l_returnflag = 'A') AS taken FROM lineitem GROUP BY 1)
"""


@query(STOCK + "SELECT s_suppkey, n_name, coalesce(n, 0) AS n, coalesce(q, 0) AS quantity, coalesce(back + taken, 0) AS settled, coalesce(taken, 0) AS taken FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN l ON s_suppkey = k WHERE s_acctbal > 0")
def join_mixed(t):
    return stocked(t).map(
        lambda r: {"s_suppkey": r.s_suppkey, "n_name": r.home.n_name, "n": f.length(r.lines), "quantity": f.total(f.map_(r.lines, lambda x: x.l_quantity)), "settled": f.length(r.settled), "taken": f.total_int(r.settled_index)}
    )


@query(STOCK + "SELECT count(*) AS n, sum(n)::BIGINT AS lines, sum(back + taken)::BIGINT AS settled FROM supplier JOIN l ON s_suppkey = k WHERE s_acctbal > 0")
def join_mixed_totals(t):
    kept = stocked(t).filter(lambda r: ~f.empty(r.lines))
    return kept.aggregate(lambda r: agg(r).count(n=1).sum(lines=f.length(r.lines), settled=f.length(r.settled)))


@query(
    "SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS high, min(o_orderkey) AS first, coalesce(sum(o_orderkey), 0)::BIGINT AS keys, "
    "coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS told FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"
)
def join_multi_records(t):
    """Figures of the records and the records themselves, so arrays are gathered."""
    joined = t.customer.join_left(lambda r: r.c_custkey, o=t.orders.join_multi_by(lambda r: r.o_custkey))
    keys = lambda r: f.map_(r.o, lambda o: o.o_orderkey)
    return joined.map(lambda r: {"c_custkey": r.c_custkey, "n": f.length(r.o), "high": f.greatest(f.map_(r.o, lambda o: o.o_totalprice)), "first": f.least(keys(r)), "keys": f.total_int(keys(r)), "told": f.concat(f.map_(f.sort(keys(r), lambda x: x), f.to_string), ",")})


@query("SELECT nullif(c_nationkey, 3) AS k, (count(*) * count(*))::BIGINT AS n FROM customer GROUP BY 1")
def join_null_key(t):
    """All customers on both sides, so that null is a hot key."""
    from pyspark.sql import functions as F

    keyed = t.customer.map(lambda r: {"id": r.c_custkey, "k": F.nullif(r.c_nationkey, F.lit(3))})
    joined = keyed.join_left(lambda r: r.k, o=keyed.join_multi_by(lambda r: r.k))
    return joined.aggregate(lambda r: agg(r).group_by(k=r.k).sum(n=f.length(r.o)))


@query("SELECT c_custkey, c_name FROM customer")
def join_unused_pruned(t):
    return t.customer.join_left(lambda r: r.c_custkey, o=t.orders.join_multi_by(lambda r: r.o_custkey)).map(lambda r: {"c_custkey": r.c_custkey, "c_name": r.c_name})


@query(
    "WITH s AS (SELECT conv_id, role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY chars DESC, role DESC) AS k FROM s WHERE n >= 2) "
    "SELECT c.conv_id AS conv, r.role AS loudest, c.n AS turns FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c LEFT JOIN r ON c.conv_id = r.conv_id AND k = 1"
)
def loudest_speakers(t):
    """Who says most in each conversation, of those who speak twice: groups within a group's records."""
    from pyspark.sql import functions as F

    talks = t.conversations.aggregate(lambda r: agg(r).group_by(conv=r.conv_id).to_array(said=r))

    def loudest(r):
        by_role = f.aggregate_to_array(r.said, lambda s: s.role, lambda s: f.text_length(s.text))
        told = f.map_(by_role, lambda g: f.tuple_(role=g["_1"], n=f.length(g["_2"]), chars=f.total_int(g["_2"])))
        best = f.max_by(f.filter_(told, lambda g: g["n"] >= 2), lambda g: F.struct(g["chars"], g["role"]))
        return {"conv": r.conv, "loudest": f.ensured_run(best, lambda b: b["role"]), "turns": f.length(r.said)}

    return talks.map(loudest)


# Collections inside a record. Arrays are all the words of a text, or the numbers of a vector.

WORDS = "string_split(text, ' ')"


def _collection(name: str, sql: str, made: Callable, table: str = "documents", key: str = "doc_id", source: str = WORDS) -> None:
    from pyspark.sql import functions as F

    def run(t):
        return getattr(t, table).map(lambda r: {key: r[key], "x": made(F.split(r.text, " ") if source == WORDS else r[source])})

    run.__name__ = name
    query(f"SELECT {key}, {sql.format(a=source)} AS x FROM {table}")(run)


def _told(array, join: str = " "):
    """An array of numbers as a text."""
    return f.concat(f.map_(array, f.to_string), join)


_collection("arr_len", "len({a})", f.length)
_collection("arr_empty", "len({a}) = 0", f.empty)
_collection("arr_contains", "list_contains({a}, 'of')", lambda a: f.contains(a, "of"))
_collection("arr_in", "list_contains({a}, 'the')", lambda a: f.in_("the", a))
_collection("arr_to_array", "array_to_string({a}, '|')", lambda a: f.concat(f.to_array(a), "|"))
_collection("arr_concat", "array_to_string({a}, '-')", lambda a: f.concat(a, "-"))
_collection("arr_to_set", "array_to_string(list_sort(list_distinct({a})), ' ')", lambda a: f.concat(f.sort(f.to_set(a), lambda w: w), " "))
_collection("arr_map", "array_to_string(list_transform({a}, lambda w: w || '!'), ' ')", lambda a: f.concat(f.map_(a, lambda w: _join(w, "!")), " "))
_collection("arr_filter", "array_to_string(list_filter({a}, lambda w: length(w) > 4), ' ')", lambda a: f.concat(f.filter_(a, lambda w: f.text_length(w) > 4), " "))
_collection("arr_zip2", "array_to_string(list_transform(range(1, least(len({a}), 3) + 1), lambda i: {a}[i] || i::VARCHAR), ' ')", lambda a: f.concat(f.map_(f.zip_(a, f.array(1, 2, 3)), lambda z: _join(z["_1"], f.to_string(z["_2"]))), " "))
_collection("arr_zip3", "array_to_string(list_transform(range(1, least(len({a}), 2) + 1), lambda i: {a}[i] || i::VARCHAR || i::VARCHAR), ' ')", lambda a: f.concat(f.map_(f.zip_(a, f.array(1, 2, 3), f.array(1, 2)), lambda z: _join(z["_1"], f.to_string(z["_2"]), f.to_string(z["_3"]))), " "))
_collection("arr_zip4", "coalesce({a}[1], '') || '4'", lambda a: f.concat(f.map_(f.zip_(a, f.array(1), f.array(2), f.array("4")), lambda z: _join(z["_1"], z["_4"])), ""))
_collection("arr_sort", "array_to_string(list_sort({a}), ' ')", lambda a: f.concat(f.sort(a, lambda w: w), " "))
_collection("arr_sort_reverse", "array_to_string(list_reverse_sort({a}), ' ')", lambda a: f.concat(f.sort(a, lambda w: w, True), " "))
_collection("arr_front", "{a}[1]", f.front)
_collection("arr_shuffle", "len({a})", lambda a: f.length(f.shuffle(a, 7)))
_collection("arr_sum", "list_sum(list_transform({a}, lambda w: length(w)))::BIGINT", lambda a: f.total_int(f.map_(a, f.text_length)))
_collection("arr_max", "list_max({a})", f.greatest)
_collection("arr_min", "list_min({a})", f.least)
_collection("arr_max_by", "list_max(list_transform({a}, lambda w: lpad(length(w)::VARCHAR, 6, '0') || w))[7:]", lambda a: f.max_by(a, f.text_length))
_collection("arr_min_by", "list_min(list_transform({a}, lambda w: lpad(length(w)::VARCHAR, 6, '0') || w))[7:]", lambda a: f.min_by(a, f.text_length))
_collection("arr_range", "array_to_string(range(2, len({a}), 3), ' ')", lambda a: _told(f.range_(2, f.length(a), 3)))
_collection("arr_range_down", "array_to_string(range(len({a}), 2, -1), ' ')", lambda a: _told(f.range_(f.length(a), 2, -1)))
_collection("arr_flatten", "array_to_string(list_concat({a}, {a}), ' ')", lambda a: f.concat(f.flatten(f.array(a, a)), " "))
_collection("arr_reduce", "list_sum(list_transform({a}, lambda w: length(w)))::BIGINT", lambda a: f.reduce_(a, f.to_int(0), lambda s, w: s + f.text_length(w)))
_collection(
    "arr_to_map",
    "array_to_string(list_transform(list_sort(list_distinct(list_transform({a}, lambda w: length(w)))), lambda n: n::VARCHAR || '=' || list_last(list_filter({a}, lambda w: length(w) = n))), ' ')",
    lambda a: f.concat(f.map_(f.sort(f.map_to_array(f.to_map(a, f.text_length, lambda w: w)), lambda e: e["key"]), lambda e: _join(f.to_string(e["key"]), "=", e["value"])), " "),
)
_collection("arr_to_map_last", "list_last(list_filter({a}, lambda w: length(w) = 3))", lambda a: f.value_of(f.to_map(a, f.text_length, lambda w: w), f.to_int(3)))
_collection(
    "arr_aggregate_to_array",
    "array_to_string(list_transform(list_sort(list_distinct(list_transform({a}, lambda w: length(w)))), lambda n: n::VARCHAR || ':' || array_to_string(list_filter({a}, lambda w: length(w) = n), '+')), ' ')",
    lambda a: f.concat(f.map_(f.aggregate_to_array(a, f.text_length, lambda w: w), lambda g: _join(f.to_string(g["_1"]), ":", f.concat(g["_2"], "+"))), " "),
)
_collection(
    "arr_aggregate_to_set",
    "array_to_string(list_transform(list_sort(list_distinct(list_transform({a}, lambda w: length(w)))), lambda n: n::VARCHAR || ':' || array_to_string(list_sort(list_distinct(list_filter({a}, lambda w: length(w) = n))), '+')), ' ')",
    lambda a: f.concat(f.map_(f.aggregate_to_set(a, f.text_length, lambda w: w), lambda g: _join(f.to_string(g["_1"]), ":", f.concat(f.sort(g["_2"], lambda w: w), "+"))), " "),
)
_collection("arr_native", "len(list_filter({a}, lambda v: v > 0))", lambda a: f.length(f.filter_(a, lambda v: v > 0)), "embeddings", "vec_id", "embedding")


def _join(*parts):
    from pyspark.sql import functions as F

    return F.concat(*map(f.col, parts))


# Scalars


def _scalar(name: str, table: str, key: str, **pairs: tuple[Callable, str]) -> None:
    def run(t):
        return getattr(t, table).map(lambda r: {key: r[key]} | {k: made(r) for k, (made, _) in pairs.items()})

    run.__name__ = name
    query(f"SELECT {key}, {', '.join(f'{sql} AS {k}' for k, (_, sql) in pairs.items())} FROM {table}")(run)


def _nullable(r):
    from pyspark.sql import functions as F

    return F.nullif(r.o_orderkey % 3, F.lit(1))


NULLED = "nullif(o_orderkey % 3, 1)"
_scalar("op_unary", "orders", "o_orderkey", neg=(lambda r: -r.o_custkey, "-o_custkey"), pos=(lambda r: _plus(r.o_custkey), "+o_custkey"), inv=(lambda r: _invert(r.o_custkey), "~o_custkey"), no=(lambda r: ~(r.o_custkey > 5), "NOT o_custkey > 5"))
_scalar("op_if", "orders", "o_orderkey", size=(lambda r: f.if_(r.o_totalprice > 1e5, "big", "small"), "CASE WHEN o_totalprice > 1e5 THEN 'big' ELSE 'small' END"), mid=(lambda r: f.between(r.o_custkey, 3, 9), "o_custkey BETWEEN 3 AND 9"))
_scalar("op_arith", "orders", "o_orderkey", mul=(lambda r: r.o_custkey * 3, "o_custkey * 3"), add=(lambda r: r.o_custkey + 3, "o_custkey + 3"), sub=(lambda r: r.o_custkey - 30, "o_custkey - 30"), div=(lambda r: r.o_custkey / 4, "o_custkey / 4"))
_scalar("op_mod", "orders", "o_orderkey", a=(lambda r: f.floor_mod(r.o_custkey - 700, 7), "((o_custkey - 700) % 7 + 7) % 7"), b=(lambda r: f.floor_mod(r.o_custkey, -7), "(o_custkey % -7 - 7) % -7"))
_scalar("op_shift_bits", "orders", "o_orderkey", l=(lambda r: f.shift_left(r.o_custkey, 3), "o_custkey << 3"), r=(lambda r: f.shift_right(r.o_custkey, 2), "o_custkey >> 2"), a=(lambda r: r.o_custkey.bitwiseAND(6), "o_custkey & 6"), o=(lambda r: r.o_custkey.bitwiseOR(6), "o_custkey | 6"), x=(lambda r: r.o_custkey.bitwiseXOR(6), "xor(o_custkey, 6)"))
_scalar("op_compare", "orders", "o_orderkey", lt=(lambda r: r.o_custkey < 9, "o_custkey < 9"), le=(lambda r: r.o_custkey <= 9, "o_custkey <= 9"), gt=(lambda r: r.o_orderpriority > "2", "o_orderpriority > '2'"), ge=(lambda r: r.o_orderdate >= f.datetime(1995, 1, 1), "o_orderdate >= TIMESTAMP '1995-01-01'"))
_scalar("op_equals", "orders", "o_orderkey", eq=(lambda r: f.equals(_nullable(r), None), f"{NULLED} IS NULL"), ne=(lambda r: f.differs(_nullable(r), 2), f"{NULLED} IS DISTINCT FROM 2"))
_scalar("op_logic", "orders", "o_orderkey", both=(lambda r: f.and_(r.o_custkey > 3, 10 / r.o_custkey > 1), "CASE WHEN o_custkey > 3 THEN 10 / o_custkey > 1 ELSE false END"), x=(lambda r: f.xor(r.o_custkey > 3, r.o_custkey < 9), "(o_custkey > 3) <> (o_custkey < 9)"))
_scalar("op_text_plus", "orders", "o_orderkey", s=(lambda r: _join(r.o_orderstatus, "/", r.o_orderpriority), "o_orderstatus || '/' || o_orderpriority"))
_scalar("null_functions", "orders", "o_orderkey", isnull=(lambda r: f.is_null(_nullable(r)), f"{NULLED} IS NULL"), e=(lambda r: f.ensure(_nullable(r), 7), f"coalesce({NULLED}, 7)"), run=(lambda r: f.ensured_run(_nullable(r), lambda x: x * 2), f"{NULLED} * 2"), sure=(lambda r: f.ensured(r.o_custkey), "o_custkey"))
_scalar("cast_int", "orders", "o_orderkey", i=(lambda r: f.to_int(-r.o_totalprice), "trunc(-o_totalprice)::BIGINT"), b=(lambda r: f.to_int(r.o_custkey > 5), "(o_custkey > 5)::BIGINT"), p=(lambda r: f.parse_int(r.o_orderpriority), "NULL::BIGINT"), d=(lambda r: f.parse_int(r.o_orderpriority, -1), "-1::BIGINT"), u=(lambda r: f.to_uint(r.o_custkey - 50), "greatest(o_custkey - 50, 0)"))
_scalar("cast_bool_text", "orders", "o_orderkey", n=(lambda r: f.number_to_bool(_nullable(r)), f"coalesce({NULLED} <> 0, false)"), t=(lambda r: f.text_to_bool(r.o_orderstatus), "length(o_orderstatus) > 0"), s=(lambda r: f.to_string(r.o_custkey), "o_custkey::VARCHAR"))
_scalar("cast_defaults", "region", "r_regionkey", i=(lambda r: f.default(L.Int), "0::BIGINT"), s=(lambda r: f.default(L.String), "''"), b=(lambda r: f.default(L.Bool), "false"), d=(lambda r: f.default(L.Date), "DATE '1970-01-01'"), a=(lambda r: f.length(f.default(L.Array(L.Int))), "0::BIGINT"), m=(lambda r: f.length(f.default(L.Map(L.Int, L.Int))), "0::BIGINT"), c=(lambda r: f.construct(L.schema(x=L.Int, y=L.String), x=5)["x"], "5::BIGINT"), e=(lambda r: f.construct(L.schema(x=L.Int, y=L.String), copy=f.tuple_(x=1, y="q"), x=2)["y"], "'q'"))
_scalar("date_parts", "orders", "o_orderkey", y=(lambda r: f.year(r.o_orderdate), "year(o_orderdate)"), m=(lambda r: f.month(r.o_orderdate), "month(o_orderdate)"), d=(lambda r: f.day(r.o_orderdate), "day(o_orderdate)"), w=(lambda r: f.weekday(r.o_orderdate), "isodow(o_orderdate) - 1"), iso=(lambda r: f.isoformat(r.o_orderdate), "strftime(o_orderdate, '%Y-%m-%d')"), fmt=(lambda r: f.strftime(r.o_orderdate, "%d/%m/%Y at %H:%M"), "strftime(o_orderdate, '%d/%m/%Y at %H:%M')"))
_scalar("date_make", "orders", "o_orderkey", d=(lambda r: f.date(2023, 2, r.o_custkey % 31 + 1), "CASE WHEN o_custkey % 31 < 28 THEN make_date(2023, 2, o_custkey % 31 + 1) END"), e=(lambda r: f.date_ensured(2023, 2, r.o_custkey % 31 + 1), "CASE WHEN o_custkey % 31 < 28 THEN make_date(2023, 2, o_custkey % 31 + 1) ELSE DATE '1970-01-01' END"), p=(lambda r: f.parse_date(f.isoformat(r.o_orderdate)), "o_orderdate::DATE"), bad=(lambda r: f.parse_date(r.o_orderstatus), "NULL::DATE"), t=(lambda r: f.date_of(r.o_orderdate), "o_orderdate::DATE"), dt=(lambda r: f.datetime(2020, 1, 2, 3, 4, 5), "TIMESTAMP '2020-01-02 03:04:05'"), ms=(lambda r: f.timestamp_ms(r.o_orderkey * 1000), "make_timestamp(o_orderkey * 1000000)"), sec=(lambda r: f.timestamp_sec(r.o_orderkey), "make_timestamp(o_orderkey * 1000000)"), z=(lambda r: f.datetime_ensured(r.o_orderstatus), "TIMESTAMP '1970-01-01'"))
_scalar("date_arith", "orders", "o_orderkey", a=(lambda r: f.date_add(f.date_of(r.o_orderdate), f.interval(weeks=1, days=2)), "(o_orderdate::DATE + INTERVAL 9 DAY)::DATE"), s=(lambda r: f.date_sub(f.date_of(r.o_orderdate), f.interval(days=40)), "(o_orderdate::DATE - INTERVAL 40 DAY)::DATE"), d=(lambda r: f.date_diff(f.date_of(r.o_orderdate), f.date(1992, 1, 1)).cast("interval day").cast("bigint"), "o_orderdate::DATE - DATE '1992-01-01'"), h=(lambda r: r.o_orderdate + f.interval(hours=2, minutes=5), "o_orderdate + INTERVAL 125 MINUTE"))
_scalar("str_functions", "documents", "doc_id", s=(lambda r: f.strip(_join(" \t", r.source, "\n ")), "source"), n=(lambda r: f.text_length(r.text), "length(text)"), b=(lambda r: f.bytes_length(r.text), "strlen(text)"), e=(lambda r: f.text_empty(r.text), "length(text) = 0"))
_scalar("access", "orders", "o_orderkey", a=(lambda r: f.at(f.array(1, 2, 3), r.o_orderkey % 5), "CASE WHEN o_orderkey % 5 < 3 THEN (o_orderkey % 5 + 1)::INTEGER END"), m=(lambda r: f.value_of(f.dict_({"F": 1, "O": 2}), r.o_orderstatus), "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END"), s=(lambda r: f.contains(f.set_("F", "F"), r.o_orderstatus), "o_orderstatus = 'F'"), t=(lambda r: f.nth(f.tuple_(r.o_orderkey, "x"), 0), "o_orderkey"), n=(lambda r: f.tuple_(p=f.tuple_(q=r.o_custkey))["p"]["q"], "o_custkey"), k=(lambda r: f.contains_key(f.dict_({"F": 1}), r.o_orderstatus), "o_orderstatus = 'F'"))


def _invert(x):
    from pyspark.sql import functions as F

    return F.bitwise_not(f.col(x))


def _plus(x):
    from pyspark.sql import functions as F

    return F.positive(f.col(x))


# Programs in the language


LANG = """
import dataset
schema Turn = { conv_id: Int; role: String; text: String; }
schema Talk = { conv: Int; loudest: Nullable<String>; turns: UInt; }
schema Supplier = { s_suppkey: Int; s_acctbal: Float64; }
schema Line = { l_suppkey: Int; l_quantity: Float64; l_returnflag: String; }
schema Order = { o_orderkey: Int; o_custkey: Int; o_orderstatus: String; }
param least: UInt = 2;
def orders(dir: String) => dataset.read_parquet(Order(), dir + "/orders.parquet")
def lines(dir: String) => dataset.read_parquet(Line(), dir + "/lineitem.parquet")
def settled(dir: String, how: String) => lines(dir).filter((x, how = how) => x.l_returnflag == how)
def loudest(said: Array<Turn>, least: UInt) => said
  .aggregate_to_array(s => s.role, s => len(s.text))
  .filter((g, n = least) => len(g[1]) >= n)
  .max_by(g => sum(g[1]))
  .ensured_run(g => g[0])
def talks(dir: String) => dataset.read_parquet(Turn(), dir + "/conversations.parquet")
  .aggregate(s => dataset.agg(s).group_by({conv = s.conv_id}).to_array({said = s}))
  .map(c => Talk(conv = c.conv, loudest = loudest(c.said, least), turns = len(c.said)))
def stock(dir: String) => dataset.read_parquet(Supplier(), dir + "/supplier.parquet").filter(s => s.s_acctbal > 0)
  .join_left(s => s.s_suppkey, {
    lines = lines(dir).join_multi_by(x => x.l_suppkey),
    settled = [settled(dir, "R"), settled(dir, "A")].join_multi_by(x => x.l_suppkey)})
  .filter(s => len(s.lines) > 0u)
  .aggregate(s => dataset.agg(s).count({n = 1}).sum({lines = len(s.lines), settled = len(s.settled)}))
def band(n: Int) : String => {
  if (n < 10) { return "low" } elif (n < 50) { return "mid" }
  "high"
}
def band(s: String, sign: String = "!") : String => s + sign
def demo_control(dir: String) => orders(dir).map(o => {
  mark = "other"
  if (o.o_orderstatus == "F") { mark = "done" }
  { o_orderkey = o.o_orderkey, band = band(o.o_custkey), status = band(sign = "?", s = o.o_orderstatus), mark = mark }
})
def demo_yield(dir: String) => orders(dir).flat_map(o => {
  if (o.o_orderkey % 2 == 0) { pass }
  yield { key = o.o_orderkey }
  yield { key = -o.o_orderkey }
})
"""


def _program(name: str, function: str, sql: str) -> None:
    def run(t):
        from lattica.lang.evaluate import Program

        program = Program(t.spark)
        return program.call(program.compile(LANG), function, t.sf_dir)

    run.__name__ = name
    query(sql)(run)


_program("lang_talks", "talks", ORACLE["loudest_speakers"])
_program("lang_stock", "stock", ORACLE["join_mixed_totals"])
_program(
    "lang_control", "demo_control",
    "SELECT o_orderkey, CASE WHEN o_custkey < 10 THEN 'low' WHEN o_custkey < 50 THEN 'mid' ELSE 'high' END AS band, o_orderstatus || '?' AS status, "
    "CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'other' END AS mark FROM orders",
)
_program("lang_yield", "demo_yield", "SELECT o_orderkey * s AS key FROM orders, (VALUES (1), (-1)) v(s) WHERE o_orderkey % 2 <> 0")
