"""What the corpus operators share: staged tables in the cluster's shared folder, ranks, Arrow text helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Upper to lower case for A-Z only; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A key is hot if it has more than one in so many of all rows.
HOT_KEYS = 1000
#: Edges that one task contracts at once.
CONTRACTED_EDGES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local folder if all tasks
    run in this process, else an error: each executor would write to its own disk."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        told = f"file:/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{told}/lattica"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_staged_path", None):
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], copies: str, total: int, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table, which has one row for each key and in copies how many of the total rows
    have that key.

    The rows of a key that more than one in HOT_KEYS rows has are dealt to several tasks by a hash of spread, each with
    a copy of the key's row. There are fewer than HOT_KEYS such keys, so what is broadcast, which is their names, has a
    bound; so have the copies, twice HOT_KEYS.
    """
    salts = F.least(F.ceil(F.col(copies) * HOT_KEYS / F.lit(max(1, total))), F.col(copies)).cast("int").alias("_salts")
    hot = F.broadcast(table.where((F.col(copies) * HOT_KEYS > total) & (F.col(copies) > 1)).select(*keys, salts))
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    copied = table.join(hot, keys, "left").withColumn("_salt", each).drop("_salts", copies)
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def gapless_rank(df: DataFrame, keys: list[str], order: list[Column], spread: list[Column], out: str) -> DataFrame:
    """df and a long column out: 0, 1, 2 ... within keys, without all rows of a key in one task.

    Rows of a key are dealt by a hash of spread to blocks, ranked by order within a block, and a block's rank begins
    where the block before ends. df is read twice, so it must give the same rows again (a staged table does).
    """
    blocks = shuffle_partitions(df.sparkSession)
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*spread), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
    return (
        ranked.join(bases, [*keys, "_block"])
        .withColumn(out, F.col("_base") + F.col("_rank"))
        .drop("_block", "_base", "_rank")
    )


def rest_of(docs: DataFrame, text_col: str, names: list[str]) -> list[str]:
    """Those of names that rows take along beside their text: a string column text_col among others is the text itself, and
    isn't sent to a worker twice."""
    itself = text_col in docs.columns and docs.schema[text_col].dataType == StringType()
    return [c for c in names if c != text_col] or names if itself else names


def give_back() -> None:
    """Free memory that Arrow's pool and the C library hold on to goes back to the system (the latter's with glibc only),
    as workers outlive tasks and stages and all those of an executor share its memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about limit bytes of text at most (one row at least). Memory that is free after a run
    is given back."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(ends):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
        give_back()


def mapped_bytes(texts: pa.Array, table: bytes) -> pa.Array:
    """texts with each byte replaced by table's; the caller's table keeps UTF-8 whole (bytes over 127 unchanged)."""
    texts = texts.cast(pa.string())
    if not len(texts):
        return texts
    texts = pa.concat_arrays([texts])
    valid, offsets, data = texts.buffers()
    new = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(table))
    return pa.StringArray.from_buffers(len(texts), offsets, new, valid, texts.null_count, texts.offset)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between runs of ASCII white space, in order, and how many each text has (null: none)."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
    flat = lists.flatten()
    if empty.any():
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
        counts[empty] = 0
    return flat, counts


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's number in a list of the distinct words, and that list."""
    encoded = words.dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def group_chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of equal integer keys from a stream sorted by them: a table, and where its groups begin."""

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        t = t.combine_chunks()
        at = begins(t)
        cut = int(at[-1])
        if cut:
            yield t.slice(0, cut).combine_chunks(), at[:-1]
        carry = t.slice(cut)
    if carry is not None and carry.num_rows:
        yield carry.combine_chunks(), np.zeros(1, np.int64)


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its component) for each end of the edges that isn't the least itself: as few edges as have the
    same components."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    low = own = np.arange(len(ids))
    while (apart := low[a] != low[b]).any():
        a, b = a[apart], b[apart]
        p, q = low[a], low[b]
        low = low.copy()
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while ((up := low[low]) != low).any():
            low = up
    rest = np.flatnonzero(low != own)
    return ids[rest], ids[low[rest]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), so many at a time, as those of spanning_stars."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        u, v = spanning_stars(t.column("u").to_numpy(), t.column("v").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CONTRACTED_EDGES:
            yield out()
            held.clear()
    if held:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of edges (a, b, longs): component is the least id that links lead to.

    Edges are dealt out by their greater end and first contracted within each task, so that many edges from the same rows
    to the same few are one for each row. The rest are large-star and small-star steps (Kiveris et al., 2014) until no
    id is both above one and next to another; each step's edges are staged.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    ends = ends.repartition(shuffle_partitions(edges.sparkSession), "u")
    cur = stage(ends.mapInArrow(_contracted, "u long, v long").distinct(), "edges")
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lower = F.count_if(F.col("v") < F.col("u")).alias("lower")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"), lower)
        total, open_ = least.agg(F.sum("n"), F.count_if((F.col("lower") > 0) & (F.col("n") > 1))).first()
        if not open_:
            break
        least = least.select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both, least, ["u"], "n", total, F.col("v")).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, least, ["u"], "n", total // 2, F.col("v")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stage(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unstage(cur)
        cur = new
    out = cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
    out._staged_path = cur._staged_path
    return out
