"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Every group of equal texts goes to one shard as a whole. A partial partition is a tuple of as many sums as there are
shards; differencing takes the two partial partitions with the largest spread and adds them oppositely ordered, the
largest sum to the smallest. Groups are dealt to buckets, each bucket is differenced down to one tuple in a task, and the
buckets' tuples are differenced the same way. As many equal groups as there are shards cancel at once, so a task keeps
fewer groups of a size than there are shards.

A group larger than a shard's fair share can't stay whole in a partition whose shards are near equal. With split_huge the
rows of such a group, and of no other, are dealt to smaller units, and the law "bytes" holds; without, every group stays
whole, and the shards are as near as their largest group allows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._common import gapless_rank, join_hot, stage, unstage

#: Units of a group that is larger than a shard's share.
UNITS = 4096
#: Groups differenced at once in a task, and buckets at most.
TASK_GROUPS, MOST_BUCKETS = 50_000, 8192


def difference(parts: list[list[int]]) -> list[np.ndarray]:
    """For partial partitions (equally many sums each): in each, which final subset every one of its sums goes to.

    The subsets' totals differ by as little as differencing gets them.
    """
    if not parts:
        return []
    k = len(parts[0])
    heap: list[tuple[int, int, list[int]]] = []
    nodes: list[tuple[int, list[int], int, list[int]] | None] = [None] * len(parts)
    for i, sums in enumerate(parts):
        heapq.heappush(heap, (min(sums) - max(sums), i, sums))
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        down = sorted(range(k), key=a.__getitem__, reverse=True)
        up = sorted(range(k), key=b.__getitem__)
        sums = [a[p] + b[q] for p, q in zip(down, up, strict=True)]
        nodes.append((i, down, j, up))
        heapq.heappush(heap, (min(sums) - max(sums), len(nodes) - 1, sums))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
    todo = [(heap[0][1], list(range(k)))]
    while todo:
        i, to = todo.pop()
        if (node := nodes[i]) is None:
            out[i] = np.array(to)
            continue
        left, down, right, up = node
        own, other = [0] * k, [0] * k
        for place, (p, q) in enumerate(zip(down, up, strict=True)):
            own[p], other[q] = to[place], to[place]
        todo += [(left, own), (right, other)]
    return out


def split_sizes(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of k subsets each size goes to, and the subsets' totals."""
    order = np.argsort(sizes, kind="stable")
    to = np.zeros(len(sizes), np.int64)
    ordered = sizes[order]
    begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    run = np.diff(np.r_[begins, len(sizes)])
    nth = np.arange(len(sizes)) - np.repeat(begins, run)
    whole = nth < np.repeat(run // k * k, run)
    to[order[whole]] = nth[whole] % k
    rest = order[~whole]
    sums = []
    runs = np.array_split(rest, max(1, -(-len(rest) // TASK_GROUPS)))
    for run in runs:
        for i, subset in zip(run, difference([[int(s)] + [0] * (k - 1) for s in sizes[run]]), strict=True):
            to[i] = subset[0]
        sums.append([int(x) for x in np.bincount(to[run], weights=sizes[run], minlength=k)])
    for run, subset in zip(runs, difference(sums), strict=True):
        to[run] = subset[to[run]]
    return to, np.bincount(to, weights=sizes, minlength=k).astype(np.int64)


def balance(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8,
    buckets: int | None = None, split_huge: bool = True,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs: shards' sums of size nearly equal.

    size is the UTF-8 bytes of the text (null or empty: none) plus overhead. Rows of equal texts share a shard; with
    split_huge, unless they are more than a shard's fair share of all bytes. slot runs from 0 without a gap in each shard;
    rows that are equal in all take any order. Rows that repeat an id, or have none, are placed each, by their texts. A very
    long text is one row like others; an empty table has no rows. buckets bounds the groups of one task; the default grows
    with the table. Other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "sizes")
    group = ["hash", "crc", "size"]
    groups = stage(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), "groups")
    told = groups.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, n_groups, n_rows = told
    # At most as many groups as shards are larger than a fair share of all bytes.
    huge = groups.where(F.col("size") * F.col("n") * shards > total).select(*group).collect() if split_huge else []
    is_huge = F.lit(False)
    for r in huge:
        is_huge = is_huge | ((F.col("hash") == r.hash) & (F.col("crc") == r.crc) & (F.col("size") == r.size))
    unit = F.when(is_huge, F.pmod(F.xxhash64("row"), F.lit(UNITS))).otherwise(F.lit(-1)).cast("int")
    units = rows.where(is_huge).withColumn("unit", unit).groupBy(*group, "unit").agg(F.count(F.lit(1)).alias("n"))
    units = groups.where(~is_huge).select(*group, F.lit(-1).alias("unit"), "n").unionByName(units)
    buckets = buckets or max(1, min(MOST_BUCKETS, -(-n_groups // TASK_GROUPS)))
    units = units.select(
        *group, "unit", "n", (F.col("size") * F.col("n")).alias("bytes"),
        F.pmod(F.xxhash64("hash", "size", "unit"), F.lit(buckets)).cast("int").alias("bucket"),
    )

    def dealt(key: tuple[int], own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["bytes", "hash", "crc", "unit"], ignore_index=True)
        own["part"], _ = split_sizes(own["bytes"].to_numpy(), shards)
        return own[["hash", "crc", "size", "unit", "n", "bytes", "bucket", "part"]]

    schema = "hash long, crc long, size long, unit int, n long, bytes long, bucket int, part int"
    parts = stage(units.groupBy("bucket").applyInPandas(dealt, schema), "parts")
    # A row for each bucket and shard: at most MOST_BUCKETS buckets.
    sums = {(r.bucket, r.part): r.bytes for r in parts.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")).collect()}
    names = sorted({b for b, _ in sums})
    final = difference([[sums.get((b, s), 0) for s in range(shards)] for b in names])
    to = docs.sparkSession.createDataFrame(
        [(b, s, int(own[s])) for b, own in zip(names, final, strict=True) for s in range(shards)], "bucket int, part int, shard int"
    )
    placed = parts.join(F.broadcast(to), ["bucket", "part"]).select(*group, "unit", "n", "shard")
    located = join_hot(rows.withColumn("unit", unit), placed, [*group, "unit"], "n", n_rows, F.col("row"))
    located = stage(located.select("id", "size", "crc", "shard", "row"), "located")
    unstage(groups, rows, parts)
    order = [F.col("id"), F.col("crc"), F.col("size"), F.col("row")]
    out = gapless_rank(located, ["shard"], order, [F.col("row")], "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
