"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

The exact table has, for each line key, the number of documents that hold it and the largest id among them; what a
document contributed can be taken away again. The keys of repeated lines also stand in cuckoo filters (Fan et al. 2014),
one for each shard of the key space, which take insertions and deletions alike. A line that the filter of its shard
doesn't know is certainly not repeated and needs no look at the exact table; all others are confirmed there.

A change writes the new counts of the keys that it touches and the filters of shards where a key became or ceased to be
repeated; everything else is read where it was written before. After COMPACT changes the tables are written anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm._common import LOWER, byte_slices, join_hot, shuffle_partitions, stage

SHORTEST, REPEATS = 20, 3
_SPACE = b" \t\n\x0b\x0c\r"
SLOTS, KICKS = 4, 500
#: Changes after which a ledger's tables are written anew as one.
COMPACT = 16


class CuckooFilter:
    """16-bit fingerprints of 64-bit keys in buckets of SLOTS; what finds no room stands in a list beside them. No false
    negatives for keys inserted."""

    def __init__(self, expected: int):
        self.bits = max(2, int(np.ceil(np.log2(max(1, expected) / (0.84 * SLOTS)))))
        self.table = np.zeros((1 << self.bits, SLOTS), np.uint16)
        self.over: dict[tuple[int, int], int] = {}

    def _spot(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(31)
        mark = ((k >> np.uint64(48)).astype(np.int64) % 65535) + 1
        one = (k & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return mark, one, one ^ self._step(mark)

    def _step(self, mark: np.ndarray | int) -> np.ndarray | int:
        """What takes a mark from either of its buckets to the other; never nothing."""
        return ((mark * 0x5BD1E995) & ((1 << self.bits) - 1)) | 1

    def insert(self, keys: np.ndarray) -> None:
        mark, one, two = self._spot(np.asarray(keys))
        left = np.arange(len(mark))
        for at in (one, two):
            # All that find a free slot in this bucket of theirs, at once.
            left = left[np.argsort(at[left], kind="stable")]
            bucket = at[left]
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            nth = np.arange(len(bucket)) - np.repeat(begin, np.diff(np.r_[begin, len(bucket)]))
            taken = self.table[bucket] != 0
            ok = nth < SLOTS - taken.sum(axis=1)
            slot = np.argsort(taken[ok], axis=1, kind="stable")[np.arange(int(ok.sum())), nth[ok]]
            self.table[bucket[ok], slot] = mark[left[ok]]
            left = left[~ok]
        for m, a, b in zip(*(x[left].tolist() for x in (mark, one, two)), strict=True):
            self._put(m, a, b)

    def _put(self, mark: int, one: int, two: int) -> None:
        table = self.table
        for at in (one, two):
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = mark
                return
        at = one
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, table[at, slot] = int(table[at, slot]), mark
            at ^= self._step(mark)
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = mark
                return
        pair = (mark, min(at, at ^ self._step(mark)))
        self.over[pair] = self.over.get(pair, 0) + 1

    def delete(self, keys: np.ndarray) -> None:
        """Keys must have been inserted."""
        for mark, one, two in zip(*(x.tolist() for x in self._spot(np.asarray(keys))), strict=True):
            pair = (mark, min(one, two))
            if self.over.get(pair):
                self.over[pair] -= 1
                continue
            for at in (one, two):
                found = np.flatnonzero(self.table[at] == mark)
                if len(found):
                    self.table[at, found[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._spot(np.asarray(keys))
        out = ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)
        live = [k for k, n in self.over.items() if n]
        if live:
            low = np.minimum(one, two)
            for m, at in live:
                out |= (mark == m) & (low == at)
        return out

    def dump(self) -> bytes:
        over = np.array([(*k, n) for k, n in self.over.items() if n], np.int64).reshape(-1, 3)
        return self.bits.to_bytes(1, "little") + self.table.tobytes() + over.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls(1)
        out.bits = data[0]
        end = 1 + (1 << out.bits) * SLOTS * 2
        out.table = np.frombuffer(data[1:end], np.uint16).reshape(-1, SLOTS).copy()
        out.over = {(int(m), int(a)): int(n) for m, a, n in np.frombuffer(data[end:], np.int64).reshape(-1, 3)}
        return out


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).translate(LOWER)


def long_key(key: bytes, shortest: int) -> bool:
    return len(key) >= shortest and (len(key) >= 4 * shortest or len(key.decode("utf-8", "replace")) >= shortest)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys(shortest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, of, h1, h2) for each row's distinct keys of at least shortest code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                counts, digests = [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    keys = {k for line in (text or b"").split(b"\n") if long_key(k := line_key(line), shortest)}
                    counts.append(len(keys))
                    digests += map(_digest, sorted(keys))
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                row = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(row), part.column("of").take(row), pa.array(both[:, 0]), pa.array(both[:, 1])],
                    ["id", "of", "h1", "h2"],
                )

    return run


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("h1"), F.lit(shards)).cast("int").alias("shard")


def _fill(key: tuple[int], own: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter(len(own))
    made.insert(np.sort(own["h1"].to_numpy()).view(np.uint64))
    return pd.DataFrame({"shard": [key[0]], "filter": [made.dump()]})


def _refill(key: tuple[int], had: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter.load(had["filter"][0]) if len(had) else CuckooFilter(len(change))
    for sign, act in ((-1, made.delete), (1, made.insert)):
        act(np.sort(change["h1"][change["sign"] == sign].to_numpy()).view(np.uint64))
    return pd.DataFrame({"shard": [key[0]], "filter": [made.dump()]})


def _asked(made: CuckooFilter | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    if made is None:
        return batch.slice(0, 0)
    return batch.filter(pa.array(made.contains(batch.column("h1").to_numpy().view(np.uint64))))


_KEY = ["h1", "h2"]


@dataclass
class LineLedger:
    """What is known of all documents' lines.

    refs (id, of, h1, h2) has the keys that each row holds, of being a hash of its text; counts (h1, h2, refs, holder) the
    exact counts of all keys: how many ids hold one, and the largest of them; filters (shard, filter) a cuckoo filter over
    each shard's keys that at least `repeats` documents hold. written has the counts and filters that the last change
    wrote. All are read from staged tables.
    """

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    shortest: int
    repeats: int
    changes: int = 0
    written: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def build(
        cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS,
        shards: int | None = None,
    ) -> LineLedger:
        """Of all rows of docs; an empty table makes an empty ledger."""
        refs = stage(_refs(docs, id_col, text_col, shortest), "line-refs")
        shards = shards or shuffle_partitions(docs.sparkSession)
        counts = stage(_counts(refs), "line-counts")
        known = counts.where(F.col("refs") >= repeats).select("h1", _shard(shards))
        filters = stage(known.groupBy("shard").applyInPandas(_fill, "shard int, filter binary"), "filters")
        return cls(refs, counts, filters, shards, shortest, repeats, 0, (counts, filters))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineLedger:
        """With further documents. What an id in the ledger holds already isn't counted again."""
        more = stage(_refs(docs, id_col, text_col, self.shortest), "line-refs")
        had = self.refs.join(more.select("id").distinct(), "id", "left_semi").select("id", *_KEY)
        new = _counts(more.join(had, ["id", *_KEY], "left_anti"))
        new = new.select(*_KEY, F.col("refs").alias("by"), F.col("holder").alias("top"))
        old = self.counts.join(new.select(*_KEY), _KEY, "left_semi").withColumnRenamed("refs", "was")
        now = new.join(old, _KEY, "left").withColumn("was", F.coalesce("was", F.lit(0)))
        now = now.select(*_KEY, "was", (F.col("was") + F.col("by")).alias("refs"), F.greatest("holder", "top").alias("holder"))
        return self._with(self.refs.unionByName(more), now)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineLedger:
        """Without some documents, as if they had never been inserted. Ids that aren't there and null ids do nothing."""
        ids = stage(ids.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct(), "line-ids")
        went = _counts(self.refs.join(ids, "id", "left_semi")).select(*_KEY, F.col("refs").alias("by"))
        went = stage(went, "line-changes")
        refs = self.refs.join(ids, "id", "left_anti")
        old = self.counts.join(went.select(*_KEY), _KEY, "left_semi").select(*_KEY, F.col("refs").alias("was"))
        left = _counts(refs.join(went.select(*_KEY), _KEY, "left_semi")).select(*_KEY, "holder")
        now = went.join(old, _KEY).join(left, _KEY, "left").select(*_KEY, "was", (F.col("was") - F.col("by")).alias("refs"), "holder")
        return self._with(refs, now)

    def _with(self, refs: DataFrame, now: DataFrame) -> LineLedger:
        """The ledger with refs, and now (h1, h2, was, refs, holder) for the keys whose counts changed."""
        now = stage(now, "line-counts")
        sign = (F.col("refs") >= self.repeats).cast("int") - (F.col("was") >= self.repeats).cast("int")
        change = stage(now.select("h1", sign.alias("sign"), _shard(self.shards)).where("sign <> 0"), "line-changes")
        shards = change.select("shard").distinct()
        touched = self.filters.join(shards, "shard", "left_semi")
        made = touched.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(_refill, "shard int, filter binary")
        made = stage(made, "filters")
        filters = self.filters.join(shards, "shard", "left_anti").unionByName(made)
        changed = now.where("refs > 0").select(*_KEY, "refs", "holder")
        counts = self.counts.join(now.select(*_KEY), _KEY, "left_anti").unionByName(changed)
        out = LineLedger(refs, counts, filters, self.shards, self.shortest, self.repeats, self.changes + 1, (now, made))
        return out.compact() if out.changes >= COMPACT else out

    def compact(self) -> LineLedger:
        """The same, its tables written anew as one each."""
        tables = (stage(self.refs, "line-refs"), stage(self.counts, "line-counts"), stage(self.filters, "filters"))
        return LineLedger(*tables, self.shards, self.shortest, self.repeats, 0, self.written)

    def maybe_repeated(self, total: int | None = None) -> DataFrame:
        """Those of refs that their shard's filter knows: all repeated ones, and few others.

        The lines of a shard meet its filter in one task; a shard with more than half an even share of all lines is dealt
        to more tasks by the lines' texts, each with the filter. What is broadcast is a number for each shard. total: the
        rows of refs, if they are counted already.
        """
        total = self.refs.count() if total is None else total
        keys = self.refs.withColumn("shard", _shard(self.shards))
        sizes = keys.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.select("shard", F.ceil(2 * self.shards * F.col("n") / F.lit(max(1, total))).cast("int").alias("salts"))
        sizes = stage(sizes, "shard-sizes")

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, of = None, None
            for batch in batches:
                place = np.stack([batch.column(c).to_numpy() for c in ("shard", "salt")], axis=1)
                begins = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)]) if len(place) else []
                for begin, end in zip(begins, np.r_[begins[1:], len(place)].astype(int), strict=True):
                    if (now := tuple(place[begin])) != of:
                        made, of = None, now
                    own = batch.slice(begin, end - begin)
                    if own.column("filter")[0].is_valid:
                        made = CuckooFilter.load(own.column("filter")[0].as_py())
                        own = own.slice(1)
                    yield _asked(made, own).select(["id", "of", *_KEY])

        salt = F.pmod(F.xxhash64("of", "id"), F.col("salts")).cast("int")
        dealt = keys.join(F.broadcast(sizes), "shard").withColumn("salt", salt).withColumn("filter", F.lit(None).cast("binary"))
        each = self.filters.join(F.broadcast(sizes), "shard")
        each = each.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "filter")
        dealt = dealt.drop("salts").unionByName(each, allowMissingColumns=True).repartition("shard", "salt")
        ordered = dealt.sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        return ordered.mapInArrow(ask, "id long, of long, h1 long, h2 long")

    def drops(self) -> DataFrame:
        """(id, of, h1, h2) of the lines that go: repeated ones, but in their holder."""
        lines, total = self.counts.where(F.col("refs") >= self.repeats), self.refs.count()
        held = join_hot(self.maybe_repeated(total), lines, _KEY, "refs", total, F.struct("id", "of"))
        return held.where("id is null or id <> holder").select("id", "of", *_KEY)


def _refs(docs: DataFrame, id_col: str, text_col: str, shortest: int) -> DataFrame:
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("of"), text.alias("text"))
    return slim.mapInArrow(_keys(shortest), "id long, of long, h1 long, h2 long")


def _counts(refs: DataFrame) -> DataFrame:
    """Counts of documents, not of rows: a row that repeats a document's id and line doesn't count again."""
    each = refs.where("id is not null").select("id", *_KEY).distinct()
    return each.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("refs"), F.max("id").alias("holder"))


def _dropping(shortest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                texts, kept, lines, dropped = part.column("text").cast(pa.binary()).to_pylist(), [], [], []
                for text, gone in zip(texts, part.column("gone").to_pylist(), strict=True):
                    own = (text or b"").split(b"\n")
                    left = own
                    if gone:
                        gone = set(zip(*(np.array([g[c] for g in gone]).tolist() for c in ("h1", "h2")), strict=True))
                        left = []
                        for line in own:
                            if not long_key(key := line_key(line), shortest) or _pair(key) not in gone:
                                left.append(line)
                    kept.append(b"\n".join(left))
                    lines.append(len(own))
                    dropped.append(len(own) - len(left))
                columns = {c: part.column(c) for c in part.schema.names if c not in ("text", "gone")}
                columns |= {"text": pa.array(kept, pa.binary()).cast(pa.string()), "lines": pa.array(lines, pa.int64()), "dropped": pa.array(dropped, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _pair(key: bytes) -> tuple[int, int]:
    d = _digest(key)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS,
    ledger: LineLedger | None = None, n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """docs with text_col less its repeated lines, and the columns n_lines (before) and n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at least shortest
    code points that at least repeats documents hold go, with all their lines, but for those of the largest id that
    holds them. A null or empty text is one empty line. Rows that repeat an id are one document in the counts, and each
    loses the lines that go. A row with a null id counts for none and never holds a line. A very long text is held whole
    by one task; what is told to it is at most its own lines. An empty table stays empty. ledger: one made before, of
    these documents and others. Columns of docs named like the new ones are replaced.
    """
    ledger = ledger or LineLedger.build(docs, id_col, text_col, shortest, repeats)
    gone = ledger.drops().groupBy("id", "of").agg(F.collect_set(F.struct(*_KEY)).alias("gone"))
    rest = [c for c in docs.columns if c not in (text_col, n_lines, n_dropped)]
    text = F.col(text_col).cast("string")
    packed = docs.select(F.col(id_col).cast("long").alias("own"), F.xxhash64(text).alias("own_of"), text.alias("text"), F.struct(*rest).alias("rest"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("own_of") == F.col("of"))
    joined = packed.join(gone, same, "left").select("text", "rest", "gone")
    schema = f"rest {joined.schema['rest'].dataType.simpleString()}, text string, lines long, dropped long"
    out = joined.mapInArrow(_dropping(ledger.shortest), schema)
    named = {c: F.col("rest").getField(c).alias(c) for c in rest} | {text_col: F.col("text").alias(text_col)}
    order = [c for c in docs.columns if c in named]
    return out.select(*(named[c] for c in order), F.col("lines").alias(n_lines), F.col("dropped").alias(n_dropped))
