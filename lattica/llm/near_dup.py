"""MinHash near-dedup with odd sketches.

Each text becomes its set of word shingles. MinHash samples of the set give band keys, and the same samples folded into
a parity bitmap give an odd sketch (Mitzenmacher, Pagh, Pham 2014): the population count of two sketches' XOR estimates
their similarity. Texts that share a band and whose sketches allow the threshold make up a group; within a group the
links are confirmed on full sets.

Rows of a large band or group are dealt to blocks, each of which meets the least id of all first. Rows that are linked
to that one, there or by way of other bands, need no other. If the rest is no more than a block, it meets all blocks. A larger
one, and what may be linked to it, is dealt anew by the bands of further permutations, as LSH forests do (Bawa, Condie,
Ganesan 2005): rows at the threshold share one of them as surely as before, others seldom. What is still in too large a
band after LEVELS times meets all blocks too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._common import (
    LOWER,
    byte_slices,
    coded,
    connected_components,
    group_chunks,
    join_hot,
    mapped_bytes,
    shuffle_partitions,
    split_words,
    stage,
    starts_of,
    unstage,
)

WIDTH = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Largest XOR count that goes on to the full sets: what sets of similarity 0.5 show on average, over five standard
#: deviations below the threshold of 0.75.
SKETCH_MOST = int(SKETCH_BITS / 2 * (1 - np.exp(-2 * SAMPLES * (1 - 0.5) * 2 / SKETCH_BITS)))
#: Rows of a band, whose sketches one task compares at once, and shingles of a group, whose sets it does.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 4_000_000
#: Times that a large band's rows are dealt anew by further bands.
LEVELS = 3

_random = np.random.default_rng(0x5EED)
_ODD64 = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = (_random.integers(0, 2**31, SAMPLES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _random.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles, ascending within a text, and each text's count.

    Words are runs of other than ASCII white space, with A-Z lower-cased. A text of fewer than width words, but not
    none, is one shingle.
    """
    words, counts = split_words(mapped_bytes(texts, LOWER))
    codes, distinct = coded(words)
    by_word = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
    hashes = np.concatenate([by_word[codes], np.zeros(width, np.uint64)])
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), many)
    at = starts_of(counts)[text] + np.arange(len(text)) - starts_of(many)[text]
    short = bool((counts < width).any())
    h = np.zeros(len(text), np.uint64)
    for j in range(width):
        part = hashes[at + j] * _ODD64[j]
        h += np.where(counts[text] > j, part, np.uint64(0)) if short else part
    if short:
        h += np.minimum(counts[text], width).astype(np.uint64) * _ODD64[width]
    h = _mix(h)
    ends = np.cumsum(many)
    for begin, end in zip((ends - many).tolist(), ends.tolist(), strict=True):
        h[begin:end].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(counts)).astype(np.int64)


def minhash(h: np.ndarray, counts: np.ndarray, level: int = 0) -> np.ndarray:
    """(texts with shingles, SAMPLES) least values under as many permutations of the hashes' upper halves; each level has
    permutations of its own."""
    begin = starts_of(counts)[counts > 0]
    if level:
        h = _mix(h * _ODD64[50] + np.uint64(level))
    upper = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), SAMPLES), np.uint32)
    for j in range(SAMPLES):
        out[:, j] = np.minimum.reduceat(upper * _MUL[j] + _ADD[j], begin) if len(begin) else 0
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for r in range(ROWS):
        keys += samples[:, r::ROWS].astype(np.uint64) * _ODD64[10 + r]
    return _mix(keys + np.arange(BANDS, dtype=np.uint64) * _ODD64[20]).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_BITS / 8) bytes: the parity of how many (permutation, least value) pairs fall on each bit."""
    n = len(samples)
    bit = _mix(samples.astype(np.uint64) * _ODD64[30] + np.arange(SAMPLES, dtype=np.uint64) * _ODD64[31])
    bit = (bit % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS
    parity = np.bincount(bit.ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(parity.reshape(n, SKETCH_BITS).astype(np.uint8), axis=1)


def sketch_similarity(xor_count: np.ndarray) -> np.ndarray:
    """The similarity that a XOR population count of two odd sketches stands for."""
    z = np.minimum(np.asarray(xor_count, float), SKETCH_BITS / 2 - 1)
    apart = -SKETCH_BITS / 2 * np.log(1 - 2 * z / SKETCH_BITS)
    return np.clip(1 - apart / (2 * SAMPLES), 0, 1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_slices(batch, "text"):
            h, counts = shingle_hashes(part.column("text"))
            some = counts > 0
            begin = starts_of(counts)[some]
            digests = []
            for k in (40, 41):
                d = np.zeros(len(counts), np.uint64)
                if len(begin):
                    d[some] = np.add.reduceat(_mix(h * _ODD64[k]), begin)
                digests.append(d.view(np.int64))
            samples = minhash(h, counts)
            bands, sketches = band_keys(samples), odd_sketch(samples)
            size = np.where(some, BANDS, 0)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            spots = np.concatenate([[0], np.cumsum(np.where(some, SKETCH_BITS // 8, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(counts),
                    pa.array(digests[0]),
                    pa.array(digests[1]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel())),
                    pa.Array.from_buffers(
                        pa.binary(), len(counts), [None, pa.py_buffer(spots), pa.py_buffer(sketches.tobytes())]
                    ),
                ],
                ["id", "n", "d1", "d2", "bands", "sketch"],
            )


def _banded(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, bands) of texts with shingles, by the permutations of a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                h, counts = shingle_hashes(part.column("text"))
                bands = band_keys(minhash(h, counts, level))
                ids = part.column("id").filter(pa.array(counts > 0))
                offsets = pa.array(np.arange(len(ids) + 1) * BANDS, pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))], ["id", "bands"])

    return run


class _BySketch:
    """Which rows of a chunk may reach the threshold, as their sizes and sketches go."""

    columns = ("n", "sketch")

    def __init__(self, chunk: pa.Table, percent: int):
        self.percent = percent
        self.n = chunk.column("n").to_numpy()
        data = b"".join(chunk.column("sketch").to_pylist())
        self.bits = np.frombuffer(data, np.uint64).reshape(len(self.n), SKETCH_BITS // 64)

    def near(self, u: int, others: np.ndarray) -> np.ndarray:
        return self.paired(np.full(len(others), u), others)

    def paired(self, us: np.ndarray, vs: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(self.bits[us] ^ self.bits[vs]).sum(axis=1)
        small, large = np.minimum(self.n[us], self.n[vs]), np.maximum(self.n[us], self.n[vs])
        return (apart <= SKETCH_MOST) & (100 * small >= self.percent * large)


class _BySet(_BySketch):
    """Which rows of a chunk do reach the threshold: those that the sketches allow, counted on full sets."""

    columns = ("n", "sketch", "text")

    def __init__(self, chunk: pa.Table, percent: int):
        super().__init__(chunk, percent)
        sets = []
        for batch in chunk.select(["text"]).to_batches():
            for part in byte_slices(batch, "text"):
                h, counts = shingle_hashes(part.column("text"))
                sets += np.split(h, np.cumsum(counts)[:-1])
        self.sets = sets

    def near(self, u: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        maybe = np.flatnonzero(super().paired(np.full(len(others), u), others))
        own = self.sets[u]
        for part in np.array_split(maybe, max(1, len(maybe) // 512)):
            if not len(part):
                continue
            sets = [self.sets[i] for i in others[part]]
            lengths = np.array([len(x) for x in sets])
            flat = np.concatenate(sets)
            found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            shared = np.add.reduceat(found.astype(np.int64), starts_of(lengths))
            out[part] = 100 * shared >= self.percent * (len(own) + lengths - shared)
        return out

    def paired(self, us: np.ndarray, vs: np.ndarray) -> np.ndarray:
        return np.array([self.near(u, np.array([v]))[0] for u, v in zip(us, vs, strict=True)], bool)


def _searched(judge: type[_BySketch], percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Within each (key, block): a star of edges for each component; the least id of the key is searched from first.

    A row outside that first component, in a key of several blocks, is also given with b null, as it may be linked in
    other blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, begins in group_chunks(batches, ["key", "block"]):
            ids, hubs, blocks = (chunk.column(c).to_numpy() for c in ("id", "hub", "blocks"))
            keys = chunk.column("key").to_numpy()
            judged = judge(chunk, percent)
            ends = np.append(begins[1:], chunk.num_rows)
            two = begins[(ends - begins == 2) & (blocks[begins] == 1)]
            two = two[judged.paired(two, two + 1)]
            pair = np.stack([ids[two], ids[two + 1]])
            pair.sort(axis=0)
            out: list[tuple[int, int, int | None]] = list(zip(keys[two].tolist(), pair[1].tolist(), pair[0].tolist(), strict=True))
            rest = (ends - begins > 2) | (blocks[begins] > 1)
            for begin, end in zip(begins[rest].tolist(), ends[rest].tolist(), strict=True):
                rows = np.arange(begin, end)
                several = blocks[begin] > 1
                rows = rows[np.argsort(ids[rows] != hubs[begin], kind="stable")]
                first = True
                while len(rows):
                    root, rows = rows[0], rows[1:]
                    todo, members = [root], [root]
                    while todo and len(rows):
                        near = judged.near(todo.pop(), rows)
                        if near.any():
                            todo += rows[near].tolist()
                            members += rows[near].tolist()
                            rows = rows[~near]
                    low = min(ids[members])
                    out += [(keys[begin], ids[m], low) for m in members if ids[m] != low]
                    if several and not first:
                        out += [(keys[begin], ids[m], None) for m in members]
                    first = False
                    if not several and len(rows) == 1:
                        break
            if out:
                k, a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"]
                )

    return run


@dataclass
class _Links:
    """Finds the links within each key of members (key, id, weight, open): payload (id, ...) has what judge reads, texts
    (id, text) what further bands are made from, first the bands of level 1 if there are some already. limit is the weight
    that one task compares at once. staged gets the tables that nothing reads once the links are used."""

    payload: DataFrame
    texts: DataFrame
    judge: type[_BySketch]
    percent: int
    limit: int
    first: DataFrame | None
    staged: list[DataFrame]
    #: The components of all edges found, where the search has made them already.
    parts: DataFrame | None = None

    def components(self, members: DataFrame) -> DataFrame:
        """(id, component) of the links within each key."""
        edges = self.edges(members)
        if self.parts is None:
            self.parts = connected_components(edges)
            self.staged.append(self.parts)
        return self.parts

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        self.staged.append(stage(df, name))
        return self.staged[-1]

    def _search(self, rows: DataFrame) -> DataFrame:
        rows = rows.join(self.payload, "id").select("key", "block", "id", "hub", "blocks", *self.judge.columns)
        rows = rows.repartition(shuffle_partitions(rows.sparkSession), "key", "block")
        rows = rows.sortWithinPartitions("key", "block", "id")
        return rows.mapInArrow(_searched(self.judge, self.percent), "key long, a long, b long")

    def edges(self, members: DataFrame, level: int = 0, known: DataFrame | None = None) -> DataFrame:
        """(a, b) so that their components are those of known and of all links within a key with an open row, one in open.

        A key of more weight than limit is dealt out to blocks, each with the key's least id. What that id's component
        doesn't hold, over the links of all keys and of known, meets all the key's blocks if it is no more than one of them,
        or after LEVELS; else it is open on the next level, where all the key's rows are dealt to keys by further bands. What
        is known by then is one edge for each row, to the least of its component.
        """
        # The rows that aren't open are in one component already, so the least of them stands for all.
        hub = F.min(F.struct("open", "id"))["id"].alias("hub")
        totals = members.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("sum"), hub, F.max("open").alias("any"))
        blocks = F.ceil(F.col("sum") / self.limit).alias("blocks")
        totals = totals.where("rows > 1 and any").select("key", "hub", F.col("rows").alias("copies"), blocks)
        block = F.pmod(F.xxhash64("id", "key"), F.col("blocks"))
        placed = join_hot(members, totals, ["key"], "copies", members.count(), F.col("id"))
        placed = self._stage(placed.select("key", "id", "weight", "hub", "blocks", block.alias("block")), "placed")
        everywhere = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        found = self._stage(self._search(placed.withColumn("block", F.explode(F.coalesce(everywhere, F.array("block"))))), "links")
        edges = found.where("b is not null").select("a", "b")
        edges = edges if known is None else known.unionAll(edges)
        rest = found.where("b is null").select("key", F.col("a").alias("id")).distinct()
        if rest.isEmpty():
            return edges
        self.parts = parts = connected_components(edges)
        self.staged.append(parts)
        of = lambda id_, name: parts.select(F.col("id").alias(id_), F.col("component").alias(name))
        rest = rest.join(placed.drop("block"), ["key", "id"])
        rest = rest.join(of("id", "own"), "id", "left").join(of("hub", "first"), "hub", "left")
        rest = rest.where(F.coalesce("own", "id") != F.coalesce("first", "hub"))
        rest = self._stage(rest.select("key", "id", "weight", "hub", "blocks"), "rest")
        known = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
        if rest.isEmpty():
            return known
        self.parts = None
        sizes = rest.groupBy("key", "hub", "blocks").agg(F.ceil(F.sum("weight") / self.limit).alias("parts"))
        sizes = self._stage(sizes, "sizes")
        rest, many = rest.select("key", "id").distinct(), sizes.where("parts > 1")
        if level == LEVELS or many.isEmpty():
            return known.unionAll(self._everywhere(placed, rest, sizes))
        known = known.unionAll(self._everywhere(placed, rest, sizes.where("parts = 1")))
        return self._anew(placed, rest.join(many, "key", "left_semi"), level + 1, known)

    def _anew(self, placed: DataFrame, rest: DataFrame, level: int, known: DataFrame) -> DataFrame:
        """Known links and those of rest with its keys' rows, by the bands of a level."""
        own = placed.join(rest.select("key").distinct(), "key", "left_semi").select("key", "id", "weight")
        own = self._stage(own.join(rest.withColumn("open", F.lit(True)), ["key", "id"], "left"), "members")
        bands = self.first
        if bands is None or level > 1:
            bands = self.texts.join(own.select("id").distinct(), "id", "left_semi").mapInArrow(_banded(level), "id long, bands array<long>")
        each = own.join(bands, "id").select("key", "id", "weight", "open", F.explode("bands").alias("band"))
        each = each.select(F.xxhash64("key", "band").alias("key"), "id", "weight", F.coalesce("open", F.lit(False)).alias("open"))
        return self.edges(self._stage(each, "members"), level, known)

    def _everywhere(self, placed: DataFrame, rest: DataFrame, sizes: DataFrame) -> DataFrame:
        """Links of rest with the rows of its keys in sizes: parts of rest meet all blocks."""
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        part = F.pmod(F.xxhash64("key", "id"), F.col("parts")).alias("part")
        own = rest.join(sizes, "key").select("key", "id", "hub", "blocks", "parts", part, each("blocks").alias("other"))
        against = placed.select("key", "id", F.col("block").alias("other")).join(sizes, "key")
        against = against.select("key", "id", "hub", "blocks", "parts", each("parts").alias("part"), "other")
        pairs = own.unionByName(against).withColumn("block", F.col("other") * F.col("parts") + F.col("part"))
        again = self._search(pairs.select("key", "id", "hub", "blocks", "block").distinct())
        return again.where("b is not null").select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, block_rows: int = BLOCK_ROWS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Rows are linked when their shingle sets' similarity is at least percent / 100. component_id is the least id that
    links lead to, the row's own included; kept says that it is the row's own. Two sets at the threshold miss each
    other in all 32 bands of 4 samples with a probability of 5e-6; a found pair is always confirmed on full sets.

    A null, empty or wordless text has no shingles and is linked with nothing. Rows with equal sets are one class, so
    copies are compared once. Rows that repeat an id are given each, and are one document in the links: texts that share
    an id are in one component. A null id never stands for a class that has other ids (alone, its component_id is null
    and kept is true). A very long text's set is held whole by one task. An empty table has no rows. Other columns of docs
    are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stage(
        slim.mapInArrow(_signed, "id long, n long, d1 long, d2 long, bands array<long>, sketch binary"), "signatures"
    )
    keys, staged = ["d1", "d2", "n"], []
    sets = signed.where("n > 0").groupBy(*keys).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies"))
    classes = stage(sets, "sets")
    # Copies of a set have ids of their own, so they meet their class in many tasks.
    firsts = classes.where("class is not null").select(*keys, F.col("class").alias("id"))
    leads = signed.where("n > 0").join(firsts, [*keys, "id"])
    leads = stage(leads.dropDuplicates(["id", "d1", "d2"]).select("id", "n", "bands", "sketch"), "classes")
    members = leads.select(F.explode("bands").alias("key"), "id", F.lit(1).cast("long").alias("weight"), F.lit(True).alias("open"))
    payload, texts = leads.select("id", "n", "sketch"), slim.where("id is not null")
    maybe = _Links(payload, texts, _BySketch, percent, block_rows, None, staged).components(members)
    staged.append(found := stage(maybe, "groups"))
    groups = found.withColumnRenamed("component", "key")
    members = groups.join(leads.select("id", F.col("n").alias("weight")), "id").select("key", "id", "weight", F.lit(True).alias("open"))
    texts = texts.join(groups.select("id"), "id", "left_semi")
    components = _Links(payload.join(texts, "id"), texts, _BySet, percent, block_shingles, leads.select("id", "bands"), staged).components(members)
    told = classes.join(components.withColumnRenamed("id", "class"), "class", "left").select(*keys, "copies", F.coalesce("component", "class").alias("component"))
    told = stage(told, "components")
    unstage(classes, leads, *staged)
    rows = signed.select("id", *keys).where("n > 0")
    out = join_hot(rows, told, keys, "copies", signed.count(), F.col("id")).select("id", "n", "component")
    out = out.unionByName(signed.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
