"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of WINDOW words (a shorter item is one window). A window's shingles are ordered by how
many documents hold them. Containment asks for all of a window's shingles, so its necessary prefix is the rarest one
alone: a document without that shingle can't hold the window. Where a document has the prefix shingle, its position in
the window tells where the window would begin (positional bound) and end (length bound); the words there are compared.

The index has one row per window of the benchmark. It is made in slices of at most SLICE_WORDS words, each sent to all
tasks, so what is sent has a bound whatever the benchmark's size; documents aren't shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._common import byte_slices, coded, mapped_bytes, rest_of, split_words, starts_of

WINDOW = 13
SHINGLE = 5
#: Characters, and so words at most, of the benchmark in one slice of the index.
SLICE_WORDS = 4_000_000
#: A-Z lower-cased; ASCII other than letters and digits becomes a space.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_ODD = np.random.default_rng(13).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return split_words(mapped_bytes(texts, _TABLE))


def _rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width word numbers from each place on; places within width of the end wrap and are invalid."""
    h = np.zeros(len(ids), np.uint64)
    u = ids.astype(np.uint64) + np.uint64(1)
    for j in range(width):
        h += np.roll(u, -j) * _ODD[j]
    h ^= h >> np.uint64(29)
    return h * _ODD[40]


@dataclass
class _Lookup:
    """Windows of one length: their words, items and prefix shingles."""

    length: int
    width: int
    windows: np.ndarray
    items: list[list[str]]
    prefix: np.ndarray
    offset: np.ndarray


class _Index:
    """The windows of a slice of the benchmark, by length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[str, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        words, counts = _words(pa.array([t for _, t in items], pa.string()))
        words = words.to_pylist()
        for (item, _), begin, n in zip(items, starts_of(counts).tolist(), counts.tolist(), strict=True):
            own = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words[begin : begin + n]]
            size = min(n, window)
            for k in range(n - size + 1) if n else ():
                by_length.setdefault(size, {}).setdefault(tuple(own[k : k + size]), set()).add(item)
        self.lookups = []
        for length, found in sorted(by_length.items()):
            windows = np.array(sorted(found), np.int64).reshape(len(found), length)
            names = [sorted(found[tuple(w)]) for w in windows.tolist()]
            none = np.zeros(len(found), np.uint64)
            self.lookups.append(_Lookup(length, min(SHINGLE, length), windows, names, none, none.astype(np.int64)))

    def shingles(self, lookup: _Lookup) -> np.ndarray:
        """(windows, places) hashes of each window's shingles."""
        places = lookup.length - lookup.width + 1
        flat = np.concatenate([lookup.windows.ravel(), np.zeros(lookup.width, np.int64)])
        h = _rolled(flat, lookup.width)[: lookup.windows.size].reshape(lookup.windows.shape)
        return h[:, :places]

    def all_shingles(self) -> dict[int, np.ndarray]:
        """Distinct shingle hashes by shingle width."""
        by: dict[int, list[np.ndarray]] = {}
        for x in self.lookups:
            by.setdefault(x.width, []).append(self.shingles(x).ravel())
        return {k: np.unique(np.concatenate(v)) for k, v in by.items()}

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's prefix: the shingle that the fewest documents hold (ties: the lesser hash)."""
        for x in self.lookups:
            h = self.shingles(x)
            held = np.array([counts.get((x.width, int(v)), 0) for v in h.view(np.int64).ravel()]).reshape(h.shape)
            x.offset = np.lexsort((h, held), axis=1)[:, 0] if h.shape[1] > 1 else np.zeros(len(h), np.int64)
            prefix = h[np.arange(len(h)), x.offset]
            by = np.argsort(prefix, kind="stable")
            x.prefix, x.offset, x.windows = prefix[by], x.offset[by], x.windows[by]
            x.items = [x.items[i] for i in by.tolist()]

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number in the vocabulary (-1: not there), and the texts' word counts."""
        words, counts = _words(texts)
        codes, distinct = coded(words)
        get = self.vocabulary.get
        known = np.fromiter((get(w, -1) for w in distinct.to_pylist()), np.int64, len(distinct))
        return (known[codes] if len(codes) else np.zeros(0, np.int64)), counts


def _runs(ids: np.ndarray) -> np.ndarray:
    """How many words of the vocabulary stand in a row from each place on."""
    out = np.flatnonzero(ids < 0)
    ends = np.append(out, len(ids))
    return ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))


def _counting(index: _Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = index.all_shingles()
        totals = {w: np.zeros(len(v), np.int64) for w, v in wanted.items()}
        for batch in batches:
            for part in byte_slices(batch, "text"):
                ids, counts = index.numbered(part.column("text"))
                if not len(ids):
                    continue
                doc, left = np.repeat(np.arange(len(counts)), counts), _runs(ids)
                rest = np.repeat(starts_of(counts) + counts, counts) - np.arange(len(ids))
                for width, hashes in wanted.items():
                    at = np.flatnonzero((left >= width) & (rest >= width))
                    h = _rolled(ids, width)[at]
                    spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    ok = hashes[spot] == h
                    seen = np.unique(doc[at[ok]] * len(hashes) + spot[ok])
                    totals[width] += np.bincount(seen % len(hashes), minlength=len(hashes))
        for width, hashes in wanted.items():
            some = totals[width] > 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(int(some.sum()), width, np.int32)),
                    pa.array(hashes[some].view(np.int64)),
                    pa.array(totals[width][some]),
                ],
                ["width", "shingle", "n"],
            )

    return run


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint spans, as begin, end, begin, end ..."""
    out: list[int] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def _probing(index: _Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds what index has to each row's hits: spans of hit words, and items."""

    def hits(texts: pa.Array) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        ids, counts = index.numbered(texts)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        if not len(ids):
            return counts, spans, items
        starts, left = starts_of(counts), _runs(ids)
        doc = np.repeat(np.arange(len(counts)), counts)
        ends = starts + counts
        for x in index.lookups:
            at = np.flatnonzero(left >= x.width)
            h = _rolled(ids, x.width)[at]
            first = np.searchsorted(x.prefix, h, "left")
            n = np.searchsorted(x.prefix, h, "right") - first
            at, first, n = at[n > 0], first[n > 0], n[n > 0]
            window = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(starts_of(n), n)
            at = np.repeat(at, n)
            begin = at - x.offset[window]
            d = doc[at]
            ok = (begin >= starts[d]) & (begin + x.length <= ends[d])
            begin, window, d = begin[ok], window[ok], d[ok]
            same = np.ones(len(begin), bool)
            for j in range(x.length):
                same[same] &= ids[begin[same] + j] == x.windows[window[same], j]
            for b, w, k in zip(begin[same].tolist(), window[same].tolist(), d[same].tolist(), strict=True):
                spans.setdefault(k, []).append((b - int(starts[k]), b - int(starts[k]) + x.length))
                items.setdefault(k, set()).update(x.items[w])
        return counts, spans, items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                counts, spans, items = hits(part.column("text"))
                had = part.column("spans").to_pylist(), part.column("items").to_pylist()
                for k, own in spans.items():
                    had[0][k] = _merged([*own, *zip(had[0][k][::2], had[0][k][1::2], strict=True)])
                    had[1][k] = sorted({*had[1][k], *items[k]})
                columns = {c: part.column(c) for c in part.schema.names}
                columns |= {
                    "n_words": pa.array(counts),
                    "spans": pa.array(had[0], pa.list_(pa.int32())),
                    "items": pa.array(had[1], pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, slice_words: int = SLICE_WORDS, keep: bool = False,
) -> DataFrame:
    """(doc_id, n_words, spans, items) for each row of docs; with keep, all columns of docs and the last three, which
    replace columns of the same names.

    Words are runs of non-ASCII characters, ASCII letters and digits, with A-Z lower-cased. spans has the hit words as
    begin, end, begin, end ..., by word number, end exclusive; items the distinct ids, as strings in order, of items of
    which a window occurs. A null or empty text has no words and no hits; neither has an item without words. Items that
    repeat an id count as one; an item with a null id is the item "". Rows that repeat a doc_id are judged each. An empty
    table of documents gives no rows, one of items no hits. A very long text is judged whole by one task.

    The driver collects the items of one slice at a time, slice_words characters or one longer item, and the counts of
    their shingles; for each slice the documents are read once to count and once to look. Time grows so with slices
    times documents: right for benchmarks, which are small, and not for joining two corpora.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")
    )
    names = [c for c in docs.columns if c not in ("n_words", "spans", "items")] if keep else [id_col]
    rest = rest_of(docs, text_col, names)
    out = docs.select(F.struct(*rest).alias("rest"), F.col(text_col).cast("string").alias("text")).select(
        "rest", "text", F.lit(0).cast("long").alias("n_words"), F.lit([]).cast("array<int>").alias("spans"),
        F.lit([]).cast("array<string>").alias("items"),
    )
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    schema = out.schema
    # A word has one character at least, so an item's characters bound its words.
    bound = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-int(bound) // slice_words))
    for k in range(slices):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == k).distinct().collect()
        index = _Index([(r.item, r.text) for r in own], window)
        counted = texts.mapInArrow(_counting(index), "width int, shingle long, n long")
        held = counted.groupBy("width", "shingle").agg(F.sum("n").alias("n")).collect()
        index.order({(r.width, r.shingle): r.n for r in held})
        out = out.mapInArrow(_probing(index), schema)
    own = {c: F.col("rest").getField(c) if c in rest else F.col("text") for c in names}
    return out.select(*(v.alias(c) for c, v in own.items()), "n_words", "spans", "items")


def contamination(hits: DataFrame, id_col: str = "doc_id", one_in: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from benchmark_hits: contaminated if at least one
    word is hit, and one in one_in."""
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return hits.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))
