"""Homomorphic multiset hash of a document's paragraphs.

A fingerprint is a sum of wide vectors, one hashed from each paragraph, so it doesn't depend on the paragraphs' order,
and inserting or deleting a paragraph adds or subtracts its vector. EXACT lanes are uniform and summed modulo 2**64: equal
fingerprints mean equal multisets of paragraphs, as in LtHash (Bellare, Micciancio 1997). The paragraph's phrases are
counted modulo 2**64, and each adds +1 or -1 to one of NEAR lanes modulo 2**32 (a count sketch: Charikar, Chen,
Farach-Colton 2002). The lanes' distances tell how many phrases two documents don't share, and with the counts, which
part of all phrases they share. The paragraphs' separators count as well.

A phrase is a run of words that ends with a paragraph or with a word whose hash is divisible by PHRASE, so phrases are
found again wherever their paragraph is cut or moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm._common import byte_slices, coded, shuffle_partitions, split_words, starts_of

EXACT, NEAR, PHRASE = 16, 4096, 4
#: Documents whose lanes are held at once.
ROWS = 512
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _unshared(per_lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For phrases that fall on the lanes with random signs, so many a lane on average: the share of lanes left at 0,
    and how many phrases there are for each that is seen in the lanes' distance. Signed counts are differences of two
    Poisson variables, whose laws are modified Bessel functions, here as integrals."""
    angle = (np.arange(4000) + 0.5) * np.pi / 4000
    weight = np.exp(per_lane[:, None] * (np.cos(angle) - 1))
    zero, one = weight.mean(axis=1), (weight * np.cos(angle)).mean(axis=1)
    return zero, 1 / (zero + one)


_ZERO, _FACTOR = _unshared(np.concatenate([[0], np.geomspace(1e-4, 1e4, 600)]))


def _phrase_hashes(paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all paragraphs' phrases, and which paragraph each is of."""
    words, counts = split_words(pa.array(paragraphs, pa.string()))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, distinct = coded(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[codes]
    last = h % np.uint64(PHRASE) == 0
    last[(starts_of(counts) + counts - 1)[counts > 0]] = True
    begin = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    powers = np.cumprod(np.full(len(h), _STEP, np.uint64))
    back = np.cumprod(np.full(len(h), _BACK, np.uint64))
    sums = np.add.reduceat((h | np.uint64(1)) * powers, begin) * back[begin]
    sums ^= sums >> np.uint64(31)
    sums *= np.uint64(0xD6E8FEB86659FD93)
    sums ^= sums >> np.uint64(32)
    return sums, np.repeat(np.arange(len(counts)), counts)[begin]


class Fingerprint:
    """The vector sums; + and - join and part multisets of paragraphs."""

    __slots__ = ("exact", "near", "phrases")

    def __init__(self, exact: np.ndarray | None = None, phrases: int = 0, near: np.ndarray | None = None):
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact
        self.phrases = phrases
        self.near = np.zeros(NEAR, np.int32) if near is None else near

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        return cls.of_paragraphs(text.split("\n"))

    @classmethod
    def of_paragraphs(cls, paragraphs: list[str]) -> Fingerprint:
        return cls.of_each([paragraphs])[0]

    @classmethod
    def of_each(cls, groups: list[list[str]]) -> list[Fingerprint]:
        """The fingerprints of several lists of paragraphs."""
        sizes = np.array([len(g) for g in groups], np.int64)
        flat = [p for g in groups for p in g]
        exact = np.zeros((len(groups), EXACT), np.uint64)
        some = sizes > 0
        if some.any():
            digests = b"".join(hashlib.shake_128(p.encode()).digest(8 * EXACT) for p in flat)
            each = np.frombuffer(digests, "<u8").reshape(-1, EXACT)
            exact[some] = np.add.reduceat(each, starts_of(sizes)[some], axis=0, dtype=np.uint64)
        hashes, paragraph = _phrase_hashes(flat)
        group = np.repeat(np.arange(len(groups)), sizes)[paragraph]
        lane = group * NEAR + (hashes % np.uint64(NEAR)).astype(np.int64)
        sign = ((hashes >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
        near = np.bincount(lane, sign, len(groups) * NEAR).astype(np.int64).astype(np.int32).reshape(-1, NEAR)
        phrases = np.bincount(group, minlength=len(groups)).tolist()
        return [cls(*row) for row in zip(exact, phrases, near, strict=True)]

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, (self.phrases + other.phrases) % (1 << 64), self.near + other.near)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, (self.phrases - other.phrases) % (1 << 64), self.near - other.near)

    def __eq__(self, other: object) -> bool:
        same = isinstance(other, Fingerprint) and self.phrases == other.phrases
        return bool(same and (self.exact == other.exact).all() and (self.near == other.near).all())

    __hash__ = None

    def hex(self) -> str:
        """All sums as text: the exact lanes, the count, and (lane, sum) of the near lanes that aren't 0."""
        lanes = np.flatnonzero(self.near)
        told = np.zeros(len(lanes), np.dtype([("lane", "<u2"), ("sum", "<i4")]))
        told["lane"], told["sum"] = lanes, self.near[lanes]
        return self.exact.astype("<u8").tobytes().hex() + self.phrases.to_bytes(8, "little").hex() + told.tobytes().hex()

    @classmethod
    def from_hex(cls, told: str) -> Fingerprint:
        data = bytes.fromhex(told)
        at = 8 * EXACT
        lanes = np.frombuffer(data[at + 8 :], np.dtype([("lane", "<u2"), ("sum", "<i4")]))
        out = cls(np.frombuffer(data[:at], "<u8").copy(), int.from_bytes(data[at : at + 8], "little"))
        out.near[lanes["lane"]] = lanes["sum"]
        return out

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the estimated share of phrases in both of those in either, counted as often as
        they occur. Phrases that cancel on a lane are made up for by the share of lanes that are left at 0."""
        if self == other:
            return 1.0
        all_ = self.phrases + other.phrases
        if not all_:
            return 0.0
        apart = self.near - other.near
        zero = 1 - np.count_nonzero(apart) / NEAR
        unshared = float(np.abs(apart.astype(np.int64)).sum() * np.interp(zero, _ZERO[::-1], _FACTOR[::-1]))
        return float(min(1.0, max(0.0, (all_ - unshared) / (all_ + unshared))))


def edited(text: str, other: str) -> str:
    """text with its last half (rounded down) replaced by the first as many characters of other, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _tails(text: str, other: str) -> tuple[list[str], list[str]]:
    """The paragraphs that an edit takes from text, and those that it puts in their place."""
    half = len(text) // 2
    kept = len(text) - half
    at = text.rfind("\n", 0, kept) + 1
    return text[at:].split("\n"), (text[at:kept] + other[:half]).split("\n")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each but a block's guest is compared with the row after it. An edited text's fingerprint is its
    text's, less the paragraphs that go and with those that come."""
    had: list[tuple] = []
    for batch in batches:
        for some in byte_slices(batch, "text"):
            for begin in range(0, some.num_rows, ROWS):
                part = some.slice(begin, ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                names = (part.column(c).to_pylist() for c in ("block", "guest", "id"))
                rows = had + list(zip(*names, texts, Fingerprint.of_each([t.split("\n") for t in texts]), strict=True))
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[1]]
                had = rows[-1:]
                tails = [_tails(a[3], b[3]) for a, b in pairs]
                went, came = (Fingerprint.of_each([t[k] for t in tails]) for k in (0, 1))
                out: list[list] = [[] for _ in range(7)]
                for (a, b), less, more in zip(pairs, went, came, strict=True):
                    own, new = a[4], a[4] - less + more
                    sha = hashlib.sha256(edited(a[3], b[3]).encode()).hexdigest()
                    row = a[2], len(a[3]), sha, own.hex(), new.hex(), own.likeness(new), own.likeness(b[4])
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                types = [part.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row of docs, none if there is none; a null text counts as empty. Rows that repeat an
    id are told each; a very long text takes memory in proportion to its own length, and its fingerprint has a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in byte_slices(batch, "text"):
                for begin in range(0, some.num_rows, ROWS):
                    part = some.slice(begin, ROWS)
                    told = [f.hex() for f in Fingerprint.of_each([(t or "").split("\n") for t in part.column("text").to_pylist()])]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(told, pa.string())], ["id", "fingerprint"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _block_of(k: Column, falling: list[int]) -> Column:
    """How many of the falling cuts are at least k: block 0 has the largest ids. Cuts are looked through in two steps, so
    a row meets about twice the root of their number."""
    if not falling:
        return F.lit(0)
    step = max(1, int(len(falling) ** 0.5))
    groups = [falling[i : i + step] for i in range(0, len(falling), step)]
    over = lambda values: F.size(F.filter(values, lambda c: c >= k))
    whole = over(F.lit([g[-1] for g in groups]).cast("array<long>"))
    each = F.array(*(F.lit(g).cast("array<long>") for g in groups))
    # The last group may be a short one.
    return F.least(whole * step, F.lit(len(falling))) + over(F.coalesce(F.get(each, whole), F.array().cast("array<long>")))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    A row's next document is the one after it by descending id (a null id is the least; equal ids follow one another by
    rising text), the first after the last. Texts are shuffled once, to blocks of ids; the first row of each block is
    also sent to the block before, so no task sees more than its block and one row. A lone row is its own next. An empty
    table has no rows; a very long text is held whole by one task. Other columns of docs are not read.
    """
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Several blocks for each partition: they even out where they fall together.
    blocks = blocks or 4 * shuffle_partitions(docs.sparkSession)
    shares = [(i + 1) / blocks for i in range(blocks - 1)]
    cuts = slim.agg(F.percentile_approx("k", shares, 10_000)).first()[0] if shares else []
    cuts = sorted(set(cuts or []))
    slim_block = _block_of(F.col("k"), cuts[::-1])
    slim = slim.withColumn("block", slim_block)
    tops = sorted((r.block, r.top) for r in slim.groupBy("block").agg(F.max("k").alias("top")).collect())
    before = {b: tops[i - 1][0] for i, (b, _) in enumerate(tops)}
    top_of, block_before = [0] * blocks, [0] * blocks
    for b, top in tops:
        top_of[b], block_before[b] = top, before[b]
    of = lambda values, kind: F.get(F.lit(values).cast(f"array<{kind}>"), F.col("block"))
    guest = F.when(F.col("k") == of(top_of, "long"), of(block_before, "int"))
    places = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("guest")), F.struct(guest.alias("block"), F.lit(True).alias("guest")))
    dealt = slim.select("k", "id", "text", F.explode(F.filter(places, lambda p: p["block"].isNotNull())).alias("place"))
    dealt = dealt.select("place.block", "place.guest", "k", "id", "text").repartition("block")
    ordered = dealt.sortWithinPartitions("block", "guest", F.desc("k"), F.asc_nulls_first("text"))
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("block", "guest", "id", "text").mapInArrow(_compared, schema).withColumnRenamed("id", id_col)
