"""Best-fit packing by bin completion.

Pieces of at most `capacity` tokens are packed into as few sequences as can be. Only the pieces' lengths matter to that,
and there are at most `capacity` distinct ones, so the search runs on the histogram of lengths, which has a bound
whatever the corpus. Bin completion (Korf 2002): around the largest piece left, enumerate the undominated fillings of
its sequence, least waste first; branch over all of them and over how often each is taken; prune where the waste so far
shows that no fewer sequences than the incumbent's can come out. The first incumbent is best-fit decreasing; a better
packing found replaces it. The search ends when it meets the lower bound, when nothing is left to try (either proves the
packing), or after `steps` steps, its one limit.

The plan is then applied in parallel: a piece's rank among the pieces of its length tells its place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._common import byte_slices, coded, gapless_rank, split_words, stage, starts_of

CAPACITY = 2048
#: Steps of the search: sequences begun and fillings looked at.
STEPS = 40_000
#: Bytes of text, about, whose tokens are made at once.
SLICE = 2 << 20
#: Sequences whose options are kept while the search is deeper; those of others are made again when it comes back.
HELD = 64

#: A plan: (lengths with how often each, how many sequences are filled so).
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, with equal pieces and equal sequences moved at once."""
    by_rest: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rests = np.zeros(capacity + 1, bool)

    def add(rest: int, filling: tuple[tuple[int, int], ...], n: int) -> None:
        by_rest.setdefault(rest, []).append((filling, n))
        rests[rest] = True

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = np.flatnonzero(rests[length:])
            if not len(fits):
                fill = capacity // length
                full, over = divmod(left, fill)
                if full:
                    add(capacity - fill * length, ((length, fill),), full)
                if over:
                    add(capacity - over * length, ((length, over),), 1)
                break
            rest = int(fits[0]) + length
            filling, n = by_rest[rest].pop()
            if not by_rest[rest]:
                rests[rest] = False
            # Each of these sequences takes pieces until it has no room for another.
            fill = rest // length
            full, over = divmod(left, fill)
            took = min(n, full)
            if took:
                add(rest - fill * length, (*filling, (length, fill)), took)
            elif over:
                add(rest - over * length, (*filling, (length, over)), 1)
                took, fill = 1, over
            left -= took * fill
            if n > took:
                add(rest, filling, n - took)
    return [x for xs in by_rest.values() for x in xs]


def fillings(lengths: list[int], counts: dict[int, int], room: int, most_waste: Callable[[], int]) -> Iterator[tuple[tuple[int, ...], int] | None]:
    """Undominated ways to fill room with pieces of lengths (descending), and their waste: least waste first, then by
    larger pieces. Ends beyond most_waste(), which may fall meanwhile. A None stands for a filling that was looked at
    and is dominated.

    A filling is dominated if one more piece fits, or a larger piece in the place of one of its own: whatever packing
    has it, one with the better filling is as good.
    """
    falling = [-x for x in lengths]
    usable = [x for x in lengths if x <= room and counts[x] > 0]
    # reach[k]: the bits of all sums that pieces of usable[k:] can have.
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(usable) + 1)
    for k in range(len(usable) - 1, -1, -1):
        sums, left, some = reach[k + 1], min(counts[usable[k]], room // usable[k]), 1
        while left:
            some = min(some, left)
            sums |= sums << usable[k] * some & mask
            left, some = left - some, 2 * some
        reach[k] = sums

    def dominated(taken: tuple[int, ...], waste: int) -> bool:
        """A larger piece that is left fits in the place of one, or any piece beside them."""
        for x in {0, *taken}:
            for k in range(bisect_left(falling, -(x + waste)), bisect_left(falling, -x) if x else len(lengths)):
                if counts[lengths[k]] > taken.count(lengths[k]):
                    return True
        return False

    def exact(at: int, target: int, taken: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not target:
            yield taken
            return
        for k in range(max(at, bisect_left(usable, -target, key=lambda x: -x)), len(usable)):
            if not reach[k] >> target & 1:
                return
            x = usable[k]
            for n in range(min(counts[x], target // x), 0, -1):
                if reach[k + 1] >> target - n * x & 1:
                    yield from exact(k + 1, target - n * x, taken + (x,) * n)

    for waste in range(room + 1):
        if waste > most_waste():
            return
        if reach[0] >> room - waste & 1:
            for taken in exact(0, room - waste, ()):
                yield None if dominated(taken, waste) else (taken, waste)


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound (Martello, Toth 1990): over each least length looked at, pieces over half of the capacity need a
    sequence each, and the others what these leave no room for."""
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in lengths.tolist()], np.int64)
    best = 0
    for least in [0, *lengths[2 * lengths <= capacity].tolist()]:
        alone, large = lengths > capacity - least, (lengths <= capacity - least) & (2 * lengths > capacity)
        small = (lengths >= least) & (2 * lengths <= capacity)
        room = int(n[large].sum()) * capacity - int((n * lengths)[large].sum())
        over = int((n * lengths)[small].sum()) - room
        best = max(best, int(n[alone | large].sum()) + max(0, -(-over // capacity)))
    return best


@dataclass
class Packing:
    """A plan, its number of sequences, the lower bound on it, and whether fewer are proved impossible."""

    plan: Plan
    sequences: int
    bound: int
    proved: bool


@dataclass
class _Step:
    """A sequence begun: sequences and waste so far, what was filled last, the options not yet seen and how many are."""

    used: int
    waste: int
    entry: tuple[tuple[tuple[int, int], ...], int] | None
    options: Iterator | None = None
    seen: int = 0


def search(counts: dict[int, int], capacity: int, steps: int = STEPS) -> Packing:
    """The best packing of counts[length] pieces of each length that bin completion finds, from the best-fit incumbent."""
    counts = {k: v for k, v in counts.items() if v > 0}
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    total = sum(k * v for k, v in counts.items())
    bound = least_sequences(counts, capacity)

    def branches(left: dict[int, int], waste: int) -> Iterator[tuple[tuple[tuple[int, int], ...], int, int] | None]:
        """(filling, how often, waste) of the sequences around the largest piece left."""
        lengths = sorted(left, reverse=True)
        first = lengths[0]
        rest = left | {first: left[first] - 1}
        # With more waste in all, at least as many sequences as the incumbent's come out.
        most_waste = lambda: (best_n - 1) * capacity - total - waste
        for found in fillings(lengths, rest, capacity - first, most_waste):
            if found is None:
                yield None
                continue
            need = {first: 1}
            for x in found[0]:
                need[x] = need.get(x, 0) + 1
            filling = tuple(sorted(need.items(), reverse=True))
            for times in range(min(left[x] // k for x, k in filling), 0, -1):
                yield filling, times, times * found[1]

    path = [_Step(0, 0, None)] if best_n > bound else []
    left, taken = dict(counts), 0
    while path and taken < steps:
        taken += 1
        at = path[-1]
        if at.options is None:
            at.options = islice(branches(dict(left), at.waste), at.seen, None)
        option = next(at.options, False)
        at.seen += 1
        if option is False:
            path.pop()
            if at.entry:
                filling, times = at.entry
                for x, k in filling:
                    left[x] = left.get(x, 0) + times * k
            continue
        if option is None:
            continue
        filling, times, more = option
        if at.waste + more > (best_n - 1) * capacity - total:
            continue
        for x, k in filling:
            left[x] -= times * k
            if not left[x]:
                del left[x]
        path.append(_Step(at.used + times, at.waste + more, (filling, times)))
        if len(path) > HELD:
            path[-HELD - 1].options = None
        if not left:
            if path[-1].used < best_n:
                best, best_n = [p.entry for p in path if p.entry], path[-1].used
                if best_n <= bound:
                    break
            path[-1].options = iter(())
    return Packing(best, best_n, bound, best_n <= bound or not path)


def pack(counts: dict[int, int], capacity: int, steps: int = STEPS) -> Plan:
    return search(counts, capacity, steps).plan


class Places:
    """Where the piece of a length and rank goes: the plan as sorted arrays. A plan of the search has at most as many
    rows as the search has steps, one of best-fit few more than there are lengths; each filling has under 64 distinct
    lengths, so the arrays have a bound."""

    def __init__(self, plan: Plan):
        used: dict[int, int] = {}
        rows = []
        sequence = 0
        for filling, times in plan:
            offset = 0
            for length, k in filling:
                rows.append((length, used.get(length, 0), k, sequence, offset))
                used[length] = used.get(length, 0) + k * times
                offset += k * length
            sequence += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.start, self.each, self.sequence, self.offset = table.T
        self.key = (self.length << 44) + self.start

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length.astype(np.int64) << 44) + rank, side="right") - 1
        nth = rank - self.start[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def _gathered(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray, runs: int = 1 << 16) -> np.ndarray:
    """The runs of flat that codes tell, end to end; run k has lengths[k] values and follows the run before. So many runs
    at a time are placed, as their places take several times the memory of the values."""
    starts = starts_of(lengths)
    out, end = np.empty(int(lengths[codes].sum()), flat.dtype), 0
    for first in range(0, len(codes), runs):
        own = codes[first : first + runs]
        n = lengths[own]
        begin, end = end, end + int(n.sum())
        out[begin:end] = flat[np.repeat(starts[own] - starts_of(n), n) + np.arange(end - begin)]
    return out


class TokenIds:
    """The ids that a tokenizer of the `tokenizers` library gives.

    The tokenizer's normaliser and splitter never join characters across ASCII white space, so texts are cut there and
    each distinct word is encoded once a slice. Words of plain letters and ASCII punctuation take a short cut: they are
    lower-cased and cut to runs of either, which the tokenizer's model encodes alone, each distinct run once and kept for
    later slices while there is room. All others go through the whole tokenizer.
    """

    KEPT = 400_000
    #: ASCII letters, and letters from Latin-1 that lower-casing keeps single and normalisation keeps as they are; ASCII
    #: punctuation but for those that begin the splitter's or the tokenizer's own marks.
    PLAIN = r"^([A-Za-zÀ-ÖØ-öø-ÿ]|[!-&(-/:;=-@\[-`{-~])+$"
    LETTERS = r"([a-zß-öø-ÿ]+)"

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        # The printable characters that stand for bytes in byte-level vocabularies.
        self.as_char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _part(self, part: str) -> bytes:
        chars = part if part.isascii() else "".join(map(self.as_char.__getitem__, part.encode()))
        got = np.array([t.id for t in self.model.tokenize(chars)], "<u4").tobytes()
        if len(self.parts) < self.KEPT:
            self.parts[part] = got
        return got

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        runs, counts = split_words(pc.replace_substring_regex(pc.utf8_lower(words), self.LETTERS, r" \1 "))
        codes, distinct = coded(runs)
        names = distinct.to_pylist()
        told = [self._part(p) if got is None else got for p, got in zip(names, map(self.parts.get, names), strict=True)]
        lengths = np.fromiter(map(len, told), np.int64, len(told)) // 4
        ids = _gathered(np.frombuffer(b"".join(told), "<u4"), lengths, codes)
        return ids, _sums(lengths[codes], counts)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, end to end, and how many each has."""
        plain = np.asarray(pc.and_(pc.match_substring_regex(words, self.PLAIN), pc.less(pc.binary_length(words), 256)))
        ids, own = self._plain(words.filter(pa.array(plain)))
        whole = words.filter(pa.array(~plain)).to_pylist()
        others = []
        for begin in range(0, len(whole), 1000):
            others += [e.ids for e in self.tokenizer.encode_batch(whole[begin : begin + 1000], add_special_tokens=False)]
        lengths = np.zeros(len(words), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        by_order = np.concatenate([own, np.array(list(map(len, others)), np.int64)])
        lengths[order] = by_order
        flat = np.concatenate([ids, np.array([i for e in others for i in e], "<u4")]).astype("<u4")
        return _gathered(flat, by_order, np.argsort(order)), lengths

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end to end, and how many each has."""
        words, counts = split_words(texts)
        codes, distinct = coded(words)
        del words
        ids, lengths = self.words(distinct.cast(pa.string()))
        return _gathered(ids, lengths, codes), _sums(lengths[codes], counts)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of runs of counts values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _pieces(tokenizer_json: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenIds(tokenizer_json)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                ids, counts = encoder.texts(part.column("text"))
                ends = np.cumsum(counts + 1)
                is_end = np.zeros(len(ids) + len(counts), bool)
                is_end[ends - 1] = True
                whole = np.full(len(is_end), end_id, "<u4")
                whole[~is_end] = ids
                pieces = -(-(counts + 1) // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                nth = np.arange(len(row)) - starts_of(pieces)[row]
                length = np.minimum(counts[row] + 1 - nth * capacity, capacity)
                begin, data = 4 * starts_of(length), whole.view(np.uint8).data
                crc = [zlib.crc32(data[b:e]) for b, e in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                columns = part.column("id").take(pa.array(row)), pa.array(nth, pa.int32())
                longs = (pa.array(v, pa.int64()) for v in (nth * capacity, length, crc))
                yield pa.RecordBatch.from_arrays([*columns, *longs], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_documents(
    docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = 0, steps: int = STEPS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, proved) for each piece of each row of docs; proved
    tells that no packing has fewer sequences.

    A row's tokens are its text's ids, then end_id; a null or empty text has the latter alone. A row of more than
    capacity tokens is cut into pieces of capacity, the last one shorter; a very long text is encoded whole by one task.
    Rows that repeat an id are packed each, whichever of equal pieces comes first. Sequences are filled from offset 0
    without gaps. An empty table has no pieces. Other columns of docs are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = stage(slim.mapInArrow(_pieces(tokenizer_json, capacity, end_id), schema), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    packing = search(counts, capacity, steps)
    places = Places(packing.plan)
    order = [F.col("id"), F.col("piece"), F.col("ids_crc32")]
    ranked = gapless_rank(pieces, ["length"], order, [F.col("id"), F.col("piece")], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(*(batch.column(c).to_numpy() for c in ("length", "rank")))
            columns = {c: batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")}
            columns |= {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    out = ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long").withColumnRenamed("id", id_col)
    return out.withColumn("proved", F.lit(packing.proved))
