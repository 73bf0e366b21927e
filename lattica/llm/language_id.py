"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum, over all
ways to cut it into pieces, of the product of the pieces' probabilities; the forward algorithm sums them without listing
them. A text's score is the sum of its words' logarithms, and the language with the largest sum is told.

The piece probabilities are learned by expectation maximisation from word counts of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lattica.llm._common import byte_slices, coded, rest_of, split_words, stage, starts_of, unstage

UNDETERMINED = "und"
#: Bounds of learning alone: labelled rows a language is learned from, about; words with a count that are kept for a
#: language, and their letters at most; steps of EM.
SAMPLE_ROWS, SAMPLE_WORDS, SAMPLE_CHARS, STEPS = 1500, 12_000, 64, 4
#: (word, language) pairs whose sums are held at once, and letters after which they are scaled anew.
CELLS, SCALED = 32_768, 16
_BASE = 0x100000001B3


def _letters(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words, which are runs of letters, and how many each text has."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    return split_words(pc.replace_substring_regex(texts, r"[^\p{L}]+", " "))


class Pieces:
    """The vocabulary: all its pieces of letters, by hash. Any other letter is the piece 0.

    hashes has the hashes of all ends of pieces, and numbers which piece each is (0: the end of one only), so the pieces
    that end at a letter are found by going back from it as far as some piece goes on."""

    def __init__(self, vocabulary: list[str]):
        own = sorted({x for p in vocabulary if (x := p.replace("▁", "").lower()).isalpha()})
        self.longest = max(map(len, own), default=1)
        self.size = len(own) + 1
        self.powers = np.array([pow(_BASE, k, 1 << 64) for k in range(self.longest)], np.uint64)
        found: dict[int, int] = {}
        for number, piece in enumerate(own, 1):
            h = 0
            for power, c in zip(self.powers.tolist(), reversed(piece), strict=False):
                h = (h + (ord(c) + 1) * power) & 0xFFFFFFFFFFFFFFFF
                found.setdefault(h, 0)
            found[h] = number
        self.hashes = np.array(sorted(found), np.uint64)
        self.numbers = np.array([found[h] for h in self.hashes.tolist()], np.int64)
        self.own = own

    def number(self, piece: str) -> int:
        return self.own.index(piece) + 1

    @staticmethod
    def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words' order by falling length; in it, where each begins and its length; and all code points."""
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        return order, starts_of(lengths)[order], lengths[order], flat

    def ending(self, end: int, starts: np.ndarray, flat: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, words, pieces): which words have a piece of that length that ends after their letter end."""
        words = np.arange(len(starts))
        h = np.zeros(len(starts), np.uint64)
        for length in range(1, min(self.longest, end) + 1):
            letter = flat[starts[words] + end - length].astype(np.uint64)
            h = h + (letter + np.uint64(1)) * self.powers[length - 1]
            spot = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
            ok = self.hashes[spot] == h if len(self.hashes) else np.zeros(len(h), bool)
            number = np.where(ok, self.numbers[spot], 0) if len(self.hashes) else np.zeros(len(h), np.int64)
            hit = number > 0
            if length == 1:
                yield 1, words, number
            elif hit.any():
                yield length, words[hit], number[hit]
            if not ok.any():
                return
            words, h = words[ok], h[ok]

    def log_scores(self, words: pa.Array, p: np.ndarray) -> np.ndarray:
        """(words, languages) logarithms of the words' probabilities, each the sum over all segmentations.

        Only as many sums are held as the longest piece has letters, in a ring, and scaled as they fall, so a word may
        have any length.
        """
        order, starts, n, flat = self.letters(words)
        out = np.zeros((len(n), p.shape[1]))
        rows = max(256, CELLS // max(1, p.shape[1]))
        for begin in range(0, len(n), rows):
            part = slice(begin, begin + rows)
            out[order[part]] = self._forward(starts[part], n[part], flat, p)
        return out

    def _forward(self, starts: np.ndarray, n: np.ndarray, flat: np.ndarray, p: np.ndarray) -> np.ndarray:
        held = self.longest + 1
        ring = np.zeros((held, len(n), p.shape[1]))
        ring[0] = 1
        scale, out = np.zeros((2, len(n), p.shape[1]))
        for end in range(1, int(n[0]) + 1):
            here, after = np.searchsorted(-n, [-end, -end - 1], side="right")
            sums = np.zeros((here, p.shape[1]))
            for length, words, pieces in self.ending(end, starts[:here], flat):
                sums[words] += ring[(end - length) % held, words] * p[pieces]
            ring[end % held, :here] = sums
            out[after:here] = np.log(np.maximum(sums[after:], 1e-300)) + scale[after:here]
            if end % SCALED == 0 and after:
                top = ring[:, :after].max(axis=0)
                top[top == 0] = 1
                ring[:, :after] /= top
                scale[:after] += np.log(top)
        return out

    def learn(self, words: list[str], counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
        """(pieces, languages) probabilities from (words, languages) counts: EM over all segmentations."""
        order, starts, n, flat = self.letters(pa.array(words, pa.string()))
        parts = []
        rows = max(256, CELLS // max(1, counts.shape[1]))
        for begin in range(0, len(n), rows):
            own, found = slice(begin, begin + rows), []
            for end in range(1, int(n[begin]) + 1):
                here = int(np.searchsorted(-n[own], -end, side="right"))
                found += [(end, *x) for x in self.ending(end, starts[own][:here], flat)]
            parts.append((n[own], counts[order[own]].astype(float), found))
        p = np.full((self.size, counts.shape[1]), 1.0 / self.size)
        for _ in range(steps):
            hits = np.zeros_like(p)
            for ends, weight, found in parts:
                each = np.arange(len(ends))
                alpha = np.zeros((int(ends[0]) + 1, len(ends), counts.shape[1]))
                alpha[0] = 1
                for end, length, rows, pieces in found:
                    alpha[end, rows] += alpha[end - length, rows] * p[pieces]
                beta = np.zeros_like(alpha)
                beta[ends, each] = weight / np.maximum(alpha[ends, each], 1e-300)
                for end, length, rows, pieces in reversed(found):
                    share = beta[end, rows] * p[pieces]
                    np.add.at(hits, pieces, alpha[end - length, rows] * share)
                    beta[end - length, rows] += share
            p = (hits + 0.01) / (hits + 0.01).sum(axis=0)
        return p


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_slices(batch, "text"):
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                words, _ = _letters(part.column("text").filter(pa.array(langs == lang)))
                codes, distinct = coded(words)
                n = np.bincount(codes, minlength=len(distinct)) if len(codes) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(distinct), pa.string()), distinct.cast(pa.string()), pa.array(n, pa.int64())],
                    ["lang", "word", "n"],
                )


class LanguageModel:
    """Languages, the vocabulary and the piece probabilities; small, and sent to the tasks."""

    def __init__(self, languages: list[str], pieces: Pieces, p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        words, counts = _letters(texts)
        codes, distinct = coded(words)
        some = counts > 0
        sums = np.zeros((len(counts), max(1, len(self.languages))))
        if len(codes) and self.languages:
            logs = self.pieces.log_scores(distinct, self.p)
            begins, ends = starts_of(counts), starts_of(counts) + counts
            for lang in range(len(self.languages)):
                total = np.concatenate([[0.0], np.cumsum(logs[codes, lang])])
                sums[:, lang] = total[ends] - total[begins]
        best = sums.argmax(axis=1)
        away = np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -700))
        score = np.where(some & bool(self.languages), 1 / away.sum(axis=1), 0.0)
        told = [self.languages[b] if s and self.languages else UNDETERMINED for b, s in zip(best, some, strict=True)]
        return told, score


def vocabulary(path: str) -> list[str]:
    """The pieces of a SentencePiece model file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


def train(
    docs: DataFrame, pieces: list[str], labelled: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS, steps: int = STEPS,
) -> LanguageModel:
    """Learn from the labelled rows (all, if not given) with a language and a text.

    Of each language about sample_rows rows are learned from, by a hash of their id, whatever the table's size; of
    their words of at most SAMPLE_CHARS letters, the sample_words most frequent (ties: in order). These bounds are of the
    training alone. A table without such rows makes a model without languages.
    """
    own = docs.where(labelled if labelled is not None else F.lit(True))
    own = own.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    own = own.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], Pieces(pieces), np.zeros((1, 0)))
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double") / 1e6
    part = F.lit(False)
    for lang, n in sorted(sizes.items()):
        part = part | ((F.col("lang") == lang) & (share < F.lit(min(1.0, sample_rows / n))))
    counted = own.where(part).select("lang", "text").mapInArrow(_counted, "lang string, word string, n long")
    counted = stage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(sizes)
    totals: dict[str, np.ndarray] = {}
    for k, lang in enumerate(languages):
        top = counted.where((F.col("lang") == lang) & (F.length("word") <= SAMPLE_CHARS)).orderBy(F.desc("n"), "word").limit(sample_words)
        for r in top.select("word", "n").collect():
            totals.setdefault(r.word, np.zeros(len(languages), np.int64))[k] = r.n
    unstage(counted)
    words = sorted(totals)
    own_pieces = Pieces(pieces)
    counts = np.array([totals[w] for w in words]).reshape(len(words), len(languages))
    return LanguageModel(languages, own_pieces, own_pieces.learn(words, counts, steps))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) for each row: score is the language's share of the probability, 0 to 1. With keep, all
    columns of docs and these two, which replace columns of the same names.

    A word is a run of letters of any length; all its segmentations into the vocabulary's pieces, of any length, and
    single letters are summed. A very long text is judged whole by one task. A null or empty text, or one without a letter,
    is "und" with score 0, and so is every text if the model has no language. Ties go to the language first in order.
    Rows that repeat an id are judged each; an empty table has no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                told, score = model.judge(part.column("text"))
                columns = {c: part.column(c) for c in sent}
                columns |= {"lang_pred": pa.array(told, pa.string()), "score": pa.array(score, pa.float64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    names = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep else [id_col]
    rest = rest_of(docs, text_col, names)
    sent = ["rest", "text"] if rest != names else ["rest"]
    slim = docs.select(F.struct(*rest).alias("rest"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([*(slim.schema[c] for c in sent), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    own = {c: F.col("rest").getField(c) if c in rest else F.col("text") for c in names}
    return slim.mapInArrow(run, schema).select(*(v.alias(c) for c, v in own.items()), "lang_pred", "score")
