"""A corpus from raw documents to packed sequences, in stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, language_id, line_dedup, near_dup, packing
from lattica.llm._common import stage
from lattica.llm.queries import held_out, tokenizer_path

#: A document stays if its language has at least this share of the probability.
LEAST_SCORE = 0.5


def rows_and_texts(docs: DataFrame) -> DataFrame:
    """(row, text): the other columns of each row, whatever their names are, beside the text, which is held once."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "text")


def whole_rows(docs: DataFrame, names: list[str], row: str = "row", text: str = "text") -> DataFrame:
    """The columns that rows_and_texts was given."""
    return docs.select(*((F.col(text) if c == "text" else F.col(row).getField(c)).alias(c) for c in names))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or no likely language. If no row tells a language to learn, those with a
    letter stay. Rows are judged each, whatever their ids; very long texts as others."""
    model = language_id.train(docs, language_id.vocabulary(tokenizer_path("piece_bpe_32k.model")), ~held_out())
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language_id.identify(rows_and_texts(docs), model, id_col="row", keep=True)
    told = told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return whole_rows(told, docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them; n_chars follows the text. No row goes; one whose lines all
    went, or with a null text, has an empty text."""
    out = line_dedup.dedup_lines(docs, n_lines="_n_lines", n_dropped="_n_dropped").select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id (a null id is the last; ties: either).

    Every row is judged by a key of its own, so rows that repeat an id, or have none, are deduplicated like others. Rows
    without words are in no group and stay.
    """
    keyed = stage(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row")), "keyed")
    texts = keyed.select("key", F.col("row.text").alias("text"))
    groups = stage(near_dup.near_duplicates(texts, id_col="key").select("key", "component_id"), "near-groups")
    ids = keyed.select("key", F.col("row.doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    kept = groups.join(ids, "key").groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias("key"))
    return keyed.join(kept, "key", "left_semi").select("row.*")


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of the benchmark, however long they are: in a long document a passage is a
    small part, and is learned all the same. Documents without words stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.benchmark_hits(rows_and_texts(docs), benchmark, id_col="row", keep=True)
    own = hits.select(F.struct("row", "text").alias("own"), "n_words", "spans", "items")
    clean = decontaminate.contamination(own, id_col="own").where("n_hit = 0")
    return whole_rows(clean, docs.columns, "own.row", "own.text")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, as op2 gives them."""
    told = Path(tokenizer_path("word_bpe_49k.json")).read_text(encoding="utf-8")
    return packing.pack_documents(docs, told)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", fresh_lines),
    ("near_dedup", distinct_documents),
    ("decontamination", clean_documents),
    ("packing", packed_sequences),
]

#: SQL can't express language identification or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
