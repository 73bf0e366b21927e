"""Each stage of the pipeline against a plain version of its decision, on the driver's documents and on planted ones."""

import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from test_corpus_queries import ascii_lower, brute_hits
from test_near_dup import brute

CLASHING = ("row", "key", "id", "n_lines", "n_dropped", "items", "spans", "score", "lang_pred", "component_id", "kept", "gone", "rest")


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, step in P.STAGES:
        docs = step(spark, docs, sf_dir)
    assert docs.collect() == []


def plain_lines(rows):
    """Texts of (id, text) rows without lines that three documents hold, but in the largest id."""
    strip = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(strip(line)) >= 20:
                holders.setdefault(strip(line), set()).add(i)
    gone = lambda i, line: len(own := holders.get(strip(line), ())) >= 3 and i != max(own)
    return [(i, "\n".join(line for line in (text or "").split("\n") if not gone(i, line))) for i, text in rows]


def planted(sf_dir, spark):
    """Rows of the driver's documents, and cases: kind by note."""
    own = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text and r.lang == "en"]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rnd = random.Random(11)
    words = sorted({w for r in own for w in r.text.split() if w.isalpha()})
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    rows = []

    def add(note, text, doc_id=False):
        rows.append((len(rows) + 10_000 if doc_id is False else doc_id, text, note))

    long_items = [t for t in items if len(t.split()) >= 20]
    for k in range(6):
        part = " ".join(long_items[k].split()[2:17])
        add("leak", long_items[k])
        add("leak", f"{prose(3000)} {part} {prose(3000)}")
        add("leak", f"{prose(300)}\n{part}\n{prose(300)}")
        add("clean", prose(400 + k))
    add("clean", prose(15_000))
    # A line of three documents would go before: no text stands in more than two.
    for _ in range(5):
        text = prose(300)
        add("first", text)
        add("copy", text)
        near = text.split()
        near[150] = "elsewhere"
        add("copy", " ".join(near))
    for _ in range(3):
        text = prose(300)
        add("first", text)
        add("copy", text.translate({c: c - 32 for c in range(97, 123)}))
    line = prose(60)
    for _ in range(5):
        add("line", f"{prose(80)}\n{line}\n{prose(80)}")
    same = prose(200)
    for k in (None, None, 777, 777, None):
        add("copy" if k is None else "repeat", same, k)
    for text in (None, "", " \n\t", "12 345 !?", "😀"):
        add("letterless", text)
    add("no id", prose(250), None)
    return own, rows, line


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(name, rows before, rows after) of each stage but the last, on documents with planted cases and odd columns."""
    own, rows, line = planted(sf_dir, spark)
    extra = {c: F.lit(c) for c in CLASHING}
    told = spark.createDataFrame([(*r[:2], "en" if i % 2 else None, None, None, r[2]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, note string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("note", F.lit("driver")).unionByName(told).withColumns(extra)
    out = []
    docs = P.stage(docs, "documents")
    for name, step in P.STAGES[:-1]:
        new = P.stage(step(spark, docs, sf_dir), name)
        assert new.columns == docs.columns
        out.append((name, docs.collect(), new.collect()))
        docs = new
    packed = P.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == docs.count()
    return {name: (before, after) for name, before, after in out}, line


def ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows)


def test_language(stages):
    before, after = stages[0]["language_id"]
    gone = set(ids(before)) - set(ids(after))
    assert {r.note for r in before if (r.doc_id is None, r.doc_id or 0, r.text or "") in gone} == {"letterless"}
    assert not [r for r in after if r.note == "letterless"]
    assert all(r[c] == c for r in after for c in CLASHING)


def test_lines(stages):
    before, after = stages[0]["line_dedup"]
    assert sorted(ids(after)) == sorted((i is None, i or 0, t) for i, t in plain_lines([(r.doc_id, r.text) for r in before]))
    assert all(r.n_chars == len(r.text) and r["n_lines"] == "n_lines" for r in after)
    assert sum(stages[1] in r.text for r in after) == 1


def test_near_duplicates(stages):
    before, after = stages[0]["near_dedup"]
    kept = {(r.doc_id, r.text) for r in after}
    low = brute(list(enumerate(r.text for r in before)))
    groups = {}
    for key, n, component, _ in low:
        groups.setdefault(component, []).append(before[key])
    assert len(after) == len(groups)
    for own in groups.values():
        left = [r for r in own if (r.doc_id, r.text) in kept]
        least = min((r.doc_id is None, r.doc_id or 0) for r in own)
        assert {(r.doc_id is None, r.doc_id or 0) for r in left} == {least}
    assert [r.note for r in after if r.note == "copy"] == []
    assert sorted(r.note for r in after if r.note in ("first", "repeat")) == ["first"] * 8 + ["repeat"]


def test_decontamination(stages, spark, sf_dir):
    before, after = stages[0]["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = {k for k, _, n_hit, *_ in brute_hits([(k, r.text) for k, r in enumerate(before)], items) if n_hit}
    assert ids(after) == ids([r for k, r in enumerate(before) if k not in hits])
    assert not [r for r in after if r.note == "leak"] and sum(r.note == "leak" for r in before) >= 12
    assert sum(r.note == "clean" for r in after) == 7


def test_no_language_to_learn(spark, sf_dir):
    docs = spark.createDataFrame([(1, "words here", None), (1, "12", None), (None, None, None)], "doc_id long, text string, lang string")
    assert [r.text for r in P.known_language(spark, docs, sf_dir).collect()] == ["words here"]
