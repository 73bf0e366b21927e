"""What Python workers hold: texts reach them once, and places of token runs take no multiple of the tokens' memory."""

import tracemalloc

import corpus_pipeline as P
import numpy as np
import pytest

from lattica.llm import packing


def test_token_runs_are_placed_in_little_memory():
    rnd = np.random.default_rng(5)
    lengths = rnd.integers(0, 6, 5000)
    flat, codes = np.arange(lengths.sum()).astype("<u4"), rnd.integers(0, 5000, 500_000)
    tracemalloc.start()
    got = packing._gathered(flat, lengths, codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * got.nbytes
    ends = np.cumsum(lengths)
    assert got.tolist() == [x for c in codes.tolist() for x in range(ends[c] - lengths[c], ends[c])]


@pytest.mark.parametrize("step", [P.known_language, P.clean_documents])
def test_texts_are_sent_once(spark, sf_dir, monkeypatch, step):
    docs = spark.createDataFrame([(1, "some words", "en"), (2, None, "de"), (3, "", None)], "doc_id long, text string, lang string")
    sent, plain = [], type(docs).mapInArrow

    def spy(self, *args, **kwargs):
        sent.append(self.schema.simpleString())
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(type(docs), "mapInArrow", spy)
    out = step(spark, docs, sf_dir)
    assert out.columns == docs.columns and sent
    assert [x.count("text:string") for x in sent] == [1] * len(sent)
