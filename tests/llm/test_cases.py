"""Nulls, ties, repeats, empty tables, clashing columns and the parts of each operator."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import _common, fingerprint, language_id, line_dedup, packing, secret_scan, sharding, url_filter, warc
from lattica.llm import queries as Q
from lattica.llm._common import connected_components, gapless_rank, stage


def told():
    from pathlib import Path

    return Path(Q.tokenizer_path("word_bpe_49k.json")).read_text(encoding="utf-8")


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(50, 40), (40, 60), (60, 50)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 1 for k in range(1, 31)} | {40: 40, 50: 40, 60: 40}


def least_reachable(edges):
    low = {x: x for e in edges for x in e}
    while changed := [(max(low[a], low[b]), min(low[a], low[b])) for a, b in edges if low[a] != low[b]]:
        for old, least in changed:
            low = {x: least if y == old else y for x, y in low.items()}
    return low


def test_components_of_shuffled_paths(spark):
    rnd = random.Random(4)
    ids = rnd.sample(range(-(10**9), 10**9), 300)
    edges = [(ids[k], ids[k + 1]) for k in range(299) if k % 60 != 59] * 2 + [(ids[7], ids[3]), (ids[3], ids[7])]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(least_reachable(edges).items())


def test_contracted_edges(monkeypatch):
    rnd = random.Random(2)
    edges = [(max(e), min(e)) for e in (rnd.sample(range(90), 2) for _ in range(100))]
    batches = [pa.RecordBatch.from_pydict({"u": [u for u, _ in part], "v": [v for _, v in part]}) for part in (edges[:5], edges[5:60], edges[60:])]
    batches.insert(1, batches[0].slice(0, 0))
    for limit in (1, 20, 1 << 20):
        monkeypatch.setattr(_common, "CONTRACTED_EDGES", limit)
        got = [(r["u"], r["v"]) for b in _common._contracted(iter(batches)) for r in b.to_pylist()]
        low, all_ = least_reachable(got), least_reachable(edges)
        assert {x: low.get(x, x) for x in all_} == all_
        assert limit < 1 << 20 or dict(got) == {x: y for x, y in all_.items() if x != y}
    assert list(_common._contracted(iter([]))) == []


def test_gapless_rank(spark):
    df = stage(spark.range(1000).select("id", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 5).alias("k")), "t")
    got = gapless_rank(df, ["k"], [F.col("id")], [F.col("id")], "r").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r.r)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 1000


# URL filter


def test_url_links(spark):
    bad, good = "http://bad.net/x", "http://good.org/fr/1"
    pages = [
        (1, bad, ""), (2, good, '<a href="http://friend.com/a">'), (3, "http://friend.com/a", "<a href='https://user@ok.com:80/'>"),
        (4, "http://spam.com/", '<a HREF="//bad.net/x">' * 3), (5, "http://ok.com/", None), (6, None, "x"), (7, "no scheme", "x"),
        (8, "http://farm.com", '<a href=http://spam.com/>'), (1, bad, ""), (9, "://", ""), (10, "HTTP://A.ORG?x=://b", ""),
    ]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, score int")
    got = url_filter.judge_urls(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(pages)
    assert [by[k].verdict for k in (1, 2, 3, 4, 5, 6, 7, 8)] == ["block", "allow", "allow", "block", "allow", "allow", "allow", "block"]
    assert by[3].trust > by[5].trust > 0 and by[4].distrust > by[8].distrust > 0
    assert [(by[k].host, by[k].path) for k in (6, 7, 9, 10)] == [("", ""), ("", ""), ("", ""), ("a.org", "")]
    assert url_filter.judge_urls(df.limit(0)).collect() == []


# Packing


def sequences(plan, capacity):
    assert all(sum(x * k for x, k in f) <= capacity for f, _ in plan)
    got = {}
    for f, n in plan:
        for x, k in f:
            got[x] = got.get(x, 0) + k * n
    return got, sum(n for _, n in plan)


def least(sizes, capacity):
    """The fewest sequences, by trying everything."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in sorted({b: j for j, b in enumerate(bins) if b + sizes[i] <= capacity}.values()):
            bins[k] += sizes[i]
            go(i + 1, bins)
            bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rnd = random.Random(seed)
    capacity = 50
    sizes = sorted((rnd.randint(4, 40) for _ in range(rnd.randint(1, 10))), reverse=True)
    counts = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    got, n = sequences(packing.pack(counts, capacity), capacity)
    assert got == counts and n == least(sizes, capacity)


def test_bin_completion_proves_what_best_fit_misses():
    """Sequences that pieces fill exactly, cut at random: best fit often needs one more."""
    beaten = 0
    for seed in range(120):
        rnd = random.Random(seed)
        sizes = []
        for _ in range(4):
            one, two = sorted(rnd.sample(range(1, 100), 2))
            sizes += [one, two - one, 100 - two]
        sizes = sorted(sizes, reverse=True)[: rnd.randint(8, 12)]
        counts = {x: sizes.count(x) for x in sizes}
        found = packing.search(counts, 100)
        got, n = sequences(found.plan, 100)
        assert got == counts and found.proved and n == found.sequences == least(sizes, 100) >= found.bound
        beaten += sequences(packing.best_fit(counts, 100), 100)[1] > n
    assert beaten > 20


def test_the_step_limit_leaves_a_whole_packing_that_is_not_proved():
    rnd = random.Random(1)
    counts = {x * 10: rnd.randint(1, 50_000) for x in range(30, 110)}
    found = packing.search(counts, 2048, steps=500)
    got, n = sequences(found.plan, 2048)
    assert got == counts and n == found.sequences > found.bound and not found.proved
    assert n <= sequences(packing.best_fit(counts, 2048), 2048)[1]
    assert packing.search({}, 2048) == packing.Packing([], 0, 0, True)


def test_bin_completion_beats_best_fit():
    counts = {44: 10, 24: 10, 22: 20, 21: 10, 17: 20, 8: 10, 6: 10}
    one, n_best = sequences(packing.best_fit(counts, 61), 61)
    two, n = sequences(packing.pack(counts, 61), 61)
    assert one == two == counts and n <= n_best


def test_places():
    counts = {7: 1000, 5: 301, 3: 17, 20: 2}
    places = packing.Places(packing.pack(counts, 20))
    spans = {}
    for length, n in counts.items():
        for s, o in zip(*places.find(np.full(n, length), np.arange(n)), strict=True):
            spans.setdefault(s, []).append((o, o + length))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[-1][1] <= 20
    assert sum(map(len, spans.values())) == sum(counts.values())


def test_token_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    rnd = random.Random(5)
    parts = ["Ab", "é", "É", "ß", "'s", "'LL", "don't", "...", "!?", "12", "³", "日本", "á", " ", " x", "<|endoftext|>", "<", "|>", "İ", "Σ", "ς", "\x1c", "_", "-", "@", "µ", "ª", "x\ty", "🙂", "´", "ﬁ"]
    texts = ["", " ", "\n\n", "x" * 300, "Hello, World's END.\nAgain"] + ["".join(rnd.choices([*parts, " "], k=rnd.randint(1, 12))) for _ in range(400)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_str(told()).encode_batch(texts, add_special_tokens=False)]
    ids, counts = packing.TokenIds(told()).texts(pa.array(texts))
    assert [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_packing_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "word", 3), (4, "la " * 5000, 4), (4, "la " * 5000, 4)], "doc_id long, text string, piece int")
    got = packing.pack_documents(docs, told()).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == sorted([(1, 1), (1, 1), (0, 2)] + [(4, 2048), (4, 2048), (4, 905)] * 2)
    assert packing.pack_documents(docs.limit(0), told()).collect() == []


# Sharding


def test_differencing():
    rnd = random.Random(1)
    sizes = np.array([rnd.randint(1, 5000) for _ in range(2000)])
    to, totals = sharding.split_sizes(sizes, 24)
    assert (np.bincount(to, weights=sizes, minlength=24) == totals).all() and totals.max() - totals.min() <= 3
    assert sorted(sharding.split_sizes(np.array([8, 7, 6, 5, 4]), 2)[1].tolist()) == [14, 16]


def test_huge_groups_are_split_and_others_not(spark):
    rows = [(i, "the same long text " * 20) for i in range(3000)] + [(5000 + i, f"other {i % 600} " * 9) for i in range(1800)] + [(9000, None), (9000, "")]
    got = sharding.balance(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, slot int"), shards=24).collect()
    assert len(got) == len(rows)
    totals, shards = {}, {}
    for r in got:
        totals[r.shard] = totals.get(r.shard, 0) + r.size
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert sorted(map(len, shards.values()))[-2:] [0] == 1 and len(totals) == 24
    assert max(totals.values()) - min(totals.values()) <= 1000
    assert sharding.balance(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_stay_whole_where_told(spark):
    rows = [(1, "same " * 50)] * 300 + [(i, f"other {i}") for i in range(60)] + [(None, "same " * 50), (None, "long " * 4000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    for split in (True, False):
        got = sharding.balance(docs, shards=4, split_huge=split).collect()
        assert len(got) == len(rows)
        shards, slots = {}, {}
        for r in got:
            shards.setdefault(r.text_crc32, set()).add(r.shard)
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert max(map(len, shards.values())) == (4 if split else 1)


# Secrets


def test_many_matches_in_one_text_and_clashing_columns(spark):
    run = "0123456789abcdef" * 2
    rows = [(1, f"{run} " * 60_000), (2, f"é token: abcdef {run}"), (2, f"é token: abcdef {run}"), (None, None), (3, "")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, spans string, blob string, copies string")
    got = secret_scan.findings_by_path(docs, secret_scan.scan(docs)).collect()
    by = {r.doc_id: r.spans for r in got}
    assert len(got) == 5 and len(by[1]) == 60_000 and (by[1][-1].start, by[1][-1].end) == (33 * 59_999, 33 * 60_000 - 1)
    assert [(s.kind, s.start, s.end) for s in by[2]] == [("assign", 2, 15), ("hex", 16, 48)] and by[None] == by[3] == []


def test_a_blob_of_many_paths_is_scanned_once(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("secret=abcdef"), "id")).otherwise("token=abcdefgh").alias("text"))
    ledger = secret_scan.scan(docs.where("doc_id < 10"))
    more = secret_scan.scan(docs, ledger=ledger)
    assert ledger.findings.count() == 5 and more.findings.count() == 1001 and more.scanned.count() == 1001 * 5
    told = secret_scan.findings_by_path(docs, more)
    assert told.where("size(spans) = 1").count() == 3000



def test_ledger_scans_unseen_pairs_only(spark):
    first = spark.createDataFrame([(1, "token = abcdefgh"), (2, "token = abcdefgh"), (1, "clean")], "doc_id long, text string")
    ledger = secret_scan.scan(first)
    rules = len(secret_scan.BASE) + len(secret_scan.MORE)
    assert ledger.scanned.count() == 2 * rules and ledger.findings.count() == 1
    more = first.union(spark.createDataFrame([(3, "secret: zzzzzz"), (None, "secret: zzzzzz"), (4, None)], "doc_id long, text string"))
    again = secret_scan.scan(more, ledger=ledger)
    assert again.scanned.count() == 4 * rules and again.scanned.distinct().count() == 4 * rules
    found = {(r.doc_id, len(r.spans)) for r in secret_scan.findings_by_path(more, again).collect()}
    assert found == {(1, 1), (2, 1), (1, 0), (3, 1), (None, 1), (4, 0)}
    newer = tuple(secret_scan.Rule(r.kind, r.version + (r.kind == "hex"), r.pattern, r.group, r.least) for r in secret_scan.BASE)
    assert secret_scan.scan(more, newer, again).scanned.count() == 4 * rules + 4
    assert secret_scan.findings_by_path(first.limit(0), secret_scan.scan(first.limit(0))).collect() == []


# Language


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces(["a", "b", "ab", "ba", "aba"])
    p = np.zeros((pieces.size, 1))
    for name, v in {"a": 0.3, "b": 0.2, "ab": 0.1, "ba": 0.15, "aba": 0.25}.items():
        p[pieces.number(name)] = v
    got = np.exp(pieces.log_scores(pa.array(["aba", "ab", "c"]), p))
    assert got[:, 0] == pytest.approx([0.3 * 0.2 * 0.3 + 0.1 * 0.3 + 0.3 * 0.15 + 0.25, 0.3 * 0.2 + 0.1, 1e-300])


def test_forward_equals_listed_segmentations():
    """Random words, in a model learned from others, against sums over all ways to cut them."""
    rnd = random.Random(4)
    vocabulary = language_id.vocabulary(Q.tokenizer_path("piece_bpe_32k.model"))
    pieces = language_id.Pieces(vocabulary)
    assert pieces.longest == max(len(x) for p in vocabulary if (x := p.replace("▁", "")).isalpha()) > 8
    known = sorted({x for p in vocabulary if (x := p.replace("▁", "").lower()).isalpha()})
    words = ["".join(rnd.choices(known, k=rnd.randint(1, 4)))[: rnd.randint(1, 40)] for _ in range(60)] + ["и", "ß𝒳é", max(known, key=len)]
    p = pieces.learn(words[:40], np.array([[1, rnd.randint(0, 5)] for _ in words[:40]]))
    assert p.sum(axis=0) == pytest.approx([1, 1])
    number = {x: i for i, x in enumerate(known, 1)}

    def listed(word, lang):
        sums = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(end):
                piece = word[begin:end]
                if piece in number or end - begin == 1:
                    sums[end] += sums[begin] * p[number.get(piece, 0), lang]
        return sums[-1]

    def recursive(word, lang):
        own = [(k, number.get(word[:k], 0)) for k in range(1, len(word) + 1) if k == 1 or word[:k] in number]
        return sum(p[i, lang] * recursive(word[k:], lang) for k, i in own) if word else 1.0

    short = [w for w in words if len(w) <= 8]
    assert [listed(w, 1) for w in short] == pytest.approx([recursive(w, 1) for w in short])
    got = pieces.log_scores(pa.array(words), p)
    want = np.log([[listed(w, k) for k in (0, 1)] for w in words])
    assert got == pytest.approx(want, rel=1e-9)
    long = "".join(rnd.choices(known, k=3000))
    halves = [sum(pieces.log_scores(pa.array([x]), p)[0, 0] for x in (long[:k], long[k:])) for k in (5000, 7000)]
    whole = pieces.log_scores(pa.array([long]), p)[0, 0]
    assert all(half <= whole + 1e-6 < half + 60 for half in halves) and np.isfinite(whole)


def test_equal_languages_tie():
    pieces = language_id.Pieces(["a", "b"])
    model = language_id.LanguageModel(["x", "y"], pieces, pieces.learn(["ab"], np.array([[1, 1]])))
    told, score = model.judge(pa.array(["ab a", "7"]))
    assert told == ["x", "und"] and score.tolist() == [0.5, 0]


def test_language_cases(spark):
    pieces = language_id.vocabulary(Q.tokenizer_path("piece_bpe_32k.model"))
    rows = [(i, "the cat sat on the mat with that thing", "en") for i in range(20)] + [(100 + i, "le chat est sur la table avec une chose", "fr") for i in range(20)]
    odd = [(500, None, "en"), (501, "12 34 ...", None), (502, "", "fr"), (502, "la chose", None), (None, "the thing", None), (503, "x" * 30000, None), (504, "the thing " * 3000, None)]
    docs = spark.createDataFrame([(*r, 7.0) for r in rows + odd], "doc_id long, text string, lang string, score double")
    model = language_id.train(docs, pieces)
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect()][len(rows) :]
    assert got[:5] == [(500, "und"), (501, "und"), (502, "und"), (502, "fr"), (None, "en")] and got[6] == (504, "en")
    none = language_id.train(docs.limit(0), pieces)
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model, keep=True).columns == ["doc_id", "text", "lang", "lang_pred", "score"]


# WARC


def test_archives(spark, tmp_path):
    big = "<p>" + "long page " * 200
    pages = [(i, f"http://h/{i}", big if i % 3 else f"{big}{i}") for i in range(60)] + [(90, None, None), (None, "u\r\nx", big), (91, "é", ""), (59, "http://h/59", big)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, size int")
    archives = warc.write_archives(warc.with_revisits(df))
    files = archives.collect()
    for f in files:
        (tmp_path / f.path).write_bytes(f.content)
    read = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path / "*.warc.zst")))
    got = {}
    for r in read.collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == len(pages)
    assert {r.record_type for r in got[59]} == {"response"} and got[1][0].refers_to == 59 and bytes(got[59][0].payload).decode() == big
    assert got[None][0].record_type == "revisit" and got[None][0].payload_bytes == len(big)
    assert got[90][0].payload_bytes == 0 and got[91][0].url == "é"
    assert warc.read_archives(warc.write_archives(warc.with_revisits(df.limit(0)))).collect() == []


def test_many_archives_and_long_payloads(spark):
    rnd = random.Random(3)
    pages = [(i, f"u{i}", "".join(rnd.choices("abcdefghij <>", k=3000))) for i in range(300)] + [(900 + i, "same", "y" * 2000) for i in range(150)]
    pages += [(2000, "long", "".join(rnd.choices("abcdefgh", k=3_000_000)))]
    df = spark.createDataFrame([(*p, 0, "c") for p in pages], "page_id long, url string, html string, n int, first string").coalesce(1)
    archives = stage(warc.write_archives(warc.with_revisits(df), archive_bytes=100_000), "archives")
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert archives.count() > 3 and archives.select("path").distinct().count() == archives.count()
    assert len(got) == len(pages) and all(bytes(got[i].payload).decode() == t for i, _, t in pages if got[i].record_type == "response")
    assert {(got[900 + i].record_type, got[900 + i].refers_to) for i in range(149)} == {("revisit", 1049)} and got[1049].record_type == "response"


def test_broken_archives():
    writer = warc.ArchiveWriter()
    for k in range(40):
        writer.add(warc.encode_record("response", k, "u", b"payload %d " % k * 3000, 0, "00" * 20, None))
    data = writer.close()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    with pytest.raises(warc.ArchiveError, match="digest"):
        list(warc.read_archive(data))
    for bad in (data[:100], data[:-9]):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(bad))
    good = warc.encode_record("revisit", 1, "u", b"", 5, "00" * 20, 2)
    with pytest.raises(warc.ArchiveError, match="the header says"):
        warc.parse_record(good.replace(b"Content-Length: 0", b"Content-Length: 3"))
    assert warc.parse_record(good)[0]["warc-refers-to"] == "<urn:page:2>"


# Fingerprints


def test_homomorphic():
    f = fingerprint.Fingerprint.of_paragraphs
    a, b = ["one two. three", "four", "four"], ["five six.", "seven"]
    assert f(a) + f(b) == f(b + a) == f([b[1], *a[::-1], b[0]]) and f(a + b) - f(b) == f(a)
    assert f(["four"]) != f(["four", "four"]) and fingerprint.Fingerprint.from_hex(f(a).hex()) == f(a)
    assert f(a).likeness(f(a)) == 1.0
    near = f([f"line {i}" for i in range(100)]).likeness(f([f"line {i}" for i in range(20, 100)]))
    assert abs(near - 0.8) < 0.15


@pytest.mark.parametrize("blocks", [1, 3, 7, 9])
def test_edits(spark, blocks):
    rows = [(5, "abcdef"), (4, None), (3, ""), (3, "xy"), (None, "nullid"), (9, "12345" * 3000), (1, "é𝒳ü")]
    got = fingerprint.compare_edits(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_chars string"), blocks=blocks).collect()
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1] is not None, r[1] or ""))
    import hashlib

    want = set()
    for (i, t), (_, o) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        want.add((i, len(t or ""), hashlib.sha256(fingerprint.edited(t or "", o or "").encode()).hexdigest()))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(rows)
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert fingerprint.compare_edits(one).first().edited_sha256 == hashlib.sha256(b"aa").hexdigest()
    assert fingerprint.compare_edits(one.limit(0)).collect() == []


def test_an_edit_deletes_and_inserts_paragraphs():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 5)))
    for _ in range(200):
        a, b = (rnd.choice(["", "\n"]).join(rnd.choice([word() + " ", "\n", "x. "]) for _ in range(rnd.randint(0, 12))) for _ in range(2))
        went, came = fingerprint._tails(a, b)
        own = fingerprint.Fingerprint.of(a)
        new = own - fingerprint.Fingerprint.of_paragraphs(went) + fingerprint.Fingerprint.of_paragraphs(came)
        assert new == fingerprint.Fingerprint.of(fingerprint.edited(a, b)) == fingerprint.Fingerprint.from_hex(new.hex())


def test_likeness_is_the_share_of_phrases(sf_dir):
    """Against the exact share of phrases, counted plainly, for the driver's documents and their edits."""
    from collections import Counter

    import pyarrow.parquet as pq
    import xxhash

    def phrases(text):
        out = Counter()
        for paragraph in text.split("\n"):
            own = []
            for w in paragraph.split():
                own.append(w)
                if xxhash.xxh3_64_intdigest(w) % fingerprint.PHRASE == 0:
                    out[tuple(own)] += 1
                    own = []
            out.update([tuple(own)] if own else [])
        return out

    texts = [t or "" for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column("text").to_pylist()]
    f, errors = fingerprint.Fingerprint.of, []
    for a, b in zip(texts, texts[1:], strict=False):
        for other in (fingerprint.edited(a, b), b):
            one, two = phrases(a), phrases(other)
            want = 1.0 if one == two else sum((one & two).values()) / max(1, sum((one | two).values()))
            errors.append(abs(f(a).likeness(f(other)) - want))
    assert np.quantile(errors, 0.95) < 0.03 and max(errors) < 0.1
    many = lambda n: f("\n".join(["the very same sentence"] * n))
    assert many(40_000).likeness(many(30_000)) == pytest.approx(0.75, abs=0.01)
    long = [f"w{k}" for k in range(300_000)]
    assert f(" ".join(long)).likeness(f(" ".join(long[:200_000]))) == pytest.approx(2 / 3, abs=0.05)


# Lines


def test_cuckoo():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    made = line_dedup.CuckooFilter(3000)
    made.insert(keys)
    assert made.contains(keys).all()
    made.delete(keys[:2500])
    made = line_dedup.CuckooFilter.load(made.dump())
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.01


def test_lines(spark):
    line = "This line is long enough"
    rows = [(1, line), (2, f"  {line.upper()}\t\nshort\nshort"), (3, f"own\n{line}\n{line}"), (4, None), (5, "é" * 19), (6, "é" * 19), (7, "é" * 19), (8, "é" * 20), (9, "é" * 20), (10, "é" * 20 + "\n"), (1, line), (None, line)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int")
    got = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect())
    want = [(0, "", 1, 1), (1, "", 1, 1), (1, "", 1, 1), (2, "short\nshort", 3, 1), (3, f"own\n{line}\n{line}", 3, 0), (4, "", 1, 0)]
    want += [(i, "é" * 19, 1, 0) for i in (5, 6, 7)] + [(8, "", 1, 1), (9, "", 1, 1), (10, "é" * 20 + "\n", 2, 0)]
    assert got == want
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_cuckoo_in_full_buckets():
    """Equal marks and more keys than slots: what is beside the buckets is found, and deleted, as well."""
    keys = np.concatenate([np.arange(50, dtype=np.uint64) * np.uint64(977), np.full(30, 5, np.uint64)])
    made = line_dedup.CuckooFilter(4)
    made.insert(keys)
    assert made.over and made.contains(keys).all()
    made = line_dedup.CuckooFilter.load(made.dump())
    for k in keys:
        assert made.contains(np.array([k])).all()
        made.delete(np.array([k]))
    assert not made.table.any() and not any(made.over.values())


def ledger_tables(x):
    return [sorted(set(map(tuple, t.collect()))) for t in (x.refs, x.counts, x.drops())]


def test_ledger_is_reversible(spark):
    rnd = random.Random(2)
    lines = [f"some quite long line number {k}" for k in range(30)]
    docs = spark.createDataFrame([(i, "\n".join(rnd.choices(lines, k=4))) for i in range(60)], "doc_id long, text string")
    some, rest = docs.where("doc_id < 40"), docs.where("doc_id >= 40")
    ledger = line_dedup.LineLedger.build(some, shards=3)
    grown = ledger.insert(rest)
    whole = line_dedup.LineLedger.build(docs, shards=3)
    assert ledger_tables(grown) == ledger_tables(whole) == ledger_tables(grown.compact())
    back = grown.delete(rest.select("doc_id"))
    assert ledger_tables(back) == ledger_tables(ledger) != ledger_tables(grown)
    odd = spark.createDataFrame([(99,), (None,)], "doc_id long")
    assert ledger_tables(back.delete(odd)) == ledger_tables(ledger)
    assert ledger_tables(ledger.insert(some)) == ledger_tables(ledger)
    assert ledger_tables(ledger.delete(docs.select("doc_id"))) == [[], [], []]


def test_a_change_writes_what_it_touches(spark):
    rows = [(i, f"a line of document number {i}\nanother one, of {i // 4} and others\nthe line that all documents have") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ledger = line_dedup.LineLedger.build(docs, shards=16)
    assert ledger.counts.count() == 501 and ledger.filters.count() == 16
    less = ledger.delete(docs.where("doc_id = 399").select("doc_id"))
    counts, filters = less.written
    assert counts.count() == 3 and filters.count() == 0
    assert less.counts.where("h1 is not null").count() == 500
    fewer = less.delete(docs.where("doc_id = 398").select("doc_id"))
    counts, filters = fewer.written
    assert counts.count() == 3 and filters.count() == 1
    assert ledger_tables(fewer) == ledger_tables(line_dedup.LineLedger.build(docs.where("doc_id < 398"), shards=16))
    again = fewer.insert(docs.where("doc_id >= 398"))
    assert ledger_tables(again) == ledger_tables(ledger)


def test_a_long_text_of_lines(spark):
    own = [f"line number {k} of the long document" for k in range(30_000)]
    docs = spark.createDataFrame([(9, "\n".join(own)), (1, "\n".join(own[:2])), (2, own[1]), (3, "\n".join(own[::-1]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {9: (0, "\n".join(own)), 1: (2, ""), 2: (1, ""), 3: (2, "\n".join(own[:1:-1]))}


def test_many_rows_of_a_null_id(spark):
    same = [(None, f"the line that all documents have\nown line of the row {i}") for i in range(50)]
    docs = spark.createDataFrame([*same, *[(i, same[0][1]) for i in range(3)]], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect())
    want = [(True, f"own line of the row {i}" if i else "", 1 if i else 2) for i in range(50)]
    assert got == sorted([(False, "", 2), (False, "", 2), (False, same[0][1], 0), *want])
