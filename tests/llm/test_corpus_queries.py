"""Each query over a whole driver table against a plain brute-force version, or its SQL."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica.llm import queries as Q


def rows_of(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").collect()


def ascii_lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(Q.ORACLE[name])
    columns = sorted(want.columns)
    got = Q.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, want.project(",".join(columns)).fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


def test_op1(spark, sf_dir):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    got = {r.page_id: r for r in Q.op1_url_filter(spark, sf_dir).collect()}
    pages = rows_of(spark, sf_dir, "pages")
    assert len(got) == len(pages)
    for p in pages:
        rest = p.url.partition("://")[2]
        host = ascii_lower(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0] + best[1])
        assert r.verdict == best[2] if best else r.verdict in ("allow", "block")


def test_op2(spark, sf_dir):
    from tokenizers import Tokenizer

    told = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    docs = rows_of(spark, sf_dir, "documents")
    got = Q.op2_best_fit_packing(spark, sf_dir).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    want = told.encode_batch([d.text or "" for d in docs], add_special_tokens=False)
    total = 0
    for d, e in zip(docs, want, strict=True):
        ids = [*e.ids, 0]
        total += len(ids)
        own = sorted(by[d.doc_id], key=lambda r: r.piece)
        assert len(own) == -(-len(ids) // 2048)
        for k, r in enumerate(own):
            part = ids[2048 * k : 2048 * k + 2048]
            assert (r.piece, r.start, r.length) == (k, 2048 * k, len(part))
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 3


def test_op3(spark, sf_dir):
    docs = {d.doc_id: d.text or "" for d in rows_of(spark, sf_dir, "documents")}
    got = Q.op3_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    shards, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        shards[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[data].add(r.shard)
    assert set(shards) == set(range(24)) and all(len(g) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len(d) for d in groups) + 8
    assert max(shards.values()) - min(shards.values()) <= largest


def base_spans(text):
    out = []
    assign = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for k, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def judge_secrets(texts, got):
    for i, text in texts.items():
        base = base_spans(text or "")
        r = got[i]
        kinds = [b[3] for b in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        told = [f"{k}:{a}:{b}" for a, _, b, k in base]
        assert r.base_sha256 == sha(",".join(told))
        assert set(told) <= set(r.spans.split(",") if r.spans else [])


def test_op4(spark, sf_dir):
    texts = {d.doc_id: d.text for d in rows_of(spark, sf_dir, "documents")}
    judge_secrets(texts, {r.doc_id: r for r in Q.op4_secret_scan(spark, sf_dir).collect()})


def test_op4_cases(spark, tmp_path):
    texts = {
        1: None, 2: "", 3: "token=abc secret=token: abcdefgh", 4: "é𝒳 API_KEY = 'abcdef' é password:x", 5: "AKIA" + "B" * 15 + " AKIA" + "C" * 16 + "D",
        6: "f" * 23 + " " + "0123456789abcdef" * 2 + "g", 7: "token = token = abcdefg", 8: "token = token = abcdefg", 9: "\n".join(["apikey=zzzzzz"] * 50),
        10: "-----BEGIN RSA PRIVATE KEY-----", 11: "xAKIA" + "9" * 16 + "\nsecret:\"aKIA" + "1" * 30, 12: "passwd" * 1000 + "=1234567",
    }
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in Q.op4_secret_scan(spark, str(tmp_path)).collect()}
    judge_secrets(texts, got)
    assert got[10].spans == "pem:0:31"


def test_op5(spark, sf_dir):
    from test_near_dup import brute

    docs = [(d.doc_id, d.text) for d in rows_of(spark, sf_dir, "documents")]
    assert {tuple(r) for r in Q.op5_near_dedup(spark, sf_dir).collect()} == brute(docs)


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows[tuple(w[k : k + n])].add(i)
    out = set()
    sizes = {len(w) for w in windows}
    for i, t in docs:
        w, hit, held = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    held |= own
                    hit |= set(range(k, k + n))
        told = sha(",".join(sorted(map(str, held))))
        out.add((i, len(w), len(hit), len(held), told, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_op6(spark, sf_dir):
    docs = [(d.doc_id, d.text) for d in rows_of(spark, sf_dir, "documents")]
    items = [(b.item_id, b.text) for b in rows_of(spark, sf_dir, "benchmark")]
    assert {tuple(r) for r in Q.op6_decontaminate(spark, sf_dir).collect()} == brute_hits(docs, items)


@pytest.mark.parametrize("slice_words", [4_000_000, 60])
def test_op6_cases(spark, slice_words):
    from lattica.llm.decontaminate import benchmark_hits, contamination

    long = [f"w{k % 7}" for k in range(40)]
    items = [(1, " ".join(long)), (2, "Short One"), (3, None), (4, "..."), (5, "x"), (10, "éa ÉB " + " ".join(f"q{k}" for k in range(14))), (10, "again same id")]
    docs = [
        (1, None), (2, ""), (3, "a short, ONE b"), (4, " ".join(long)), (5, " ".join(long[:12])), (6, "short"), (7, "x " * 3000), (8, "z " * 500 + "short one"),
        (9, "pre éa ÉB " + " ".join(f"q{k}" for k in range(11)) + " end"), (9, "again same id"),
    ]
    got = benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"), slice_words=slice_words)
    assert {tuple(r) for r in contamination(got).collect()} == brute_hits(docs, items)


def test_op6_without_items(spark):
    from lattica.llm.decontaminate import benchmark_hits, contamination

    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert {tuple(r) for r in contamination(benchmark_hits(docs, items)).collect()} == brute_hits([(1, "some words here"), (2, None)], [])


def test_op7(spark, sf_dir):
    docs = {d.doc_id: d for d in rows_of(spark, sf_dir.replace("0.001", "0.01"), "documents")}
    got = Q.op7_language_id(spark, sf_dir.replace("0.001", "0.01")).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_op9(spark, sf_dir):
    docs = sorted(((d.doc_id, d.text or "") for d in rows_of(spark, sf_dir, "documents")), reverse=True)
    got = {r.doc_id: r for r in Q.op9_fingerprint(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    prints = {}
    for (i, text), (_, other) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        new = text[: len(text) - half] + other[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(new))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(prints.values())) == len(prints)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.8 * len(got)
