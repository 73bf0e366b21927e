import random
import re

import pytest

from lattica.llm import _common, near_dup
from lattica.llm.near_dup import near_duplicates, odd_sketch, shingle_hashes, sketch_similarity, minhash


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    low = {i: i for i, _ in rows}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                low[q] = p
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


def corpus(seed=3, families=12, size=14):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(families):
        base = rnd.choices(words, k=rnd.randint(30, 200))
        for _ in range(rnd.randint(1, size)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 20))):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((n * 7 % 1009, " ".join(own)))
            n += 1
    return rows


@pytest.mark.parametrize("block", [8192, 3])
def test_matches_brute_force(spark, block):
    rows = corpus() + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One two"), (2004, "one  TWO"), (2005, "x " * 5000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_shingles string")
    got = near_duplicates(docs, block_rows=block, block_shingles=4_000_000 if block > 3 else 400)
    assert {tuple(r) for r in got.collect()} == brute(rows)


@pytest.mark.parametrize("levels", [0, 3])
def test_a_large_band_of_unlike_rows(spark, monkeypatch, levels):
    """Texts that share most of their shingles, but not three quarters, and clusters among them: bands with hundreds of
    rows of which few are linked to the least one; found by further bands, or by all blocks."""
    monkeypatch.setattr(near_dup, "LEVELS", levels)
    rnd = random.Random(9)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for family in range(40):
        own = [f"f{family}x{k}" for k in range(35)]
        for copy in range(rnd.randint(1, 4)):
            words = common + own + [f"v{len(rows)}"] * (copy > 0)
            rows.append((len(rows) * 31 % 1009, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    anew = near_dup._Links._anew
    monkeypatch.setattr(near_dup._Links, "_anew", lambda self, *a: found.append(a) or anew(self, *a))
    got = near_duplicates(docs, block_rows=16)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert bool(found) == bool(levels)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Each of 32 bands finds the links of a copy again; the steps that make components join a few rows for each copy."""
    rnd = random.Random(5)
    base, rows = [f"w{k}" for k in range(120)], []
    for i in range(250):
        own = list(base)
        own[rnd.randrange(len(own))] = f"x{i}"
        rows.append((i * 7919 % 100003, " ".join(own)))
    joined, join = [], _common.join_hot

    def counted(rows, table, keys, *args, **kwargs):
        out = join(rows, table, keys, *args, **kwargs)
        joined.append(out.count())
        return out

    monkeypatch.setattr(_common, "join_hot", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert sum(joined) <= 2 * len(rows)


def test_a_large_band_with_few_unlike_rows(spark, monkeypatch):
    """Near copies, and a few rows of their bands that aren't linked to them: these meet the blocks, and nothing is dealt
    to further bands."""
    rnd = random.Random(8)
    base, rows = [f"c{k}" for k in range(80)], []
    for i in range(80):
        own = list(base)
        own[rnd.randrange(len(own))] = f"x{i}"
        rows.append((i * 31 % 1009, " ".join(own)))
    rows += [(2000 + i, " ".join(base[:55] + [f"f{i // 2}x{k}" for k in range(35)] + [f"y{i}"])) for i in range(12)]
    called = []
    for name in ("_anew", "_everywhere"):
        monkeypatch.setattr(near_dup._Links, name, lambda *a, f=getattr(near_dup._Links, name), n=name: called.append(n) or f(*a))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=32)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert called == ["_everywhere"]


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "other words here")], "doc_id long, text string"
    )
    got = sorted(map(str, near_duplicates(docs).collect()))
    assert len(got) == 4
    assert sum("component_id=1, kept=True" in x for x in got) == 2
    assert sum("doc_id=None" in x and "component_id=1, kept=False" in x for x in got) == 1
    assert sum("component_id=None, kept=True" in x for x in got) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []


def test_sketch_estimates_similarity():
    import numpy as np
    import pyarrow as pa

    words = [f"w{i}" for i in range(3000)]
    one, two = " ".join(words), " ".join(words[:2800] + [f"v{i}" for i in range(200)])
    h, counts = shingle_hashes(pa.array([one, two]))
    bits = odd_sketch(minhash(h, counts))
    apart = int(np.unpackbits(bits[0] ^ bits[1]).sum())
    a, b = set(h[: counts[0]].tolist()), set(h[counts[0] :].tolist())
    assert abs(float(sketch_similarity(apart)) - len(a & b) / len(a | b)) < 0.15
