"""Seeds, reach and values of the URL filter's scores."""

import random
from collections import defaultdict

import pytest

from lattica.llm import url_filter


def plain_rank(edges, seeds, damping=0.85, rounds=300):
    """PageRank over a dict of dicts of weights, from seeds (shares that sum to 1); rank of dangling hosts starts anew."""
    score = dict(seeds)
    for _ in range(rounds):
        new = defaultdict(float)
        for u, own in score.items():
            for v, w in edges.get(u, {}).items():
                new[v] += damping * own * w / sum(edges[u].values())
        left = 1 - sum(new.values())
        for h, share in seeds.items():
            new[h] += share * left
        score = new
    return score


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_equal_a_plain_version(spark, seed):
    """Random graphs of hosts with cycles, dangling and uncrawled ones, repeated links, and two alike branches (ties)."""
    rnd = random.Random(seed)
    kinds = [f"h{k}.com" for k in range(18)] + [f"bad{k}.net" for k in range(3)] + [f"good{k}.org" for k in range(3)]
    crawled = [h for h in kinds if not h.startswith("bad2")]
    pages, edges = [], defaultdict(lambda: defaultdict(float))
    for host in crawled:
        for _ in range(rnd.randint(1, 3)):
            to = [] if host == "h5.com" else rnd.choices(kinds, k=rnd.randint(0, 3))
            if host == "h0.com":
                to = ["h1.com", "h2.com"]
            name = rnd.choice([host, f"{host}:80", f"me@{host.upper()}"])
            html = " ".join(f'<a href="http://{rnd.choice(["", "u@"])}{h.upper()}/fr/x">' for h in to)
            pages.append((len(pages), f"http://{name}/fr/{len(pages)}", html))
            for h in to:
                edges[host][h] += h != host
    edges = {u: {v: w for v, w in own.items() if w} for u, own in edges.items()}
    hosts = set(crawled) | {v for own in edges.values() for v in own}
    bad = lambda h: h.startswith("bad")
    # A rule sees the url's host as it is, port included; a host is a seed by the pages whose urls a rule fits.
    named = lambda url: url.split("://")[1].split("/")[0].lower()
    node = lambda url: named(url).split("@")[-1].split(":")[0]
    fits = lambda url, end: named(url).endswith(end)
    count = lambda h, end: sum(node(u) == h and fits(u, end) for _, u, _ in pages)
    all_ = lambda h: sum(node(u) == h for _, u, _ in pages)
    blocked = {h: count(h, ".net") if all_(h) else 1 for h in hosts if bad(h)}
    blocked = {h: n for h, n in blocked.items() if n and 2 * n >= max(1, all_(h))}
    allowed = {h: count(h, ".org") if all_(h) else 1 for h in hosts if h.startswith("good")}
    shares = lambda x: {h: n / sum(x.values()) for h, n in x.items() if n}
    back = defaultdict(dict)
    for u, own in edges.items():
        for v, w in own.items():
            back[v][u] = w
    trust, distrust = plain_rank(edges, shares(allowed)), plain_rank(back, shares(blocked))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(pages)
    for k, url, _ in pages:
        h, r = node(url), got[k]
        assert r.host == named(url)
        assert (r.trust, r.distrust) == pytest.approx((trust.get(h, 0), distrust.get(h, 0)), abs=1e-4)
        want = "allow" if fits(url, ".org") else "block" if fits(url, ".net") else None
        own = distrust.get(h, 0)
        if want or abs(own - trust.get(h, 0)) > 1e-3 and abs(own * len(hosts) - 1) > 1e-2:
            assert r.verdict == (want or ("block" if own > trust.get(h, 0) and own * len(hosts) >= 1 else "allow"))


def test_equal_trust_and_distrust_allow_and_long_pages_count(spark):
    link = lambda h: f'<a href="http://{h}/fr/">'
    pages = [(1, "http://x.com/", link("bad.net")), (2, "http://good.org/fr/", link("x.com")), (3, "http://good.org/fr/", link("x.com"))]
    pages += [(4, "http://y.com/", "z " * 400_000 + link("bad.net")), (5, "http://far.com/", None), (6, "http://farther.com/", "")]
    by = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert by[4].verdict == "block" and by[5].verdict == "allow" and by[1].trust > by[1].distrust and by[1].verdict == "allow"


def test_linked_hosts_without_a_page_are_seeds(spark):
    pages = [
        (1, "http://x.com/", '<a href="http://spam.net/">'), (2, "http://y.com/", "<a href=//u@spam.net:80>"),
        (3, "http://z.com/", '<a href="http://example.com/de/a?b"> <a href="http://example.com/en/a"> <a href="http://example.com/en/b">'),
        (4, "http://w.com/", '<a href="http://example.com/de/a">' * 9), (5, "http://v.com/", '<a href="http://news.org/fr/1">'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    by = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(by) == len(pages)
    assert [by[k].verdict for k in range(1, 6)] == ["block", "block", "allow", "allow", "allow"]
    assert by[1].distrust == by[2].distrust > 0 == by[3].distrust
    links = url_filter.host_links(df).collect()
    assert sorted((r.src, r.path, r.weight) for r in links if r.dst == "example.com") == [("w.com", "/de/a", 9.0), ("z.com", "/de/a", 1.0), ("z.com", "/en/a", 1.0), ("z.com", "/en/b", 1.0)]
    assert [(r.dst, r.path) for r in links if r.src == "y.com"] == [("spam.net", "/")]


def test_scores_reach_the_end_of_a_long_chain(spark):
    n, damping = 24, 0.5
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(n)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", 1.0)], "host string, share double")
    got = {r.host: r.score for r in url_filter.page_rank(edges, seeds, damping, tolerance=1e-8).collect()}
    whole = (1 - damping ** (n + 1)) / (1 - damping)
    want = {f"h{i}": damping**i / whole for i in range(n + 1)}
    assert got.keys() == want.keys() and sum(abs(got[h] - want[h]) for h in want) < 1e-8
