from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from quarry.llm import url_filter as u

SCHEMA = "page_id long, url string, html string, host string, score double"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    best = None
    for r in u.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(str(r)) > len(str(best))):
            best = r
    return best


def rank(edges, seeds, rounds=200, damping=0.85):
    total = sum(seeds.values()) or 1
    base = {h: w / total for h, w in seeds.items() if w}
    if not edges:
        return {h: (1 - damping) * b for h, b in base.items()}
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    scores = dict(base)
    for _ in range(rounds):
        new = defaultdict(float)
        for (a, b), n in edges.items():
            new[b] += damping * scores.get(a, 0) * n / out[a]
        for h, b in base.items():
            new[h] += (1 - damping) * b
        scores = new
    return scores


def test_against_brute_force(spark):
    link = lambda *hosts: " ".join(f'<A HREF="http://{h}/x">l</a> <a href="/rel">r</a>' for h in hosts)
    rows = [
        (1, "http://good.org/a", link("friend.net", "Friend.net", "x.com")),
        (2, "https://friend.net/b?q=http://bad.org", link("deep.net")),
        (3, "http://www.example.org/es/1", link("friend.net")),
        (4, "http://deep.net", None),
        (5, "http://suspect.net/z#f", link("www.example.org", "shop.com")),
        (6, "http://shop.com/de/1", "<a href='//friend.net/q'>x</a>"),
        (7, "http://shop.com/fr/1", ""),
        (8, "http://shop.com/en/1", ""),
        (9, "http://EXAMPLE.org/en/12", ""),
        (10, "http://org/x", ""),
        (11, None, link("good.org")),
        (12, "no scheme", ""),
        (13, "a://b.net://c/d", ""),
        (14, "http://example.org?x", ""),
        (1, "http://good.org/a", link("friend.net")),
        (None, "http://far.com/en/", link("shop.com", "shop.com")),
    ]
    found = u.judge_urls(spark.createDataFrame([(*r, "h", 1.0) for r in rows], SCHEMA)).collect()
    assert len(found) == len(rows)
    edges, good, bad = Counter(), Counter(), Counter()
    for _, url, html in rows:
        host, path = parts(url)
        if r := rule_of(host, path):
            (good if r.verdict == "allow" else bad)[host] += 1
        for target in re.findall(r"""(?i)href=["']((?:[a-z]+:)?//[^"']*)""", html or ""):
            to = parts(target if "://" in target else "http:" + target)[0]
            if host and to and host != to:
                edges[host, to] += 1
    trust, distrust = rank(edges, good), rank(Counter({(b, a): n for (a, b), n in edges.items()}), bad)
    want = []
    for page, url, _ in rows:
        host, path = parts(url)
        r = rule_of(host, path)
        by_host = "block" if distrust.get(host, 0) > trust.get(host, 0) else "allow"
        want.append((page, host, path, str(r) if r else None, r.verdict if r else by_host))
    key = lambda r: (str(r[0]), str(r[2]))
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(want, key=key)
    for r in found:
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0)) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0))
    assert next(r for r in found if r["host"] == "suspect.net")["verdict"] == "block"
    assert next(r for r in found if r["host"] == "deep.net")["verdict"] == "allow"


def test_scores_reach_far_hosts(spark):
    rows = [(k, f"http://h{k}.net/", f'<a href="http://h{k + 1}.net/">x</a>', "h", 1.0) for k in range(30)] + [(30, "http://h30.net/", '<a href="http://x.com/">x</a>', "h", 1.0), (31, "http://x.com/de/1", None, "h", 1.0)]
    found = {r["page_id"]: r["verdict"] for r in u.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {k: "block" for k in range(32)}


def test_sql_on_a_linked_graph(spark):
    import duckdb

    from quarry.llm.oracles import urls

    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">l</a>' for h in hosts)
    rows = [(k, f"http://h{k % 9}.{'org' if k % 4 == 0 else 'com' if k % 3 else 'net'}/{'de' if k % 5 == 0 else 'x'}/{k}", link(f"h{k * 7 % 9}.org", f"h{k * 5 % 9}.com", f"h{k % 8}.net"), "h", 1.0) for k in range(60)]
    pages = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toPandas())
    want = con.execute(urls()).fetchall()
    found = [tuple(r) for r in u.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(found, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert {r[4] for r in found if r[3] is None} == {"allow", "block"}


def test_empty_table(spark):
    assert u.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0
