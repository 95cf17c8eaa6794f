from __future__ import annotations

import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quarry.llm import mixing as m


def test_targets_reshare_the_excess():
    got = m.targets([10, 100, 100], [3, 1, 2])
    assert got[0] == 20 and sum(got) == pytest.approx(315)
    assert got[2] == pytest.approx(2 * got[1]) or got[2] == 200
    assert m.targets([], []) == []
    assert m.targets([0, 0], [3, 1]) == [0.0, 0.0]


def test_quotas_are_exact_and_even():
    counts = [1000, 10, 0, 333]
    quotas = np.array(m.split_quotas(counts, 7, 1))
    assert quotas.sum(axis=0).tolist() == counts
    assert quotas.sum(axis=1).max() - quotas.sum(axis=1).min() <= 3
    assert m.split_quotas(counts, 7, 1) == quotas.tolist()


def test_quotas_follow_the_hypergeometric_law():
    draws = [m.split_quotas([30, 70], 2, seed)[0][0] for seed in range(600)]
    mean, var = 15, 50 * 0.3 * 0.7 * 50 / 99
    assert abs(np.mean(draws) - mean) < 4 * (var / 600) ** 0.5
    assert 0.75 < np.var(draws) / var < 1.3


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    return [" ".join("w" for _ in range(n)) for n in rng.integers(0, 30, 900)] + [None, "", "x y", "x y", "x y"]


def test_report_against_brute_force(make_docs, texts):
    sources = [["src2", "src10", None, "é", "a"][k * k % 5] for k in range(len(texts))]
    settings = m.Settings(rows_per_block=16, shards=8)
    docs = make_docs(texts, sources)
    out = {r["doc_id"]: r for r in m.mix_report(docs, settings).collect()}
    sizes = Counter()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    for s, n in zip(sources, size, strict=True):
        sizes[s] += n
    order = sorted({s for s in sources if s is not None}) + [None]
    wanted = dict(zip(order, m.targets([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for k, s in enumerate(sources):
        r = out[k]
        assert (r["size"], r["source_size"]) == (size[k], sizes[s])
        assert r["target"] == pytest.approx(wanted[s])
        assert r["taken"] in (0, size[k], 2 * size[k])
        taken[s] += r["taken"]
    assert len(out) == len(texts)
    for s in order:
        assert abs(taken[s] - wanted[s]) <= max(size)
    again = {r["doc_id"]: r["taken"] for r in m.mix_report(docs.repartition(7), settings).collect()}
    assert again == {k: r["taken"] for k, r in out.items()}


def order_hash(block, seed):
    out = xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=xxhash.xxh64_intdigest(struct.pack("<q", block), seed=42))
    return out - (1 << 64) if out >> 63 else out


def brute_copies(rows, settings):
    """Copies of each of the rows (id, source, hash, size), by walking each source's blocks in their order."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    order = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
    sizes = [sum(r[3] for r in by_source[s]) for s in order]
    wanted = m.targets(sizes, [settings.weights[k % 3] for k in range(len(order))], settings.percent)
    out = {}
    for s, size, target in zip(order, sizes, wanted, strict=True):
        n = settings.block_count(len(by_source[s]), len(rows))
        blocks = defaultdict(list)
        for r in by_source[s]:
            blocks[r[2] % n].append(r)
        passes, at = (int(target // size) if size else 0), 0
        part = target - passes * size
        for block in sorted(blocks, key=lambda b: (order_hash(b, settings.seed), b)):
            words, run = sum(r[3] for r in blocks[block]), at
            for r in sorted(blocks[block], key=lambda r: r[2]):
                more = part >= at + words or run + r[3] / 2 <= part if at < part else False
                out[r[0]] = passes + more
                run += r[3]
            at += words
    return out


def test_taken_documents_against_brute_force(make_docs, texts):
    settings = m.Settings(rows_per_block=16, shards=8)
    docs = make_docs(texts, [["b", None, "a"][k % 3] for k in range(len(texts))])
    slim = [(r["doc_id"], r["_source"], r["_h"], r["size"]) for r in m.slim_rows(docs, settings).collect()]
    found = {r["doc_id"]: len(r["shards"]) for r in m.mix_report(docs, settings).collect()}
    want = brute_copies(slim, settings)
    assert found == want and set(want.values()) >= {0, 1, 2}


def test_equal_rows_are_taken_in_part(make_docs):
    docs = make_docs(["a b c"] * 90 + ["x y"] * 90, ["s"] * 90 + ["t"] * 90, ids=[None] * 90 + list(range(90)))
    out = m.mix_report(docs).collect()
    taken = Counter()
    for r in out:
        taken[r["source_size"]] += r["taken"]
    for r in out:
        assert abs(taken[r["source_size"]] - r["target"]) <= 3
    assert m.mix(docs).count() == sum(len(r["shards"]) for r in out)


def test_mix_takes_rows_as_often_as_reported(make_docs, texts):
    docs = make_docs(texts)
    out = m.mix(docs)
    assert out.columns == docs.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == Counter({r["doc_id"]: len(r["shards"]) for r in m.mix_report(docs).collect() if r["shards"]})
    equal = make_docs(["a b"] * 6 + ["c"], ["s"] * 7, ids=[1] * 6 + [2])
    assert Counter(r["doc_id"] for r in m.mix(equal).collect()) == Counter(r["doc_id"] for r in m.mix_report(equal).collect() for _ in r["shards"])


def test_empty_and_wordless(make_docs):
    assert m.mix_report(make_docs(["a"]).limit(0)).count() == 0
    assert m.mix(make_docs(["a"]).limit(0)).count() == 0
    assert [r["taken"] for r in m.mix_report(make_docs([None, ""])).collect()] == [0, 0]
