from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_query_against_brute_force(make_docs, odd_texts):
    prints = [brute_print(t) for t in odd_texts]
    roots = brute_components(prints)
    out = {r["doc_id"]: r for r in simhash.component_rows(make_docs(odd_texts)).collect()}
    assert len(out) == len(odd_texts)
    for k in range(len(odd_texts)):
        assert (out[k]["fingerprint"], out[k]["component_id"]) == (f"{prints[k]:016x}", roots[k])


def test_every_word_decodes_within_three_errors():
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    low, high, errors = simhash._TABLES
    pattern = errors[low[words & 0xFFF] ^ high[words >> 12]]
    assert max(int(p).bit_count() for p in pattern) <= 3
    right = words ^ pattern
    assert not (low[right & 0xFFF] ^ high[right >> 12]).any()
    found, fresh = simhash.near_indices(words, 23)
    assert fresh.sum(axis=1).max() <= 6


@pytest.mark.parametrize("flips", [0, 1, 2, 3, 4])
def test_keys_meet_for_all_links(flips):
    rng = random.Random(flips)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), flips):
            b ^= 1 << bit
        keys, places, roles = simhash.golay_keys(np.array([a, b], np.uint64))
        one = {(int(k), int(r)) for k, p, r in zip(keys, places, roles, strict=True) if p == 0}
        two = {(int(k), int(r)) for k, p, r in zip(keys, places, roles, strict=True) if p == 1}
        meets = {(simhash.BOTH, simhash.BOTH), (simhash.PROBE, simhash.HELD), (simhash.HELD, simhash.PROBE)}
        assert any(k == j and (r, s) in meets for k, r in one for j, s in two)


def test_components_of_clustered_prints(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 40)):  # a walk: neighbours link, ends don't
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                at ^= 1 << bit
            prints.append(at)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {r["node"]: r["root"] for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()}
    groups = {}
    for p, root in zip(signed, brute_components(prints), strict=True):
        groups.setdefault(root, set()).add(found.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def test_keep_one(make_docs, odd_texts):
    docs = make_docs(odd_texts)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    roots = brute_components([brute_print(t) for t in odd_texts])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))
    assert simhash.keep_one(docs.limit(0)).count() == 0
    twice = simhash.keep_one(make_docs(["same words here", "same words here", None], ids=[5, 5, None]))
    assert sorted((r["doc_id"], r["text"]) for r in twice.where("doc_id = 5").collect()) == [(5, "same words here")]
    assert twice.count() == 2


def test_keep_one_keeps_different_texts_of_null_ids(make_docs):
    texts = ["rivers run slowly past the old mill", "a cat sat on a warm stone wall", "rivers run slowly past the old mill", "nine ships left the port at dawn"]
    kept = simhash.keep_one(make_docs(texts, ids=[None, None, None, 4]))
    assert sorted(r["text"] for r in kept.collect()) == sorted(set(texts))
