from __future__ import annotations

import random

import corpus_pipeline
import xxhash
from quarry.llm import near_copies


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_roots(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def test_stage_against_brute_force(spark, make_docs, odd_texts):
    rng = random.Random(11)
    line = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, texts = line(30), list(odd_texts)
    for n in (1, 3, 5, 6, 9, 14, 40, 120, 300):
        for _ in range(3):
            base = line(n)
            for edits in range(0, n // 15 + 3):  # similarities on both sides of the bound
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(n)] = "new" + str(rng.randrange(9))
                texts.append(" ".join(copy))
    texts += [" ".join(line(6) + passage + line(k)) for k in range(12)]  # a common passage
    texts += [" ".join(passage + line(1)) for _ in range(40)]  # a group of near copies
    rng.shuffle(texts)
    kept = corpus_pipeline.near_duplicates(spark, make_docs(texts), "")
    want = brute_roots(texts)
    assert 0 < len(want) < len(set(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_null_ids_and_empty(make_docs):
    docs = make_docs(["a b c d e f g h", "one two three", "a b c d e f g h", None, ""], ids=[None, None, None, 3, None])
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["text"] or "") for r in kept.collect()) == ["", "a b c d e f g h", "one two three"]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def brute_print(text):
    hashes = [xxhash.xxh64_intdigest(s) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {frozenset(k for k in range(n) if find(k) == r) for r in range(n) if find(r) == r}


def edited_texts():
    """Different sets of shingles, edited in few and many places, also in groups, and repeats that leave a set as it is."""
    rng, texts = random.Random(5), []
    for n, most in ((25, 2), (60, 3), (400, 12), (900, 20)):
        for _ in range(5):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            for edits in range(most):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(n)] = "new" + str(rng.randrange(9))
                texts.append(" ".join(copy))
    # A round of one passage has the same set however often it is gone through.
    wheel = [f"r{k}" for k in range(12)]
    texts += [" ".join(wheel * 2 + wheel[:4]), " ".join(wheel * 5 + wheel[:4]), " ".join([*wheel * 3, *wheel[:4], "end"])]
    return texts


def test_golay_keys_decide_links_of_few_bits_and_the_rest_the_others(spark, make_docs, monkeypatch):
    texts = edited_texts()
    sets, prints, n = [shingles(t) for t in texts], [brute_print(t) for t in texts], len(texts)
    docs = make_docs(texts)
    keyed = near_copies.settle(near_copies.prefixes(docs), "test-keys")
    rows = {r["doc_id"]: r for r in keyed.collect()}
    assert [rows[k]["print"] % (1 << 64) for k in range(n)] == prints

    def groups(found):
        root = {r["node"]: r["root"] for r in found.collect()}
        out = {}
        for k in range(n):
            out.setdefault(root.get(rows[k]["same"], rows[k]["same"]), set()).add(k)
        return {frozenset(g) for g in out.values()}

    linked = [(i, j) for i in range(n) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    close = [(i, j) for i, j in linked if (prints[i] ^ prints[j]).bit_count() <= 4]
    far = [(i, j) for i, j in linked if (prints[i] ^ prints[j]).bit_count() > 4 or sets[i] == sets[j]]
    assert components_of(close, n) != components_of(linked, n) != components_of(far, n)
    assert groups(near_copies.close_links(docs, keyed)) == components_of(close, n)
    assert groups(near_copies.links(docs, keyed)) == components_of(linked, n)
    # The second step is no other way to the links of the first.
    monkeypatch.setattr(near_copies, "close_links", lambda *_: spark.createDataFrame([], "node long, root long"))
    assert groups(near_copies.links(docs, keyed)) == components_of(far, n)
