from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from quarry.llm import context_mixing as cm


def brute_cost(tables, text):
    """The same model, a bit at a time."""
    data = bytes(8) + text + b"\0"
    array = np.frombuffer(data, np.uint8)
    found, gate = cm.contexts(array)
    weights = np.full((cm.GATES, cm.PREDICTORS, 8), 0.45 / cm.STEP)
    total, n = 0.0, len(text) + 1
    edges = cm._block_edges(n)
    for low, high in zip(edges, edges[1:], strict=False):
        grad, many = np.zeros_like(weights), Counter()
        for i in range(low, min(high, n)):
            at = 8 + i
            g, byte, node = int(gate[at]), int(array[at]), 1
            many[g] += 1
            for k in range(8):
                z = [float(t[(int(c[at]) << 8) + node]) for t, c in zip(tables, found, strict=True)]
                bit = byte >> (7 - k) & 1
                p = 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights[g, :, k], z, strict=True))))
                total += math.log(p if bit else 1 - p)
                for j in range(cm.PREDICTORS):
                    grad[g, j, k] += (bit - p) * z[j]
                node = node * 2 + bit
        for g, m in many.items():
            weights[g] += cm.RATE / cm.STEP / math.sqrt(m) * grad[g] / cm.STEP
    return total


@pytest.fixture(scope="module")
def scored(make_docs, odd_texts):
    docs = make_docs(odd_texts)
    return docs, {r["doc_id"]: r for r in cm.score_documents(docs).collect()}


def test_base_against_brute_force(scored, odd_texts):
    _, out = scored
    tokens = [(t or "").encode().lower().split() + [None] for t in odd_texts]
    train = Counter(w for k, t in enumerate(tokens) if not cm.held_out(k) for w in t)
    total = sum(train.values())
    assert len(out) == len(odd_texts)
    for k, t in enumerate(tokens):
        r = out[k]
        want = sum(math.log10((train[w] + 1) / (total + len(train) + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (cm.held_out(k), len(t), sum(w in train for w in t), total)
        assert r["base_score"] == pytest.approx(want, rel=1e-12)


def test_base_without_a_head(make_docs, odd_texts, scored, monkeypatch):
    monkeypatch.setattr(cm, "HEAD", 3)  # all but three words go the other way
    for r in cm.score_documents(scored[0]).collect():
        was = scored[1][r["doc_id"]]
        assert r["n_known"] == was["n_known"] and r["base_score"] == pytest.approx(was["base_score"], rel=1e-12)


def test_score_against_a_bit_at_a_time(scored, odd_texts):
    docs, out = scored
    tables = cm.train(docs)[0].tables
    for k in [0, 1, 2, 3, 5, 7, 9, 20]:
        text = (odd_texts[k] or "").encode().lower()
        assert out[k]["score"] == pytest.approx(brute_cost(tables, text) / math.log(10), rel=1e-4)


def test_counts_of_one_text():
    logits = cm.node_logits(np.array([(5 << 8) | 97]), np.array([1000]))
    path = cm.NODES[97]
    assert all((logits[5, node] > 0) == bool(bit) for node, bit in zip(path, cm.BITS[97], strict=True))
    assert not logits[6].any()


def test_held_out_text_like_the_training_is_likelier(make_docs):
    import random

    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["walking", "talking", "singing", "house", "tree"]) for _ in range(80))
    texts = [text() for _ in range(60)]
    other = next(k for k in range(60, 200) if cm.held_out(k))
    out = cm.score_documents(make_docs(texts + ["".join(rng.choice("qxzjkv ") for _ in range(400))], ids=[*range(60), other])).collect()
    held = [r["bits_per_byte"] for r in out if r["held_out"] and r["doc_id"] < 60]
    odd = next(r["bits_per_byte"] for r in out if r["doc_id"] == other)
    assert held and max(held) < 1 < 4 < odd


def test_empty_table(make_docs):
    assert cm.score_documents(make_docs(["a"]).limit(0)).count() == 0
