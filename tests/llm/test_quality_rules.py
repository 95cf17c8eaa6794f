from __future__ import annotations

import random
import re
from collections import Counter

from quarry.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts_against_brute_force(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts)
    out = {r["doc_id"]: r for r in q.quality_rules(docs, labels(spark, [])).collect()}
    assert len(out) == len(odd_texts)
    for k, text in enumerate(odd_texts):
        r, want = out[k], brute(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (not r["base_failed"])  # nothing was learned


def test_rules_reject_bad_and_keep_clean(spark, make_docs):
    clean = [" ".join(f"word{(i * 7 + k * 13) % 997}" for k in range(40)) for i in range(120)]
    bad = [" ".join(f"w{(i * 5 + k * 11) % 997}###" for k in range(40)) for i in range(60)]
    docs = make_docs(clean + bad)
    known = labels(spark, [(i, int(i < 120), 0) for i in range(180) if i % 3] + [(None, 0, 0), (3, None, 0)])
    out = {r["doc_id"]: r for r in q.quality_rules(docs, known).collect()}
    assert all(out[i]["kept"] for i in range(120))
    assert not any(out[i]["kept"] for i in range(120, 180))
    kept = q.filter_documents(docs, known)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(120))


def test_empty_tables(spark, make_docs):
    docs = make_docs(["a"]).limit(0)
    assert q.quality_rules(docs, labels(spark, [])).count() == 0
    assert q.filter_documents(docs, labels(spark, [(1, 0, 0)])).count() == 0


def statistics(spark, rows):
    """Rows of (doc_id, bad, mean_word, symbols, upper); the other features are constant."""
    columns = "doc_id long, bad boolean, n_words long, n_repeat_words long, mean_word double, symbols double, dup_lines double, repeats double, upper double, line_words double"
    return spark.createDataFrame([(k, bad, 50, 0, word, symbols, 0.0, 0.0, upper, 20.0) for k, bad, word, symbols, upper in rows], columns)


def test_conjunctions_and_several_rules(spark):
    rng = random.Random(1)
    rows = []
    for k in range(1200):
        near = lambda *at: rng.choice(at) + rng.random() * 0.05
        upper, symbols, word = near(0.1, 0.9), near(0.1, 0.9), near(4, 6) if k % 10 else near(15)
        rows.append((k, (upper > 0.5 and symbols > 0.5) or word > 10, word, symbols, upper))
    rules = q.learn_rules(statistics(spark, rows))
    assert len(rules) >= 2
    assert any({(c.feature, c.above) for c in r} >= {("upper", True), ("symbols", True)} for r in rules)
    assert any(("mean_word", True) in {(c.feature, c.above) for c in r} for r in rules)
    fires = lambda r, row: all((row[c.feature] > c.threshold) == c.above for c in r)
    fired = {True: [], False: []}
    for _, bad, word, symbols, upper in rows:
        row = {"mean_word": word, "symbols": symbols, "upper": upper, "dup_lines": 0.0, "repeats": 0.0, "line_words": 20.0}
        fired[bad].append(any(fires(r, row) for r in rules))
    assert not any(fired[False]) and sum(fired[True]) > 0.9 * len(fired[True]), [[str(c) for c in r] for r in rules]


def test_a_rule_must_hold_on_rows_it_was_not_grown_from(spark):
    held = {r["k"] for r in spark.range(4000).selectExpr("id AS k", "pmod(xxhash64(id), 3) = 0 AS h").where("h").collect()}
    grown = [k for k in range(4000) if k not in held]
    bad = set(grown[:40])  # none of the bad rows is held
    rows = [(k, k in bad, 5.0, 0.9 + k / 1e6 if k in bad else 0.1 + k / 1e6, 0.1) for k in range(4000) if k in bad or k in held or k in grown[40:1000]]
    assert q.learn_rules(statistics(spark, rows)) == []
