from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import line_dedup as ld


def words(line):
    return line.encode().decode().translate({9: 32, 11: 32, 12: 32, 13: 32}).split(" ") and [w for w in line.translate({9: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]


def distance_at_most_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(texts, ids=None, least=10):
    ids = ids or list(range(len(texts)))
    places = sorted((i, n, words(x)) for i, t in zip(ids, texts, strict=True) if t is not None for n, x in enumerate(t.split("\n")))
    first = {}
    for i, n, w in places:
        if w:
            first.setdefault(tuple(w), (i, n))
    near = {w for w, at in first.items() for v, was in first.items() if min(len(w), len(v)) >= least and was < at and distance_at_most_one(list(w), list(v))}
    out = []
    for i, t in zip(ids, texts, strict=True):
        if t is None:
            out.append(None)
            continue
        kept = [x for n, x in enumerate(t.split("\n")) if not (w := words(x)) or (tuple(w) not in near and first[tuple(w)] == (i, n))]
        out.append("\n".join(kept))
    return out


def check(docs, texts, ids=None):
    found = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs).collect()}
    want = brute(texts, ids)
    for k, w in zip(ids or range(len(texts)), want, strict=True):
        assert found[k] == w, k
    return want


def test_against_brute_force(make_docs, odd_texts):
    docs = make_docs(odd_texts)
    want = check(docs, odd_texts)
    assert want != odd_texts
    out = ld.dedup_lines(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_edits_of_every_kind_and_length(make_docs):
    rng = random.Random(5)
    texts = []
    for n in (9, 10, 11, 15, 16, 17, 18, 19, 30):
        for _ in range(4):
            base = [f"w{rng.randrange(50)}" for _ in range(n)]
            at = rng.randrange(n)
            texts += [" ".join(base), " ".join(base[:at] + ["new"] + base[at + 1 :]), " ".join(base[:at] + base[at + 1 :]), " ".join(base[:at] + ["add"] + base[at:])]
            texts += [" ".join(["p", "q"] + base[2:]), " ".join(base) + "\n" + " ".join(base[::-1]), "a a " + " ".join(base), " ".join(base[-1:] + base[:-1])]
    texts += [f"this is line number {k} of many that are all the same otherwise" for k in range(40)]
    rng.shuffle(texts)
    check(make_docs(texts), texts)


def test_report_null_ids_and_empty(spark, make_docs):
    long = " ".join(f"w{k}" for k in range(12))
    docs = make_docs([long, long, None, ""], ids=[3, None, 5, 6])
    out = {r["doc_id"]: r for r in ld.line_report(docs).collect()}
    assert (out[3]["n_dropped"], out[None]["n_dropped"]) == (0, 1)
    assert (out[5]["n_lines"], out[6]["n_lines"], out[None]["kept_chars"]) == (0, 1, 0)
    assert ld.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("x", "y", "near"), [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a c", True), ("a c", "a b c", True), ("a b c", "c b a", False), ("a b", "a b c d", False), ("a", "b", True), ("", "a", True), ("a a b", "a b", True)])
def test_one_edit(spark, x, y, near):
    row = spark.createDataFrame([(x.split(), y.split())], "x array<string>, y array<string>").select(ld.within_one_edit(F.col("x"), F.col("y")).alias("n")).first()
    assert row["n"] == near


def test_rows_that_share_an_id_are_documents_of_their_own(make_docs):
    line = lambda tag: " ".join(f"{tag}{k}" for k in range(12))
    texts = [line("a") + "\n" + line("b"), line("a") + "\n" + line("c"), line("d") + "\n" + line("e"), line("f"), line("f"), line("g"), line("g") + " x\n" + line("h")]
    ids = [1, None, None, -5, -5, None, None]
    out = [r["text"] for r in ld.dedup_lines(make_docs(texts, ids=ids)).collect()]
    # The lines g differ by one word: the later of the two rows loses its own, whichever that is.
    g = [line("g"), line("h")], ["", line("g") + " x\n" + line("h")]
    want = [texts[0], line("c"), texts[2], line("f"), ""]
    assert sorted(out) in [sorted([*want, *x]) for x in g]


def test_copies_of_short_lines_go(spark, make_docs, odd_texts):
    texts = [*odd_texts, "short\n\n a  b\nlong enough " + " ".join(f"v{k}" for k in range(9)), "a b\nshort\n \na c", "one\na b c d e f g h i", "a b c d e f g h x\na b c d e f g h i"]
    want = check(make_docs(texts), texts)
    assert corpus_pipeline.lines(spark, make_docs(texts), "").where(f"doc_id = {len(odd_texts) + 1}").first()["text"] == want[len(odd_texts) + 1] == " \na c"


def test_ids_too_far_apart_for_longs(make_docs):
    line = " ".join(f"w{k}" for k in range(12))
    texts, ids = [line + "\nx", "x\n" + line + " y", line.replace("w3", "q") + "\nz", line, "z"], [(1 << 63) - 1, -(1 << 63), 5, None, None]
    rows, at = ld.numbered(make_docs(texts, ids=ids))
    assert at.kind == "decimal(38,0)" and rows.select("_doc").distinct().count() == 5
    out = {(r["doc_id"], r["text"]) for r in ld.dedup_lines(make_docs(texts, ids=ids)).collect()}
    assert out == {(ids[1], texts[1]), (5, texts[2]), (ids[0], ""), (None, "")}
    assert ld.numbered(make_docs(texts))[1].kind == "long"
