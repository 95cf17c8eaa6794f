from __future__ import annotations

import random

import pytest

from quarry.operators import graphs
from quarry.plans import fixpoint


@pytest.fixture
def graph(spark):
    def make(text):
        edges = [tuple(ord(c) - 96 for c in e.split(">")) for e in text.split()]
        nodes = sorted({n for e in edges for n in e})
        return spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(edges, "src int, dest int")

    return make


def marks(spark, names):
    return spark.createDataFrame([(ord(c) - 96,) for c in names], "node int")


def groups(reps):
    out = {}
    for r in reps.collect():
        out.setdefault(r["rep"], set()).add(chr(96 + r["node"]))
    return sorted("".join(sorted(v)) for v in out.values())


def test_components(graph):
    assert groups(fixpoint.strong_components(*graph("a>b b>c c>d d>b"))) == ["a", "bcd"]
    eight = "e>a a>b b>e b>f e>f g>f f>g c>g h>g b>c d>c c>d h>d d>h"
    assert groups(fixpoint.strong_components(*graph(eight))) == ["abe", "cdh", "fg"]


def test_drop_marked(spark, graph):
    _, edges = graph("a>b e>b b>c b>d d>e c>e e>f")
    left = {tuple(chr(96 + x) for x in r) for r in graphs.without_marked(edges, marks(spark, "acf")).collect()}
    assert left == {("e", "b"), ("b", "d"), ("d", "e")}


def test_merge_then_fold(spark, graph):
    nodes, edges = graph("a>b e>b b>c b>d d>e c>e e>f")
    merged = graphs.merge_unmarked_components(nodes, edges, marks(spark, "ac"))
    folded = graphs.fold_single(merged, edges, marks(spark, "ac"))
    assert groups(folded) == ["a", "bdef", "c"]
    preds = {(chr(96 + r["dest"]), chr(96 + r["src"])) for r in fixpoint.to_reps(edges, folded).collect()}
    assert preds == {("b", "a"), ("c", "b"), ("b", "c")}


def test_needed(spark, graph):
    nodes, edges = graph("a>b e>b b>c b>d d>e c>e e>f f>g")
    assert {chr(96 + r["node"]) for r in graphs.needed_nodes(nodes, edges, marks(spark, "f")).collect()} == set("abcdef")


def test_levels_reject_cycles(graph):
    assert {(r["node"], r["level"]) for r in fixpoint.levels(*graph("a>b b>c a>c")).collect()} == {(1, 0), (2, 1), (3, 2)}
    with pytest.raises(ValueError, match="cycle"):
        fixpoint.levels(*graph("a>b b>a"))


def test_dominators(graph):
    _, edges = graph("a>b b>c b>d c>e d>e e>f e>b")
    assert {(chr(96 + r["node"]), chr(96 + r["idom"])) for r in fixpoint.dominators(1, edges).collect()} == {("b", "a"), ("c", "b"), ("d", "b"), ("e", "b"), ("f", "e")}


def test_paths_refuse_to_cut(graph):
    _, edges = graph("a>b b>c c>a")
    assert sorted(r["path"] for r in fixpoint.acyclic_paths(1, edges, 5).collect()) == [[1], [1, 2], [1, 2, 3]]
    with pytest.raises(ValueError, match="longer"):
        fixpoint.acyclic_paths(1, edges, 2)


def facts_of(rows):
    pts, copies = {}, {(s, d) for t, s, d, _ in rows if t == 0}
    for t, s, d, _ in rows:
        if t == 3:
            pts.setdefault(d, set()).add(s)
    while True:
        new = {(s, d, o) for s, d in copies for o in pts.get(s, ()) if o not in pts.get(d, ())}
        edges = {(o, d) for t, s, d, _ in rows if t == 1 for o in pts.get(s, ())} | {(s, o) for t, s, d, _ in rows if t == 2 for o in pts.get(d, ())}
        if not new and edges <= copies:
            return {(n, o) for n, objs in pts.items() for o in objs}
        copies |= edges
        for _, d, o in new:
            pts.setdefault(d, set()).add(o)


def test_reduction_keeps_facts_of_live_nodes(spark):
    from quarry.operators import pointsto

    rng = random.Random(2)
    rows = sorted({(rng.choice([0, 0, 0, 1, 2, 3]), rng.randrange(4, 40), rng.randrange(4, 40), 0) for _ in range(60)})
    df = spark.createDataFrame(rows, "ctype int, src int, dest int, offs int")
    assert {tuple(r) for r in pointsto.solve(df)[0].collect()} == facts_of(rows)
    copies = df.where("ctype = 0").select("src", "dest")
    fresh = df.where("ctype <> 0").selectExpr("dest as node").union(df.where("ctype = 3").selectExpr("src as node")).distinct()
    nodes = df.selectExpr("src as node").union(df.selectExpr("dest as node")).distinct()
    for unions in (False, True):
        classes = {}
        # Objects are written through stores as well, so all nodes that any object may be stay apart.
        held = fresh.union(df.where("ctype = 3").selectExpr("src as node")).union(df.where("ctype = 2").selectExpr("src as node")).distinct()
        for r in graphs.value_numbers(nodes, copies, held, unions=unions).collect():
            classes.setdefault(r["cls"], []).append(r["node"])
        facts = facts_of(rows)
        taken = {s for t, s, _, _ in rows if t == 3}
        for cls, members in classes.items():
            sets = {frozenset(o for n, o in facts if n == m) for m in members if m not in taken}
            assert len(sets) <= 1 if cls != -1 else sets <= {frozenset()}
