from __future__ import annotations

import math

import duckdb
import pytest

from quarry.operators import graphs, pointsto
from quarry.plans import registry
from quarry.plans.tables import project


@pytest.fixture(scope="module")
def db(sf_dir):
    from pathlib import Path

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted((tuple(None if x is None or (isinstance(x, float) and math.isnan(x)) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = [tuple(r[c] for c in columns) for r in df.collect()]
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]}) q").fetchall()
    assert plain(found) == plain(want)


def relation(spark, sf_dir, sql):
    return [tuple(r) for r in project(spark, sf_dir, sql).collect()]


def folded(edges, fixed, back):
    """Fold one class at a time into its only neighbour, until none is left: the classes."""
    rep = {n: n for e in edges for n in e}
    while True:
        near = {}
        for a, b in edges:
            a, b = (rep[a], rep[b]) if back else (rep[b], rep[a])
            if a != b:
                near.setdefault(b, set()).add(a)
        found = next(((n, next(iter(to))) for n, to in sorted(near.items()) if len(to) == 1 and n not in fixed), None)
        if not found:
            return classes(rep)
        rep = {n: found[1] if r == found[0] else r for n, r in rep.items()}


def classes(rep):
    out = {}
    for n, r in rep.items():
        out.setdefault(r, set()).add(n)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize(("name", "back"), [("folded_predecessors", True), ("folded_successors", False)])
def test_folds_against_brute_force(spark, sf_dir, name, back):
    edges, fixed = relation(spark, sf_dir, registry.SPARSE), {n for (n,) in relation(spark, sf_dir, registry.MARKED)}
    found = {r["node"]: r["rep"] for r in registry.QUERIES[name](spark, sf_dir).collect()}
    assert classes(found) == folded(edges, fixed, back)


def facts_of(rows):
    """Points-to facts of (ctype, src, dest) rows by plain iteration: node -> objects."""
    copies = {(s, d) for t, s, d in rows if t == 0}
    pts = {}
    for t, s, d in rows:
        if t == 3:
            pts.setdefault(d, set()).add(s)
    while True:
        before = len(copies), sum(map(len, pts.values()))
        for t, s, d in rows:
            if t == 1:
                copies |= {(o, d) for o in pts.get(s, ()) if o != d}
            elif t == 2:
                copies |= {(s, o) for o in pts.get(d, ()) if o != s}
        for s, d in copies:
            if s in pts:
                pts.setdefault(d, set()).update(pts[s])
        if before == (len(copies), sum(map(len, pts.values()))):
            return pts


def test_reductions_keep_the_facts(spark, sf_dir):
    rows = [r[:3] for r in relation(spark, sf_dir, registry.CONS)]
    want, objects = facts_of(rows), {s for t, s, _ in rows if t == 3}
    numbers = {}
    for r in registry.QUERIES["value_numbering"](spark, sf_dir).collect():
        numbers.setdefault(r["cls"], []).append(r["node"])
    held = objects | {s for t, s, _ in rows if t == 2}
    for cls, members in numbers.items():
        sets = {frozenset(want.get(n, ())) for n in members if n not in held}
        assert sets <= {frozenset()} if cls == -1 else len(sets) <= 1
    left, reps = graphs.reduce_constraints(project(spark, sf_dir, registry.CONS))
    after = [tuple(r) for r in left.select("ctype", "src", "dest").collect()]
    assert sorted(after) == sorted((r["ctype"], r["src"], r["dest"]) for r in registry.QUERIES["reduced_constraints"](spark, sf_dir).collect())
    assert len(after) < len(rows)
    assert {tuple(r) for r in pointsto.solve(left, reps=reps)[0].collect()} == {(n, o) for n, objs in want.items() for o in objs}


def test_recorded_stacks_and_checks(spark, sf_dir):
    stacks = {r["stack"] for r in registry.QUERIES["recorded_stacks"](spark, sf_dir).collect()}
    sites = {k for _, k in relation(spark, sf_dir, "SELECT DISTINCT kind, id FROM (" + registry.STACK_EVENTS + ") e WHERE kind = 'call'")}
    assert stacks and all({int(x) for x in s.split()} <= sites | {0} for s in stacks)
    hit = {r["stack"] for r in registry.QUERIES["stack_checks"](spark, sf_dir).collect()}
    invalid = {s for s in stacks if len(s.split()) == 2 and s.split()[0] == "1"}
    assert hit == {s for s in stacks if any(" ".join(s.split()[:n]) in invalid for n in range(1, len(s.split()) + 1))}


def test_every_query_without_sql_has_a_test_here():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"folded_predecessors", "folded_successors", "value_numbering", "reduced_constraints", "recorded_stacks", "stack_checks"}


def test_entry_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert registry.FLAGSHIP in __spark_entry__.queries()
