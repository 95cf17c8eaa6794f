from __future__ import annotations

import random

from quarry.operators import graphs
from quarry.plans import fixpoint


def test_components_of_any_size_are_numbered_alike(spark):
    rng = random.Random(1)
    edges = sorted({(rng.randrange(20), rng.randrange(20)) for _ in range(22)})
    es = spark.createDataFrame(edges, "src int, dest int")
    nodes, fresh = spark.range(24).selectExpr("int(id) as node"), spark.range(0, 24, 3).selectExpr("int(id) as node")
    ends = {n for e in edges for n in e}
    reach = {n: {n} for n in range(24)}
    while any(reach[b] - reach[a] for a, b in edges):
        for a, b in edges:
            reach[a] |= reach[b]
    sets = {n: frozenset(m for m in range(0, 24, 3) if n in reach[m]) for n in range(24)}
    # A component's own labels are one.
    rep = {n: min(m for m in range(24) if n in reach[m] and m in reach[n]) for n in range(24)}
    sets = {n: frozenset(rep[m] for m in s) for n, s in sets.items()}
    expected = {(n, min(m for m in range(24) if sets[m] == sets[n]) if sets[n] else -1) for n in range(24)}
    one = {tuple(r) for r in graphs.value_numbers(nodes, es, fresh, unions=True).collect()}
    by_level = {tuple(r) for r in graphs.value_numbers(nodes, es, fresh, unions=True, most=0).collect()}
    assert ends and one == expected and by_level == expected
    assert {tuple(r) for r in fixpoint.strong_components(nodes, es, most=0).collect()} == set(rep.items())
