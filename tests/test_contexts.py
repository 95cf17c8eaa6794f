from __future__ import annotations

from quarry.operators import slices


def test_popped_pairs_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(slices, "PAIRS", 100)
    sites = [(c, c % 2) for c in range(60)]
    stacks = spark.createDataFrame([([c, (c * 7) % 60], 0) for c in range(60)] + [([5], 0), ([], 3)], "stack array<int>, fn int")
    out = slices.pop(stacks, spark.createDataFrame(sites, "cs int, rep int"), spark.createDataFrame([(3, 1), (3, 2)], "fn int, cs int"))
    rows = [(tuple(r["stack"]), r["cs"]) for r in out.collect()]
    expected = {((c,), s) for c in range(60) for s, rep in sites if rep == (c * 7) % 60 % 2} | {((), s) for s, rep in sites if rep == 1} | {((), 1), ((), 2)}
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert out.rdd.getNumPartitions() > 10
