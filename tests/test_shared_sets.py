from __future__ import annotations

from quarry.operators import assumptions


def test_shared_sets_are_asked_as_sets(spark):
    live = spark.createDataFrame([(1, 4096, 4100, 0, 9), (2, 8192, 8200, 0, 9)], "obj long, start long, stop long, born long, died long")
    accesses = spark.createDataFrame([(7, 4097, 1), (7, 8193, 1), (8, 4097, 1), (9, 8193, 1), (9, 0, 1)], "ptr long, addr long, seq long")
    allowed = spark.createDataFrame([(7, 1), (9, 2)], "ptr long, set_id long")
    members = spark.createDataFrame([(1, 1), (2, 2)], "set_id long, obj long")
    arrays = spark.createDataFrame([(7, [1]), (9, [2])], "ptr long, objs array<long>")
    by_set = {tuple(r) for r in assumptions.set_violations(accesses, live, allowed, members).collect()}
    assert by_set == {tuple(r) for r in assumptions.set_violations(accesses, live, arrays).collect()} == {(7, 8193), (8, 4097)}
