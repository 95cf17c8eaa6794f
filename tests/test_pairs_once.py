from __future__ import annotations

from quarry.operators import clients


def test_pairs_are_made_once(spark):
    rows = [(n, o) for n in range(12) for o in range(9) if (n * 7 + o * 5) % 4 < 2 or n == 3]
    facts = spark.createDataFrame(rows, "node int, obj int")
    expected = sorted({(a, b) for a, o in rows for b, p in rows if o == p and a < b})
    for most in (0, 4, 64):
        assert sorted(tuple(r) for r in clients.may_alias_pairs(facts, most).collect()) == expected
