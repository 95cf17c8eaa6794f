from __future__ import annotations

import random

import pytest

from quarry.operators import constraints as cons, graphs, pointsto

INST = "inst long, fn int, op string, dst int, a int, b int, k int, is_ptr boolean, value_type string, pointee string, more array<int>"


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_instruction_rules(spark):
    def of(op, value_type, pointee, more=None):
        row = (7, 1, op, 20, 30, 40, 2, value_type == "ptr", value_type, pointee, more)
        return rows_of(cons.from_instructions(spark.createDataFrame([row], INST), 5000, 9000))

    assert of("load", "ptr", "ptr") == {(1, 30, 20, 0)}
    assert of("load", "int", "ptr") == {(1, 20, 1, 0)}
    assert of("load", "int", "int") == of("load", "float", "ptr") == of("load", "struct", "struct") == set()
    assert of("store", "ptr", "ptr") == {(2, 30, 40, 0)}
    assert of("store", "int", "ptr") == of("store", "int", "struct") == {(2, 1, 40, 0)}
    assert of("store", "int", "int") == of("store", "float", "ptr") == of("store", "struct", "struct") == set()
    assert of("extract", "int", "ptr") == {(0, 3, 1, 0)} and of("insert", "ptr", "ptr") == {(0, 30, 3, 0)}
    assert of("extract", "float", "ptr") == of("insert", "struct", "ptr") == set()
    assert of("phi", "ptr", "ptr", [50, 60]) == {(0, x, 20, 0) for x in (30, 40, 50, 60)}
    assert of("alloca", "ptr", "ptr") == {(3, 9007, 20, 0)}


def external(spark, name, args, ret, n_fields=0, params=()):
    calls = spark.createDataFrame([(2, name, args, ret, n_fields)], "call_id int, name string, args array<int>, ret int, n_fields int")
    known = spark.createDataFrame(list(params), "callee int, param int")
    return rows_of(cons.external_calls(calls, cons.find_models(calls), 100, 1000, 5000, known))


def test_external_models(spark):
    assert external(spark, "who_knows", [11, 12], 13) == {(1, 11, 2, 0), (1, 12, 2, 0), (1, 13, 2, 0)}
    assert external(spark, "who_knows", [11], -1) == {(1, 11, 2, 0)}
    assert external(spark, "pthread_create", [11, 12, 13, 14], -1, params=[(13, 77)]) == {(0, 14, 77, 0)}
    assert external(spark, "pthread_create", [11, 12, 13, 14], -1) == set()
    assert external(spark, "strdup", [11], 13) == {(3, 1002, 13, 0)}
    assert external(spark, "free", [11], -1) == set()
    scalar = external(spark, "llvm.memcpy.p0", [11, 12], -1)
    assert scalar == {(1, 12, 5048, 0), (2, 5048, 11, 0)}
    with pytest.raises(Exception, match="more than 8 fields"):
        external(spark, "llvm.memcpy.p0", [11, 12], -1, n_fields=9)


def test_a_copied_struct_keeps_its_fields_apart(spark):
    """Two structs of two fields; the first, whose fields hold different objects, is copied to the second."""
    copy = external(spark, "memmove", [21, 22], -1, n_fields=2)
    a, b = 200, 300  # the structs, with their second fields at 201 and 301
    rows = [(3, b, 22, 0), (3, a, 21, 0), (0, 22, 31, 0), (0, 22, 32, 1), (3, 400, 33, 0), (3, 500, 34, 0), (2, 33, 31, 0), (2, 34, 32, 0), (0, 21, 41, 0), (0, 21, 42, 1), (1, 41, 51, 0), (1, 42, 52, 0)]
    table = spark.createDataFrame(rows + sorted(copy), "ctype int, src int, dest int, offs int")
    allocs = spark.createDataFrame([(a, 1), (b, 1), (400, 0), (500, 0)], "obj int, max_offs int")
    found = rows_of(pointsto.solve(table, allocs)[0])
    assert {o for n, o in found if n == 51} == {400}
    assert {o for n, o in found if n == 52} == {500}


def test_reduced_rows_and_class_map_give_the_same_facts(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = sorted({(rng.choice([0, 0, 0, 0, 1, 2, 3]), rng.randrange(4, 40), rng.randrange(4, 40), 0) for _ in range(60)})
        df = spark.createDataFrame(rows, "ctype int, src int, dest int, offs int")
        left, reps = graphs.reduce_constraints(df, stop_at=0)
        assert left.count() < len(rows)
        assert rows_of(pointsto.solve(left, reps=reps)[0]) == rows_of(pointsto.solve(df)[0])


def test_fold_into_single_successors(spark):
    edges = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (4, 5), (4, 6)], "src int, dest int")
    nodes = spark.createDataFrame([(k, k) for k in range(1, 7)], "node int, rep int")
    fixed = spark.createDataFrame([(1,)], "node int")
    assert rows_of(graphs.fold_single(nodes, edges, fixed, into="dest")) == {(1, 1), (2, 4), (3, 4), (4, 4), (5, 5), (6, 6)}


def test_collapsing_cycles_keeps_the_facts(spark):
    for seed in (3, 4):
        rng = random.Random(seed)
        rows = sorted({(rng.choice([0, 0, 0, 1, 2, 3]), rng.randrange(4, 30), rng.randrange(4, 30), 0) for _ in range(50)})
        df = spark.createDataFrame(rows, "ctype int, src int, dest int, offs int")
        plain, merged = pointsto.solve(df)[0], pointsto.solve(df, collapse_every=2)[0]
        assert rows_of(merged) == rows_of(plain)
        assert merged.count() == plain.count()
