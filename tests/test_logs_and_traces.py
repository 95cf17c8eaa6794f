from __future__ import annotations

import pytest

from quarry.operators import clients, constraints, pointsto, slices
from quarry.sources import logs
from quarry.streaming import traces


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_readers(spark):
    assert {tuple(r) for r in logs.read_counts(lines(spark, "1 2", "3 4", "1 5", "")).collect()} == {(1, 7), (3, 4)}
    assert {tuple(r) for r in logs.read_points_to(lines(spark, "1: 4 0 -1", "2: 5 2", "3:", "2: 6", "1: 4")).collect()} == {(1, 4)}
    assert {tuple(r) for r in logs.read_aliases(lines(spark, "1: 2 0", "4: 7")).collect()} == {(1, -1), (4, 7)}
    assert sorted(r["stack"] for r in logs.read_stacks(lines(spark, "1 2", "1", "")).collect()) == [[0, 1], [0, 1, 2]]
    with pytest.raises(Exception, match="repeated id"):
        logs.read_stacks(lines(spark, "1 2 1")).collect()


def test_run_logs_and_merge(spark, tmp_path):
    (tmp_path / "profile.edge.17").write_text("1 2\n")
    (tmp_path / "profile.edge.18").write_text("1 3\n")
    read = logs.read_lines(spark, str(tmp_path / "profile.edge.*"))
    assert {tuple(r) for r in read.collect()} == {("1 2", 17), ("1 3", 18)}
    assert [tuple(r) for r in logs.read_counts(read).collect()] == [(1, 5)]
    assert [r["value"] for r in logs.merge_pairs(lines(spark, "1: 9 3"), lines(spark, "1: 3 4")).collect()] == ["1: 3 4 9"]


def test_prefix_rules(spark):
    seen = spark.createDataFrame([([0, 1, 2],), ([0, 3],)], "stack array<int>")
    assert sorted(r["stack"] for r in logs.prefixes(seen).collect()) == [[0], [0, 1], [0, 1, 2], [0, 3]]
    stacks = spark.createDataFrame([([0], 5), ([0, 1], 6), ([], 5)], "stack array<int>, fn int")
    sites = spark.createDataFrame([(1, 5, 6), (9, 5, 6), (1, 6, 6)], "cs int, fn int, callee int")
    returns = spark.createDataFrame([(6, 77)], "fn int, value int")
    assert sorted(r["stack"] for r in slices.push(stacks, sites, returns, seen).collect()) == [[], [0, 1]]


def events(spark, text):
    rows = [(1, n, *x.split(":")) for n, x in enumerate(text.split())]
    return spark.createDataFrame([(t, n, k, int(i), 0, 0) for t, n, k, i in rows], "thread long, seq long, kind string, id long, addr long, size long")


def test_stack_recorder(spark):
    df = events(spark, "call:1 call:2 call:2 ret:2 call:3 ret:3 ret:1 setjmp:8 call:1 call:4 longjmp:8 call:5 ret:5")
    assert sorted(r["stack"] for r in traces.recorded_stacks(df).collect()) == [[1, 2], [1, 3], [1, 4], [5]]


def test_streams_agree_with_batches(spark, tmp_path):
    for k, part in enumerate(["call:1 call:2 ret:2", "call:3 setjmp:4 call:6 longjmp:4 ret:3 ret:1 call:9 ret:9"]):
        df = events(spark, part).selectExpr("thread", f"seq + {k * 100} as seq", "kind", "id", "addr", "size")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    run = traces.stream_stacks(stream).writeStream.format("memory").queryName("stacks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    run.awaitTermination(120)
    assert {tuple(r["stack"]) for r in spark.table("stacks").collect()} == {tuple(r["stack"]) for r in traces.recorded_stacks(batch).collect()}
    visits = stream.selectExpr("thread", "seq", "'visit' as kind", "id", "addr", "size")
    run = traces.visit_counts(visits).writeStream.format("memory").queryName("visits").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    run.awaitTermination(120)
    want = traces.visit_counts(batch.selectExpr("thread", "seq", "'visit' as kind", "id", "addr", "size"))
    assert {tuple(r) for r in spark.table("visits").collect()} == {tuple(r) for r in want.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows(spark, data):
    return spark.createDataFrame(data, "ctype int, src int, dest int, offs int")


def test_points_to_rules(spark):
    # m = &o; *m = &a; *m = &b: the object holds both.
    facts, _ = pointsto.solve(rows(spark, [(3, 10, 20, 0), (3, 11, 21, 0), (3, 12, 22, 0), (2, 21, 20, 0), (2, 22, 20, 0), (1, 20, 23, 0)]))
    held = {tuple(r) for r in facts.collect()}
    assert {(10, 11), (10, 12), (23, 11), (23, 12)} <= held
    # Fields stay apart, and an offset beyond the object is dropped.
    allocs = spark.createDataFrame([(10, 1), (11, 0)], "obj int, max_offs int")
    facts, _ = pointsto.solve(rows(spark, [(3, 10, 20, 0), (3, 11, 20, 0), (0, 20, 21, 1)]), allocs)
    assert {r["obj"] for r in facts.where("node = 21").collect()} == {11}
    chain = pointsto.provenance(*(lambda f, c: (f, rows(spark, [(3, 10, 20, 0), (0, 20, 21, 0), (0, 21, 22, 0)]), c))(*pointsto.solve(rows(spark, [(3, 10, 20, 0), (0, 20, 21, 0), (0, 21, 22, 0)]))), 22, 10)
    assert chain == [20, 21, 22]


def test_special_ids(spark):
    facts, copies = pointsto.solve(rows(spark, [(3, 1, 20, 0), (3, 0, 21, 0), (1, 20, 22, 0), (2, 23, 20, 0), (3, 30, 23, 0), (0, 23, 0, 0)]))
    assert {tuple(r) for r in facts.collect()} == {(20, 1), (23, 30)}
    assert copies.count() == 0
    with pytest.raises(Exception, match="vaarg"):
        inst = spark.createDataFrame([(1, 1, "vaarg", 1, 2, 3, 0, True, "ptr", "ptr")], "inst long, fn int, op string, dst int, a int, b int, k int, is_ptr boolean, value_type string, pointee string")
        constraints.from_instructions(inst, 0, 0).collect()


def test_alias_null_switch(spark):
    facts = spark.createDataFrame([(5, 0), (6, 0)], "node int, obj int")
    asked, none = spark.createDataFrame([(5, 6)], "p int, q int"), spark.createDataFrame([], "node int")
    assert [clients.alias_answers(asked, facts, none, ignore_null=x).first()["answer"] for x in (False, True)] == ["may", "no"]


def test_noop_names_are_a_parameter(spark):
    names = spark.createDataFrame([("ioctl",), ("xllvm.memcpyx",), ("malloc",)], "name string")
    got = {r["name"]: r["model"] for r in constraints.find_models(names, spark.createDataFrame([("ioctl",)], "name string")).collect()}
    assert got == {"ioctl": "noop", "xllvm.memcpyx": "memcpy", "malloc": "alloc"}
    assert constraints.find_models(names).where("name = 'ioctl'").first()["model"] == "unknown"
