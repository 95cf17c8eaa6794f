"""Client queries over facts and profiles: alias relations, censuses, soundness, usage and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.plans.tables import settle
from quarry.sources.logs import NULL_ID, UNKNOWN


def alias_answers(pairs: DataFrame, facts: DataFrame, int_pointers: DataFrame, ignore_null: bool = False) -> DataFrame:
    """``p, q, answer`` of asked pairs: No for constants made from ints, empty or disjoint sets, else May."""
    known = facts.where(F.col("obj") != NULL_ID) if ignore_null else facts
    known = known.select("node", "obj").distinct()
    asked = pairs.select("p", "q").distinct()
    shared = asked.join(known.select(F.col("node").alias("p"), "obj"), "p").join(known.select(F.col("node").alias("q"), "obj"), ["q", "obj"]).select("p", "q").distinct()
    ints = int_pointers.select("node")
    ok = shared.join(ints.select(F.col("node").alias("p")), "p", "left_anti").join(ints.select(F.col("node").alias("q")), "q", "left_anti")
    return asked.join(ok.withColumn("may", F.lit(True)), ["p", "q"], "left").select("p", "q", F.when(F.col("may"), "may").otherwise("no").alias("answer"))


def first_answer(*answers: DataFrame) -> DataFrame:
    """The first analysis' answer that there is (``p, q, answer`` each, nulls abstain), else May."""
    out = answers[0].withColumnRenamed("answer", "a0")
    for k, more in enumerate(answers[1:], 1):
        out = out.join(more.withColumnRenamed("answer", f"a{k}"), ["p", "q"], "full")
    return out.select("p", "q", F.coalesce(*(f"a{k}" for k in range(len(answers))), F.lit("may")).alias("answer"))


#: Objects of a node up to which its rows carry the lesser ones along.
MOST_CARRIED = 64


def may_alias_pairs(facts: DataFrame, most: int = MOST_CARRIED) -> DataFrame:
    """Distinct pairs p < q that share an object. Its size is the answer's; for counts use the census.

    A pair is made once, at the least object that both hold: each row of a node of at most ``most`` objects carries the
    lesser ones. Only pairs with a node of more objects are shuffled to be made distinct.
    """
    sets = facts.groupBy("node").agg(F.collect_set("obj").alias("objs"))
    small = F.size("objs") <= most
    each = settle(sets.select("node", F.when(small, F.col("objs")).alias("objs"), F.explode("objs").alias("obj")), "alias-rows")
    each = each.select("node", "obj", F.filter("objs", lambda x: x < F.col("obj")).alias("less"))  # null: too many
    p, q = each.select(F.col("node").alias("p"), "obj", F.col("less").alias("a")), each.select(F.col("node").alias("q"), "obj", F.col("less").alias("b"))
    met = p.join(q, "obj").where("p < q")
    once = met.where(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.arrays_overlap("a", "b")).select("p", "q")
    large = each.where("less is null")
    big = large.select(F.col("node").alias("n"), "obj")
    rest = each.join(big, "obj").where("node <> n").select(F.least("node", "n").alias("p"), F.greatest("node", "n").alias("q")).distinct()
    return once if large.isEmpty() else once.union(rest)


def object_signatures(facts: DataFrame) -> DataFrame:
    """``node, sig``: nodes of equal sets share a signature."""
    sets = facts.groupBy("node").agg(F.array_sort(F.collect_set("obj")).alias("objs"))
    return sets.select("node", "objs", F.md5(F.array_join(F.transform("objs", lambda x: x.cast("string")), ",")).alias("sig"))


def alias_census(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """``checked, may, no`` over all pairs i < j: pairs of equal sets are counted by class, others by pairs of classes that
    share an object, each made once, at the least object that they share, and summed at once."""
    sig = object_signatures(facts.join(nodes, "node", "left_semi"))
    classes = settle(sig.groupBy("sig").agg(F.count("*").alias("n"), F.first("objs").alias("objs")), "classes")
    each = classes.select("sig", "n", "objs", F.explode("objs").alias("obj"))
    others = each.select(F.col("sig").alias("sig2"), F.col("n").alias("n2"), F.col("objs").alias("objs2"), "obj")
    across = each.join(others, "obj").where((F.col("sig") < F.col("sig2")) & (F.array_min(F.array_intersect("objs", "objs2")) == F.col("obj")))
    own = classes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("own"))
    other = across.agg(F.coalesce(F.sum(F.col("n") * F.col("n2")), F.lit(0)).alias("other"))
    total = nodes.select("node").distinct().agg(F.expr("count(*) * (count(*) - 1) div 2").cast("long").alias("checked"))
    return total.join(own).join(other).select("checked", (F.col("own") + F.col("other")).cast("long").alias("may"), (F.col("checked") - F.col("own") - F.col("other")).cast("long").alias("no"))


def load_store_census(loads: DataFrame, stores: DataFrame, facts: DataFrame) -> DataFrame:
    """``checked, may, no`` over all pairs of loads and stores (``inst, ptr``), counted by pointer."""
    l, s = (d.groupBy("ptr").agg(F.count("*").alias(n)) for d, n in ((loads, "nl"), (stores, "ns")))  # noqa: E741
    asked = l.select("ptr").union(s.select("ptr")).distinct()
    sets = settle(facts.select(F.col("node").alias("ptr"), "obj").join(asked, "ptr", "left_semi").groupBy("ptr").agg(F.collect_set("obj").alias("objs")), "pointer-sets")
    one, two = (d.join(sets, "ptr").select(n, F.col("objs").alias(o), F.explode("objs").alias("obj")) for d, n, o in ((l, "nl", "x"), (s, "ns", "y")))
    # A pair of pointers counts at the least object that they share.
    met = one.join(two, "obj").where(F.array_min(F.array_intersect("x", "y")) == F.col("obj"))
    may = met.agg(F.coalesce(F.sum(F.col("nl") * F.col("ns")), F.lit(0)).cast("long").alias("may"))
    both = loads.agg(F.count("*").alias("a")).join(stores.agg(F.count("*").alias("b")))
    return both.join(may).select((F.col("a") * F.col("b")).alias("checked"), "may", (F.col("a") * F.col("b") - F.col("may")).alias("no"))


def dynamic_census(asked: DataFrame, seen: DataFrame) -> DataFrame:
    """``checked, may, no`` over all pairs of the loads and the stores in ``asked``: those seen together may alias. Only seen
    pairs are made."""
    loads, stores = asked.select("load").distinct(), asked.select("store").distinct()
    met = seen.select("load", "store").distinct().join(loads, "load", "left_semi").join(stores, "store", "left_semi")
    both = loads.agg(F.count("*").alias("a")).join(stores.agg(F.count("*").alias("b"))).join(met.agg(F.count("*").alias("may")))  # one row each
    return both.select((F.col("a") * F.col("b")).alias("checked"), "may", (F.col("a") * F.col("b") - F.col("may")).alias("no"))


def dynamic_alias(pairs: DataFrame, seen: DataFrame, static: DataFrame) -> DataFrame:
    """``load, store, answer``: a load that was never seen answers false; one with an unknown store asks ``static``
    (``load, store``); else whether the store was seen."""
    loads = seen.groupBy("load").agg((F.min("store") == UNKNOWN).alias("open"))
    out = pairs.select("load", "store").distinct().join(loads, "load", "left")
    out = out.join(seen.distinct().withColumn("met", F.lit(True)), ["load", "store"], "left").join(static.select("load", "store").distinct().withColumn("may", F.lit(True)), ["load", "store"], "left")
    answer = F.when(F.col("open").isNull(), F.lit(False)).when(F.col("open"), F.coalesce("may", F.lit(False))).otherwise(F.coalesce("met", F.lit(False)))
    return out.select("load", "store", answer.alias("answer"))


def unsound_pairs(seen: DataFrame, static: DataFrame, used_loads: DataFrame, used_stores: DataFrame) -> DataFrame:
    """Load and store pairs that ran together though the static analysis says they cannot."""
    real = seen.where(F.col("store") != UNKNOWN).distinct().join(used_loads, "load", "left_semi").join(used_stores, "store", "left_semi")
    return real.join(static, ["load", "store"], "left_anti")


def soundness(seen: DataFrame, static: DataFrame, used_loads: DataFrame, used_stores: DataFrame) -> DataFrame:
    """``good_loads, good_stores, bad_pairs``."""
    bad = settle(unsound_pairs(seen, static, used_loads, used_stores), "bad")
    real = seen.where(F.col("store") != UNKNOWN).distinct().join(used_loads, "load", "left_semi").join(used_stores, "store", "left_semi")
    good = real.join(bad.select("load"), "load", "left_anti").agg(F.countDistinct("load").alias("good_loads"))
    good_s = real.join(bad.select("store"), "store", "left_anti").agg(F.countDistinct("store").alias("good_stores"))
    return good.join(good_s).join(bad.agg(F.count("*").alias("bad_pairs")))


def used_blocks(blocks: DataFrame, counts: DataFrame | None, enabled: bool = True) -> DataFrame:
    """Blocks that ran; without a profile, or with it switched off, all of them."""
    if counts is None or not enabled:
        return blocks.select("bb")
    return blocks.join(counts.where("cnt >= 1"), "bb", "left_semi").select("bb")


def used_functions(functions: DataFrame, entries: DataFrame, counts: DataFrame | None, enabled: bool = True) -> DataFrame:
    """``fn``: main, declarations, and functions whose entry block ran (``fn, is_main, is_declaration``; ``fn, bb``)."""
    if counts is None or not enabled:
        return functions.select("fn")
    ran = entries.join(counts.where("cnt >= 1"), "bb", "left_semi").select("fn")
    return functions.where("is_main or is_declaration").select("fn").union(functions.join(ran, "fn", "left_semi").select("fn")).distinct()


def invariants(counts: DataFrame, targets: DataFrame, stacks: DataFrame) -> DataFrame:
    """``used_blocks, targets, stacks``."""
    used = counts.where("cnt >= 1").agg(F.countDistinct("bb").alias("used_blocks"))
    return used.join(targets.distinct().agg(F.count("*").alias("targets"))).join(stacks.distinct().agg(F.count("*").alias("stacks")))


def smoke(instructions: DataFrame, facts: DataFrame, fn: int) -> DataFrame:
    """The first two pointer instructions of a function, and whether they may alias."""
    two = instructions.where((F.col("fn") == fn) & F.col("is_ptr")).orderBy("inst").limit(2).agg(F.min_by("dst", "inst").alias("p"), F.max_by("dst", "inst").alias("q"))
    return alias_answers(two, facts, facts.limit(0))


def is_prefix(stack: Column, of: Column) -> Column:
    return F.slice(of, F.lit(1), F.size(stack)) == stack
