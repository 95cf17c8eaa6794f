"""Predicates taken from profiles: what an analysis assumed, the checks that this needs, and their cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.plans.fixpoint import reachable


def dead_code(boundary: DataFrame) -> DataFrame:
    """A visit trap at every unused block at which the walk stopped (``node``)."""
    return boundary.select(F.lit("visit").alias("kind"), F.col("node").alias("site"))


def target_sets(targets: DataFrame) -> DataFrame:
    """``ptr, set_id, n``: profiled target sets (``ptr, obj``); equal sets share the least pointer's number."""
    sets = targets.distinct().groupBy("ptr").agg(F.array_join(F.transform(F.array_sort(F.collect_set("obj")), lambda x: x.cast("string")), " ").alias("key"), F.count("*").alias("n"))
    ids = sets.groupBy("key").agg(F.min("ptr").alias("set_id"))
    return sets.join(ids, "key").select("ptr", "set_id", "n")


def checks(targets: DataFrame, definitions: DataFrame, allocations: DataFrame, frees: DataFrame) -> DataFrame:
    """``kind, site``: where points-to assumptions are checked: at the pointer's definition (``ptr, site``), and at the
    sites that make and free its objects (``obj, site``). Each once."""
    at = targets.select("ptr").distinct().join(definitions, "ptr").select(F.lit("set").alias("kind"), "site")
    objs = targets.select("obj").distinct()
    made = allocations.join(objs, "obj", "left_semi").select(F.lit("alloc").alias("kind"), "site")
    freed = frees.join(objs, "obj", "left_semi").select(F.lit("free").alias("kind"), "site")
    return at.union(made).union(freed).distinct()


def check_cost(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``kind, cost``: how often the checks of a kind would run."""
    met = found.join(counts, F.col("site") == F.col("bb"), "left")
    return met.groupBy("kind").agg(F.sum(F.coalesce("cnt", F.lit(0))).cast("long").alias("cost"))


def worth_it(savings: DataFrame, costs: DataFrame, threshold: float) -> DataFrame:
    """Pointers (``ptr``) whose saving exceeds ``threshold`` times their checks' cost."""
    return savings.join(costs, "ptr").where(F.col("saving") > threshold * F.col("cost")).select("ptr")


def freed_objects(frees: DataFrame, facts: DataFrame) -> DataFrame:
    """``obj, site``: the sites (``site, ptr``) that may free an object."""
    return frees.join(facts, F.col("ptr") == F.col("node")).select("obj", "site").distinct()


def invalid_stack_closure(invalid: DataFrame, edges: DataFrame) -> DataFrame:
    """Call sites that must be tracked: every id of an invalid stack and all before it."""
    ids = invalid.select(F.explode("stack").alias("node")).distinct()
    return reachable(ids, edges.select(F.col("dest").alias("src"), F.col("src").alias("dest")))


def stacks_by_last(invalid: DataFrame) -> DataFrame:
    return invalid.distinct().groupBy(F.element_at("stack", -1).alias("last")).agg(F.count("*").alias("n"))


def violations(stacks: DataFrame, invalid: DataFrame) -> DataFrame:
    """Stacks that equal an invalid one."""
    return stacks.join(invalid.distinct(), "stack", "left_semi")


def set_violations(accesses: DataFrame, live: DataFrame, allowed: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``ptr, addr`` of accesses (``ptr, addr, seq``) whose object isn't in the pointer's set.

    ``allowed``: ``ptr, objs``; or, where pointers share sets, ``ptr, set_id`` with the sets' ``members`` (``set_id, obj``),
    so that a set is written once. The object is that of the live range (``obj, start, stop, born, died``) that holds the
    address; null addresses pass.
    """
    at = (F.col("addr") >= F.col("start")) & (F.col("addr") < F.col("stop")) & (F.col("seq") >= F.col("born")) & (F.col("seq") < F.col("died"))
    page = accesses.where("addr <> 0").withColumn("page", F.expr("addr div 4096"))
    pages = live.withColumn("page", F.explode(F.sequence(F.expr("start div 4096"), F.expr("(stop - 1) div 4096"))))
    met = page.join(pages, "page").where(at).select("ptr", "addr", "obj")
    if members is None:
        return met.join(allowed.select("ptr", F.explode("objs").alias("obj")), ["ptr", "obj"], "left_anti").select("ptr", "addr").distinct()
    own = met.join(allowed.select("ptr", "set_id"), "ptr", "left")
    return own.join(members.select("set_id", "obj"), ["set_id", "obj"], "left_anti").select("ptr", "addr").distinct()
