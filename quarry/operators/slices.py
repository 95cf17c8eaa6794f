"""Contexts and backward slices: stacks, valid pushes, predecessor blocks, dependence edges, closure, cost, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.plans.fixpoint import closure, reachable
from quarry.plans.tables import ranked, settle
from quarry.sources.logs import joined, prefixes


def _allowed(stacks: DataFrame, observed: DataFrame | None) -> DataFrame:
    """Context-free (empty) stacks, and those that are a prefix of an observed one."""
    if observed is None:
        return stacks
    return stacks.where(F.size("stack") == 0).unionByName(stacks.where(F.size("stack") > 0).join(prefixes(observed), "stack", "left_semi").select(*stacks.columns))


def push(stacks: DataFrame, sites: DataFrame, returns: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """``stack, value``: every call site (``cs, fn, callee``) of a stack's function (``stack, fn``) appended to it, for all
    values that the callee returns. A site that is on top already is refused, as are stacks not ``observed``; context-free
    stacks stay empty."""
    met = stacks.join(sites, "fn").where(~F.coalesce(F.get("stack", F.size("stack") - 1) == F.col("cs"), F.lit(False)))
    grown = met.select(F.when(F.size("stack") == 0, F.col("stack")).otherwise(F.concat("stack", F.array("cs"))).alias("stack"), F.col("callee").alias("fn"))
    return _allowed(grown, observed).join(returns, "fn").select("stack", "value").distinct()


def pop(stacks: DataFrame, components: DataFrame, callers: DataFrame) -> DataFrame:
    """``stack, cs``: the stack without its top, for all call sites in the top's component (``cs, rep``).

    A context-free stack (``stack, fn``) gives every caller of its function (``fn, cs``).
    """
    free = stacks.where(F.size("stack") == 0).join(callers, "fn").select("stack", "cs")
    deep = stacks.where(F.size("stack") > 0).withColumn("top", F.element_at("stack", -1))
    sites = components.select("cs", "rep").distinct()
    rep = sites.select(F.col("cs").alias("top"), "rep")
    rest = settle(deep.join(rep, "top").select(F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"), "rep").distinct(), "popped")
    # A site has one component and the rests are distinct, so no pair of a stack and a site comes twice: the pairs, of which
    # there may be very many, are neither shuffled nor compared. Only empty stacks can be those of ``free`` again.
    short = free.union(paired(rest.where(F.size("stack") == 0), sites, "rep").select("stack", "cs")).distinct()
    return short.union(paired(rest.where(F.size("stack") > 0), sites, "rep").select("stack", "cs"))


#: Pairs that one task makes.
PAIRS = 4_000_000


def paired(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The join on ``key`` in tasks of about ``PAIRS`` pairs: ``many`` is dealt by a salt, ``few`` is sent once a salt.

    Few keys with many rows on both sides would otherwise meet in a task each, or all in one.
    """
    sizes = many.groupBy(key).agg(F.count("*").alias("_m")).join(few.groupBy(key).agg(F.count("*").alias("_f")), key)
    salts = settle(sizes.select(key, (F.expr(f"_m * _f div {PAIRS}") + 1).cast("int").alias("_salts")), "salts")
    n = salts.agg(F.sum("_salts")).first()[0] or 0
    n = max(1, min(n, 20_000))
    one = many.join(salts, key).withColumn("_salt", F.pmod(F.xxhash64(*(c for c in many.columns if c != key)), F.col("_salts")).cast("int")).drop("_salts")
    two = few.join(salts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return one.repartition(n, key, "_salt").join(two.repartition(n, key, "_salt").hint("shuffle_hash"), [key, "_salt"]).drop("_salt")


def contexts_of(instructions: DataFrame, paths: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """``inst, stack``: the paths (``path``, of functions' call sites, ``fn`` where it ends) to an instruction's function."""
    return instructions.join(_allowed(paths.select(F.col("path").alias("stack"), "fn"), observed), "fn").select("inst", "stack").distinct()


def local_predecessors(blocks: DataFrame, edges: DataFrame, recursive: DataFrame, callee_blocks: DataFrame) -> DataFrame:
    """``bb, pred``: blocks from which one is reached in its function, with the blocks of functions they call.

    In a recursive function every block precedes every other. ``callee_blocks``: ``bb, pred`` by call.
    """
    inner = closure(edges).select(F.col("dest").alias("bb"), F.col("src").alias("pred"))
    own = blocks.select("bb", F.col("bb").alias("pred"))
    loops = blocks.join(recursive, "fn", "left_semi")
    all_of = loops.select("fn", "bb").join(loops.select("fn", F.col("bb").alias("pred")), "fn").select("bb", "pred")
    base = inner.union(own).union(all_of).distinct()
    deep = base.join(callee_blocks.select(F.col("bb").alias("pred"), F.col("pred").alias("deep")), "pred").select("bb", F.col("deep").alias("pred"))
    return base.union(deep).distinct()


def all_predecessors(local: DataFrame, callers: DataFrame) -> DataFrame:
    """``bb, pred``: the local ones, and those of the blocks that call the function, and so on (``bb, caller_bb``)."""
    up = closure(callers.select(F.col("bb").alias("src"), F.col("caller_bb").alias("dest"))).select(F.col("src").alias("bb"), F.col("dest").alias("at"))
    return local.union(up.join(local.select(F.col("bb").alias("at"), "pred"), "at").select("bb", "pred")).distinct()


def intern(stacks: DataFrame) -> DataFrame:
    """``stack_id, stack``: a number for each distinct stack, by its whole sequence."""
    return ranked(stacks.select("stack").distinct(), ["stack"], "stack_id")


def dependence(instructions: DataFrame, idom_terminators: DataFrame, load_stores: DataFrame, call_returns: DataFrame, actuals: DataFrame, control: bool = True) -> DataFrame:
    """``inst, src, kind`` edges from ``inst, op, a, b, c`` (operand instructions, -1: none), united by opcode.

    Loads depend on their address and, by ``load_stores``, on aliasing stores before them; calls on what callees return;
    arguments on the actuals; everything on its block's controlling terminator, unless ``control`` is off.
    """
    op = F.col("op")
    one = op.isin("ret", "gep", "unary", "extract", "load", "switch", "condbr", "bitcast")
    two = op.isin("store", "binop", "cmp", "insert", "phi", "cmpxchg", "rmw")
    operands = F.when(one, F.array("a")).when(two, F.array("a", "b")).when(op == "select", F.array("b", "c")).otherwise(F.array().cast("array<int>"))
    own = instructions.select("inst", F.explode(operands).alias("src"), F.lit("operand").alias("kind")).where("src >= 0")
    parts = [(load_stores, "memory"), (call_returns, "call"), (actuals, "argument")] + [(idom_terminators, "control")] * control
    out = own
    for part, kind in parts:
        out = out.union(part.select("inst", "src", F.lit(kind).alias("kind")))
    return out.distinct()


def load_store_edges(loads: DataFrame, stores: DataFrame, facts: DataFrame, preds: DataFrame) -> DataFrame:
    """``inst, src``: stores that may write what a load reads, in a block before it (both ``inst, bb, ptr``)."""
    f = facts.select(F.col("node").alias("ptr"), "obj").distinct()
    l = loads.join(f, "ptr").join(preds, "bb").select("inst", "obj", F.col("pred").alias("at"))  # noqa: E741
    s = stores.join(f, "ptr").select(F.col("inst").alias("src"), "obj", F.col("bb").alias("at"))
    return l.join(s, ["obj", "at"]).select("inst", "src").distinct()


def slices(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``slice_id, inst``: all that a seed depends on, itself included, for all seeds at once."""
    from quarry.plans.fixpoint import fixpoint

    start = seeds.select("slice_id", "inst")
    dep = edges.select(F.col("inst").alias("at"), "src").distinct()
    return fixpoint(start, lambda new, _: new.join(dep, F.col("inst") == F.col("at")).select("slice_id", F.col("src").alias("inst")))


def seeds_of_function(instructions: DataFrame, fn: int) -> DataFrame:
    """All instructions of a function, such as main, as seeds."""
    return instructions.where(F.col("fn") == fn).select("fn", "inst").distinct()


def pick_seeds(instructions: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` pseudo-random instructions, a function first: the least hash of each function, then the least of those."""
    order = F.md5(F.concat_ws(" ", F.lit(seed), "fn", "inst"))
    per_fn = instructions.groupBy("fn").agg(F.min_by("inst", order).alias("inst"))
    return per_fn.orderBy(F.md5(F.concat_ws(" ", F.lit(seed + 1), "fn"))).limit(n)


def slice_cost(members: DataFrame, instructions: DataFrame, counts: DataFrame, binary: bool = False) -> DataFrame:
    """``slice_id, cost``: twice the count of each block in the slice, and once that of each load, store, select and call.

    ``binary`` counts a block that ran as one.
    """
    count = F.when(F.col("cnt") >= 1, 1).otherwise(0) if binary else F.col("cnt")
    met = members.join(instructions.select("inst", "bb", "op"), "inst").join(counts, "bb", "left").withColumn("c", F.coalesce(count, F.lit(0)))
    blocks = met.select("slice_id", "bb", "c").distinct().groupBy("slice_id").agg(F.sum(2 * F.col("c")).alias("x"))
    heavy = met.where(F.col("op").isin("load", "store", "select", "call")).groupBy("slice_id").agg(F.sum("c").alias("y"))
    return blocks.join(heavy, "slice_id", "left").select("slice_id", (F.col("x") + F.coalesce("y", F.lit(0))).cast("long").alias("cost"))


def slice_report(members: DataFrame, instructions: DataFrame) -> DataFrame:
    """``slice_id, fn, bb, insts``: a slice's instructions by function and block, in order."""
    met = members.join(instructions.select("inst", "fn", "bb"), "inst")
    return met.groupBy("slice_id", "fn", "bb").agg(joined(F.array_sort(F.collect_set("inst"))).alias("insts"))


def instruction_census(instructions: DataFrame, used: DataFrame) -> DataFrame:
    """``fn, total, used``: instructions of a function, and those in blocks that ran."""
    met = instructions.join(used.select("bb").distinct().withColumn("u", F.lit(1)), "bb", "left")
    return met.groupBy("fn").agg(F.count("*").alias("total"), F.count("u").alias("used"))


__all__ = ["all_predecessors", "contexts_of", "dependence", "instruction_census", "intern", "load_store_edges", "local_predecessors", "pick_seeds", "pop", "push", "reachable", "slice_cost", "slice_report", "slices"]
