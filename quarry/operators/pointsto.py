"""Inclusion-based points-to facts: a semi-naive fixpoint over copy edges and facts, with fields and indirect calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.operators.constraints import ADDRESS, COPY, LOAD, STORE
from quarry.plans.fixpoint import strong_components
from quarry.plans.tables import settle
from quarry.sources.logs import INT_ID, NULL_ID


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def clean(constraints: DataFrame) -> DataFrame:
    """Without repeats (the same but for ``rep``), rows that touch null (but copies from it), and copies into it."""
    touches = (F.col("src") == NULL_ID) | (F.col("dest") == NULL_ID)
    return constraints.select("ctype", "src", "dest", "offs").where(~(touches & (F.col("ctype") != COPY)) & ~((F.col("ctype") == COPY) & (F.col("dest") == NULL_ID))).distinct()


def solve(constraints: DataFrame, allocs: DataFrame | None = None, indirect: DataFrame | None = None, functions: DataFrame | None = None, max_rounds: int = 500, collapse_every: int = 0, reps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(node, obj)`` facts and ``(src, dest)`` copy edges of the least fixpoint.

    ``allocs`` (``obj, max_offs``): a field offset beyond an object's size drops the object. ``indirect`` (``callee,
    args, ret``) and ``functions`` (``obj, params, ret_node``): calls through pointers add copies as targets appear. Each
    ``collapse_every`` rounds the nodes of a cycle of copies, which must hold equal facts, become one (0: never); the
    facts are those of all nodes, the copy edges then those between the cycles' least nodes. ``reps`` (``node, rep``) says
    which nodes the rows stand for, as ``reduce_constraints`` returns it: an object's edges are then its representative's,
    and the facts are those of all nodes.
    """
    rows = settle(clean(constraints), "constraints")
    load = rows.where(F.col("ctype") == LOAD).select(F.col("src").alias("at"), F.col("dest").alias("to"))
    store = rows.where(F.col("ctype") == STORE).select(F.col("src").alias("from"), F.col("dest").alias("at"))
    gep = rows.where((F.col("ctype") == COPY) & (F.col("offs") > 0)).select("src", "dest", "offs")
    fields = allocs is not None and not gep.isEmpty()
    copies = new_c = settle(rows.where((F.col("ctype") == COPY) & (F.col("offs") == 0) & (F.col("src") != F.col("dest"))).select("src", "dest"), "copies")
    facts = new_p = settle(rows.where(F.col("ctype") == ADDRESS).select(F.col("dest").alias("node"), F.col("src").alias("obj")).distinct(), "facts")
    parts_c, parts_p = [copies], [facts]
    merged = None if reps is None else settle(reps.where("node <> rep and rep <> -1").select("node", "rep"), "reps")
    for k in range(max_rounds):
        if collapse_every and k % collapse_every == 0:
            found = strong_components(_ends(copies), copies).where("node <> rep")
            found = settle(found, "cycles")
            if not found.isEmpty():
                merged = found if merged is None else settle(_to_reps(merged, found, "rep").union(found), "cycles")
                load, store = settle(_to_reps(_to_reps(load, found, "at"), found, "to").distinct(), "loads"), settle(_to_reps(_to_reps(store, found, "at"), found, "from").distinct(), "stores")
                if indirect is not None:
                    indirect = settle(_to_reps(indirect, found, "callee"), "calls")
                gep = settle(_to_reps(_to_reps(gep, found, "src"), found, "dest"), "geps")
                # What a merged node holds has met only its own member's rules: it is new to those of the others.
                old_p = settle(facts, "facts")
                copies = settle(_to_reps(_to_reps(copies, found, "src"), found, "dest").where("src <> dest").distinct(), "copies")
                facts = settle(_to_reps(old_p, found, "node").distinct(), "facts")
                held = found.select(F.col("rep").alias("node")).distinct()
                new_p = settle(_to_reps(new_p, found, "node").union(facts.join(held, "node", "left_semi")).distinct(), "facts")
                parts_c, parts_p = [copies], [facts]
        loads = new_p.join(load, F.col("node") == F.col("at")).where(F.col("obj") > INT_ID).select(F.col("obj").alias("src"), F.col("to").alias("dest"))
        stores = new_p.join(store, F.col("node") == F.col("at")).where((F.col("obj") > INT_ID) & (F.col("from") > INT_ID)).select(F.col("from").alias("src"), F.col("obj").alias("dest"))
        edges = [loads, stores]
        if indirect is not None:
            edges.append(_calls(new_p, indirect, functions))
        edge = _union(*edges)
        if merged is not None:
            edge = _to_reps(_to_reps(edge, merged, "src"), merged, "dest")
        fresh_c = settle(edge.where("src <> dest").distinct().join(copies, ["src", "dest"], "left_anti"), "copies")
        over = lambda c, p: c.join(p, c["src"] == p["node"]).select(F.col("dest").alias("node"), "obj")
        # What the last round's new edges or new facts derive with all that was known; this round's edges come with theirs.
        found = [over(copies, new_p), over(fresh_c, facts)]
        if fields:
            moved = new_p.where(F.col("obj") > INT_ID).join(gep, F.col("node") == F.col("src")).join(allocs, "obj").where("max_offs >= offs")
            found.append(moved.select(F.col("dest").alias("node"), (F.col("obj") + F.col("offs")).alias("obj")))
        fresh_p = settle(_union(*found).distinct().join(facts, ["node", "obj"], "left_anti"), "facts")
        new_c, new_p = fresh_c, fresh_p
        # What is known is a list of rounds, written as one table every eight of them.
        parts_c, parts_p = [*parts_c, new_c], [*parts_p, new_p]
        if len(parts_p) > 8:
            parts_c, parts_p = [settle(_union(*parts_c), "copies")], [settle(_union(*parts_p), "facts")]
        copies, facts = _union(*parts_c), _union(*parts_p)
        if new_p.isEmpty():
            if merged is not None:
                facts = facts.union(merged.join(facts.select(F.col("node").alias("rep"), "obj"), "rep").select("node", "obj"))
            return facts, copies
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dest")).distinct()


def _to_reps(rows: DataFrame, reps: DataFrame, column: str) -> DataFrame:
    """``rows`` with the nodes in ``column`` replaced by their representatives (``node, rep``), where they have one."""
    to = reps.select(F.col("node").alias("_node"), F.col("rep").alias("_rep"))
    met = rows.join(to, F.col(column) == F.col("_node"), "left")
    return met.select(*(F.coalesce("_rep", column).alias(column) if c == column else F.col(c) for c in rows.columns))


def _calls(new: DataFrame, indirect: DataFrame, functions: DataFrame) -> DataFrame:
    met = new.join(indirect, F.col("node") == F.col("callee")).join(functions, "obj")
    pairs = F.transform(F.slice("args", 1, F.least(F.size("args"), F.size("params"))), lambda x, i: F.struct(x.alias("src"), F.get(F.col("params"), i).alias("dest")))
    back = F.when((F.col("ret") >= 0) & (F.col("ret_node") >= 0), F.array(F.struct(F.col("ret_node").alias("src"), F.col("ret").alias("dest")))).otherwise(F.array().cast("array<struct<src:int,dest:int>>"))
    return met.select(F.explode(F.concat(pairs, back)).alias("e")).select("e.src", "e.dest").distinct()


def of_values(values: DataFrame, facts: DataFrame, reps: DataFrame | None = None) -> DataFrame:
    """``value_key, obj``: the union over all ids of a value (``values``: ``id, value_key``), through merged ``reps``."""
    ids = values
    if reps is not None:
        ids = values.join(reps, F.col("id") == F.col("node"), "left").select(F.coalesce("rep", "id").alias("id"), "value_key")
    return ids.join(facts, F.col("id") == F.col("node")).select("value_key", "obj").distinct()


def result_counts(facts: DataFrame, copies: DataFrame) -> DataFrame:
    nodes = facts.select("node").union(copies.select("src")).union(copies.select("dest")).distinct()
    sizes = facts.agg(F.count("*").alias("facts"), F.countDistinct("node").alias("non_empty"))
    return nodes.agg(F.count("*").alias("nodes")).join(sizes).join(copies.agg(F.count("*").alias("edges")))  # one row each


def size_histogram(pairs: DataFrame, key: str, top: int = 9) -> DataFrame:
    """``size, n``: how many keys have sets of each size; sizes above ``top`` count as ``top + 1``."""
    sizes = pairs.distinct().groupBy(key).agg(F.count("*").alias("size"))
    return sizes.groupBy(F.least("size", F.lit(top + 1)).alias("size")).agg(F.count("*").alias("n"))


def size_summary(pairs: DataFrame, key: str) -> DataFrame:
    """``tracked, total, largest, n_largest``: keys, set sizes in all, the largest size and how many keys have it."""
    sizes = pairs.distinct().groupBy(key).agg(F.count("*").alias("size"))
    by_size = sizes.groupBy("size").agg(F.count("*").alias("n"))
    return by_size.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tracked"), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("total"), F.max("size").alias("largest"), F.max_by("n", "size").alias("n_largest"))


def provenance(facts: DataFrame, constraints: DataFrame, copies: DataFrame, node: int, obj: int, max_steps: int = 100) -> list[int]:
    """Nodes from one that holds ``obj`` by an address row to ``node``, each handing it on: a shortest chain."""
    back = copies.join(facts.where(F.col("obj") == obj).select(F.col("node").alias("src")), "src", "left_semi")
    origins = {r["dest"] for r in constraints.where((F.col("ctype") == ADDRESS) & (F.col("src") == obj)).select("dest").distinct().collect()}
    spark = facts.sparkSession
    came: dict[int, int] = {node: -1}
    front = [node]
    for _ in range(max_steps):
        if hit := sorted(set(front) & origins):
            chain = [hit[0]]
            while came[chain[-1]] != -1:
                chain.append(came[chain[-1]])
            return chain
        at = spark.createDataFrame([(x,) for x in front], "dest int")
        step = back.join(F.broadcast(at), "dest").groupBy("src").agg(F.min("dest").alias("dest")).collect()  # one chain's front
        front = [r["src"] for r in step if r["src"] not in came]
        came |= {r["src"]: r["dest"] for r in step if r["src"] not in came}
        if not front:
            return []
    return []
