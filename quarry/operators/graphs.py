"""Graph and offline-reduction operators: value numbering, rewriting, call graphs, edits and reducing transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.operators.constraints import ADDRESS, COLUMNS, COPY, STORE
from quarry.plans import local
from quarry.plans.fixpoint import ONE_TASK, by_component, levels, reachable, strong_components, tasks, to_reps, weak_components
from quarry.plans.tables import settle
from quarry.sources.logs import INT_ID, NULL_ID


#: Edges of a weak component up to which one task numbers it: its sets have a bit for each of its nodes.
MOST_NUMBERED = 20_000


def value_numbers(nodes: DataFrame, edges: DataFrame, indirect: DataFrame, unions: bool = False, most: int = MOST_NUMBERED, comps: DataFrame | None = None) -> DataFrame:
    """``node, cls``: classes of nodes that must hold equal facts; ``cls`` is the least member, or -1 for non-pointers.

    Over the components in topological order a node's label set is a label of its own if it is in ``indirect``, and the
    class of each predecessor's label set (or, with ``unions``, all the predecessors' labels). Equal sets are one class.
    Labels don't leave a weak component (``comps``, if known), so that those of at most ``most`` edges are numbered in one
    task each; only the larger ones go level by level.
    """
    kind, es = dict(nodes.dtypes)["node"], settle(edges.select("src", "dest").where("src <> dest").distinct(), "vn-edges")
    if comps is None:
        comps = settle(weak_components(es), "vn-comps")
    own = settle(indirect.select("node").distinct(), "vn-own")
    met, large = by_component(es, comps, most)
    rows = met.withColumn("own", F.lit(0)).union(comps.join(own, "node", "left_semi").select("comp", "node", "node", F.lit(1)))
    if large is not None:
        rows = rows.join(large.select("comp").distinct(), "comp", "left_anti")
    found = local.by_group(tasks(rows, es.count(), ONE_TASK), local.numbered(unions), f"node {kind}, cls {kind}")
    alone = own.join(comps, "node", "left_anti").select("node", F.col("node").alias("cls"))  # without edges; those without a label either hold nothing
    found = found.union(alone)
    if large is not None:
        big = settle(comps.join(large.select("comp").distinct(), "comp", "left_semi").select("node"), "vn-big")
        reps = settle(strong_components(big, large, most), "vn-reps")
        mine = settle(reps.join(own, "node", "left_semi").select(F.col("rep").alias("node")).distinct(), "vn-own")
        dag = settle(to_reps(large, reps), "vn-dag")
        keys = _by_level(reps.select(F.col("rep").alias("node")).distinct(), dag, mine, unions)
        found = found.union(reps.join(keys.withColumnRenamed("node", "rep"), "rep").select("node", "cls"))
    return nodes.join(settle(found, "vn-classes"), "node", "left").select("node", F.coalesce("cls", F.lit(-1)).alias("cls"))


def _by_level(nodes: DataFrame, dag: DataFrame, own: DataFrame, unions: bool) -> DataFrame:
    """``node, cls`` of acyclic edges, level by level; what a level sends waits under its receiver's level."""
    order = settle(levels(nodes, dag), "vn-levels")
    sent = settle(dag.join(order.select(F.col("node").alias("src"), F.col("level").alias("src_level")), "src").join(order.select(F.col("node").alias("dest"), F.col("level").alias("dest_level")), "dest"), "vn-sent")
    labels = order.join(own, "node", "left_semi").select("node", (-F.col("node").cast("long") - 2).alias("label"), "level")  # fresh ones are negative
    labels, waiting, keys = settle(labels, "vn-labels"), [], []
    for k in range(1 + (order.agg(F.max("level")).first()[0])):
        came = [w.where(F.col("level") == k).select("node", "label", "key") for w in waiting]
        mine = labels.where(F.col("level") == k).select("node", "label")
        got = _all([mine.withColumn("key", F.lit(None).cast("string")), *came])
        # A set of one inherited class is that class itself.
        sets = got.groupBy("node").agg(F.array_sort(F.collect_set("label")).alias("set"), F.min("key").alias("one"))
        text = F.array_join(F.transform("set", lambda x: x.cast("string")), ",")
        sets = settle(sets.select("node", "set", (text if unions else F.when((F.size("set") == 1) & (F.get("set", F.lit(0)) >= 0), F.col("one")).otherwise(text)).alias("key")), "vn-sets")
        keys.append(sets.select("node", "key"))
        along = sent.where(F.col("src_level") == k).join(sets.withColumnRenamed("node", "src"), "src").select(F.col("dest").alias("node"), F.col("dest_level").alias("level"), "set", "key")
        if unions:
            out = along.select("node", F.explode("set").alias("label"), F.lit(None).cast("string").alias("key"), "level")
        else:
            out = along.select("node", F.xxhash64("key").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).alias("label"), "key", "level")
        waiting.append(settle(out.distinct(), "vn-waiting"))
        if len(waiting) > 8:  # many small tables are read as one
            waiting = [settle(_all(waiting).where(F.col("level") > k), "vn-waiting")]
    done = settle(_all(keys), "vn-keys")
    return done.join(done.groupBy("key").agg(F.min("node").alias("cls")), "key").select("node", "cls")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def rewrite(constraints: DataFrame, classes: DataFrame) -> DataFrame:
    """Constraints on class members mapped to their classes; address rows keep their object.

    Rows that touch the null or int node stay as they are. Rows from or to a non-pointer (class -1), copies of a class to
    itself, and repeats go.
    """
    special = F.col("src").isin(NULL_ID, INT_ID) | F.col("dest").isin(NULL_ID, INT_ID)
    kept = constraints.where(special).select("ctype", "src", "dest", "offs")
    a, b = (classes.select(F.col("node").alias(n), F.col("cls").alias(f"{n}_cls")) for n in ("src", "dest"))
    met = constraints.where(~special).join(a, "src", "left").join(b, "dest", "left")
    src = F.when(F.col("ctype") == ADDRESS, F.col("src")).otherwise(F.coalesce("src_cls", "src"))
    dest = F.coalesce("dest_cls", "dest")
    out = met.select("ctype", src.cast("int").alias("src"), dest.cast("int").alias("dest"), "offs").where("src <> -1 and dest <> -1")
    return kept.union(out.where(~((F.col("ctype") == COPY) & (F.col("src") == F.col("dest")) & (F.col("offs") == 0)))).distinct()


def reduce_constraints(constraints: DataFrame, stop_at: int = 100, max_loops: int = 10) -> tuple[DataFrame, DataFrame]:
    """Value numbering by unions and rewriting, until a loop removes at most ``stop_at`` rows.

    The second table, ``node, rep``, says which node's facts each one has; -1: it has none. Objects can be merged as well, so
    the rows left must be solved with it (``solve(reps=...)``).
    """
    plain = (F.col("ctype") == COPY) & (F.col("offs") == 0)
    out = settle(constraints.select("ctype", "src", "dest", "offs").distinct(), "hu")
    # Rewriting maps copies within their weak components, so that those of the first loop hold for all.
    comps = settle(weak_components(out.where(plain)), "hu-comps")
    loop = plain & (F.col("src") == F.col("dest")) & ~F.col("src").isin(NULL_ID, INT_ID)
    classes = settle(value_numbers(_ends(out), out.where(plain).select("src", "dest"), _fresh(out), unions=True, comps=comps), "hu-classes")
    reps, moved = classes.select("node", F.col("cls").alias("rep")), classes.where("node <> cls")
    loops = out.where(loop).count()
    out, lost, gone = _moved(out.where(~loop), moved)
    gone += loops
    # What stands for an object can be written through pointers as well.
    objects = out.where(F.col("ctype") == ADDRESS).select(F.col("src").alias("node")).distinct()
    objects = settle(objects.union(objects.join(reps, "node").select(F.col("rep").alias("node"))).distinct(), "hu-objects")
    later = None
    for _ in range(max_loops - 1):
        if gone <= stop_at:
            break
        # Only nodes that have lost their own label can be numbered anew, and what is linked with them by copies.
        ids = lost.join(_held(out).join(lost, "node", "left_semi"), "node", "left_anti").join(objects, "node", "left_anti").where("node > 3")
        ids = settle(ids, "hu-lost")
        near = comps.join(comps.join(ids, "node", "left_semi").select("comp").distinct(), "comp", "left_semi").select("node")
        near = settle(near.union(ids).distinct(), "hu-near")
        nodes = _ends(out).join(near, "node", "left_semi")
        copies = out.where(plain).select("src", "dest").join(near.select(F.col("node").alias("src")), "src", "left_semi").join(near.select(F.col("node").alias("dest")), "dest", "left_semi")
        fresh = _held(out).union(objects).union(near.where("node <= 3")).join(near, "node", "left_semi").distinct()
        moved = settle(value_numbers(settle(nodes, "hu-nodes"), copies, fresh, unions=True, comps=comps.join(near, "node", "left_semi")).where("node <> cls"), "hu-moved")
        objects = settle(objects.union(objects.join(moved, "node").select(F.col("cls").alias("node"))).distinct(), "hu-objects")
        out, lost, gone = _moved(out, moved)
        then = moved.select(F.col("node").alias("at"), F.col("cls").alias("now"))
        if later is not None:
            then = then.union(later.join(moved, F.col("now") == F.col("node"), "left").select("at", F.coalesce("cls", "now")))
        later = settle(then, "hu-later")
    if later is not None:
        reps = settle(reps.join(later, F.col("rep") == F.col("at"), "left").select("node", F.coalesce("now", "rep").alias("rep")), "hu-reps")
    return out, reps


def _ends(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("src").alias("node")).union(rows.select("dest")).distinct()


def _held(rows: DataFrame) -> DataFrame:
    """Nodes that get facts by other rules than plain copies, or are stored."""
    plain = (F.col("ctype") == COPY) & (F.col("offs") == 0)
    return rows.where(~plain).select(F.col("dest").alias("node")).union(rows.where(F.col("ctype") == STORE).select("src"))


def _fresh(rows: DataFrame) -> DataFrame:
    objects = rows.where(F.col("ctype") == ADDRESS).select(F.col("src").alias("node"))
    return _held(rows).union(objects).union(_ends(rows).where(F.col("node") <= 3)).distinct()


def _moved(rows: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Distinct rows rewritten by the classes of the nodes that have left theirs, the ends of rows that went for having a
    non-pointer's end, and how many rows went. Rows that touch none of those nodes are neither compared nor shuffled."""
    hit = moved.select(F.col("node").alias("n"))
    met = rows.join(hit.select(F.col("n").alias("src"), F.lit(1).alias("a")), "src", "left").join(hit.select(F.col("n").alias("dest"), F.lit(1).alias("b")), "dest", "left")
    met = met.select("ctype", "src", "dest", "offs", (F.col("a").isNotNull() | F.col("b").isNotNull()).alias("touched"))
    met = settle(met, "hu-met")
    same, touched = met.where("not touched").drop("touched"), met.where("touched").drop("touched")
    new = settle(rewrite(touched, moved), "hu-new")
    new = settle(new.join(same.join(new, COLUMNS, "left_semi"), COLUMNS, "left_anti"), "hu-new")
    none = moved.where("cls = -1").select(F.col("node").alias("src"))
    lost = touched.join(none, "src", "left_semi").where(F.col("ctype") != ADDRESS).select(F.col("dest").alias("node")).distinct()
    lost = lost.join(moved, "node", "left").select(F.coalesce("cls", "node").alias("node")).where("node <> -1").distinct()
    return same.union(new), settle(lost, "hu-lost"), touched.count() - new.count()


def call_edges(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct caller to callee edges: ``calls`` (``call_id, caller``) and their ``targets`` (``call_id, fn``)."""
    return calls.join(targets, "call_id").select(F.col("caller").alias("src"), F.col("fn").alias("dest")).distinct()


def call_site_edges(sites: DataFrame) -> DataFrame:
    """cs1 to cs2 where cs2 stands in the function that cs1 calls (``cs, fn, callee``)."""
    inner = sites.select(F.col("cs").alias("dest"), F.col("fn").alias("callee"))
    return sites.select(F.col("cs").alias("src"), "callee").join(inner, "callee").select("src", "dest").distinct()


def with_virtual_main(edges: DataFrame, sites: DataFrame, main_fn: int, main_cs: int) -> DataFrame:
    """Call-site edges (``src, dest``) and those from a virtual call of main, ``main_cs``, to the sites (``cs, fn``) in it."""
    own = sites.where(F.col("fn") == main_fn).select(F.lit(main_cs).cast("int").alias("src"), F.col("cs").alias("dest"))
    return edges.select("src", "dest").union(own).distinct()


def call_destinations(sites: DataFrame, profiled: DataFrame, facts: DataFrame, function_objects: DataFrame, used: DataFrame) -> DataFrame:
    """``cs, fn``: direct, profiled, or any used function whose object the callee pointer may hold."""
    direct = sites.where("direct_fn >= 0").select("cs", F.col("direct_fn").alias("fn"))
    seen = sites.where("direct_fn < 0").join(profiled, "cs").select("cs", "fn")
    rest = sites.where("direct_fn < 0").join(profiled, "cs", "left_anti")
    alias = rest.join(facts, F.col("callee") == F.col("node")).join(function_objects, "obj").join(used, "fn", "left_semi").select("cs", "fn")
    return direct.union(seen).union(alias).distinct()


def edit(edges: DataFrame, added: DataFrame, removed: DataFrame, dropped_nodes: DataFrame, replaced: DataFrame) -> DataFrame:
    """Add and remove edges, drop nodes, then replace nodes (``node, rep``): the cleaned edge set."""
    out = edges.select("src", "dest").union(added.select("src", "dest")).distinct().join(removed, ["src", "dest"], "left_anti")
    for c in ("src", "dest"):
        out = out.join(dropped_nodes.select(F.col("node").alias(c)), c, "left_anti")
        out = out.join(replaced.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_rep")), c, "left").withColumn(c, F.coalesce(f"{c}_rep", c)).drop(f"{c}_rep")
    return out.select("src", "dest").distinct()


def without_marked(edges: DataFrame, marked: DataFrame) -> DataFrame:
    for c in ("src", "dest"):
        edges = edges.join(marked.select(F.col("node").alias(c)), c, "left_anti")
    return edges.select("src", "dest").distinct()


def merge_unmarked_components(nodes: DataFrame, edges: DataFrame, marked: DataFrame) -> DataFrame:
    """``node, rep``: components of the graph without marked nodes; marked ones stay alone."""
    plain = nodes.join(marked, "node", "left_anti")
    inner = strong_components(plain, without_marked(edges, marked))
    return inner.union(nodes.join(marked, "node", "left_semi").select("node", F.col("node").alias("rep")))


def fold_single(reps: DataFrame, edges: DataFrame, fixed: DataFrame, into: str = "src") -> DataFrame:
    """Fold every class outside ``fixed`` that has one neighbour class only into it, until none is left.

    ``into`` 'src' folds into single predecessors, 'dest' into single successors. Folds of one round are chained to
    their ends; of a ring of folds the least class stays.
    """
    other = "dest" if into == "src" else "src"
    reps = settle(reps, "fold")
    while True:
        between = settle(to_reps(edges, reps), "fold-edges")
        single = between.groupBy(F.col(other).alias("node")).agg(F.countDistinct(into).alias("n"), F.min(into).alias("to")).where("n = 1").join(fixed, "node", "left_anti").select("node", "to")
        single = settle(single, "fold-single")
        if single.isEmpty():
            return reps
        link = single.select(F.col("node").alias("src"), F.col("to").alias("dest"))
        ends = single.select("node").union(single.select(F.col("to").alias("node"))).distinct()
        groups = strong_components(ends, link.union(link.select(F.col("dest").alias("src"), F.col("src").alias("dest"))))
        # The end of a chain is the class that doesn't fold itself; a ring has none.
        stays = groups.join(single.select("node"), "node", "left_anti").groupBy("rep").agg(F.min("node").alias("stay"))
        to = groups.join(stays, "rep", "left").select(F.col("node").alias("rep"), F.coalesce("stay", "rep").alias("stay"))
        reps = settle(reps.join(to, "rep", "left").select("node", F.coalesce("stay", "rep").alias("rep")), "fold")


def needed_nodes(nodes: DataFrame, edges: DataFrame, relevant: DataFrame) -> DataFrame:
    """Relevant nodes and those that lead to one; the others can be deleted."""
    back = edges.select(F.col("dest").alias("src"), F.col("src").alias("dest"))
    return reachable(relevant.join(nodes, "node", "left_semi").select("node"), back)


def predecessors(seeds: DataFrame, edges: DataFrame, stop: DataFrame) -> DataFrame:
    """Instructions from which a seed is reached, not walked past those of ``stop``."""
    back = edges.select(F.col("dest").alias("src"), F.col("src").alias("dest")).join(stop.select(F.col("node").alias("src")), "src", "left_anti")
    first = seeds.join(edges, F.col("node") == F.col("dest")).select(F.col("src").alias("node")).distinct()
    return reachable(first, back)


def valid_calls(calls: DataFrame) -> DataFrame:
    """``call_id, callee``: calls that are neither inline assembly nor intrinsics; a bitcast's operand is the callee."""
    callee = F.when(F.col("kind") == "bitcast", F.col("operand")).otherwise(F.col("callee"))
    return calls.where((F.col("kind") != "asm") & (F.col("kind") != "intrinsic")).select("call_id", callee.alias("callee"))
