"""Semi-naive fixpoints over DataFrame joins: closure, components, levels, dominators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from quarry.plans import local
from quarry.plans.tables import settle

#: Edges of a weak component up to which one task takes it whole; larger ones go through rounds of joins.
ONE_TASK = 1_000_000


def fixpoint(base: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """The least set that holds ``base`` and, with its newest rows, what ``step(newest, all)`` derives.

    Rows are compared on all columns. Each round is settled, so a plan never holds more than one round.
    """
    known = delta = settle(base.distinct(), "fix")
    parts = [known]
    for _ in range(max_rounds):
        new = step(delta, known).select(*known.columns).distinct().join(known, known.columns, "left_anti")
        delta = settle(new, "fix")
        if delta.isEmpty():
            return known
        parts.append(delta)
        if len(parts) > 8:  # many small tables are read as one
            parts = [settle(_union(parts), "fix")]
        known = _union(parts)
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``: the seeds and all that edges (``src, dest``) lead to."""
    return fixpoint(seeds.select("node"), lambda new, _: new.join(edges, F.col("node") == F.col("src")).select(F.col("dest").alias("node")))


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dest) with a path of at least one edge, a step at a time over the newest pairs."""
    e = edges.select(F.col("src").alias("mid"), F.col("dest").alias("next")).distinct()
    return fixpoint(edges.select("src", "dest"), lambda new, _: new.join(e, F.col("dest") == F.col("mid")).select("src", F.col("next").alias("dest")))


def least_label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the least node from which each can be reached, itself included.

    A round takes the least label of the predecessors and then that label's own label, so long chains shrink by halves.
    """
    labels = settle(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        sent = labels.join(edges, F.col("node") == F.col("src")).groupBy("dest").agg(F.min("label").alias("got"))
        least = labels.join(sent, F.col("node") == F.col("dest"), "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("got", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        moved = settle(least.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels


def weak_components(edges: DataFrame, most: int = ONE_TASK) -> DataFrame:
    """``node, comp``: of every end of an edge, the least node that it is linked with, whatever the edges' direction.

    A task links the edges of a range of nodes; rounds over joins are left for the links between what tasks have found.
    """
    es = settle(edges.select("src", "dest").where("src <> dest").distinct(), "weak")
    kind, n = dict(es.dtypes)["src"], es.count()
    ranges = es.repartition(1) if n <= most // 4 else es.repartitionByRange(1 + n // (most // 4 + 1), "src")
    found = settle(local.by_group(ranges.select(F.lit(0).alias("comp"), "src", "dest"), local.weak, f"node {kind}, root {kind}"), "weak-found")
    if n <= most // 4:
        return found.withColumnRenamed("root", "comp")
    least = settle(found.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")), "weak-least")
    links = settle(least.where(F.size("roots") > 1).select(F.col("root").alias("dest"), F.explode("roots").alias("src")).where("src <> dest").distinct(), "weak-links")
    both = settle(links.select("src", "dest").union(links.select("dest", "src")), "weak-links")
    labels = least_label(ends(links), both).withColumnRenamed("node", "root")
    return least.join(labels, "root", "left").select("node", F.coalesce("label", "root").alias("comp"))


def by_component(edges: DataFrame, comps: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``comp, src, dest`` of the edges, and those of them in weak components of more than ``most`` edges, if there are any."""
    met = settle(edges.join(comps.select(F.col("node").alias("src"), "comp"), "src").select("comp", "src", "dest"), "by-comp")
    large = settle(met.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > most).select("comp"), "large")
    return met, None if large.isEmpty() else settle(met.join(large, "comp", "left_semi"), "large")


def strong_components(nodes: DataFrame, edges: DataFrame, most: int = ONE_TASK) -> DataFrame:
    """``node, rep``: the least node of each one's strong component.

    Nodes without edges on one side go first, again and again while there are many of them: they are alone. What is left
    falls into weak components: those of at most ``most`` edges are taken whole, each in one task, the larger ones are
    coloured.
    """
    es = _inner(settle(edges.select("src", "dest").where("src <> dest").distinct(), "scc-edges"))
    found = _found(es, dict(nodes.dtypes)["node"], most)
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("rep", "node").alias("rep"))


def _found(es: DataFrame, kind: str, most: int) -> DataFrame:
    schema, n = f"node {kind}, rep {kind}", es.count()
    if n <= most:  # also without edges: one short task
        one = es.select(F.lit(0).alias("comp"), "src", "dest").repartition(1)
        return settle(local.by_group(one, local.strong, schema), "scc-found")
    met, large = by_component(es, settle(weak_components(es), "scc-comps"), most)
    small = met if large is None else met.join(large.select("comp").distinct(), "comp", "left_anti")
    found = settle(local.by_group(tasks(small, n, most), local.strong, schema), "scc-found")
    return found if large is None else found.union(_coloured(large.select("src", "dest")))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dest")).distinct()


def tasks(rows: DataFrame, n: int, most: int) -> DataFrame:
    """The ``n`` rows by ``comp``, in tasks of about ``most`` / 4, and sorted there."""
    return rows.repartition(1 + n // (most // 4 + 1), "comp").sortWithinPartitions("comp")


def _inner(es: DataFrame) -> DataFrame:
    """The edges that are left when nodes without edges on one side are taken out while there are many."""
    many = es.count()
    while many:
        within = settle(es.select(F.col("src").alias("node")).intersect(es.select(F.col("dest").alias("node"))), "scc-inner")
        es, before = settle(_within(es, within), "scc-edges"), many
        many = es.count()
        if many > 0.9 * before:
            break
    return es


def _coloured(edges: DataFrame) -> DataFrame:
    """``node, rep`` of nodes in cycles, by colouring: forward least labels colour the graph; the nodes of a colour that reach
    its origin back are the origin's component. They are taken out, and the rest is coloured anew."""
    es, done = _inner(edges), []
    while not es.isEmpty():
        inner = settle(ends(es), "scc-nodes")
        labels = least_label(inner, es)
        same = es.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dest"), F.col("label").alias("b")), "dest").where("a = b")
        back = same.select(F.col("dest").alias("src"), F.col("src").alias("dest"))
        origins = labels.where("node = label").select("node")
        found = settle(reachable(origins, settle(back, "scc-back")).join(labels, "node").select("node", F.col("label").alias("rep")), "scc-found")
        done.append(found)
        left = settle(inner.join(found, "node", "left_anti"), "scc-nodes")
        es = _inner(settle(_within(es, left), "scc-edges"))
    return _union(done) if done else ends(edges).limit(0).select("node", F.col("node").alias("rep"))


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dest")), "dest", "left_semi")


def to_reps(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges between components, without loops or repeats."""
    mapped = edges.join(reps.select(F.col("node").alias("src"), F.col("rep").alias("a")), "src").join(reps.select(F.col("node").alias("dest"), F.col("rep").alias("b")), "dest")
    return mapped.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dest")).distinct()


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, level``: rounds of a topological walk of an acyclic graph; sources are at level 0."""
    left, out, k = settle(nodes.select("node").distinct(), "topo"), [], 0
    es = settle(edges.select("src", "dest").distinct(), "topo-edges")
    while not left.isEmpty():
        ready = settle(left.join(es.select(F.col("dest").alias("node")), "node", "left_anti"), "topo-ready")
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        out.append(ready.withColumn("level", F.lit(k)))
        left = settle(left.join(ready, "node", "left_anti"), "topo")
        es = settle(es.join(ready.select(F.col("node").alias("src")), "src", "left_anti"), "topo-edges")
        k += 1
    return _union(out) if out else left.withColumn("level", F.lit(0))


def levels_from(start: DataFrame, edges: DataFrame, back: bool = False) -> DataFrame:
    """``node, level`` of the nodes that ``start`` reaches, in topological order from there; ``back`` walks edges backwards."""
    along = edges.select(F.col("dest").alias("src"), F.col("src").alias("dest")) if back else edges.select("src", "dest")
    seen = settle(reachable(start, along), "topo-seen")
    return levels(seen, _within(along, seen))


def dominators(entry: int, edges: DataFrame) -> DataFrame:
    """``node, idom`` of every node that ``entry`` reaches, but itself.

    d dominates n if n cannot be reached without d: for all d at once, (d, n) pairs that avoid d are closed forward.
    """
    spark = edges.sparkSession
    start = spark.createDataFrame([(entry,)], "node int")
    seen = settle(reachable(start, edges), "dom-seen")
    es = settle(_within(edges.select("src", "dest").distinct(), seen), "dom-edges")
    base = seen.where(F.col("node") != entry).select(F.col("node").alias("d"), F.lit(entry).alias("n"))
    avoid = fixpoint(base, lambda new, _: new.join(es, F.col("n") == F.col("src")).where("dest <> d").select("d", F.col("dest").alias("n")))
    # All dominators of a node stand on every path to it, so on its path in the tree of first visits.
    tree = closure(first_visits(entry, es).select(F.col("parent").alias("src"), F.col("node").alias("dest")))
    doms = settle(tree.select(F.col("src").alias("d"), F.col("dest").alias("n")).join(avoid, ["d", "n"], "left_anti"), "doms")
    depth = doms.groupBy(F.col("n").alias("d")).agg(F.count("*").alias("depth"))
    best = doms.join(depth, "d", "left").groupBy("n").agg(F.max_by("d", F.coalesce("depth", F.lit(0))).alias("idom"))
    return best.select(F.col("n").alias("node"), "idom")


def first_visits(entry: int, edges: DataFrame) -> DataFrame:
    """``node, parent``: the breadth-first tree from ``entry``, the least of possible parents each."""
    new = settle(edges.sparkSession.createDataFrame([(entry, -1)], "node int, parent int"), "bfs")
    seen, parts = new.select("node"), []
    while True:
        found = new.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dest").alias("node")).agg(F.min("src").alias("parent"))
        new = settle(found.join(seen, "node", "left_anti"), "bfs")
        if new.isEmpty():
            return _union(parts) if parts else new
        parts.append(new)
        seen = seen.union(new.select("node"))


def acyclic_paths(start: int, edges: DataFrame, max_depth: int) -> DataFrame:
    """``path``: every path without a repeated node from ``start``, up to ``max_depth`` nodes; longer ones are an error.

    The number of paths is exponential by nature, so the limit is explicit and never cuts silently.
    """
    path = edges.sparkSession.createDataFrame([([start],)], "path array<int>")
    parts, new = [path], path
    for _ in range(max_depth):
        grown = new.join(edges, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dest")))
        new = settle(grown.select(F.concat("path", F.array("dest")).alias("path")), "paths")
        if new.isEmpty():
            return _union(parts)
        parts.append(new)
    raise ValueError(f"paths are longer than {max_depth} nodes")
