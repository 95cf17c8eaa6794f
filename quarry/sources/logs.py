"""Readers and writers of the text logs: counts, key-to-set maps, call stacks, seeds, id maps and graph text.

Readers take a table of lines (``value``), as ``spark.read.text`` gives it, so any store and any number of files work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quarry.plans.tables import ranked

NULL_ID, INT_ID, UNIVERSAL_ID, AGGREGATE_ID, UNKNOWN = 0, 1, 2, 3, -1


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of all files, with the run that wrote them: the number a log's name ends in."""
    run = F.regexp_extract(F.col("_metadata.file_name"), r"\.(\d+)$", 1)
    return spark.read.text(list(paths)).select("value", F.when(run != "", run.cast("long")).alias("run"))


def read_counts(lines: DataFrame) -> DataFrame:
    """``bb, cnt`` from lines ``id count``; counts of one id are summed."""
    part = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(part[0].cast("int").alias("bb"), part[1].cast("long").alias("cnt")).groupBy("bb").agg(F.sum("cnt").alias("cnt"))


def read_pairs(lines: DataFrame, key: str, item: str) -> DataFrame:
    """One row an item of lines ``key: item item ...``; nothing is deduplicated."""
    part = F.split("value", ":")
    items = F.transform(F.filter(F.split(F.trim(F.get(part, F.lit(1))), r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    return lines.where(F.contains("value", F.lit(":"))).select(F.trim(part[0]).cast("int").alias(key), F.explode(items).alias(item))


def read_points_to(lines: DataFrame) -> DataFrame:
    """``val, obj``: null and unknown objects go; a value that has the universal object goes as a whole."""
    pairs = read_pairs(lines, "val", "obj")
    universal = pairs.where(F.col("obj") == UNIVERSAL_ID).select("val").distinct()
    return pairs.where(~F.col("obj").isin(NULL_ID, UNKNOWN)).distinct().join(universal, "val", "left_anti")


def read_aliases(lines: DataFrame) -> DataFrame:
    """``load, store``: the universal store becomes unknown (-1), null ones go."""
    pairs = read_pairs(lines, "load", "store").where(F.col("store") != NULL_ID)
    return pairs.select("load", F.when(F.col("store") == UNIVERSAL_ID, F.lit(UNKNOWN)).otherwise(F.col("store")).alias("store")).distinct()


def read_stacks(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``stack``: ids with a 0 before them. A repeated id in a stack is an error, or drops it if not ``strict``."""
    ids = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    stacks = lines.where(F.trim("value") != "").select(F.concat(F.array(F.lit(0)), ids).alias("stack"))
    simple = F.size(F.array_distinct("stack")) == F.size("stack")
    if not strict:
        return stacks.where(simple)
    return stacks.select(F.when(simple, F.col("stack")).otherwise(F.raise_error(F.concat(F.lit("repeated id in stack "), F.array_join("stack", " ")))).alias("stack"))


def stack_index(stacks: DataFrame) -> DataFrame:
    """``id, n_stacks``: in how many distinct stacks an id stands."""
    return stacks.distinct().select(F.explode("stack").alias("id")).groupBy("id").agg(F.count("*").alias("n_stacks"))


def stacks_by_id(stacks: DataFrame) -> DataFrame:
    """``id, stack``: every distinct stack under each id that stands in it."""
    return stacks.distinct().select(F.explode(F.array_distinct("stack")).alias("id"), "stack")


def equal_to_prefix(stacks: DataFrame, asked: DataFrame) -> DataFrame:
    """The distinct stacks that are, as a whole, one of the ``asked`` prefixes."""
    return stacks.distinct().join(asked.select("stack").distinct(), "stack", "left_semi")


def prefixes(stacks: DataFrame) -> DataFrame:
    """Every distinct prefix of a stack."""
    return stacks.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("stack")), lambda n: F.slice("stack", 1, n))).alias("stack")).distinct()


def write_pairs(pairs: DataFrame, key: str, item: str) -> DataFrame:
    """Lines ``key: item item ...`` with sorted distinct items."""
    each = pairs.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return each.select(F.concat(F.col(key).cast("string"), F.lit(": "), joined("items")).alias("value"))


def joined(items: Column | str) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), " ")


def merge_pairs(*logs: DataFrame) -> DataFrame:
    """The union by key of logs of lines ``key: item ...``, as one log."""
    both = read_pairs(_union(logs), "key", "item")
    return write_pairs(both, "key", "item")


def merge_stacks(*stacks: DataFrame) -> DataFrame:
    """The distinct stacks that aren't empty."""
    return _union(stacks).where(F.size("stack") > 0).distinct()


def _union(frames: tuple[DataFrame, ...]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_seeds(lines: DataFrame) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    return lines.select(part[0].cast("int").alias("fcn_num"), part[1].cast("int").alias("inst_num"))


def ordinals(instructions: DataFrame) -> DataFrame:
    """``fcn_num, inst_num, inst``: functions by their order and instructions by their order in the function, from 0."""
    functions = ranked(instructions.select("fn").distinct(), ["fn"], "fcn_num").withColumn("fcn_num", F.col("fcn_num") - 1)
    place = F.row_number().over(Window.partitionBy("fn").orderBy("inst")) - 1
    return instructions.select("fn", "inst").distinct().withColumn("inst_num", place).join(functions, "fn").select("fcn_num", "inst_num", "inst")


def seed_instructions(seeds: DataFrame, instructions: DataFrame) -> DataFrame:
    """``fcn_num, inst_num, inst``: the instructions that a file's seeds name; a seed of none is left out."""
    return seeds.distinct().join(ordinals(instructions), ["fcn_num", "inst_num"])


def merge_into(known: DataFrame, run: DataFrame, key: str, item: str) -> DataFrame:
    """The lines of a log after a run's pairs have been merged into it, by key."""
    return write_pairs(read_pairs(known, key, item).union(run.select(key, item)), key, item)


def write_seeds(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.concat_ws(" ", "fcn_num", "inst_num").alias("value"))


def read_id_map(lines: DataFrame) -> DataFrame:
    """``id, text`` of lines ``id: text`` after the first line ``OUTPUT:``; ``lines`` has ``value`` and its number ``n``."""
    start = lines.where(F.trim("value") == "OUTPUT:").agg(F.min("n").alias("start"))
    rest = lines.join(F.broadcast(start), F.col("n") > F.col("start"))  # one row
    found = rest.where(F.col("value").rlike(r"^\s*\d+:"))
    return found.select(F.regexp_extract("value", r"^\s*(\d+):", 1).try_cast("int").alias("id"), F.trim(F.regexp_replace("value", r"^\s*\d+:", "")).alias("text"))


def substitute_ids(traces: DataFrame, id_map: DataFrame) -> DataFrame:
    """``n, value`` with every id of a trace line replaced by its text, where it has one."""
    each = traces.select("n", F.posexplode(F.split("value", " ")).alias("at", "id"))
    named = each.join(id_map.select(F.col("id").cast("string").alias("id"), "text"), "id", "left")
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("text", "id").alias("w")))), lambda x: x["w"])
    return named.groupBy("n").agg(F.array_join(words, " ").alias("value"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """One line of graph text a node with successors."""
    out = edges.groupBy("src").agg(F.array_sort(F.collect_set("dest")).alias("to"))
    return out.select(F.concat(F.col("src").cast("string"), F.lit(" -> { "), joined("to"), F.lit(" };")).alias("value"))
