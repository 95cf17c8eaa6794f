"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are dealt by a seeded hash to blocks of their source. How many blocks of each source the mix takes, and how
often, follows from the targets; the block at which a target is reached is cut at a document. The taken blocks are then
split among the output shards by a tree: at each node the left half draws its share of all blocks at random, exactly, with
the sources' counts as the colours. A shard's blocks are a range of the source's permuted blocks, so draws are disjoint.

What a document's copies and shards are follows from its hash and two tables that are sent to the tasks, of at most
``MAX_SOURCES`` and ``MOST_BLOCKS`` rows: texts are shuffled once, to their shards. The driver refuses more sources than
that. Equal input and seed give equal results on every run, whatever the partitions.

Defined results: a null text has size 0, and a null source is a source of its own, the last. Documents without words take
part like others, at 0 words. Repeated rows are documents of their own; which of equal rows is taken doesn't show. Of an
empty table, or one without words, nothing is taken. ``mix`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quarry.llm.common import bucketed_rank, forget, settle, split_words

MAX_SOURCES = 100_000
MOST_BLOCKS = 1 << 17
#: Words of a shard, and shards (and numbers of shards x sources, which the driver holds) at most.
WORDS_PER_SHARD, MOST_SHARDS, MOST_QUOTAS = 1 << 25, 1 << 15, 1 << 22
MOST = 2


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    shards: int = 64  # at least; more for many words
    rows_per_block: int = 256  # at least
    seed: int = 20_240

    def shard_count(self, words: int, sources: int) -> int:
        return max(1, min(max(self.shards, words // WORDS_PER_SHARD), MOST_SHARDS, MOST_QUOTAS // max(1, sources)))

    def block_count(self, rows: int, all_rows: int) -> int:
        return max(1, min(rows // self.rows_per_block, MOST_BLOCKS * rows // max(1, all_rows)))


def targets(sizes: list[int], weights: list[int], percent: int = 150, most: int = MOST) -> list[float]:
    """Each source's share of ``percent`` of all sizes; what exceeds ``most`` times a size is reshared by weight."""
    left, out, free = sum(sizes) * percent / 100, [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        weight = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / weight > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / weight
            break
        for k in over:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in over]
    return out


def split_quotas(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard, how many of each source's ``counts`` blocks it gets; all are dealt, evenly and at random."""
    out: list[list[int]] = []

    def split(have: np.ndarray, width: int, path: str) -> None:
        if width == 1:
            out.append([int(x) for x in have])
            return
        half = width // 2
        total = int(have.sum())
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{path}".encode()).digest()[:8], "big"))
        # A source at a time: what it gives to the left, of what the left still lacks.
        lack, rest, left = total * half // width, total, np.zeros_like(have)
        for k, n in enumerate(have.tolist()):
            left[k] = rng.hypergeometric(n, rest - n, lack) if lack and n else 0
            lack, rest = lack - int(left[k]), rest - n
        split(left, half, path + "0")
        split(have - left, width - half, path + "1")

    split(np.array(counts, np.int64), shards, "")
    return out


@dataclass(frozen=True)
class Plan:
    """What decides on each document, by its ``_source`` and hash ``_h``."""

    sources: DataFrame  # a row a source
    blocks: DataFrame  # a row a block
    shards: int
    tied: bool  # of some equal rows only a part is taken

    def applied(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``_size``, ``_target`` of the source, and ``_shards``, one for each copy that the mix takes."""
        met = docs.join(F.broadcast(self.sources), F.col("_source").eqNullSafe(F.col("_name"))).withColumn("_block", F.pmod("_h", F.col("_n_blocks")))
        met = met.join(F.broadcast(self.blocks), ["_sid", "_block"])
        last = F.when(~F.col("_cut"), 0).when(F.col("_cut_h").isNull() | (F.col("_h") < F.col("_cut_h")), 1).otherwise(((F.col("_h") == F.col("_cut_h")) & (F.col("_tie") > 0)).cast("int"))
        partly = F.coalesce(F.col("_cut") & (F.col("_h") == F.col("_cut_h")) & (F.col("_tie") > 0) & (F.col("_tie") < F.col("_ties")), F.lit(False))
        out = met.withColumn("_last", last)
        if self.tied:  # equal rows, of which the first few by any order are taken
            each = settle(met.where(partly).withColumn("_at", F.monotonically_increasing_id()), "mix-ties")
            ranked = bucketed_rank(each, ["_sid"], [F.col("_at")], F.xxhash64("_at"), 256, "_rank")
            ranked = ranked.withColumn("_last", (F.col("_rank") < F.col("_tie")).cast("int")).drop("_rank", "_at")
            out = out.where(~partly).unionByName(ranked)
        return out.select(*docs.columns, "_size", "_target", F.slice("_block_shards", F.lit(1), F.col("_copies") + F.col("_last")).alias("_shards"))


def with_hash(documents: DataFrame, settings: Settings) -> DataFrame:
    """``_row`` (all columns), ``_source`` and ``_h``, a seeded hash of id and text."""
    rows = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("_row"))
    key = F.xxhash64("_row.doc_id", "_row.text")
    return rows.select("_row", F.col("_row.source").cast("string").alias("_source"), F.xxhash64(key, F.col("_row.doc_id").cast("long"), F.lit(settings.seed)).alias("_h"))


def slim_rows(documents: DataFrame, settings: Settings) -> DataFrame:
    size = F.size(split_words(F.col("_row.text"))).cast("long")
    return settle(with_hash(documents, settings).select(F.col("_row.doc_id").cast("long").alias("doc_id"), "_source", "_h", size.alias("size")), "mix-docs")


def plan(slim: DataFrame, settings: Settings = Settings()) -> Plan:
    """The plan for rows of ``_source, _h, size``."""
    spark = slim.sparkSession
    found = slim.groupBy("_source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes, rows = [r["size"] for r in found], sum(r["n"] for r in found)
    weights = [settings.weights[k % len(settings.weights)] for k in range(len(found))]
    wanted = targets(sizes, weights, settings.percent)
    table = [(k, r["_source"], int(r["size"]), float(t), settings.block_count(r["n"], rows)) for k, (r, t) in enumerate(zip(found, wanted, strict=True))]
    sources = spark.createDataFrame(table, "_sid int, _name string, _size long, _target double, _n_blocks long")
    docs = slim.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("_name"))).withColumn("_block", F.pmod("_h", F.col("_n_blocks")))

    # A target is so many whole passes over the source and a last pass of `part` words, taken block after block.
    blocks = docs.groupBy("_sid", "_block").agg(F.sum("size").alias("words"), F.first("_size").alias("_size"), F.first("_target").alias("_target"))
    order = F.xxhash64("_block", F.lit(settings.seed))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("_sid").orderBy(order, "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passes = F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(0).cast("int")
    blocks = blocks.withColumns({"before": before, "passes": passes}).withColumn("part", F.col("_target") - F.col("passes") * F.col("_size"))
    inside = (F.col("before") < F.col("part")) & (F.col("part") >= F.col("before") + F.col("words"))
    cut = (F.col("before") < F.col("part")) & ~inside
    blocks = settle(blocks.select("_sid", "_block", "before", "part", cut.alias("_cut"), (F.col("passes") + inside.cast("int")).alias("_copies")), "mix-blocks")

    # Inside a cut block documents are taken in the order of their hashes while the words before them, and half their own,
    # fall short of the target. Equal rows share a hash, so their run is one row here.
    cuts = blocks.where("_cut").select("_sid", "_block", (F.col("part") - F.col("before")).alias("room"))
    runs = docs.join(F.broadcast(cuts), ["_sid", "_block"]).groupBy("_sid", "_h").agg(F.first("room").alias("room"), F.count("*").alias("ties"), F.sum("size").alias("words"))
    run = F.coalesce(F.sum("words").over(Window.partitionBy("_sid").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = F.col("words") / F.col("ties")
    free = F.col("room") - F.col("run") - each / 2
    fit = F.when(free < 0, 0).when(each == 0, F.col("ties")).otherwise(F.least(F.col("ties"), F.floor(free / F.when(each > 0, each)) + 1))
    ends = runs.withColumn("run", run).withColumn("tie", fit.cast("long")).where("tie < ties")
    ends = {r["_sid"]: r["e"] for r in ends.groupBy("_sid").agg(F.min(F.struct("_h", "tie", "ties")).alias("e")).collect()}
    cut_rows = [(*row, *(ends[row[0]] if row[0] in ends else (None, None, None))) for row in table]
    sources = spark.createDataFrame(cut_rows, "_sid int, _name string, _size long, _target double, _n_blocks long, _cut_h long, _tie long, _ties long")

    # Ranks of the taken copies of blocks in their source's permutation, and the shards that those ranks fall to.
    most = F.col("_copies") + F.col("_cut").cast("int")
    copies = blocks.withColumn("most", most).where("most > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("most"))))
    rank = F.row_number().over(Window.partitionBy("_sid").orderBy(F.xxhash64("_block", "copy", F.lit(settings.seed + 1)), "_block", "copy")) - 1
    copies = settle(copies.select("_sid", "_block", "copy", rank.alias("rank")), "mix-copies")
    counts = {r["_sid"]: r["n"] for r in copies.groupBy("_sid").agg(F.count("*").alias("n")).collect()}
    shards = settings.shard_count(sum(sizes), len(table))
    quotas = split_quotas([counts.get(k, 0) for k in range(len(table))], shards, settings.seed)
    ends_dim = spark.createDataFrame([(k, np.cumsum([q[k] for q in quotas]).tolist()) for k in range(len(table))], "_sid int, ends array<long>")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int")
    dealt = copies.join(F.broadcast(ends_dim), "_sid").withColumn("shard", shard).groupBy("_sid", "_block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("at"))
    none = F.array().cast("array<int>")
    whole = settle(blocks.join(dealt, ["_sid", "_block"], "left").select("_sid", "_block", "_cut", "_copies", F.coalesce(F.col("at.shard"), none).alias("_block_shards")), "mix-plan")
    forget(copies, blocks)
    return Plan(sources, whole, shards, any(0 < e["tie"] < e["ties"] for e in ends.values()))


def mix_report(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, shards`` of every row."""
    slim = slim_rows(documents, settings)
    found = plan(slim, settings).applied(slim)
    return found.select("doc_id", "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.size("_shards")).alias("taken"), F.col("_shards").alias("shards"))


def mix(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``documents`` as often as the mix takes them, in files of shuffled shards.

    Each shard is sorted by a seeded hash inside its task: the local shuffle.
    """
    slim = slim_rows(documents, settings)
    found = plan(slim, settings)
    forget(slim)
    each = found.applied(with_hash(documents, settings)).select("_row", "_h", F.posexplode("_shards").alias("_copy", "_shard"))
    dealt = each.repartition(found.shards, "_shard")
    return dealt.sortWithinPartitions("_shard", F.xxhash64("_h", "_copy", F.lit(settings.seed))).select("_row.*")
