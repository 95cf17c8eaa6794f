"""What the text operators share: the shared folder, settled tables, words and distributed ranks."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: The six ASCII white-space characters that separate words, for trim() and for regular expressions.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local session without it gets one of its own;
    on a cluster there is none to fall back on."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def settle(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and the planner gets true sizes. With
    ``release`` the driver drops what it no longer refers to, and with that the shuffle files of finished steps.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._settled_at = at
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if at := df.__dict__.pop("_settled_at", None):
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the filter of ``maybe_in``: at most 2^18 rows of 16 bytes are sent to the tasks, whatever the corpus.
FILTER_BITS = 1 << 24


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false only where ``key`` is certainly not in the one column of ``keys``.

    Rows that have nothing to look up thus pass by a join without being shuffled. Where hashes meet in the filter, or
    with more keys than it has bits, more rows take the join; no result depends on it.
    """
    spot = F.pmod(F.xxhash64(keys[keys.columns[0]]), F.lit(FILTER_BITS))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    words = keys.select(F.shiftright(spot, 6).alias("_word"), bit((spot % 64).cast("int")).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    own = rows.withColumn("_spot", F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))).withColumn("_word", F.shiftright("_spot", 6))
    met = own.join(F.broadcast(words), "_word", "left")
    on = F.col("_bits").bitwiseAND(bit((F.col("_spot") % 64).cast("int"))) != 0
    return met.withColumn("_maybe", F.coalesce(on, F.lit(False))).drop("_spot", "_word", "_bits")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def split_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    words = F.split(bare, SPACE_RE + "+")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(words)


def row_hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def bucketed_rank(df: DataFrame, group: list[str], order: list[Column], spread: Column, buckets: int, name: str) -> DataFrame:
    """Add ``name``: each row's gapless rank from 0 in its group, without one task per group.

    Rows are dealt to ``buckets`` by the hash ``spread``, ranked inside (group, bucket) and shifted by the counts of the
    group's earlier buckets. The order inside a group is therefore (bucket, order): a fixed pseudo-random order.
    """
    dealt = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_inside", F.row_number().over(inside) - 1)
    return ranked.join(starts, [*group, "_bucket"]).withColumn(name, F.col("_inside") + F.col("_start")).drop("_bucket", "_inside", "_start")
