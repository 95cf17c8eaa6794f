"""Tables of a data folder, tables settled in the shared folder, and projections valid in both SQL dialects."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


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


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and the planner gets true sizes."""
    at = f"{shared_dir(df.sparkSession)}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: each row's rank from 1 by ``order``, from ranges that are ranked on their own; equal rows differ."""
    parts = settle(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_inside", inside).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_inside") + F.col("_start")).cast("int")).drop("_part", "_inside", "_start")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run ``sql``, in which ``{name}`` stands for a table of the folder."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


def oracle(sql: str, **relations: str) -> str:
    """The same projections as common table expressions before ``sql``."""
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    body, ctes = plain(sql).strip(), [f"{k} AS ({plain(v)})" for k, v in relations.items()]
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*ctes, body.removeprefix("WITH RECURSIVE ")])
    return ("WITH RECURSIVE " + ", ".join(ctes) + " " if ctes else "") + body
