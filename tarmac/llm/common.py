"""Reading the corpus tables and cutting lineage in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import ensure_checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint location (spark.checkpoint.dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    The written table cuts the lineage, is columnar, and outlives any executor.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, copies: str, most: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, whose ``key`` is unique and whose ``copies`` counts the rows of each key.

    Fewer than ``most`` keys can have more than a share of 1/most of all rows; those are
    broadcast, so the rows of a hot key stay where they are. The others meet by a plain join.
    """
    total = keyed.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    hot = F.col(copies) * F.lit(most) > F.lit(total)
    heavy = F.broadcast(keyed.where(hot))
    light = rows.join(heavy.select(key), key, "left_anti").join(keyed.where(~hot), key)
    return rows.join(heavy, key).unionByName(light)


def running_sum(df: DataFrame, group: list[str], order: str, value: str, out: str, block: int = 128) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the group with a smaller ``order``.

    ``order`` is a non-negative integer, unique in its group. Rows are summed inside
    blocks of ``order`` and block totals are summed over, so no task sorts a whole group.
    """
    from pyspark.sql import Window as W

    blk = "_rs_block"
    d = df.withColumn(blk, (F.col(order) / F.lit(block)).cast("long"))
    totals = d.groupBy(*group, blk).agg(F.sum(value).alias("_rs_total"))
    before = W.partitionBy(*[F.col(g) for g in group]) if group else W.partitionBy(F.lit(1))
    totals = totals.withColumn(
        "_rs_before", F.coalesce(F.sum("_rs_total").over(before.orderBy(blk).rowsBetween(W.unboundedPreceding, -1)),
                                 F.lit(0))).drop("_rs_total")
    inside = W.partitionBy(*group, blk).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_rs_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return d.join(totals, [*group, blk]).withColumn(out, F.col("_rs_before") + F.col("_rs_in")) \
        .drop(blk, "_rs_before", "_rs_in")
