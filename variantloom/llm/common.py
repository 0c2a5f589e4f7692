"""Shared parts: tables, the shared folder, bounded broadcasts, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

#: Rows of the narrow lookup tables (two or three longs) that may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: A word, as the contracts define it: a run of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/variantloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder among those of this application."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once no result of it is read any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and no task recomputes it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(d)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A lookup side for a join: broadcast up to BROADCAST_ROWS counted rows, else left to a sort-merge join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")


#: Copies of a row that one task writes.
COPIES = 100_000


def expanded(d: DataFrame, copies: str, most: int | None = None) -> DataFrame:
    """Each row ``copies`` times, with the number of the copy in ``_copy``; the copies of a row with very many come from several tasks."""
    most, one = most or COPIES, F.lit(0).cast("long")
    few = d.where(F.col(copies) <= most).withColumn("_from", one)
    many = d.where(F.col(copies) > most).withColumn("_from", F.explode(F.sequence(one, F.col(copies) - 1, F.lit(most).cast("long"))))
    d = few.unionByName(many.repartition(*d.columns, "_from"))
    return d.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col(copies), F.col("_from") + most) - 1))).drop("_from")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of an edge list; component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until
    the edges no longer change. No step gathers a node's neighbours: each is a
    grouped minimum (combined on the map side) and a join against those minima.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, "cc")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "cc-min")
        # Large star: every larger neighbour of u goes to the least of u and its neighbours.
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "cc-large")
        # Small star: u and its smaller neighbours go to the least of those.
        least2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        joined = large.join(small(least2), "u")
        star = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least2.select("u", F.col("m").alias("v"))).distinct()
        star = materialize(star, "cc-small")
        for old in (e, least, large, least2):
            delete(old)
        e = star
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(e: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then the edges give the components."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("x").agg(F.sum("i").alias("i"), F.max("o").alias("o")).where("i > 1 or (i = 1 and o = 1)").isEmpty()
