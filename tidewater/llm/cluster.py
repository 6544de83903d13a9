"""Helpers shared by the operators: cutting lineage, size-checked broadcasts, components."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


EDGES = 50_000  # edges to a task, about, where components are found


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for what is cut.

    It is the one named by ``spark.checkpoint.dir``.  Where that is unset a temporary folder serves
    a session on one machine only; on a cluster, where executors wouldn't see it, that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidewater-checkpoint-"))
    return context.getCheckpointDir()


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of whatever store Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    With ``rows``, as many tasks read it as have about so many rows, so a small frame isn't
    dealt over all the tasks of a large one.
    """
    checkpoint_folder(df.sparkSession)
    df = df.checkpoint()
    return df if rows is None else df.coalesce(df.count() // rows + 1)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for a broadcast join if a count proves that it has at most ``rows`` rows.

    Callers pass frames whose rows have a bounded width; beyond the bound the join shuffles.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: ``(node, component)`` with the smallest node as name.

    ``edges`` has columns ``a`` and ``b`` of one orderable type, without nulls.  Alternates
    large-star and small-star steps: each needs only the minimum of a node's neighbours, so a
    node with very many neighbours is pre-aggregated before the shuffle and never collected.
    Only nodes that occur in an edge are returned; an empty graph gives an empty frame.  Rounds
    grow as the logarithm of the longest path; a graph that needs more than ``rounds`` is an error,
    never a partial result.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), EDGES)
    before = None
    for _ in range(rounds):
        both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        # large star: neighbours larger than x move to the least node around x
        pairs = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u itself, move to the least of them
        lower = pairs.groupBy("u").agg(F.min("v").alias("m"))
        moved = pairs.join(lower, "u")
        pairs = cut(
            moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lower.select("u", F.col("m").alias("v")))
            .distinct(),
            EDGES,
        )
        # a star forest is reached when the stars repeat themselves
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError("components did not settle")
