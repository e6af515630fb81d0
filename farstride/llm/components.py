"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on directed edges (u, v) with u > v."""
    both = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).unionByName(edges) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("m", F.least("u", "w")).drop("w")
    near = both.join(least, "u")
    if large:
        out = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and component (its smallest node) for every node with an edge in edges (a, b)."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    now, k, seen = scratch.save(now, f"{name}0"), 0, None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            break
        seen, k = mark, k + 1
        now = scratch.save(star(star(now, True), False), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
