"""Assembly of the multimodal graph, and the orderings and codings of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import hilbert
from ..functions.scalars import unzigzag, zigzag
from .iterate import checkpointed

WALK, BOARD, RIDE, ALIGHT = 0, 1, 2, 3


def route_nodes(hops: DataFrame) -> DataFrame:
    """Distinct (route, stop) that hops touch."""
    return hops.select("route", F.col("from_stop").alias("stop")).union(hops.select("route", "to_stop")).distinct()


def node_name(kind: str, *columns: str):
    """Names of nodes in one space: s<street>, p<stop>, r<route>:<stop>."""
    return F.concat(F.lit(kind), F.concat_ws(":", *(F.col(c).cast("string") for c in columns)))


def assemble(street_edges: DataFrame, snapped: DataFrame, hops: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """src, dst, kind, weight (metres to walk, seconds to ride), route; snapped: (id stop, other street, d).

    Walking edges go both ways; boarding and alighting cost nothing here (a search adds waits and penalties).
    extra: further columns of hops (seconds by period) that ride edges keep.
    """
    none = {c: F.lit(None).cast("double") for c in extra}

    def family(df, src, dst, kind, weight, route=None):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), weight.cast("double").alias("weight"), (route if route is not None else F.lit(None)).cast("long").alias("route"), *(F.col(c) if kind == RIDE else none[c].alias(c) for c in extra))

    walks = street_edges.select("u", "v", "m").union(street_edges.select("v", "u", "m")).toDF("u", "v", "m")
    nodes = route_nodes(hops).join(snapped.select(F.col("id").alias("stop")), "stop", "left_semi")
    rides = hops
    for end in ("from_stop", "to_stop"):
        rides = rides.join(snapped.select(F.col("id").alias(end)), end, "left_semi")
    stop, street, at = node_name("p", "stop"), node_name("s", "other"), node_name("r", "route", "stop")
    own = node_name("p", "id")
    zero = F.lit(0.0)
    return (
        family(walks, node_name("s", "u"), node_name("s", "v"), WALK, F.col("m"))
        .unionByName(family(snapped, street, own, WALK, F.col("d")))
        .unionByName(family(snapped, own, street, WALK, F.col("d")))
        .unionByName(family(nodes, stop, at, BOARD, zero, F.col("route")))
        .unionByName(family(nodes, at, stop, ALIGHT, zero, F.col("route")))
        .unionByName(family(rides, node_name("r", "route", "from_stop"), node_name("r", "route", "to_stop"), RIDE, F.col("seconds"), F.col("route")))
    )


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def in_lanes(df: DataFrame, order: list[str], lanes: int) -> DataFrame:
    """df in range partitions of the given order, with its lane (__p) and its place there (__n); stored, as range bounds are sampled anew each time."""
    ranged = df.repartitionByRange(lanes, *order).sortWithinPartitions(*order)
    return checkpointed(ranged.withColumns({"__p": F.spark_partition_id(), "__n": F.monotonically_increasing_id()}))


def earlier_lanes():
    return W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)


def running(df: DataFrame, order: list[str], value: str, name: str, lanes: int = 64) -> DataFrame:
    """The sum of value over all rows before each row in the given order, without a task that sees all rows: sums within lanes, then offsets of lanes."""
    rows = in_lanes(df, order, lanes)
    sums = rows.groupBy("__p").agg(F.sum(value).alias("__c"))  # one row for each lane
    offsets = sums.select("__p", F.coalesce(F.sum("__c").over(earlier_lanes()), F.lit(0)).alias("__o"))
    own = F.coalesce(F.sum(value).over(W.partitionBy("__p").orderBy("__n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(offsets), "__p").withColumn(name, own + F.col("__o")).drop("__p", "__n", "__o")


def dense_ids(df: DataFrame, order: list[str], name: str, lanes: int = 64) -> DataFrame:
    """Gapless numbers from 0 in the given order."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", name, lanes).drop("__one")


def hilbert_place(nodes: DataFrame, bits: int = 16) -> DataFrame:
    """nodes with their place on the Hilbert curve over the bounding box."""
    box = nodes.agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("d")).first()
    if box.a is None:
        return nodes.withColumn("place", F.lit(None).cast("long"))
    full = (1 << bits) - 1
    scale = lambda x, lo, hi: F.floor((F.col(x) - lo) / max(hi - lo, 1e-12) * full).cast("long")
    return nodes.withColumn("place", hilbert(scale("lon", box.a, box.b), scale("lat", box.c, box.d), bits))


def delta_coded(df: DataFrame, column: str, order: str, key: str | None = None, lanes: int = 64) -> DataFrame:
    """column as zigzag codes of differences from the row before (0 before the first of each key, or of all)."""
    if key:
        return df.withColumn("code", zigzag(F.col(column) - F.coalesce(F.lag(column).over(W.partitionBy(key).orderBy(order)), F.lit(0))))
    rows = in_lanes(df, [order], lanes)
    ends = rows.groupBy("__p").agg(F.max_by(column, "__n").alias("__e"))  # one row for each lane
    before = ends.select("__p", F.last("__e", ignorenulls=True).over(earlier_lanes()).alias("__b"))
    last = F.coalesce(F.lag(column).over(W.partitionBy("__p").orderBy("__n")), "__b", F.lit(0))
    return rows.join(F.broadcast(before), "__p").withColumn("code", zigzag(F.col(column) - last)).drop("__p", "__n", "__b")


def delta_decoded(df: DataFrame, order: str, key: str | None = None) -> DataFrame:
    step = unzigzag("code")
    if key:
        return df.withColumn("value", F.sum(step).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    return running(df.withColumn("__step", step), [order], "__step", "__sum").withColumn("value", F.col("__sum") + F.col("__step")).drop("__sum", "__step")
