"""Walkable streets: way filters, simplification, edges, components, and snapping of stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import grid_cell, haversine, meters_between, meters_from
from .iterate import Tables

# Tags that exclude a way.
HIGHWAYS_EXCLUDED = ("motorway", "motorway_link", "construction", "proposed", "abandoned", "bus_guideway", "raceway", "busway", "platform", "elevator")
SERVICES_EXCLUDED = ("parking_aisle", "driveway", "drive-through")
FOOTWAYS_EXCLUDED = ("sidewalk", "crossing", "traffic_island")
VERTEX_METERS, MAX_SNAP_METERS = 200, 400


def walkable() -> Column:
    """Over columns highway, foot, access, service, footway (null or empty: no such tag)."""
    tag = {c: F.coalesce(F.col(c), F.lit("")) for c in ("highway", "foot", "access", "service", "footway")}
    allowed = tag["foot"].isin("yes", "designated", "permissive")
    return (
        (tag["highway"] != "")
        & ~tag["highway"].isin(*HIGHWAYS_EXCLUDED)
        & ~tag["foot"].isin("no", "private", "discouraged")
        & (allowed | ~tag["access"].isin("no", "private"))
        & ~((tag["highway"] == "service") & tag["service"].isin(*SERVICES_EXCLUDED))
        & ~tag["footway"].isin(*FOOTWAYS_EXCLUDED)
    )


def valid_refs(refs: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Points of ways with two valid points at least, whose first point lies in the box."""
    w = W.partitionBy("way")
    rows = refs.dropna(subset=["lon", "lat"]).withColumns({"__n": F.count("*").over(w), "__lon": F.first("lon").over(w.orderBy("ord")), "__lat": F.first("lat").over(w.orderBy("ord"))})
    ok = (F.col("__n") >= 2) & F.col("__lon").between(bbox[0], bbox[2]) & F.col("__lat").between(bbox[1], bbox[3])
    return rows.filter(ok).drop("__n", "__lon", "__lat")


def simplify(refs: DataFrame) -> DataFrame:
    """Edges (way, u, v, m) between kept points of a way: its ends, points used more than once, and one about every VERTEX_METERS."""
    w = W.partitionBy("way").orderBy("ord")
    rows = refs.withColumns({"__lon": F.lag("lon").over(w), "__lat": F.lag("lat").over(w)})
    step = F.coalesce(haversine("__lon", "__lat", "lon", "lat"), F.lit(0.0))
    rows = rows.withColumn("cum", F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0)))
    bucket = F.floor(F.col("cum") / VERTEX_METERS)
    rows = rows.withColumns({
        "first": F.row_number().over(w) == 1,
        "last": F.lead("ord").over(w).isNull(),
        "uses": F.count("*").over(W.partitionBy("node")),
        "turn": bucket != F.lag(bucket).over(w),
    })
    kept = rows.filter(F.col("first") | F.col("last") | (F.col("uses") > 1) | F.col("turn"))
    out = kept.select("way", F.col("node").alias("u"), F.lead("node").over(w).alias("v"), (F.lead("cum").over(w) - F.col("cum")).alias("m"))
    return out.filter(F.col("v").isNotNull() & (F.col("u") != F.col("v")))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One undirected edge for each pair, the shortest."""
    return edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("m").alias("m"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component (smallest node connected to it).

    Each round hangs a node's larger neighbours under its smallest one, then a node and its smaller neighbours under the smallest of them, so
    chains halve and no join has a component's label as its key.
    """
    tables = Tables(nodes.sparkSession)

    def hung(pairs: DataFrame, larger: bool) -> DataFrame:
        """pairs (u, v) with u > v."""
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else pairs
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        under = both.join(least, "u")
        out = under.filter(F.col("v") > F.col("u")) if larger else under
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return (out if larger else out.unionByName(least.select("u", F.col("m").alias("v")))).filter(F.col("u") != F.col("v")).distinct()

    now = tables.save(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while (mark := now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != seen:
        seen = mark
        now = tables.save(hung(hung(now, True), False))
        tables.keep_last(1)
    return nodes.select("node").join(now.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def large_components(labels: DataFrame, least: int) -> DataFrame:
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    return labels.join(sizes.filter(F.col("size") >= least), "component")


def cell_join(points: DataFrame, others: DataFrame, radius: float, size: float, distance=meters_between) -> DataFrame:
    """Pairs within radius metres: an equi-join on grid cells of `size` degrees, each point with the cells around its own.

    A cell must be at least radius metres wide, which a size of 0.008 is for 400 m below 60 degrees of latitude.
    points and others: (id, lon, lat); the result has id, other and d.
    """
    x, y = grid_cell("lon", "lat", size)
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS i, j AS j))))"))
    mine = points.withColumn("c", around).select("id", "lon", "lat", (x + F.col("c.i")).alias("cx"), (y + F.col("c.j")).alias("cy"))
    theirs = others.select(F.col("id").alias("other"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), grid_cell("lon", "lat", size)[0].alias("cx"), grid_cell("lon", "lat", size)[1].alias("cy"))
    return mine.join(theirs, ["cx", "cy"]).withColumn("d", distance("lon", "lat", "lon2", "lat2")).filter(F.col("d") <= radius).select("id", "other", "d")


def snap(stops: DataFrame, nodes: DataFrame, radius: float = MAX_SNAP_METERS) -> DataFrame:
    """Nearest street node within radius of each stop: (id, other, d); ties to the smaller node."""
    near = cell_join(stops, nodes, radius, 0.008)
    best = near.groupBy("id").agg(F.min(F.struct("d", "other")).alias("b"))
    return best.select("id", "b.other", "b.d")


def ring_search(points: DataFrame, nodes: DataFrame, radius: float, rings: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """Nodes within the smallest of radius * rings that has any, for each point."""
    near = cell_join(points, nodes, radius * rings[-1], 0.008 * max(1.0, radius * rings[-1] / 400), meters_from)
    ring = F.lit(rings[-1])
    for r in reversed(rings[:-1]):
        ring = F.when(F.col("d") <= radius * r, r).otherwise(ring)
    near = near.withColumn("ring", ring)
    return near.withColumn("least", F.min("ring").over(W.partitionBy("id"))).filter("ring <= least").drop("least")
