"""Named places and the boundaries around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import grid_cell, in_rings
from .iterate import Tables

# Kinds of places that a puzzle may lie in, and kinds of towns.
NEIGHBOURHOODS, TOWNS = ("neighbourhood", "suburb", "quarter"), ("city", "town", "village")


#: Levels of administrative boundaries that count as cities and as counties.
CITY_LEVEL, COUNTY_LEVEL = "8", "6"


def neighbourhood_places(places: DataFrame) -> DataFrame:
    """Named places of a kind that a puzzle may lie in. places: (place, name, type, ...)."""
    return places.filter(F.col("type").isin(*NEIGHBOURHOODS) & F.col("name").isNotNull())


def administrative(relations: DataFrame, level: str) -> DataFrame:
    """(boundary, name) of named administrative boundaries of a level. relations: (boundary, kind, name, level)."""
    return relations.filter((F.col("kind") == "administrative") & F.col("name").isNotNull() & (F.col("level") == level)).select("boundary", "name")


def rings(ways: DataFrame) -> DataFrame:
    """(boundary, ring, points) of the closed rings that a boundary's ways make up; ways: (boundary, way, points: node, lon, lat in order).

    Ways come in any order and direction. Each open way is an arc both ways, and an arc's successor is the other way that starts where it ends; where not just two
    ways meet, there is none. Pointer doubling finds each cycle's least arc, and from there each arc's place; so a ring of n ways takes about 2 log n
    rounds of joins. Of a ring's two directions the one with its least way's own direction stays. Ways that close no ring drop out.
    """
    tables = Tables(ways.sparkSession)
    ways = ways.filter(F.size("points") > 1).withColumns({"head": F.get("points", F.lit(0))["node"], "tail": F.element_at("points", -1)["node"]})
    ways = tables.save(ways)
    closed = ways.filter("head = tail").select("boundary", F.col("way").alias("ring"), "points")
    open_ways = ways.filter("head <> tail")
    arcs = open_ways.select("boundary", "way", F.lit(0).alias("back"), "head", "tail").unionByName(open_ways.select("boundary", "way", F.lit(1).alias("back"), F.col("tail").alias("head"), F.col("head").alias("tail")))
    arcs = tables.save(arcs.withColumn("arc", F.struct("way", "back")))
    meets = arcs.groupBy("boundary", "head").agg(F.count("*").alias("n"), F.min("arc").alias("a"), F.max("arc").alias("b")).filter("n = 2").withColumnRenamed("head", "tail")
    after = F.when(F.col("a.way") == F.col("way"), F.col("b")).otherwise(F.col("a"))
    now = arcs.join(meets, ["boundary", "tail"], "left").select("boundary", "arc", F.when(F.col("n").isNotNull(), after).alias("next"))
    now = tables.save(now.withColumns({"least": F.col("arc"), "ends": F.col("next").isNull()}))
    while True:  # least arc within 2^k steps; chains that end have no next any more
        ahead = now.select("boundary", F.col("arc").alias("next"), F.col("next").alias("far"), F.col("least").alias("their"), F.col("ends").alias("stops"))
        step = now.join(ahead, ["boundary", "next"], "left").withColumn("new", F.least("least", "their"))
        step = step.select("boundary", "arc", F.col("far").alias("next"), F.col("new").alias("least"), (F.col("ends") | F.coalesce("stops", F.lit(True))).alias("ends"), ((F.col("new") != F.col("least")) | (F.col("ends") != (F.col("ends") | F.coalesce("stops", F.lit(True))))).alias("moved"))
        step = tables.save(step)
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    cycles = tables.save(now.filter(~F.col("ends") & (F.col("least.back") == 0)).select("boundary", "arc", "least"))
    # places: steps to the least arc, by doubling over the cycle cut there
    links = arcs.join(meets, ["boundary", "tail"]).select("boundary", "arc", after.alias("next")).join(cycles, ["boundary", "arc"])
    rank = tables.save(links.select("boundary", "arc", "least", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"), F.when(F.col("next") != F.col("least"), 1).otherwise(0).cast("long").alias("left")))
    while not rank.filter("next IS NOT NULL").isEmpty():
        ahead = rank.select("boundary", F.col("arc").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        rank = tables.save(rank.join(ahead, ["boundary", "next"], "left").select("boundary", "arc", "least", F.col("far").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    parts = rank.select("boundary", "least", F.col("arc.way").alias("way"), F.col("arc.back").alias("back"), "left").join(ways, ["boundary", "way"])
    own = F.when(F.col("back") == 1, F.reverse("points")).otherwise(F.col("points"))
    whole = parts.groupBy("boundary", "least").agg(F.sort_array(F.collect_list(F.struct("left", F.slice(own, 1, F.size(own) - 1).alias("points"))), asc=False).alias("parts"))
    points = F.flatten(F.transform("parts", lambda p: p["points"]))
    joined = whole.select("boundary", F.col("least.way").alias("ring"), F.concat(points, F.slice(points, 1, 1)).alias("points"))
    return closed.unionByName(joined)


def ring_edges(found: DataFrame) -> DataFrame:
    """rings with edges, as containing() takes them."""
    edge = lambda p, q: F.struct(p["lon"].alias("x1"), p["lat"].alias("y1"), q["lon"].alias("x2"), q["lat"].alias("y2"))
    n = F.size("points")
    return found.withColumn("edges", F.zip_with(F.slice("points", 1, n - 1), F.slice("points", 2, n - 1), edge))


def containing(places: DataFrame, boundaries: DataFrame, size: float = 0.05) -> DataFrame:
    """(place, boundary name) of the last boundary (by ord) that has the place in any of its rings.

    places: (place, lon, lat), boundaries: (ord, name, edges: the x1, y1, x2, y2 of one ring), one row a ring. Rings are dealt to the
    grid cells that their boxes touch, so places meet them by an equi-join.
    """
    low = lambda *xs: F.array_min(F.flatten(F.array(*(F.col(f"edges.{x}") for x in xs))))
    high = lambda *xs: F.array_max(F.flatten(F.array(*(F.col(f"edges.{x}") for x in xs))))
    span = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
    rings = boundaries.withColumns({"ring": F.xxhash64("ord", "edges"), "cx": span(low("x1", "x2"), high("x1", "x2"))}).withColumn("cy", span(low("y1", "y2"), high("y1", "y2")))
    x, y = grid_cell("lon", "lat", size)
    near = places.select("place", "lon", "lat", x.alias("cx"), y.alias("cy")).join(rings, ["cx", "cy"])
    inside = near.filter(in_rings("lon", "lat", "edges"))
    return inside.groupBy("place").agg(F.max_by("name", "ord").alias("name"))


def with_city(places: DataFrame, cities: DataFrame, counties: DataFrame) -> DataFrame:
    """places with the city around them, else the county, else an empty text."""
    city, county = (containing(places, b).withColumnRenamed("name", n) for b, n in ((cities, "city_name"), (counties, "county_name")))
    out = places.join(city, "place", "left").join(county, "place", "left")
    return out.withColumn("city", F.coalesce(F.nullif("city_name", F.lit("")), "county_name", F.lit(""))).drop("city_name", "county_name")


def label(name: str, city: str):
    """`name, city` unless the city is empty or the same."""
    return F.when((F.coalesce(F.col(city), F.lit("")) != "") & (F.col(city) != F.col(name)), F.concat_ws(", ", name, city)).otherwise(F.col(name))
