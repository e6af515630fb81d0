"""Whole itineraries of searched origins: walks and rides with their stops, hops, metres and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .iterate import Tables
from .search import Reach

#: Walks of up to this many seconds are left out.
LEAST_S = 0.5


def steps(path: DataFrame) -> DataFrame:
    """Steps of paths in order, with their leg: a run on one route, or a run of stops and streets on foot."""
    w = W.partitionBy("origin", "target").orderBy(F.desc("step"))
    rows = path.withColumn("line", F.when(F.col("node").startswith("r"), F.split(F.substring("node", 2, 1 << 20), ":")[0]))
    rows = rows.withColumns({"i": F.row_number().over(w), "before": F.lag("node").over(w), "after": F.lead("node").over(w), "cost_before": F.lag("cost").over(w)})
    turn = (F.col("before").isNull() | ~F.col("line").eqNullSafe(F.lag("line").over(w))).cast("int")
    return rows.withColumn("leg", F.sum(turn).over(w.rowsBetween(W.unboundedPreceding, 0)))


def walked(found: Reach, rows: DataFrame) -> DataFrame:
    """(origin, target, leg, i, lons, lats): the way of each step on foot, from the spot or from a stop."""
    on_foot = rows.filter(F.col("line").isNull() & F.col("before").isNotNull() & ~F.col("before").startswith("r"))
    keys = ["origin", "target", "leg", "i"]
    home = on_foot.filter("before = ''").select(*keys, "node")
    away = on_foot.filter("before <> ''").select(*keys, "before", "node")
    line = lambda asks, seeds: found.roads.lines(asks, seeds).select("origin", "node", "lons", "lats")
    first = home.join(line(home.select("origin", "node"), found.seeds), ["origin", "node"])
    later = line(away.select(F.col("before").alias("origin"), "node"), found.stop_seeds).withColumnRenamed("origin", "before")
    return first.select(*keys, "lons", "lats").unionByName(away.join(later, ["before", "node"]).select(*keys, "lons", "lats"))


def ridden(found: Reach, rows: DataFrame, shapes: DataFrame | None) -> DataFrame:
    """(origin, target, leg, i, lons, lats): the boarding stop's place, then of each hop what follows its start: its shape (route, from_stop, to_stop, lons, lats), or the place where it ends."""
    at = found.places.select(F.col("node").alias("stop"), "lon", "lat")
    hops = rows.filter(F.col("line").isNotNull()).withColumn("boards", ~F.col("before").startswith("r"))
    id_of = lambda c: F.substring_index(c, ":", -1)
    hops = hops.withColumn("stop", F.concat(F.lit("p"), id_of("node"))).join(at, "stop")
    own = F.array("lon"), F.array("lat")
    if shapes is None:
        return hops.select("origin", "target", "leg", "i", own[0].alias("lons"), own[1].alias("lats"))
    known = shapes.select(F.col("route").cast("string").alias("line"), *(F.col(c).cast("string").alias(c) for c in ("from_stop", "to_stop")), F.col("lons").alias("xs"), F.col("lats").alias("ys"))
    hops = hops.withColumns({"from_stop": F.when(~F.col("boards"), id_of("before")), "to_stop": id_of("node")}).join(known, ["line", "from_stop", "to_stop"], "left")
    rest = lambda c, place: F.when(F.col(c).isNull(), place).otherwise(F.slice(c, 2, F.greatest(F.lit(1), F.size(c))))
    return hops.select("origin", "target", "leg", "i", rest("xs", own[0]).alias("lons"), rest("ys", own[1]).alias("lats"))


def itineraries(found: Reach, ends: DataFrame, starts: DataFrame, goals: DataFrame, names: DataFrame, shapes: DataFrame | None = None, lined: bool = True) -> DataFrame:
    """Legs of the way from each origin to each of its ends.

    ends: (origin, goal, node, seconds, walk_m, snapped) of search.destinations; starts: (origin, lon, lat); goals: (goal, lon, lat);
    names: (node, name) of stops; shapes: (route, from_stop, to_stop, lons, lats) of hops, where known.
    Result: origin, goal, leg (from 1), kind, route, from_stop, to_stop, hops, seconds, penalty (of boarding), metres (of walks), lons, lats,
    total (seconds of the whole way) and final_walk_m. The last walk goes on to the destination itself, unless it was snapped to the node.
    Without lined there are no lons and lats, and their walks aren't searched.
    """
    tables = Tables(ends.sparkSession)
    ends = tables.save(ends)
    rows = tables.save(steps(found.paths(ends.select("origin", "node").distinct())))
    first, last = (lambda c: F.min_by(c, "i")), (lambda c: F.max_by(c, "i"))
    legs = rows.groupBy("origin", "target", "leg").agg(
        first("line").alias("route"), first("before").alias("b"), first("node").alias("n"), last("node").alias("m"), last("after").alias("a"),
        first("cost").alias("begin"), last("cost").alias("end"), (first("cost") - first("cost_before")).alias("penalty"), (F.count("*") - 1).alias("hops"),
    )
    if lined:
        lines = walked(found, rows).unionByName(ridden(found, rows, shapes))
        # a stop where rides meet has no way of its own
        lines = lines.groupBy("origin", "target", "leg").agg(F.array_sort(F.collect_list(F.struct("i", "lons", "lats"))).alias("parts"))
        join = lambda c: F.flatten(F.transform("parts", lambda p: p[c]))
        lines = lines.select("origin", "target", "leg", join("lons").alias("lons"), join("lats").alias("lats"))
        legs = legs.join(lines, ["origin", "target", "leg"], "left")
    legs = legs.join(legs.groupBy("origin", "target").agg(F.max("leg").alias("final")), ["origin", "target"])
    legs = ends.withColumnRenamed("node", "target").join(legs, ["origin", "target"])
    ride, ending = F.col("route").isNotNull(), F.col("leg") == F.col("final")
    more = F.when(ending, F.col("walk_m") / found.speed).otherwise(0.0)
    seconds = F.col("end") - F.col("begin") + F.when(ride, 0.0).otherwise(more)
    goal_at, start_at = goals.select("goal", F.col("lon").alias("goal_lon"), F.col("lat").alias("goal_lat")), starts.select("origin", F.col("lon").alias("start_lon"), F.col("lat").alias("start_lat"))
    legs = legs.join(goal_at, "goal").join(start_at, "origin")
    whole = lambda c: F.concat(F.when(~ride & (F.col("leg") == 1), F.array(f"start_{c}")).otherwise(F.array()), F.coalesce(f"{c}s", F.array()), F.when(~ride & ending & ~F.col("snapped"), F.array(f"goal_{c}")).otherwise(F.array()))
    stop = lambda alias: names.select(F.col("node").alias(alias), F.col("name").alias(f"{alias}_name"))
    legs = legs.withColumns({"from": F.when(ride, F.col("b")), "to": F.when(ride, F.col("a")), "seconds_of": seconds})
    drawn = [whole("lon").alias("lons"), whole("lat").alias("lats")] if lined else []
    legs = legs.join(stop("from"), "from", "left").join(stop("to"), "to", "left").filter(ride | (F.col("seconds_of") > LEAST_S))
    order = F.row_number().over(W.partitionBy("origin", "goal").orderBy("leg"))
    on_ride = lambda c: F.when(ride, F.col(c))
    return legs.select(
        "origin", "goal", order.alias("leg"), F.when(ride, "ride").otherwise("walk").alias("kind"), "route", F.col("from_name").alias("from_stop"), F.col("to_name").alias("to_stop"), on_ride("hops").alias("hops"),
        F.col("seconds_of").alias("seconds"), on_ride("penalty").alias("penalty"), F.when(~ride, F.col("seconds_of") * found.speed).alias("metres"), *drawn,
        F.col("seconds").alias("total"), F.col("walk_m").alias("final_walk_m"),
    )
