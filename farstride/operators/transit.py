"""Schedules to hops: time interpolation, hops by service period, agency report and clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import SERVICE_AREA, in_polygon
from ..functions.scalars import PERIODS, period_masks

#: Least share of an agency's stops inside the area, and agencies decided by hand.
MIN_INSIDE_SHARE, FORCE_INCLUDE, FORCE_EXCLUDE = 0.5, ("se",), ()


def interpolate(stop_times: DataFrame, column: str = "t", key: str = "trip", order: str = "seq") -> DataFrame:
    """Blank times of a trip between two known ones are spaced evenly by position; trailing ones carry the last; leading ones stay null."""
    w = W.partitionBy(key).orderBy(order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("__pos").alias("p"), F.col(column).alias("t")))
    rows = stop_times.withColumn("__pos", F.row_number().over(w))
    rows = rows.withColumns({"__a": F.last(known, ignorenulls=True).over(back), "__b": F.first(known, ignorenulls=True).over(ahead)})
    apart = F.col("__b.p") - F.col("__a.p")
    between = F.col("__a.t") + (F.col("__b.t") - F.col("__a.t")) * (F.col("__pos") - F.col("__a.p")) / F.nullif(apart, F.lit(0))
    filled = F.coalesce(F.col(column), between, F.col("__a.t"))
    return rows.withColumn(column, filled).drop("__pos", "__a", "__b")


def day_types(calendar: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """service, weekday, weekend: from calendar flags and dates added by hand (exception_type 1); ranges and removals don't count."""
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    flag = lambda names: F.greatest(*(F.col(d).cast("int") for d in names)) > 0
    out = calendar.select(F.col("service_id").alias("service"), flag(days[:5]).alias("weekday"), flag(days[5:]).alias("weekend"))
    if added is not None:
        on_weekday = F.weekday(F.to_date("date", "yyyyMMdd")) < 5
        more = added.filter(F.col("exception_type").cast("int") == 1).select(F.col("service_id").alias("service"), on_weekday.alias("weekday"), (~on_weekday).alias("weekend"))
        out = out.unionByName(more)
    return out.groupBy("service").agg(F.bool_or("weekday").alias("weekday"), F.bool_or("weekend").alias("weekend"))


def raw_hops(stop_times: DataFrame, arrival: str = "arr", departure: str = "dep") -> DataFrame:
    """Neighbouring stops of a trip with seconds of travel (at least 0) and departure hour; hops to the same stop or without times drop out."""
    w = W.partitionBy("trip").orderBy("seq")
    rows = stop_times.select("trip", F.col("stop").alias("from_stop"), F.lead("stop").over(w).alias("to_stop"), departure, F.lead(arrival).over(w).alias("__arr"))
    seconds = F.greatest(F.col("__arr") - F.col(departure), F.lit(0.0))
    rows = rows.select("trip", "from_stop", "to_stop", F.when(F.col("__arr").isNotNull() & F.col(departure).isNotNull(), seconds).alias("seconds"), F.floor(F.col(departure) / 3600).alias("hour"))
    return rows.filter((F.col("from_stop") != F.col("to_stop")) & F.col("seconds").isNotNull())


def timed_hops(stop_times: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """raw_hops of interpolated stop times (trip, stop, t): a hop's two times follow from the known ones around it, so a trip is gone through twice, in one order."""
    w = W.partitionBy("trip").orderBy(*order)
    known = "CASE WHEN t IS NOT NULL THEN __pos END"
    over = f"OVER (PARTITION BY trip ORDER BY {', '.join(order)}"
    last = lambda c: F.expr(f"last_value({c}) IGNORE NULLS {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    after = lambda c: F.expr(f"lead({c}) IGNORE NULLS {over})")
    rows = stop_times.withColumns({"__pos": F.row_number().over(w), "to_stop": F.lead("stop").over(w)}).withColumn("__known", F.expr(known))
    rows = rows.withColumns({"__p": last("__known"), "__pt": last("t"), "__n": after("__known"), "__nt": after("t")})
    at = lambda place: F.coalesce(F.col("__pt") + (F.col("__nt") - F.col("__pt")) * (place - F.col("__p")) / F.nullif(F.col("__n") - F.col("__p"), F.lit(0)), F.col("__pt"))
    left = F.coalesce("t", at(F.col("__pos")))
    arrived = F.when(F.col("__n") == F.col("__pos") + 1, F.col("__nt")).otherwise(at(F.col("__pos") + 1))
    rows = rows.filter(F.col("stop") != F.col("to_stop")).select("trip", F.col("stop").alias("from_stop"), "to_stop", left.alias("left"), arrived.alias("arrived"))
    return rows.filter(F.col("left").isNotNull() & F.col("arrived").isNotNull()).select("trip", "from_stop", "to_stop", F.greatest(F.col("arrived") - F.col("left"), F.lit(0.0)).alias("seconds"), F.floor(F.col("left") / 3600).alias("hour"))


def fastest_hops(hops: DataFrame, trips: DataFrame, services: DataFrame) -> DataFrame:
    """Fastest seconds of each (route, from, to), at any time and by period; null where a period has no service."""
    typed = hops.join(trips, "trip").join(services, "service", "left")
    for c in ("weekday", "weekend"):
        typed = typed.withColumn(c, F.coalesce(F.col(c), F.lit(False)))
    masks = period_masks("hour", "weekday", "weekend")
    return typed.filter(F.col("route").isNotNull()).groupBy("route", "from_stop", "to_stop").agg(
        F.min("seconds").alias("seconds"), *(F.min(F.when(masks[p], F.col("seconds"))).alias(f"s_{p}") for p in PERIODS)
    )


def agency_report(hops: DataFrame, routes: DataFrame, stops: DataFrame, names: DataFrame) -> DataFrame:
    """Stops served by each agency, share of them inside the service area, and the decision to keep it."""
    placed = stops.select("stop", in_polygon("lon", "lat", SERVICE_AREA).alias("inside"))
    of = hops.join(routes.select("route", "agency"), "route")
    served = of.select("agency", F.col("from_stop").alias("stop")).union(of.select("agency", "to_stop")).distinct()
    report = served.join(placed, "stop").groupBy("agency").agg(F.count("*").alias("stops"), F.avg(F.col("inside").cast("int")).alias("inside_share"))
    report = report.join(names, "agency", "left")
    called = lambda words: F.lower(F.col("agency").cast("string")).isin(*words) | F.lower("name").isin(*words) if words else F.lit(False)
    decision = F.when(called(FORCE_EXCLUDE), "exclude").when(called(FORCE_INCLUDE), "include").when(F.col("inside_share") >= MIN_INSIDE_SHARE, "include").otherwise("exclude")
    return report.withColumn("decision", decision)


def clip(hops: DataFrame, routes: DataFrame, stops: DataFrame, report: DataFrame) -> DataFrame:
    """Hops of kept agencies between stops inside the area."""
    kept = routes.join(report.filter("decision = 'include'").select("agency"), "agency", "left_semi").select("route")
    inside = stops.filter(in_polygon("lon", "lat", SERVICE_AREA)).select("stop")
    out = hops.join(kept, "route", "left_semi")
    for end in ("from_stop", "to_stop"):
        out = out.join(inside.withColumnRenamed("stop", end), end, "left_semi")
    return out


def patterns(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Distinct stop sequences of each route, with their first trip."""
    of = stop_times.groupBy("trip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop"))), lambda s: s["stop"].cast("string")), "\x1f").alias("pattern"))
    return of.join(trips, "trip").groupBy("route", "pattern").agg(F.min("trip").alias("trip"), F.count("*").alias("trips"))
