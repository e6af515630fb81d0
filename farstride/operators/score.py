"""Score distributions, weighted picks, puzzles and guesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import offset_point
from ..functions.scalars import half_up, pct_of_best, tile_colour
from .graph import running
from .streets import cell_join

#: Shares at which a distribution is reported.
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)
#: Overrides of the daily settings: (twist, period, limit minutes, speed, transfer minutes, modes to keep).
TWISTS = [
    ("rush", None, None, None, None, None), ("rail-strike", None, None, None, None, [0, 2, 3]), ("bus-only", None, None, None, None, [0]), ("no-bus", None, None, None, None, [1, 2, 3]),
    ("late-night", "night", None, None, None, None), ("saturday", "weekend", None, None, None, None), ("quick-trip", None, 20, None, None, None), ("long-haul", None, 75, None, None, None),
    ("one-seat", None, None, None, 45, None), ("sore-feet", None, None, 3.0, None, None),
]
TWIST_SCHEMA = "twist string, period string, limit_min int, speed double, transfer_min int, modes array<int>"


def ordered_counts(scores: DataFrame, value: str) -> DataFrame:
    """Each distinct value with the rows below it and in all; values are counted before they are ordered, in range lanes."""
    counts = scores.groupBy(value).agg(F.count("*").alias("here"))
    total = counts.agg(F.sum("here").alias("total"))  # one row
    return running(counts, [value], "here", "below").crossJoin(F.broadcast(total))


def percentiles(scores: DataFrame, value: str) -> DataFrame:
    """pct: 100 times the share of rows strictly below each distinct value."""
    return ordered_counts(scores, value).select(value, (100 * F.col("below") / F.col("total")).alias("pct"))


def quantiles(scores: DataFrame, value: str, shares: tuple[float, ...] = QUANTILES) -> DataFrame:
    """The value at place min(n - 1, floor(share * n)) of the sorted rows."""
    share = F.explode(F.array(*(F.lit(float(q)) for q in shares)))
    rows = ordered_counts(scores, value).withColumn("share", share)
    place = F.least(F.col("total") - 1, F.floor(F.col("share") * F.col("total")))
    return rows.filter((F.col("below") <= place) & (place < F.col("below") + F.col("here"))).select("share", value)


def candidates(places: DataFrame, stops: DataFrame, radius: float = 1000, cap: int = 60, least: int = 5) -> DataFrame:
    """Neighbourhood-like places with weight min(stops within radius, cap), from `least` on. places, stops: (id, lon, lat).

    Points meet by their positions, each once: a position of stops counts as many as lie there, and all places of a position share its weight.
    """
    at = ["lon", "lat"]
    spots = places.select(*at).dropna().distinct().withColumn("id", F.struct(*at))
    held = stops.dropna(subset=at).groupBy(*at).agg(F.count("*").alias("n")).select(F.struct("lon", "lat", "n").alias("id"), *at)
    near = cell_join(spots, held, radius, 0.016).groupBy("id").agg(F.sum("other.n").alias("n")).select("id.lon", "id.lat", "n")
    weights = places.join(near, at).groupBy("id").agg(F.least(F.sum("n"), F.lit(cap)).alias("weight"))
    return weights.filter(F.col("weight") >= least)


def weighted_pick(rows: DataFrame, key: str, weight: str, at: float) -> DataFrame:
    """The first row by key whose running weight reaches `at` times the total."""
    total = rows.agg(F.sum(weight).alias("all"))  # one row
    run = running(rows, [key], weight, "before").crossJoin(F.broadcast(total))
    return run.filter(F.col("before") + F.col(weight) >= F.col("all") * at).orderBy("before", key).limit(1).select(*rows.columns)


def puzzle_summary(grid: DataFrame, key: str = "puzzle") -> DataFrame:
    """Best spot (ties to the first in scan order dy, dx), upper median, and whether the gates pass. grid: (puzzle, dx, dy, km2)."""
    w = W.partitionBy(key)
    rows = grid.withColumns({
        "rank": F.row_number().over(w.orderBy(F.desc("km2"), "dy", "dx")),
        "place": F.row_number().over(w.orderBy("km2", "dy", "dx")) - 1,
        "n": F.count("*").over(w),
    })
    out = rows.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.struct("dx", "dy", "km2"))).alias("best"),
        F.max(F.when(F.col("place") == F.floor(F.col("n") / 2), F.col("km2"))).alias("median"), F.count("*").alias("points"),
    )
    passed = (F.col("best.km2") >= 10) & (F.col("median") / F.nullif("best.km2", F.lit(0.0)) <= 0.8)
    return out.select(key, F.col("best.dx").alias("dx"), F.col("best.dy").alias("dy"), F.col("best.km2").alias("best"), "median", "points", F.coalesce(passed, F.lit(False)).alias("passed"))


def puzzle_grid(radius: int = 1000, step: int = 150) -> str:
    """SQL of the grid's offsets inside the disc, in scan order."""
    return f"SELECT dx, dy FROM (SELECT explode(sequence(-{radius}, {radius}, {step})) AS dy) LATERAL VIEW explode(sequence(-{radius}, {radius}, {step})) AS dx WHERE dx * dx + dy * dy <= {radius * radius}"


def graded(guesses: DataFrame, best: DataFrame, limit: int = 3) -> DataFrame:
    """The first guesses of each player and day, with share of the best, tile, and whether the day is over. best: (day, best)."""
    w = W.partitionBy("player", "day").orderBy("moment")
    rows = guesses.withColumn("guess", F.row_number().over(w)).filter(F.col("guess") <= limit).join(best, "day")
    rows = rows.withColumn("pct", pct_of_best("km2", "best"))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({"tile": tile_colour("pct"), "over": (F.col("guess") >= limit) | (F.max("pct").over(so_far) >= 99.5)})


def with_twists(params: DataFrame, twists: DataFrame) -> DataFrame:
    """Settings (twist, period, limit_min, speed, transfer_min, modes) after each twist's overrides."""
    t = twists.select("twist", *(F.col(c).alias(f"new_{c}") for c in ("period", "limit_min", "speed", "transfer_min", "modes")))
    out = params.join(t, "twist", "left")
    for c in ("period", "limit_min", "speed", "transfer_min", "modes"):
        out = out.withColumn(c, F.coalesce(f"new_{c}", c))
    return out.drop(*(f"new_{c}" for c in ("period", "limit_min", "speed", "transfer_min", "modes")))


def of_build(rows: DataFrame, column: str, build: str) -> DataFrame:
    """Rows that were made on this build of the graph; others are stale."""
    return rows.filter(F.col(column) == build)


def merge_by_date(existing: DataFrame, new: DataFrame, key: str = "date", force: bool = False) -> DataFrame:
    """Rows by date: earlier ones stay unless force."""
    if force:
        return existing.join(new.select(key), key, "left_anti").unionByName(new)
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def probes(centres: DataFrame, key: str, radius: float) -> DataFrame:
    """Each centre (k = -1) and six points around it: (key, k, lon, lat)."""
    k = F.explode(F.sequence(F.lit(-1), F.lit(5)))
    rows = centres.select(key, "lon", "lat", k.alias("k"))
    angle = F.col("k") / 6 * 2 * 3.141592653589793
    far = F.when(F.col("k") >= 0, radius).otherwise(0.0)
    lon, lat = offset_point("lon", "lat", far * F.cos(angle), far * F.sin(angle))
    return rows.select(key, "k", lon.alias("lon"), lat.alias("lat"))


def probe_gate(scored: DataFrame, key: str, least: float, most: float) -> DataFrame:
    """Whether an area's probes have a good spot, and differ enough."""
    out = scored.groupBy(key).agg(F.count("*").alias("probes"), F.max("km2").alias("best"), (F.min("km2") / F.nullif(F.max("km2"), F.lit(0.0))).alias("ratio"))
    return out.withColumn("passed", F.coalesce((F.col("best") >= least) & (F.col("ratio") <= most), F.lit(False)))


def valid_guesses(tried: DataFrame, radius: float, limit: int = 3) -> DataFrame:
    """The first guesses of each player that lie in the area and on land. tried: (player, event_id, dx, dy, water)."""
    ok = (F.hypot("dx", "dy") <= radius) & ~F.coalesce("water", F.lit(False))
    return tried.filter(ok).withColumn("k", F.row_number().over(W.partitionBy("player").orderBy("event_id"))).filter(F.col("k") <= limit).drop("k")


def share_texts(guesses: DataFrame, best, limit: int = 3) -> DataFrame:
    """A title, the tiles of the first guesses in order, and the best percentage. guesses: (player, moment, km2, title)."""
    rows = guesses.withColumn("k", F.row_number().over(W.partitionBy("player").orderBy("moment"))).filter(F.col("k") <= limit)
    pct = pct_of_best("km2", best)
    letter = F.upper(F.substring(tile_colour(pct), 1, 1))
    out = rows.groupBy("player").agg(F.array_sort(F.collect_list(F.struct("k", letter.alias("t")))).alias("tiles"), F.max(pct).alias("pct"), F.min("title").alias("title"))
    tiles = F.array_join(F.transform("tiles", lambda x: x["t"]), "")
    return out.select("player", F.concat("title", F.lit("\n"), tiles, F.lit(" "), half_up("pct").cast("string"), F.lit("%")).alias("text"))
