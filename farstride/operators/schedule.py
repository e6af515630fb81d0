"""The seeded calendar of twists, seeded picks, and the areas that recent days used."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Window as W

from ..functions.geo import grid_cell, meters_between
from .graph import in_lanes

# Fixed values of the generator: step of its state, seeds of cycles and of sampled nodes.
STEP, CYCLE_SEED, NODE_SEED = 0x6D2B79F5, 0x7157, 0x5EED
MASK = 0xFFFFFFFF


def draws(seed: int):
    """Uniform numbers of a 32-bit mixing generator."""
    state = seed
    while True:
        state = (state + STEP) & MASK
        t = ((state ^ (state >> 15)) * (1 | state)) & MASK
        t = ((t + (((t ^ (t >> 7)) * (61 | t)) & MASK)) & MASK) ^ t
        yield ((t ^ (t >> 14)) & MASK) / 4294967296


def times32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, by halves of a."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = F.shiftleft((F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(MASK))


def nth_draw(n: Column, seed: int) -> Column:
    """The n-th number (from 0) of the same generator, as a column: its state is the seed plus n + 1 steps."""
    s = (F.lit(seed).cast("long") + times32((n + 1).cast("long"), F.lit(STEP).cast("long"))).bitwiseAND(F.lit(MASK))
    t = times32(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1)))
    t = (t + times32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def cycles(count: int, size: int) -> list[list[int]]:
    """Orders of `size` twists, one a cycle, shuffled from its end by the cycle's own draws; none begins with three of which one was among the last three."""
    out: list[list[int]] = []
    for c in range(count):
        numbers = draws(CYCLE_SEED + c)
        before = set(out[-1][-3:]) if out else set()
        while True:
            order = list(range(size))
            for last in range(size - 1, 0, -1):
                pick = int(next(numbers) * (last + 1))
                order[last], order[pick] = order[pick], order[last]
            if not before & set(order[:3]):
                break
        out.append(order)
    return out


def scheduled(days: DataFrame, twists: list[str], last: int) -> DataFrame:
    """days (n: 1 on the first day) with the twist of each; last is the greatest n."""
    size = len(twists)
    rows = [(c, k, twists[t]) for c, order in enumerate(cycles((last - 1) // size + 1, size)) for k, t in enumerate(order)]
    table = days.sparkSession.createDataFrame(rows, "cycle long, place long, twist string")  # one row for each day
    at = days.withColumns({"cycle": F.floor((F.col("n") - 1) / size), "place": (F.col("n") - 1) % size})
    return at.join(table, ["cycle", "place"])


def fresh(candidates: DataFrame, used: DataFrame, days: int = 14, radius: float = 2500.0) -> DataFrame:
    """candidates (day, name, lon, lat) whose name no used row (day, name, lon, lat) has, and that lie farther than radius from all areas used in the days before.

    Areas meet candidates by day, grid cell and position, each once; a cell is wider than the radius up to 60 degrees of latitude. Those rows are many times
    the used ones, which the planner's estimate doesn't see, so the joins say that neither side goes through the driver.
    """
    size = radius / 111_195 * 2.1
    x, y = grid_cell("lon", "lat", size)
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS i, j AS j))))"))
    ahead = F.explode(F.sequence(F.lit(1), F.lit(days)))
    at = ["day", "lon", "lat"]
    recent = used.select(*at).distinct().withColumn("ahead", ahead).select(F.date_add("day", F.col("ahead")).alias("day"), "lon", "lat").distinct().withColumn("c", around)
    recent = recent.select("day", (x + F.col("c.i")).alias("cx"), (y + F.col("c.j")).alias("cy"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    new = candidates.join(used.select("name").distinct(), "name", "left_anti")
    asked = new.select(*at).distinct().withColumns({"cx": x, "cy": y})
    near = meters_between("lon", "lat", "lon2", "lat2") <= radius
    taken = asked.join(recent.hint("merge"), ["day", "cx", "cy"]).filter(near).select(*at).distinct()
    return new.join(taken.hint("merge"), at, "left_anti").select(*candidates.columns)


#: Draws for a day at most, days for which an area is kept from its neighbourhood, and metres; a day's seed is its number times DAY_SEED.
ATTEMPTS, RECENT_DAYS, RECENT_M, DAY_SEED = 40, 14, 2500.0, 7919
#: Areas of a lane of the pool, about.
LANE = 10_000


class Pool:
    """Weighted draws without replacement from areas (area, name, lon, lat, weight, ord), in the order of ord.

    The pool stays in range lanes; the driver holds one running weight a lane, and the areas near where a day's draws can fall.
    """

    def __init__(self, areas: DataFrame):
        lanes = max(1, -(-areas.count() // LANE))
        self.rows = self.open = in_lanes(areas, ["ord"], lanes)
        self.shared = not self.rows.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()

    def begin(self, used: set[str], recent: list[tuple[float, float]], metres: float) -> None:
        """Only areas whose name isn't used and that lie farther than metres from all recent ones are drawn from now on."""
        self.open = self.rows.filter(~F.col("name").isin(*used)) if used else self.rows
        for lon, lat in recent:
            self.open = self.open.filter(meters_between("lon", "lat", F.lit(lon), F.lit(lat)) > metres)

    def draws(self, shares: list[float]) -> list:
        """One area for each share, the first at which the running weight reaches that share of all that is left; areas of its name leave the pool. Fewer if nothing is left.

        What earlier draws take off moves a later one by no more than their weight, so all of them are found among the areas that near their places.
        Draws after names have taken off more than was thought are made anew.
        """
        found: list = []
        while len(found) < len(shares):
            lanes = self.open.groupBy("__p").agg(F.sum("weight").alias("w"), F.max("weight").alias("most")).orderBy("__p").collect()  # one row a lane
            todo, total = shares[len(found) :], sum(r.w for r in lanes)
            if total <= 0:
                break
            slack = len(todo) * max(r.most for r in lanes)
            more = walked(self.near(lanes, sorted((s * (total - slack), s * total + slack) for s in todo)), todo, total, slack)
            found += more
            self.open = self.open.filter(~F.col("name").isin(*(r.name for r in more)))
        return found

    def near(self, lanes: list, spans: list[tuple[float, float]]) -> list:
        """Areas whose running weight meets a span, in order, and what else their names have between the spans, as one row (at: null) a name and gap."""
        merged = [list(spans[0])]
        for low, high in spans[1:]:
            if low <= merged[-1][1]:
                merged[-1][1] = max(high, merged[-1][1])
            else:
                merged.append([low, high])
        before, offsets = 0, []
        for r in lanes:
            offsets.append((r["__p"], before))
            before += r.w
        offset = F.broadcast(self.rows.sparkSession.createDataFrame(offsets, "__p int, __o long"))  # one row a lane
        so_far = F.sum("weight").over(W.partitionBy("__p").orderBy("__n").rowsBetween(W.unboundedPreceding, 0))
        rows = self.open.withColumn("run", so_far).join(offset, "__p").withColumn("run", F.col("run") + F.col("__o"))
        run = F.col("run")
        meets = reduce(or_, ((run >= low) & (run - F.col("weight") <= high) for low, high in merged))
        rows = rows.withColumns({"at": F.when(meets, run), "gap": reduce(add, ((run >= low).cast("int") for low, _ in merged))})
        first, found = F.first(F.struct("area", "lon", "lat")).alias("a"), rows.filter(F.col("at").isNotNull())
        # where each name has one area, there is nothing of theirs elsewhere
        kept = (rows.join(found.select("name").distinct(), "name", "left_semi") if self.shared else found).groupBy("name", "gap", "at").agg(F.sum("weight").alias("weight"), F.max("run").alias("run"), first)
        return sorted(kept.select("name", "at", "weight", "run", "a.area", "a.lon", "a.lat").collect(), key=lambda r: r.run)


def walked(rows: list, shares: list[float], total: int, slack: int) -> list:
    """The areas that are drawn, from rows of Pool.near(), as long as earlier draws took off no more than slack."""
    found, gone, off = [], set(), 0
    weight: dict[str, int] = {}
    for r in rows:
        weight[r.name] = weight.get(r.name, 0) + r.weight
    for share in shares:
        if off > slack or off >= total:
            break
        passed = 0
        for r in rows:
            if r.name in gone:
                passed += r.weight
            elif r.at is not None and r.run - passed >= share * (total - off):
                break
        found.append(r)
        gone.add(r.name)
        off += weight[r.name]
    return found


def puzzle_days(days: DataFrame, areas: DataFrame, passing, used: set[str] | None = None, attempts: int = ATTEMPTS, recent_m: float = RECENT_M, strict: bool = True) -> DataFrame:
    """(n, date, twist, area, name, attempt): the area of each day, drawn one day after another.

    days: (n, date, twist), one row a day of the range that is asked for; areas: (area, name, lon, lat, weight, ord); passing: (area, twist) that meet the gates,
    or a function that is given a day's draws (area, name, lon, lat) in order and its twist, and returns the place of the first that meets them, or None.
    A drawn area that fails its day's gates isn't drawn again, on any day. A day without an area after `attempts` draws is an error, or, unless strict, a row
    without area and name.
    """

    def listed(drawn: list, twist: str):
        met = {r.area for r in passing.filter((F.col("twist") == twist) & F.col("area").isin(*(r.area for r in drawn))).select("area").distinct().collect()}
        return next((k for k, r in enumerate(drawn) if r.area in met), None)

    spark, pool, used = days.sparkSession, Pool(areas), set(used or ())
    first = listed if isinstance(passing, DataFrame) else passing
    rows, chosen = [], []
    for d in sorted(days.select("n", "date", "twist").collect(), key=lambda d: d.n):
        numbers = draws(d.n * DAY_SEED & MASK)
        pool.begin(used, [at for when, at in chosen if 0 < (d.date - when).days <= RECENT_DAYS], recent_m)
        drawn = pool.draws([next(numbers) for _ in range(attempts)])
        k = first(drawn, d.twist) if drawn else None
        used |= {r.name for r in (drawn if k is None else drawn[: k + 1])}
        if k is not None:
            chosen.append((d.date, (drawn[k].lon, drawn[k].lat)))
            rows.append((d.n, d.date, d.twist, drawn[k].area, drawn[k].name, k + 1))
        elif strict:
            raise ValueError(f"no area for {d.date} ({d.twist}) after {attempts} draws")
        else:
            rows.append((d.n, d.date, d.twist, None, None, len(drawn)))
    schema = f"n long, date date, twist string, area {areas.schema['area'].dataType.simpleString()}, name string, attempt int"
    return spark.createDataFrame(rows, schema)  # one row a day
