"""State of games and of waiting requests, kept by key in a stream; each has a twin over tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import meters_between

#: Guesses a day, and the share of the best spot (percent) that ends a day early.
GUESSES, ENOUGH = 3, 99.5
RESULT = "player long, guess long, lon double, lat double, km2 double, pct double, over boolean"
STATE = "last long, pin_lon double, pin_lat double, pin_valid boolean, lon double, lat double, guesses long, top double"
NEW = (-1, None, None, False, None, None, 0, 0.0)


def with_area(events: DataFrame, areas: DataFrame) -> DataFrame:
    """Events (player, moment, kind, lon, lat, water, km2) as play() takes them: with valid (inside the day's area and not in water) and best. areas: (player, centre_lon, centre_lat, radius, best)."""
    inside = meters_between("lon", "lat", "centre_lon", "centre_lat") <= F.col("radius")
    joined = events.join(areas, "player")
    return joined.select("player", "moment", "kind", "lon", "lat", "km2", F.coalesce(inside & ~F.coalesce("water", F.lit(False)), F.lit(False)).alias("valid"), "best")


def turn(state: tuple, e) -> tuple[tuple, tuple | None]:
    """The state after an event, and the guess that it settles, if any.

    place: sets the pin, until the day is over. submit: a valid pin is sent for its score, one at a time. answer: counts only if it is for the very point that was sent.
    Events not later than the last one seen are repeats and change nothing.
    """
    last, pin_lon, pin_lat, pin_valid, lon, lat, guesses, top = state
    if e.moment <= last:
        return state, None
    over = guesses >= GUESSES or top >= ENOUGH
    settled = None
    if e.kind == "place" and not over:
        pin_lon, pin_lat, pin_valid = e.lon, e.lat, bool(e.valid)
    elif e.kind == "submit" and pin_lon is not None and pin_valid and lon is None and not over:
        lon, lat = pin_lon, pin_lat
    elif e.kind == "answer" and lon is not None and (e.lon, e.lat) == (lon, lat):
        pct = min(100.0, 100 * e.km2 / e.best)
        guesses, top = guesses + 1, max(top, pct)
        settled = (e.player, guesses, lon, lat, e.km2, pct, guesses >= GUESSES or top >= ENOUGH)
        pin_lon = pin_lat = lon = lat = None
        pin_valid = False
    return (e.moment, pin_lon, pin_lat, pin_valid, lon, lat, guesses, top), settled


def rows_of(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=[c.split()[0] for c in RESULT.split(", ")])


def turns(state: tuple, events: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    found = []
    for e in events.sort_values("moment").itertuples(index=False):
        state, settled = turn(state, e)
        found += [settled] if settled else []
    return state, rows_of(found)


def games(events: DataFrame) -> DataFrame:
    """Settled guesses of a stream of with_area() events; the state of each player is small and fixed."""

    def play(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        plain = lambda x: None if x is None or x != x else x
        now = tuple(map(plain, state.get)) if state.exists else NEW
        now, out = turns(now, pd.concat(list(parts)))
        state.update(now)
        yield out

    return events.groupBy("player").applyInPandasWithState(play, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def played(events: DataFrame) -> DataFrame:
    """The same over a table of all events; a group is one player's."""
    return events.groupBy("player").applyInPandas(lambda pdf: turns(NEW, pdf)[1], RESULT)


WAITING = "ready boolean, numbers array<long>, bodies array<string>"


def queued(requests: DataFrame) -> DataFrame:
    """Requests (session, request, kind, body) of a stream, held back in their order until the session's record of kind `ready` has come; then they pass at once."""

    def hold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ready, numbers, bodies = (state.get[0], list(state.get[1]), list(state.get[2])) if state.exists else (False, [], [])
        new = pd.concat(list(parts)).sort_values("request")
        ready = bool(ready or (new["kind"] == "ready").any())
        asked = new[new["kind"] != "ready"]
        waiting = sorted({*zip(numbers, bodies, strict=True), *zip(asked["request"].tolist(), asked["body"].tolist(), strict=True)})
        out, kept = (waiting, []) if ready else ([], waiting)
        state.update((ready, [n for n, _ in kept], [b for _, b in kept]))
        yield pd.DataFrame({"session": [key[0]] * len(out), "request": [n for n, _ in out], "body": [b for _, b in out]})

    return requests.groupBy("session").applyInPandasWithState(hold, "session long, request long, body string", WAITING, "append", GroupStateTimeout.NoTimeout)


def serve_with_side(requests: DataFrame, side: str, answer: Callable[[DataFrame, DataFrame | None], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Answers each micro-batch with a Parquet table that may not be there yet: it is read anew each time, None until it exists. A batch that runs again replaces its own part."""

    def batch(df: DataFrame, number: int) -> None:
        try:
            table = df.sparkSession.read.parquet(side)
        except AnalysisException:
            table = None
        answer(df, table).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
