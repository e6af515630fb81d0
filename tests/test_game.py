"""Games, waiting requests and late side data as streams that restart between micro-batches."""

import random

import pytest

from farstride.operators import hygiene
from farstride.plans import catalog, puzzles  # noqa: F401  adds its queries
from farstride.streaming import game

EVENT = "player long, moment long, kind string, lon double, lat double, water boolean, km2 double"
AREA = "player long, centre_lon double, centre_lat double, radius double, best double"


def streamed(spark, make, df, folder, batches):
    """What a stream gives over batches of rows, each in a run of its own from the same checkpoint."""
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, df).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(df).parquet(f"{folder}/in"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        out.append(sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect())))
    return out


def test_a_game_over_restarts(spark, tmp_path):
    areas = spark.createDataFrame([(p, -122.5, 37.5, 1000.0, 50.0) for p in (1, 2)], AREA)
    place = lambda p, m, lon, water=False: (p, m, "place", lon, 37.5, water, None)
    answer = lambda p, m, lon, km2: (p, m, "answer", lon, 37.5, None, km2)
    submit = lambda p, m: (p, m, "submit", None, None, None, None)
    first = [place(1, 1, -122.5), submit(1, 2), place(2, 1, -122.0), submit(2, 2), answer(2, 3, -122.0, 9.0)]  # 2's pin is far outside
    second = [answer(1, 3, -122.501, 44.0), answer(1, 4, -122.5, 40.0), answer(1, 5, -122.5, 45.0), answer(1, 4, -122.5, 40.0)]  # another point; right; stale; repeated
    third = [place(1, 6, -122.501, True), submit(1, 7), answer(1, 8, -122.501, 20.0), place(1, 9, -122.499), submit(1, 10), submit(1, 11), answer(1, 12, -122.499, 49.9), place(1, 13, -122.5), submit(1, 14), answer(1, 15, -122.5, 50.0)]
    runs = streamed(spark, lambda s: game.games(game.with_area(s, areas)), EVENT, tmp_path, [first, second, third])
    one, two = (1, 1, -122.5, 37.5, 40.0, 80.0, False), (1, 2, -122.499, 37.5, 49.9, pytest.approx(99.8), True)
    assert runs == [[], [one], [one, two]]
    batch = game.played(game.with_area(spark.createDataFrame(first + second + third, EVENT).repartition(3), areas))
    assert sorted(map(tuple, batch.collect())) == runs[-1]


def test_requests_wait_until_ready(spark, tmp_path):
    schema = "session long, request long, kind string, body string"
    ask = lambda s, n: (s, n, "ask", f"b{n}")
    runs = streamed(spark, game.queued, schema, tmp_path, [[ask(1, 2), ask(1, 1), ask(2, 1)], [ask(1, 3), ask(1, 2)], [(1, 0, "ready", None)], [ask(1, 4), ask(2, 2)]])
    assert runs == [[], [], [(1, 1, "b1"), (1, 2, "b2"), (1, 3, "b3")], [(1, 1, "b1"), (1, 2, "b2"), (1, 3, "b3"), (1, 4, "b4")]]


def test_shapes_that_come_late(spark, tmp_path):
    stops = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "stop long, lon double, lat double")
    shape = "route long, from_stop long, to_stop long, xs array<double>, ys array<double>"

    def answer(df, shapes):
        none = df.sparkSession.createDataFrame([], shape)
        return hygiene.with_geometry(df, none if shapes is None else shapes, stops)

    seen = []
    for k in range(2):
        spark.createDataFrame([(7, 1, 2)], "route long, from_stop long, to_stop long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("route long, from_stop long, to_stop long").parquet(f"{tmp_path}/in")
        game.serve_with_side(stream, f"{tmp_path}/shapes", answer, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        seen.append(spark.read.parquet(f"{tmp_path}/out/batch={k}").first())
        spark.createDataFrame([(7, 1, 2, [0.0, 0.5, 1.0], [0.0, 0.9, 1.0])], shape).write.mode("overwrite").parquet(f"{tmp_path}/shapes")
    assert [(r.straight, r.xs) for r in seen] == [(True, [0.0, 1.0]), (False, [0.0, 0.5, 1.0])]


def test_query_against_a_plain_walk(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(k, rnd.randint(1, 60), rnd.choice(["view", "click", "purchase", None]), rnd.choice([None, rnd.random() * 100])) for k in range(1500)]
    spark.createDataFrame(rows, "event_id long, user_id int, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.player, r.guess, r.moment, round(r.pct, 6), r.over) for r in catalog.QUERIES["game_guesses"](spark, str(tmp_path)).collect())
    want, games = [], {}
    for k, user, kind, value in rows:
        g = games.setdefault(user, {"pin": None, "sent": None, "n": 0, "top": 0.0})
        g["view"] = k if kind == "view" else g.get("view")
        over = g["n"] >= 3 or g["top"] >= 99.5
        if kind == "view" and not over:
            g["pin"] = k
        elif kind == "click" and g["pin"] is not None and g["pin"] % 5 and g["sent"] is None and not over:
            g["sent"] = g["pin"]
        elif kind == "purchase" and value is not None and g["sent"] is not None and g["sent"] == g["view"]:
            g["n"], pct = g["n"] + 1, min(100.0, 100 * value / 60)
            g["top"] = max(g["top"], pct)
            want.append((user, g["n"], g["sent"], round(pct, 6), g["n"] >= 3 or g["top"] >= 99.5))
            g["pin"] = g["sent"] = None
    assert got == sorted(want) and len(want) > 20
