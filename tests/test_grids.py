"""Grids of areas: what makes them."""

from farstride.plans import puzzles


def test_grids_are_made_by_tasks_that_grow_in_number(spark, monkeypatch):
    """The centres are a small table: two tasks made the grids of all of them, whatever the number."""
    centres = spark.range(1, 41).selectExpr("id AS place", "-122.5 + id * 1e-3 AS lon", "37.5 + id * 1e-3 AS lat").coalesce(1)
    whole = puzzles.spread_out(centres, "place")
    rows = sorted(map(tuple, whole.collect()))
    assert whole.rdd.getNumPartitions() == 1 and len(rows) % 40 == 0
    monkeypatch.setattr(puzzles, "SPREAD_AT_ONCE", 6)
    many = puzzles.spread_out(centres, "place")
    assert many.rdd.getNumPartitions() == 7 and sorted(map(tuple, many.collect())) == rows
