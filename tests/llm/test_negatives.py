"""Hard negatives against SQL and a scan, and the trees' bounds against all scores."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from farstride.llm import negatives


def vectors(n=420, seed=3, dims=6, spread=0.4):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, dims))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 5] + spread * rnd.normal(size=dims)], int(rnd.integers(0, 4))) for k in range(n)]
    rows += [(n + k, rows[50][1], rows[50][2]) for k in range(30)]  # ties among equal vectors
    rows += [(2000 + 50 * k, rows[50][1], rows[50][2]) for k in range(3)]
    return [*rows, (None, [1.0] * dims, 1), (5000, None, 1), (5050, [1.0] * dims, None), (5100, [float("nan")] + [1.0] * (dims - 1), 2), (5150, [None] + [1.0] * (dims - 1), 2), (5200, [], 1), (5250, [0.0] * dims, 3), (5300, [1.0, 2.0], 1), (5301, [2.0, 2.0], 1), (5302, [1.0, 0.5], 2), rows[10], (5350, [3.0], 9)]


SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)


def by_sql(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    return sorted(con.execute(negatives.ORACLE["op12_ball_tree_negatives"]).fetchall())


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_query_against_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 60)
    monkeypatch.setattr(negatives, "LOT", 5)
    monkeypatch.setattr(negatives, "PIVOTS", 4)
    table(spark, vectors()).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in negatives.op12_ball_tree_negatives(spark, str(tmp_path)).select(*COLUMNS).collect())
    assert got and got == by_sql(f"{tmp_path}/embeddings.parquet")


def test_no_anchor_no_row_and_no_other_label(spark):
    assert negatives.mine(table(spark, vectors()).limit(0), F.col("id") % 50 == 0).count() == 0
    alone = table(spark, [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1)])
    assert negatives.mine(alone, F.col("id") % 50 == 0).count() == 0
    lonely = table(spark, [(0, [1.0, 1.0], 1), (1, [0.7, 0.7], 2)])
    assert negatives.mine(lonely, F.col("id") % 50 == 0).count() == 0


def block(rnd, n, dims, near):
    at = rnd.normal(size=(8, dims)) * 300
    v = np.floor(at[rnd.integers(0, 8, n)] + near * rnd.normal(size=(n, dims))).astype(np.int64)
    return pd.DataFrame({"id": np.arange(n), "label": rnd.integers(0, 3, n).astype(str), "v": list(v)})


def test_blocks_find_what_a_scan_finds_with_fewer_scores():
    rnd = np.random.default_rng(1)
    rows = block(rnd, 3000, 8, 15)
    rows.loc[100:400, "v"] = pd.Series([rows["v"][7]] * 301, index=range(100, 401))
    asks = rows.iloc[::37].reset_index(drop=True)
    asks = pd.DataFrame({"ask": asks["id"].astype(str), "label": asks["label"], "v": asks["v"], "floor": negatives.LOW})
    scores = negatives.exact(negatives.matrix(asks["v"]), negatives.matrix(rows["v"]))
    for same, low, high in ((True, negatives.LOW, negatives.HIGH), (False, 200_000, 500_000)):
        found, scored = negatives.search_block(rows, asks.assign(low=low, high=high), 4, same)
        assert scored < 0.7 * scores.size
        for i, ask in enumerate(asks["ask"]):
            fits = ((rows["label"] == asks["label"][i]) == same) & (scores[i] >= low) & (scores[i] <= high)
            best = sorted((-scores[i, j], j) for j in np.flatnonzero(fits))[:4]
            mine = found[found["ask"] == ask]
            assert [(-s, i) for i, s in zip(mine["id"], mine["score"])] == best


def test_bounds_hold_for_every_row_of_every_node():
    rnd = np.random.default_rng(4)
    rows = block(rnd, 900, 5, 200)
    v, q = negatives.matrix(rows["v"]), negatives.matrix(rows["v"])[:20]
    tree = negatives.Tree(v, np.zeros(len(v)))
    for (lo, hi, *_), c, r in zip(tree.nodes, tree.centre, tree.radius):
        score, norm = q @ v[tree.order[lo:hi]].T, np.sqrt(np.square(q.astype(float)).sum(axis=1))
        assert (score <= (q @ c + norm * r)[:, None] + 1).all() and (score >= (q @ c - norm * r)[:, None] - 1).all()


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[1 << 30, 3]]), np.array([[(1 << 30) + 1, 5]])
    assert negatives.exact(a, b).tolist() == [[(1 << 60) + (1 << 30) + 15]]
