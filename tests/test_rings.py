"""Rings from open ways against the rings they were cut from."""

import random

from farstride.operators import places


def ways(seed):
    """Boundaries with several rings, each cut at random nodes into ways that are shuffled and turned."""
    rnd, out, want, node = random.Random(seed), [], {}, 0
    for b in range(6):
        way = 0
        for _ in range(rnd.randint(1, 3)):
            n = rnd.choice([3, 4, 7, 40])
            ring = [(node + k, float(node + k), float(k * k % 17)) for k in range(n)]
            node += n
            want.setdefault(b, []).append({frozenset((p[0], q[0])) for p, q in zip(ring, ring[1:] + ring[:1])})
            cuts = sorted(rnd.sample(range(n), rnd.randint(2, n)) if n < 40 else range(n))
            if rnd.random() < 0.2:
                cuts = cuts[:1]
            for a, z in zip(cuts, cuts[1:] + [cuts[0] + n]):
                part = [ring[k % n] for k in range(a, z + 1)]
                out.append((b, way, part if rnd.random() < 0.5 else part[::-1]))
                way += 1
        out.append((b, way, [(node, 0.0, 0.0), (node + 1, 0.0, 1.0), (node + 2, 1.0, 1.0)]))  # closes nothing
        out.append((b, way + 1, [(node + 2, 1.0, 1.0), (node + 3, 2.0, 1.0)]))
        out.append((b, way + 2, [(node + 3, 2.0, 1.0)]))
        node += 4
    rnd.shuffle(out)
    return out, want


SCHEMA = "boundary long, way long, points array<struct<node: long, lon: double, lat: double>>"


def test_rings_are_put_together(spark):
    for seed in (1, 2):
        rows, want = ways(seed)
        got = {}
        for r in places.rings(spark.createDataFrame(rows, SCHEMA)).collect():
            names = [p.node for p in r.points]
            assert names[0] == names[-1] and len(set(names)) == len(names) - 1
            got.setdefault(r.boundary, []).append({frozenset(e) for e in zip(names, names[1:])})
        key = lambda es: sorted(map(sorted, es))
        assert {b: sorted(x, key=key) for b, x in got.items()} == {b: sorted(x, key=key) for b, x in want.items()}


def test_three_ways_at_a_node_and_no_ways(spark):
    fork = [(1, k, [(0, 0.0, 0.0), (k + 1, 1.0, float(k))]) for k in range(3)]
    assert places.rings(spark.createDataFrame(fork, SCHEMA)).count() == 0
    assert places.rings(spark.createDataFrame([], SCHEMA)).count() == 0
