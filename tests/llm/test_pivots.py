"""Clusters with pivots against plain whole-number arithmetic."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np

from rowgrain.llm import pivots
from helpers import SMALL

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, far int"


def plain(rows, how):
    """Rows of ``(vec_id, vector)`` in Python numbers alone."""
    usable = [(i, v) for i, v in rows if v is not None and len(v) == how.dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [int(x * how.scale // 1) if abs(x) < 1e15 else int(x) * how.scale for x in v], v) for i, v in usable]
    order = sorted((hashlib.sha256(f"{how.seed}:{i}".encode()).hexdigest(), v, q) for i, q, v in kept if i is not None)
    centre = [q for *_, q in order[: how.clusters]]
    if not centre:
        return []

    def nearest(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centre]
        return d.index(min(d)), min(d)

    for _ in range(how.rounds):
        at = [nearest(q)[0] for _, q, _ in kept]
        for c in range(len(centre)):
            own = [q for (_, q, _), k in zip(kept, at) if k == c]
            if own:
                centre[c] = [sum(x) // len(own) for x in zip(*own)]
    at = [nearest(q) for _, q, _ in kept]
    within = [sum(d for k, d in at if k == c) for c in range(len(centre))]
    fits = lambda x: x if x < 1 << 63 else None
    return [
        (i, k, fits(d), fits(within[k]), fits(sum(within)), hashlib.sha256(",".join(map(str, centre[k])).encode()).hexdigest())
        for (i, _, _), (k, d) in zip(kept, at)
    ]


def test_bounds_lose_no_centroid_and_spare_work():
    draw = np.random.default_rng(2)
    centre = draw.integers(-900, 900, (8, 64))
    x = centre[draw.integers(0, 8, 3000)] + draw.integers(-60, 60, (3000, 64))
    x[:50], x[50:60] = centre[3], (centre[0] + centre[1]) // 2
    p = pivots.choose_pivots(x[:300], 12)
    far = lambda y: np.sqrt(((y[:, None] - p) ** 2).sum(2).astype(float))
    at, best, spent = pivots.nearest(x, far(x), centre, far(centre))
    d = ((x[:, None] - centre) ** 2).sum(2)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all()
    assert spent < 2 * len(x)  # of eight times as many


def test_equal_centroids_go_to_the_smaller_number():
    x = np.array([[0, 0], [5, 5], [2, 2]])
    centre = np.array([[5, 5], [0, 0], [0, 0], [4, 4]])
    at, best, _ = pivots.nearest(x, np.zeros((3, 0)), centre, np.zeros((4, 0)))
    assert at.tolist() == [1, 0, 1] and best.tolist() == [0, 0, 8]


def test_given_vectors_against_plain_numbers_and_sql(spark):
    how = pivots.Clustering()
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = sorted(map(tuple, pivots.clusters(df, how).collect()))
    assert got == sorted(plain([(r.vec_id, r.embedding) for r in df.collect()], how))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    assert got == sorted(con.execute(pivots.clusters_sql(how)).fetchall())


def test_awkward_vectors(spark):
    how = pivots.Clustering(clusters=3, rounds=4, dim=2, sample=10)
    draw = random.Random(4)
    rows = [(i, [draw.uniform(-3, 3), draw.uniform(-3, 3)]) for i in range(40)]
    rows += [(50, None), (51, []), (52, [1.0]), (53, [1.0, None]), (54, [float("nan"), 1.0]), (55, [1.0, float("inf")]), (56, [1.0, 2.0, 3.0])]
    rows += [(None, [0.5, 0.5]), (7, [0.0, -0.0]), (7, [0.0, -0.0]), (60, [1e300, -1e300]), (61, [1e9, 5.0]), (62, [-1e308, 1.7e308])]
    df = lambda r: spark.createDataFrame([(i, v, 1, "x", 2) for i, v in r], SCHEMA)
    for given in (rows, rows[:47], rows[40:47], rows[:2], rows[47:48], []):
        got = pivots.clusters(df(given), how).collect()
        assert sorted(map(tuple, got), key=str) == sorted(plain(given, how), key=str)


def test_many_equal_vectors(spark):
    how = pivots.Clustering(clusters=4, rounds=3, dim=2)
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 0.0]) for i in range(5)]
    got = pivots.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), how).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, how))
