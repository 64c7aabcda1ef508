"""The range join against all pairs, and how many rows it compares."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rowgrain import source
from rowgrain.operators.joins import range_join
from rowgrain.spec import GrainError


def pairs(df):
    return sorted((r.p, r.i) for r in df.select("p", "i").collect())


INSIDE = {
    "both": lambda x, a, b: a <= x <= b, "neither": lambda x, a, b: a < x < b, "low": lambda x, a, b: a <= x < b, "high": lambda x, a, b: a < x <= b,
}


@pytest.mark.parametrize("closed", INSIDE)
def test_doubles_of_any_size_against_all_pairs(spark, closed):
    draw = random.Random(3)
    value = lambda: draw.choice([-1, 1]) * 10 ** draw.uniform(-12, 12)
    points = [value() for _ in range(150)] + [0.0, -0.0, 1e308, -1e308, 5e-324, math.inf, -math.inf, 3.0, 3.0]
    ends = [sorted((value(), value())) for _ in range(60)] + [(x, x) for x in points[:20]] + [(x, x + abs(x) * 1e-9) for x in points[:20]]
    ends += [(0.0, 0.0), (-1e308, 1e308), (-math.inf, math.inf), (5e-324, 5e-324), (4.0, 3.0), (3.0, 3.0)]
    p = spark.createDataFrame([*enumerate(points), (-1, None), (-2, math.nan)], "p int, x double")
    i = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(ends)] + [(-1, None, 1.0), (-2, 1.0, None)], "i int, a double, b double")
    want = sorted((k, n) for k, x in enumerate(points) for n, (a, b) in enumerate(ends) if INSIDE[closed](x, a, b))
    assert pairs(range_join(p, i, "x", "a", "b", closed)) == want and len(want) > 1000


def test_open_ends_times_names_and_equal_columns(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    points = [(k, k % 3, day(k * 5)) for k in range(60)] + [(60, None, day(1))]
    spans = [(n, n % 3, day(n * 7) if n % 4 else None, day(n * 7 + 3**(n % 6)) if n % 5 else None) for n in range(40)]
    for kind in ("timestamp", "timestamp_ntz", "date"):
        p = spark.createDataFrame(points, "p int, g int, at timestamp_ntz").withColumn("at", F.col("at").cast(kind))
        i = spark.createDataFrame(spans, "i int, g int, at timestamp_ntz, until timestamp_ntz").withColumns({c: F.col(c).cast(kind) for c in ("at", "until")})
        cut = (lambda t: t and t.date()) if kind == "date" else (lambda t: t)
        inside = lambda x, a, b: (a is None or cut(a) <= cut(x)) and (b is None or cut(x) < cut(b))
        every = [(k, n, g == h) for k, g, x in points for n, h, a, b in spans if inside(x, a, b)]
        got = range_join(p, i, "at", "at", "until", "low", open_ends=True)
        assert got.columns == ["p", "g_r1", "at_r1", "i", "g_r2", "at_r2", "until"] and pairs(got) == sorted((k, n) for k, n, _ in every)
        got = range_join(p, i, "at", "at", "until", "low", equal="g", open_ends=True)
        assert got.columns == ["p", "g", "at_r1", "i", "at_r2", "until"] and pairs(got) == sorted((k, n) for k, n, same in every if same)


def test_empty_sides_grain_and_refusals(spark):
    p, i = spark.range(5).selectExpr("id as p", "id as x"), spark.range(3).selectExpr("id as i", "id as a", "id + 1 as b")
    assert range_join(p.limit(0), i, "x", "a", "b").count() == range_join(p, i.limit(0), "x", "a", "b").count() == 0
    assert range_join(p.filter("p > 9"), i.withColumn("p", F.col("i")), "x", "a", "b", equal="p").columns == ["p", "x", "i", "a", "b"]
    both = source(p, "p").range_join(source(i, "i"), "x", "a", "b")
    assert both.grain == {"p", "i"} and both.count() == 6
    with pytest.raises(GrainError):
        range_join(p, i, "x", "a", "b", "open")
    with pytest.raises(GrainError):
        range_join(p.withColumn("x", F.lit("t")), i, "x", "a", "b")




def test_a_burst_compares_little_more_than_the_result(spark, monkeypatch):
    """Most points within one second of a year, and intervals from a second to a year."""
    from rowgrain.operators import joins

    draw = random.Random(1)
    points = [(k, 1e7 + draw.random()) for k in range(2000)] + [(k, draw.random() * 3e7) for k in range(2000, 4000)]
    spans = [(n, s, s + 10 ** draw.uniform(-4, 4)) for n in range(2000) for s in [1e7 + draw.random() if n % 2 else draw.random() * 3e7]]
    p, i = spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(spans, "i int, a double, b double")
    result = range_join(p, i, "x", "a", "b").count()
    everything = lambda x, a, b: (F.lit(True), F.lit(True))
    monkeypatch.setitem(joins._INSIDE, "both", everything)
    met = range_join(p, i, "x", "a", "b").count()
    assert result <= met < 3 * result < 4000 * 2000 / 2
