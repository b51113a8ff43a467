import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from glyphsieve.operators import relational

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("width", [60, 86_400])
def test_asof_join_against_brute_force(spark, width):
    rng = random.Random(1)
    when = lambda: START + dt.timedelta(seconds=rng.randrange(4000))
    left = [(k, rng.choice(["a", "a", "a", "b", None]), when()) for k in range(200)] + [(500, "a", None), (501, "z", START)]
    right = [(rng.choice(["a", "b", "c", None]), when(), k) for k in range(60)] + [("a", START, 900), ("a", START, 901), ("a", None, 1)]
    got = relational.asof_join(spark.createDataFrame(left, "k int, key string, at timestamp"), spark.createDataFrame(right, "key string, at timestamp, v int"), "key", "at", ["v"], width=width)
    want = {}
    for k, key, at in left:
        found = [(t, v) for rk, t, v in right if key is not None and rk == key and at and t and t <= at]
        want[k] = max(found)[1] if found else None
    assert {r["k"]: r["v"] for r in got.collect()} == want and got.columns == ["k", "key", "at", "v"]


def test_range_join_against_brute_force(spark):
    rng = random.Random(2)
    points = [(k, rng.uniform(-50, 50)) for k in range(150)] + [(500, None), (501, 10.0)]
    ranges = [(k, low, low + rng.choice([0.0, 3.0, 40.0])) for k in range(40) for low in [rng.uniform(-60, 50)]] + [(90, 10.0, 20.0), (91, 0.0, 10.0), (92, None, 1.0)]
    got = relational.range_join(spark.createDataFrame(points, "p int, at double"), spark.createDataFrame(ranges, "r int, low double, high double"), "at", "low", "high", 7.0)
    want = sorted((p, r) for p, at in points for r, low, high in ranges if at is not None and low is not None and low <= at < high)
    assert sorted((x["p"], x["r"]) for x in got.collect()) == want and (501, 90) in want and (501, 91) not in want


def test_sets_counts_and_dates(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert sorted(map(tuple, relational.shared_rows(a, b).collect())) == [(1, "first"), (2, "both"), (3, "second")]
    rows = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}), (None, {"c": 1})], "m map<string,bigint>, n map<string,bigint>")
    assert [r[0] for r in rows.select(relational.merged_counts(F.col("m"), F.col("n"))).collect()] == [{"a": 1, "b": 5}, {"c": 1}]
    texts = ["D:2024", "D:20240229", "D:20240229101112Z", "D:20240229101112-08'00'", "D:20240229101112+05'30", "2024", "D:20241399", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(F.unix_seconds(relational.from_pdf_date(F.col("t")))).collect()]
    at = lambda *x: int(dt.datetime(*x, tzinfo=dt.timezone.utc).timestamp())
    assert got == [at(2024, 1, 1), at(2024, 2, 29), at(2024, 2, 29, 10, 11, 12), at(2024, 2, 29, 18, 11, 12), at(2024, 2, 29, 4, 41, 12), None, None, None]


@pytest.mark.parametrize("width", [3.0, 50.0])
def test_range_totals_against_brute_force(spark, width):
    rng = random.Random(4)
    points = [(rng.randrange(-50, 50), rng.choice([1.25, -3.5, 0.1, None])) for _ in range(150)] + [(None, 1.0), (60, None), (70, float("inf")), (71, float("nan")), (72, 2.0)]
    ranges = [(k, low, low + rng.choice([0, 1, 7, 40])) for k in range(60) for low in [rng.randrange(-60, 50)]] + [(90, 60, 61), (91, 69, 71), (92, 70, 73), (93, 72, 90), (94, None, 1), (95, 69, 71), (96, 200, 300)]
    got = relational.range_totals(spark.createDataFrame(points, "at long, value double"), spark.createDataFrame(ranges, "r int, low long, high long"), "at", "low", "high", "value", width)
    want = {}
    for r, low, high in ranges:
        held = [v for at, v in points if low is not None and at is not None and low <= at < high]
        if held:
            valued = [v for v in held if v is not None]
            want[r] = (len(held), repr(round(sum(valued), 6) + 0.0) if valued else "None")
    assert {x["r"]: (x["n"], "None" if x["total"] is None else repr(round(x["total"], 6) + 0.0)) for x in got.collect()} == want and {90, 91, 92, 93, 95} <= set(want)


def test_range_totals_make_no_pairs(spark):
    """Where every point meets every range, a join would make 10 ** 10 rows."""
    rows = spark.range(100_000).selectExpr("id", "id % 10 AS at", "id % 10 - 5 AS low", "id % 10 + 20 AS high", "1.0D AS value")
    got = relational.range_totals(rows.select("at", "value"), rows.select("id", "low", "high"), "at", "low", "high", "value", 10)
    assert [tuple(r) for r in got.groupBy("low").agg({"n": "max", "total": "min", "id": "count"}).orderBy("low").select("low", "max(n)", "min(total)", "count(id)").collect()] == [(k - 5, 100_000 - 10_000 * max(0, k - 5), 100_000.0 - 10_000 * max(0, k - 5), 10_000) for k in range(10)]
