"""Golden results of rollups, raw reads, ranges and limits; grammar of query strings."""

import pytest
from pyspark.sql import functions as F

from tidemark import Aggregate, Query, SeriesBinding, parse_query_string, plan


def bound(spark, points, kind="bigint", **more):
    df = spark.createDataFrame([(i, ts, v) for i, (ts, v) in enumerate(points)], f"seq bigint, ts bigint, v {kind}")
    return SeriesBinding(df.orderBy(F.rand(3)), "m", "ts", (), ("v",), ("seq",), **more)


def rows(df):
    return [tuple(r) for r in df.collect()]


A = Aggregate
UNEVEN = list(zip([1000, 1500, 1600, 1700, 1800, 2000, 2100], [100, 10, 20, 30, 40, 50, 60]))
SIX = [1000, 1100, 1200, 1500, 1600, 1700]


@pytest.mark.parametrize(
    ("points", "kind", "method", "width", "want"),
    [
        (list(zip(SIX, [10, 20, 30, 40, 50, 60])), "bigint", A.AVG, 500, [(1000, 20), (1500, 50)]),
        (list(zip(SIX, [1, 2, 3, 4, 5, 6])), "bigint", A.NONE, 500, [(1000, 6), (1500, 15)]),
        ([(1000, 100), (1200, 200), (1400, 300)], "bigint", A.AVG, 100, [(1000, 100), (1200, 200), (1400, 300)]),
        ([(1000, 10), (1100, 20), (5000, 30), (5100, 40)], "bigint", A.AVG, 500, [(1000, 15), (5000, 35)]),
        (list(zip(SIX, [True, False, True, False, False, True])), "boolean", A.AVG, 500, [(1000, True), (1500, False)]),
        ([(1000, True), (1100, False), (1500, True), (1600, True)], "boolean", A.MIN, 500, [(1000, False), (1500, True)]),
        ([(1000, True), (1100, False), (1500, True), (1600, True)], "boolean", A.MAX, 500, [(1000, True), (1500, True)]),
        ([(1000, True), (1100, False), (1200, True)], "boolean", A.SUM, 500, [(1000, 2)]),
        ([(1000, 1), (1100, 2)], "bigint", A.AVG, 500, [(1000, 2)]),
        (UNEVEN, "bigint", A.AVG, 500, [(1000, 100), (1500, 25), (2000, 55)]),
        (UNEVEN, "bigint", A.COUNT, 500, [(1000, 1), (1500, 4), (2000, 2)]),
        (UNEVEN, "bigint", A.SUM, 500, [(1000, 100), (1500, 100), (2000, 110)]),
        (UNEVEN, "bigint", A.MIN, 500, [(1000, 100), (1500, 10), (2000, 50)]),
        (UNEVEN, "bigint", A.MAX, 500, [(1000, 100), (1500, 40), (2000, 60)]),
        (UNEVEN, "bigint", A.LAST, 500, [(1000, 100), (1500, 40), (2000, 60)]),
        ([(1000, -10), (1100, -20), (1200, 5)], "bigint", A.AVG, 500, [(1000, -7)]),
        ([(1000, -10), (1100, -20), (1200, 5)], "bigint", A.MIN, 500, [(1000, -20)]),
        ([(1000, 2_000_000_000)] + [(1100 + i, 2_000_000_000) for i in range(2)], "bigint", A.SUM, 10000, [(1000, 6_000_000_000)]),
        ([(1000, "a"), (1100, "b")], "string", A.LATEST, 500, [(1000, "b")]),
        ([(1000, "a"), (1100, "b")], "string", A.COUNT, 500, [(1000, 2)]),
        ([(1000, "a")], "string", A.MAX, 500, [(1000, None)]),
        ([(1000, "a")], "string", A.SUM, 500, [(1000, 0.0)]),
        ([(1000, float("nan")), (1100, 2.0), (1200, 1.0)], "double", A.MAX, 500, [(1000, 2.0)]),
        ([(1000, float("nan"))], "double", A.MIN, 500, [(1000, None)]),
        ([(1000, 10), (1100, 20), (1200, 30)], "bigint", A.AVG, 0, [(1000, 10), (1100, 20), (1200, 30)]),
    ],
)
def test_golden(spark, points, kind, method, width, want):
    assert rows(plan(Query("m", rollup_interval=width, method=method), bound(spark, points, kind))) == want


def test_float_average(spark):
    got = rows(plan(Query("m", rollup_interval=10000, method=A.AVG), bound(spark, [(1000, 1.0000001), (1001, 1.0000002), (1002, 1.0000003)], "double")))
    assert got[0][1] == pytest.approx(1.0000002, abs=1e-9)


BOUNDARY = [(ts, float(ts // 100)) for ts in range(1000, 6000, 1000)]


@pytest.mark.parametrize(
    ("start", "end", "want"),
    [(2000, 4000, [2000, 3000, 4000]), (2001, 3999, [3000]), (0, 999, []), (6000, 10000, []), (3000, 3000, [3000]), (0, 0, [1000, 2000, 3000, 4000, 5000]), (-5, -7, [1000, 2000, 3000, 4000, 5000]), (4000, 2000, [])],
)
def test_range(spark, start, end, want):
    assert [r[0] for r in rows(plan(Query("m", start_ms=start, end_ms=end), bound(spark, BOUNDARY, "double")))] == want


@pytest.mark.parametrize(("limit", "n"), [(10, 10), (1, 1), (500, 100), (0, 100)])
def test_limit(spark, limit, n):
    points = [(i * 1000, float(i)) for i in range(100)]
    assert [r[0] for r in rows(plan(Query("m", limit=limit), bound(spark, points, "double")))] == [i * 1000 for i in range(n)]
    assert len(rows(plan(Query("m", limit=limit, rollup_interval=1000, method=A.SUM), bound(spark, points, "double")))) == n


def test_last_write_wins(spark):
    two = [(1000, 1.0), (2000, 2.0), (3000, 3.0), (2000, 20.0), (3000, 30.0), (4000, 40.0)]
    assert rows(plan(Query("m"), bound(spark, two, "double"))) == [(1000, 1.0), (2000, 20.0), (3000, 30.0), (4000, 40.0)]
    assert rows(plan(Query("m"), bound(spark, [(5000, 10.0), (5000, 20.0), (5000, 30.0)], "double"))) == [(5000, 30.0)]
    assert rows(plan(Query("m", rollup_interval=10000, method=A.SUM), bound(spark, two, "double"))) == [(1000, 91.0)]


def tagged(spark):
    data = [("office", "sensor1", 1000 + 1000 * i, 10.0 + i) for i in range(3)] + [("warehouse", "sensor2", 1500 + 1000 * i, 20.0 + i) for i in range(2)]
    df = spark.createDataFrame(data, "location string, device string, ts bigint, temp double")
    return SeriesBinding(df, "tagged", "ts", ("location", "device"), ("temp",))


def test_tags(spark):
    ask = lambda *tags: [r[0] for r in rows(plan(Query("tagged", tags=tags), tagged(spark)))]
    assert ask() == [1000, 1500, 2000, 2500, 3000]
    assert ask(("location", "office")) == [1000, 2000, 3000]
    assert ask(("location", "office"), ("device", "sensor1")) == [1000, 2000, 3000]
    assert ask(("location", "office"), ("device", "sensor2")) == []
    assert ask(("room", "1")) == []


def test_fields_and_alignment(spark):
    df = spark.createDataFrame([(0, 1.0, None), (400, None, 5), (1200, 2.0, 7), (1300, 3.0, None)], "ts bigint, a double, b bigint")
    b = SeriesBinding(df, "m", "ts", (), ("a", "b"))
    assert rows(plan(Query("m"), b)) == [(0, 1.0, None), (400, None, 5), (1200, 2.0, 7), (1300, 3.0, None)]
    assert rows(plan(Query("m", zero_fill=True), b))[0] == (0, 1.0, 0)
    assert plan(Query("m", fields=("b", "x", "a", "b")), b).columns == ["ts_ms", "b", "a"]
    # each field has a grid of its own: a from 0, b from 400
    assert rows(plan(Query("m", rollup_interval=1000, method=A.COUNT), b)) == [(0, 1, 0), (400, 0, 2), (1000, 2, 0)]
    assert rows(plan(Query("m", limit=1), b)) == [(0, 1.0, None), (400, None, 5)]


def test_unknown_and_refused(spark):
    got = plan(Query("other"), tagged(spark))
    assert got.columns == ["ts_ms"] and got.count() == 0
    assert plan(Query("tagged", fields=("nothing",)), tagged(spark)).columns == ["ts_ms"]
    with pytest.raises(ValueError, match="measurement"):
        Query(None)
    with pytest.raises(ValueError, match="name"):
        SeriesBinding(spark.range(1), "", "id")
    with pytest.raises(ValueError, match="supported"):
        SeriesBinding(spark.createDataFrame([(1, [1])], "ts bigint, v array<int>"), "m", "ts", (), ("v",))


def test_plan_prunes_and_pushes(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    b = SeriesBinding(spark.read.parquet(path), "events", "ts", ("event_type", "user_id"), ("value",), ("event_id",))
    text = plan(Query("events", tags=(("event_type", "click"),), start_ms=1_704_412_800_000, rollup_interval=3_600_000, method=A.AVG), b)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text and "EqualTo(event_type,click)" in text
    assert "props" not in text and "CartesianProduct" not in text and "Python" not in text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("avg:m(a,b){k:v}", Query("m", (("k", "v"),), ("a", "b"), method=A.AVG)),
        ("MEAN:m()", Query("m", method=A.AVG)),
        ("sum:m( a , , b ){ k : v , l : w }  ", Query("m", (("k", "v"), ("l", "w")), ("a", "b"), method=A.SUM)),
        ("latest:m(a)", Query("m", fields=("a",))),
        ("count:m(a){}", Query("m", fields=("a",), method=A.COUNT)),
        ("last: m(a)", Query(" m", fields=("a",), method=A.LAST)),
    ],
)
def test_query_string(text, want):
    assert parse_query_string(text) == want


@pytest.mark.parametrize("text", [None, "", "avg", "avg:m", ":m(a)", "avg:(a)", "avg:m(a", "avg:m(a) x", "avg:m(a){k}", "avg:m(a){:v}", "avg:m(a){k:v", "avg:m(a){k:v} x", "avg:m(" + ",".join(f"f{i}" for i in range(65)) + ")", "avg:m(){" + ",".join(f"k{i}:v" for i in range(33)) + "}"])
def test_bad_query_string(text):
    with pytest.raises(ValueError):
        parse_query_string(text)
