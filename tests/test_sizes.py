"""What shows on larger tables only: points written over, and how much a task holds."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import Aggregate, Query, catalogue
from tidemark.sources import store as store_module
from tidemark.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The events three times, with other ids."""
    sf = str(tmp_path_factory.mktemp("repeated"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    copies = events.crossJoin(spark.range(3).withColumnRenamed("id", "_n")).withColumn("event_id", F.col("event_id") + 1_000_000 * F.col("_n"))
    copies.drop("_n").coalesce(1).write.parquet(f"{sf}/events.parquet")
    return sf


@pytest.mark.parametrize("name", ["store_expire", "store_timestamp_range", "store_raw", "compact_levels", "compact_equivalence"])
def test_equals_sql_on_repeated_points(spark, repeated, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{repeated}/events.parquet/*.parquet'")
    df = catalogue.Q[name](spark, repeated)
    result = con.execute(catalogue.SQL[name])
    names = [d[0] for d in result.description]
    want = sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in result.fetchall())
    assert sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in names) for r in df.collect()) == want


def files(spark, store, batch):
    """Points of each file of a batch."""
    found = spark.read.parquet(f"{store.root}/{batch.path}").groupBy(F.input_file_name()).count().collect()
    return [r["count"] for r in found]


@pytest.fixture
def small(spark, tmp_path, monkeypatch):
    """A store whose tasks take about 1000 points each."""
    monkeypatch.setattr(store_module, "TASK_POINTS", 1000, raising=False)
    return Store(spark, f"file://{tmp_path}/store", auto_compact=False)


@pytest.mark.parametrize("at", ["id", "7L"])
def test_a_write_is_dealt_by_points(spark, small, at):
    """One field of one series from one partition, even all at one time, is sorted by several tasks; the last write still counts."""
    rows = spark.range(10_000, numPartitions=1).selectExpr(f"{at} AS ts_ms", "id AS v")
    assert small.insert("m", rows)
    assert small.insert("m", rows.withColumn("v", F.col("v") + 1))
    for batch in small.manifest.batches:
        counts = files(spark, small, batch)
        assert sum(counts) == batch.rows == 10_000 and max(counts) < 2500 and batch.files == len(counts)
    got = small.query(Query("m")).collect()
    assert [tuple(r) for r in got] == ([(i, i + 1) for i in range(10_000)] if at == "id" else [(7, 10_000)])


def test_a_write_with_a_clash_is_dealt_by_points(spark, small):
    rows = spark.range(10_000, numPartitions=1).selectExpr("id AS ts_ms", "id AS v", "id AS w")
    assert small.insert("m", rows.select("ts_ms", F.col("v").cast("double")))
    assert not small.insert("m", rows)
    counts = files(spark, small, small.manifest.batches[1])
    assert sum(counts) == 10_000 and 8 <= len(counts) and max(counts) < 2500


def test_series_of_a_write_take_no_sort(spark, small):
    """A batch's tags are told from its points by hashing: a map as an aggregate's value would sort them all."""
    points = spark.range(100).selectExpr("id AS ts_ms", "CAST(id % 3 AS string) AS s", "CAST(NULL AS string) AS none", "id AS v", "id > 5 AS w")
    small.insert("m", points, tag_cols=("s", "none"), fields=("v", "w"), tags={"a": "b"})
    series = small._series_of(small.manifest.batches[0], ["v", "w"])
    assert "SortAggregate" not in series._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["field"], r["tags"]["s"], r["tags"]["a"], len(r["tags"]), r["ftype"], r["seq"], r["place"]) for r in series.collect())
    assert got == [(f, s, "b", 2, t, None, p) for f, t, p in (("v", "bigint", 1), ("w", "boolean", 2)) for s in "012"]


def test_reads_are_dealt_by_points(spark, small):
    """What a split of files holds isn't aggregated before it is dealt; filters and columns still reach the files."""
    small.insert("m", spark.range(3000).selectExpr("id div 3 AS ts_ms", "CAST(id % 2 AS string) AS s", "id AS v", "id AS w"), tag_cols=("s",))
    raw = Query("m", fields=("v",), tags=(("s", "1"),), start_ms=10)
    for query in (raw, Query("m", fields=("v",), tags=(("s", "1"),), start_ms=10, rollup_interval=100, method=Aggregate.COUNT)):
        got = small.query(query)
        physical = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        lines = [line.strip(" :+-*") for line in physical.splitlines()]
        scan = next(i for i, line in enumerate(lines) if line.startswith("FileScan"))
        above = [line for line in lines[:scan] if line.startswith(("Exchange", "SortAggregate", "Sort "))]
        assert above[-1].startswith("Exchange hashpartitioning(ts_ms") and ", 6)" in above[-1], above[-1]
        assert "GreaterThanOrEqual(ts_ms,10)" in lines[scan] and "v_string" not in lines[scan], lines[scan]
        assert "field" in lines[scan].split("PartitionFilters")[1]
    want = {i // 3: i for i in range(3000) if i % 2 and i // 3 >= 10}
    assert [tuple(r) for r in small.query(raw).collect()] == sorted(want.items())
    assert sum(r["v"] for r in got.collect()) == len(want)
    assert tuple(small.timestamp_range("m", once=True).first()) == (0, 999, 4000)
