"""The Parquet store: ingest, deletion, compaction, expiration, catalogue."""

import threading

import pytest

from tidemark import Aggregate, Query
from tidemark.engine import Engine
from tidemark.streaming import stream_into


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", capacity_bytes=100_000)
    e.init()
    e.init()
    yield e
    e.deinit()


def rows(df):
    return [tuple(r) for r in df.collect()]


WEATHER = [{"ts_ms": 1000 * i, "temperature": 1.5 * i, "valid": i % 2 == 0, "status": 4 * i} for i in range(10)]
SCHEMA = "ts_ms bigint, temperature double, valid boolean, status bigint"


def insert(engine, name, data, schema, **more):
    return engine.insert(name, [tuple(d.values()) for d in data], schema=schema, **more)


def test_insert_and_query(engine):
    assert insert(engine, "weather", WEATHER, SCHEMA, tags={"suburb": "beldon", "city": "perth"})
    assert engine.insert("weather", [])
    got = engine.query(Query("weather", limit=250))
    assert got.columns == ["ts_ms", "temperature", "valid", "status"]
    assert rows(got) == [tuple(w.values()) for w in WEATHER]
    assert rows(engine.query_string("sum:weather(status){city:perth}", rollup_interval=5000)) == [(0, 40), (5000, 140)]
    assert engine.query(Query("weather", tags=(("city", "york"),))).count() == 0
    assert rows(engine.get_measurements()) == [("weather",)]
    assert rows(engine.get_fields_for_measurement("weather")) == [("temperature",), ("valid",), ("status",)]
    assert sorted(rows(engine.get_tags_for_measurement("weather"))) == [("city", "perth"), ("suburb", "beldon")]
    assert rows(engine.get_timestamp_range("weather")) == [(0, 9000, 30)]
    with pytest.raises(ValueError, match="name"):
        insert(engine, "", WEATHER, SCHEMA)


def test_last_write_wins_before_and_after_compaction(engine):
    for ts, v in (((1000, 2000, 3000), (1.0, 2.0, 3.0)), ((2000, 3000, 4000), (20.0, 30.0, 40.0)), ((5000, 5000, 5000), (10.0, 20.0, 30.0))):
        insert(engine, "m", [{"ts_ms": t, "v": x} for t, x in zip(ts, v)], "ts_ms bigint, v double")
    want = [(1000, 1.0), (2000, 20.0), (3000, 30.0), (4000, 40.0), (5000, 30.0)]
    assert rows(engine.query(Query("m"))) == want
    assert engine.compact_force_sync()
    assert rows(engine.query(Query("m"))) == want
    assert rows(engine.get_timestamp_range("m")) == [(1000, 5000, 5)]
    assert engine.compact().result()
    insert(engine, "m", [{"ts_ms": 1000, "v": 7.0}], "ts_ms bigint, v double")
    assert rows(engine.query(Query("m")))[0] == (1000, 7.0)


def test_levels(engine):
    for i in range(5):
        insert(engine, "m", [{"ts_ms": i, "v": i}], "ts_ms bigint, v bigint")
    engine.deinit()  # waits for the compaction that the fourth insert has started
    levels = [b.level for b in engine.store.manifest.batches]
    assert sorted(levels) in ([0, 1], [1])
    assert engine.query(Query("m")).count() == 5
    usage = engine.get_usage_summary()
    assert usage["levels"][1]["files"] >= 1 and usage["used_bytes"] > 0 and usage["total_bytes"] == 100_000


def test_inserts_and_queries_beside_compactions(engine):
    """Nothing is lost, nothing counts twice, and every query sees all that was written before it began."""
    engine.store.auto_compact = False
    for i in range(6):
        insert(engine, "m", [{"ts_ms": i, "v": i}], "ts_ms bigint, v bigint", tags={"s": "a"})
    seen, failed = [], []

    def write(start):
        try:
            for i in range(start, start + 3):
                insert(engine, "m", [{"ts_ms": i, "v": i}], "ts_ms bigint, v bigint", tags={"s": str(start)})
                seen.append(engine.query(Query("m")).filter(f"ts_ms = {i}").count())
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in (100, 200)]
    for t in threads:
        t.start()
    done = [engine.compact(), engine.compact()]
    assert engine.compact_force_sync()
    for t in threads:
        t.join()
    assert all(d.result() for d in done) and not failed and seen == [1] * 6
    want = [(i, i) for i in (*range(6), *range(100, 103), *range(200, 203))]
    assert rows(engine.query(Query("m"))) == want
    assert engine.compact_force_sync() and rows(engine.query(Query("m"))) == want
    assert rows(engine.get_timestamp_range("m")) == [(0, 202, 12)]


def test_change_made_from_an_old_version_is_made_again(engine):
    """A deletion and an insert that commit while a merge is being written stay in force."""
    store = engine.store
    store.auto_compact = False
    for i in range(3):
        insert(engine, "m", [{"ts_ms": i, "v": i, "w": i}], "ts_ms bigint, v bigint, w bigint")
    write = store._write

    def slow(*a, **b):
        store._write = write
        store.delete_field("m", "w")
        insert(engine, "m", [{"ts_ms": 9, "v": 9, "w": 9}], "ts_ms bigint, v bigint, w bigint")
        return write(*a, **b)

    store._write = slow
    assert store.compact(force=True)
    assert rows(engine.query(Query("m"))) == [(0, 0, None), (1, 1, None), (2, 2, None), (9, 9, 9)]
    assert store.compact(force=True) and not store.manifest.tombstones
    assert rows(engine.query(Query("m"))) == [(0, 0, None), (1, 1, None), (2, 2, None), (9, 9, 9)]


def test_series_keys(engine):
    """The order of tags doesn't matter, and no value passes for another tag."""
    one = [{"ts_ms": 1, "v": 1.0}]
    insert(engine, "m", one, "ts_ms bigint, v double", tags={"a": "1", "b": "2"})
    insert(engine, "m", [{"ts_ms": 1, "v": 5.0}], "ts_ms bigint, v double", tags={"b": "2", "a": "1"})
    insert(engine, "m", one, "ts_ms bigint, v double", tags={"a": "1:b:2"})
    assert rows(engine.query(Query("m", tags=(("b", "2"),)))) == [(1, 5.0)]
    assert engine.store.catalog().count() == 2


def test_average_of_large_longs(engine):
    insert(engine, "m", [{"ts_ms": i, "v": 2**62} for i in range(3)], "ts_ms bigint, v bigint")
    assert rows(engine.query(Query("m", rollup_interval=10, method=Aggregate.AVG))) == [(0, 2**62)]
    insert(engine, "m", [{"ts_ms": 20, "v": -3}, {"ts_ms": 21, "v": -4}], "ts_ms bigint, v bigint")
    assert rows(engine.query(Query("m", rollup_interval=10, method=Aggregate.AVG)))[1] == (20, -3)


def test_expiration_leaves_other_batches_alone(engine):
    engine.store.auto_compact = False
    for i in range(3):
        insert(engine, "m", [{"s": f"s{j:02d}", "ts_ms": 1000 * i + j, "v": 1.0} for j in range(30)], "s string, ts_ms bigint, v double", tag_cols=("s",))
    engine.store.capacity = 90 * 61 + 1
    before = {b.path for b in engine.store.manifest.batches[1:]}
    assert engine.store.expire(0.9, 0.9) == 25
    assert before <= {b.path for b in engine.store.manifest.batches}
    assert engine.query(Query("m")).count() == 65


def test_type_clash(engine):
    insert(engine, "m", [{"ts_ms": 1, "v": 1.0}], "ts_ms bigint, v double", tags={"s": "a"})
    assert not insert(engine, "m", [{"ts_ms": 2, "v": 2, "w": 3}], "ts_ms bigint, v bigint, w bigint", tags={"s": "a"})
    assert rows(engine.query(Query("m"))) == [(1, 1.0, None), (2, None, 3)]
    # another series may have another type; the field then can't be read with both
    assert insert(engine, "m", [{"ts_ms": 3, "v": 4}], "ts_ms bigint, v bigint", tags={"s": "b"})
    assert engine.query(Query("m")).columns == ["ts_ms", "w"]
    assert rows(engine.query(Query("m", tags=(("s", "b"),)))) == [(3, 4)]


def test_delete_and_reinsert(engine):
    data = [{"ts_ms": i, "temp": float(i), "humidity": 2.0 * i} for i in range(3)]
    insert(engine, "m", data, "ts_ms bigint, temp double, humidity double", tags={"site": "A"})
    assert engine.delete_measurement_and_field("m", "temp")
    assert rows(engine.get_fields_for_measurement("m")) == [("humidity",)]
    assert rows(engine.query(Query("m", tags=(("site", "A"),)))) == [(0, 0.0), (1, 2.0), (2, 4.0)]
    assert engine.delete_measurement("m") and engine.delete_measurement("never")
    assert engine.query(Query("m")).columns == ["ts_ms"] and engine.get_measurements().count() == 0
    insert(engine, "m", [{"ts_ms": 5000 + i, "pressure": i} for i in range(50)], "ts_ms bigint, pressure bigint", tags={"site": "B"})
    assert engine.query(Query("m")).count() == 50
    assert rows(engine.get_fields_for_measurement("m")) == [("pressure",)]
    engine.compact_force_sync()
    assert engine.query(Query("m")).count() == 50 and not engine.store.manifest.tombstones
    assert engine.clear_all() and engine.get_measurements().count() == 0


def test_expire(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/full", capacity_bytes=50 * 61)
    for _ in range(2):  # 25 records of one point each time
        insert(e, "m", [{"s": f"s{i:02d}", "ts_ms": 1000 * i + _, "v": 1.0} for i in range(25)], "s string, ts_ms bigint, v double", tag_cols=("s",))
    assert e.store.expire(0.99, 0.9) == 25
    left = rows(e.query(Query("m")))
    assert len(left) == 25 and left[0][0] == 13000 - 1000 + 1
    e.store.capacity = 10**9
    assert e.expire() == 0
    with pytest.raises(ValueError, match="between"):
        e.store.expire(0, 0.5)


def test_stream(spark, engine, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([(i, "a", float(i)) for i in range(5)], "ts_ms bigint, s string, v double").write.parquet(source)
    stream = spark.readStream.schema("ts_ms bigint, s string, v double").parquet(source)
    stream_into(engine.store, "live", stream, f"{tmp_path}/checkpoint", tag_cols=("s",)).awaitTermination(60)
    assert rows(engine.query(Query("live", rollup_interval=10, method=Aggregate.SUM))) == [(0, 10.0)]
    version = engine.store.manifest.version
    again = spark.createDataFrame([(0, "a", 99.0)], "ts_ms bigint, s string, v double")
    assert engine.store.insert("live", again, tag_cols=("s",), stream=(f"{tmp_path}/checkpoint", 0))  # was written: left out
    assert engine.store.manifest.version == version and rows(engine.get_timestamp_range("live")) == [(0, 4, 5)]
