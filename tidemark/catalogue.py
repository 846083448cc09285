"""The registered queries of the time-series operators, and the same in SQL.

Both read the whole tables. ``events`` has tags event_type and user_id; ``lineitem`` has ties in time and is the table
for writes over writes and for several series at one time.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, expiration
from .plans import Aggregate, Query, SeriesBinding, parse_query_string, plan
from .sources.store import CHUNKS, Store

DAY, HOUR = 86_400_000, 3_600_000
#: 2024-01-05 and 2024-01-15, 00:00 UTC.
FROM, TO = 1_704_412_800_000, 1_705_276_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *fields: str) -> SeriesBinding:
    df = table(spark, sf_dir, "events").withColumns(
        {
            "high": F.col("value") > 50,
            "whole": F.floor(F.col("value") - 60).cast("bigint"),
            "clicks": F.when(F.col("event_type") == "click", F.col("value")),
            "purchases": F.when(F.col("event_type") == "purchase", F.col("value")),
        }
    )
    return SeriesBinding(df, "events", "ts", ("event_type", "user_id"), fields or ("value",), ("event_id",))


def lineitem(spark: SparkSession, sf_dir: str, *fields: str) -> SeriesBinding:
    df = table(spark, sf_dir, "lineitem")
    numbers = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    return SeriesBinding(df, "lineitem", "l_shipdate", ("l_returnflag", "l_linestatus"), fields or numbers, ("l_orderkey", "l_linenumber", "l_partkey"))


def _rounded(df: DataFrame, *fields: str) -> DataFrame:
    """Double sums depend on the order of addition; both engines round them alike."""
    return df.withColumns({f: F.round(f, 9) for f in fields})


EVENT_MS = "(epoch_us(ts) // 1000)"
LINE_MS = "(epoch_us(l_shipdate) // 1000)"
LINE_KEY = "md5('lineitem:l_returnflag:' || l_returnflag || ':l_linestatus:' || l_linestatus || ':{field}')"
EVENT_KEY = "md5('events:event_type:' || event_type || ':user_id:' || user_id || ':{field}')"

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = make
    if sql is not None:
        SQL[name] = sql


# -- raw points -------------------------------------------------------------------------------------------------------

_raw = "SELECT ts_ms, arg_max(value, (k, event_id)) AS value FROM (SELECT {ms} AS ts_ms, value, event_id, {key} AS k FROM events WHERE value IS NOT NULL AND {where}) GROUP BY ts_ms"


def _raw_sql(where: str = "true", tail: str = "") -> str:
    return _raw.format(ms=EVENT_MS, key=EVENT_KEY.format(field="value"), where=where) + tail


_add("raw_all", lambda s, d: plan(Query("events"), events(s, d)), _raw_sql())
_add("raw_range", lambda s, d: plan(Query("events", start_ms=FROM, end_ms=TO), events(s, d)), _raw_sql(f"{EVENT_MS} BETWEEN {FROM} AND {TO}"))
_add("raw_limit", lambda s, d: plan(Query("events", limit=100), events(s, d)), _raw_sql(tail=" ORDER BY ts_ms LIMIT 100"))
_add("tag_eq", lambda s, d: plan(Query("events", tags=(("event_type", "click"),)), events(s, d)), _raw_sql("event_type = 'click'"))
_add("tag_and", lambda s, d: plan(Query("events", tags=(("event_type", "click"), ("user_id", "7"))), events(s, d)), _raw_sql("event_type = 'click' AND user_id = 7"))
_add("tag_nomatch", lambda s, d: plan(Query("events", tags=(("event_type", "click"), ("room", "7"))), events(s, d)), _raw_sql("false"))
_add(
    "raw_zero_fill",
    lambda s, d: plan(Query("events", zero_fill=True, tags=(("event_type", "click"),)), events(s, d, "clicks", "purchases", "high")),
    f"SELECT ts_ms, arg_max(value, (k1, event_id)) AS clicks, CAST(0 AS DOUBLE) AS purchases, arg_max(value > 50, (k2, event_id)) AS high FROM (SELECT {EVENT_MS} AS ts_ms, value, event_id, {EVENT_KEY.format(field='clicks')} AS k1, {EVENT_KEY.format(field='high')} AS k2 FROM events WHERE event_type = 'click') GROUP BY ts_ms",
)


def _line_raw_sql(fields: tuple[str, ...], where: str = "true") -> str:
    values = ", ".join(f"arg_max({f}, (k{i}, l_orderkey, l_linenumber, l_partkey)) AS {f}" for i, f in enumerate(fields))
    keys = ", ".join(f"{LINE_KEY.format(field=f)} AS k{i}" for i, f in enumerate(fields))
    return f"SELECT ts_ms, {values} FROM (SELECT *, {LINE_MS} AS ts_ms, {keys} FROM lineitem WHERE {where}) GROUP BY ts_ms"


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _as_long(sql: str, *fields: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({f} AS BIGINT) AS {f}' for f in fields)}) FROM ({sql})"


_add("field_star", lambda s, d: plan(Query("lineitem"), lineitem(s, d)), _as_long(_line_raw_sql(_NUMBERS), "l_linenumber"))
_add(
    "field_subset_dedup",
    lambda s, d: plan(Query("lineitem", fields=("l_tax", "nothing", "l_quantity", "l_tax")), lineitem(s, d)),
    _line_raw_sql(("l_tax", "l_quantity")),
)
_add("unknown_measurement", lambda s, d: plan(Query("weather"), events(s, d)), f"SELECT {EVENT_MS} AS ts_ms FROM events WHERE false")
_add("multi_series_collapse", lambda s, d: plan(Query("lineitem", fields=("l_extendedprice",)), lineitem(s, d)), _line_raw_sql(("l_extendedprice",)))
_add(
    "dedup_last_write_wins",
    lambda s, d: plan(Query("lineitem", fields=("l_quantity", "l_tax"), tags=(("l_returnflag", "R"), ("l_linestatus", "F"))), lineitem(s, d)),
    _line_raw_sql(("l_quantity", "l_tax"), "l_returnflag = 'R' AND l_linestatus = 'F'"),
)
_add(
    "raw_limit_two_fields",
    lambda s, d: plan(Query("events", limit=50), events(s, d, "clicks", "purchases")),
    f"""WITH e AS (SELECT {EVENT_MS} AS ts_ms, * FROM events),
        c AS (SELECT ts_ms, arg_max(value, ({EVENT_KEY.format(field="clicks")}, event_id)) AS clicks FROM e WHERE event_type = 'click' GROUP BY 1 ORDER BY 1 LIMIT 50),
        p AS (SELECT ts_ms, arg_max(value, ({EVENT_KEY.format(field="purchases")}, event_id)) AS purchases FROM e WHERE event_type = 'purchase' GROUP BY 1 ORDER BY 1 LIMIT 50)
        SELECT coalesce(c.ts_ms, p.ts_ms) AS ts_ms, clicks, purchases FROM c FULL JOIN p ON c.ts_ms = p.ts_ms""",
)

# -- rollups ----------------------------------------------------------------------------------------------------------


def _windows(source: str, ms: str, value: str, aggregate: str, out: str, width: int, where: str = "true", dedup: str | None = None, key: str = "''") -> str:
    """SQL of a rollup: last writes by ``dedup`` order within (``key``, time), windows from the first point."""
    rows = f"SELECT {ms} AS ms, {value} AS v, {key} AS k, {dedup or '0'} AS seq FROM {source} WHERE {where}"
    points = f"SELECT ms, k, arg_max(v, seq) AS v FROM ({rows}) WHERE v IS NOT NULL GROUP BY ms, k"
    return f"""WITH p AS ({points}), a AS (SELECT min(ms) AS a FROM p)
        SELECT a + ((ms - a) // {width}) * {width} AS ts_ms, {aggregate} AS {out} FROM p, a GROUP BY 1"""


_METHODS = {
    "min": (Aggregate.MIN, "min(v) FILTER (NOT isnan(v))"),
    "max": (Aggregate.MAX, "max(v) FILTER (NOT isnan(v))"),
    "avg": (Aggregate.AVG, "round(avg(v), 9)"),
    "sum": (Aggregate.SUM, "round(sum(v), 9)"),
    "count": (Aggregate.COUNT, "count(v)"),
    "last": (Aggregate.LAST, "arg_max(v, (ms, k))"),
    "none": (Aggregate.NONE, "round(sum(v), 9)"),
}
_INT = {
    "min": "min(v)", "max": "max(v)", "avg": "CAST((2 * sum(v) + count(v)) // (2 * count(v)) AS BIGINT)",
    "sum": "CAST(sum(v) AS BIGINT)", "count": "count(v)", "last": "arg_max(v, (ms, k))", "none": "CAST(sum(v) AS BIGINT)",
}
_BOOL = {"none": "CAST(sum(CAST(v AS INT)) AS BIGINT)", "min": "bool_and(v)", "max": "bool_or(v)", "avg": "avg(CAST(v AS INT)) > 0.5", "sum": "CAST(sum(CAST(v AS INT)) AS BIGINT)", "count": "count(v)", "last": "arg_max(v, (ms, k))"}
_STRING = {
    "count": "count(v)", "last": "arg_max(v, (ms, k))", "min": "CAST(NULL AS DOUBLE)", "max": "CAST(NULL AS DOUBLE)",
    "avg": "CAST(0 AS DOUBLE)", "sum": "CAST(0 AS DOUBLE)", "none": "CAST(0 AS DOUBLE)",
}


def _rollup(field: str, method: Aggregate, width: int, bound, **more) -> Callable[[SparkSession, str], DataFrame]:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = plan(Query(bound.__name__, fields=(field,), rollup_interval=width, method=method, **more), bound(spark, sf_dir, field))
        return _rounded(found, field) if method in (Aggregate.AVG, Aggregate.SUM, Aggregate.NONE) and found.schema[field].dataType.simpleString() == "double" else found

    return make


for _name, (_method, _sql) in _METHODS.items():
    _add(f"rollup_{_name}", _rollup("value", _method, DAY, events), _windows("events", EVENT_MS, "value", _sql, "value", DAY, dedup="event_id", key=EVENT_KEY.format(field="value")))
    _add(
        f"rollup_int_{_name}",
        _rollup("l_linenumber", _method, 30 * DAY, lineitem),
        _windows("lineitem", LINE_MS, "CAST(l_linenumber AS BIGINT)", _INT[_name], "l_linenumber", 30 * DAY, dedup="(l_orderkey, l_linenumber, l_partkey)", key=LINE_KEY.format(field="l_linenumber")),
    )
    if _name in _BOOL:
        _add(f"rollup_bool_{_name}", _rollup("high", _method, DAY, events), _windows("events", EVENT_MS, "value > 50", _BOOL[_name], "high", DAY, dedup="event_id", key=EVENT_KEY.format(field="high")))
    if _name in _STRING:
        _add(f"rollup_string_{_name}", _rollup("props", _method, DAY, events), _windows("events", EVENT_MS, "props", _STRING[_name], "props", DAY, dedup="event_id", key=EVENT_KEY.format(field="props")))
_add(
    "rollup_signed_avg",
    _rollup("whole", Aggregate.AVG, HOUR, events),
    _windows("events", EVENT_MS, "CAST(floor(value - 60) AS BIGINT)", _INT["avg"], "whole", HOUR, dedup="event_id", key=EVENT_KEY.format(field="whole")),
)
_add(
    "rollup_gap",
    _rollup("value", Aggregate.COUNT, HOUR, events, tags=(("user_id", "7"),)),
    _windows("events", EVENT_MS, "value", "count(v)", "value", HOUR, "user_id = 7", "event_id", EVENT_KEY.format(field="value")),
)
_add(
    "rollup_range",
    _rollup("value", Aggregate.AVG, HOUR, events, start_ms=FROM, end_ms=TO),
    _windows("events", EVENT_MS, "value", "round(avg(v), 9)", "value", HOUR, f"{EVENT_MS} BETWEEN {FROM} AND {TO}", "event_id", EVENT_KEY.format(field="value")),
)
_add(
    "rollup_limit",
    _rollup("value", Aggregate.MAX, DAY, events, limit=5),
    _windows("events", EVENT_MS, "value", "max(v)", "value", DAY, dedup="event_id", key=EVENT_KEY.format(field="value")) + " ORDER BY ts_ms LIMIT 5",
)
_add(
    "rollup_two_fields_misaligned",
    lambda s, d: _rounded(plan(Query("events", rollup_interval=DAY, method=Aggregate.AVG), events(s, d, "clicks", "purchases")), "clicks", "purchases"),
    f"""WITH e AS (SELECT {EVENT_MS} AS ms, value AS v, event_type AS t FROM events),
        c AS (SELECT a + ((ms - a) // {DAY}) * {DAY} AS ts_ms, round(avg(v), 9) AS clicks FROM e, (SELECT min(ms) AS a FROM e WHERE t = 'click') WHERE t = 'click' GROUP BY 1),
        p AS (SELECT a + ((ms - a) // {DAY}) * {DAY} AS ts_ms, round(avg(v), 9) AS purchases FROM e, (SELECT min(ms) AS a FROM e WHERE t = 'purchase') WHERE t = 'purchase' GROUP BY 1)
        SELECT coalesce(c.ts_ms, p.ts_ms) AS ts_ms, clicks, purchases FROM c FULL JOIN p ON c.ts_ms = p.ts_ms""",
)
_add(
    "qs_avg",
    lambda s, d: _rounded(plan(parse_query_string("mean:events(value){event_type:click}", rollup_interval=DAY), events(s, d)), "value"),
    _windows("events", EVENT_MS, "value", "round(avg(v), 9)", "value", DAY, "event_type = 'click'", "event_id", EVENT_KEY.format(field="value")),
)

# -- catalogue --------------------------------------------------------------------------------------------------------


def orders(spark: SparkSession, sf_dir: str) -> SeriesBinding:
    return SeriesBinding(table(spark, sf_dir, "orders"), "orders", "o_orderdate", ("o_orderstatus", "o_orderpriority"), ("o_totalprice",), ("o_orderkey",))


_add("list_measurements", lambda s, d: catalog.measurements(s, [orders(s, d), events(s, d)]), "SELECT 'orders' AS measurement UNION ALL SELECT 'events'")
_add("list_fields", lambda s, d: catalog.fields(lineitem(s, d)), "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{'bigint' if f == 'l_linenumber' else 'double'}')" for f in _NUMBERS) + ") AS t(field, type)")
_add(
    "list_tags",
    lambda s, d: catalog.tags(orders(s, d)),
    "SELECT DISTINCT 'o_orderstatus' AS key, o_orderstatus AS value FROM orders UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders",
)
_add("timestamp_range", lambda s, d: catalog.timestamp_range(lineitem(s, d)), f"SELECT min({LINE_MS}) AS min_ms, max({LINE_MS}) AS max_ms, {' + '.join(f'count({f})' for f in _NUMBERS)} AS points FROM lineitem")

# -- expiration -------------------------------------------------------------------------------------------------------


def expire_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly records of orders by priority: which of the oldest go to free 10,000 bytes."""
    rows = table(spark, sf_dir, "orders").withColumn("record_id", F.concat_ws(":", F.date_format("o_orderdate", "yyyy-MM"), "o_orderpriority"))
    records = rows.groupBy("record_id").agg(F.min(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("start_ms"), F.count("*").alias("points"))
    records = records.withColumn("bytes", expiration.record_bytes("points"))
    oldest = expiration.expired(records, 10_000.0)
    return oldest.select("record_id", "start_ms", F.col("bytes").cast("bigint").alias("bytes"))


_add(
    "expire_candidates",
    expire_candidates,
    """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') || ':' || o_orderpriority AS record_id, min(epoch_us(o_orderdate) // 1000) AS start_ms,
               CAST(45 + 16 * count(*) AS BIGINT) AS bytes FROM orders GROUP BY 1),
        o AS (SELECT * FROM r ORDER BY start_ms, record_id LIMIT 25),
        c AS (SELECT *, sum(bytes) OVER (ORDER BY start_ms, record_id) - bytes AS before FROM o)
        SELECT record_id, start_ms, bytes FROM c WHERE before < 10000""",
)

# -- the store --------------------------------------------------------------------------------------------------------


def _fresh(spark: SparkSession) -> Store:
    """An empty store in the folder that all executors share; where Spark runs in one process and none is set, in a temporary one.

    It is deleted when the application's Python ends.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    store = Store(spark, f"{shared}/tidemark-store-{uuid.uuid4().hex}", auto_compact=False)
    atexit.register(_drop, store)
    return store


def _drop(store: Store) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        store.files.delete("")


def _filled(spark: SparkSession, sf_dir: str) -> Store:
    store = _fresh(spark)
    rows = table(spark, sf_dir, "events").select("ts", "event_type", "event_id", "value", (F.col("value") > 50).alias("high"))
    for even in (0, 1):
        store.insert("events", rows.filter(F.col("event_id") % 2 == even), ts_col="ts", tag_cols=("event_type",), fields=("value", "high"), seq_col="event_id")
    return store


def compact_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.compact(force=True)
    return _rounded(store.query(Query("events", fields=("value",), rollup_interval=DAY, method=Aggregate.SUM)), "value")


def delete_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.delete_field("events", "value")
    return store.query(Query("events", rollup_interval=DAY, method=Aggregate.SUM))


def delete_measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.delete_measurement("events")
    return store.query(Query("events"))


def reinsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.delete_measurement("events")
    rows = table(spark, sf_dir, "events").filter("event_type = 'click'")
    store.insert("events", rows, ts_col="ts", tag_cols=("event_type",), fields=("value",), seq_col="event_id")
    return store.query(Query("events"))


_store_points = f"SELECT ms, event_type, arg_max(value, (event_id % 2, event_id)) AS value FROM (SELECT {EVENT_MS} AS ms, * FROM events) GROUP BY ALL"
_add("compact_equivalence", compact_equivalence, f"WITH p AS ({_store_points}), a AS (SELECT min(ms) AS a FROM p) SELECT a + ((ms - a) // {DAY}) * {DAY} AS ts_ms, round(sum(value), 9) AS value FROM p, a GROUP BY 1")
_add("delete_field", delete_field, f"WITH p AS ({_store_points}), a AS (SELECT min(ms) AS a FROM p) SELECT a + ((ms - a) // {DAY}) * {DAY} AS ts_ms, CAST(sum(CAST(value > 50 AS INT)) AS BIGINT) AS high FROM p, a GROUP BY 1")
_add("delete_measurement", delete_measurement, f"SELECT {EVENT_MS} AS ts_ms FROM events WHERE false")
_add("reinsert", reinsert, f"SELECT {EVENT_MS} AS ts_ms, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1")


def store_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left once the oldest records have gone from a store that is two thirds full; points written over aren't left."""
    store = _filled(spark, sf_dir)
    store.capacity = store.records().agg(F.sum("bytes")).first()[0] * 3 // 2
    store.expire(0.5, 0.05)
    return store.timestamp_range("events", once=True)


_rows = f"SELECT {EVENT_MS} AS ms, event_type, event_id, value, value > 50 AS high, (event_id % 2, event_id) AS seq FROM events"
_key = "md5('events:event_type:' || event_type || ':{}')"
_add(
    "store_raw",
    lambda s, d: _filled(s, d).query(Query("events")),
    f"SELECT ms AS ts_ms, arg_max(value, ({_key.format('value')}, seq)) AS value, arg_max(high, ({_key.format('high')}, seq)) AS high FROM ({_rows}) GROUP BY ms",
)
_add(
    "store_tag_limit",
    lambda s, d: _filled(s, d).query(Query("events", tags=(("event_type", "click"),), fields=("high",), limit=200)),
    f"SELECT ms AS ts_ms, arg_max(high, seq) AS high FROM ({_rows}) WHERE event_type = 'click' GROUP BY ms ORDER BY ms LIMIT 200",
)
_add("store_query_string", lambda s, d: _filled(s, d).query_string("count:events(value){event_type:view}", rollup_interval=DAY, start_ms=FROM), f"WITH p AS (SELECT DISTINCT ms FROM ({_rows}) WHERE event_type = 'view' AND ms >= {FROM}), a AS (SELECT min(ms) AS a FROM p) SELECT a + ((ms - a) // {DAY}) * {DAY} AS ts_ms, count(*) AS value FROM p, a GROUP BY 1")
_add("store_list_measurements", lambda s, d: _filled(s, d).measurements(), "SELECT 'events' AS measurement")
_add("store_list_fields", lambda s, d: _filled(s, d).fields("events"), "SELECT * FROM (VALUES ('value'), ('high')) AS t(field)")
_add("store_list_tags", lambda s, d: _filled(s, d).tags("events"), "SELECT DISTINCT 'event_type' AS key, event_type AS value FROM events")
_add("store_timestamp_range", lambda s, d: _filled(s, d).timestamp_range("events"), f"SELECT min(ms) AS min_ms, max(ms) AS max_ms, 2 * count(*) AS points FROM ({_rows})")
_add(
    "store_expire",
    store_expire,
    f"""WITH r AS ({_rows}), f AS (SELECT *, 'value' AS field, {_key.format("value")} AS series FROM r UNION ALL SELECT *, 'high', {_key.format("high")} FROM r),
        g AS (SELECT field, series, event_id % 2 + 1 AS batch, min(ms) AS start, CAST(45 + 16 * count(*) AS BIGINT) AS bytes FROM f GROUP BY ALL),
        t AS (SELECT (sum(bytes) * 3 // 2) * 0.05 AS target FROM g),
        o AS (SELECT *, batch || ':' || series AS id FROM g ORDER BY start, id LIMIT 25),
        c AS (SELECT *, sum(bytes) OVER (ORDER BY start, id) - bytes AS before FROM o),
        kept AS (SELECT DISTINCT f.series, f.ms FROM f LEFT JOIN (SELECT * FROM c, t WHERE before < target) AS x ON f.series = x.series AND f.event_id % 2 + 1 = x.batch WHERE x.series IS NULL)
        SELECT min(ms) AS min_ms, max(ms) AS max_ms, count(*) AS points FROM kept""",
)


def _in_five(spark: SparkSession, sf_dir: str, *, auto_compact: bool = False) -> Store:
    """The events in five writes, by event_id modulo 5."""
    store = _fresh(spark)
    store.auto_compact = auto_compact
    rows = table(spark, sf_dir, "events").select("ts", "event_type", "event_id", "value")
    for n in range(5):
        store.insert("events", rows.filter(F.col("event_id") % 5 == n), ts_col="ts", tag_cols=("event_type",), fields=("value",), seq_col="event_id")
    return store


def level_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points after a compaction of level 0 and a further write."""
    store = _in_five(spark, sf_dir)
    store.compact()
    rows = table(spark, sf_dir, "events").filter("event_id % 5 = 0").withColumn("value", F.col("value") + 1)
    store.insert("events", rows, ts_col="ts", tag_cols=("event_type",), fields=("value",), seq_col="event_id")
    return store.query(Query("events"))


def auto_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each level holds once the fourth of five writes has set off a compaction."""
    return _in_five(spark, sf_dir, auto_compact=True).usage_by_level()


def type_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of another type is not written to series that have it; its siblings are."""
    store = _fresh(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    tags = {"ts_col": "ts", "tag_cols": ("o_orderstatus",), "seq_col": "o_orderkey"}
    store.insert("orders", rows, fields=("price",), **tags)
    store.insert("orders", rows.withColumn("price", F.col("price").cast("bigint")).withColumn("number", F.col("o_orderkey")), fields=("price", "number"), **tags)
    return _rounded(store.query(Query("orders", rollup_interval=30 * DAY, method=Aggregate.SUM)), "price")


def cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.clear_all()
    rows = table(spark, sf_dir, "events").filter("event_type = 'view'")
    store.insert("views", rows, ts_col="ts", tag_cols=("event_type",), fields=("value",), seq_col="event_id")
    return store.measurements()


def chunk_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a write in small chunks makes more files than one in large chunks, of the same points."""
    found = []
    for size in (1, 500):
        store = _fresh(spark)
        store.set_chunk_size(size)
        store.set_chunk_size(0)  # ignored
        store.insert("lines", table(spark, sf_dir, "lineitem").selectExpr("l_shipdate AS ts", "l_quantity", "l_orderkey AS seq"), ts_col="ts", fields=("l_quantity",), seq_col="seq")
        batch = store.manifest.batches[0]
        found.append((size, batch.rows, batch.files >= batch.rows / (size * CHUNKS)))
    return spark.createDataFrame(found, "chunk_size int, points bigint, enough_files boolean")


_add("compact_levels", level_compact, f"SELECT ms AS ts_ms, arg_max(v, ({_key.format('value')}, n, event_id)) AS value FROM (SELECT {EVENT_MS} AS ms, event_type, event_id, event_id % 5 AS n, value AS v FROM events UNION ALL SELECT {EVENT_MS}, event_type, event_id, 5, value + 1 FROM events WHERE event_id % 5 = 0) GROUP BY ms")
_add(
    "auto_compact",
    auto_compact,
    f"""WITH e AS (SELECT {EVENT_MS} AS ms, event_type, event_id % 5 AS n FROM events),
        m AS (SELECT count(*) AS points FROM (SELECT DISTINCT event_type, ms FROM e WHERE n < 4))
        SELECT 0 AS level, CAST(1 AS BIGINT) AS batches, count(*) AS points FROM e WHERE n = 4 UNION ALL SELECT 1, 1, points FROM m""",
)
_ORDER_KEY = "md5('orders:o_orderstatus:' || o_orderstatus || ':{}')"
_add(
    "type_clash",
    type_clash,
    f"""WITH o AS (SELECT epoch_us(o_orderdate) // 1000 AS ms, o_orderstatus AS s, arg_max(o_totalprice, o_orderkey) AS price, arg_max(o_orderkey, o_orderkey) AS number FROM orders GROUP BY ALL),
        a AS (SELECT min(ms) AS a FROM o)
        SELECT a + ((ms - a) // {30 * DAY}) * {30 * DAY} AS ts_ms, round(sum(price), 9) AS price, CAST(sum(number) AS BIGINT) AS number FROM o, a GROUP BY 1""",
)
_add("clear_all", cleared, "SELECT 'views' AS measurement")
_add("chunk_size", chunk_size, "SELECT n AS chunk_size, count(l_quantity) AS points, true AS enough_files FROM lineitem, (VALUES (1), (500)) AS t(n) GROUP BY n")
_add("usage_by_level", lambda s, d: _filled(s, d).usage_by_level(), "SELECT 0 AS level, CAST(2 AS BIGINT) AS batches, 2 * count(*) AS points FROM events")
