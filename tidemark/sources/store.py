"""A mutable time-series store on Parquet: ingest, query, delete, expire, compact.

Layout under the root: ``points/<batch>/measurement=.../field=.../*.parquet`` (long rows, sorted by series and time),
``catalog/<batch>`` (one row for each series that a batch brought), ``records/<batch>`` (one row for each record, see
``records``) and ``_manifest``. Every change writes new files and then a new manifest version, made of the newest one, so
that writers beside each other lose nothing; readers see one version. Writes are numbered in the order of their commits,
and the last write of a series at one time counts, whatever the level its batch is on. A deletion holds for all writes
committed before it.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import expiration
from ..operators.dedup import newest
from ..plans.binding import FIELD_TYPES, SeriesBinding
from ..plans.planner import plan
from ..plans.query import Query, parse_query_string
from .manifest import Batch, Files, Listed, Manifest, Tombstone

log = logging.getLogger(__name__)

POINTS = (
    "series_id string, tags map<string,string>, ts_ms bigint, ftype string, v_double double, v_bigint bigint, v_boolean boolean, v_string string, seq bigint, ord bigint, measurement string, field string"
)
CATALOG = "measurement string, field string, series_id string, tags map<string,string>, ftype string, seq bigint, place bigint"
def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.replace("map<string,string>", "map").split(", ")]


TYPES = ("double", "bigint", "boolean", "string")
#: Batches on a level from which compaction merges it; the last level.
MERGE_AT, LAST_LEVEL = 4, 4
MAX_CHUNK, DEFAULT_CHUNK = 65_535, 500
#: Chunks to a file of a write; points that a task sorts and writes, about.
CHUNKS, TASK_POINTS = 2000, 1_000_000
#: What a batch is sorted by.
KEYS = ("measurement", "field", "series_id", "ts_ms")

RECORDS = "measurement string, field string, series_id string, seq bigint, start_ms bigint, points bigint"


class Store:
    """A store at ``root``. ``capacity_bytes`` is what ``expire`` measures usage against."""

    def __init__(self, spark: SparkSession, root: str, *, capacity_bytes: int = 1 << 40, auto_compact: bool = True):
        self.spark, self.root, self.capacity, self.auto_compact = spark, root.rstrip("/"), capacity_bytes, auto_compact
        self.files = Files(spark, self.root)
        self.chunk_size = DEFAULT_CHUNK
        #: What an insert calls when a level is full, instead of compacting itself.
        self.on_full: Callable[[], object] | None = None

    # -- reading ------------------------------------------------------------------------------------------------

    @property
    def manifest(self) -> Manifest:
        return self.files.latest()

    def _live(self, df: DataFrame, manifest: Manifest, measurement: str | None = None) -> DataFrame:
        """Without what is deleted. Tombstones of other measurements need no test."""
        tests = []
        for t in manifest.tombstones:
            if measurement is None or t.measurement == measurement:
                test = (F.col("measurement") == t.measurement) & ((F.col("seq") == t.seq) if t.only else (F.col("seq") <= t.seq))
                if t.field is not None:
                    test = test & (F.col("field") == t.field)
                if t.series_id is not None:
                    test = test & (F.col("series_id") == t.series_id)
                tests.append(test)
        return df.filter(~reduce(or_, tests)) if tests else df

    def _numbered(self, schema: str, parts: Sequence[tuple[str, int | None]]) -> DataFrame:
        """The rows of some folders; those of one write get its number."""
        merged, made = [f"{self.root}/{p}" for p, seq in parts if seq is None], []
        if merged:
            made += [self.spark.read.schema(schema).parquet(p) for p in merged]
        made += [self.spark.read.schema(schema).parquet(f"{self.root}/{p}").withColumn("seq", F.lit(seq).cast("bigint")) for p, seq in parts if seq is not None]
        return reduce(DataFrame.unionByName, made) if made else self.spark.createDataFrame([], schema)

    def points(self, manifest: Manifest | None = None, measurement: str | None = None, batches: Sequence[Batch] | None = None) -> DataFrame:
        """The live points as long rows."""
        manifest = manifest or self.manifest
        batches = manifest.batches if batches is None else batches
        df = self._numbered(POINTS, [(b.path, b.seq) for b in batches])
        if measurement is not None:
            df = df.filter(F.col("measurement") == measurement)
        return self._live(df, manifest, measurement)

    def _tasks(self, manifest: Manifest) -> int:
        """Over how many tasks to deal what is read: a split of files may hold many times the points that a task should sort. 0: no need."""
        rows = sum(b.rows for b in manifest.batches)
        return max(-(-rows // TASK_POINTS), self.spark.sparkContext.defaultParallelism) if rows > TASK_POINTS else 0

    def catalog(self, manifest: Manifest | None = None) -> DataFrame:
        """The live series: (measurement, field, series_id, tags, ftype, place), each once, as first seen."""
        manifest = manifest or self.manifest
        df = self._numbered(CATALOG, [(c.path, c.seq) for c in manifest.catalog])
        first = self._live(df, manifest).withColumn("_at", F.struct("seq", "place"))
        rest = F.struct("tags", "ftype", "seq", "place")
        return first.groupBy("measurement", "field", "series_id").agg(F.min_by(rest, "_at").alias("_row")).select("measurement", "field", "series_id", "_row.*")

    def binding(self, measurement: str, tags: Sequence[tuple[str, str]] = ()) -> SeriesBinding | None:
        """The measurement's live points with a column for each field; None where there are none.

        A field whose series (those with ``tags``) differ in type is left out, as no column can hold it.
        """
        manifest = self.manifest
        known = self.catalog(manifest).filter(F.col("measurement") == measurement)
        for k, v in tags:
            known = known.filter(F.col("tags")[k] == v)
        kinds = known.groupBy("field").agg(F.collect_set("ftype").alias("kinds"), F.min(F.struct("seq", "place")).alias("at")).orderBy("at").collect()
        fields = {}
        for row in kinds:
            if len(row["kinds"]) > 1:
                log.warning("field %s of %s has series of types %s; it is left out", row["field"], measurement, row["kinds"])
            else:
                fields[row["field"]] = row["kinds"][0]
        if not fields:
            return None
        df = self.points(manifest, measurement).filter(F.col("field").isin(list(fields)))
        columns = [F.when(F.col("field") == f, F.col(f"v_{kind}")).alias(f) for f, kind in fields.items()]
        hidden = {"ts_ms": "__ts_ms", "series_id": "__series", "tags": "__tags", "seq": "__seq", "ord": "__ord", "field": "__field"}
        df = df.select(*(F.col(a).alias(b) for a, b in hidden.items()), *columns)
        return SeriesBinding(df, measurement, "__ts_ms", (), tuple(fields), ("__seq", "__ord"), "__series", "__tags", self._tasks(manifest))

    def query(self, query: Query) -> DataFrame:
        """The query's result, as ``plans.plan`` defines it. Partitions of fields that it doesn't name aren't read."""
        bound = self.binding(query.measurement, query.tags)
        if bound is None:
            return self.spark.createDataFrame([], "ts_ms bigint")
        if query.fields:
            wanted = [f for f in query.fields if f in bound.field_cols]
            bound = replace(bound, df=bound.df.filter(F.col("__field").isin(wanted)), field_cols=wanted)
        return plan(query, bound)

    def query_string(self, text: str, **settings) -> DataFrame:
        return self.query(parse_query_string(text, **settings))

    # -- writing ------------------------------------------------------------------------------------------------

    def insert(self, measurement: str, points: DataFrame, *, ts_col: str = "ts_ms", tags: Mapping[str, str] | None = None, tag_cols: Sequence[str] = (), fields: Iterable[str] | None = None, seq_col: str | None = None, stream: tuple[str, int] | None = None) -> bool:
        """Append points: a row for each time, a column for each field; null cells are no points.

        ``tags`` hold for all rows, ``tag_cols`` name columns with more. ``seq_col`` orders the rows; else their order
        in the DataFrame does. A field whose type differs from what a series of it has is not written. True where all
        fields were written; no rows is success. ``stream`` names a stream and its micro-batch: one that was written
        already, or an earlier one, is left out.
        """
        if not measurement:
            raise ValueError("a measurement needs a name")
        used = {ts_col, *tag_cols, seq_col}
        fields = [c for c in points.columns if c not in used] if fields is None else list(fields)
        kinds = {}
        for f in fields:
            kind = FIELD_TYPES.get(type(points.schema[f].dataType))
            if kind is None:
                raise ValueError(f"field {f} has an unsupported type")
            kinds[f] = kind
        manifest = self.manifest
        if stream and manifest.streams.get(stream[0], -1) >= stream[1]:
            return True
        long = self._long(measurement, points, ts_col, tags or {}, list(tag_cols), kinds, seq_col)
        long, rows, clashes = self._without_clashes(long, manifest)
        name = uuid.uuid4().hex
        batch = self._write(self._dealt(long, rows, "ord"), name, 0)
        if batch.rows:
            self._add_catalog(manifest, name, batch, fields)

        def with_batch(now: Manifest) -> Manifest | None:
            if stream and now.streams.get(stream[0], -1) >= stream[1]:
                return None
            done = {"streams": now.streams | dict([stream])} if stream else {}
            if not batch.rows:
                return now.next(**done) if stream else None
            seq = now.seq + 1
            return now.next(seq=seq, batches=(*now.batches, replace(batch, seq=seq)), catalog=(*now.catalog, Listed(f"catalog/{name}", seq)), **done)

        committed = self.files.change(with_batch)
        if committed and self.auto_compact and not clashes and sum(b.level == 0 for b in committed.batches) >= MERGE_AT:
            (self.on_full or self.compact)()
        return not clashes

    def _long(self, measurement: str, points: DataFrame, ts_col: str, tags: Mapping[str, str], tag_cols: list[str], kinds: Mapping[str, str], seq_col: str | None) -> DataFrame:
        binding = SeriesBinding(points, measurement, ts_col, tag_cols, tuple(kinds))
        pairs = [x for k, v in tags.items() for x in (F.lit(k), F.lit(str(v)))] + [x for k in tag_cols for x in (F.lit(k), F.col(f"`{k}`").cast("string"))]
        tag_map = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        cells = []
        for f, kind in kinds.items():
            value = binding.value(f)
            typed = [(value if k == kind else F.lit(None).cast(k)).alias(f"v_{k}") for k in TYPES]
            cells.append(F.struct(F.lit(f).alias("field"), F.lit(kind).alias("ftype"), *typed))
        order = F.col(f"`{seq_col}`").cast("bigint") if seq_col else F.monotonically_increasing_id()
        rows = points.select(binding.ts_ms().alias("ts_ms"), tag_map.alias("tags"), order.alias("ord"), F.array(*cells).alias("_cells"))
        rows = rows.filter("ts_ms IS NOT NULL").select("ts_ms", "tags", "ord", F.explode("_cells").alias("_c")).select("ts_ms", "tags", "ord", "_c.*")
        rows = rows.filter(reduce(or_, (F.col(f"v_{k}").isNotNull() for k in TYPES)))
        rows = rows.withColumn("series_id", self._series(measurement)).withColumn("seq", F.lit(None).cast("bigint")).withColumn("measurement", F.lit(measurement))
        return rows.select(*_names(POINTS))

    def _series(self, measurement: str) -> Column:
        """The key of a row's series: a hash of measurement, tags in the order of their names, and field.

        Names and values that hold a control character or ``:`` are told apart by backslashes, so that no two sets of tags
        have one key.
        """
        plain = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
        tags = F.array_sort(F.map_entries("tags"))
        named = F.transform(tags, lambda e: F.concat_ws(":", plain(e["key"]), plain(e["value"])))
        return F.md5(F.concat_ws(":", F.lit(measurement), F.array_join(named, ":"), F.col("field")).cast("binary"))

    def _without_clashes(self, long: DataFrame, manifest: Manifest) -> tuple[DataFrame, int, bool]:
        """The points of fields whose type is that of their series, how many those are, and whether any field was left out."""
        if not manifest.catalog:
            return long, long.count(), False
        known = self.catalog(manifest).select("series_id", F.col("ftype").alias("_known"))
        runs = long.groupBy("series_id", "field", "ftype").count().join(known, "series_id", "left")
        found = runs.groupBy("field").agg(F.sum("count").alias("points"), F.bool_or(F.col("ftype") != F.col("_known")).alias("bad")).collect()
        bad = [r["field"] for r in found if r["bad"]]
        rows = sum(r["points"] for r in found if not r["bad"])
        return (long.filter(~F.col("field").isin(bad)), rows, True) if bad else (long, rows, False)

    def _dealt(self, points: DataFrame, rows: int, *more: str) -> DataFrame:
        """Points dealt by field, series, time and ``more`` over as many tasks as ``rows`` of them need.

        What a task sorts so depends neither on the input's partitions nor on how few fields or series there are.
        """
        return points.repartitionByRange(max(1, -(-rows // TASK_POINTS)), *KEYS, *more)

    def _write(self, dealt: DataFrame, name: str, level: int) -> Batch:
        """Write points as a batch, each partition sorted by itself."""
        path, limit = f"points/{name}", self.chunk_size * CHUNKS if level == 0 else 4 * TASK_POINTS
        dealt = dealt.sortWithinPartitions(*KEYS)
        dealt.write.option("maxRecordsPerFile", str(limit)).option("compression", "zstd").partitionBy("measurement", "field").parquet(f"{self.root}/{path}")
        written = self.spark.read.schema(POINTS).parquet(f"{self.root}/{path}")
        runs = written.groupBy("measurement", "field", "series_id", "seq").agg(F.min("ts_ms").alias("start_ms"), F.count("*").alias("points"))
        runs.select(*_names(RECORDS)).write.parquet(f"{self.root}/records/{name}")
        n = self.spark.read.schema(RECORDS).parquet(f"{self.root}/records/{name}").agg(F.sum("points")).first()[0] or 0
        files, size = self.files.usage(path, ".parquet")
        return Batch(path, level, n, size, files, None, f"records/{name}")

    def _series_of(self, batch: Batch, fields: list[str]) -> DataFrame:
        """The series of a write. All points of one have its tags and its type, so these are keys: as values, they would be sorted for."""
        place = F.array_position(F.array(*map(F.lit, fields)), F.col("field")).cast("bigint")
        written = self.spark.read.schema(POINTS).parquet(f"{self.root}/{batch.path}")
        series = written.select("measurement", "field", "series_id", F.array_sort(F.map_entries("tags")).alias("_tags"), "ftype").distinct()
        return series.select("measurement", "field", "series_id", F.map_from_entries("_tags").alias("tags"), "ftype", F.lit(None).cast("bigint").alias("seq"), place.alias("place"))

    def _add_catalog(self, manifest: Manifest, name: str, batch: Batch, fields: list[str]) -> None:
        """Series of the batch that the catalogue doesn't have yet; two writers may both bring one, the first counts."""
        series = self._series_of(batch, fields)
        if manifest.catalog:
            series = series.join(self.catalog(manifest).select("series_id"), "series_id", "left_anti")
        series.select(*_names(CATALOG)).write.parquet(f"{self.root}/catalog/{name}")

    # -- changing -----------------------------------------------------------------------------------------------

    def _bury(self, *tombstones: Callable[[int], Tombstone]) -> None:
        self.files.change(lambda now: now.next(tombstones=(*now.tombstones, *(t(now.seq) for t in tombstones))))

    def delete_measurement(self, measurement: str) -> bool:
        """Delete all points so far; an unknown measurement is success. What is inserted later is visible."""
        self._bury(lambda seq: Tombstone(measurement, seq))
        return True

    def delete_field(self, measurement: str, field: str) -> bool:
        """Delete one field's points so far; its siblings stay, whatever tags they share."""
        self._bury(lambda seq: Tombstone(measurement, seq, field))
        return True

    def records(self, manifest: Manifest | None = None) -> DataFrame:
        """The live records: runs of one series within one write (record_id, measurement, field, series_id, seq, start_ms, points, bytes).

        They are read from the tables of records that each write leaves, not from the points.
        """
        manifest = manifest or self.manifest
        runs = self._live(self._numbered(RECORDS, [(b.records, b.seq) for b in manifest.batches]), manifest)
        runs = runs.groupBy("measurement", "field", "series_id", "seq").agg(F.min("start_ms").alias("start_ms"), F.sum("points").alias("points"))
        return runs.withColumn("record_id", F.concat_ws(":", "seq", "series_id")).withColumn("bytes", expiration.record_bytes("points"))

    def expire(self, threshold: float = 0.5, reduction: float = 0.05) -> int:
        """Where usage has reached ``threshold`` of the capacity, delete the oldest records; how many went.

        Usage and sizes are those of records. At most 25 records go in one run. They are marked as deleted, and the batches
        that hold any of them are merged; other batches are not touched.
        """
        if not (0 < threshold < 1 and 0 < reduction < 1):
            raise ValueError("threshold and reduction must be between 0 and 1")
        manifest = self.manifest
        records = self.records(manifest)
        used = records.agg(F.sum("bytes")).first()[0] or 0
        if used < threshold * self.capacity:
            return 0
        gone = expiration.expired(records, self.capacity * reduction).select("measurement", "field", "series_id", "seq").collect()
        self._bury(*(lambda _, r=r: Tombstone(r["measurement"], r["seq"], r["field"], r["series_id"], True) for r in gone))
        written = {r["seq"] for r in gone}
        touched = tuple(b for b in manifest.batches if (b.seq in written if b.seq is not None else self._holds(b, written)))
        self._merge(touched, max((b.level for b in touched), default=0))
        return len(gone)

    def _holds(self, batch: Batch, written: set[int]) -> bool:
        return bool(self.spark.read.schema(RECORDS).parquet(f"{self.root}/{batch.records}").filter(F.col("seq").isin(*written)).head(1))

    def compact(self, *, force: bool = False) -> bool:
        """Merge the batches of each level that has enough of them into one on the next level; all of them with ``force``.

        Points written over are dropped, and deleted ones; a full merge also drops the tombstones it has applied. Inserts,
        deletions and queries go on beside it; of two compactions of one batch the later gives up.
        """
        if force:
            manifest = self.manifest
            if manifest.batches or manifest.tombstones:
                self._merge(manifest.batches, LAST_LEVEL, whole=True)
            return True
        for level in range(LAST_LEVEL):
            batches = tuple(b for b in self.manifest.batches if b.level == level)
            if len(batches) >= MERGE_AT:
                self._merge(batches, level + 1)
        return True

    def _merge(self, batches: tuple[Batch, ...], level: int, *, whole: bool = False) -> None:
        """Replace ``batches`` by one. ``whole``: they were all there were, so what they and the catalogue no longer hold is forgotten."""
        manifest, name = self.manifest, uuid.uuid4().hex
        dealt = self._dealt(self.points(manifest, batches=batches), sum(b.rows for b in batches))
        points = newest(dealt, list(KEYS), ["seq", "ord"])  # dealt by its keys: no further shuffle
        merged = self._write(points.select(*_names(POINTS)), name, level) if batches else None
        kept, applied, listed = (merged,) if merged and merged.rows else (), set(manifest.tombstones), set(manifest.catalog)
        forget = whole and set(batches) == set(manifest.batches)
        if forget:
            self.catalog(manifest).select(*_names(CATALOG)).write.parquet(f"{self.root}/catalog/{name}")

        def with_merged(now: Manifest) -> Manifest | None:
            if not set(batches) <= set(now.batches):
                return None  # another merge took them
            # batches that came meanwhile have later numbers than any tombstone that was applied
            parts = {"batches": (*(b for b in now.batches if b not in set(batches)), *kept)}
            if forget:
                parts |= {"tombstones": tuple(t for t in now.tombstones if t not in applied), "catalog": (Listed(f"catalog/{name}"), *(c for c in now.catalog if c not in listed))}
            return now.next(**parts)

        if self.files.change(with_merged) is None:
            for folder in ("points", "records", "catalog"):
                self.files.delete(f"{folder}/{name}")

    def vacuum(self) -> None:
        """Delete files that the latest version doesn't use. No query on an older one and no writer may be running."""
        manifest = self.manifest
        live = {"points": {b.path for b in manifest.batches}, "records": {b.records for b in manifest.batches}, "catalog": {c.path for c in manifest.catalog}}
        for folder, used in live.items():
            for name in self.files.names(folder):
                if f"{folder}/{name}" not in used:
                    self.files.delete(f"{folder}/{name}")
        for name in self.files.names("_manifest"):
            if not name.startswith(f"v{manifest.version}.json"):
                self.files.delete(f"_manifest/{name}")

    def clear_all(self) -> bool:
        """Delete everything."""
        self.files.change(lambda now: now.next(batches=(), catalog=(), tombstones=()))
        self.vacuum()
        return True

    def set_chunk_size(self, n: int) -> None:
        """How many points a chunk takes; a file of an insert takes CHUNKS chunks at most. 0 is ignored, MAX_CHUNK the most."""
        if n > 0:
            self.chunk_size = min(n, MAX_CHUNK)

    def usage_by_level(self) -> DataFrame:
        """(level, batches, points): what each level that holds any has."""
        batches = self.manifest.batches
        rows = [(n, len(some), sum(b.rows for b in some)) for n in range(LAST_LEVEL + 1) if (some := [b for b in batches if b.level == n])]
        return self.spark.createDataFrame(rows, "level int, batches bigint, points bigint")

    def usage_summary(self) -> dict:
        """Files and bytes of each level and of the metadata; used and total bytes."""
        manifest = self.manifest
        levels = [{"files": sum(b.files for b in manifest.batches if b.level == n), "bytes": sum(b.bytes for b in manifest.batches if b.level == n)} for n in range(LAST_LEVEL + 1)]
        files, size = map(sum, zip(self.files.usage("catalog", ".parquet"), self.files.usage("_manifest"), strict=True))
        used = size + sum(x["bytes"] for x in levels)
        return {"levels": levels, "metadata": {"files": files, "bytes": size}, "used_bytes": used, "total_bytes": self.capacity}

    # -- catalogue ----------------------------------------------------------------------------------------------

    def measurements(self) -> DataFrame:
        return self.catalog().select("measurement").distinct()

    def fields(self, measurement: str) -> DataFrame:
        """(field) in order of first appearance."""
        rows = self.catalog().filter(F.col("measurement") == measurement).groupBy("field").agg(F.min(F.struct("seq", "place")).alias("_at"))
        return rows.orderBy("_at").select("field")

    def tags(self, measurement: str) -> DataFrame:
        rows = self.catalog().filter(F.col("measurement") == measurement)
        return rows.select(F.explode(F.map_entries("tags")).alias("_e")).select("_e.key", "_e.value").distinct()

    def timestamp_range(self, measurement: str, *, once: bool = False) -> DataFrame:
        """One row (min_ms, max_ms, points); points of writes not yet merged count each, with ``once`` those of a series at one time as one."""
        manifest = self.manifest
        points = self.points(manifest, measurement)
        if once:
            points, tasks = points.select("series_id", "ts_ms"), self._tasks(manifest)
            points = (points.repartition(tasks, "series_id", "ts_ms") if tasks else points).distinct()
        return points.agg(F.min("ts_ms").alias("min_ms"), F.max("ts_ms").alias("max_ms"), F.count("*").alias("points"))
