"""Helpers the operators of this subpackage share: scratch tables, words, prefix sums, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words everywhere in this subpackage: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset and Spark runs in one process, a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scratch: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the application's scratch tables are deleted when its Python ends."""
    root = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"
    if root not in _scratch:
        _scratch.add(root)
        atexit.register(_at_exit, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _at_exit(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        drop_path(spark, root)


#: Settings while a table is written: the shuffle files of its plan go when it is done, and Python gets its input in batches of a few MB.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextlib.contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: On a local or mounted folder Hadoop starts a process (chmod) for each file it makes, for a moment another view of the whole JVM's
#: memory, and makes a file of checksums beside each; without those it is half as many. Pages have checksums of their own, tested when read.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
_TESTED = {"parquet.page.verify-checksum.enabled": "true"}


def written(df: DataFrame, path: str, *, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to ``path`` and read it."""
    writer = df.write.option("compression", "zstd").options(**_PLAIN_FILES)
    with writing(df.sparkSession):
        (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).options(**_TESTED).parquet(path)


def stored(df: DataFrame, name: str, *, by: str | None = None) -> DataFrame:
    """Cut the lineage of ``df`` by a Parquet table in the shared folder, which survives lost executors."""
    return written(df, scratch_path(df.sparkSession, name), by=by)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``, after which a worker, which lives on for other tasks, gives its free memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def release() -> None:
    """Give memory that is free inside this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later read needs."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    """Array of the words of a text: maximal runs of anything but ``BLANKS``; empty for null and for blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def n_words(text: Column) -> Column:
    """Number of words of a text as a long."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK_RUN))).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_start(df: DataFrame, keys: list[str], chunk: str, order: list[Column], amount: str, out: str) -> DataFrame:
    """Exclusive prefix sum of ``amount`` for each ``keys`` in ``chunk`` then ``order`` order, as column ``out``.

    ``chunk`` must rise with ``order``. Sums of chunks are added up first, so no task ever holds all rows of a key:
    a window sees the rows of one chunk, or one row for each chunk.
    """
    sums = df.groupBy(*keys, chunk).agg(F.sum(amount).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy(chunk)) - F.col("_sum")
    base = sums.select(*keys, chunk, before.alias("_base"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = df.withColumn("_inside", F.sum(amount).over(inside) - F.col(amount))
    return placed.join(base, [*keys, chunk]).withColumn(out, F.col("_base") + F.col("_inside")).drop("_base", "_inside")


#: Bytes of text that a Python worker takes in hand at once; a longer text is taken alone.
SLICE_BYTES = 2_000_000


def text_slices(batches: Iterator[pa.RecordBatch], key: str, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(keys, UTF-8 texts) of a few MB at a time; null texts are empty."""
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key))
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).fill_null(b"")
        if not len(texts):
            continue
        sizes = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
        sizes = np.diff(sizes)
        upto, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + most, side="right")))
            yield keys.slice(begin, end - begin), texts.slice(begin, end - begin).to_pylist()
            begin = end


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of a sorted integer column, which may cross batches, one table at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, int)
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and values[begin] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = values[begin]
    if held:
        yield pa.Table.from_batches(held)


#: Up to so many ids are broadcast to drop documents by them (some 50 bytes each in memory); more are joined by shuffle.
MOST_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose ``key`` is not among ``ids`` (one column, doc_id), which are few enough to broadcast or joined."""
    gone = stored(ids.select(F.col("doc_id").alias("_gone")).distinct(), "dropped-ids")
    if gone.count() <= MOST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column that names each one, and the column's name.

    The name of a document is its doc_id. Rows without one, or with one that other rows have too, are named by a hash of
    doc_id and text, beyond all ids, and of rows that are equal in both one stays.
    """
    name = "_key"
    while name in docs.columns:
        name += "_"
    shared = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id")), "shared-ids")
    n, own = shared.count(), F.col("doc_id").cast("long")
    if not n:
        return docs.withColumn(name, own), name
    if n <= MOST_IDS:
        shared = F.broadcast(shared)
    same = docs["doc_id"].eqNullSafe(shared["_id"])
    code = F.lit(2**63 - 1) - F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**61))
    once = docs.join(shared, same, "left_semi").withColumn(name, code).dropDuplicates([name])
    return docs.join(shared, same, "left_anti").withColumn(name, own).union(once), name
