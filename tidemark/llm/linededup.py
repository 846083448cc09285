"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line stripped of blanks with A-Z lower-cased; runs hold 128-bit hashes of keys with the number of
documents that have them, sorted by hash. A new batch of documents merge-anti-joins the runs' frequent keys (they need
no more counting) and adds the rest as a run of its own on level 0; ``fanout`` runs of a level are merged into one on
the next. A key that ``min_docs`` documents have is frequent, and a second pass drops its lines everywhere.

Defined cases: a null or empty text is one empty line; keys of fewer than ``min_chars`` code points never go; every row
counts as a document, also where rows repeat a doc_id; an empty table gives an empty result. A kept text is its kept
lines joined by line feeds (empty where none is kept); other columns pass through, whatever their names, but for n_lines and
n_dropped, which are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_STRIP = common.BLANKS.encode()
#: Keys that a worker counts before it hands its counts on.
HELD = 500_000
#: Up to so many frequent keys (16 bytes each) go to the workers by broadcast; more are joined to the lines.
MOST_BROADCAST = 500_000


def _key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(_STRIP).lower()
    if len(key) < min_chars or (min_chars > 1 and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _halves(keys) -> list[pa.Array]:
    """128-bit hashes as two columns of signed longs that sort alike."""
    both = [(int.from_bytes(k[:8], "big", signed=True), int.from_bytes(k[8:], "big", signed=True)) for k in keys]
    return [pa.array([x[i] for x in both], pa.int64()) for i in (0, 1)]


def line_counts(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """(batch, hi, lo, n): documents of each batch that have a key, added up within a worker. Stored by batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            rows = list(held.items())
            hi, lo = _halves([k for (_, k), _ in rows])
            return pa.RecordBatch.from_arrays([pa.array([b for (b, _), _ in rows], pa.int32()), hi, lo, pa.array([n for _, n in rows], pa.int64())], names=["batch", "hi", "lo", "n"])

        for numbers, texts in common.text_slices(parts, "batch"):
            for number, text in zip(numbers.to_pylist(), texts, strict=True):
                held.update({(number, k) for k in (_key(x, min_chars) for x in text.split(b"\n")) if k})
            if len(held) > HELD:
                yield handed_on()
                held.clear()
        if held:
            yield handed_on()

    batch = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(batches)), F.lit(0)).cast("int")
    return common.stored(common.in_arrow(docs.select(batch.alias("batch"), "text"), run, "batch int, hi long, lo long, n long"), "line-counts", by="batch")


class LineRuns:
    """The runs under a folder of the shared store, by level; newer ones last."""

    def __init__(self, spark, min_docs: int, fanout: int = 4, root: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.root = root or common.scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _write(self, counts: DataFrame, level: int) -> None:
        path = f"{self.root}/L{level}-{self.written:06d}"
        self.written += 1
        rows = counts.groupBy("hi", "lo").agg(F.sum("n").alias("n")).withColumn("frequent", F.col("n") >= self.min_docs)
        rows.sortWithinPartitions("hi", "lo").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("hi long, lo long, n long, frequent boolean").parquet(*paths)

    def add(self, counts: DataFrame) -> None:
        """Take in a batch's (hi, lo, n)."""
        paths = [p for level in self.levels for p in level]
        if paths:
            known = self._read(paths).filter("frequent").select("hi", "lo").distinct()
            counts = counts.join(known.hint("merge"), ["hi", "lo"], "left_anti")
        self._write(counts.select("hi", "lo", "n"), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        paths, self.levels[level] = self.levels[level], []
        self._write(self._read(paths).select("hi", "lo", "n"), level + 1)
        for path in paths:
            common.drop_path(self.spark, path)

    def frequent(self) -> DataFrame:
        """(hi, lo) of the frequent keys of all runs. Counts may stop rising once a key is frequent, never before."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "hi long, lo long")
        return self._read(paths).groupBy("hi", "lo").agg(F.sum("n").alias("n")).filter(F.col("n") >= self.min_docs).select("hi", "lo")


def _drop(text: bytes, gone, min_chars: int) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    kept = [x for x in lines if _key(x, min_chars) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def without_lines(docs: DataFrame, frequent: DataFrame, min_chars: int, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The documents without lines whose keys are frequent, with n_lines and n_dropped."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = [f"c{i}" for i in range(len(names))]  # no name of a document's column can clash
    text, key = own[names.index("text")], own[names.index("doc_id")]
    docs = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != text), "kept string, lines long, gone long"])
    spark = docs.sparkSession
    frequent = common.stored(frequent, "frequent-lines")
    if frequent.count() <= most_broadcast:
        found = frequent.toArrow()
        pairs = zip(found.column("hi").to_pylist(), found.column("lo").to_pylist(), strict=True)
        shared = spark.sparkContext.broadcast(frozenset(a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True) for a, b in pairs))
        rows, own_keys = docs, False
    else:
        rows, own_keys, shared = _with_own_keys(docs, key, text, frequent, min_chars), True, None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = 0
            for keys, texts in common.text_slices([part], key, text):
                some = part.slice(at, len(keys))
                at += len(keys)
                if own_keys:
                    gone = [{a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True) for a, b in x or ()} for x in _pairs(some)]
                else:
                    gone = [shared.value] * len(texts)
                done = [_drop(t, g, min_chars) for t, g in zip(texts, gone, strict=True)]
                made = [pa.array([x[0].decode() for x in done], pa.string()), *(pa.array([x[i] for x in done], pa.int64()) for i in (1, 2))]
                others = [c for c in own if c != text]
                columns = [some.column(some.schema.get_field_index(c)) for c in others]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*others, "kept", "lines", "gone"])

    found = common.in_arrow(rows, run, schema)
    out = [F.col("kept" if o == text else o).alias(c) for c, o in zip(names, own, strict=True)]
    return found.select(*out, F.col("lines").alias("n_lines"), F.col("gone").alias("n_dropped"))


def _pairs(batch: pa.RecordBatch) -> list[list[tuple[int, int]]]:
    return [[(y["hi"], y["lo"]) for y in x or ()] for x in batch.column(batch.schema.get_field_index("_keys")).to_pylist()]


def _with_own_keys(docs: DataFrame, key: str, text: str, frequent: DataFrame, min_chars: int) -> DataFrame:
    """The documents with ``_keys``: the frequent keys that the rows of their id have."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_slices(parts, key, text):
            for i, line_text in enumerate(texts):
                hi, lo = _halves(sorted({k for k in (_key(x, min_chars) for x in line_text.split(b"\n")) if k}))
                yield pa.RecordBatch.from_arrays([pa.repeat(ids[i], len(hi)), hi, lo], names=["_of", "hi", "lo"])

    kind = docs.schema[key].dataType.simpleString()
    lines = common.in_arrow(docs.select(key, text), run, f"_of {kind}, hi long, lo long")
    keys = lines.join(frequent, ["hi", "lo"]).groupBy("_of").agg(F.collect_set(F.struct("hi", "lo")).alias("_keys"))
    return docs.join(keys, F.col(key).eqNullSafe(F.col("_of")), "left").drop("_of")


def dedup_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The documents, taken in as ``batches`` batches, without the lines that at least ``min_docs`` of them have."""
    counts = line_counts(docs, batches, min_chars)
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for number in range(batches):
        runs.add(counts.filter(F.col("batch") == number))
    return without_lines(docs, runs.frequent(), min_chars, most_broadcast)
