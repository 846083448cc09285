"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are whole words and byte prefixes of words, with log(1 + count) as value. P(grade > j) = sigmoid(w x - t_j)
with one weight vector for all thresholds t_1 < t_2 < ...; the expected severity is the sum of these. Labels say toxic or
not; severity grades of toxic training documents are the thirds of how much speaks against them (their telltale
features' values times z), grade 0 is clean.

The model is fit on the ``sample_rows`` labelled documents with the least hashes of their ids. Features are counted by
class on the workers and the ``max_features`` that differ most (by z) are taken; only their values reach the driver.
Every document is scored whole.

Defined cases: null and empty texts have no features and get the score of none; documents may be labelled several times
(any toxic label counts), null labels are ignored; without labels of both classes nothing is toxic; equal rows score
alike; where rows repeat a labelled id, the one with the least (hash, text) is in the sample; an empty table gives an empty
result. Columns besides doc_id and text pass through ``without_toxic`` unchanged, whatever their names.

``MAX_FEATURES`` bounds the model, a documented parameter: the features that tell the classes apart best, by z of at least
LEAST_Z. How many a larger bound would add has not been measured.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 10_000
MAX_FEATURES = 512
#: Least z of a feature, least number of sample documents that have it.
LEAST_Z, LEAST_DOCS = 5.0, 5
GRADES = 4
_WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Lengths in bytes of the prefixes that are features; the first is the gate.
GATE, LONGEST = 5, 9


def _features(word: bytes) -> list[bytes]:
    """A word's features: itself with an end mark, and its prefixes."""
    return [word + b"$", *(word[:k] for k in range(GATE, min(LONGEST, len(word)) + 1))]


def _counted(text: bytes) -> Counter:
    return Counter(f for w, n in Counter(_WORD.findall(text.lower())).items() for f in _features(w) for _ in range(n))


@dataclass
class Model:
    """Weights by feature, thresholds; no features: nothing is toxic."""

    weights: dict[bytes, float]
    thresholds: np.ndarray
    threshold: float = 0.5

    def __post_init__(self) -> None:
        self.gate = {f[:GATE] for f in self.weights} | {f[:-1][:GATE] for f in self.weights if f.endswith(b"$")}

    def linear(self, text: bytes) -> float:
        gate, counts = self.gate, Counter()
        for word in [w for w in _WORD.findall(text.lower()) if w[:GATE] in gate]:
            counts.update(f for f in _features(word) if f in self.weights)
        return sum(self.weights[f] * np.log1p(n) for f, n in sorted(counts.items()))

    def beyond(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) by row, for j = 0, 1, ..."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, n_grades: int, *, ridge: float = 1e-4, rounds: int = 1500, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of a cumulative-link model by gradient steps with momentum (Adam) on the whole sample, equal rows taken together."""
    rows, times = np.unique(np.column_stack([x, grades]), axis=0, return_counts=True)
    x, grades, share, d = rows[:, :-1], rows[:, -1].astype(np.int64), times / times.sum(), x.shape[1]
    theta = np.concatenate([np.zeros(d), [1.0], np.zeros(n_grades - 2)])  # weights, first threshold, logs of the gaps
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, cuts = theta[:d], theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        s = x @ w
        low, high = _sigmoid(edges[grades] - s), _sigmoid(edges[grades + 1] - s)
        low[grades == 0], high[grades == n_grades - 1] = 0.0, 1.0
        mass = np.maximum(high - low, 1e-12)
        grad_cut = np.zeros(n_grades - 1)
        np.add.at(grad_cut, grades[grades < n_grades - 1], -(share * high * (1 - high) / mass)[grades < n_grades - 1])
        np.add.at(grad_cut, grades[grades > 0] - 1, (share * low * (1 - low) / mass)[grades > 0])
        grad_w = x.T @ (share * (1 - low - high)) + ridge * w
        gaps = np.exp(theta[d + 1 :])
        tail = np.cumsum(grad_cut[::-1])[::-1]
        grad = np.concatenate([grad_w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:d], theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample_rows`` labelled documents, written once."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    least = F.min(F.struct(F.xxhash64("text"), "text")).alias("_least")  # where rows repeat an id, the same one in every run
    return common.stored(texts.groupBy("doc_id", "toxic").agg(least).select("doc_id", "toxic", "_least.text"), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES) -> Model:
    sample = labelled_sample(docs, labels, sample_rows)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not (n0 and n1):
        return Model({}, np.array([1.0, 2.0, 3.0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, texts in common.text_slices(batches, "toxic"):
            held = (Counter(), Counter())
            for mark, text in zip(marks.to_pylist(), texts, strict=True):
                held[mark > 0].update(_counted(text).keys())
            names = [*held[0].keys() | held[1].keys()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array([h[f] for f in names], pa.int64()) for h in held)], names=["feature", "clean", "toxic"])

    counts = common.in_arrow(sample.select("toxic", "text"), count, "feature binary, clean long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("clean") + F.col("toxic") >= LEAST_DOCS)
    both = (F.col("clean") + F.col("toxic")) / (n0 + n1)
    z = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(both * (1 - both) * (1 / n0 + 1 / n1) + 1e-12)
    chosen = counts.withColumn("z", z).filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "feature").limit(max_features).collect()
    if not chosen:
        return Model({}, np.array([1.0, 2.0, 3.0]))
    names = [bytes(r["feature"]) for r in chosen]
    place, against = {f: i for i, f in enumerate(names)}, np.array([max(r["z"], 0.0) for r in chosen])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, texts in common.text_slices(batches, "toxic"):
            found = [{place[f]: n for f, n in _counted(t).items() if f in place} for t in texts]
            lists = [pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))]
            keys = [zlib.crc32(t) for t in texts]
            yield pa.RecordBatch.from_arrays([marks.cast(pa.int32()), *lists, pa.array(keys, pa.int64())], names=["toxic", "at", "n", "key"])

    rows = common.in_arrow(sample.select("toxic", "text"), values, "toxic int, at array<int>, n array<int>, key long").orderBy("key", "toxic").toArrow()
    toxic = rows.column("toxic").to_numpy() > 0
    x = np.zeros((len(toxic), len(names)))
    for i, (at, n) in enumerate(zip(rows.column("at").to_pylist(), rows.column("n").to_pylist(), strict=True)):
        x[i, at] = n
    x = np.log1p(x)
    speaks = x @ against
    grades = np.zeros(len(toxic), np.int64)
    cuts = np.quantile(speaks[toxic], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    grades[toxic] = 1 + np.searchsorted(cuts, speaks[toxic], side="right")
    weights, thresholds = fit_ordinal(x, grades, GRADES)
    return Model(dict(zip(names, weights.tolist(), strict=True)), thresholds)


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with expected_severity, severity (the grade that is more likely than not reached) and toxic."""
    names = docs.columns
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*own, "expected_severity double, severity int, toxic_probability double, toxic boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for keys, texts in common.text_slices([batch], names[0]):
                beyond = model.beyond(np.array([model.linear(t) for t in texts]))
                some = batch.slice(at, len(keys))
                at += len(keys)
                made = [pa.array(beyond.sum(1)), pa.array((beyond >= 0.5).sum(1).astype(np.int32)), pa.array(beyond[:, 0]), pa.array(beyond[:, 0] >= model.threshold)]
                yield pa.RecordBatch.from_arrays([*some.columns, *made], names=[*names, "expected_severity", "severity", "toxic_probability", "toxic"])

    return common.in_arrow(docs, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, expected_severity, severity, toxic_probability, toxic) of each row."""
    return graded(docs.select("doc_id", "text"), fit(docs, labels, **options)).drop("text")


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    kept = graded(docs.select(*(F.col(f"`{c}`").alias(f"c{i}" if c != "text" else c) for i, c in enumerate(docs.columns))), fit(docs, labels, **options)).filter(~F.col("toxic"))
    return kept.select(*(F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
