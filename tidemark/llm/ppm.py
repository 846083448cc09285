"""Language-model scores by prediction by partial matching over a byte-context trie.

A context of up to ``order`` bytes predicts the next symbol (a byte of the lower-cased text, or the end) from what
followed it. A symbol seen n times weighs 2n - 1, leaving the context weighs the number of distinct symbols seen (escape
method D); a symbol that a context hasn't seen costs such an escape to the next shorter context, in which the symbols already ruled out are excluded; after order 0 the symbols left are
equally likely. Every count goes to all suffixes of a context, so that what a context has seen its suffixes have too.
Hence what is excluded after an escape depends on one pair of contexts only, and the pretrained trie becomes two tables:
log10 P of each (context, symbol), and the log10 weight of leaving each context.

Pretrained: workers count the longest grams of all texts (those of held-out texts with 0), counts are added up by shuffle,
and joins level by level give the cost of each gram from that of the gram without its first symbol. No gram is left out:
costs of the most frequent (at most TOP_GRAMS) are broadcast, those of others are joined, which changes no score. Adaptive
(``Trie``): each text by what came before in it.

The base score takes words with one end a text: sum of log10((c + 0.5) / (N + 0.5 (V + 1))). Counts of the most
frequent words (at most TOP_WORDS) are broadcast, those of others are joined. Words are counted by 64-bit hashes.

Defined cases: null texts are empty (one end token, one end symbol); a null doc_id is in training; rows count each, also
where they repeat; without training texts all symbols are equally likely and no word is known; an empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .shingles import word_hashes

ORDER = 5
END = 256
SYMBOLS = 257
_BITS = 9
TOP_GRAMS = 3_000_000
TOP_WORDS = 500_000
#: Distinct grams or words that a worker counts before it hands them on.
HELD = 800_000
#: Keys that a worker gathers before it sorts and counts them.
WAITING = 2_000_000
#: Symbols that are counted or scored at once; of a longer text one piece after another.
PIECE = 500_000
#: Bytes of text in hand at once; a symbol takes some 100 bytes while it is scored.
COUNTED_BYTES, SCORED_BYTES = 1_000_000, PIECE

_LOWER = np.arange(256, dtype=np.int16)
_LOWER[65:91] += 32


# -- one text after another -----------------------------------------------------------------------------------------


class Trie:
    """The plain form: counts by context, learnt symbol by symbol, for adaptive scores."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.seen: dict[tuple, dict[int, int]] = {}

    def learn(self, before: list[int], symbol: int) -> None:
        for k in range(min(self.order, len(before)) + 1):
            follows = self.seen.setdefault(tuple(before[len(before) - k :]), {})
            follows[symbol] = follows.get(symbol, 0) + 1

    def log10(self, before: list[int], symbol: int) -> float:
        """log10 P of a symbol after the symbols ``before``."""
        total, excluded = 0.0, set()
        for k in range(min(self.order, len(before)), -1, -1):
            follows = self.seen.get(tuple(before[len(before) - k :]))
            if not follows:
                continue
            distinct = len(follows) if len(follows) < SYMBOLS else 0
            whole = sum(2 * n - 1 for s, n in follows.items() if s not in excluded) + distinct
            if symbol in follows:
                return total + math.log10((2 * follows[symbol] - 1) / whole)
            total += math.log10(distinct / whole)
            excluded = set(follows)
        return total - math.log10(SYMBOLS - len(excluded))

    def score(self, text: bytes, *, adaptive: bool) -> float:
        """log10 P of a text and its end; ``adaptive`` learns each symbol once it is scored."""
        total, before = 0.0, []
        for symbol in [*text.lower(), END]:
            total += self.log10(before, symbol)
            if adaptive:
                self.learn(before, symbol)
            before = [*before, symbol][-self.order :] if self.order else []
        return total


# -- counting -------------------------------------------------------------------------------------------------------


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts in turn, each with its end; places of the ends)."""
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))) - 1
    data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)] if texts else np.zeros(0, np.int16)
    data[ends] = END
    return data, ends


def grams(texts: list[bytes], order: int) -> Iterator[np.ndarray]:
    """The longest gram that ends at each symbol, up to order + 1 symbols of its text: 9 bits each, symbols plus 1; by pieces."""
    data, ends = symbols(texts)
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    for a in range(0, len(data), PIECE):
        b = min(a + PIECE, len(data))
        piece = np.zeros(b - a + order, np.int64)
        piece[max(order - a, 0) :] = data[max(a - order, 0) : b]
        piece[max(order - a, 0) :] += 1
        key = piece[order:].copy()
        for k in range(1, order + 1):
            key += piece[order - k : len(piece) - k] << (_BITS * k)
        for j in range(order):  # the symbol that j symbols of its text precede
            at = begins[np.searchsorted(begins, a - j) : np.searchsorted(begins, b - j)] + j - a
            key[at] &= (1 << (_BITS * (j + 1))) - 1
        yield key


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, where each begins) of sorted keys."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[heads], heads


class Counts:
    """Sums by key, kept sorted; keys of ``grams`` or hashes. Keys wait until there are WAITING of them, to be sorted at once."""

    def __init__(self, kind: int):
        self.kind, self.keys, self.sums = kind, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: dict[int, list[np.ndarray]] = {}
        self.n_waiting = 0

    def add(self, keys: np.ndarray, weight: int = 1) -> None:
        self.waiting.setdefault(weight, []).append(keys)
        self.n_waiting += len(keys)
        if self.n_waiting > WAITING:
            self.settle()

    def settle(self) -> None:
        """Add up what waits."""
        for weight, waiting in self.waiting.items():
            new = np.concatenate(waiting)
            new.sort()
            new, heads = _runs(new)
            n = np.diff(heads, append=sum(map(len, waiting))) * weight
            both = np.concatenate([self.keys, new])
            order = np.argsort(both, kind="stable")  # merges two sorted runs
            self.keys, heads = _runs(both[order])
            self.sums = np.add.reduceat(np.concatenate([self.sums, n])[order], heads) if len(heads) else self.sums[:0]
        self.waiting, self.n_waiting = {}, 0

    def handed_on(self) -> pa.RecordBatch:
        self.settle()
        out = pa.RecordBatch.from_arrays([pa.array(np.full(len(self.keys), self.kind, np.int32)), pa.array(self.keys), pa.array(self.sums)], names=["kind", "key", "n"])
        self.keys, self.sums = self.keys[:0], self.sums[:0]
        return out


GRAM, WORD, TEXT = 0, 1, 2


def corpus_counts(rows: DataFrame, order: int) -> DataFrame:
    """(kind, key, n) over all training texts: longest grams, words, and the number of texts (key 0); grams of held-out texts alone have n 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counts(GRAM), Counts(WORD), Counts(TEXT)]
        for held, texts in common.text_slices(batches, "held_out", most=COUNTED_BYTES):
            held = held.to_numpy(zero_copy_only=False)
            for out in (False, True):
                some = [texts[i] for i in np.flatnonzero(held == out)]
                for keys in grams(some, order):
                    counts[GRAM].add(keys, 0 if out else 1)
                if some and not out:
                    counts[WORD].add(word_hashes(some)[0].view(np.int64))
                    counts[TEXT].add(np.zeros(len(some), np.int64))
            for c in counts:
                if len(c.keys) > HELD:
                    yield c.handed_on()
        for c in counts:
            yield c.handed_on()

    rows = common.in_arrow(rows.select("held_out", "text"), run, "kind int, key long, n long")
    return common.stored(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")


# -- the pretrained trie --------------------------------------------------------------------------------------------


def costs(grams: DataFrame, order: int) -> DataFrame:
    """(key, n, cost) for (key, n) of longest grams: log10 P of each one's last symbol after the others.

    Level m has all grams of m symbols that end a longest gram, also those never trained (n 0). A gram meets the one without
    its first symbol, whose cost and whose context's weight it takes on where its own context leaves; so a row of a level
    is joined with at most SYMBOLS rows, and a context has at most SYMBOLS.
    """
    key, n, levels = F.col("key"), F.col("n"), {}
    for m in range(order + 1, 0, -1):
        rows = grams.filter(key.between(1 << (_BITS * (m - 1)), (1 << (_BITS * m)) - 1)).select("key", "n", F.lit(True).alias("own"))
        if m <= order:
            ends = levels[m + 1].select(key.bitwiseAND(F.lit((1 << (_BITS * m)) - 1)).alias("key"), "n", F.lit(False).alias("own"))
            rows = rows.unionByName(ends).groupBy("key").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
            rows = common.stored(rows, "lm-level")
        levels[m] = rows
    # after order 0 each symbol counts once
    shorter = grams.sparkSession.createDataFrame([(0, 1, -math.log10(SYMBOLS), float(SYMBOLS))], "key long, n long, cost double, weight double")
    found, context, seen = [], Window.partitionBy("context"), n > 0
    for m in range(1, order + 2):
        shorter = shorter.select(key.alias("suffix"), n.alias("suffix_n"), F.col("cost").alias("suffix_cost"), F.col("weight").alias("before"))
        rows = levels[m].withColumns({"suffix": key.bitwiseAND(F.lit((1 << (_BITS * (m - 1))) - 1)).cast("long"), "context": F.shiftright("key", _BITS)})
        rows = rows.join(shorter, "suffix").withColumns(
            {
                "total": F.coalesce(F.sum(F.when(seen, 2 * n - 1)).over(context), F.lit(0)),
                "distinct": F.count(F.when(seen, 1)).over(context),
                "gone": F.sum(F.when(seen, 2 * F.col("suffix_n") - 1)).over(context),
            }
        )
        rows = rows.withColumn("distinct", F.when(F.col("distinct") < SYMBOLS, F.col("distinct")).otherwise(0))
        rows = rows.withColumn("weight", (F.col("total") + F.col("distinct")).cast("double"))
        leave = F.log10(F.try_divide("distinct", "weight")) + F.log10(F.try_divide("before", F.col("before") - F.col("gone")))
        leave = F.when(F.col("total") > 0, leave).otherwise(0.0)
        cost = F.when(seen, F.log10(F.try_divide(2 * n - 1, F.col("weight")))).otherwise(leave + F.col("suffix_cost"))
        shorter = common.stored(rows.select("key", "n", "own", cost.alias("cost"), "weight"), "lm-costs")
        found.append(shorter.filter("own").select("key", "n", "cost"))
    return functools.reduce(DataFrame.union, found)


def _frequent(counts: DataFrame, most: int, parts: int) -> tuple[list, Column]:
    """(sizes by step of frequency, whether a row is among the most frequent, at most ``most``: whole steps at a time)."""
    step = F.floor(F.log2("n") * parts).cast("int")
    steps = counts.filter("n > 0").groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    least, some = None, 0
    for r in steps:
        if some + r["rows"] > most:
            break
        least, some = r["step"], some + r["rows"]
    return steps, F.lit(False) if least is None else (F.col("n") > 0) & (step >= least)


class Known:
    """Sorted keys and a value of each, for looking many up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each is there, its value or 0)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        order = np.argsort(keys)
        value, heads = _runs(keys[order])
        spot = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
        hit, times = self.keys[spot] == value, np.diff(heads, append=len(keys))
        there, found = np.empty(len(keys), bool), np.empty(len(keys))
        there[order] = np.repeat(hit, times)
        found[order] = np.repeat(np.where(hit, self.values[spot], 0.0), times)
        return there, found


def gram_scores(known: Known, texts: list[bytes], order: int) -> tuple[np.ndarray, pa.ListArray]:
    """(sum of the known grams' costs, the other grams) of each text."""
    cuts = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    total, n_rest, rest, a = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [], 0
    for keys in grams(texts, order):
        of = np.repeat(np.arange(len(texts)), np.diff(np.clip(cuts, a, a + len(keys)), prepend=a))
        got, value = known.find(keys)
        total += np.bincount(of, weights=value, minlength=len(texts))
        n_rest += np.bincount(of[~got], minlength=len(texts))
        rest.append(keys[~got])
        a += len(keys)
    return total, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rest)]), pa.int32()), pa.array(np.concatenate(rest)))


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score(docs: DataFrame, *, order: int = ORDER, top_grams: int = TOP_GRAMS, top_words: int = TOP_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of each row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = corpus_counts(rows, order)
    words = counts.filter(F.col("kind") == WORD).select(F.col("key").alias("word"), "n")
    n_texts = counts.filter(F.col("kind") == TEXT).agg(F.sum("n")).first()[0] or 0
    steps, frequent = _frequent(words, top_words, 8)
    n_tokens = sum(r["n"] for r in steps) + n_texts
    n_distinct = sum(r["rows"] for r in steps) + (n_texts > 0)
    whole = n_tokens + 0.5 * (n_distinct + 1)
    top = words.filter(frequent).orderBy("word").toArrow()
    all_grams = counts.filter(F.col("kind") == GRAM).select("key", "n")
    gram_costs = costs(all_grams, order)
    _, often = _frequent(gram_costs, top_grams, 4)
    top_costs = gram_costs.filter(often).select("key", "cost").toArrow()
    by_key = np.argsort(top_costs.column("key").to_numpy())
    known_grams = Known(top_costs.column("key").to_numpy()[by_key], top_costs.column("cost").to_numpy()[by_key])
    known_words = Known(top.column("word").to_numpy(), np.log10((top.column("n").to_numpy() + 0.5) / whole))
    model = spark.sparkContext.broadcast((known_grams, known_words))
    del top_costs, by_key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_grams, known_words = model.value
        end = math.log10((n_texts + 0.5) / whole)
        for batch in batches:
            at = 0
            for ids, texts in common.text_slices([batch], "doc_id", most=SCORED_BYTES):
                hashes, offsets = word_hashes(texts)
                got, gain = known_words.find(hashes.view(np.int64))
                sizes = np.diff(offsets)
                base = np.array([gain[a:b].sum() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]) + end
                n_known = np.concatenate([[0], np.cumsum(got)])
                rest = np.concatenate([[0], np.cumsum(~got)])[offsets]
                lists = pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(hashes.view(np.int64)[~got]))
                held = batch.column(2).slice(at, len(ids))
                at += len(ids)
                score, grams_left = gram_scores(known_grams, texts, order)
                columns = [ids, held, pa.array(sizes + 1), pa.array(n_known[offsets[1:]] - n_known[offsets[:-1]] + (n_texts > 0)), pa.array(base), pa.array(score)]
                columns += [lists, grams_left, pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))]
                names = ["doc_id", "held_out", "n_tokens", "top_known", "top_base", "top_score", "rest", "grams", "n_bytes"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, top_known long, top_base double, top_score double, rest array<long>, grams array<long>, n_bytes long"
    scored = common.stored(common.in_arrow(rows, run, schema).withColumn("_row", F.monotonically_increasing_id()), "lm-scores")
    others = scored.select("_row", F.explode("rest").alias("word")).groupBy("_row", "word").agg(F.count("*").alias("times"))
    others = others.join(words.filter(~frequent), "word", "left")
    n = F.coalesce("n", F.lit(0))
    gain = (F.sum(F.col("times") * F.log10((n + 0.5) / F.lit(whole)))).alias("more_base")
    others = others.groupBy("_row").agg(gain, F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"))
    rarer = scored.select("_row", F.explode("grams").alias("key")).join(gram_costs.filter(~often), "key")
    rarer = rarer.groupBy("_row").agg(F.sum("cost").alias("more_score"))
    both = scored.drop("rest", "grams").join(others, "_row", "left").join(rarer, "_row", "left")
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("top_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("top_base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("top_score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
        "n_bytes",
    )


def score_adaptively(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, score): each text by a trie that learns from it alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_slices(batches, "doc_id"):
            yield pa.RecordBatch.from_arrays([ids, pa.array([Trie(order).score(x, adaptive=True) for x in texts], pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")
