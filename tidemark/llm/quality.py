"""Quality rules as a short-circuit cascade ordered by measured rejection per cost. DataFrame functions only.

``measures`` computes what every row reports; ``RULES`` are further tests of these and of the text. On a bounded sample each
rule's rejections are counted and its own time is taken: that of a job that evaluates it REPEATS times on every row, less that
of the same job without a rule. The cascade then tests the rules in falling order of rejections per second, and a
document's later rules are not evaluated once one has rejected it. The order changes the cost, never the verdict.

Defined cases: null, empty and blank texts have no words, so that the base test rejects them; equal rows give equal
results; an empty table gives an empty result (and the cascade keeps the declared order). Only doc_id and text are read.
Repeated 5-word windows are found by 64-bit hashes within one text.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 5
SAMPLE_ROWS = 1000
#: How often each rule is evaluated on a sample's row while it is timed; the least time that a rule counts with.
REPEATS, LEAST_SECONDS = 8, 1e-4


def _covered(grams: Column) -> Column:
    """Words inside the windows whose hash occurs twice or more."""

    def of_pairs(pairs: Column) -> Column:
        same = lambda x, i: ((i > 0) & (pairs[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | (
            (i < F.size(pairs) - 1) & (pairs[F.least(i + 1, F.size(pairs) - 1)]["h"] == x["h"])
        )
        places = F.sort_array(F.transform(F.filter(pairs, same), lambda x: x["i"]))
        return common.let(places, of_places)

    def of_places(places: Column) -> Column:
        last = F.size(places) - 1
        wide = F.transform(places, lambda p, i: F.when(i == last, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), places[F.least(i + 1, last)] - p)))
        return F.aggregate(wide, F.lit(0).cast("long"), lambda total, x: total + x)

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(common.let(pairs, of_pairs))


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _words, _lines) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; _lines counts those with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), common.words(F.col("text")).alias("_words"))
    rows = rows.withColumn("_hashes", F.transform("_words", lambda x: F.xxhash64(x)))
    w, h = F.col("_words"), F.col("_hashes")
    grams = F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(h[i + k] for k in range(WINDOW))))
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(common.BLANKS)) != "")
    rows = rows.select(
        "doc_id",
        "text",
        "_words",
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        common.let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct"))).alias("_of_lines"),
        common.let(grams, _covered).alias("n_repeat_words"),
    )
    rows = rows.withColumns({"_lines": F.col("_of_lines.all").cast("long"), "n_dup_lines": (F.col("_of_lines.all") - F.col("_of_lines.distinct")).cast("long")})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _share_at_most(part: Column, whole: Column, percent: int) -> Column:
    return 100 * part <= percent * whole


#: name -> test of (text, words) and of the columns of ``measures``: true passes.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "mean_word_length": lambda t, w: F.col("word_chars").between(2 * F.col("n_words"), 20 * F.col("n_words")),
    "symbols": lambda t, w: _share_at_most(F.col("n_symbols"), F.col("n_words"), 10),
    "digits": lambda t, w: _share_at_most(F.char_length(t) - F.char_length(F.regexp_replace(t, r"[0-9]", "")), F.char_length(t), 35),
    "letters": lambda t, w: _share_at_most(F.char_length(F.regexp_replace(t, r"[\p{L}\p{M}\s]+", "")), F.char_length(t), 55),
    "distinct_words": lambda t, w: _share_at_most(F.size(w) - F.size(F.array_distinct(w)), F.size(w), 95),
    "stutter": lambda t, w: _share_at_most(F.size(F.filter(w, lambda x, i: (i > 0) & (x == w[F.greatest(i - 1, F.lit(0))]))), F.size(w), 30),
    "duplicate_lines": lambda t, w: _share_at_most(F.col("n_dup_lines"), F.col("_lines"), 50),
}


def plan_order(docs: DataFrame, rules: dict[str, Callable], sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules in the order in which the cascade tests them: name, rejected (share), seconds (for the sample), score.

    ``sample_rows`` bounds the sample (about: rows are drawn independently). Times are the least of three runs.
    """
    count = docs.count()
    rows = docs.select("doc_id", "text").sample(fraction=min(1.0, sample_rows / max(count, 1)), seed=7)
    rows = common.stored(measures(rows), "quality-sample")
    often = rows.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(fails: Column) -> tuple[float, float]:
        """(share of rows that it holds for, seconds)."""
        test, seconds = often.agg(F.count("*").alias("n"), F.count_if(fails).alias("rejected")), []
        for _ in range(3):
            began = time.perf_counter()
            got = test.first()
            seconds.append(time.perf_counter() - began)
        return got["rejected"] / max(got["n"], 1), min(seconds)

    empty, found = timed(F.col("_time") < 0)[1], []
    for name, rule in rules.items():
        share, seconds = timed(~rule(F.col("text"), F.col("_words")))
        own = max(seconds - empty, LEAST_SECONDS) / REPEATS
        found.append({"name": name, "rejected": share, "seconds": own, "score": share / own})
    return sorted(found, key=lambda x: -x["score"])


def cascade(rules: dict[str, Callable], order: list[str], first: Column) -> Column:
    """True where ``first`` is false and every rule passes; CASE evaluates no branch after the first that holds."""
    verdict = F.when(first, F.lit(False))
    for name in order:
        verdict = verdict.when(~rules[name](F.col("text"), F.col("_words")), F.lit(False))
    return verdict.otherwise(F.lit(True))


def quality(docs: DataFrame, rules: dict[str, Callable] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    rules = RULES if rules is None else rules
    order = [x["name"] for x in plan_order(docs, rules, sample_rows)]
    rows = measures(docs).withColumn("kept", cascade(rules, order, F.col("base_failed")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
