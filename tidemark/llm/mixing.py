"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled (by the MD5 of seed and id) and laid end to end on a token axis, which is cut
into blocks of ``block_tokens``. The schedule has one slot for each block that a source must give. Slot points are the
van der Corput sequence: the bit-reversed slot number, mapped through the cumulative numbers of slots of the sources,
names the slot's source, so that any stretch of the schedule holds the sources close to their shares. The slot's rank
within its source names the block; ranks beyond the last block start over (a second pass). DataFrame functions only.
``mix`` counts what is taken to the word; ``mixed_rows`` writes the mix out in the order of its slots, whole documents only.

Defined cases: a null text has size 0; null sources form a source of their own, last in order; a document of size 0
takes 0; rows that repeat a (doc_id, source) count as one document of their summed size; an empty table gives an empty
result. Columns other than doc_id, text and source are not read; ``mixed_rows`` passes them through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK_TOKENS = 2048
#: Up to so many taken documents (some 60 bytes each) are broadcast to pick their rows; more are joined.
MOST_BROADCAST = 200_000
#: Slots or documents whose order one window sorts at most (about).
CHUNK = 4096


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each document."""
    rows = docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"))
    return rows.groupBy("doc_id", "source").agg(F.sum("size").alias("size"))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """One row for each source: source_id (rank by code point, null last), source_size, weight, target.

    Targets share ``share`` times all sizes by weight; none is above ``most`` times its source's size, and what the cap
    cuts off is shared again. With sources in the order of cap over weight, those at their cap are a prefix; the level
    is that of the first prefix whose next source stays below its cap. The window runs over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights) + 1).cast("int"))
    per = per.withColumn("source_id", rank.cast("long")).withColumn("weight", weight.cast("long"))
    per = per.withColumn("_cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), "source_id")
    everything = Window.partitionBy()
    per = (
        per.withColumn("_place", F.row_number().over(order))
        .withColumn("_capped", F.sum("_cap").over(order) - F.col("_cap"))
        .withColumn("_rest", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_rest"))
    )
    below = F.col("_cap") >= F.col("_level") * F.col("weight")
    level = F.min(F.when(below, F.struct("_place", "_level"))).over(everything)["_level"]
    cap = F.col("_cap").cast("double")
    target = F.coalesce(F.least(cap, level * F.col("weight")), cap)
    return per.select("source", "source_id", "source_size", "weight", target.alias("target"))


def bit_reversed(value: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a long in reverse order."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        keep = F.lit(mask).cast("long")
        value = F.shiftleft(value.bitwiseAND(keep), shift).bitwiseOR(F.shiftrightunsigned(value, shift).bitwiseAND(keep))
    value = F.shiftleft(value, 32).bitwiseOR(F.shiftrightunsigned(value, 32))
    return F.shiftrightunsigned(value, 64 - bits) if bits else F.lit(0).cast("long")


def schedule(sources: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The slots: (slot, source_id, rank, pass, block, take): what each gives, in the order of the mix.

    A source gives floor(target) words: its blocks in turn, the last one cut where the target ends.
    """
    spark = sources.sparkSession
    rest = F.col("quota") % F.col("source_size")
    plan = (
        sources.filter("source_size > 0")
        .withColumn("quota", F.floor("target"))
        .withColumn("n_blocks", F.ceil(F.col("source_size") / block_tokens))
        .withColumn("n_slots", F.expr("quota div source_size") * F.col("n_blocks") + F.ceil(rest / block_tokens))
        .withColumn("_end", F.sum("n_slots").over(Window.orderBy("source_id")))
        .withColumn("_start", F.col("_end") - F.col("n_slots"))
        .select("source_id", "source_size", "quota", "n_blocks", "n_slots", "_start", "_end")
        .filter("n_slots > 0")
    )
    total = plan.agg(F.max("_end")).first()[0] or 0
    bits = max(total - 1, 0).bit_length()
    points = spark.range(total).select(F.col("id").alias("point"), F.expr(f"id div {CHUNK}").alias("_piece"))
    spans = plan.withColumn("_piece", F.explode(F.expr(f"sequence(_start div {CHUNK}, (_end - 1) div {CHUNK})")))
    slots = points.join(spans, "_piece").filter("point >= _start AND point < _end")
    slots = slots.withColumn("slot", bit_reversed(F.col("point"), bits)).withColumn("_one", F.lit(1).cast("long"))
    slots = slots.withColumn("_chunk", F.expr(f"slot div {CHUNK}"))
    slots = common.running_start(slots, ["source_id"], "_chunk", [F.col("slot")], "_one", "rank")
    slots = slots.withColumn("pass", F.expr("rank div n_blocks")).withColumn("block", F.col("rank") % F.col("n_blocks"))
    first = F.col("block") * block_tokens
    whole = F.least(F.lit(block_tokens).cast("long"), F.col("source_size") - first)
    left = F.col("quota") - F.col("pass") * F.col("source_size") - first
    return slots.select("slot", "source_id", "rank", "pass", "block", F.least(whole, left).alias("take"))


def laid_out(sizes: DataFrame, sources: DataFrame, seed: int = 0) -> DataFrame:
    """The documents with source_id, source_size, target and ``at``, their first word's place among their source's words."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    names = sources.select("source_id", "source_size", "target", F.col("source").alias("_name"))
    docs = sizes.join(names, sizes["source"].eqNullSafe(names["_name"])).drop("_name").withColumn("_key", key)
    docs = docs.withColumn("_chunk", F.substring("_key", 1, 3))
    return common.running_start(docs, ["source_id"], "_chunk", [F.col("_key"), F.col("doc_id")], "size", "at").drop("_chunk", "_key")


def mix(docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """What the mix takes of each document: (doc_id, source, source_id, size, source_size, target, taken, passes).

    ``taken`` counts words, repeats counted; ``passes`` is an array of (slot, at, words) for each pass that takes any: the
    first slot that does, the document's place in its source, and how many words, always the document's first ones.
    """
    sizes = common.stored(sized(docs), "mix-sizes")
    sources = common.stored(source_targets(sizes, weights, share, most), "mix-sources")
    slots = schedule(sources, block_tokens)
    placed = laid_out(sizes, sources, seed)
    pieces = placed.withColumn("block", F.expr(f"explode_outer(CASE WHEN size > 0 THEN sequence(at div {block_tokens}, (at + size - 1) div {block_tokens}) END)"))
    joined = pieces.join(slots.select("source_id", "block", "pass", "take", "slot"), ["source_id", "block"], "left")
    begin = F.greatest(F.col("at"), F.col("block") * block_tokens)
    end = F.least(F.col("at") + F.col("size"), F.col("block") * block_tokens + F.col("take"))
    joined = joined.withColumn("_taken", F.when(F.col("take").isNull(), F.lit(0)).otherwise(F.greatest(end - begin, F.lit(0))))
    keys = ["doc_id", "source", "source_id", "size", "source_size", "target"]
    first = F.min(F.when(F.col("_taken") > 0, F.col("slot"))).alias("slot")
    by_pass = joined.groupBy(*keys, "pass").agg(F.sum("_taken").alias("_taken"), first, F.min("at").alias("at"))
    of_pass = F.collect_list(F.when(F.col("_taken") > 0, F.struct("slot", "at", F.col("_taken").alias("words"))))
    return by_pass.groupBy(*keys).agg(F.sum("_taken").alias("taken"), F.array_sort(of_pass).alias("passes"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents in the order of its slots: a row for each pass that takes half or more of a document's words.

    A document comes where its first slot is. Where a source's target ends inside a document, that one is taken whole or
    not at all, whichever is nearer. Passes are few (``most``), so the explode makes at most that many rows of a document.
    """
    taken = mix(docs, **options).select("doc_id", "source", "size", F.explode("passes").alias("_pass")).filter(2 * F.col("_pass.words") >= F.col("size"))
    taken = common.stored(taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "_pass.slot", "_pass.at"), "mix-taken")
    if taken.count() <= MOST_BROADCAST:
        taken = F.broadcast(taken)
    own = [f"c{i}" for i in range(len(docs.columns))]  # no name of a document's column can clash
    rows = docs.toDF(*own)
    key, source = (F.col(own[docs.columns.index(c)]) for c in ("doc_id", "source"))
    rows = rows.join(taken, key.eqNullSafe(F.col("_id")) & source.eqNullSafe(F.col("_source")))
    rows = rows.repartitionByRange("slot", "at").sortWithinPartitions("slot", "at")
    return rows.select(*(F.col(c).alias(name) for c, name in zip(own, docs.columns, strict=True)))
