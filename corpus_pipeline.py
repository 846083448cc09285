"""A training corpus from raw documents, stage by stage: each stage's result is written as Parquet and read by the next.

Defined cases are those of the operators; every stage but the last returns the columns of its input. Near duplicates and
benchmark items are sought row by row, also among rows without an id or with a repeated one: of rows that are equal in id
and text one stays, others are told apart by their texts. A copy without an id goes rather than one with an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, mixing, nearjoin, tokens, toxicity

#: Near duplicates share 80 % of their sets of five-word shingles.
SHINGLE_WORDS, SIMILARITY = 5, 80


def _named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fit on the labelled ones among them, doesn't call toxic."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity connect, the one with the least id."""
    rows, key = common.keyed(docs)
    found = nearjoin.near_components(rows.select(F.col(key).alias("doc_id"), "text"), words=SHINGLE_WORDS, percent=SIMILARITY)
    return common.without(rows, found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id"), key).select(*_named(docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, key = common.keyed(docs)
    found = decontaminate.leaks(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return common.without(rows, found.select("doc_id"), key).select(*_named(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix's slots, once, twice or not: whole ones, about as many words of a source as its target."""
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in ORC, read back and digested: (doc_id, start, n_tokens, ids_crc32)."""
    import public_tokenizers

    return tokens.token_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SQL can express neither the trained model nor the latent space; the stages are tested on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what a stage has written is deleted once the next one has read it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = common.scratch_path(spark, name)
        docs = common.written(stage(spark, docs, sf_dir), path)
        if before:
            common.drop_path(spark, before)
        before = path
    made = STAGES[-1][1](spark, docs, sf_dir)
    common.drop_path(spark, before)
    return made
