"""The queries this subpackage registers, each an operator applied to its whole table, and their DuckDB oracles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, linededup, mixing, nearjoin, ppm, quality, tokens, toxicity

WORD = r"'[^\x20\x09-\x0D]+'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_components(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_lsa_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A conversation whose texts hold the template's own control strings.
CONTROL_CHAT = {"messages": [{"role": "user", "content": r"\### Assistant: </turn> ok"}, {"role": "assistant", "content": r"\### Assistant: </turn> ok"}]}


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.from_table(table(spark, sf_dir, "conversations"))
    record = spark.range(1).select(F.lit(-7).cast(chats.schema["conv_id"].dataType).alias("conv_id"), F.lit(json.dumps(CONTROL_CHAT)).alias("payload"))
    chats = chats.unionByName(chat.from_json(record, "payload").select("conv_id", "turns"))
    return chat.digests(chat.formatted(chats))


def op9_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_source_mix": op4_source_mix,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_lsa_decontaminate": op7_lsa_decontaminate,
    "op8_chat_format": op8_chat_format,
    "op9_ppm_score": op9_ppm_score,
    "op10_token_orc": op10_token_orc,
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op3_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
        g AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS gram
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest(range(5)) AS u(k) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
              FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
              WHERE trim(line, {_BLANKS}) <> '' GROUP BY doc_id),
        m AS (SELECT d.doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
                     coalesce(n_lines, 0) AS n_lines
              FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 100 * n_symbols <= 10 * n_words
               AND 100 * (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) <= 35 * length(t)
               AND 100 * length(regexp_replace(t, '[\p{{L}}\p{{M}}\s\x0B]+', '', 'g')) <= 55 * length(t)
               AND 100 * (n_words - len(list_distinct(w))) <= 95 * n_words
               AND 100 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) <= 30 * n_words
               AND 100 * n_dup_lines <= 50 * n_lines AS kept
        FROM b""",
    "op6_line_dedup": rf"""
        WITH l AS (SELECT row, doc_id, i, lines[i] AS line, lower_key FROM
                   (SELECT row, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
                    FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
                   LATERAL (SELECT translate(trim(lines[i], {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key)),
        f AS (SELECT lower_key FROM l WHERE lower_key <> '' GROUP BY lower_key HAVING count(DISTINCT row) >= 10),
        m AS (SELECT l.*, f.lower_key IS NOT NULL AS gone FROM l LEFT JOIN f USING (lower_key))
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY row, doc_id""",
    "op8_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS t,
                     replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ': ', ':\ ') AS r FROM c),
        a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS spoken,
                     coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                     CAST(sum(length('### ' || r || ': ' || t || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a""",
    "op4_source_mix": rf"""
        WITH s AS (SELECT doc_id, source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), {WORD}))) AS BIGINT) AS size
                   FROM documents GROUP BY doc_id, source),
        p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
              FROM s GROUP BY source),
        q AS (SELECT *, [3, 1, 2][sid % 3 + 1] AS weight, 2 * source_size AS cap FROM p),
        o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, sid) AS place,
                     CAST(sum(cap) OVER (ORDER BY cap / weight, sid) - cap AS BIGINT) AS capped,
                     CAST(sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest,
                     CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS budget FROM q),
        v AS (SELECT *, (budget - capped) / rest AS lev FROM o),
        f AS (SELECT arg_min(lev, place) AS lev FROM v WHERE cap >= lev * weight),
        t AS (SELECT v.source, source_size, coalesce(least(CAST(cap AS DOUBLE), f.lev * weight), CAST(cap AS DOUBLE)) AS target FROM v LEFT JOIN f ON true),
        x AS (SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
                     CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('0:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id
                                            ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS at0
              FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size
                    + greatest(0, least(at0 + size, quota % source_size) - at0) END AS taken
        FROM x""",
}
