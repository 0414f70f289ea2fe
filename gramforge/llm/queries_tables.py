"""Queries over archives, conversations and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gramforge.llm import chat, merkle, mixing
from gramforge.llm.common import table


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    whole = merkle.Replica(pages)
    return merkle.audit_records(whole, merkle.Replica(merkle.damaged(pages), manifest=whole))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("row.doc_id", "row.source", "n_tokens", "weight", "block", "copies")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.render(chat.fold(chat.log_of(rows))))


QUERIES = {"op1_merkle_fixity": op1_merkle_fixity, "op3_temperature_mixing": op3_temperature_mixing, "op9_chat_format": op9_chat_format}

_RECORD = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || {1} || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen({0}) || chr(13) || chr(10) || chr(13) || chr(10) || {0} || chr(13) || chr(10) || chr(13) || chr(10)"

ORACLE_SQL = {
    "op1_merkle_fixity": f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, substr(md5(page_id::VARCHAR), 1, 2) AS k FROM pages),
a AS (SELECT page_id, k, strlen({_RECORD.format('html', 'page_id')}) AS n, sha256({_RECORD.format('html', 'page_id')}) AS d, sha256({_RECORD.format("(html || ' ')", 'page_id')}) AS e, sha256({_RECORD.format('html', '(-page_id - 1)')}) AS x FROM p),
o AS (SELECT *, page_id >> 12 AS f, coalesce(sum(n) OVER (PARTITION BY page_id >> 12 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM a)
SELECT page_id AS record_id, CASE k WHEN '00' THEN 'altered' ELSE 'missing' END AS status, f AS warc_file, place::BIGINT AS warc_offset, n::BIGINT AS n_bytes, d AS digest, CASE k WHEN '00' THEN e END AS replica_digest FROM o WHERE k IN ('00', '01')
UNION ALL SELECT -page_id - 1, 'extra', -1 - f, NULL, NULL, NULL, x FROM o WHERE k = '02'""",
    "op9_chat_format": """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(role) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
}
