"""The queries of this package: name -> (callable, comparison SQL or None). Each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vicinity.llm import (
    byte_bpe, chat_format, conversation_repair, exact_dedup, jaccard_join, language, packing, quality, suffix_dedup,
    token_alignment, token_counts, vector_search, warc_fixity,
)
from vicinity.llm.common import table

OP1 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP7 = """
WITH a AS (SELECT page_id AS number, page_id >> 10 AS file,
    concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:record:', page_id, '>',
           chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
           'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''),
           chr(13), chr(10), chr(13), chr(10)) AS record FROM pages),
laid AS (SELECT number, file, record, strlen(record) AS bytes,
    sum(strlen(record)) OVER (PARTITION BY file ORDER BY number) - strlen(record) AS "offset", sha256(record) AS digest_a FROM a),
b AS (SELECT number, sha256(CASE WHEN number % 97 = 3 THEN left(record, length(record) - 5) || '?' || right(record, 4)
    WHEN number % 89 = 7 THEN left(record, length(record) // 2) ELSE record END) AS digest_b FROM a WHERE number % 101 <> 5)
SELECT file, number, CAST("offset" AS BIGINT) AS "offset", bytes, CASE WHEN digest_b IS NULL THEN 'missing' ELSE 'damaged' END AS status,
       digest_a, digest_b
FROM laid LEFT JOIN b USING (number) WHERE digest_b IS DISTINCT FROM digest_a
"""

OP13 = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(regexp_replace(text, '(<)(\\*)(s>|/s>)|(\[)(\\*)(INST\]|/INST\]|AND\])', '\1\4\\\2\5\3\6', 'g')) AS text_chars,
    length(regexp_replace(role, '(<)(\\*)(s>|/s>)|(\[)(\\*)(INST\]|/INST\]|AND\])', '\1\4\\\2\5\3\6', 'g')) AS role_chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(length('<s>') + length('</s>') + sum(text_chars + CASE WHEN before = role THEN length('[AND]')
        ELSE length('[INST]') + role_chars + length('[/INST]') + CASE WHEN before IS NULL THEN 0 ELSE length('</s>') END END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=False)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_digests(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_fixity.warc_records(table(spark, sf_dir, "pages"))
    return warc_fixity.audit(records, warc_fixity.aged_replica(records))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema)
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(own)))


QUERIES = {
    "op1_exact_dedup": (op1_exact_dedup, OP1),
    "op2_packing": (op2_packing, None),
    "op3_byte_bpe": (op3_byte_bpe, None),
    "op4_quality": (op4_quality, None),
    "op5_suffix_dedup": (op5_suffix_dedup, None),
    "op6_token_counts": (op6_token_counts, None),
    "op7_warc_fixity": (op7_warc_fixity, OP7),
    "op8_vector_search": (op8_vector_search, None),
    "op9_jaccard_join": (op9_jaccard_join, None),
    "op10_language": (op10_language, None),
    "op11_token_alignment": (op11_token_alignment, None),
    "op12_conversation_repair": (op12_conversation_repair, None),
    "op13_chat_format": (op13_chat_format, OP13),
}
