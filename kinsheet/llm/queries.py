"""Queries of the operators over the supplied tables, with their fixed parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinsheet.llm import (
    chat,
    decontaminate,
    langid,
    licenses,
    mix,
    quality,
    repeats,
    ring,
    simhash,
    spelling,
    tokens,
    warc,
    whiten,
)
from kinsheet.llm.common import read_table
from kinsheet.session import scratch_folder


SEED = 20


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/tokens-{uuid.uuid4()}"
    tokens.write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_file(), end_id=2)
    shards = spark.read.parquet(path)
    return tokens.document_index(shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


TRICKY = "\\### Assistant: </turn> ok"
DELTA_CHARS = 400


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Every row as the events that streamed it: a message begins, then its text in deltas."""
    spark = conversations.sparkSession
    turns = F.array(
        *[
            F.struct(
                F.lit(-7).cast("long").alias("conv_id"),
                F.lit(n).cast("long").alias("turn"),
                F.lit(role).alias("role"),
                F.lit(TRICKY).alias("text"),
            )
            for n, role in enumerate(("user", "assistant"))
        ]
    )
    rows = conversations.select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.range(1).select(F.inline(turns)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    message = F.row_number().over(order).cast("long")
    number = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / DELTA_CHARS).cast("int")))
    return (
        rows.withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("message", message)
        .withColumn("seq", number)
        .select(
            "conv_id",
            F.col("message").alias("turn"),
            "seq",
            F.when(F.col("seq") == 0, "create").otherwise("delta").alias("kind"),
            "role",
            F.when(F.col("seq") == 0, "")
            .otherwise(F.substring("text", (F.col("seq") - 1) * DELTA_CHARS + 1, F.lit(DELTA_CHARS)))
            .alias("text"),
        )
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = conversation_events(read_table(spark, sf_dir, "conversations"))
    path = f"{scratch_folder(spark)}/chats-{uuid.uuid4()}"
    chat.format_chats(chat.reconstruct(events)).write.parquet(path)
    return chat.digests(spark.read.parquet(path))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.Mix(read_table(spark, sf_dir, "documents"), SEED).taken()
    shards = ["first_shard", "last_shard"]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", *shards)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.BASE, "base_failed", "kept", "quality")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/warc-{uuid.uuid4()}"
    warc.write_archive(read_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path)


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: a directory a source, language and thousand of ids.

    A text whose first line speaks of a licence is a licence file of its directory.
    """
    first = F.substring_index("text", "\n", 1)
    name = F.when(first.rlike("(?i)licen[cs]"), F.concat(F.lit("LICENSE."), "doc_id")).otherwise(
        F.concat("doc_id", F.lit(".txt"))
    )
    folder = F.expr("doc_id div 1000").cast("string")
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", folder, name).alias("path"), "text")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(document_paths(read_table(spark, sf_dir, "documents")))


RING_SHARDS = 8


def op11_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = ring.shard_rows(read_table(spark, sf_dir, "documents"), RING_SHARDS)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(read_table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(read_table(spark, sf_dir, "documents"))
    return spelling.group_variants(words)


def queries() -> dict:
    return {
        "op1_token_files": op1_token_files,
        "op2_decontamination": op2_decontamination,
        "op3_chat_format": op3_chat_format,
        "op4_mix": op4_mix,
        "op5_language": op5_language,
        "op6_simhash": op6_simhash,
        "op7_repeats": op7_repeats,
        "op8_quality": op8_quality,
        "op9_warc": op9_warc,
        "op10_licenses": op10_licenses,
        "op11_ring": op11_ring,
        "op12_whitening": op12_whitening,
        "op13_spelling": op13_spelling,
    }


#: Long payloads that occur again: the last page of each keeps the response.
WARC_SQL = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages
), held AS (
    SELECT
        page_id,
        strlen(payload) AS payload_bytes,
        sha1(payload) AS payload_digest,
        CASE WHEN strlen(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS holder
    FROM payloads
)
SELECT
    CAST(page_id AS BIGINT) AS page_id,
    CAST(payload_bytes AS BIGINT) AS payload_bytes,
    payload_digest,
    CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CAST(CASE WHEN holder <> page_id THEN holder END AS BIGINT) AS refers_to
FROM held
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": WARC_SQL}
