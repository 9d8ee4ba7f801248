"""Corpus pipeline: documents to token files, one stored table a stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinsheet.llm import decontaminate, langid, mix, simhash, tokens
from kinsheet.llm.queries import SEED, tokenizer_file
from kinsheet.session import scratch_folder

SHINGLE_WORDS, RADIUS_BITS = 4, 4
END_ID = 2
#: The token stage shares its workers with the other stages: it remembers fewer words.
WORDS_KEPT = 1 << 17


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts near a centroid of a language that is learned from the documents themselves."""
    return langid.keep_known(docs, langid.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return simhash.keep_first(docs, SHINGLE_WORDS, RADIUS_BITS)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time, or part, that the mix takes of a document."""
    return mix.mixed_documents(docs, SEED)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, read back: ``(doc_id, start, n_tokens, ids_crc32)``."""
    path = f"{scratch_folder(spark)}/tokens-{uuid.uuid4()}"
    tokens.write_tokens(docs, path, tokenizer_file(), END_ID, WORDS_KEPT)
    index = tokens.document_index(spark.read.parquet(path))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", known_languages),
    ("simhash", drop_near_copies),
    ("decontamination", drop_test_items),
    ("mix", mix_sources),
    ("tokens", write_token_files),
]

#: Fingerprints, tokenizer ids and fitted models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
