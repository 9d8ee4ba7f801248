"""Registered queries over the supplied tables, and the SQL they are checked against."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import bindings as B  # noqa: E402
import oracle as O  # noqa: E402
from kinsheet.functions import scoring, text  # noqa: E402
from kinsheet.operators.objects import conflicts, extract_objects, group_order  # noqa: E402
from kinsheet.operators.outline import classified_rows, header_rows, row_faults  # noqa: E402
from kinsheet.operators.vectors import model_vectors  # noqa: E402
from kinsheet.plans.flatten import flatten_hierarchy  # noqa: E402
from kinsheet.plans.report import result_table, snapshot  # noqa: E402
from kinsheet.plans.runs import flatten_run, similarity_run  # noqa: E402
from kinsheet.plans.similar import find_similar, similarity_job  # noqa: E402
from kinsheet.schemas import EXCLUDED_HEADERS, RECORD_COLUMNS, RECORD_HEADERS  # noqa: E402
from kinsheet.session import passing_tables, scratch_folder  # noqa: E402
from kinsheet.sources.records import (  # noqa: E402
    combine_records,
    missing_entities,
    read_records,
    violations,
)
from kinsheet.sources.sinks import run_options, write_flattened, write_similarity  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

VECTOR_OPTIONS = {"threshold": 0.3, "top_k": 3}
ANCHOR, TARGETS = "3", ["1", "7", "9"]
TARGET_COUNT = 3


def _pairs(results: DataFrame, label: bool = False) -> DataFrame:
    columns = [
        F.col("a.group_id").alias("a_group"),
        F.col("a.software_id").alias("a_id"),
        F.col("b.group_id").alias("b_group"),
        F.col("b.software_id").alias("b_id"),
        F.col("rank").alias("rnk"),
        F.round("score", 6).alias("score"),
    ]
    return results.select(*columns, *(["label"] if label else []))


def _vectors(label: bool = False, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        objects, vectors = B.vector_objects(spark, sf_dir)
        return _pairs(find_similar(objects, vectors, **VECTOR_OPTIONS, **options), label)

    return run


def _directed_vectors(**options) -> Query:
    return _vectors(mode="cross", anchor_group=ANCHOR, target_groups=TARGETS, **options)


def _part_grams(**options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        results = find_similar(B.part_objects(spark, sf_dir), threshold=0.5, **options)
        return _pairs(results, label=True)

    return run


def _supplier_ties(**options) -> Query:
    """Numbered names of one template: nearly all of them score alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        results = find_similar(B.supplier_objects(spark, sf_dir), threshold=0.8, top_k=3, **options)
        return _pairs(results, label=True)

    return run


def _part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = find_similar(B.part_objects(spark, sf_dir), threshold=0.5, top_k=40)
    return results.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def load_letter_counter():
    """A stand-in encoder with a known answer: how often each letter occurs."""
    import numpy as np

    def encode(texts, *, batch_size, max_length):
        return np.array([[t.count(chr(c)) for c in range(97, 123)] for t in texts], dtype="f4")

    return encode


def _part_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = model_vectors(load_letter_counter, batch_size=16)
    results = find_similar(
        B.part_objects(spark, sf_dir), provider, mode="cross", threshold=0.85, top_k=5
    )
    return _pairs(results, label=True)


def _sheet_job(**options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = B.records(spark, sf_dir, many=True)
        results, _ = similarity_job(records, threshold=0.75, top_k=3, numbered=True, **options)
        return result_table(results)

    return run


def _sheet_job_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first nation to the next ones, in the order of their names."""
    groups = B.records(spark, sf_dir, many=True).select("group_id").distinct()
    first = [r["group_id"] for r in groups.orderBy("group_id").limit(1 + TARGET_COUNT).collect()]
    job = _sheet_job(
        mode="cross", anchor_group=first[0], target_groups=first[1:], include_unmatched=True
    )
    return job(spark, sf_dir)


def _flattened(spark: SparkSession, sf_dir: str, many: bool):
    group = F.col("source_id") if many else "A"
    return flatten_hierarchy(B.sheets(spark, sf_dir, many), group, check=False)


def _sheet_records(many: bool) -> Query:
    return lambda spark, sf_dir: _flattened(spark, sf_dir, many).records


def _sheet_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = B.sheets(spark, sf_dir)
    rows = classified_rows(sheets).join(header_rows(sheets), "source_id")
    rows = rows.where(F.col("row_number") > F.col("header_row"))
    return rows.where(F.col("level") != "total").select(
        "source_id", "row_number", "serial", "name", "level"
    )


def _sheet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = B.sheets(spark, sf_dir, many=True)
    rows = classified_rows(sheets).join(header_rows(sheets), "source_id")
    below = F.col("row_number") > F.col("header_row")
    return rows.groupBy("source_id").agg(
        F.count_if(~F.col("level").isin("total") & below).alias("kept"),
        F.count_if(F.col("level") == "nameless").alias("nameless"),
    )


def _sheet_row_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers that are lost, repeated or out of range, by rule."""
    row = F.col("row_number")
    damaged = (
        F.when(row % 50 == 7, None)
        .when(row % 50 == 11, row - 1)
        .when(row % 50 == 13, -row)
        .otherwise(row)
    )
    return row_faults(B.sheets(spark, sf_dir, many=True).withColumn("row_number", damaged))


def _stored_flattening(spark: SparkSession, sf_dir: str) -> str:
    """A sheet a nation through the whole stored run, the sheet's name as its group."""
    folder = f"{scratch_folder(spark)}/{uuid.uuid4()}"
    B.sheets(spark, sf_dir, many=True, lead=False).write.parquet(f"{folder}/sheets")
    flatten_run(spark, f"{folder}/sheets", f"{folder}/flat", group_id=None)
    return f"{folder}/flat"


def _run_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(f"{_stored_flattening(spark, sf_dir)}/excluded_categories")
    return stored.select("source_id", *[F.col(h).alias(c) for c, h in EXCLUDED_HEADERS.items()])


def _run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _stored_flattening(spark, sf_dir)
    similarity_run(spark, [flat], f"{flat}-similar", threshold=0.95, top_k=1)
    stored = spark.read.parquet(f"{flat}-similar/input_snapshot")
    return stored.select(*[F.col(h).alias(c) for c, h in RECORD_HEADERS.items()])


def _broken_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient output has blank parents; two kinds of damage are added by rule."""
    records = B.records(spark, sf_dir, lead=True)
    software = F.col("module_id") == ""
    return records.select(
        *[c for c in RECORD_COLUMNS if c not in ("module_name", "system_id")],
        F.when(software & F.col("software_name").endswith("7"), "stray name")
        .otherwise(F.col("module_name"))
        .alias("module_name"),
        F.when(F.col("module_name").startswith("cold"), "")
        .otherwise(F.col("system_id"))
        .alias("system_id"),
        "input_seq",
    )


def _missing_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = B.records(spark, sf_dir)
    entity_rows = (F.col("module_id") == "") & F.col("software_name").endswith("3")
    return missing_entities(records.where(~entity_rows))


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation claims the same group, so ids of different sheets collide."""
    records = B.records(spark, sf_dir, many=True)
    return conflicts(records.withColumn("group_id", F.lit("A")))


def _objects(level: str, many: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        objects = extract_objects(B.records(spark, sf_dir, many), check=False)
        return objects.where(F.col("level") == level).select(
            "level", "object_id", *RECORD_COLUMNS, "obj_seq"
        )

    return run


def _group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_order(B.sheet_objects(spark, sf_dir))


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two record tables stacked in argument order, cells trimmed, blank rows dropped."""
    tables = []
    for many in (False, True):
        records = B.records(spark, sf_dir, many)
        tables.append(
            records.select(
                *[
                    F.concat(F.lit(" 　"), F.col(c), F.lit("\t")).alias(h)
                    for c, h in RECORD_HEADERS.items()
                ],
                F.col("input_seq").alias("row_number"),
            )
        )
    return combine_records(tables, check=False)


def _stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flatten, store, read back with all checks."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4()}"
    flat = flatten_hierarchy(B.sheets(spark, sf_dir, lead=False))
    write_flattened(flat, path)
    return read_records(spark, [path])


def _stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/{uuid.uuid4()}"
    options = {"mode": "within", "threshold": 0.9, "top_k": 2}
    records = B.records(spark, sf_dir, many=True)
    with passing_tables(spark):
        results, objects = similarity_job(records, numbered=True, **options)
        write_similarity(results, objects, run_options(model="grams", **options), path)
    return spark.read.parquet(f"{path}/similarity_results")


def _run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects per level and the number of results they give."""
    records = B.records(spark, sf_dir, many=True)
    results, objects = similarity_job(records, threshold=0.9, top_k=1)
    counted = objects.groupBy(F.col("level").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    found = results.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("results"))
    return counted.unionByName(found)


def _vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column form of the score: every vector against the first one of its label."""
    rows = B.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", scoring.unit(F.col("embedding")).alias("u")
    )
    first = rows.groupBy("label").agg(F.min_by("u", "vec_id").alias("first_u"))
    score = scoring.cosine(F.col("u"), F.col("first_u"))
    return rows.join(first, "label").select(
        "vec_id", F.round(score, 6).alias("score"), scoring.reaches(score, 0.3).alias("kept")
    )


def _text_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", text.display_name(F.col("text")).alias("name")
    )


def _text_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", text.comparable_name(F.col("text")).alias("name")
    )


def _text_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = B.table(spark, sf_dir, "part")
    doubled = F.concat(F.col("p_name"), F.lit("  模 块"), F.lit("模块"))
    return parts.select("p_partkey", text.comparable_name(doubled, True).alias("name"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(B.sheet_objects(spark, sf_dir))


def _optional() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the training-data operators, if their subpackage is there."""
    try:
        from kinsheet.llm import queries as llm
        import corpus_pipeline as pipeline
    except ModuleNotFoundError as missing:
        if missing.name not in ("kinsheet.llm", "corpus_pipeline"):
            raise
        return {}, {}
    sql = llm.oracle_sql()
    if pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = pipeline.ORACLE_SQL
    return {**llm.queries(), "pipeline": pipeline.run}, sql


def queries() -> dict[str, Query]:
    return {**base_queries(), **_optional()[0]}


def oracle_sql() -> dict[str, str]:
    return {**base_sql(), **_optional()[1]}


def base_queries() -> dict[str, Query]:
    return {
        "sim_within": _vectors(mode="within"),
        "sim_cross": _vectors(mode="cross"),
        "sim_all": _vectors(mode="all"),
        "sim_directed": _directed_vectors(),
        "sim_cross_small_blocks": _vectors(mode="cross", block_rows=64),
        "sim_cross_pivots": _vectors(mode="cross", pivots=8),
        "sim_within_unmatched": _vectors(mode="within", include_unmatched=True, label=True),
        "sim_directed_unmatched": _directed_vectors(include_unmatched=True, label=True),
        "sim_gram_names": _part_grams(mode="within", top_k=5),
        "sim_gram_names_cross": _part_grams(mode="cross", top_k=5),
        "sim_gram_names_all_ranges": _part_grams(mode="all", top_k=5, range_bits=6),
        "sim_ties": _supplier_ties(mode="within"),
        "sim_ties_cross": _supplier_ties(mode="cross"),
        "sim_labels": _part_labels,
        "sim_model_names": _part_model,
        "sim_result_table": _sheet_job(mode="within"),
        "sim_result_table_directed": _sheet_job_directed,
        "stored_results": _stored_results,
        "run_counts": _run_counts,
        "sheet_header": lambda s, d: header_rows(B.sheets(s, d, many=True)),
        "sheet_classify": _sheet_classify,
        "sheet_filter": _sheet_filter,
        "sheet_row_faults": _sheet_row_faults,
        "run_excluded": _run_excluded,
        "run_snapshot": _run_snapshot,
        "sheet_records": _sheet_records(many=False),
        "sheet_records_many": _sheet_records(many=True),
        "sheet_excluded": lambda s, d: _flattened(s, d, False).excluded,
        "sheet_issues": lambda s, d: _flattened(s, d, False).issues,
        "sheet_counts": lambda s, d: _flattened(s, d, True).counts,
        "stored_records": _stored_records,
        "records_combined": _combined,
        "record_violations": lambda s, d: violations(_broken_records(s, d)),
        "record_missing_entity": _missing_entity,
        "record_conflicts": _conflicts,
        "objects_software": _objects("software", many=False),
        "objects_module": _objects("module", many=True),
        "group_order": _group_order,
        "snapshot": _snapshot,
        "vector_cosine": _vector_cosine,
        "text_display": _text_display,
        "text_normalized": _text_normalized,
        "text_module_suffix": _text_suffix,
    }


def base_sql() -> dict[str, str]:
    vector = {"threshold": 0.3, "top_k": 3}
    to_targets = O.directed(ANCHOR, TARGETS)
    cross = O.vector_query(O.CROSS, **vector)
    labelled = f"SELECT {O.PAIR_COLUMNS}, {O.LABEL} AS label FROM ranked"
    grams = O.gram_pairs("parts", 0.5)
    ties = O.gram_pairs("parts", 0.8)
    record = f"group_id, {O.RECORD}"
    fields = ", ".join(
        f"CASE WHEN {c} = '' THEN '{h}' END" for c, h in list(RECORD_HEADERS.items())[:7]
    )
    broken = f"""{O.records_sql(False, True)}, broken AS (
  SELECT group_id, platform_id, platform_name, system_name, software_id, software_name, module_id,
    CASE WHEN module_id = '' AND software_name LIKE '%7' THEN 'stray name' ELSE module_name END
      AS module_name,
    CASE WHEN module_name LIKE 'cold%' THEN '' ELSE system_id END AS system_id, input_seq
  FROM records)
SELECT input_seq, 'missing_fields' AS rule, concat_ws(',', {fields}) AS detail FROM broken
WHERE concat_ws(',', {fields}) <> ''
UNION ALL SELECT input_seq, 'module_pair', group_id || '/' || software_id FROM broken
WHERE (module_id = '') <> (module_name = '')
UNION ALL SELECT input_seq, 'module_path', module_id FROM broken
WHERE module_id <> '' AND (platform_id = '' OR system_id = '' OR software_id = '')"""
    sheet_scope = "a.group_id = b.group_id AND a.obj_seq < b.obj_seq"
    anchor = "a.group_id = (SELECT min(group_id) FROM objects)"
    nation_scope = (
        f"{anchor} AND b.group_id <> a.group_id AND b.group_id IN "
        f"(SELECT DISTINCT group_id FROM objects ORDER BY 1 LIMIT {1 + TARGET_COUNT})"
    )
    objects = f"level, object_id, {record}, obj_seq"
    return {
        "sim_within": O.vector_query(O.WITHIN, **vector),
        "sim_cross": cross,
        "sim_all": O.vector_query(O.ALL, **vector),
        "sim_directed": O.vector_query(to_targets, **vector),
        "sim_cross_small_blocks": cross,
        "sim_cross_pivots": cross,
        "sim_within_unmatched": O.unmatched_query(O.WITHIN, "true", **vector),
        "sim_directed_unmatched": O.unmatched_query(to_targets, f"a.grp = '{ANCHOR}'", **vector),
        "sim_gram_names": f"WITH {O.part_matches(O.WITHIN, grams, 5)} {labelled}",
        "sim_gram_names_cross": f"WITH {O.part_matches(O.CROSS, grams, 5)} {labelled}",
        "sim_gram_names_all_ranges": f"WITH {O.part_matches(f'({O.ALL})', grams, 5)} {labelled}",
        "sim_ties": f"WITH {O.part_matches(O.WITHIN, ties, 3, O.SUPPLIERS)} {labelled}",
        "sim_ties_cross": f"WITH {O.part_matches(O.CROSS, ties, 3, O.SUPPLIERS)} {labelled}",
        "sim_labels": f"WITH {O.part_matches(O.WITHIN, grams, 40)} "
        f"SELECT {O.LABEL} AS label, count(*) AS n FROM ranked GROUP BY 1",
        "sim_model_names": "WITH "
        + O.part_matches(O.CROSS, O.LETTER_PAIRS.format(threshold=0.85), 5)
        + labelled,
        "sim_result_table": O.sheet_result_table(sheet_scope, "rnk IS NOT NULL", 0.75, 3),
        "sim_result_table_directed": O.sheet_result_table(
            nation_scope, anchor, 0.75, 3
        ),
        "stored_results": O.sheet_result_table(sheet_scope, "rnk IS NOT NULL", 0.9, 2),
        "run_counts": f"WITH {O.sheet_matches(sheet_scope, 0.9, 1)} SELECT level AS what, "
        "count(*) AS n FROM objects GROUP BY level UNION ALL SELECT 'results', count(*) FROM ranked",
        "sheet_header": f"{O.outline_sql(True, True)} SELECT source_id, header_row FROM headers",
        "sheet_classify": f"{O.outline_sql(False, True)} "
        "SELECT source_id, row_number, serial, name, level FROM levelled",
        "sheet_filter": f"{O.outline_sql(True, True)} SELECT source_id, count(*) AS kept, "
        "count(*) FILTER (level = 'nameless') AS nameless FROM levelled GROUP BY source_id",
        "sheet_row_faults": f"""{O.outline_sql(True, True)}, damaged AS (
  SELECT source_id, CASE WHEN row_number % 50 = 7 THEN NULL WHEN row_number % 50 = 11
    THEN row_number - 1 WHEN row_number % 50 = 13 THEN -row_number ELSE row_number END AS row_number
  FROM sheet),
counted AS (SELECT source_id, row_number, count(*) AS n FROM damaged GROUP BY 1, 2)
SELECT source_id, row_number, CASE WHEN row_number IS NULL THEN 'no row number'
  WHEN row_number < 1 THEN 'row number out of range' ELSE 'repeated row number' END AS fault, n
FROM counted WHERE row_number IS NULL OR row_number < 1 OR n > 1""",
        "run_excluded": f"{O.states_sql(True, False)} SELECT source_id, platform_id, "
        "platform_name, system_id, system_name, name AS title, row_number AS source_row "
        "FROM states WHERE level = 'category'",
        "run_snapshot": f"{O.objects_sql(True)} SELECT {record} FROM objects",
        "sheet_records": f"{O.states_sql(False, True)} SELECT source_id, row_number, "
        f"'A' AS group_id, {O.RECORD} FROM states WHERE level = 'software' OR module_id <> ''",
        "sheet_records_many": f"{O.states_sql(True, True)} SELECT source_id, row_number, "
        f"source_id AS group_id, {O.RECORD} FROM states "
        "WHERE level = 'software' OR module_id <> ''",
        "sheet_excluded": f"{O.states_sql(False, True)} SELECT source_id, platform_id, "
        "platform_name, system_id, system_name, name AS title, row_number AS source_row "
        "FROM states WHERE level = 'category'",
        "sheet_issues": f"{O.states_sql(False, True)} SELECT source_id, row_number, "
        "'第 ' || row_number || ' 行：' || problem AS issue FROM issues WHERE problem IS NOT NULL",
        "sheet_counts": f"{O.states_sql(True, True)} {O.counts_select()}",
        "stored_records": f"{O.records_sql(False, False)} SELECT {record}, input_seq FROM records",
        "records_combined": f"{O.records_sql(False, False)} SELECT {record}, input_seq FROM records "
        f"UNION ALL (WITH {O.records_sql(True, False)[5:]} "
        f"SELECT {record}, input_seq + (1::BIGINT << 40) FROM records)",
        "record_violations": broken,
        "record_missing_entity": f"{O.records_sql(False, False)} SELECT DISTINCT group_id, "
        "software_id FROM records EXCEPT SELECT group_id, software_id FROM records "
        "WHERE module_id = '' AND software_name NOT LIKE '%3'",
        "record_conflicts": f"{O.records_sql(True, False)} "
        "SELECT 'software' AS level, 'A' AS group_id, software_id AS object_id FROM records "
        "GROUP BY software_id HAVING count(DISTINCT (platform_id, platform_name, system_id, "
        "system_name, software_name)) > 1 UNION ALL SELECT 'module', 'A', module_id FROM records "
        "WHERE module_id <> '' GROUP BY module_id HAVING count(DISTINCT (platform_id, "
        "platform_name, system_id, system_name, software_id, software_name, module_name)) > 1",
        "objects_software": f"{O.objects_sql(False)} SELECT {objects} FROM objects "
        "WHERE level = 'software'",
        "objects_module": f"{O.objects_sql(True)} SELECT {objects} FROM objects "
        "WHERE level = 'module'",
        "group_order": f"{O.objects_sql(True)} SELECT level, group_id, min(obj_seq) AS group_pos "
        "FROM objects GROUP BY level, group_id",
        "snapshot": f"{O.objects_sql(True)} SELECT {record} FROM objects",
        "vector_cosine": f"WITH {O.VECTORS} SELECT a.seq AS vec_id, "
        "round(list_cosine_similarity(a.v, b.v), 6) AS score, "
        "list_cosine_similarity(a.v, b.v) + 1e-7 >= 0.3 AS kept "
        "FROM items a JOIN items b ON b.seq = a.first_seq",
        "text_display": f"SELECT doc_id, trim(regexp_replace(replace(text, chr(65279), ''), "
        f"'{O.SPACES}+', ' ', 'g')) AS name FROM documents",
        "text_normalized": f"SELECT doc_id, replace(trim(regexp_replace(lower(text), "
        f"'{O.SPACES}+', ' ', 'g')), 'ß', 'ss') AS name FROM documents",
        "text_module_suffix": "SELECT p_partkey, lower(p_name) || ' 模块' AS name FROM part",
    }


def entry(spark: SparkSession) -> DataFrame:
    """Ranked near-duplicates across the groups of the smallest ``embeddings`` table."""
    return queries()["sim_cross"](spark, "/root/testdata/sf0.001")
