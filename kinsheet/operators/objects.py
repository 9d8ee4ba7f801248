"""Named objects out of records: keyed dedup, conflicts, group order, snapshot."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsheet.functions.text import comparable_name
from kinsheet.schemas import LEVELS, RECORD_COLUMNS, SOFTWARE_COLUMNS
from kinsheet.session import materialize
from kinsheet.sources.records import RecordError, breaks_module_rule, violations


def _path(level: str) -> Column:
    return F.struct(
        *[
            F.col(c) if level == "module" or c in SOFTWARE_COLUMNS else F.lit("").alias(c)
            for c in RECORD_COLUMNS
        ]
    )


def _per_key(records: DataFrame) -> DataFrame:
    """One row per ``(level, group, object)`` with first position and lowest/highest path.

    Both levels share one aggregation. Its map-side part folds the many module rows that
    repeat their software, so a hot software key does not travel row by row.
    """
    software = F.struct(
        F.lit("software").alias("level"),
        F.col("software_id").alias("object_id"),
        _path("software").alias("path"),
    )
    module = F.struct(
        F.lit("module").alias("level"),
        F.col("module_id").alias("object_id"),
        _path("module").alias("path"),
    )
    # No filter over an array with a null: Spark runs a lambda outside its compiled code.
    both, one = F.array(software, module), F.array(software)
    found = F.when(F.col("module_id") != "", both).otherwise(one)
    return (
        records.select("input_seq", F.explode(found).alias("o"))
        .groupBy("o.level", F.col("o.path.group_id").alias("group_id"), "o.object_id")
        .agg(
            F.min("input_seq").alias("obj_seq"),
            F.min("o.path").alias("path"),
            F.max("o.path").alias("other"),
        )
    )


def conflicts(records: DataFrame) -> DataFrame:
    """Keys that stand for different names or paths."""
    return _per_key(records).where(F.col("path") != F.col("other")).select(
        "level", "group_id", "object_id"
    )


def extract_objects(records: DataFrame, *, check: bool = True) -> DataFrame:
    """Deduplicated software and module objects with their path and first position.

    With ``check`` they are stored: the check and all later uses share one aggregation.
    """
    clash = F.col("path") != F.col("other")
    # The group comes from the key: a use without the other path columns then leaves paths out.
    path = [F.col("group_id" if c == "group_id" else f"path.{c}").alias(c) for c in RECORD_COLUMNS]
    keyed = _per_key(records).select("level", "object_id", "obj_seq", *path, clash.alias("clash"))
    if check:
        bad = records.where(
            (F.col("group_id") == "") | (F.col("software_id") == "") | (F.col("software_name") == "")
        )
        if not bad.isEmpty():
            raise RecordError("blank group id, software id or software name")
        # Rules are only spelled out for rows that break one: the test of a row is much cheaper.
        pair = violations(records.where(breaks_module_rule()))
        pair = pair.where(F.col("rule").isin("module_pair", "module_path"))
        broken = pair.orderBy("input_seq", "rule").limit(1).collect()
        if broken:
            raise RecordError(f"{broken[0]['rule']}: {broken[0]['detail']}")
        keyed = materialize(keyed)
        clashes = keyed.where("clash").orderBy("level", "group_id", "object_id")
        first = clashes.select("level", "group_id", "object_id").limit(1).collect()
        if first:
            raise RecordError(f"one id, different names or paths: {tuple(first[0])}")
    return keyed.drop("clash")


def object_name() -> Column:
    return F.when(F.col("level") == "module", F.col("module_name")).otherwise(
        F.col("software_name")
    )


def with_norm_name(
    objects: DataFrame, drop_module_suffix: bool = False, name: Column | None = None
) -> DataFrame:
    suffix = (F.col("level") == "module") if drop_module_suffix else False
    name = object_name() if name is None else name
    return objects.withColumn("norm_name", comparable_name(name, suffix))


def level_order() -> Column:
    """Place of a row's level in results."""
    return F.when(F.col("level") == "software", 0).when(F.col("level") == "module", 1).otherwise(99)


def group_order(objects: DataFrame) -> DataFrame:
    """First position of every group inside its level; comparing it orders the groups."""
    return objects.groupBy("level", "group_id").agg(F.min("obj_seq").alias("group_pos"))


def snapshot_rows(objects: DataFrame) -> DataFrame:
    """The deduplicated records of both levels, entity rows ahead of their modules."""
    return objects.where(F.col("level").isin(*LEVELS)).select(*RECORD_COLUMNS)


def snapshot_order() -> list[Column]:
    return [
        F.col("group_id"),
        F.col("platform_id"),
        F.col("system_id"),
        F.col("software_id"),
        (F.col("module_id") != "").cast("int"),
        F.col("module_id"),
    ]
