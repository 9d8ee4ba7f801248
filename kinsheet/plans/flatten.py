"""Sheet rows in, full-path records, excluded titles, issues and counts out."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsheet.functions.text import BOM, display_name, quoted
from kinsheet.operators.outline import CHUNK_BITS, classified_rows, header_rows, row_faults, with_state
from kinsheet.schemas import (
    EXCLUDED_HEADERS,
    ISSUE_NO_NAME,
    ISSUE_NO_PARENT,
    ISSUE_NO_PLATFORM,
    ISSUE_NO_SOFTWARE,
    ISSUE_PREFIX,
    ISSUE_UNKNOWN,
    RECORD_COLUMNS,
)
from kinsheet.session import kept_table, materialize, passing_tables


class HierarchyError(ValueError):
    """The sheet breaks the outline rules."""


@dataclass(frozen=True)
class FlattenResult:
    records: DataFrame
    excluded: DataFrame
    issues: DataFrame
    counts: DataFrame
    faults: DataFrame  # rows without a place of their own, see ``row_faults``
    placed: DataFrame  # records with ``place``, 1..n in their sheet
    sizes: DataFrame  # number of records of each sheet, ``rows``


def flatten_hierarchy(
    sheets: DataFrame,
    group_id: str | Column = "A",
    *,
    source_id: str | None = None,
    strict: bool = False,
    check: bool = True,
    chunk_bits: int = CHUNK_BITS,
) -> FlattenResult:
    """Flatten sheets ``(source_id, row_number, serial, name)``.

    ``group_id`` is one group for all sheets, or a column such as ``source_id``.
    ``source_id`` picks one sheet. With ``check`` a missing sheet or header, rows without a
    place of their own and broken ids raise; ids are unique in a group, so several sheets need
    a group each. With ``strict`` the first issue raises too. Without both, only the rows with
    the state of their chunk are stored at once, and the plan behind them stays lazy.
    """
    for column in ("source_id", "row_number", "serial", "name"):
        if column not in sheets.columns:
            raise HierarchyError(f"sheet column missing: {column}")
    if source_id is not None:
        sheets = sheets.where(F.col("source_id") == source_id)
    if isinstance(group_id, str) and not group_id.replace(BOM, "").strip():
        raise HierarchyError("group_id must not be blank")
    if check:
        _require_places(sheets)
        _require_headers(sheets, source_id)
    group = display_name(F.lit(group_id) if isinstance(group_id, str) else group_id)
    rows = classified_rows(sheets)
    if check or strict:
        with passing_tables(sheets.sparkSession):
            states = kept_table(with_state(rows, chunk_bits))
    else:
        states = with_state(rows, chunk_bits)
    result = FlattenResult(
        records=_records(states, group),
        excluded=_excluded(states),
        issues=_issues(states),
        counts=_counts(states),
        faults=row_faults(sheets),
        placed=_records(states, group, "place"),
        # The last row of a sheet knows them all: no paths are made for this.
        sizes=states.groupBy("source_id").agg(F.max("place").alias("rows")),
    )
    if strict:
        first = result.issues.orderBy("source_id", "row_number").limit(1).collect()
        if first:
            raise HierarchyError(first[0]["issue"])
    if check:
        _require_integrity(result)
    return result


def standard_records(result: FlattenResult) -> DataFrame:
    """Records in sheet order with the dense ``input_seq`` that later stages order by."""
    return numbered_records(result, "input_seq").select(*RECORD_COLUMNS, "input_seq")


def numbered_records(result: FlattenResult, name: str) -> DataFrame:
    """Records numbered 1..n by sheet and row, without a sort.

    The state of a sheet's rows counts its records, so only the sheets are put in order. Their
    offsets, one row a sheet, are stored so that the join knows their true size.
    """
    earlier = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("rows").over(earlier), F.lit(0).cast("long"))
    offsets = materialize(result.sizes.select("source_id", offset.alias("offset")))
    numbered = result.placed.join(offsets, "source_id")
    return numbered.withColumn(name, F.col("offset") + F.col("place")).drop("offset", "place")


def _require_headers(sheets: DataFrame, source_id: str | None) -> None:
    heads = header_rows(sheets)
    missing = heads.where(F.col("header_row").isNull()).orderBy("source_id").limit(20).collect()
    if missing:
        raise HierarchyError(f"no header row in sheets {[r['source_id'] for r in missing]}")
    if heads.isEmpty():
        raise HierarchyError("no sheet" if source_id is None else f"no such sheet: {source_id}")


def _require_places(sheets: DataFrame) -> None:
    first = row_faults(sheets).orderBy("fault", "source_id", "row_number").limit(20).collect()
    if first:
        raise HierarchyError(f"rows without a place of their own: {[tuple(r) for r in first]}")


def _is_output(states: DataFrame) -> Column:
    return (F.col("level") == "software") | (F.col("module_id") != "")


def _records(states: DataFrame, group: Column, *more: str) -> DataFrame:
    return states.where(_is_output(states)).select(
        "source_id",
        "row_number",
        group.alias("group_id"),
        *[c for c in RECORD_COLUMNS if c != "group_id"],
        *more,
    )


def _excluded(states: DataFrame) -> DataFrame:
    return (
        states.where(F.col("level") == "category")
        .withColumn("title", F.col("name"))
        .withColumn("source_row", F.col("row_number"))
        .select("source_id", *EXCLUDED_HEADERS)
    )


def _issue_kind() -> Column:
    level = F.col("level")
    return (
        F.when(level == "nameless", ISSUE_NO_NAME)
        .when((level == "system") & (F.col("platform_id") == ""), ISSUE_NO_PLATFORM)
        .when(
            (level == "software") & ((F.col("platform_id") == "") | (F.col("system_id") == "")),
            ISSUE_NO_PARENT,
        )
        .when((level == "module") & (F.col("module_id") == ""), ISSUE_NO_SOFTWARE)
        .when(level == "unknown", ISSUE_UNKNOWN)
    )


def _issues(states: DataFrame) -> DataFrame:
    found = states.withColumn("kind", _issue_kind()).where(F.col("kind").isNotNull())
    text = F.replace(F.col("kind"), F.lit("%s"), quoted("serial"))
    return found.select(
        "source_id", "row_number", F.format_string(ISSUE_PREFIX, F.col("row_number"), text).alias("issue")
    )


def _counts(states: DataFrame) -> DataFrame:
    level = F.col("level")
    per_level = {m: level == m for m in ("platform", "system", "software")}
    per_level["module"] = F.col("module_id") != ""
    per_level["excluded_categories"] = level == "category"
    per_level["output_rows"] = _is_output(states)
    per_level["warnings"] = _issue_kind().isNotNull()
    return states.groupBy("source_id").agg(
        *[F.count_if(condition).alias(name) for name, condition in per_level.items()]
    )


def _require_integrity(result: FlattenResult) -> None:
    """Ids are filled and unique, and their numbers agree with the counts."""
    is_module = F.col("module_id") != ""
    entity = F.when(is_module, F.col("module_id")).otherwise(F.col("software_id"))
    name = F.when(is_module, F.col("module_name")).otherwise(F.col("software_name"))
    per_id = (
        result.records.groupBy("group_id", is_module.alias("is_module"), entity.alias("entity"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if((entity == "") | (name == "")).alias("blank"),
            F.count_if(~is_module & (F.col("module_name") != "")).alias("stray"),
            F.count_if(F.col("group_id") == "").alias("no_group"),
        )
    )
    found = per_id.agg(
        F.count_if(F.col("rows") > 1).alias("duplicate ids"),
        F.sum("blank").alias("blank ids or names"),
        F.sum("stray").alias("software rows with a module name"),
        F.sum("no_group").alias("blank groups"),
        F.count_if(~F.col("is_module")).alias("software"),
        F.count_if("is_module").alias("module"),
    ).first().asDict()
    counted = result.counts.agg(F.sum("software"), F.sum("module")).first()
    found["software count mismatch"] = (found.pop("software") or 0) - (counted[0] or 0)
    found["module count mismatch"] = (found.pop("module") or 0) - (counted[1] or 0)
    broken = {k: v for k, v in found.items() if v}
    if broken:
        raise HierarchyError(f"flattened records are inconsistent: {broken}")
