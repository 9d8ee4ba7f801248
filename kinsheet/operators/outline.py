"""Carry outline state down an ordered sheet.

A sheet is cut into chunks of consecutive row numbers. Running windows work inside
``(source, chunk)``; one summary row per chunk is combined along the sheet and handed
back to its chunk as the state to start from. A sheet holding most of the data is
therefore spread over many tasks, and only its summaries meet in one.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsheet.functions.text import (
    BOM,
    cell_text,
    display_name,
    has_text,
    normalized_serial,
    outline_level,
)
from kinsheet.schemas import HEADER_SCAN_ROWS, SHEET_HEADER, TOTAL_MARK
from kinsheet.session import materialize

CHUNK_BITS = 12  # a chunk is 2**CHUNK_BITS consecutive row numbers
MARKERS = ("platform", "system", "software")
CHUNK = ["source_id", "chunk"]
MAX_ROW = (1 << 40) - 1  # row numbers share a long with the number of their table later on


def _is_header(df: DataFrame) -> Column:
    serial, name = SHEET_HEADER
    return (
        (F.col("row_number") <= HEADER_SCAN_ROWS)
        & (display_name(cell_text(df, "serial")) == serial)
        & (display_name(cell_text(df, "name")) == name)
    )


def header_rows(sheets: DataFrame) -> DataFrame:
    """First header row of every source, null where there is none."""
    found = F.when(_is_header(sheets), F.col("row_number"))
    return sheets.groupBy("source_id").agg(F.min(found).alias("header_row"))


def _filled(sheets: DataFrame) -> Column:
    return has_text(cell_text(sheets, "serial")) | has_text(cell_text(sheets, "name"), besides=BOM)


def row_faults(sheets: DataFrame) -> DataFrame:
    """Rows with text that have no place of their own: ``(source_id, row_number, fault, n)``.

    Such rows cannot be ordered: those without a place are in no output, and of several in
    one place any could come first. One aggregate, folded before the shuffle.
    """
    row = F.col("row_number")
    fault = (
        F.when(F.col("source_id").isNull(), "no source")
        .when(row.isNull(), "no row number")
        .when((row < 1) | (row > MAX_ROW), "row number out of range")
        .when(F.col("n") > 1, "repeated row number")
    )
    places = sheets.where(_filled(sheets)).select("source_id", row.cast("long").alias("row_number"))
    counted = places.groupBy("source_id", "row_number").agg(F.count(F.lit(1)).alias("n"))
    found = counted.select("source_id", "row_number", fault.alias("fault"), "n")
    return found.where(F.col("fault").isNotNull())


def classified_rows(sheets: DataFrame) -> DataFrame:
    """Clean and classify rows; blank rows are gone, headers and totals are marked.

    Filters here look at raw cells only: one on the normalised serial would be pushed
    below the projection and run the NFKC hop a second time.
    """
    raw = sheets.where(F.col("source_id").isNotNull() & F.col("row_number").isNotNull())
    raw = raw.where(_filled(sheets))
    cleaned = raw.select(
        "source_id",
        F.col("row_number").cast("long").alias("row_number"),
        normalized_serial(cell_text(sheets, "serial")).alias("serial"),
        display_name(cell_text(sheets, "name")).alias("name"),
        _is_header(sheets).alias("is_header"),
    )
    serial, name = F.col("serial"), F.col("name")
    return cleaned.withColumn(
        "level",
        F.when((serial == TOTAL_MARK) | (name == TOTAL_MARK), "total")
        .when(name == "", "nameless")
        .otherwise(outline_level(serial, name)),
    )


def _row(marker: Column) -> Column:
    return F.coalesce(marker["row"], F.lit(0))


def _software_is_current(platform: Column, system: Column, software: Column) -> Column:
    return _row(software) > F.greatest(_row(platform), _row(system))


def with_state(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Add current platform/system/software and running counts to classified rows.

    Rows with the state of their chunk are stored: the summaries and the rows themselves start
    from them, and so does every use of the result. The chunks' own states are stored as well,
    so that the join knows their true size.
    """
    if 1 << chunk_bits <= HEADER_SCAN_ROWS:
        raise ValueError(f"chunks must exceed {HEADER_SCAN_ROWS} rows, so a header stays in chunk 0")
    local = materialize(_within_chunks(rows, chunk_bits))
    carried = materialize(_into_chunks(local))
    joined = local.drop("last", "header_row").join(carried, CHUNK).where(
        F.col("source_header").isNotNull() & ~F.col("level").isin("header", "total")
    )
    counts = [(F.col(f"n_{m}") + F.col(f"c_{m}")).alias(f"n_{m}") for m in MARKERS]
    current = [F.coalesce(f"at_{m}", f"from_{m}").alias(f"at_{m}") for m in MARKERS]
    modules = F.col("n_module") + F.when(F.col("open_ok"), F.col("n_open")).otherwise(0)
    return _with_paths(
        joined.select(
            "source_id",
            "row_number",
            "serial",
            "name",
            "level",
            *counts,
            *current,
            (modules + F.col("c_module")).alias("n_module"),
        )
    )


def _within_chunks(rows: DataFrame, chunk_bits: int) -> DataFrame:
    """Running state of each row as far as its own chunk knows it."""
    in_order = Window.partitionBy(*CHUNK).orderBy("row_number")
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.col("level")
    chunked = rows.withColumn("chunk", F.shiftright("row_number", chunk_bits))
    # Rows above the first header are not data. Headers only occur in chunk 0.
    headed = chunked.withColumn(
        "header_row", F.min(F.when(F.col("is_header"), F.col("row_number"))).over(running)
    ).where((F.col("chunk") > 0) | (F.col("row_number") >= F.col("header_row")))
    headed = headed.withColumn(
        "level",
        F.when(F.col("row_number") == F.col("header_row"), "header").otherwise(level),
    )
    marker = F.struct(F.col("row_number").alias("row"), F.col("name").alias("name"))
    marked = headed.select(
        *CHUNK,
        "row_number",
        "serial",
        "name",
        "level",
        "header_row",
        *[F.sum((level == m).cast("long")).over(running).alias(f"n_{m}") for m in MARKERS],
        *[F.max(F.when(level == m, marker)).over(running).alias(f"at_{m}") for m in MARKERS],
    )
    at = [F.col(f"at_{m}") for m in MARKERS]
    is_module = level == "module"
    no_marker_yet = at[0].isNull() & at[1].isNull() & at[2].isNull()
    flagged = marked.withColumn("placed", is_module & _software_is_current(*at)).withColumn(
        "open", is_module & no_marker_yet
    )
    return flagged.select(
        *marked.columns,
        F.sum(F.col("placed").cast("long")).over(running).alias("n_module"),
        F.sum(F.col("open").cast("long")).over(running).alias("n_open"),
        F.lead("row_number").over(in_order).isNull().alias("last"),
    )


def _into_chunks(local: DataFrame) -> DataFrame:
    """State that each chunk starts from: one row per chunk."""
    totals = local.where("last")  # running values end where the chunk does
    earlier = Window.partitionBy("source_id").orderBy("chunk")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *CHUNK,
        F.min("header_row").over(Window.partitionBy("source_id")).alias("source_header"),
        "n_module",
        "n_open",
        *[F.coalesce(F.sum(f"n_{m}").over(earlier), F.lit(0)).alias(f"c_{m}") for m in MARKERS],
        *[F.max(f"at_{m}").over(earlier).alias(f"from_{m}") for m in MARKERS],
    )
    # Modules met before any marker of their chunk belong to the carried software, if any.
    open_ok = _software_is_current(*[F.col(f"from_{m}") for m in MARKERS])
    modules = F.col("n_module") + F.when(open_ok, F.col("n_open")).otherwise(0)
    return carried.select(
        *CHUNK,
        "source_header",
        *[f"c_{m}" for m in MARKERS],
        *[f"from_{m}" for m in MARKERS],
        open_ok.alias("open_ok"),
        F.coalesce(F.sum(modules).over(earlier), F.lit(0)).alias("c_module"),
    )


def _numbered(prefix: str, number: Column, digits: int) -> Column:
    """``prefix`` and a number of at least ``digits`` digits, without a formatter a row."""
    text = number.cast("string")
    padded = F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)
    return F.concat(F.lit(prefix), padded)


def _with_paths(rows: DataFrame) -> DataFrame:
    platform, system, software = (F.col(f"at_{m}") for m in MARKERS)
    current = {
        "platform": platform.isNotNull(),
        "system": _row(system) > _row(platform),
        "software": _software_is_current(platform, system, software),
    }
    form = {"platform": "P", "system": "S", "software": "SW"}
    is_module = (F.col("level") == "module") & current["software"]
    blank = F.lit("")
    return rows.select(
        "source_id",
        "row_number",
        "serial",
        "name",
        "level",
        *[
            column
            for m in MARKERS
            for column in (
                F.when(current[m], _numbered(form[m], F.col(f"n_{m}"), 3))
                .otherwise(blank)
                .alias(f"{m}_id"),
                F.when(current[m], F.col(f"at_{m}")["name"]).otherwise(blank).alias(f"{m}_name"),
            )
        ],
        F.when(is_module, _numbered("M", F.col("n_module"), 4))
        .otherwise(blank)
        .alias("module_id"),
        F.when(is_module, F.col("name")).otherwise(blank).alias("module_name"),
        # Software and modules met so far: the place of one among the records of its sheet.
        (F.col("n_software") + F.col("n_module")).alias("place"),
    )
