"""The supplied tables seen as sheets, records and objects."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsheet.operators.objects import extract_objects
from kinsheet.operators.sequence import with_sequence
from kinsheet.plans.flatten import flatten_hierarchy, standard_records
from kinsheet.schemas import CHINESE_NUMERALS, RECORD_COLUMNS, SHEET_HEADER
from kinsheet.session import lasting_table, passing_tables

NUMERALS = CHINESE_NUMERALS[2:12]
SORT_KEY = ["region", "nation", "supplier", "part", "place"]

# Rows every system gets besides its software: (place, serial, name prefix or None).
EXTRA_ROWS = [
    (3, None, "category "),
    (4, "（9）", "orphan "),
    (5, "x-1", "unknown "),
    (6, "7", None),
    (7, "合 计", "sum of "),
]
# Rows of a sheet before its first platform.
LEAD_ROWS = [
    (0, "（十）", "system without platform"),
    (1, "0", "software without platform"),
    (2, "（１）", "module of  unplaced software"),
]

_built: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Inputs that many queries share are built once per session."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _built:
        with passing_tables(spark):
            _built[key] = lasting_table(build())
    return _built[key]


def _numeral(position: Column) -> Column:
    return F.substring(F.lit(NUMERALS), position, F.lit(1))


def _outline(spark: SparkSession, sf_dir: str, many: bool, lead: bool) -> DataFrame:
    def rows(df, region, nation, supplier, part, place, serial, name) -> DataFrame:
        values = [region, nation, supplier, part, F.lit(place)]
        return df.select(
            *[v.cast("long").alias(c) for v, c in zip(values, SORT_KEY)],
            (F.col("n_name") if many else F.lit("all")).alias("source_id"),
            serial.cast("string").alias("serial"),
            name.cast("string").alias("name"),
        )

    before = F.lit(-1)
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    systems = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").join(
        systems, F.col("s_nationkey") == F.col("n_nationkey")
    )
    modules = (
        table(spark, sf_dir, "lineitem")
        .select("l_suppkey", "l_partkey")
        .distinct()
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    region, nation = F.col("r_regionkey"), F.col("n_nationkey")
    supplier, part = F.col("s_suppkey"), F.col("p_partkey")
    bracketed = F.concat(F.lit("（"), _numeral(nation % 10 + 1), F.lit("）"))
    # One sheet has a platform row per region; a sheet per nation repeats its region's row.
    platform_nation = nation if many else before
    parts = [
        rows(
            systems if many else regions,
            region,
            platform_nation,
            before,
            before,
            1,
            _numeral(region + 1),
            F.col("r_name"),
        ),
        rows(systems, region, nation, before, before, 2, bracketed, F.col("n_name")),
        rows(
            suppliers,
            region,
            nation,
            supplier,
            before,
            8,
            (supplier + 1).cast("string"),
            F.col("s_name"),
        ),
        rows(
            modules,
            region,
            nation,
            supplier,
            part,
            9,
            F.concat(F.lit("（"), (part + 1).cast("string"), F.lit("）")),
            F.col("p_name"),
        ),
    ]
    for place, serial, prefix in EXTRA_ROWS:
        name = F.lit(None) if prefix is None else F.concat(F.lit(prefix), F.col("n_name"))
        parts.append(rows(systems, region, nation, before, before, place, F.lit(serial), name))
    if lead:
        for place, serial, name in LEAD_ROWS:
            owner = systems if many else regions.where(region == 0)
            at = (region, nation) if many else (before, before)
            parts.append(
                rows(owner, *at, before, F.lit(-2), place, F.lit(serial), F.lit(name))
            )
    outline = parts[0]
    for more in parts[1:]:
        outline = outline.unionByName(more)
    return outline


def sheets(spark: SparkSession, sf_dir: str, many: bool = False, lead: bool = True) -> DataFrame:
    """Regions, nations, suppliers and supplied parts as outline sheets.

    One sheet in all, or one per nation. Row 1 is a title and row 2 the header.
    """

    def build() -> DataFrame:
        numbered = with_sequence(
            _outline(spark, sf_dir, many, lead), "position", *SORT_KEY, drop=SORT_KEY
        ).select("source_id", "position", "serial", "name")
        first = numbered.groupBy("source_id").agg(F.min("position").alias("first"))
        # One row a sheet: shuffled by sheet, all rows of one sheet would meet in one task.
        body = numbered.join(F.broadcast(first), "source_id").select(
            "source_id",
            (F.col("position") - F.col("first") + 3).alias("row_number"),
            "serial",
            "name",
        )
        serial, name = SHEET_HEADER
        head = first.select(
            "source_id",
            F.explode(
                F.array(
                    F.struct(
                        F.lit(1).cast("long").alias("row_number"),
                        F.lit(None).cast("string").alias("serial"),
                        F.lit("inventory").alias("name"),
                    ),
                    F.struct(
                        F.lit(2).cast("long").alias("row_number"),
                        F.lit(serial).alias("serial"),
                        F.lit(f" {name} ").alias("name"),
                    ),
                )
            ).alias("h"),
        ).select("source_id", "h.*")
        return body.unionByName(head)

    return _once(spark, ("sheets", sf_dir, many, lead), build)


def records(spark: SparkSession, sf_dir: str, many: bool = False, lead: bool = False) -> DataFrame:
    """Standard records of those sheets; with one sheet per nation, the nation is the group."""

    def build() -> DataFrame:
        group = F.col("source_id") if many else "A"
        flat = flatten_hierarchy(sheets(spark, sf_dir, many, lead), group, check=False)
        return standard_records(flat)

    return _once(spark, ("records", sf_dir, many, lead), build)


def sheet_objects(spark: SparkSession, sf_dir: str, many: bool = True) -> DataFrame:
    return extract_objects(records(spark, sf_dir, many), check=False)


def _object(level: str, group: Column, object_id: Column, name: Column, seq: Column) -> list[Column]:
    values = {
        "group_id": group,
        "platform_id": F.lit("P001"),
        "platform_name": F.lit("platform"),
        "system_id": F.lit("S001"),
        "system_name": F.lit("system"),
        f"{level}_id": object_id,
        f"{level}_name": name,
    }
    return [
        F.lit(level).alias("level"),
        object_id.alias("object_id"),
        seq.cast("long").alias("obj_seq"),
        *[values.get(c, F.lit("")).alias(c) for c in RECORD_COLUMNS],
    ]


def vector_objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Objects and lookup vectors from ``embeddings``: group = label, name = id."""
    rows = table(spark, sf_dir, "embeddings")
    key = F.lpad(F.col("vec_id").cast("string"), 10, "0")
    objects = rows.select(
        *_object("software", F.col("label").cast("string"), key, key, F.col("vec_id"))
    )
    return objects, rows.select(key.alias("norm_name"), F.col("embedding").alias("vec"))


def part_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects from ``part``: group = brand, name = part name."""
    key = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    return table(spark, sf_dir, "part").select(
        *_object("software", F.col("p_brand"), key, F.col("p_name"), F.col("p_partkey"))
    )


def supplier_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects from ``supplier``: names of one template with a number, group = nation."""
    key = F.lpad(F.col("s_suppkey").cast("string"), 10, "0")
    return table(spark, sf_dir, "supplier").select(
        *_object("software", F.col("s_nationkey").cast("string"), key, F.col("s_name"), F.col("s_suppkey"))
    )
