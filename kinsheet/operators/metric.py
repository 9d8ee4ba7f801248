"""Stripes by nearest centre: pairs of stripes too far apart for the threshold are never made.

A sample of distinct names gives the centres. Every name goes to its nearest one, and a stripe
keeps its radius, the widest angle to its centre. Two names are at least
``angle(centres) - radius - radius`` apart, so a pair of stripes is left out when that exceeds
the angle of the threshold. Names of zero length have no angle and are never left out.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from kinsheet.functions.scoring import NORM_FLOOR, THRESHOLD_TOLERANCE
from kinsheet.session import materialize

MOST_CENTRES = 1024
_SLACK = 1e-6  # more than rounding does to an arc cosine
_NO_ANGLE = -1  # centre of names without a direction, and of scopes of one stripe


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(vectors, axis=1)
    return vectors / np.maximum(norms, NORM_FLOOR)[:, None], norms >= NORM_FLOOR


def sample_centres(rows: DataFrame, wanted: int) -> np.ndarray:
    """Directions of ``wanted`` distinct names, the first by hash."""
    picked = rows.groupBy("name").agg(F.any_value("payload").alias("payload"))
    picked = picked.orderBy(F.xxhash64("name"), "name").limit(min(wanted, MOST_CENTRES))
    vectors = [r["payload"] for r in picked.collect()]
    if not vectors or not vectors[0]:
        return np.zeros((0, 0))
    units, pointed = _units(np.array(vectors, dtype=np.float64))
    return np.unique(units[pointed], axis=0)


def nearest_centre(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with ``centre`` and ``angle``; without a direction -1 and a half turn."""
    schema = StructType(
        [*rows.schema.fields, StructField("centre", IntegerType()), StructField("angle", DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("payload").flatten().to_numpy(zero_copy_only=False)
            units, pointed = _units(flat.astype(np.float64).reshape(batch.num_rows, -1))
            cosine = units @ centres.T
            centre = np.argmax(cosine, axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(centre)), centre], -1.0, 1.0))
            centre[~pointed], angle[~pointed] = _NO_ANGLE, math.pi
            batch = batch.append_column("centre", pa.array(centre.astype(np.int32)))
            yield batch.append_column("angle", pa.array(angle))

    return rows.mapInArrow(run, schema)


def metric_stripes(
    rows: DataFrame,
    centres: np.ndarray,
    *,
    scope: list[str],
    threshold: float,
    two_sided: bool,
    block_rows: int,
    stripe_rows: Column,
    stripe_values: int,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, cells)``: rows with their ``stripe``, and the pairs of stripes to compare.

    ``cells`` has ``(*scope, x, y)``, with ``x <= y`` unless the sides differ. A scope of up to
    ``block_rows`` names is one stripe; a centre with more names than ``stripe_rows``, a number
    made from the scope's ``n``, is split by hash into stripes of equal radius.
    """
    spark = rows.sparkSession
    assigned = materialize(nearest_centre(rows, centres))
    sizes = assigned.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") <= block_rows
    assigned = assigned.join(sizes, scope).withColumns(
        {
            "centre": F.when(small, F.lit(_NO_ANGLE)).otherwise(F.col("centre")),
            "angle": F.when(small, F.lit(math.pi)).otherwise(F.col("angle")),
        }
    )
    width = F.size("payload").cast("long")
    parts = assigned.groupBy(*scope, "side", "centre").agg(
        F.max("angle").alias("radius"),
        F.greatest(
            F.ceil(F.count(F.lit(1)) / F.max(stripe_rows)), F.ceil(F.sum(width) / stripe_values)
        ).cast("long").alias("pieces"),
    )
    key = [*scope, "side", "centre"]
    parts = materialize(parts)
    # Centre and piece in one number; -1 becomes 0.
    number = F.shiftleft((F.col("centre") + 1).cast("long"), 32)
    striped = assigned.join(parts.select(*key, "pieces"), key).withColumn(
        "stripe", number + F.pmod(F.xxhash64("name"), F.col("pieces"))
    )
    angles = np.arccos(np.clip(centres @ centres.T, -1.0, 1.0))
    limit = math.acos(min(1.0, max(-1.0, threshold - 2 * THRESHOLD_TOLERANCE))) + _SLACK
    table = spark.createDataFrame(
        pa.table(
            {
                "x_centre": np.repeat(np.arange(len(centres)), len(centres)).astype(np.int32),
                "y_centre": np.tile(np.arange(len(centres)), len(centres)).astype(np.int32),
                "apart": angles.ravel(),
            }
        )
    )

    def side(which: int, name: str) -> DataFrame:
        some = parts.where(F.col("side") == which)
        return some.select(
            *scope,
            F.col("centre").alias(f"{name}_centre"),
            F.col("radius").alias(f"{name}_radius"),
            F.col("pieces").alias(f"{name}_pieces"),
            number.alias(f"{name}_number"),
        )

    pairs = side(0, "x").join(side(1 if two_sided else 0, "y"), scope)
    if not two_sided:
        pairs = pairs.where("x_centre <= y_centre")
    # Without an angle the pair stays: nothing is known about its distance.
    near = pairs.join(table, ["x_centre", "y_centre"], "left").where(
        F.col("apart").isNull() | (F.col("apart") - F.col("x_radius") - F.col("y_radius") <= limit)
    )
    one = F.lit(1).cast("long")
    cells = near.select(
        *scope,
        "y_number",
        "y_pieces",
        F.explode(F.sequence("x_number", F.col("x_number") + F.col("x_pieces") - one)).alias("x"),
    ).select(
        *scope, "x", F.explode(F.sequence("y_number", F.col("y_number") + F.col("y_pieces") - one)).alias("y")
    )
    return striped, cells if two_sided else cells.where("x <= y")
