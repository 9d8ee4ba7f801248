"""Dense 1..n numbering in a global order without a single-task window."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsheet.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above, the row below


def with_sequence(
    df: DataFrame, name: str, *order: Column | str, drop: Sequence[str] = ()
) -> DataFrame:
    """Number the rows of ``df`` by ``order``: a range sort, then an offset per partition.

    Rows are stored once together with their place in the sort, so counting and numbering
    see the same partitions even when tasks are retried. The offsets table has one row per
    partition of the sort, which bounds both its window and its broadcast. Columns to ``drop``
    are sorted by, but not stored.
    """
    placed = df.orderBy(*order).withColumn("_position", F.monotonically_increasing_id())
    placed = placed.drop(*drop)
    tagged = materialize(placed).withColumn("_slice", F.shiftright("_position", _ROW_BITS))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    in_slice = F.col("_position").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        tagged.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_offset") + in_slice + 1)
        .drop("_slice", "_position", "_offset")
    )
