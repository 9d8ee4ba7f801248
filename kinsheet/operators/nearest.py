"""Best k candidates that come later in position, for every query of a key.

Rows of a key are read from the last position to the first with k candidates held, so a
key of any size needs constant memory and one pass, and no query meets every candidate.
Keys too large for one task are cut into position ranges: the best k of each range are
combined from the back and handed to the earlier ranges as extra candidates.
"""

from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["level", "part", "a_name", "range1", "range2"]
_AFTER_ALL = (1 << 63) - 1

FOUND_SCHEMA = (
    "level string, part string, a_name string, a_group string, a_object string, "
    "rank int, score double, b_group string, b_object string, b_name string"
)
_ROW_COLUMNS = [*KEY, "p1", "p2", "kind", "score", "group_id", "object_id", "b_name"]
_READ_COLUMNS = ["kind", "score", "group_id", "object_id", "b_name"]
_QUERY_COLUMNS = ["level", "part", "a_name", "group_id", "object_id"]
_FOUND_COLUMNS = [field.split()[0] for field in FOUND_SCHEMA.split(", ")]


def best_for_one(candidates: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """The same as ``best_later`` for keys with one query each: a join and a ranked window."""
    key = ["level", "part", "a_name"]
    asked = queries.select(
        *key,
        F.col("group_id").alias("a_group"),
        F.col("object_id").alias("a_object"),
        F.struct("p1", "p2").alias("asked_at"),
    )
    best_first = Window.partitionBy(*key).orderBy(F.desc("score"), "group_id", "object_id")
    later = candidates.join(asked, key).where(F.struct("p1", "p2") > F.col("asked_at"))
    ranked = later.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top_k)
    return ranked.select(
        *key,
        "a_group",
        "a_object",
        "rank",
        "score",
        F.col("group_id").alias("b_group"),
        F.col("object_id").alias("b_object"),
        "b_name",
    )


def best_later(
    candidates: DataFrame, queries: DataFrame, top_k: int, range_bits: int, has_hot: bool
) -> DataFrame:
    """Top ``top_k`` of the candidates strictly after each query, per ``(level, part, a_name)``.

    ``candidates``: key, p1, p2, score, group_id, object_id, b_name, hot.
    ``queries``: key, p1, p2, group_id, object_id, hot; the last two name the query.
    Keys flagged ``hot`` are cut into ranges of ``2**range_bits`` minor positions.
    """
    candidates, queries = (_ranged(df, range_bits) for df in (candidates, queries))
    scanned = candidates
    if has_hot:
        scanned = candidates.unionByName(_carried(candidates, queries, top_k))
    return _scan(scanned, queries, top_k)


def _ranged(df: DataFrame, range_bits: int) -> DataFrame:
    return df.withColumn(
        "range1", F.when(F.col("hot"), F.col("p1")).otherwise(F.lit(0).cast("long"))
    ).withColumn(
        "range2",
        F.when(F.col("hot"), F.shiftright("p2", range_bits)).otherwise(F.lit(0).cast("long")),
    )


def _carried(candidates: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """For each range of a hot key, the best candidates of all later ranges."""
    best_first = Window.partitionBy(*KEY).orderBy(F.desc("score"), "group_id", "object_id")
    leaders = (
        candidates.where("hot")
        .withColumn("place", F.row_number().over(best_first))
        .where(F.col("place") <= top_k)
        .drop("place")
    )
    zero = F.lit(0).cast("long")

    def whole_key(df: DataFrame) -> DataFrame:
        moved = df.withColumn("p1", F.col("range1")).withColumn("p2", F.col("range2"))
        return moved.withColumn("range1", zero).withColumn("range2", zero)

    ranges = queries.where("hot").select(*KEY, "hot").distinct()
    asked = whole_key(
        ranges.withColumn("group_id", F.col("range1").cast("string")).withColumn(
            "object_id", F.col("range2").cast("string")
        )
    )
    later = _scan(whole_key(leaders), asked, top_k)
    return later.select(
        "level",
        "part",
        "a_name",
        F.col("a_group").cast("long").alias("range1"),
        F.col("a_object").cast("long").alias("range2"),
        F.lit(_AFTER_ALL).alias("p1"),
        F.lit(_AFTER_ALL).alias("p2"),
        "score",
        F.col("b_group").alias("group_id"),
        F.col("b_object").alias("object_id"),
        "b_name",
        F.lit(True).alias("hot"),
    )


def _scan(candidates: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    rows = candidates.withColumn("kind", F.lit(1)).select(*_ROW_COLUMNS)
    asked = (
        queries.withColumn("kind", F.lit(0))
        .withColumn("score", F.lit(None).cast("double"))
        .withColumn("b_name", F.lit(None).cast("string"))
        .select(*_ROW_COLUMNS)
    )
    # At equal positions queries come first, so they never see candidates of their own position.
    ordered = (
        rows.unionByName(asked)
        .repartition(*KEY)
        .sortWithinPartitions(*KEY, F.desc("p1"), F.desc("p2"), "kind")
    )
    return ordered.mapInArrow(_reader(top_k), FOUND_SCHEMA)


def _reader(top_k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, best, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            first_key = [batch.column(c)[0].as_py() for c in KEY]
            starts = _key_starts(batch)
            starts[0] = first_key != last_key
            last_key = [batch.column(c)[batch.num_rows - 1].as_py() for c in KEY]
            asked, sizes = [], []
            scores, groups, ids, names = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in _READ_COLUMNS]
            for i, (start, kind, score, group, object_id, name) in enumerate(zip(starts, *columns)):
                if start:
                    best, held = [], None
                if kind == 0:
                    if not best:
                        continue
                    if held is None:  # unpacked once per change of the best, not per query
                        minus, *rest = zip(*best)
                        held = ([-m for m in minus], *rest)
                    asked.append(i)
                    sizes.append(len(best))
                    scores.extend(held[0])
                    groups.extend(held[1])
                    ids.extend(held[2])
                    names.extend(held[3])
                    continue
                entry = (-score, group, object_id, name)
                if len(best) == top_k:
                    if entry > best[-1]:
                        continue
                    best.pop()
                insort(best, entry)
                held = None
            if not asked:
                continue
            sizes = np.array(sizes)
            query = pa.array(np.repeat(asked, sizes))
            ends = np.cumsum(sizes)
            ranks = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(query) for c in _QUERY_COLUMNS],
                    pa.array(ranks, type=pa.int32()),
                    pa.array(scores, type=pa.float64()),
                    *[pa.array(c, type=pa.string()) for c in (groups, ids, names)],
                ],
                _FOUND_COLUMNS,
            )

    return read


def _key_starts(batch: pa.RecordBatch) -> list[bool]:
    starts = np.zeros(batch.num_rows, dtype=bool)
    for c in KEY:
        column = batch.column(c)
        changed = pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1))
        starts[1:] |= changed.to_numpy(zero_copy_only=False)
    return starts.tolist()
