"""Vectors for names: looked up, encoded by a model callable, or character 3-grams."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsheet.schemas import VECTOR_SCHEMA
from kinsheet.session import materialize

Encode = Callable[..., np.ndarray]
VectorProvider = Callable[[DataFrame], DataFrame]

GRAM_SIZE = 3
SMALL_SCOPE = 256  # names a single cell scores faster than any candidate search
_CODE_POINT_BITS = 21


def model_vectors(
    load_encoder: Callable[..., Encode],
    *,
    batch_size: int = 64,
    max_length: int = 64,
    device: str | None = None,
    use_fp16: bool | None = None,
    tasks: int | None = None,
) -> VectorProvider:
    """Provider that runs ``encode(texts, batch_size=, max_length=)`` over distinct names.

    ``load_encoder`` runs once per task, so a model is loaded next to the data it encodes;
    ``device`` and ``use_fp16`` are handed to it when given. Names are few bytes and much
    work, so they are spread over ``tasks`` tasks (by default the shuffle partitions),
    whatever their size. The result is materialised: encoding is the costliest step of a run
    and need not be repeatable. ``provider.options`` holds what a run stores.
    """
    if batch_size <= 0 or max_length <= 0:
        raise ValueError("batch_size and max_length must be positive")
    model = {k: v for k, v in {"device": device, "use_fp16": use_fp16}.items() if v is not None}

    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start in range(0, len(texts), batch_size):
                part = texts[start : start + batch_size]
                encode = encode or load_encoder(**model)
                matrix = np.asarray(
                    encode(part, batch_size=batch_size, max_length=max_length), dtype=np.float32
                )
                if matrix.ndim != 2 or len(matrix) != len(part):
                    raise ValueError(f"encoder returned {matrix.shape} for {len(part)} texts")
                offsets = np.arange(len(part) + 1, dtype=np.int32) * matrix.shape[1]
                vectors = pa.ListArray.from_arrays(offsets, matrix.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(part), vectors], ["norm_name", "vec"])

    def provide(names: DataFrame) -> DataFrame:
        spread = tasks or int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread_names = names.repartition(spread, "norm_name")
        return materialize(spread_names.mapInArrow(encode_batches, VECTOR_SCHEMA))

    provide.options = {"batch_size": batch_size, "max_length": max_length, **model}
    return provide


def vectors_for(names: DataFrame, vectors: DataFrame | VectorProvider) -> DataFrame:
    """Join a vector to every name row and check that each got exactly one usable vector."""
    if not isinstance(vectors, DataFrame):
        vectors = vectors(names.select(F.col("name").alias("norm_name")).distinct())
    table = vectors.select(F.col("norm_name").alias("name"), F.col("vec").alias("payload"))
    joined = materialize(names.join(table, "name", "left"))
    per_name = joined.groupBy("name", "level", "part", "side").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("payload").isNull()).alias("missing"),
        F.count_if(
            F.exists("payload", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        ).alias("not_finite"),
        F.min(F.size("payload")).alias("narrow"),
        F.max(F.size("payload")).alias("wide"),
    )
    found = per_name.agg(
        F.sum("missing").alias("missing"),
        F.sum("not_finite").alias("not_finite"),
        F.max("rows").alias("rows"),
        F.min("narrow").alias("narrow"),
        F.max("wide").alias("wide"),
    ).first()
    if found["missing"]:
        raise ValueError(f"{found['missing']} names have no vector")
    if found["not_finite"]:
        raise ValueError("vectors hold NaN or infinite values")
    if (found["rows"] or 1) > 1:
        raise ValueError("a name has more than one vector")
    if found["narrow"] != found["wide"]:
        raise ValueError(f"vector sizes differ: {found['narrow']} to {found['wide']}")
    return joined


def vector_norm_square(payload: Column) -> Column:
    squares = F.transform(payload, lambda x: x.cast("double") * x.cast("double"))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def grams(name: Column) -> Column:
    """All 3-grams of a name as exact longs: three code points of 21 bits each.

    A shorter name is one gram by itself.
    """
    codes = F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long"))

    def packed(values: Column, start: Column) -> Column:
        def code(i: int) -> Column:
            point = F.coalesce(F.get(values, start + i), F.lit(0).cast("long"))
            return F.shiftleft(point, _CODE_POINT_BITS * (GRAM_SIZE - 1 - i))

        return code(0) + code(1) + code(2)

    starts = F.sequence(F.lit(0), F.greatest(F.size(codes) - GRAM_SIZE, F.lit(0)))
    return F.transform(starts, lambda i: packed(codes, i.cast("int")))


def gram_prefix_rows(rows: DataFrame, threshold: float) -> DataFrame:
    """Copy each name to the rare grams that any similar name must share with it.

    Grams are ordered from rare to common. Where the weights from some gram onwards no
    longer reach the threshold, no pair can live on those grams alone; so the rarest
    gram two similar names share lies before that point in both. The copies are keyed
    by ``bucket``; pairs that meet in several buckets are merged after scoring. A scope
    of few names stays whole in bucket 0.
    """
    need = max(float(threshold) - 1e-6, 0.0)
    keys = ["level", "part", "side", "name"]
    sizes = rows.groupBy("level", "part").agg(F.count(F.lit(1)).alias("names_in_scope"))
    sized = rows.join(sizes, ["level", "part"])
    is_small = F.col("names_in_scope") <= SMALL_SCOPE
    small = sized.where(is_small).withColumn("bucket", F.lit(0).cast("long"))
    large = sized.where(~is_small)
    counted = (
        large.select(*keys, F.explode("payload").alias("gram"))
        .groupBy(*keys, "gram")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    spread = counted.groupBy("level", "gram").agg(F.count(F.lit(1)).alias("names"))
    from_here = (
        Window.partitionBy(*keys)
        .orderBy("names", "gram")
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    square = F.col("times").cast("double") * F.col("times")
    prefix = (
        counted.join(spread, ["level", "gram"])
        .select(
            *keys,
            F.col("gram").alias("bucket"),
            F.sum(square).over(from_here).alias("rest"),
            F.sum(square).over(Window.partitionBy(*keys)).alias("whole"),
        )
        .where(F.col("rest") >= F.lit(need * need) * F.col("whole"))
        .select(*keys, "bucket")
    )
    keyed = large.join(prefix, keys).unionByName(small)
    return keyed.drop("names_in_scope")


def pivot_rows(rows: DataFrame, threshold: float, pivots: Sequence[Sequence[float]]) -> DataFrame:
    """Copy each vector to the pivot cells in which a similar vector may have its home.

    A vector's home is its nearest pivot. A similar vector can only live across the
    plane between two pivots if that plane is within the threshold's angle, which is
    read off the two dot products. Of two homes the pair meets in the first one, so a
    vector visits only cells ahead of its home. Exact for unit vectors and a positive
    threshold.
    """
    centres = np.asarray(pivots, dtype=np.float64)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    gaps = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2)
    reach = float(np.sqrt(max(0.0, 1.0 - max(threshold - 1e-6, 0.0) ** 2))) + 1e-9

    @F.arrow_udf("array<long>")
    def cells(column: pa.Array) -> pa.Array:
        if len(column) == 0:
            return pa.array([], type=pa.list_(pa.int64()))
        matrix = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
        matrix = matrix.reshape(len(column), -1)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        dots = matrix @ centres.T
        home = dots.argmax(axis=1)
        near = dots.max(axis=1, keepdims=True) - dots <= reach * gaps[home]
        near &= np.arange(len(centres)) < home[:, None]
        near[np.arange(len(home)), home] = True
        rows_of, cell_of = np.nonzero(near)
        offsets = np.searchsorted(rows_of, np.arange(len(column) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(cell_of, type=pa.int64()))

    return rows.withColumn("bucket", F.explode(cells("payload")))
