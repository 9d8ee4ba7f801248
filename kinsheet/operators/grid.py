"""Blocked all-pairs cosine on distinct names.

Names of one scope are dealt into stripes of bounded size, and a pair of stripes is a cell
that one task scores with a matrix product: every pair of hashed stripes, or, for dense
vectors with centres, the pairs whose stripes are near enough (see ``metric``). Cells are keyed rows in one shuffle:
no join of names with names is ever planned, no pair below the threshold leaves a task,
and one hot scope is as many equal cells as its size asks for.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsheet.functions.scoring import NORM_FLOOR, THRESHOLD_TOLERANCE
from kinsheet.operators.metric import metric_stripes

BLOCK_ROWS = 2048
# A dense name is copied to a cell for each stripe that faces its own: stripes of a scope grow with it
# to keep their number, until they have _MOST_ROWS or _STRIPE_VALUES.
_STRIPES_WANTED = 16
_MOST_ROWS = 1 << 16
_STRIPE_VALUES = 1 << 23  # vector entries per stripe, whatever its row count
_PRODUCT_CELLS = 1 << 22  # scores held at a time, 32 MB of doubles
_PENDING_PAIRS = 1 << 21  # pairs a task gathers before it cuts them
_GRAM_COLUMNS = 1024
_SCORE_DIGITS = 12

SCOPE = ["level", "part", "bucket"]
# Positions are (major, minor) pairs: q = as left side of a pair, c = as right side.
# c_first is the place, in the order of ties, of a name's first object; c_last that of the object
# at its last position (the first of several).
STATS = ["q_lo1", "q_lo2", "q_hi1", "q_hi2", "c_hi1", "c_hi2", "n_q", "n_c", "c_first", "c_last"]
PAIR_SCHEMA = (
    "level string, part string, a_name string, b_name string, score double, "
    "n_q long, n_c long, c_first long, c_last long, alive boolean"
)


def score_names(
    rows: DataFrame,
    *,
    threshold: float,
    top_k: int,
    two_sided: bool,
    sparse: bool,
    block_rows: int = BLOCK_ROWS,
    centres: np.ndarray | None = None,
) -> DataFrame:
    """Score name rows ``(level, part, bucket, side, name, payload, *STATS)``.

    Emits both directions of every pair that reaches the threshold and for which some
    object of ``a_name`` may precede some object of ``b_name``. Within a cell, a name
    keeps only partners that can still matter for its ``top_k`` (see ``_cut``).
    ``two_sided`` pairs side 0 with side 1; otherwise side 0 is paired with itself.
    With ``centres`` only cells of stripes that are near enough for the threshold are made.
    """
    task = _cell_task(threshold, top_k, two_sided, sparse)
    if centres is not None and len(centres):
        keyed = _metric_cells(rows, two_sided, block_rows, threshold, centres)
        return keyed.mapInArrow(task, PAIR_SCHEMA)
    return _cells(rows, two_sided, block_rows, sparse).mapInArrow(task, PAIR_SCHEMA)


def _stripe_rows(count: str, block_rows: int) -> Column:
    """Rows of a dense stripe in a scope of ``count`` names."""
    grown = F.least(F.ceil(F.col(count) / _STRIPES_WANTED), F.lit(_MOST_ROWS))
    return F.greatest(F.lit(block_rows), grown)


def _cells(rows: DataFrame, two_sided: bool, block_rows: int, sparse: bool) -> DataFrame:
    def stripes(count: str, values: str) -> Column:
        size = F.lit(block_rows) if sparse else _stripe_rows(count, block_rows)
        by_rows = F.ceil(F.col(count) / size)
        by_values = F.ceil(F.col(values) / _STRIPE_VALUES)
        return F.greatest(by_rows, by_values).cast("int")

    width = F.size("payload").cast("long")
    sizes = rows.groupBy(*SCOPE).agg(
        *[F.count_if(F.col("side") == s).alias(f"n{s}") for s in (0, 1)],
        *[F.sum(F.when(F.col("side") == s, width)).alias(f"v{s}") for s in (0, 1)],
    )
    if two_sided:
        sizes = sizes.where((F.col("n0") > 0) & (F.col("n1") > 0))
    else:
        sizes = sizes.where(F.col("n0") > 1)
    sizes = sizes.select(*SCOPE, stripes("n0", "v0").alias("g0"), stripes("n1", "v1").alias("g1"))
    left = F.col("side") == 0
    if two_sided:
        own = F.when(left, F.col("g0")).otherwise(F.col("g1"))
        other = F.when(left, F.col("g1")).otherwise(F.col("g0"))
    else:
        own = other = F.col("g0")
    striped = rows.join(sizes, SCOPE).withColumn(
        "stripe", F.pmod(F.xxhash64("name"), own.cast("long")).cast("int")
    )
    blocks = striped.groupBy(*SCOPE, "side", "stripe", other.alias("facing")).agg(
        F.collect_list(F.struct("name", "payload", *STATS)).alias("items")
    )

    def cell(y: Column) -> Column:
        if two_sided:
            return F.struct(
                F.when(left, F.col("stripe")).otherwise(y).alias("x"),
                F.when(left, y).otherwise(F.col("stripe")).alias("y"),
                F.col("side").alias("role"),
            )
        return F.struct(
            F.least(F.col("stripe"), y).alias("x"),
            F.greatest(F.col("stripe"), y).alias("y"),
            (F.col("stripe") > y).cast("int").alias("role"),
        )

    facing = F.transform(F.sequence(F.lit(0), F.col("facing") - 1), cell)
    return _keyed(blocks.withColumn("cells", facing))


def _metric_cells(
    rows: DataFrame, two_sided: bool, block_rows: int, threshold: float, centres: np.ndarray
) -> DataFrame:
    striped, cells = metric_stripes(
        rows,
        centres,
        scope=SCOPE,
        threshold=threshold,
        two_sided=two_sided,
        block_rows=block_rows,
        stripe_rows=_stripe_rows("n", block_rows),
        stripe_values=_STRIPE_VALUES,
    )
    blocks = striped.groupBy(*SCOPE, "side", "stripe").agg(
        F.collect_list(F.struct("name", "payload", *STATS)).alias("items")
    )
    # A stripe's cells: as the first of a pair, and as the second of another stripe's.
    first = F.struct("x", "y", F.lit(0).alias("role"))
    second = F.struct("x", "y", F.lit(1).alias("role"))
    one_sided = F.lit(0)
    as_first = cells.select(*SCOPE, one_sided.alias("side"), F.col("x").alias("stripe"), first.alias("cell"))
    as_second = cells if two_sided else cells.where("x < y")
    as_second = as_second.select(
        *SCOPE,
        F.lit(1 if two_sided else 0).alias("side"),
        F.col("y").alias("stripe"),
        second.alias("cell"),
    )
    facing = as_first.union(as_second).groupBy(*SCOPE, "side", "stripe")
    facing = facing.agg(F.collect_list("cell").alias("cells"))
    return _keyed(blocks.join(facing, [*SCOPE, "side", "stripe"]))


def _keyed(blocks: DataFrame) -> DataFrame:
    """A row for each cell that a stripe is in, both rows of a cell next to each other."""
    keyed = blocks.select(
        *SCOPE,
        F.explode("cells").alias("cell"),
        F.transform("items", lambda i: i["name"]).alias("names"),
        F.transform("items", lambda i: F.size(i["payload"])).alias("sizes"),
        F.flatten(F.transform("items", lambda i: i["payload"])).alias("values"),
        F.flatten(
            F.transform("items", lambda i: F.array(*[i[s] for s in STATS]))
        ).alias("stats"),
    )
    at = [*SCOPE, "x", "y"]
    return (
        keyed.select(*SCOPE, "cell.*", "names", "sizes", "values", "stats")
        .repartition(*at)
        .sortWithinPartitions(*at, "role")
    )


class _Block:
    """One stripe as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int, sparse: bool) -> None:
        def values(name: str) -> pa.Array:
            return batch.column(name)[i].values

        self.names = values("names")
        stats = values("stats").to_numpy(zero_copy_only=False).reshape(-1, len(STATS))
        self.stats = dict(zip(STATS, stats.T))
        sizes = values("sizes").to_numpy(zero_copy_only=False)
        raw = values("values").to_numpy(zero_copy_only=False)
        if sparse:
            self.load_grams(raw, sizes)
        else:
            matrix = raw.astype(np.float64).reshape(len(sizes), -1)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            self.matrix = matrix / np.maximum(norms, NORM_FLOOR)

    def load_grams(self, raw: np.ndarray, sizes: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((raw, owner))
        owner, raw = owner[order], raw[order]
        first = np.ones(len(raw), dtype=bool)
        first[1:] = (owner[1:] != owner[:-1]) | (raw[1:] != raw[:-1])
        starts = np.flatnonzero(first)
        self.gram_owner, self.gram = owner[starts], raw[starts]
        self.gram_count = np.diff(np.append(starts, len(raw))).astype(np.float64)
        self.square = np.bincount(
            self.gram_owner, weights=self.gram_count**2, minlength=len(sizes)
        )

    def __len__(self) -> int:
        return len(self.names)


def _gram_scores(a: _Block, b: _Block) -> np.ndarray:
    """Cosine of count vectors over the grams both stripes have, a few columns at a time."""
    shared = np.intersect1d(a.gram, b.gram)
    dots = np.zeros((len(a), len(b)))

    def placed(block: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Entries of shared grams in the order of these, found once."""
        place = np.searchsorted(shared, block.gram)
        entry = np.flatnonzero(place < len(shared))
        entry = entry[shared[place[entry]] == block.gram[entry]]
        entry = entry[np.argsort(place[entry], kind="stable")]
        return entry, place[entry]

    def columns(block: _Block, entry, place, low: int, high: int) -> np.ndarray:
        run = slice(*np.searchsorted(place, [low, high]))
        dense = np.zeros((len(block), high - low))
        entry = entry[run]
        dense[block.gram_owner[entry], place[run] - low] = block.gram_count[entry]
        return dense

    at_a, at_b = placed(a), placed(b)
    for low in range(0, len(shared), _GRAM_COLUMNS):
        high = min(low + _GRAM_COLUMNS, len(shared))
        dots += columns(a, *at_a, low, high) @ columns(b, *at_b, low, high).T
    return dots / np.maximum(np.sqrt(np.outer(a.square, b.square)), NORM_FLOOR)


def _before(lo1, lo2, hi1, hi2) -> np.ndarray:
    return (lo1 < hi1) | ((lo1 == hi1) & (lo2 < hi2))


def _cut(left, score, alive, first, last, top_k: int) -> np.ndarray:
    """Indices of pairs that can still reach some object's top-k.

    An ``alive`` partner has an object after the last object of the left name, so it gives
    every left object that one match at least. It comes before all objects of another partner
    if it scores higher, or the same with its last object (``last``) ahead of the other's
    first one (``first``) in the order of ties. Once ``top_k`` of them come before a pair, the
    pair is out: equal scores leave no more than higher ones do.
    """
    count = len(left)
    lives = np.flatnonzero(alive)
    owner = np.concatenate([np.arange(count), lives])
    place = np.concatenate([first, last[lives]])
    is_alive = np.repeat([0, 1], [count, len(lives)])
    # A pair is looked at ahead of its own object of the same place.
    order = np.lexsort((is_alive, place, -score[owner], left[owner]))
    new_left = np.ones(len(order), dtype=bool)
    new_left[1:] = left[owner[order[1:]]] != left[owner[order[:-1]]]
    before = np.cumsum(is_alive[order]) - is_alive[order]
    start = np.maximum.accumulate(np.where(new_left, np.arange(len(order)), 0))
    ahead = before - before[start]
    return order[(ahead < top_k) & (is_alive[order] == 0)]


def _useful_pairs(a, b, ia, ib, score, top_k) -> tuple[np.ndarray, ...]:
    """The pairs that may go from ``a`` to ``b``, cut to those that can matter, and whether alive."""
    q, c = a.stats, b.stats
    possible = _before(q["q_lo1"][ia], q["q_lo2"][ia], c["c_hi1"][ib], c["c_hi2"][ib])
    ia, ib, score = ia[possible], ib[possible], score[possible]
    alive = _before(q["q_hi1"][ia], q["q_hi2"][ia], c["c_hi1"][ib], c["c_hi2"][ib])
    keep = _cut(ia, score, alive, c["c_first"][ib], c["c_last"][ib], top_k)
    return ia[keep], ib[keep], score[keep], alive[keep]


class _Gathered:
    """Pairs from ``a`` to ``b`` that come in pieces: cut together, however many pieces there are."""

    def __init__(self, a: _Block, b: _Block, top_k: int) -> None:
        self.a, self.b, self.top_k = a, b, top_k
        self.pieces, self.held, self.limit = [], 0, _PENDING_PAIRS

    def add(self, ia: np.ndarray, ib: np.ndarray, score: np.ndarray) -> None:
        self.pieces.append((ia, ib, score))
        self.held += len(ia)
        if self.held > self.limit:
            self.pieces = [self.cut()[:3]]
            self.held = len(self.pieces[0][0])
            self.limit = max(_PENDING_PAIRS, 2 * self.held)

    def cut(self) -> tuple[np.ndarray, ...]:
        ia, ib, score = (np.concatenate(column) for column in zip(*self.pieces))
        return _useful_pairs(self.a, self.b, ia, ib, score, self.top_k)

    def table(self) -> pa.Table | None:
        ia, ib, score, alive = self.cut()
        if not len(ia):
            return None
        q, c = self.a.stats, self.b.stats
        return pa.table(
            {
                "a_name": self.a.names.take(pa.array(ia)),
                "b_name": self.b.names.take(pa.array(ib)),
                "score": score,
                "n_q": q["n_q"][ia],
                "n_c": c["n_c"][ib],
                "c_first": c["c_first"][ib],
                "c_last": c["c_last"][ib],
                "alive": alive,
            }
        )


def _cell_task(
    threshold: float, top_k: int, two_sided: bool, sparse: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score_cell(a: _Block, b: _Block) -> Iterator[pa.Table]:
        whole = _gram_scores(a, b) if sparse else None
        step = max(1, _PRODUCT_CELLS // max(len(b), 1))
        forth, back = _Gathered(a, b, top_k), _Gathered(b, a, top_k)
        for start in range(0, len(a), step):
            stop = min(start + step, len(a))
            low = start if a is b else 0  # of a stripe with itself, only the later names
            scores = whole[start:stop, low:] if sparse else a.matrix[start:stop] @ b.matrix[low:].T
            # Rounding moves a score by far less than the tolerance: few scores are rounded.
            ia, ib = np.nonzero(scores >= threshold - 2 * THRESHOLD_TOLERANCE)
            score = np.round(np.clip(scores[ia, ib], -1.0, 1.0), _SCORE_DIGITS)
            ia, ib = ia + start, ib + low
            hit = score + THRESHOLD_TOLERANCE >= threshold
            if a is b:
                hit &= ia < ib
            ia, ib, score = ia[hit], ib[hit], score[hit]
            forth.add(ia, ib, score)
            back.add(ib, ia, score)
        yield forth.table()
        yield back.table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in [*SCOPE, "x", "y"]]))
            roles = batch.column("role").to_pylist()
            for i, key in enumerate(keys):
                block = _Block(batch, i, sparse)
                if roles[i] == 0:
                    held_key, held = key, block
                diagonal = not two_sided and key[-1] == key[-2]
                if not diagonal and (roles[i] == 0 or held_key != key):
                    continue
                for table in score_cell(held, block):
                    if table is None:
                        continue
                    table = table.add_column(0, "level", pa.repeat(key[0], len(table)))
                    table = table.add_column(1, "part", pa.repeat(key[1], len(table)))
                    yield from table.combine_chunks().to_batches()

    return run
