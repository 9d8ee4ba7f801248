"""Near-duplicate search: objects and vectors in, ranked and labelled pairs out."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsheet.functions.scoring import (
    NORM_FLOOR,
    THRESHOLD_TOLERANCE,
    band,
    reaches,
)
from kinsheet.operators.grid import BLOCK_ROWS, STATS, score_names
from kinsheet.operators.metric import sample_centres
from kinsheet.operators.nearest import best_for_one, best_later
from kinsheet.operators.objects import (
    extract_objects,
    group_order,
    level_order,
    object_name,
    with_norm_name,
)
from kinsheet.operators.scope import Scope, make_scope, parse_levels, require_groups
from kinsheet.operators.sequence import with_sequence
from kinsheet.operators.vectors import (
    VectorProvider,
    gram_prefix_rows,
    grams,
    pivot_rows,
    vector_norm_square,
    vectors_for,
)
from kinsheet.schemas import LABEL_UNMATCHED, LEVELS, RECORD_COLUMNS
from kinsheet.session import kept_table, kept_tables, materialize, passing_tables

GRAMS = "grams"
NAME_KEY = ["level", "part", "name"]
RANGE_BITS = 20  # a key with more rows than 2**RANGE_BITS is scanned in ranges that long
_CENTRES_A_STRIPE = 2  # sampled centres for each stripe that the objects would fill
_MOST_CENTRES = 32  # a name is copied to a cell for each centre: a number that must not follow the names
_NEVER = -(1 << 62)
_LATE = 1 << 62


def find_similar(
    objects: DataFrame,
    vectors: DataFrame | VectorProvider | str = GRAMS,
    *,
    mode: str = "within",
    threshold: float = 0.85,
    top_k: int = 10,
    levels: Sequence[str] = LEVELS,
    include_unmatched: bool = False,
    drop_module_suffix: bool = False,
    anchor_group: str | None = None,
    target_groups: Sequence[str] | None = None,
    block_rows: int = BLOCK_ROWS,
    range_bits: int = RANGE_BITS,
    pivots: int = 0,
    require_known_groups: bool = False,
    numbered: bool = False,
) -> DataFrame:
    """Ranked similar pairs ``(level, rank, score, label, a, b)`` of one level each.

    ``vectors`` is a table ``(norm_name, vec)``, a provider that makes one from distinct
    names, or ``"grams"`` for character 3-gram counts. Scores are computed once per pair of
    distinct names and expanded to objects with only ``top_k`` matches per object.
    Dense names that fill more than one stripe of ``block_rows`` are dealt by their nearest
    centre, and stripes too far apart for a positive ``threshold`` never meet; ``pivots`` > 0
    copies names to pivot cells instead. Both are exact.
    ``numbered`` adds ``number``, 1..n in result order, found before the paths are joined;
    it needs objects with keys of their own, as ``extract_objects`` makes them.
    """
    scope = make_scope(mode, anchor_group, target_groups)
    levels = parse_levels(levels)
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must lie in [0, 1]")
    if top_k <= 0 or block_rows <= 0:
        raise ValueError("top_k and block_rows must be positive")
    if require_known_groups:
        require_groups(scope, objects)

    chosen = objects.where(F.col("level").isin(levels))
    if scope.directed:
        chosen = chosen.where(F.col("group_id").isin(scope.anchor, *scope.targets))
    # Stored in the order in which ties are taken; a row's place in it is one long. Names are
    # normalised behind the sort, which reads the rows before it twice.
    if numbered:  # paths are found by key later on, and stay out of the search
        chosen = chosen.select("level", "group_id", "object_id", "obj_seq", object_name().alias("name"))
    in_order = chosen.orderBy("group_id", "object_id")
    in_order = in_order.withColumn("place", F.monotonically_increasing_id())
    named = with_norm_name(in_order, drop_module_suffix, F.col("name") if numbered else None)
    chosen = materialize(named.drop("name"))
    if not chosen.where(F.col("norm_name") == "").isEmpty():
        raise ValueError("a name is empty after normalisation")

    placed = _placed(chosen, scope)
    # Stored while narrow: sorting, counting and writing the results all start from here.
    with passing_tables(objects.sparkSession):
        pairs = materialize(
            _name_pairs(placed, scope, vectors, threshold, top_k, block_rows, pivots)
        )
        hits = _hits(placed, pairs, scope, top_k, range_bits)
        if numbered:
            narrow = _narrow_results(chosen, materialize(hits), scope, include_unmatched)
            with kept_tables():
                in_order = with_sequence(narrow, "number", *_narrow_order())
        else:
            hits = kept_table(hits)
    if numbered:
        return _with_paths(in_order, objects, include_unmatched)
    return _described(chosen, hits, scope, include_unmatched)


def similarity_job(
    records: DataFrame,
    vectors: DataFrame | VectorProvider | str = GRAMS,
    *,
    mode: str = "within",
    anchor_group: str | None = None,
    target_groups: Sequence[str] | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Records to ``(results, objects)``: extraction, scope checks and search."""
    require_groups(make_scope(mode, anchor_group, target_groups), records)
    objects = extract_objects(records)
    results = find_similar(
        objects,
        vectors,
        mode=mode,
        anchor_group=anchor_group,
        target_groups=target_groups,
        **options,
    )
    return results, objects


# --- positions -------------------------------------------------------------------------


def _placed(objects: DataFrame, scope: Scope) -> DataFrame:
    """Objects with ``part``, the scope they stay in, and position ``(p1, p2)``.

    A pair goes from the earlier to the strictly later position: row order inside a
    group, group order across groups, anchor before targets.
    """
    zero, none = F.lit(0).cast("long"), F.lit("")
    base = objects.select(
        "level", "group_id", "object_id", "obj_seq", "place", F.col("norm_name").alias("name")
    )
    if scope.mode == "within":
        part = F.col("group_id")
        return base.select("*", part.alias("part"), zero.alias("p1"), F.col("obj_seq").alias("p2"))
    if scope.directed:
        p1 = (F.col("group_id") != scope.anchor).cast("long")
        return base.select("*", none.alias("part"), p1.alias("p1"), zero.alias("p2"))
    ordered = base.join(group_order(objects), ["level", "group_id"])
    group_pos = F.col("group_pos")
    p1, p2 = (zero, group_pos) if scope.mode == "cross" else (group_pos, F.col("obj_seq"))
    return ordered.select(*base.columns, none.alias("part"), p1.alias("p1"), p2.alias("p2"))


def _name_rows(placed: DataFrame, scope: Scope) -> DataFrame:
    """Distinct names per scope with the position range of their objects."""
    if scope.directed:
        side = F.col("p1").cast("int")
        left = F.col("side") == 0
        zero = F.lit(0).cast("long")
        rows = placed.groupBy(*NAME_KEY, side.alias("side")).agg(
            F.count(F.lit(1)).alias("n"), F.min("place").alias("c_first")
        )
        asks = F.when(left, zero).otherwise(F.lit(_LATE))
        answers = F.when(left, F.lit(_NEVER)).otherwise(F.lit(1).cast("long"))
        return rows.select(
            *NAME_KEY,
            "side",
            asks.alias("q_lo1"),
            zero.alias("q_lo2"),
            asks.alias("q_hi1"),
            zero.alias("q_hi2"),
            answers.alias("c_hi1"),
            zero.alias("c_hi2"),
            F.col("n").alias("n_q"),
            F.col("n").alias("n_c"),
            "c_first",
            F.col("c_first").alias("c_last"),  # all targets share one position
        )
    ties = [
        F.min("place").alias("c_first"),
        (-F.max(F.struct("p1", "p2", (-F.col("place")).alias("minus")))["minus"]).alias("c_last"),
    ]
    grouped = placed.groupBy(*NAME_KEY)
    if scope.mode == "all":
        both = F.struct("p1", "p2")
        rows = grouped.agg(
            F.min(both).alias("lo"), F.max(both).alias("hi"), F.count(F.lit(1)).alias("n"), *ties
        ).select(
            *NAME_KEY,
            F.col("lo.p1").alias("lo1"),
            F.col("lo.p2").alias("lo2"),
            F.col("hi.p1").alias("hi1"),
            F.col("hi.p2").alias("hi2"),
            "n",
            "c_first",
            "c_last",
        )
    else:  # one of the two position parts is constant
        rows = grouped.agg(
            F.min("p1").alias("lo1"),
            F.min("p2").alias("lo2"),
            F.max("p1").alias("hi1"),
            F.max("p2").alias("hi2"),
            F.count(F.lit(1)).alias("n"),
            *ties,
        )
    bounds = ["lo1", "lo2", "hi1", "hi2", "hi1", "hi2", "n", "n", "c_first", "c_last"]
    return rows.select(
        *NAME_KEY, F.lit(0).alias("side"), *[F.col(b).alias(s) for b, s in zip(bounds, STATS)]
    )


# --- name pairs ------------------------------------------------------------------------


def _name_pairs(placed, scope, vectors, threshold, top_k, block_rows, pivots) -> DataFrame:
    """Pairs of names at or above the threshold, cut to what any object can use.

    Columns: level, part, a_name, b_name, score, load (rows the left name has to read).
    """
    names = _name_rows(placed, scope)
    sparse = isinstance(vectors, str)
    if sparse:
        if vectors != GRAMS:
            raise ValueError(f"unknown vectors: {vectors}")
        rows = names.withColumn("payload", grams(F.col("name")))
        self_score = F.lit(1.0)
    else:
        rows = vectors_for(names, vectors)
        norm = F.sqrt(vector_norm_square(F.col("payload")))
        ratio = norm / F.greatest(norm, F.lit(NORM_FLOOR))
        self_score = F.least(F.lit(1.0), ratio * ratio)
    prunable = threshold > 10 * THRESHOLD_TOLERANCE
    merge = False
    if sparse and prunable:
        keyed, merge = gram_prefix_rows(materialize(rows), threshold), True
    elif not sparse and pivots > 0 and prunable:
        centres = rows.select("name", "payload").orderBy(F.xxhash64("name"), "name")
        centres = [r["payload"] for r in centres.limit(pivots).collect()]
        keyed, merge = (pivot_rows(rows, threshold, centres), True) if centres else (rows, False)
    else:
        keyed = rows
    centres = None
    if not sparse and not merge and prunable:
        objects = placed.count()
        # Fewer objects than a stripe holds names: one stripe a scope, nothing to leave out.
        if objects > block_rows:
            wanted = _CENTRES_A_STRIPE * -(-objects // block_rows)
            centres = sample_centres(rows, min(wanted, _MOST_CENTRES))
    if "bucket" not in keyed.columns:
        keyed = keyed.withColumn("bucket", F.lit(0).cast("long"))
    scored = score_names(
        keyed,
        threshold=threshold,
        top_k=top_k,
        two_sided=scope.directed,
        sparse=sparse,
        block_rows=block_rows,
        centres=centres,
    )
    if not scope.directed:  # with two sides, equal names already meet as left and right
        scored = scored.unionByName(_self_pairs(rows, self_score, threshold))
    return _useful(scored, top_k, merge)


def _later(lo1: str, lo2: str, hi1: str, hi2: str) -> Column:
    a1, a2, b1, b2 = F.col(lo1), F.col(lo2), F.col(hi1), F.col(hi2)
    return (a1 < b1) | ((a1 == b1) & (a2 < b2))


def _self_pairs(rows: DataFrame, score: Column, threshold: float) -> DataFrame:
    """A name paired with itself, where it has objects at two positions."""
    twice = rows.where(_later("q_lo1", "q_lo2", "c_hi1", "c_hi2"))
    return twice.select(
        "level",
        "part",
        F.col("name").alias("a_name"),
        F.col("name").alias("b_name"),
        score.alias("score"),
        "n_q",
        "n_c",
        "c_first",
        "c_last",
        F.lit(False).alias("alive"),  # nothing of a name comes after its own last object
    ).where(reaches(F.col("score"), threshold))


def _useful(pairs: DataFrame, top_k: int, merge: bool) -> DataFrame:
    """Apply the cell cut once more across cells, and size up each left name."""
    left = ["level", "part", "a_name"]
    pairs = pairs.repartition(*left)
    if merge:
        same = ["score", "n_q", "n_c", "c_first", "c_last"]
        pairs = pairs.groupBy(*left, "b_name").agg(
            *[F.max(c).alias(c) for c in same], F.bool_or("alive").alias("alive")
        )
    # Two events a pair: its first object, and the object it is sure to give if it is alive.
    events = F.array(
        F.struct(F.col("c_first").alias("at"), F.lit(0).alias("gives")),
        F.when(F.col("alive"), F.struct(F.col("c_last").alias("at"), F.lit(1).alias("gives"))),
    )
    events = F.filter(events, lambda e: e.isNotNull())
    ahead = (
        Window.partitionBy(*left)
        .orderBy(F.desc("score"), "event.at", "event.gives")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cut = (
        pairs.withColumn("event", F.explode(events))
        .withColumn("ahead", F.coalesce(F.sum("event.gives").over(ahead), F.lit(0)))
        .where((F.col("event.gives") == 0) & (F.col("ahead") < top_k))
    )
    load = F.sum("n_c").over(Window.partitionBy(*left)) + F.col("n_q")
    return cut.select(*left, "b_name", "score", "n_q", load.alias("load"))


# --- objects ---------------------------------------------------------------------------


def _hits(placed, pairs, scope, top_k, range_bits) -> DataFrame:
    """Expand name pairs to the best ``top_k`` objects for every query.

    A name with one object asks once: its candidates are a plain join, cut by a ranked
    window. Only names with several objects are scanned, so that no query meets every
    candidate.
    """
    single = F.col("n_q") == 1
    hot = ~single & (F.col("load") > F.lit(1 << range_bits))
    pairs = pairs.select(
        "level", "part", "a_name", "b_name", "score", single.alias("single"), hot.alias("hot")
    )
    has_hot = not pairs.where("hot").isEmpty()
    by_object = ["group_id", "object_id"]
    if scope.directed:
        b_side = placed.where(F.col("p1") == 1)
        a_side = placed.where(F.col("p1") == 0)
        answering, query = _first_objects(b_side, NAME_KEY, top_k), []
    elif scope.mode == "cross":
        a_side, query = placed, ["group_id"]
        answering = _first_objects(placed, [*NAME_KEY, "group_id"], top_k)
    else:
        a_side, query, answering = placed, by_object, placed
    candidates = (
        pairs.withColumnRenamed("b_name", "name")
        .join(answering.select(*NAME_KEY, *by_object, "p1", "p2"), NAME_KEY)
        .withColumnRenamed("name", "b_name")
    )
    asking = a_side.select(
        *NAME_KEY,
        *[F.col(c) if c in query else F.lit("").alias(c) for c in by_object],
        "p1",
        "p2",
    )
    if query != by_object:
        asking = asking.distinct()
    queried = pairs.select("level", "part", F.col("a_name").alias("name"), "single", "hot")
    queries = asking.join(queried.distinct(), NAME_KEY).withColumnRenamed("name", "a_name")
    by_join = best_for_one(candidates.where("single"), queries.where("single"), top_k)
    several = candidates.where("NOT single").drop("single"), queries.where("NOT single").drop("single")
    return by_join.union(best_later(*several, top_k, range_bits, has_hot))


def _first_objects(placed: DataFrame, key: list[str], top_k: int) -> DataFrame:
    """Where all objects of ``key`` are open to the same queries, only the first k can be used."""
    order = Window.partitionBy(*key).orderBy("group_id", "object_id")
    return placed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)


# Joins sort by these columns in this order: rows of one group and software stay together, and small.
_A_KEY = ["level", "a_group", "a_object"]
_B_KEY = ["level", "b_group", "b_object"]


def _side(objects: DataFrame, side: str, *more: Column | str) -> DataFrame:
    """Objects as side ``a`` or ``b`` of a result."""
    key = {"group_id": f"{side}_group", "object_id": f"{side}_object"}
    return objects.select("level", *[F.col(c).alias(k) for c, k in key.items()], *more)


def _asking(objects: DataFrame, scope: Scope) -> DataFrame:
    return objects.where(F.col("group_id") == scope.anchor) if scope.directed else objects


def _hit_key(scope: Scope) -> list[str]:
    """What a hit knows of the object it starts from."""
    if scope.directed:
        return ["level", "a_name"]
    if scope.mode == "cross":
        return ["level", "a_name", "a_group"]
    return _A_KEY


def _result_columns(name_of_a: str) -> list[Column]:
    unmatched = F.col("score").isNull()
    label = F.when(unmatched, LABEL_UNMATCHED).otherwise(
        band(F.col(name_of_a), F.col("b_name"), F.col("score"))
    )
    rank = F.coalesce("rank", F.lit(0)).alias("rank")
    return [F.col("level"), rank, F.col("score"), label.alias("label"), F.col("a"), F.col("b")]


def _narrow_results(objects, hits, scope, include_unmatched) -> DataFrame:
    """Results without their paths: a row for each hit of an object, or for an object without one."""
    key, found = _hit_key(scope), ["rank", "score", "b_group", "b_object", "b_name"]
    if key == _A_KEY and not include_unmatched:
        return hits.select(*_A_KEY, "a_name", *found)
    a_side = _side(_asking(objects, scope), "a", F.col("norm_name").alias("a_name"))
    narrow = a_side.join(hits.select(*key, *found), key, "left" if include_unmatched else "inner")
    return narrow.select(*_A_KEY, "a_name", *found)


def _narrow_order() -> list[Column | str]:
    return [level_order(), "a_group", "a_object", "rank", F.desc_nulls_last("score")]


def _with_paths(narrow: DataFrame, objects: DataFrame, include_unmatched: bool) -> DataFrame:
    """Both paths for numbered results: sorting would carry them along and store them once more."""
    path = F.struct(*RECORD_COLUMNS)
    b_side = _side(objects, "b", path.alias("b"))
    joined = narrow.join(b_side, _B_KEY, "left" if include_unmatched else "inner")
    joined = joined.join(_side(objects, "a", path.alias("a")), _A_KEY)
    return joined.select(*_result_columns("a_name"), "number")


def _described(objects, hits, scope, include_unmatched) -> DataFrame:
    """Attach both paths after the cut; objects without a hit come along when asked for."""
    on, path = _hit_key(scope), F.struct(*RECORD_COLUMNS)
    a_side = _side(
        _asking(objects, scope), "a", path.alias("a"), F.col("norm_name").alias("a_name")
    )
    a_side = a_side.select(*on, "a", F.col("a_name").alias("name_of_a"))
    found = hits.select(*on, "rank", "score", "b_group", "b_object", "b_name")
    matched = found.join(_side(objects, "b", path.alias("b")), _B_KEY)
    joined = a_side.join(matched, on, "left" if include_unmatched else "inner")
    return joined.select(*_result_columns("name_of_a"))
