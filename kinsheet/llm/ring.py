"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``replicas`` points of a ring of 64-bit positions; a row's key is its text, so
equal texts stand at one position. A row belongs to the next point clockwise. Shards have room
for a bounded number of rows: what a full shard cannot take continues clockwise to the next
point whose shard has room. All rows try their own shard first, then what is left moves on in
rounds; each round fills a shard or ends, so there are no more rounds than shards.

Rows are numbered once along the ring, together with the points as marker rows. The numbers of
the points are all that the driver needs: rows of an arc are a run of numbers, a split run is
two runs, and a row finds its run again by its number. The work on rows is one range sort,
which cuts a hot text by ``doc_id``, and one join with a table of a few runs a point.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsheet.llm.common import literal_table
from kinsheet.operators.sequence import with_sequence

REPLICAS = 64
#: Cells of row numbers in which runs are looked up.
CELLS = 1024


def points(shards: int, replicas: int = REPLICAS, seed: int = 0) -> list[tuple[int, int]]:
    """``(position, shard)`` of all points, clockwise. More shards keep the points of fewer."""

    def position(shard: int, replica: int) -> int:
        text = f"{seed}/{shard}/{replica}".encode()
        return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)

    return sorted((position(s, r), s) for s in range(shards) for r in range(replicas))


def room(rows: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may take: a share within one of the others', or ``1 + slack`` shares."""
    if slack:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


Run = tuple[int, int]


def deal(arcs: list[list[Run]], owner: list[int], free: list[int]) -> list[tuple[int, int, int]]:
    """Runs of row numbers ``(low, high, shard)`` with ``high`` excluded.

    ``arcs`` holds the runs of each point clockwise, ``owner`` the points' shards, ``free`` the
    rows that shards may take. Runs are cut only where a shard fills up.
    """
    free = list(free)
    waiting = {i: list(runs) for i, runs in enumerate(arcs) if runs}
    out: list[tuple[int, int, int]] = []
    while waiting:
        left: dict[int, list[Run]] = {}
        for i in sorted(waiting):
            s = owner[i]
            for low, high in waiting[i]:
                cut = min(high, low + free[s])
                free[s] -= cut - low
                if cut > low:
                    out.append((low, cut, s))
                if high > cut:
                    left.setdefault(i, []).append((cut, high))
        waiting = {}
        for i, runs in sorted(left.items()):
            around = ((i + step) % len(owner) for step in range(1, len(owner) + 1))
            after = next(j for j in around if free[owner[j]])
            waiting.setdefault(after, []).extend(runs)
    return sorted(out)


def _key(text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(text, F.lit("")))


def shard_rows(
    docs: DataFrame,
    shards: int,
    *,
    replicas: int = REPLICAS,
    slack: float = 0.0,
    seed: int = 0,
    whole: bool = False,
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``, one row a document; ``whole`` adds ``row``.

    ``size`` is the UTF-8 bytes of the text plus 1; ``slot`` numbers a shard's rows from 0
    without gaps; ``row`` is the document as one struct. With ``slack`` 0 shards differ by one
    row at most; with more, none has over ``1 + slack`` times the mean, and fewer rows move
    when a shard is added. Equal texts are in one shard, but for the few that a filling shard
    cuts and those too many for one.

    A null text is an empty one; a null ``doc_id`` is an id like others, first among equal
    texts; repeated rows each have a slot. An empty table gives no rows. The driver holds
    ``shards * replicas`` numbers and as many runs; it never sees rows.
    """
    if shards < 1 or replicas < 1 or slack < 0:
        raise ValueError("shards and replicas must be positive, slack not negative")
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    fields = [
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        _key(text, seed).alias("place"),
        F.lit(None).cast("int").alias("point"),
    ]
    if whole:
        fields.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    ring = points(shards, replicas, seed)
    markers = literal_table(
        spark,
        [{"place": p, "point": i} for i, (p, _) in enumerate(ring)],
        "place long, point int",
    )
    rows = docs.select(*fields).unionByName(markers, allowMissingColumns=True)
    # A point stands behind the rows of its own position: its arc ends with it.
    order = ["place", F.col("point").asc_nulls_first(), "doc_id", "size"]
    numbered = with_sequence(rows, "number", *order)
    last = numbered.agg(F.max("number")).first()[0]
    marks = numbered.where("point IS NOT NULL").select("point", "number").collect()
    ends = [n for _, n in sorted((r["point"], r["number"]) for r in marks)]
    arcs = [[(a + 1, b)] if b > a + 1 else [] for a, b in zip([0, *ends], ends)]
    if last > ends[-1]:  # the ring closes: what stands behind the last point meets the first
        arcs[0].append((ends[-1] + 1, last + 1))
    free = room(last - len(ring), shards, slack)
    runs = deal(arcs, [s for _, s in ring], free)
    return _dealt(numbered.where("point IS NULL"), runs, last).select(
        "doc_id", "size", "text_crc32", "shard", "slot", *(["row"] if whole else [])
    )


def _dealt(numbered: DataFrame, runs: list[tuple[int, int, int]], last: int) -> DataFrame:
    """Join the run of each row by cells of numbers, a run being in all cells it meets."""
    width = max(1, math.ceil((last + 1) / CELLS))
    table, taken = [], {}
    for low, high, s in runs:
        run = {"low": low, "high": high, "shard": s, "first": taken.get(s, 0)}
        taken[s] = run["first"] + high - low
        table += [run | {"cell": c} for c in range(low // width, (high - 1) // width + 1)]
    looked_up = literal_table(
        numbered.sparkSession, table, "cell long, low long, high long, shard int, first long"
    )
    celled = numbered.withColumn("cell", F.expr(f"number div {width}"))
    met = celled.join(F.broadcast(looked_up), "cell").where("low <= number AND number < high")
    return met.withColumn("slot", F.col("first") + F.col("number") - F.col("low"))


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Store the documents under ``path/shard=n`` with their ``slot``, files in slot order.

    A shard is as many files as its range of slots is cut into; columns named ``shard`` or
    ``slot`` are kept in the struct ``row``, as all others.
    """
    dealt = shard_rows(docs, shards, whole=True, **options)
    tasks = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    in_order = dealt.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot")
    in_order.select("shard", "slot", "row").write.partitionBy("shard").parquet(path)
