"""Mixing sources to target weights with DataFrame functions only.

Texts are cut into blocks of words. The blocks of a source are put into a pseudo-random order
(by hash); the mix takes that line of blocks from its start, over and over, until the words of
the source's target are reached. A splitting tree deals the blocks that are taken out to the
output shards: at each node the left half's share of each source is a multivariate
hypergeometric draw, so that every shard has its exact number of blocks and the mix of a shard
is that of a random subset. A shard takes the next run of each source's line: shards are
disjoint, and each is then shuffled by itself.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsheet.llm.common import literal_table, word_count
from kinsheet.session import materialize

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK_WORDS = 64
#: Blocks are made longer for texts with more of them in all: exact draws end at 10^9.
MOST_BLOCKS = 1 << 28
#: Mean blocks of one bucket of a source's line; ranks are counted inside buckets.
BUCKET_BLOCKS = 4096
SHARD_BLOCKS = 1 << 18
#: Numbers of the plan (sources times shards) that the driver draws.
MOST_QUOTAS = 1_000_000

#: A word and the white space that follows it.
WORD_ON = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """Words of each source: shares by weight, none above ``MOST_REPEATS`` times its size.

    What a source cannot take is shared again, by weight, among those below their limit.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    found = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(sum(sizes))
    while open_:
        level = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if level * weight[i] > MOST_REPEATS * sizes[i]]
        if not full:
            for i in open_:
                found[i] = level * weight[i]
            break
        for i in full:
            found[i] = float(MOST_REPEATS * sizes[i])
            left -= found[i]
            open_.discard(i)
    return found


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """``(source, shard)`` blocks: row sums are ``quotas``, shard sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(quotas)
    room = [total // shards + (i < total % shards) for i in range(shards)]
    out = np.zeros((len(quotas), shards), dtype=np.int64)
    nodes = [(0, shards, np.array(quotas, dtype=np.int64))]
    while nodes:
        low, high, have = nodes.pop()
        if high - low == 1:
            out[:, low] = have
            continue
        mid = (low + high) // 2
        left = rng.multivariate_hypergeometric(have, sum(room[low:mid]), method="marginals")
        nodes += [(low, mid, left), (mid, high, have - left)]
    return out


def sized(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: its key, source and number of words. Equal rows are numbered."""
    text = F.col("text")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(text).alias("digest"),
    )
    same = Window.partitionBy("doc_id", "source", "digest").orderBy("size")
    return rows.withColumn("nth", F.row_number().over(same))


KEY = ["doc_id", "source", "digest", "nth"]


def _same_key(left: DataFrame, right: DataFrame) -> Column:
    """Rows of one document; ``right`` has its key under names with an underscore."""
    found = F.lit(True)
    for k in KEY:
        found &= left[k].eqNullSafe(right[f"_{k}"])
    return found


class Mix:
    """Plan of a mix: ``sizes`` (one row a document), ``sources`` and ``draws``.

    ``sources(source, number, source_size, target, words)``: numbered by code point, null
    last; ``words`` is the whole number of words that are taken. ``draws`` has a row for each
    block that is taken, and each time it is: the document's key, ``block`` (its number in
    the text), ``epoch``, ``shard``, ``words`` and ``place``, the order inside the shard.

    A null text has no words and is never drawn; a null source is a source. Repeated rows are
    documents of their own. A source without words has target 0. An empty table gives empty
    results. The plan keeps a few numbers a source on the driver, ``MOST_QUOTAS`` at most.
    """

    def __init__(self, docs: DataFrame, seed: int = 0, id_col: str = "doc_id"):
        spark = docs.sparkSession
        self.sizes = materialize(sized(docs, id_col))
        by_source = self.sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        listed = [tuple(r) for r in by_source.limit(MOST_QUOTAS + 1).collect()]
        if len(listed) > MOST_QUOTAS:
            raise ValueError(f"over {MOST_QUOTAS} sources")
        listed.sort(key=lambda r: (r[0] is None, r[0] or ""))
        aims = targets([n for _, n in listed])
        total = sum(n for _, n in listed)
        self.block_words = max(BLOCK_WORDS, math.ceil(total / MOST_BLOCKS))
        self.sources = literal_table(
            spark,
            [
                {"source": s, "number": i, "source_size": n, "target": t}
                | {"words": round(t), "epochs": round(t) // n if n else 0}
                | {"rest": round(t) % n if n else 0}
                for i, ((s, n), t) in enumerate(zip(listed, aims))
            ],
            "source string, number int, source_size long, target double, words long, "
            "epochs long, rest long",
        )
        self.draws = self._draws(spark, total, len(listed), seed)

    def _blocks(self, buckets: int, seed: int) -> DataFrame:
        """Blocks of all texts with their place in the line of their source."""
        width = self.block_words
        numbered = self.sizes.where("size > 0").join(
            self.sources.select(F.col("source").alias("_source"), "number", "rest", "epochs"),
            F.col("source").eqNullSafe(F.col("_source")),
        )
        last = F.expr(f"div(size - 1, {width})")
        block = numbered.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        place = F.xxhash64(F.lit(seed), "doc_id", "digest", "nth", "block")
        return block.select(
            *KEY,
            "number",
            "rest",
            "epochs",
            "block",
            F.least(F.lit(width), F.col("size") - F.col("block") * width).alias("words"),
            place.alias("place"),
            F.pmod(place, F.lit(buckets)).cast("int").alias("bucket"),
        )

    def _draws(self, spark, total: int, sources: int, seed: int) -> DataFrame:
        expected = max(1, total // self.block_words)
        buckets = 1 << max(0, math.ceil(math.log2(expected / BUCKET_BLOCKS)))
        blocks = self._blocks(buckets, seed)
        filled = blocks.groupBy("number", "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.sum("words").alias("w")
        )
        line = Window.partitionBy("number").orderBy("bucket")
        earlier = line.rowsBetween(Window.unboundedPreceding, -1)
        filled = filled.select(
            "number",
            "bucket",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
            F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w_before"),
        )
        inside = Window.partitionBy("number", "bucket").orderBy(
            "place", "doc_id", "digest", "nth", "block"
        )
        running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = blocks.withColumns(
            {"rank": F.row_number().over(inside) - 1, "run": F.sum("words").over(running)}
        ).join(filled, ["number", "bucket"])
        start = F.col("w_before") + F.col("run") - F.col("words")
        placed = materialize(
            placed.select(
                *KEY,
                "number",
                "block",
                "place",
                "words",
                "epochs",
                (F.col("n_before") + F.col("rank")).alias("rank"),
                F.greatest(F.lit(0), F.least("words", F.col("rest") - start)).alias("extra"),
            )
        )
        counted = placed.groupBy("number").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("epochs") + (F.col("extra") > 0).cast("long")).alias("taken"),
        )
        taken = {r["number"]: (r["n"], r["taken"]) for r in counted.collect()}
        quotas = [taken.get(i, (0, 0))[1] for i in range(sources)]
        self.shards = max(1, math.ceil(sum(quotas) / SHARD_BLOCKS))
        if self.shards * sources > MOST_QUOTAS:
            raise ValueError("too many shards for the number of sources: raise SHARD_BLOCKS")
        ends = np.cumsum(split_quotas(quotas, self.shards, seed), axis=1)
        plan = literal_table(
            spark,
            [
                {"number": i, "per_epoch": taken.get(i, (0, 0))[0], "ends": ends[i].tolist()}
                for i in range(sources)
            ],
            "number int, per_epoch long, ends array<long>",
        )
        last_epoch = F.col("epochs") - F.when(F.col("extra") > 0, 0).otherwise(1)
        epoch = F.explode(F.sequence(F.lit(0).cast("long"), last_epoch))
        drawn = placed.where("epochs > 0 OR extra > 0").withColumn("epoch", epoch)
        position = F.col("epoch") * F.col("per_epoch") + F.col("rank")
        return (
            drawn.join(plan, "number")
            .withColumn("position", position)
            .select(
                *KEY,
                "block",
                "epoch",
                F.expr("size(filter(ends, e -> e <= position))").alias("shard"),
                F.when(F.col("epoch") < F.col("epochs"), F.col("words"))
                .otherwise(F.col("extra"))
                .alias("words"),
                F.xxhash64(F.lit(seed), "place", "epoch").alias("place"),
            )
        )

    def taken(self) -> DataFrame:
        """``(doc_id, size, source, source_size, target, taken, first_shard, last_shard)``.

        One row a document; the shards are the lowest and highest that hold some of it, null
        for a document that the mix does not take.
        """
        words = self.draws.groupBy(*KEY).agg(
            F.sum("words").alias("taken"),
            F.min("shard").alias("first_shard"),
            F.max("shard").alias("last_shard"),
        )
        held = ["taken", "first_shard", "last_shard"]
        words = words.select(*[F.col(k).alias(f"_{k}") for k in KEY], *held)
        aims = self.sources.select(F.col("source").alias("_from"), "source_size", "target")
        return (
            self.sizes.join(words, _same_key(self.sizes, words), "left")
            .join(aims, F.col("source").eqNullSafe(F.col("_from")))
            .select(
                "doc_id",
                "size",
                "source",
                "source_size",
                "target",
                F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                "first_shard",
                "last_shard",
            )
        )

    def shuffled(self) -> DataFrame:
        """The draws, one partition run a shard, each in its own random order."""
        return self.draws.repartition(self.shards, "shard").sortWithinPartitions("shard", "place")


def _blocks_of(text: Column, words: int) -> Column:
    """Blocks of a text with the white space after their words."""
    return F.regexp_extract_all(text, F.lit(f"(?:{WORD_ON}){{1,{words}}}+"), F.lit(0))


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` as the mix takes them: a row for each whole time, one for a part.

    The part holds the document's blocks that the last round took, in text order; its last
    words may be cut off where the target is reached. Documents the mix does not take go.
    Columns stay as they are; other columns of a part are those of its document.
    """
    mix = Mix(docs, seed)
    by_epoch = mix.draws.groupBy(*KEY, "epoch").agg(
        F.sum("words").alias("words"),
        F.sort_array(F.collect_list(F.struct("block", "words"))).alias("blocks"),
    )
    whole = mix.sizes.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("size").alias("_size"))
    taken = by_epoch.join(whole, _same_key(by_epoch, whole)).select(
        *[f"_{k}" for k in KEY],
        F.when(F.col("words") < F.col("_size"), F.col("blocks")).alias("_blocks"),
    )
    # The document travels as one column, so that none of its names can be met by another.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(
        row,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(F.col("text").cast("string")).alias("digest"),
    )
    if mix.sizes.where("nth > 1").isEmpty():
        number = F.lit(1)
    else:
        same = Window.partitionBy("doc_id", "source", "digest").orderBy("digest")
        number = F.row_number().over(same)
    keyed = keyed.withColumn("nth", number)
    text = F.col("row.text").cast("string")
    joined = keyed.join(taken, _same_key(keyed, taken)).select(
        "row",
        F.col("_blocks").alias("blocks"),
        F.when(F.col("_blocks").isNotNull(), _blocks_of(text, mix.block_words)).alias("parts"),
    )

    def cut(block: Column) -> Column:
        words = F.regexp_extract_all(F.col("parts")[block["block"].cast("int")], F.lit(WORD_ON), F.lit(0))
        return F.array_join(F.slice(words, F.lit(1), block["words"].cast("int")), "")

    part = F.array_join(F.transform("blocks", cut), "")
    mixed = F.when(F.col("blocks").isNull(), text).otherwise(part).alias("text")
    return joined.select(
        *[mixed if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    )
