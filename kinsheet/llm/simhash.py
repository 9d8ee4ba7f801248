"""SimHash near-duplicates, compared by bit slices."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsheet.llm import common
from kinsheet.llm.components import connected_components
from kinsheet.session import materialize

BITS = 64
SEED = 42
#: Rows of a bucket that one side of a comparison cell holds.
CELL_ROWS = 4096
#: Mean rows of a bucket that are wanted; more fingerprints make finer keys.
BUCKET_ROWS = 4096
#: Comparisons of a row with a 64-row word that are under way at once.
ENTRIES = 1 << 17
#: Planes between two looks at which words can be abandoned.
PLANES_A_LOOK = 8
ALL = np.uint64(2**64 - 1)


def _hashes(words: pa.Array, counts: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, and the number of shingles of each text."""
    number = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = common.ranges(common.starts_of(counts), number)
    last = first + np.repeat(np.minimum(counts, shingle), number) - 1
    data = b" ".join(words.cast(pa.binary()).to_pylist())
    sizes = np.asarray(pc.binary_length(words), dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    view, digest = memoryview(data), xxhash.xxh64_intdigest
    spans = zip((ends - sizes)[first].tolist(), ends[last].tolist(), strict=True)
    hashed = np.fromiter((digest(view[a:b], SEED) for a, b in spans), np.uint64, len(first))
    return hashed, number


def _majority(hashed: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One fingerprint a text: the bits set in over half of its hashes."""
    found = np.zeros(len(number), dtype=np.uint64)
    full = np.flatnonzero(number)
    if len(full):
        bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits = np.add.reduceat(bits, common.starts_of(number)[full], axis=0, dtype=np.int32)
        over = 2 * set_bits > number[full][:, None]
        found[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return found


def fingerprints(
    docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fp)``: the 64-bit SimHash of each whole text as a signed long.

    Words are separated by ASCII white space and lower-cased in A-Z. A text with fewer words
    than a shingle is one shingle; one without words, or null, has fingerprint 0. Rows keep
    their number: repeated rows give repeated results, an empty table gives none. Other
    columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                lowered = pc.ascii_lower(part.column("text"))
                words, counts = common.split_words(lowered)
                found = _majority(*_hashes(words, counts, shingle))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"]
                )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return rows.mapInArrow(common.lean(run), "doc_id long, fp long")


def key_masks(pieces: int, radius: int) -> list[int]:
    """Bit masks of which one at least holds no differing bit of a pair within ``radius``.

    The bits are cut into ``pieces`` runs; ``radius`` differing bits spoil at most as many of
    them, so one choice of ``pieces - radius`` runs is left untouched.
    """
    if pieces <= radius:
        raise ValueError("pieces must exceed the radius")
    cuts = [round(i * BITS / pieces) for i in range(pieces + 1)]
    runs = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(choice) for choice in combinations(runs, pieces - radius)]


def pieces_for(count: int, radius: int) -> int:
    """Fewest pieces whose keys leave a mean bucket of ``BUCKET_ROWS`` rows or fewer."""
    pieces = radius + 1
    while pieces < 4 * (radius + 1) and count >> (BITS * (pieces - radius) // pieces) > BUCKET_ROWS:
        pieces += 1
    return pieces


def _planes(values: np.ndarray, slots: np.ndarray, words: int) -> np.ndarray:
    """Bit planes: plane ``b`` of word ``w`` holds bit ``b`` of the 64 rows of that word."""
    bits = np.zeros((words * BITS, BITS), dtype=np.uint8)
    bits[slots] = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits, axis=0, bitorder="little").reshape(words, 8, BITS)
    return np.ascontiguousarray(packed.transpose(2, 0, 1)).view(np.uint64)[:, :, 0]


def _near(planes, live, value, word, radius) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``(value, word)`` with rows within ``radius``, and a bit mask of those rows.

    Distances of 64 rows are counted at once: carry-save counters of as many bits as the
    radius needs, and a bit for rows beyond it. An entry whose rows are all beyond is left.
    """
    at = np.arange(len(value))
    over = ~live[word]
    depth = radius.bit_length()
    counters = [np.zeros(len(value), dtype=np.uint64) for _ in range(depth)]
    for b in range(BITS):
        bit = (value >> np.uint64(b)) & np.uint64(1)
        carry = planes[b][word] ^ (np.uint64(0) - bit)
        for i in range(depth):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if radius + 1 == 1 << depth:
            beyond = None
        else:
            # more than ``radius``: compare the counters with it from the top bit down
            beyond, equal = np.zeros_like(over), np.full_like(over, ALL)
            for i in reversed(range(depth)):
                if radius >> i & 1:
                    equal &= counters[i]
                else:
                    beyond |= equal & counters[i]
                    equal &= ~counters[i]
            over |= beyond
        if b % PLANES_A_LOOK == PLANES_A_LOOK - 1:
            open_ = np.flatnonzero(over != ALL)
            if len(open_) < len(over):
                at, over, value, word = at[open_], over[open_], value[open_], word[open_]
                counters = [c[open_] for c in counters]
    return at, ~over


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lower the labels of linked rows to the smallest one, in place."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def forest(values: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its cell that links within ``radius`` lead to.

    Cells begin at ``starts``. Rows are queries against the words of their own cell that
    follow; a word whose rows all have the query's label already is not looked at again.
    """
    ends = np.append(starts[1:], len(values))
    sizes = ends - starts
    cell_words = -(-sizes // BITS)
    first_word = common.starts_of(cell_words)
    cell = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(len(values)) - starts[cell]
    slots = first_word[cell] * BITS + inside
    words = int(cell_words.sum())
    planes = _planes(values, slots, words)
    live_bits = np.zeros(words * BITS, dtype=np.uint8)
    live_bits[slots] = 1
    live = np.packbits(live_bits, bitorder="little").view(np.uint64)
    row_of = np.zeros(words * BITS, dtype=np.int64)
    row_of[slots] = np.arange(len(values))

    label = np.arange(len(values))
    own_word = slots // BITS
    word_end = (first_word + cell_words)[cell]
    todo = word_end - own_word
    cuts = np.cumsum(todo)
    row = 0
    while row < len(values):
        base = cuts[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(cuts, base + ENTRIES, side="right")))
        query = np.repeat(np.arange(row, stop), todo[row:stop])
        word = common.ranges(own_word[row:stop], todo[row:stop])
        if row:  # labels are known only after a first block
            slot_label = np.full(words * BITS, -1)
            slot_label[slots] = label
            grid = slot_label.reshape(words, BITS)
            high = grid.max(axis=1)
            low = np.where(grid < 0, len(values), grid).min(axis=1)
            own = label[query]
            open_ = (low[word] != own) | (high[word] != own)
            query, word = query[open_], word[open_]
        at, mask = _near(planes, live, values[query], word, radius)
        for part in range(0, len(at), 1 << 13):
            pick, bits = at[part : part + (1 << 13)], mask[part : part + (1 << 13)]
            found, lane = np.nonzero(
                np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            )
            a = query[pick[found]]
            b = row_of[word[pick[found]] * BITS + lane]
            later = b > a
            _join(label, a[later], b[later])
        row = stop
    return label


def near_links(nodes: DataFrame, radius: int = 4, pieces: int | None = None) -> DataFrame:
    """``(u, v)``: links within ``radius`` bits that join all that all such pairs would join.

    ``nodes(fp)`` are distinct. Each goes to one bucket a key mask; a bucket of over
    ``CELL_ROWS`` rows is dealt to chunks whose pairs are cells of their own. Each cell gives
    a spanning forest of its links, so a group of n rows never emits more than n - 1.
    """
    if radius < 0 or radius >= BITS:
        raise ValueError("radius must be from 0 to 63")
    pieces = pieces or pieces_for(nodes.count(), radius)
    masks = key_masks(pieces, radius)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for i, m in enumerate(signed)
        ]
    )
    keyed = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CELL_ROWS).cast("int")
    dealt = keyed.join(sizes, ["mask", "key"]).select(
        "mask", "key", "fp", chunks.alias("chunks")
    )
    own = F.pmod(F.xxhash64("fp", "mask"), F.col("chunks")).cast("int")
    # Cell (a, b) with a <= b holds the chunks a and b of its bucket.
    partner = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cells = dealt.withColumn("own", own).withColumn("other", partner)
    cells = cells.select(
        "mask",
        "key",
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        "fp",
    )
    cell_key = ["mask", "key", "a", "b"]
    ordered = cells.repartition(*cell_key).sortWithinPartitions(*cell_key, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.whole_groups(batches, cell_key):
            values = table.column("fp").to_numpy()
            starts = common.group_starts(table, cell_key)
            label = forest(values.view(np.uint64), starts, radius)
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[linked]), pa.array(values[label[linked]])], ["u", "v"]
            )

    return ordered.mapInArrow(common.lean(run), "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = 4,
    radius: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, fp, component_id)``: near-duplicate classes of whole texts.

    Texts are linked if their fingerprints differ in ``radius`` bits or fewer; the class id is
    the smallest document id that links lead to, and a text without links has its own. Null
    and empty texts share fingerprint 0 and are linked like others. A null id keeps its row
    and is never a class id unless its class has no other. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(near_links(nodes.select("fp"), radius))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class does.

    That is the one with the smallest id. Rows that repeat its id and text stay once; rows
    without an id cannot be named and all stay.
    """
    found = materialize(near_duplicates(docs.select("doc_id", "text"), shingle, radius))
    heads = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_head"))
    heads = heads.agg(F.count(F.lit(1)).alias("_rows"))
    same = docs["doc_id"] == heads["_head"]
    kept = docs.join(heads.where("_rows = 1"), same, "left_semi")
    repeated = heads.where("_rows > 1")
    if not repeated.isEmpty():
        kept = kept.union(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.union(docs.where(docs["doc_id"].isNull()))
