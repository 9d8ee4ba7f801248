"""Helpers the operators share: Arrow text batches, grouped streams, stored tables."""

from __future__ import annotations

import ctypes
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the ASCII controls 9 to 13. Fixed value.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at once inside a task; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``most`` bytes of text or one row."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def lean(run):
    """``run`` for ``mapInArrow``: its task gives freed memory back to the system at its end.

    Workers outlive their tasks and keep what their allocators hold, beside the next stages.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in a flat array, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
    ends = np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))
    counts = np.diff(before[np.concatenate([[0], ends])])
    return flat.filter(pa.array(full)), counts


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, …`` with ``counts[i]`` members each, end to end."""
    total = int(counts.sum())
    return np.repeat(first - starts_of(counts), counts) + np.arange(total)


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16
) -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by ``keys``; the tail waits for its rest.

    Memory is one table of about ``rows`` rows or the largest single group.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(table: pa.Table) -> int:
        """Row at which the last group begins."""
        changed = np.zeros(table.num_rows - 1, dtype=bool)
        for k in keys:
            column = table.column(k).combine_chunks()
            different = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True)
            changed |= np.asarray(different)
        at = np.flatnonzero(changed)
        return int(at[-1]) + 1 if len(at) else 0

    wanted = rows
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= wanted:
            table = pa.Table.from_batches(held).combine_chunks()
            at = cut(table)
            if at:
                yield table.slice(0, at)
            held = table.slice(at).to_batches()
            count = table.num_rows - at
            wanted = max(rows, 2 * count)
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each group of a sorted table."""
    changed = np.ones(table.num_rows, dtype=bool)
    changed[1:] = False
    for k in keys:
        column = table.column(k).to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(changed)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null, inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table that stands in the plan as one literal."""
    values = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(values))
