"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

All texts' windows of ``window`` bytes are dealt to groups by the smallest of the hashes of
their grams, the anchor: equal windows have equal anchors, so a group can be finished alone.
A run of neighbouring windows with one anchor is a segment. Equal segments are folded to the
first of them before anything is shuffled or compared. What is left, the different segments
of one anchor, are the shards whose transforms are merged: see ``interleave``. Anchors with too
many of them for one task are left to their single windows, which are sorted and read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsheet.llm import common
from kinsheet.session import materialize

WINDOW = 100
NO_ID = -(1 << 63)
#: Bytes of the hashed strings whose smallest hash places a window.
GRAM = 16
#: Bytes in which equal segments are folded inside a task. Positions in them need 24 bits.
FOLD_BYTES = 2 << 20
#: Segments of one anchor that one task merges; a larger group is compared window by window.
GROUP_SEGMENTS = 1 << 15
#: Windows of larger groups whose bytes a task holds at once and folds before the shuffle.
WINDOW_BLOCK = 1 << 17
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on, by one running sum."""
    n = len(data)
    if n < gram:
        return np.zeros(0, dtype=np.uint64)
    powers = np.full(n + 1, MULTIPLIER, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    back = np.full(n + 1, np.uint64(_inverse(int(MULTIPLIER))), dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * back[:n], out=sums[1:])
    hashed = (sums[gram:] - sums[:-gram]) * powers[: n - gram + 1]
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    hashed ^= hashed >> np.uint64(32)
    return hashed


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: block-wise prefix and suffix minima."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[: n - width + 1], after[width - 1 : n])


def segments(data: np.ndarray, owner_end: np.ndarray, window: int):
    """Maximal runs of windows with one smallest gram: ``(anchor, first, count)``.

    ``owner_end`` is, for each byte, the end of its text; windows stay inside texts. Windows
    of equal bytes have equal anchors at equal offsets, wherever they stand.
    """
    n = len(data)
    if n < window:
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty
    hashed = gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    key = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)
    least = sliding_minimum(key, window - GRAM + 1)
    at = (least & low).astype(np.int64)
    start = np.arange(len(least))
    valid = start + window <= owner_end[: len(least)]
    same = np.zeros(len(least), dtype=bool)
    same[1:] = valid[1:] & valid[:-1] & (at[1:] == at[:-1])
    # The next text's first window cannot follow the last one: bytes between them are invalid.
    first = np.flatnonzero(valid & ~same)
    ends = np.flatnonzero(valid & ~np.append(same[1:], False)) + 1
    return hashed[at[first]], first, ends - first


def interleave(data: np.ndarray, ends: np.ndarray, block: np.ndarray, depth: int) -> tuple:
    """Merge transforms by refinement: ``(window, block)`` of strings that occur again.

    ``ends`` are the positions after each string of ``depth`` bytes, in shard order, and
    ``block`` a number that equal strings share. A step puts the symbol before each suffix (its
    Burrows-Wheeler symbol) in front: the interleave of all shards is dealt to the symbols'
    buckets, stably, and so is sorted by one more byte, without comparing any suffix. An
    interval of suffixes with a common prefix goes on as long as it has two members or more; one
    that is alone has no common prefix of this length and leaves. After ``depth`` steps the
    intervals are the repeated strings.
    """
    window = np.arange(len(ends))
    order = np.argsort(block, kind="stable")
    window, at, block = window[order], ends[order].copy(), block[order]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = block[1:] != block[:-1]
    for step in range(depth + 1):
        if step:
            at -= 1
            symbol = data[at]
            order = np.argsort(symbol, kind="stable")
            symbol, block = symbol[order], block[order]
            at, window = at[order], window[order]
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        alone = fresh & np.append(fresh[1:], True)
        block = np.cumsum(fresh)
        if alone.any():
            stays = ~alone
            at, window, block = at[stays], window[stays], block[stays]
        if not len(at):
            break
    return window, block


def repeated_windows(data, ends, group) -> np.ndarray:
    """Windows, numbered in order of place, whose string an earlier window has as well."""
    window, block = interleave(data, ends, group, WINDOW)
    if not len(window):
        return window
    first = np.flatnonzero(np.diff(block, prepend=-1))
    earliest = np.minimum.reduceat(window, first)
    sizes = np.diff(np.append(first, len(block)))
    return window[window != np.repeat(earliest, sizes)]


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, version, text)`` of all rows, and of each document once.

    The version is 0 unless an id is repeated or null somewhere. Then it is the text's hash,
    and rows with equal id and text are one document.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        keyed = rows.select(_known("doc_id"), F.lit(0).cast("long").alias("version"), "text")
        return keyed, keyed
    keyed = rows.select(_known("doc_id"), F.xxhash64("text").alias("version"), "text")
    return keyed, keyed.dropDuplicates(["doc_id", "version"])


def _known(column: str) -> F.Column:
    """Missing ids travel as the smallest long, so they come before all others."""
    return F.coalesce(column, F.lit(NO_ID).cast("long")).alias(column)


#: Segments on their way: ``kind`` 0 is to be compared, 1 is known to repeat an earlier one.
#: ``span`` is the start times 2^24 plus the length, so it sorts by start.
SPAN = 1 << 24
SEGMENT = "kind int, anchor long, body long, doc_id long, version long, span long"


def _segments(docs: DataFrame) -> DataFrame:
    """Segments of all texts, those that a task can fold by itself already folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", FOLD_BYTES):
                yield from _fold(part)

    return docs.mapInArrow(run, SEGMENT)


def _fold(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = part.column("text").cast(pa.binary())
    ids = part.column("doc_id").to_numpy()
    versions = part.column("version").to_numpy()
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    whole = b"".join(texts.to_pylist())
    found = []
    text_end = np.cumsum(sizes)
    for start in range(0, max(len(whole), 1), FOLD_BYTES):
        # A text longer than a part is looked at in parts that overlap by a window.
        data = whole[start : start + FOLD_BYTES + WINDOW - 1]
        position = np.arange(start, start + len(data))
        owner = np.searchsorted(text_end, position, side="right")
        anchor, first, count = segments(
            np.frombuffer(data, dtype=np.uint8), text_end[owner] - start, WINDOW
        )
        view, digest = memoryview(data), xxhash.xxh3_64_intdigest
        spans = zip(first.tolist(), (first + count + WINDOW - 1).tolist())
        body = np.fromiter((digest(view[a:b]) for a, b in spans), np.uint64, len(first))
        own = owner[first]
        found.append((anchor, body, own, start + first - (text_end - sizes)[own], count + WINDOW - 1))
    anchor, body, own, begin, length = (np.concatenate(c) for c in zip(*found))
    doc, version = ids[own], versions[own]
    order = np.lexsort((begin, version, doc, body, anchor))
    anchor, body, own, begin, length = (c[order] for c in (anchor, body, own, begin, length))
    doc, version = doc[order], version[order]
    again = np.zeros(len(anchor), dtype=bool)
    again[1:] = (anchor[1:] == anchor[:-1]) & (body[1:] == body[:-1])
    kept = ~again
    yield _rows(0, anchor[kept], body[kept], doc[kept], version[kept], begin[kept], length[kept])
    # Neighbouring repeats of a text are one span.
    own, begin, length = _joined(own[again], begin[again], length[again])
    if len(own):
        key = np.arange(len(own), dtype=np.uint64) * MULTIPLIER
        yield _rows(1, key, key, ids[own], versions[own], begin, length)


def _joined(own: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple:
    """``(own, begin, length)`` of the joined spans of each text."""
    order = np.lexsort((begin, own))
    own, begin, end = own[order], begin[order], (begin + length)[order]
    starts = np.ones(len(own), dtype=bool)
    starts[1:] = (own[1:] != own[:-1]) | (begin[1:] > end[:-1])
    at = np.flatnonzero(starts)
    stop = end[np.append(at[1:], len(own)) - 1] if len(at) else end
    return _short_spans(own[at], begin[at], stop - begin[at])


def _short_spans(own: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple:
    """Spans in pieces whose lengths are below ``SPAN``; ``_cut`` joins them again."""
    most = SPAN - 1
    pieces = -(-length // most)
    index = np.repeat(np.arange(len(own)), pieces)
    ahead = most * common.ranges(np.zeros(len(own), dtype=np.int64), pieces)
    return own[index], begin[index] + ahead, np.minimum(length[index] - ahead, most)


def _rows(kind: int, anchor, body, doc, version, begin, length) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(doc), kind, dtype=np.int32)),
            pa.array(anchor.view(np.int64)),
            pa.array(body.view(np.int64)),
            pa.array(doc),
            pa.array(version),
            pa.array(begin * SPAN + length),
        ],
        ["kind", "anchor", "body", "doc_id", "version", "span"],
    )


def _first_segments(rows: DataFrame) -> DataFrame:
    """Fold equal segments of all tasks: repeats (1), and firsts of shared anchors (2).

    Rows of an anchor come sorted and pass as a stream; nothing of a group is held but its
    first segment.
    """
    order = ["anchor", "body", "doc_id", "version", "span"]
    ordered = rows.repartition("anchor").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last anchor's only segment so far
        last: tuple = (None, None)

        def told(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
            column = pa.array(np.full(batch.num_rows, kind, dtype=np.int32))
            return batch.set_column(0, "kind", column)

        for batch in batches:
            known = batch.filter(pc.equal(batch.column("kind"), 1))
            if known.num_rows:
                yield known
            batch = batch.filter(pc.equal(batch.column("kind"), 0))
            if not batch.num_rows:
                continue
            anchor, body = batch.column("anchor").to_numpy(), batch.column("body").to_numpy()
            same_anchor = np.append(anchor[0] == last[0], anchor[1:] == anchor[:-1])
            same = same_anchor & np.append(body[0] == last[1], body[1:] == body[:-1])
            if same.any():
                yield told(batch.filter(pa.array(same)), 1)
            firsts = batch.filter(pa.array(~same))
            last = (anchor[-1], body[-1])
            if not firsts.num_rows:
                continue
            joins = same_anchor[~same]  # the segment before it has the same anchor
            if joins[0] and held is not None:
                yield told(held, 2)
            several = joins | np.append(joins[1:], False)
            held = None if several[-1] else firsts.slice(firsts.num_rows - 1)
            if several.any():
                yield told(firsts.filter(pa.array(several)), 2)

    return ordered.mapInArrow(run, SEGMENT)


def _wanted(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts with the list of their segments in ``firsts``."""
    wanted = firsts.groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("anchor", "span")).alias("wanted")
    )
    return docs.join(wanted, ["doc_id", "version"]).select("doc_id", "version", "text", "wanted")


def _places(part: pa.RecordBatch) -> tuple:
    """``(bytes, anchor, owner, begin, place, length)`` of the wanted segments of a batch."""
    wanted = part.column("wanted")
    n = np.asarray(pc.list_value_length(wanted), dtype=np.int64)
    flat = wanted.flatten()
    owner = np.repeat(np.arange(len(n)), n)
    span = flat.field("span").to_numpy()
    texts = part.column("text").cast(pa.binary())
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    begin = span // SPAN
    place = (np.cumsum(sizes) - sizes)[owner] + begin
    anchor = flat.field("anchor").to_numpy()
    return b"".join(texts.to_pylist()), anchor, owner, begin, place, span % SPAN


def _bodies(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """Bytes of the segments that are to be merged, cut out of their texts."""
    schema = pa.schema(
        [
            ("anchor", pa.int64()),
            ("doc_id", pa.int64()),
            ("version", pa.int64()),
            ("start", pa.int64()),
            ("body", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                data, anchor, owner, begin, at, length = _places(part)
                view = memoryview(data)
                bodies = [bytes(view[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor),
                        part.column("doc_id").take(pa.array(owner)),
                        part.column("version").take(pa.array(owner)),
                        pa.array(begin),
                        pa.array(bodies, pa.binary()),
                    ],
                    schema=schema,
                )

    return _wanted(firsts, docs).mapInArrow(
        run, "anchor long, doc_id long, version long, start long, body binary"
    )


def _folded_windows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Single windows of the wanted segments: one row with its bytes for the first of equal ones
    of a block, spans without bytes for the others."""
    data, _, owner, begin, place, length = _places(part)
    if not len(owner):
        return
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, dtype=np.uint8), WINDOW)
    ids, versions = part.column("doc_id").to_numpy(), part.column("version").to_numpy()
    stop = np.cumsum(length - WINDOW + 1)
    for low in range(0, int(stop[-1]), WINDOW_BLOCK):
        number = np.arange(low, min(low + WINDOW_BLOCK, int(stop[-1])))
        segment = np.searchsorted(stop, number, side="right")
        step = number - (stop - (length - WINDOW + 1))[segment]
        own, start = owner[segment], begin[segment] + step
        held = np.ascontiguousarray(rows[place[segment] + step])
        body = pa.FixedSizeBinaryArray.from_buffers(
            pa.binary(WINDOW), len(held), [None, pa.py_buffer(held)]
        ).cast(pa.binary())
        code = body.dictionary_encode().indices.to_numpy()
        order = np.lexsort((start, versions[own], ids[own], code))
        first = np.ones(len(order), dtype=bool)
        first[1:] = code[order][1:] != code[order][:-1]
        kept, again = order[first], order[~first]
        yield _window_rows(ids, versions, own[kept], start[kept], WINDOW, body.take(pa.array(kept)))
        if len(again):
            spans = _joined(own[again], start[again], np.full(len(again), WINDOW))
            yield _window_rows(ids, versions, *spans, pa.nulls(len(spans[0]), pa.binary()))


def _window_rows(ids, versions, own, begin, length, body) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[own]), pa.array(versions[own]), pa.array(begin * SPAN + length), body],
        ["doc_id", "version", "span", "body"],
    )


def _streamed(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, version, span)``: windows of ``firsts`` that an earlier one equals.

    Windows come sorted by their bytes, and only the last one is held, whatever number of equal
    ones there is. Equality is that of the bytes.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", FOLD_BYTES):
                yield from _folded_windows(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            body = batch.column("body")
            full = body.is_valid()
            again = ~np.asarray(full)
            windows = body.filter(full)
            if len(windows):
                same = np.zeros(len(windows), dtype=bool)
                same[0] = windows[0].as_py() == last
                same[1:] = np.asarray(pc.equal(windows[1:], windows[:-1]))
                again[np.asarray(full)] = same
                last = windows[-1].as_py()
            if again.any():
                yield batch.select(["doc_id", "version", "span"]).filter(pa.array(again))

    windows = _wanted(firsts, docs).mapInArrow(
        fold, "doc_id long, version long, span long, body binary"
    )
    # Spans without bytes are spread; equal bytes meet.
    key = F.when(F.col("body").isNull(), F.xxhash64("doc_id", "span")).otherwise(F.xxhash64("body"))
    ordered = windows.withColumn("key", key).repartition("key")
    ordered = ordered.sortWithinPartitions("key", "body", "doc_id", "version", "span").drop("key")
    return ordered.mapInArrow(run, "doc_id long, version long, span long")


def _merged(bodies: DataFrame) -> DataFrame:
    """``(doc_id, version, span)``: what of each segment an earlier one of its group has."""
    keys = ["anchor"]
    ordered = bodies.repartition(*keys).sortWithinPartitions(*keys, "doc_id", "version", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.whole_groups(batches, keys, rows=1 << 14):
            body = table.column("body").combine_chunks()
            sizes = np.asarray(pc.binary_length(body), dtype=np.int64)
            data = np.frombuffer(b"".join(body.to_pylist()), dtype=np.uint8)
            count = sizes - WINDOW + 1
            first = np.cumsum(sizes) - sizes
            ends = common.ranges(first, count) + WINDOW
            group = np.zeros(table.num_rows, dtype=np.int64)
            group[common.group_starts(table, keys)] = 1
            segment = np.repeat(np.arange(len(count)), count)
            again = np.sort(repeated_windows(data, ends, np.cumsum(group)[segment]))
            if not len(again):
                continue
            own = segment[again]
            step = again - common.starts_of(count)[own]
            starts = np.ones(len(again), dtype=bool)
            starts[1:] = (own[1:] != own[:-1]) | (step[1:] != step[:-1] + 1)
            at = np.flatnonzero(starts)
            length = step[np.append(at[1:], len(again)) - 1] - step[at] + WINDOW
            begin = table.column("start").to_numpy()[own[at]] + step[at]
            pick = pa.array(own[at])
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id").combine_chunks().take(pick),
                    table.column("version").combine_chunks().take(pick),
                    pa.array(begin * SPAN + length),
                ],
                ["doc_id", "version", "span"],
            )

    return ordered.mapInArrow(run, "doc_id long, version long, span long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, span)``: bytes that an earlier equal window covers, with overlaps."""
    columns = ["kind", "anchor", "doc_id", "version", "span"]
    found = materialize(_first_segments(_segments(docs)).select(*columns))
    firsts = found.where("kind = 2").drop("kind")
    counted = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    large = counted.where(F.col("n") > GROUP_SEGMENTS).select("anchor")
    known = found.where("kind = 1").select("doc_id", "version", "span")
    if large.isEmpty():
        return known.union(_merged(_bodies(firsts, docs)))
    streamed = _streamed(firsts.join(large, "anchor", "left_semi"), docs)
    merged = _merged(_bodies(firsts.join(large, "anchor", "left_anti"), docs))
    return known.union(merged).union(streamed)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)``, a row a document.

    Every byte of a text's UTF-8 form is removed that a window of ``WINDOW`` bytes covers which
    also starts earlier: in a smaller id, or earlier in the same text. ``kept`` is what stays.
    A null or empty text has no bytes. Rows that share an id are ordered by a hash of their
    texts, those equal in both are one document; a null id comes before all. Equality of
    whole segments is that of 128 bits of hashes. Other columns are not read.
    """
    keyed, distinct = _keyed(docs)
    spans = repeated_spans(distinct).groupBy("doc_id", "version")
    spans = spans.agg(F.collect_list("span").alias("spans"))
    joined = keyed.join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows = []
                for text, spans in zip(
                    part.column("text").cast(pa.binary()).to_pylist(), part.column("spans").to_pylist()
                ):
                    rows.append(_cut(text, spans))
                n_bytes, removed, runs, digests, kept = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n_bytes, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(runs, pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    out = joined.mapInArrow(
        run,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID).cast("long")))


def _cut(text: bytes, spans: list[int] | None) -> tuple[int, int, int, str, bytes]:
    if not spans:
        return len(text), 0, 0, hashlib.sha256(text).hexdigest(), text
    begin, length = np.divmod(np.sort(np.array(spans, dtype=np.int64)), SPAN)
    reach = np.maximum.accumulate(begin + length)
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > reach[:-1]
    at = np.flatnonzero(new)
    starts, stops = begin[at], reach[np.append(at[1:], len(begin)) - 1]
    edges = zip([0, *stops.tolist()], [*starts.tolist(), len(text)])
    kept = b"".join(text[a:b] for a, b in edges)
    removed = int((stops - starts).sum())
    return len(text), removed, len(starts), hashlib.sha256(kept).hexdigest(), kept
