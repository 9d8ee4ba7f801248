"""Benchmark decontamination: BM25 retrieval of test items by training passages."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsheet.llm import common

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage has to reach.
THRESHOLD = 0.5
#: Share of the shingles of the item, or of its question and of its answer each, that the
#: passage has to hold.
OVERLAP = 0.8
SHINGLE = 5
#: Share of an item's last words that is its answer. Items come as one text, so this cut is a
#: guess: it adds leaks but never takes one away whose item as a whole is held. The answer has
#: two shingles' words at least; an item without as many again is question and answer at once.
ANSWER_SHARE = 0.25
#: Items whose impacts share one maximum a term.
BLOCK_ITEMS = 8
#: Text bytes of the items of one index, which is sent to the tasks; more items, more indexes.
INDEX_BYTES = 8 << 20
#: ASCII punctuation, which is no part of a word at its edges.
EDGES = string.punctuation


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words without edge punctuation, flat, with their number in each text."""
    words, counts = common.split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    words = pc.utf8_trim(words, EDGES)
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    before = np.concatenate([[0], np.cumsum(full)])
    ends = np.cumsum(counts)
    return words.filter(pa.array(full)), before[ends] - before[ends - counts]


def _shingles(ids: np.ndarray) -> set[tuple]:
    """Runs of ``SHINGLE`` word ids; a shorter text is one run."""
    ids = ids.tolist()
    size = min(SHINGLE, len(ids))
    return {tuple(ids[i : i + size]) for i in range(len(ids) - size + 1)} if size else set()


class Index:
    """BM25 index of test items with block maxima; impacts are shares of the item's own score."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        words, counts = words_in(pa.array(texts, pa.string()))
        self.ids = pa.array(ids, pa.int64())
        coded = words.dictionary_encode()
        self.terms = coded.dictionary
        term = coded.indices.to_numpy().astype(np.int64)
        item = np.repeat(np.arange(len(ids)), counts)
        key, tf = np.unique(term * max(1, len(ids)) + item, return_counts=True)
        term_of, item_of = np.divmod(key, max(1, len(ids)))
        df = np.bincount(term_of, minlength=len(self.terms))
        idf = np.log1p((len(ids) - df + 0.5) / (df + 0.5))
        norm = 1 - B + B * counts / max(1.0, counts.mean() if len(ids) else 1.0)
        weight = idf[term_of] * tf * (K1 + 1) / (tf + K1 * norm[item_of])
        own = np.bincount(item_of, weights=weight, minlength=len(ids))
        impact = weight / own[item_of]
        # Postings by (term, block of items).
        self.blocks = -(-len(ids) // BLOCK_ITEMS)
        cell = term_of * max(1, self.blocks) + item_of // BLOCK_ITEMS
        self.item, self.impact = item_of, impact
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell = cell[first]
        self.cell_start = first
        self.cell_size = np.diff(np.append(first, len(cell)))
        self.cell_max = np.maximum.reduceat(impact, first) if len(first) else impact
        cell_term = self.cell // max(1, self.blocks)
        self.term_first = np.searchsorted(cell_term, np.arange(len(self.terms)))
        self.term_cells = np.bincount(cell_term, minlength=len(self.terms))
        self.term_max = np.zeros(len(self.terms))
        np.maximum.at(self.term_max, cell_term, self.cell_max)
        self.longest = int(counts.max()) if len(ids) else 0
        ends = np.cumsum(counts)
        # Shingles of the question, of the answer and of the whole item.
        self.parts = []
        for a, b in zip(ends - counts, ends):
            split = max(2 * SHINGLE, round((b - a) * ANSWER_SHARE))
            whole = _shingles(term[a:b])
            if b - a < 2 * split:
                self.parts.append((whole,) * 3)
            else:
                parts = (_shingles(term[a : b - split]), _shingles(term[b - split : b]))
                self.parts.append((*parts, whole))

    def retrieve(self, passage: np.ndarray, term: np.ndarray, passages: int):
        """``(passage, item, score)`` of all pairs that reach the threshold.

        ``passage`` is sorted, with distinct terms. As in block-max WAND, a passage whose
        list maxima cannot reach the threshold is left, then a block of items whose block
        maxima cannot; only the items of blocks that stay are scored.
        """
        bound = np.bincount(passage, weights=self.term_max[term], minlength=passages)
        live = bound[passage] >= THRESHOLD
        passage, term = passage[live], term[live]
        entry = np.repeat(np.arange(len(term)), self.term_cells[term])
        cells = common.ranges(self.term_first[term], self.term_cells[term])
        pair = passage[entry] * self.blocks + self.cell[cells] % self.blocks
        order = np.argsort(pair, kind="stable")
        pair, cells = pair[order], cells[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        sizes = np.diff(np.append(first, len(pair)))
        upper = np.add.reduceat(self.cell_max[cells], first) if len(first) else np.zeros(0)
        stays = np.repeat(upper >= THRESHOLD - 1e-9, sizes)
        pair, cells = pair[stays], cells[stays]
        owner = np.repeat(pair // max(1, self.blocks), self.cell_size[cells])
        posting = common.ranges(self.cell_start[cells], self.cell_size[cells])
        key = owner * max(1, len(self.ids)) + self.item[posting]
        found, where = np.unique(key, return_inverse=True)
        score = np.bincount(where, weights=self.impact[posting], minlength=len(found))
        good = score >= THRESHOLD - 1e-9
        at, item = np.divmod(found[good], max(1, len(self.ids)))
        return at, item, score[good]

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
        """``(text, item, score, question share, answer share)`` of verified pairs.

        Passages are windows of two strides; a stride is a quarter longer than the longest
        item, so every copy of an item lies in one of them.
        """
        if not self.longest:
            return
        words, counts = words_in(texts)
        term = np.asarray(
            pc.fill_null(pc.index_in(words, value_set=self.terms), -1), dtype=np.int64
        )
        stride = self.longest + -(-self.longest // 4)
        starts = common.starts_of(counts)
        text = np.repeat(np.arange(len(counts)), counts)
        halves = -(-counts // stride)
        half_first = common.starts_of(halves + 1)
        half = half_first[text] + (np.arange(len(term)) - starts[text]) // stride
        known = term >= 0
        half_of_text = np.repeat(np.arange(len(counts)), halves + 1)
        total = int((halves + 1).sum())
        # Window h holds the strides h - 1 and h of its text; the first holds one.
        size = max(1, len(self.terms))
        keys = np.unique(half[known] * size + term[known])
        both = np.unique(np.concatenate([keys, keys + size]))
        at, item, score = self.retrieve(both // size, both % size, total)
        best: dict[tuple[int, int], tuple] = {}
        shown, ids, have = -1, term[:0], set()
        for h, i, s in zip(at.tolist(), item.tolist(), score.tolist()):
            t = int(half_of_text[h])
            if h != shown:
                stop = (h - int(half_first[t]) + 1) * stride
                low, high = max(0, stop - 2 * stride), min(int(counts[t]), stop)
                ids = term[starts[t] + low : starts[t] + high]
                shown, have = h, _shingles(ids) if len(ids) >= SHINGLE else set()
            shares = [self._share(part, ids, have) for part in self.parts[i]]
            if shares[2] >= OVERLAP or min(shares[:2]) >= OVERLAP:
                best[t, i] = max(best.get((t, i), (0.0,)), (s, *shares[:2]))
        for (t, i), (s, question, answer) in sorted(best.items()):
            yield t, i, s, question, answer

    @staticmethod
    def _share(part: set, ids: np.ndarray, have: set) -> float:
        """Share of an item's shingles that a passage holds."""
        run = len(next(iter(part))) if part else SHINGLE
        if run < SHINGLE:
            listed = ids.tolist()
            have = {tuple(listed[j : j + run]) for j in range(len(listed) - run + 1)}
        return len(part & have) / len(part) if part else 1.0


def indexes(items: DataFrame, id_col: str = "item_id") -> Iterator[Index]:
    """Indexes over all items, each of bounded size.

    Null or empty texts match nothing. An item without an id is one like any other, under null.
    """
    rows = items.select(
        F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")
    )
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for row in rows.where("text <> ''").orderBy("id", "text").toLocalIterator():
        ids.append(row["id"])
        texts.append(row["text"])
        size += len(texts[-1]) + 64
        if size >= INDEX_BYTES:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
    yield Index(ids, texts)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)`` of all leaks.

    Every passage of every whole text is a query. A leak reaches ``THRESHOLD`` of the item's
    own BM25 score, and the same passage holds ``OVERLAP`` of the five-word shingles of the
    whole item, or of its question and of its answer each. A null or empty text has no leaks;
    repeated rows repeat them; without items or documents there are none. An item with a text
    but no id is reported under null. Only id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = (
        "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    )
    found = None
    for index in indexes(items):
        task = _finder(docs.sparkSession.sparkContext.broadcast(index))
        part = rows.mapInArrow(common.lean(task), schema)
        found = part if found is None else found.union(part)
    return found


def _finder(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids = part.column("doc_id")
                hits = list(index.value.leaks(part.column("text")))
                if not hits:
                    continue
                text, item, score, question, answer = map(list, zip(*hits))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(text)),
                        index.value.ids.take(pa.array(item)),
                        pa.array(score),
                        pa.array(question),
                        pa.array(answer),
                    ],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

    return run


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs``, as they are, that hold no leak of an item."""
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("text").cast("string").alias("text"),
    )
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.slices(batch, "text"):
                    clean = np.ones(part.num_rows, dtype=bool)
                    clean[[t for t, *_ in sent.value.leaks(part.column("text"))]] = False
                    yield part.filter(pa.array(clean))

        packed = packed.mapInArrow(common.lean(run), packed.schema)
    return packed.select("row.*")
