"""Spelling variants: words one edit apart, found in bidirectional FM-indexes of the vocabulary.

Two words one edit apart share the first or the last half of the shorter one. Words are dealt
by these halves, so that near words meet; what one task holds at a time is a block. A block's
distinct words, delimited, get a Burrows-Wheeler transform in each direction, both in wavelet
matrices. A query matches one half exactly from the word's middle to its delimiter, which moves
the intervals of suffix ranks of both directions at once, and then turns round: it extends
across the other half with one error, to the delimiter at the other end. There the rank within
the delimiters is the number of the word, so no suffix array is kept.

A half that very many words share is cut into parts, and every part is asked for every other:
blocks stay bounded, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsheet.llm.common import group_starts, ranges, starts_of, whole_groups
from kinsheet.session import materialize

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One occurrence in this many loses a letter, by its hash.
DELETED_ONE_IN = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: How many times as frequent a word's form is.
FORM_FACTOR = 2
#: Code points of a text whose words are listed at once.
PIECE_CHARS = 4 << 20
#: Code points of a block's index; a longer single word is a block of its own.
BLOCK_CHARS = 1 << 20
#: Queries searched at once.
QUERY_ROWS = 4096


# Vocabulary ----------------------------------------------------------------------------------


def _piece(text: Column, number: Column, chars: int) -> Column:
    """The runs that begin in a piece: without the end of an earlier one, the last one whole."""
    start = number * chars + 1
    own = F.substring(text, start, F.lit(chars))
    continued = (number > 0) & F.substring(text, start - 1, F.lit(1)).rlike(f"[{LETTERS}]")
    own = F.when(continued, F.regexp_replace(own, f"^[{LETTERS}]+", "")).otherwise(own)
    after = F.substring(text, start + chars, F.lit(chars))
    rest = F.regexp_extract(after, f"^[{LETTERS}]+", 0)
    farther = F.substring(text, start + chars, F.length(text))
    farther = F.regexp_extract(farther, f"^[{LETTERS}]+", 0)
    rest = F.when(F.length(rest) < chars, rest).otherwise(farther)
    return F.when(own.rlike(f"[{LETTERS}]\\z"), F.concat(own, rest)).otherwise(own)


def word_counts(
    docs: DataFrame, *, least_count: int = LEAST_COUNT, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """``(word, n)``: distinct words and their occurrences in whole texts.

    Words are runs of Latin letters, A-Z in lower case; the occurrence whose hash with its
    ``doc_id`` says so has lost a letter. Null and empty texts have none; a null ``doc_id``
    counts as an empty one in the hash; repeated rows count each. Long texts are read in pieces
    that cut no run. Counts are folded before the shuffle, so a frequent word is no hot key.
    """
    text = F.col("text").cast("string")
    whole = F.length(text) <= piece_chars
    numbers = F.sequence(F.lit(0), F.ceil(F.length(text) / piece_chars).cast("int") - 1)
    pieces = F.when(whole, F.array(text)).otherwise(
        F.transform(numbers, lambda k: _piece(text, k, piece_chars))
    )
    found = docs.where(F.length(text) >= LEAST_LENGTH).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(pieces).alias("piece"),
    )
    run = F.regexp_extract_all("piece", F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    found = found.select("id", F.explode(run).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    lowered = F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    hashed = F.crc32(F.concat("id", F.lit(":"), "run"))
    found = found.withColumn("run", lowered).withColumn("h", hashed)
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(
        F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))
    )
    word = F.when(F.col("h") % DELETED_ONE_IN == 0, shorter).otherwise(F.col("run"))
    counted = found.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
    counted = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


# Index ---------------------------------------------------------------------------------------


def transform(codes: list[np.ndarray]) -> np.ndarray:
    """Burrows-Wheeler transform of sorted distinct words, each ended by the delimiter 0.

    The text is a ring. The delimiter before word ``k`` ranks ``k``-th among the delimiters, as
    the word does among the words' beginnings, so ranks carry over from last to first column.
    """
    count = len(codes)
    ends = np.cumsum([len(c) + 1 for c in codes]) - 1
    size = int(ends[-1]) + 1
    text = np.zeros(size, dtype=np.int64)
    inside = np.ones(size, dtype=bool)
    inside[ends] = False
    text[inside] = np.concatenate(codes)
    rank = text + count
    rank[ends] = (np.arange(count) + 1) % count
    step, base = 1, max(size, int(rank.max())) + 1
    while True:
        key = rank * base + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        if rank[order[-1]] == size - 1:
            return text[order - 1]
        step *= 2


class Ranks:
    """A transform as a wavelet matrix: intervals of suffix ranks grow by one character."""

    def __init__(self, codes: np.ndarray, sigma: int):
        self.codes, self.size, self.sigma = codes.astype(np.int32), len(codes), sigma
        self.depth = max(1, int(sigma).bit_length())
        self.words, self.before, self.zeros = [], [], []
        row = codes
        for level in range(self.depth):
            bits = ((row >> (self.depth - 1 - level)) & 1).astype(bool)
            packed = np.zeros(self.size // 64 + 1, dtype=np.uint64)
            some = np.packbits(bits, bitorder="little")
            packed.view(np.uint8)[: len(some)] = some
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(self.size - int(ones.sum()))
            row = np.concatenate([row[~bits], row[bits]])
        counts = np.bincount(codes, minlength=sigma + 1)
        every = np.arange(sigma + 1)
        self.shift = np.zeros(sigma + 1, dtype=np.int64)
        leaf, _, _ = self.narrow(np.zeros_like(every), np.zeros_like(every), every)
        self.shift = starts_of(counts) - leaf

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & low)

    def narrow(self, low: np.ndarray, high: np.ndarray, code: np.ndarray):
        """Intervals after one more character, and how many entries of the old are smaller."""
        smaller = np.zeros(len(low), dtype=np.int64)
        for level in range(self.depth):
            one = ((code >> (self.depth - 1 - level)) & 1).astype(bool)
            a, b = self._ones(level, low), self._ones(level, high)
            smaller += np.where(one, (high - b) - (low - a), 0)
            low = np.where(one, self.zeros[level] + a, low - a)
            high = np.where(one, self.zeros[level] + b, high - b)
        return low + self.shift[code], high + self.shift[code], smaller

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(interval, code)`` of the letters that extend each interval, some in vain."""
        few = high - low <= self.sigma
        size = np.where(few, high - low, self.sigma)
        owner = np.repeat(np.arange(len(low)), size)
        at = ranges(np.where(few, low, 0), size)
        listed = np.repeat(few, size)
        code = np.where(listed, self.codes[np.where(listed, at, 0)], at + 1)
        both = np.unique(owner * (self.sigma + 1) + code)
        owner, code = np.divmod(both, self.sigma + 1)
        return owner[code > 0], code[code > 0]


def _encoded(words: list[str]) -> list[np.ndarray]:
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    return np.split(flat, np.cumsum([len(w) for w in words])[:-1])


class Vocabulary:
    """Transforms of distinct words in both directions; searches give word numbers."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        codes = _encoded(self.words)
        self.alphabet = np.unique(np.concatenate(codes))
        codes = [np.searchsorted(self.alphabet, c) + 1 for c in codes]
        back = sorted(range(len(words)), key=lambda i: self.words[i][::-1])
        self.numbers = {False: np.arange(len(words)), True: np.array(back)}
        sigma = len(self.alphabet)
        self.ranks = {
            False: Ranks(transform(codes), sigma),
            True: Ranks(transform([codes[i][::-1] for i in back]), sigma),
        }

    def near(self, asked: list[str], half: np.ndarray, last: bool):
        """``(query, word)`` numbers of words one edit away that share a half with a query.

        The half is the first ``half`` code points, or the ``last`` ones; the error is in the
        rest. A pair may come twice.
        """
        found_q, found_w = [], []
        for a in range(0, len(asked), QUERY_ROWS):
            part = [w[::-1] for w in asked[a : a + QUERY_ROWS]] if last else asked[a : a + QUERY_ROWS]
            q, at = self._search(part, half[a : a + QUERY_ROWS], self.ranks[last], self.ranks[not last])
            found_q.append(q + a)
            found_w.append(self.numbers[not last][at])
        return np.concatenate(found_q), np.concatenate(found_w)

    def _search(self, asked: list[str], half: np.ndarray, left: Ranks, right: Ranks):
        length = np.array([len(w) for w in asked])
        flat = np.frombuffer("\0".join([*asked, ""]).encode("utf-32-le"), dtype=np.uint32)
        place = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        # A letter that the block lacks is -1 and matches nothing; the delimiter stays 0.
        code = np.where(self.alphabet[place] == flat, place + 1, np.where(flat == 0, 0, -1))
        begin = starts_of(length + 1)

        # One half, from its inner end to the delimiter; `turn` is the interval the other way.
        q = np.arange(len(asked))
        low, high = np.zeros(len(q), np.int64), np.full(len(q), left.size, dtype=np.int64)
        turn = np.zeros(len(q), np.int64)
        done = []
        for step in range(int(half.max()) + 1):
            c = np.where(step < half[q], code[begin[q] + np.maximum(half[q] - 1 - step, 0)], 0)
            known = c >= 0
            q, low, high, turn, c = (v[known] for v in (q, low, high, turn, c))
            low, high, smaller = left.narrow(low, high, c)
            turn = turn + smaller
            ended, alive = step == half[q], low < high
            done.append([v[ended & alive] for v in (q, turn, turn + high - low)])
            q, low, high, turn = (v[alive & ~ended] for v in (q, low, high, turn))

        # Across the other half with one error: `q` has none so far, `eq` has had it.
        q, low, high = (np.concatenate(v) for v in zip(*done))
        at = half[q]
        eq, elow, ehigh, eat = (np.zeros(0, np.int64) for _ in range(4))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(q) or len(eq):
            own = code[begin[q] + at]  # the delimiter behind the last letter
            i, c = right.children(low, high)
            clow, chigh, _ = right.narrow(low[i], high[i], c)
            some = clow < chigh
            i, c, clow, chigh = i[some], c[some], clow[some], chigh[some]
            inside = at < length[q]
            replaced = (c != own[i]) & inside[i]
            spawned = [
                (q[inside], low[inside], high[inside], at[inside] + 1),  # a letter less
                (q[i], clow, chigh, at[i]),  # a letter more
                (q[i][replaced], clow[replaced], chigh[replaced], at[i][replaced] + 1),
            ]
            on = (c == own[i]) & inside[i]
            q, low, high, at = q[i][on], clow[on], chigh[on], at[i][on] + 1

            c = code[begin[eq] + eat]
            known = c >= 0
            eq, elow, ehigh, eat, c = (v[known] for v in (eq, elow, ehigh, eat, c))
            elow, ehigh, _ = right.narrow(elow, ehigh, c)
            alive = elow < ehigh
            ended = alive & (c == 0)
            found.append((eq[ended], elow[ended]))
            going = (eq, elow, ehigh, eat + 1)
            going = tuple(v[alive & ~ended] for v in going)
            eq, elow, ehigh, eat = (np.concatenate(v) for v in zip(going, *spawned))
        return tuple(np.concatenate(v) for v in zip(*found))


# Pairs ---------------------------------------------------------------------------------------


def _blocks(table: pa.Table, chars: int) -> Iterator[pa.Table]:
    """Runs of whole groups with at most ``chars`` code points each, or one group."""
    starts = group_starts(table, ["key", "i", "j"])
    size = np.cumsum(pc.utf8_length(table["word"]).to_numpy().astype(np.int64) + 1)
    ends = np.append(starts[1:], table.num_rows)
    first = 0
    while first < len(starts):
        base = size[starts[first] - 1] if starts[first] else 0
        stop = max(first + 1, int(np.searchsorted(size[ends - 1], base + chars, side="right")))
        yield table.slice(starts[first], ends[stop - 1] - starts[first])
        first = stop


def _pairs_of(block: pa.Table) -> pa.RecordBatch:
    held = block.filter(block["indexed"])
    count = dict(zip(held["word"].to_pylist(), held["n"].to_pylist()))
    words: list[str] = []
    near: list[str] = []
    index = Vocabulary(list(count)) if count else None
    for last in (False, True):
        asks = block.filter(pc.and_(block["asks"], pc.equal(block["last"], last)))
        if index and asks.num_rows:
            asked = asks["word"].to_pylist()
            q, w = index.near(asked, asks["half"].to_numpy(), last)
            both = np.unique(q * len(index.words) + w)
            words += [asked[i] for i in (both // len(index.words)).tolist()]
            near += [index.words[i] for i in (both % len(index.words)).tolist()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(words, pa.string()),
            pa.array(near, pa.string()),
            pa.array([count[w] for w in near], pa.int64()),
        ],
        ["word", "near", "near_n"],
    )


def near_words(words: DataFrame, *, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(word, near, near_n)``, all pairs of words one edit apart, in both orders; some twice.

    ``words`` has distinct ``word`` of two code points or more with its count ``n``.
    """
    length = F.length("word")
    # A pair shares half of the shorter word's length, and that may be the other one's.
    halves = F.array_distinct(F.array((length / 2).cast("int"), ((length - 1) / 2).cast("int")))
    asked = words.select("word", "n", F.explode(halves).alias("half")).where("half > 0")
    asked = asked.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("last"))
    shared = F.when(
        F.col("last"), F.substring("word", length - F.col("half") + 1, F.col("half"))
    ).otherwise(F.substring("word", F.lit(1), F.col("half")))
    asked = asked.withColumn("key", F.xxhash64("last", shared))
    large = asked.groupBy("key").agg(F.sum(length + 1).alias("chars"))
    large = large.where(F.col("chars") > block_chars)
    large = large.select("key", F.ceil(F.col("chars") / block_chars).cast("int").alias("parts"))
    split = asked.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))

    def cell(i: Column, j: Column, indexed: bool, asks: bool) -> Column:
        flags = F.lit(indexed).alias("indexed"), F.lit(asks).alias("asks")
        return F.struct(i.alias("i"), j.alias("j"), *flags)

    own = F.col("own")
    cells = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda p: F.when(p == own, F.array(cell(own, own, True, True))).otherwise(
                F.array(cell(own, p, True, False), cell(p, own, False, True))
            ),
        )
    )
    dealt = split.select("key", "word", "n", "half", "last", F.inline(cells))
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "i", "j"]):
            for block in _blocks(table, block_chars):
                yield _pairs_of(block)

    return dealt.mapInArrow(run, "word string, near string, near_n long")


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: every word takes its root's root until none moves.

    Counts at least double from a word to its form, so chains are short and have no rings.
    """
    links = materialize(links.select("word", F.col("form").alias("root")))
    while True:
        after = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(
            links.join(after, "root", "left").select(
                "word",
                F.coalesce("next", "root").alias("root"),
                F.col("next").isNotNull().alias("moved"),
            )
        )
        links = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return links


def group_variants(words: DataFrame, *, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row a word of ``words`` ``(word, n)``.

    ``form`` is the most frequent word one edit away (ties: the smallest) if it has at least
    twice the occurrences, else null; ``root`` the last form of the chain, the word itself
    without one. Counts of equal words are added up; null words and null counts go; words under
    two code points have no near words. An empty table gives no rows.
    """
    known = words.select("word", "n").where("word IS NOT NULL AND n IS NOT NULL")
    known = materialize(known.groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    pairs = near_words(known, block_chars=block_chars)
    none = F.lit(None)
    rows = known.select(
        "word", none.cast("string").alias("near"), none.cast("long").alias("near_n"), "n"
    ).unionByName(pairs.withColumn("n", none.cast("long")))
    # One shuffle: a word has few near words, and both foldings are by word.
    single = rows.repartition("word").groupBy("word", "near", "near_n").agg(F.max("n").alias("n"))
    found = single.groupBy("word").agg(
        F.max("n").alias("n"),
        F.count("near").alias("n_near"),
        F.min(F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), "near"))).alias("best"),
    )
    form_n = -F.col("best.col1")
    frequent = form_n >= FORM_FACTOR * F.col("n")
    found = materialize(
        found.select(
            "word",
            F.when(frequent, F.col("best.near")).alias("form"),
            "n",
            "n_near",
            F.when(frequent, form_n).alias("form_n"),
        )
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
