"""Token-id files: documents in id order, grammar-compressed in shards.

A file is a Parquet table with one row a shard. A shard holds whole documents:

    part, shard      order of the shards (part first)
    doc_id           ids of its documents, in order
    n_tokens         ids of each document, with the end id
    n_symbols        symbols of each document after compression
    base             smallest nonterminal; lower symbols are token ids
    rounds           number of rules made in each round
    rules            pairs of symbols, little-endian u4; rule i makes symbol base + i
    lengths          ids that each rule expands to, little-endian u4
    width, symbols   the sequence, little-endian unsigned of ``width`` bytes
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsheet.llm import common

#: Ids after which a shard is closed; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 18
#: Text bytes encoded at once: the more, the fewer words are looked up again.
SLICE_BYTES = 9 << 20
#: A round replaces the pairs at least this share as frequent as its most frequent one.
ROUND_SHARE = 1 / 64
#: A rule is two symbols and a length, an occurrence saves one symbol: the fourth one pays.
LEAST_PAIRS = 4
#: Ids up to which a rule's expansion is written out for decoding.
SHORT_RULE = 64
#: Pieces of words, and as many words that are encoded whole, whose ids a worker remembers.
WORDS_KEPT = 1 << 20
#: Pieces that are given to the tokenizer's model at once.
LEARNT_PIECES = 1 << 14
#: Words whose ids are put in place at once.
PLACED_WORDS = 1 << 17

SCHEMA = (
    "part int, shard int, doc_id array<bigint>, n_tokens array<bigint>, n_symbols array<bigint>, "
    "base int, rounds array<int>, rules binary, lengths binary, width int, symbols binary"
)


# Word pieces ---------------------------------------------------------------------------------

#: The tokenizer's own rule for pieces, for texts of the first 256 code points: runs of letters,
#: single digits and runs of other signs; white space falls out. Fixed values.
SPACE, LETTER, DIGIT, OTHER = range(4)
KINDS = ((SPACE, "[\t-\r \x85\xa0]"), (LETTER, "[a-zªµºß-öø-ÿ]"), (DIGIT, "[0-9²³¹¼-¾]"), (OTHER, "."))
#: An apostrophe that begins a run takes these letters with it.
ONE_LETTER, TWO_LETTERS = b"stmd", (b"re", b"ve", b"ll")


def _lower_and_kind() -> tuple[np.ndarray, np.ndarray]:
    """Small letter and kind of each of the first 256 code points."""
    low = [chr(c).lower() for c in range(256)]
    kind = [next(k for k, rule in KINDS if re.match(rule, x, re.S)) for x in low]
    return np.array(list(map(ord, low)), dtype=np.uint8), np.array(kind, dtype=np.uint8)


LOWER, KIND = _lower_and_kind()


def _byte_letters() -> str:
    """How byte-level vocabularies write each byte; the space stays, it parts pieces."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    letters = [chr(b if b in plain else next(others)) for b in range(256)]
    letters[ord(" ")] = " "
    return "".join(letters)


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of words end to end, and the place of each word's first byte and of the end."""
    _, edges, data = words.cast(pa.string()).buffers()
    edges = np.frombuffer(edges, dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def cut_pieces(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces, in small letters, of words of the first 256 code points; number of each word's."""
    data, edges = _bytes_of(words)
    size = len(data)
    text = np.zeros(size + 2, dtype=np.uint8)
    text[:size] = data
    wide = np.flatnonzero(text >= 0xC2)
    code = ((text[wide] & 3) << 6) | (text[wide + 1] & 0x3F)
    text, kind = LOWER[text], KIND[text]
    text[wide], text[wide + 1] = 0xC0 | (LOWER[code] >> 6), 0x80 | (LOWER[code] & 0x3F)
    kind[wide] = kind[wide + 1] = KIND[code]
    word = np.ones(size + 3, dtype=bool)
    word[:size] = False
    word[edges] = True
    begins = word.copy()
    begins[1:size] |= kind[1:size] != kind[: size - 1]
    begins[:size] |= (kind[:size] == DIGIT) & (text[:size] & 0xC0 != 0x80)
    at = np.flatnonzero((text[:size] == ord("'")) & begins[:size])
    at = at[~word[at + 1]]
    one = np.isin(text[at + 1], np.frombuffer(ONE_LETTER, dtype=np.uint8))
    two = np.zeros(len(at), dtype=bool)
    for a, b in TWO_LETTERS:
        two |= (text[at + 1] == a) & (text[at + 2] == b) & ~word[at + 2]
    begins[at[one | two] + 1] = False
    begins[at[one] + 2] = begins[at[two] + 3] = True
    stays = kind[:size] != SPACE
    begins = begins[:size] & stays
    count = np.concatenate([[0], np.cumsum(begins)])[edges]
    if not stays.all():
        begins, text = begins[stays], text[:size][stays]
        size = len(begins)
    starts = np.append(np.flatnonzero(begins), size).astype(np.int32)
    buffers = [None, pa.py_buffer(starts), pa.py_buffer(text)]
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, buffers), np.diff(count)


class Remembered:
    """Ids of strings: what was asked for lately stays, in two generations."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def find(self, names: list, most: int, learn) -> list[bytes]:
        """Ids of distinct ``names``; ``learn`` makes those of the names not remembered."""
        if len(self.young) > most // 2:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, names))
        lost = [i for i, ids in enumerate(found) if ids is None]
        if lost:
            asked = [names[i] for i in lost]
            older = list(map(self.old.get, asked))
            new = iter(learn([name for name, ids in zip(asked, older) if ids is None]))
            parts = [next(new) if ids is None else ids for ids in older]
            self.young.update(zip(asked, parts))
            for i, ids in zip(lost, parts):
                found[i] = ids
        return found


def _pool(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids end to end, and the number of each part's."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.frombuffer(b"".join(parts), dtype="<u4"), sizes


class WordEncoder:
    """Ids of white-space separated words; those of their pieces are remembered between batches.

    The tokenizer splits at white space and handles each part by itself, so the ids of a text
    are those of its words. Words of Latin letters are cut into pieces here and go straight to
    the tokenizer's model; all others, and words with its marker strings, go through it whole.
    """

    def __init__(self, tokenizer_file: str, words_kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(tokenizer_file)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.vocabulary = self.whole.get_vocab_size()
        self.letters = _byte_letters()
        self.markers = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words_kept = words_kept
        self.words, self.pieces = Remembered(), Remembered()
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        self.ends_piece = np.zeros(self.vocabulary, dtype=bool)
        if suffix:
            self.ends_piece[[i for t, i in self.model.get_vocab().items() if t.endswith(suffix)]] = True

    def _learn_pieces(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Ids of pieces by the tokenizer's model, which reads them as one text with spaces."""
        for start in range(0, len(pieces), LEARNT_PIECES):
            some = pieces[start : start + LEARNT_PIECES]
            text = codecs.charmap_decode(b" ".join(some), "strict", self.letters)[0]
            ids = self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids
            ids = np.array(ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_piece[ids]) + 1
            if len(ends) != len(some):  # a model that does not mark the end of a piece
                owner = self.model.encode(text, add_special_tokens=False).word_ids
                ends = np.cumsum(np.bincount(np.array(owner, dtype=np.int64), minlength=len(some)))
            data, ends = ids.tobytes(), (4 * ends).tolist()
            yield from map(data.__getitem__, map(slice, [0, *ends], ends))

    def _learn_words(self, words: list[str]) -> Iterator[bytes]:
        for coded in self.whole.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(coded.ids, dtype="<u4").tobytes()

    def _latin(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, count = cut_pieces(words)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, sizes = _pool(self.pieces.find(distinct, self.words_kept, self._learn_pieces))
        index = coded.indices.to_numpy()
        each = sizes[index]
        before = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(count)
        return ids[common.ranges(common.starts_of(sizes)[index], each)], before[ends] - before[ends - count]

    def _ids(self, words: pa.Array, marked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pool, first, size)``: ids of distinct words, and where in them each word's are."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, edges = _bytes_of(words)
        plain = np.maximum.reduceat(data, edges[:-1]) < 0xC4
        if marked:
            for marker in self.markers:
                plain &= ~np.asarray(pc.match_substring(words, marker))
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        pools = []
        if plain.any():
            ids, size[plain] = self._latin(words.filter(pa.array(plain)))
            pools.append(ids)
        first[plain] = common.starts_of(size[plain])
        if not plain.all():
            rest = words.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist()
            ids, size[~plain] = _pool(self.words.find(rest, self.words_kept, self._learn_words))
            first[~plain] = common.starts_of(size[~plain]) + sum(map(len, pools))
            pools.append(ids)
        return np.concatenate(pools), first, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each text."""
        # Case folding makes fewer distinct words. It could make a marker string of another one.
        marked = any(
            pc.any(pc.match_substring(texts, m, ignore_case=True)).as_py() for m in self.markers
        )
        flat, counts = common.split_words(texts if marked else pc.ascii_lower(texts))
        coded = flat.dictionary_encode()
        pool, first, sizes = self._ids(coded.dictionary, marked)
        del flat
        index = coded.indices.to_numpy()
        each = sizes[index].astype(np.int32)
        before = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        ids = np.empty(int(before[-1]), dtype=np.uint32)
        for start in range(0, len(index), PLACED_WORDS):
            stop = min(start + PLACED_WORDS, len(index))
            at = common.ranges(first[index[start:stop]], each[start:stop])
            ids[before[start] : before[stop]] = pool[at]
        ends = np.cumsum(counts)
        return ids, before[ends] - before[ends - counts]


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer_file: str, words_kept: int = WORDS_KEPT) -> WordEncoder:
    """One encoder a worker process, kept between its tasks."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
    _encoders[tokenizer_file].words_kept = words_kept
    return _encoders[tokenizer_file]


# Grammar -------------------------------------------------------------------------------------


def _overlapping(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Every second place of a run of one symbol, of the places ``at`` of pairs of equal ones."""
    first = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(key, prepend=~key[:1]) != 0))
    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return nth % 2 == 1


def _without_overlap(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places left when the pairs are replaced one by one, the smallest rank first."""
    taken = np.zeros(len(at), dtype=bool)
    rest = np.arange(len(at))
    while len(rest):
        meets, r = np.diff(at[rest]) == 1, rank[rest]
        wins = np.ones(len(rest), dtype=bool)
        wins[1:] &= ~(meets & (r[:-1] < r[1:]))
        wins[:-1] &= ~(meets & (r[1:] < r[:-1]))
        gone = wins.copy()
        gone[1:] |= meets & wins[:-1]
        gone[:-1] |= meets & wins[1:]
        taken[rest[wins]] = True
        rest = rest[~gone]
    return taken


def best_pairs(
    seq: np.ndarray, open_: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(pairs, at, which, rare)``: pairs to replace, where, which one, and spent places.

    ``open_`` marks the places that begin a pair. Counts are exact: places whose hash slot has
    too few pairs of any kind are ``rare`` for good, all others are sorted. Equal counts are
    ordered by the hash. Of pairs that share a slot the most frequent is replaced, the others
    wait for the next round, as do pairs whose overlaps with better ones leave too few places.
    """
    where = np.flatnonzero(open_)
    symbols = np.empty((len(where), 2), dtype="<u4")
    symbols[:, 1], symbols[:, 0] = seq[where], seq[1:][where]
    key = symbols.view("<u8").ravel()
    bits = max(12, min(18, len(where).bit_length()))
    shift = np.uint64(64 - bits)
    hashed = key * np.uint64(0x9E3779B97F4A7C15)
    slot = (hashed >> shift).view(np.int64)
    # The places of one pair never overlap.
    same = np.flatnonzero(symbols[:, 0] == symbols[:, 1])
    second = same[_overlapping(key[same], where[same])] if len(same) else same
    bound = np.bincount(slot, minlength=1 << bits)
    bound -= np.bincount(slot[second], minlength=1 << bits) if len(second) else 0
    often = (bound >= LEAST_PAIRS)[slot]
    rare = where[~often]
    often[second] = False
    live = np.flatnonzero(often)
    hashed = hashed[live]
    held = np.sort(hashed)
    edge = np.flatnonzero(held[1:] != held[:-1]) + 1
    edge = np.concatenate([[0], edge, [len(held)]]) if len(held) else edge
    count = np.diff(edge)
    top = int(count.max(initial=0))
    if top < LEAST_PAIRS:
        return key[:0], where[:0], where[:0], rare
    chosen = np.flatnonzero(count >= max(LEAST_PAIRS, top * ROUND_SHARE))
    chosen = chosen[np.argsort(-count[chosen], kind="stable")]
    pair = held[edge[chosen]]
    rank_of = np.full(1 << bits, -1, dtype=np.int32)
    rank_of[(pair >> shift).view(np.int64)[::-1]] = np.arange(len(pair))[::-1]
    rank = rank_of[slot[live]]
    found = np.flatnonzero(rank >= 0)
    found = found[pair[rank[found]] == hashed[found]]
    spot, rank = live[found], rank[found]
    taken = _without_overlap(where[spot], rank)
    taken &= (np.bincount(rank[taken], minlength=len(pair)) >= LEAST_PAIRS)[rank]
    spot, rank = spot[taken], rank[taken]
    used, which = np.flatnonzero(np.bincount(rank, minlength=len(pair))), np.zeros(len(pair), np.int64)
    which[used] = np.arange(len(used))
    pair[rank] = key[spot]
    return pair[used], where[spot], which[rank], rare


def compress(ids: np.ndarray, last: np.ndarray, base: int) -> tuple:
    """Re-Pair in rounds: ``(symbols, last, rules, lengths, rounds)``.

    A round replaces the most frequent pair, wherever it stands, then the others at least
    ``ROUND_SHARE`` as frequent; the end is reached when no pair occurs ``LEAST_PAIRS`` times.
    A pair never gets more frequent (new ones hold a new symbol), so places of rare pairs are
    looked at again only when a neighbour is replaced. ``last`` marks the last id of each
    document; no pair crosses it.
    """
    seq, open_ = ids.astype(np.uint32), ~last
    open_[-1:] = False
    ends = np.flatnonzero(last)
    made: list[np.ndarray] = []
    rounds: list[int] = []
    length = np.ones(base, dtype=np.uint32)
    while True:
        pair, at, which, rare = best_pairs(seq, open_)
        if not len(pair):
            break
        left, right = (pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32)
        made.append(np.stack([left, right], axis=1))
        rounds.append(len(pair))
        seq[at] = (len(length) + which).astype(np.uint32)
        length = np.append(length, length[left] + length[right])
        open_[rare] = False
        stays = np.ones(len(seq), dtype=bool)
        stays[at + 1] = False
        seq, open_ = seq[stays], open_[stays]
        ends -= np.searchsorted(at, ends)
        # Both pairs of a new symbol are new, and so may be frequent.
        at = at - np.arange(len(at))
        open_[at] = True
        open_[at[at > 0] - 1] = True
        open_[ends] = False
        open_[-1:] = False
    last = np.zeros(len(seq), dtype=bool)
    last[ends] = True
    rules = np.concatenate(made) if made else np.zeros((0, 2), np.uint32)
    return seq, last, rules, length[base:], rounds


class Rules:
    """A shard's rules, opened for decoding.

    Short expansions are written out once, end to end, so that a sequence is one gather;
    symbols of longer ones are first replaced by their pairs, from the last round back.
    """

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, base: int, rounds: list[int]):
        self.rules, self.lengths, self.base = rules, lengths.astype(np.int64), base
        self.short = self.lengths <= SHORT_RULE
        self.edges = np.concatenate([[0], np.cumsum(rounds, dtype=np.int64)])
        self.first = common.starts_of(self.lengths * self.short)
        self.pool = np.zeros(int((self.lengths * self.short).sum()), dtype=np.uint32)
        for a, b in zip(self.edges[:-1], self.edges[1:]):
            some = np.flatnonzero(self.short[a:b]) + a
            self.pool[common.ranges(self.first[some], self.lengths[some])] = self._gather(
                rules[some].ravel()
            )

    def _gather(self, seq: np.ndarray) -> np.ndarray:
        """Ids of token ids and symbols of short rules."""
        rule = np.flatnonzero(seq >= self.base)
        number = seq[rule].astype(np.int64) - self.base
        sizes = np.ones(len(seq), dtype=np.int64)
        sizes[rule] = self.lengths[number]
        start = common.starts_of(sizes)
        out = np.empty(int(sizes.sum()), dtype=np.uint32)
        out[start] = seq
        at = common.ranges(start[rule], sizes[rule])
        out[at] = self.pool[common.ranges(self.first[number], sizes[rule])]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Token ids of a run of symbols."""
        seq = symbols.astype(np.uint32)
        for a, b in zip(self.edges[-2::-1], self.edges[:0:-1]):
            if self.short[a:b].all():
                continue
            pair = (seq >= self.base + a) & (seq < self.base + b)
            pair[pair] = ~self.short[seq[pair] - self.base]
            ends = np.cumsum(1 + pair)
            out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
            out[ends[~pair] - 1] = seq[~pair]
            rule = self.rules[seq[pair] - self.base]
            out[ends[pair] - 2], out[ends[pair] - 1] = rule[:, 0], rule[:, 1]
            seq = out
        return self._gather(seq)


class Shard:
    """A stored shard, opened for reading; decodes documents or ranges without the rest."""

    def __init__(self, row: dict):
        self.doc_id = row["doc_id"]
        self.n_tokens = np.asarray(row["n_tokens"], dtype=np.int64)
        self.n_symbols = np.asarray(row["n_symbols"], dtype=np.int64)
        self.base = row["base"]
        self.lengths = np.frombuffer(row["lengths"], dtype="<u4")
        pairs = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
        self.rules = Rules(pairs, self.lengths, self.base, list(row["rounds"]))
        self.symbols = np.frombuffer(row["symbols"], dtype=f"<u{row['width']}")

    def all(self) -> np.ndarray:
        return self.rules.expand(self.symbols)

    def document(self, number: int) -> np.ndarray:
        start = int(self.n_symbols[:number].sum())
        run = self.symbols[start : start + int(self.n_symbols[number])]
        return self.rules.expand(run)

    def range(self, start: int, count: int) -> np.ndarray:
        """``count`` ids of the shard from the id at ``start``: only the symbols they are in."""
        sizes = np.ones(len(self.symbols), dtype=np.int64)
        pair = self.symbols >= self.base
        sizes[pair] = self.lengths[self.symbols[pair] - self.base]
        ends = np.cumsum(sizes)
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, start + count, side="left")) + 1
        ids = self.rules.expand(self.symbols[a:b])
        skip = start - int(ends[a - 1] if a else 0)
        return ids[skip : skip + count]


# Writing and reading -------------------------------------------------------------------------


def _shard(part: int, number: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, base: int):
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(sizes) - 1] = True
    symbols, ends, rules, lengths, rounds = compress(ids, last, base)
    at = np.flatnonzero(ends)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return {
        "part": part,
        "shard": number,
        "doc_id": doc_ids,
        "n_tokens": sizes,
        "n_symbols": np.diff(at, prepend=-1),
        "base": base,
        "rounds": rounds,
        "rules": rules.astype("<u4").tobytes(),
        "lengths": lengths.astype("<u4").tobytes(),
        "width": width,
        "symbols": symbols.astype(f"<u{width}").tobytes(),
    }


ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32())]
    + [(n, pa.list_(pa.int64())) for n in ("doc_id", "n_tokens", "n_symbols")]
    + [("base", pa.int32()), ("rounds", pa.list_(pa.int32())), ("rules", pa.binary())]
    + [("lengths", pa.binary()), ("width", pa.int32()), ("symbols", pa.binary())]
)


def encode_shards(
    docs: DataFrame, tokenizer_file: str, end_id: int, words_kept: int = WORDS_KEPT
) -> DataFrame:
    """Shards of all documents, ordered by ``doc_id`` over ``(part, shard)``.

    A null text is an empty one and gives the end id alone. Null ids come first; repeated rows
    stay, next to each other; texts of one id are in the order of their hashes. An empty table gives no shards. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = common.parallelism(docs.sparkSession)
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        coder = encoder(tokenizer_file, words_kept)
        base = max(coder.vocabulary, end_id + 1)
        doc_ids, sizes, ids, count = [], [], [], 0

        def closed():
            row = _shard(part, number, doc_ids, np.concatenate(sizes), np.concatenate(ids), base)
            return pa.RecordBatch.from_arrays(
                [pa.array([row[f.name]], f.type) for f in ARROW], schema=ARROW
            )

        for batch in batches:
            for piece in common.slices(batch, "text", SLICE_BYTES):
                found, n = coder.encode(piece.column("text"))
                full = np.empty(len(found) + len(n), dtype=np.uint32)
                ends = np.cumsum(n + 1) - 1
                inner = np.ones(len(full), dtype=bool)
                inner[ends] = False
                full[inner], full[ends] = found, end_id
                names, edges = piece.column("doc_id").to_pylist(), np.append(0, np.cumsum(n + 1))
                a = 0
                while a < len(names):
                    full_at = edges[a] + SHARD_TOKENS - count
                    b = min(int(np.searchsorted(edges, full_at)), len(names))
                    doc_ids.extend(names[a:b])
                    sizes.append(n[a:b] + 1)
                    ids.append(full[edges[a] : edges[b]])
                    count += int(edges[b] - edges[a])
                    if count >= SHARD_TOKENS:
                        yield closed()
                        doc_ids, sizes, ids, count = [], [], [], 0
                        number += 1
                    a = b
        if doc_ids:
            yield closed()

    return ordered.mapInArrow(common.lean(run), SCHEMA)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int, words_kept: int = WORDS_KEPT
) -> None:
    """Store the shards; ``words_kept`` trades a worker's memory for encoding words again."""
    encode_shards(docs, tokenizer_file, end_id, words_kept).write.parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """``(part, shard, doc_id, offset, n_tokens, ids_crc32)`` of every stored document.

    ``offset`` counts the ids of the shard before the document; the checksum is over its ids,
    decoded from the file, as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                data = shard.all().astype("<u4").tobytes()
                ends = np.cumsum(shard.n_tokens)
                starts = ends - shard.n_tokens
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["shard"]] * n, pa.int32()),
                        pa.array(shard.doc_id, pa.int64()),
                        pa.array(starts),
                        pa.array(shard.n_tokens),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(
        common.lean(run),
        "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long",
    )


def document_index(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, part, shard)``: ``start`` over the whole output.

    Offsets are summed in two steps: parts (one row a task of the writer), then the shards of
    each part; documents are joined with the offset of their shard.
    """
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = shards.select("part", "shard", total.alias("ids"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("ids"))
    zero = F.lit(0).cast("long")
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), zero).alias("part_start"))
    offsets = sizes.select(
        "part", "shard", F.coalesce(F.sum("ids").over(inside), zero).alias("shard_start")
    ).join(parts, "part")
    return (
        read_documents(shards)
        .join(offsets, ["part", "shard"])
        .select(
            "doc_id",
            (F.col("part_start") + F.col("shard_start") + F.col("offset")).alias("start"),
            "n_tokens",
            "ids_crc32",
            "part",
            "shard",
        )
    )
