import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from kinsheet.llm import queries, tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file())


def expected(tokenizer, rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf_dir, documents, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    found = queries.op1_token_files(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in found) == expected(tokenizer, rows)


def test_odd_rows(spark, odd_docs, odd_rows, tokenizer, tmp_path):
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    path = str(tmp_path / "t")
    tokens.write_tokens(docs, path, queries.tokenizer_file(), 2)
    index = tokens.document_index(spark.read.parquet(path))
    rows = {i: t for i, t, *_ in odd_rows if i is not None}.items()
    assert sorted(tuple(r)[:4] for r in index.collect()) == expected(tokenizer, rows)
    again = str(tmp_path / "all")
    tokens.write_tokens(odd_docs, again, queries.tokenizer_file(), 2)
    index = tokens.document_index(spark.read.parquet(again)).orderBy("start").collect()
    assert [r["doc_id"] for r in index][:2] == [None, None] and len(index) == len(odd_rows)
    assert [r["start"] for r in index] == [0, *np.cumsum([r["n_tokens"] for r in index])[:-1]]


def test_no_rows(spark, no_docs, tmp_path):
    path = str(tmp_path / "t")
    tokens.write_tokens(no_docs, path, queries.tokenizer_file(), 2)
    assert tokens.document_index(spark.read.parquet(path)).count() == 0


def test_words_are_those_of_the_tokenizer(tokenizer):
    rng = random.Random(3)
    letters = "aZé ß'sİΣ9²½ \u0085́中#<|>\n\t-_ñÀ\U0001f600"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(300)]
    texts += ["<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|> x", "don't WE'LL 's", "é ́x"]
    coder = tokens.WordEncoder(queries.tokenizer_file())
    for start in range(0, len(texts), 7):
        part = texts[start : start + 7]
        ids, counts = coder.encode(pa.array(part))
        whole = [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert ids.tolist() == sum(whole, []) and counts.tolist() == [len(w) for w in whole]


class Watched:
    """A tokenizer that notes the pieces it is asked for."""

    def __init__(self, inner):
        self.inner, self.asked = inner, []

    def __getattr__(self, name):
        def call(texts, **options):
            for text in texts:
                self.asked += text.split()
            return getattr(self.inner, name)(texts, **options)

        return call


def test_words_that_come_again_stay_when_many_others_pass(tokenizer):
    rng = random.Random(8)
    often = ["house", "straße", "don't", "x9y"]
    coder = tokens.WordEncoder(queries.tokenizer_file(), words_kept=100)
    coder.model = Watched(coder.model)
    for _ in range(40):
        texts = [" ".join([*often, *("".join(rng.choices("abcdé", k=9)) for _ in range(30))])]
        ids, _ = coder.encode(pa.array(texts))
        assert ids.tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert len(coder.model.asked) > 1000
    assert coder.model.asked.count("house") == 1
    for held in (coder.pieces.young, coder.pieces.old):
        assert len(held) <= 100 // 2 + 40


def test_a_model_that_does_not_mark_ends(tokenizer):
    text = "The house's 42 doors, açaí -- don't''re x\u00a0y " * 3
    coder = tokens.WordEncoder(queries.tokenizer_file())
    coder.ends_piece[:] = False
    ids, counts = coder.encode(pa.array([text, None, text]))
    expected_ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == 2 * expected_ids
    assert counts.tolist() == [len(expected_ids), 0, len(expected_ids)]


def test_pieces_follow_the_rule():
    letters, digits = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
    rule = re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\t-\r \x85\xa0{letters}{digits}]+"
    )
    rng = random.Random(4)
    latin = [chr(c) for c in range(256) if c not in (32, *range(9, 14))]
    some = "'''stmdrevlLx9²é-\xa0"
    words = ["".join(rng.choices(some + rng.choice(latin), k=rng.randint(1, 9))) for _ in range(4000)]
    words += ["".join(rng.choices(latin, k=rng.randint(1, 12))) for _ in range(4000)] + ["\xa0", "'", "'r", "l"]
    pieces, counts = tokens.cut_pieces(pa.array(["cut off", *words])[1:])
    found = [p.decode() for p in pieces.to_pylist()]
    assert found == [p for w in words for p in rule.findall(w.lower())]
    assert counts.tolist() == [len(rule.findall(w.lower())) for w in words]


@pytest.mark.parametrize("kind", ["random", "runs", "empty", "one", "phrases"])
def test_grammar_round_trip(kind):
    rng = np.random.default_rng(5)
    ids = {
        "random": rng.integers(0, 50, 5000),
        "runs": np.zeros(3000, dtype=int),
        "empty": np.zeros(0, dtype=int),
        "one": np.array([7]),
        "phrases": np.concatenate([rng.permutation(np.arange(i, i + 9)) for i in rng.integers(0, 5, 900)]),
    }[kind].astype(np.uint32)
    last = np.zeros(len(ids), dtype=bool)
    last[::97] = True
    last[-1:] = True
    symbols, ends, rules, lengths, rounds = tokens.compress(ids, last, 100)
    assert (tokens.Rules(rules, lengths, 100, rounds).expand(symbols) == ids).all()
    if kind in ("runs", "phrases"):
        assert len(symbols) < 0.8 * len(ids) and len(rules)
    sizes = np.diff(np.flatnonzero(last), prepend=-1)
    shard = tokens.Shard(
        {
            "doc_id": list(range(len(sizes))),
            "n_tokens": sizes,
            "n_symbols": np.diff(np.flatnonzero(ends), prepend=-1),
            "base": 100,
            "rounds": rounds,
            "rules": rules.astype("<u4").tobytes(),
            "lengths": lengths.astype("<u4").tobytes(),
            "width": 4,
            "symbols": symbols.astype("<u4").tobytes(),
        }
    )
    edges = np.cumsum(sizes)
    for n in range(0, len(sizes), 5):
        assert (shard.document(n) == ids[edges[n] - sizes[n] : edges[n]]).all()
    for start in range(0, max(len(ids) - 40, 0), 311):
        assert (shard.range(start, 37) == ids[start : start + 37]).all()


def plain_counts(seq, last):
    """Places of each pair without overlap, read from left to right."""
    counts, free_at = {}, {}
    for i, pair in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist())):
        if not last[i] and free_at.get(pair, 0) <= i:
            counts[pair] = counts.get(pair, 0) + 1
            free_at[pair] = i + 2
    return counts


@pytest.mark.parametrize("seed", range(6))
def test_each_round_takes_the_most_frequent_pair(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    if seed % 3 == 2:
        ids = np.tile(np.arange(400), 7)
    else:
        ids = rng.zipf(1.3, 6000) % (20 if seed % 2 else 90)
    ids = ids.astype(np.uint32)
    last = rng.random(len(ids)) < 0.02
    last[-1] = True
    taken = tokens.best_pairs
    rounds_seen = []

    def watched(seq, open_):
        found = taken(seq, open_)
        rounds_seen.append((seq.copy(), found[0], found[1]))
        return found

    monkeypatch.setattr(tokens, "best_pairs", watched)
    symbols, ends, rules, lengths, rounds = tokens.compress(ids, last, 1000)
    assert (tokens.Rules(rules, lengths, 1000, rounds).expand(symbols) == ids).all()
    assert max(plain_counts(symbols, ends).values(), default=0) < tokens.LEAST_PAIRS
    assert (rules < 1000 + np.arange(len(rules))[:, None]).all()
    edges = np.flatnonzero(last)
    for seq, pairs, at in rounds_seen[:-1]:
        # Ends of documents, from the ids that each symbol stands for.
        sizes = np.where(seq < 1000, 1, lengths[np.maximum(seq, 1000) - 1000])
        marks = np.isin(np.cumsum(sizes) - 1, edges)
        counts = plain_counts(seq, marks)
        best = max(counts.values())
        keys = [(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()]
        assert best in [counts[k] for k in keys] and len(set(keys)) == len(keys)
        assert min(counts[k] for k in keys) >= max(tokens.LEAST_PAIRS, best * tokens.ROUND_SHARE)
        first = max(keys, key=lambda k: counts[k])
        if sum(n == best for n in counts.values()) == 1:
            replaced = sum((int(seq[i]), int(seq[i + 1])) == first for i in at.tolist())
            assert replaced == best


def test_long_rules_and_many_shards(monkeypatch, spark, tmp_path, tokenizer):
    rows = [(i, "a long text that comes again " * (40 * (i % 5)) + str(i)) for i in range(60)]
    monkeypatch.setattr(tokens, "SHARD_TOKENS", 700)
    path = str(tmp_path / "t")
    tokens.write_tokens(
        spark.createDataFrame(rows, "doc_id long, text string"), path, queries.tokenizer_file(), 2
    )
    shards = spark.read.parquet(path)
    assert shards.count() > 3
    index = tokens.document_index(shards).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r) for r in index.collect()) == expected(tokenizer, rows)
