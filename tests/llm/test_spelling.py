import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from kinsheet.llm import queries, spelling

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if n >= 3 and len(w) >= 5}


def edit_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_by_deletion(words):
    """Near pairs of distinct words: some deletion of each is the same, then compared."""
    met = defaultdict(set)
    for w in words:
        for short in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            met[short].add(w)
    near = defaultdict(set)
    for group in met.values():
        for a in group:
            near[a] |= {b for b in group if edit_apart(a, b)}
    return near


def grouped(n):
    near = near_by_deletion(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def check(found, n):
    rows = found.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(rows) == len(got)
    assert got == grouped(n)


def test_query(spark, sf_dir, documents):
    n = counted((r["doc_id"], r["text"]) for r in documents.collect())
    found = queries.op13_spelling(spark, sf_dir)
    check(found, n)
    assert sum(f is not None for f, *_ in grouped(n).values()) > 10


def test_odd_rows(odd_docs, odd_rows):
    for piece in (spelling.PIECE_CHARS, 5000):
        words = spelling.word_counts(odd_docs, piece_chars=piece)
        got = {r["word"]: r["n"] for r in words.collect()}
        assert got == counted((i, t) for i, t, *_ in odd_rows)
    check(spelling.group_variants(words), got)


def test_runs_longer_than_pieces(spark):
    text = "ab " + "x" * 500 + "ÄBC×" + "y" * 90 + " . " + "words here " * 40
    docs = spark.createDataFrame([(i, text[i:]) for i in range(40)], "doc_id long, text string")
    for piece in (1, 8, 33, 1000):
        words = spelling.word_counts(docs, piece_chars=piece)
        assert {r["word"]: r["n"] for r in words.collect()} == counted(
            (i, text[i:]) for i in range(40)
        )


def random_words(seed, count, letters="abc", low=2, high=9):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(low, high))): rng.randint(1, 40) for _ in range(count)}


@pytest.mark.parametrize("block", [spelling.BLOCK_CHARS, 300, 40])
def test_parts_of_hot_halves(spark, block):
    """Small alphabets make halves that many words share; small blocks cut them into cells."""
    n = random_words(block, 400)
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    check(spelling.group_variants(words, block_chars=block), n)


def test_long_and_wide_words(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("ab", k=5000))
    n = {long: 9, long[:77] + long[78:]: 4, long + "a": 2, "b" + long: 1, "aaaaaaaa": 8, "aaaaaaa": 4}
    n |= {"\U0001f600中ÿÀz": 3, "\U0001f600中ÿÀ": 7, "\U00010000x": 1}
    n |= {"same": 4, "same\U00010000": 4, "sames": 1}  # code points, not UTF-16, break ties
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    check(spelling.group_variants(words), n)


def test_repeated_and_null_words(spark, no_docs):
    rows = [("house", 1), ("house", 2), ("hause", 9), (None, 4), ("mouse", None), ("", 3), ("x", 1)]
    words = spark.createDataFrame(rows, "word string, n long")
    found = {r["word"]: r for r in spelling.group_variants(words).collect()}
    assert set(found) == {"house", "hause", "", "x"}
    assert found["house"]["n"] == 3 and found["house"]["form"] == "hause"
    assert spelling.group_variants(spelling.word_counts(no_docs)).count() == 0


def test_intervals_of_both_directions():
    """Extending either way, both intervals have as many ranks as the text has occurrences."""
    words = sorted(random_words(5, 60, low=5))
    index = spelling.Vocabulary(words)
    text = "$" + "$".join(words) + "$"
    left, right = index.ranks[False], index.ranks[True]
    for word in words[:20]:
        low = back = np.zeros(1, np.int64)
        high = np.full(1, left.size)
        for at in range(len(word) - 1, -1, -1):
            c = np.searchsorted(index.alphabet, [ord(word[at])]) + 1
            low, high, smaller = left.narrow(low, high, c)
            back = back + smaller
            times = len(re.findall(f"(?={word[at:]})", text))
            assert (high - low == times).all()
        forth, end = np.zeros(1, np.int64), np.full(1, right.size)
        for ch in word:
            forth, end, _ = right.narrow(forth, end, np.searchsorted(index.alphabet, [ord(ch)]) + 1)
        assert (forth == back).all() and (end - forth == high - low).all()
