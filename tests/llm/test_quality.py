import re
from collections import Counter

import numpy as np
from kinsheet.llm import quality, queries

from llm_helpers import split


def brute(text):
    words = split(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    earlier, repeated = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            repeated += line in earlier
            earlier.add(line)
    symbols = len(re.findall("[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


def check(rows, found):
    got = Counter((r["doc_id"], *(r[c] for c in quality.BASE)) for r in found)
    assert got == Counter((i, *brute(t)) for i, t in rows)
    for r in found:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_query(spark, sf_dir, documents):
    found = queries.op8_quality(spark, sf_dir).collect()
    check([(r["doc_id"], r["text"]) for r in documents.collect()], found)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [r["kept"] for r in found if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(clean) >= 0.97 * len(clean)


def test_odd_rows(odd_docs, odd_rows):
    check([(i, t) for i, t, *_ in odd_rows], quality.judge(odd_docs).collect())


def test_no_rows(no_docs):
    assert quality.judge(no_docs).count() == 0


def test_votes_are_weighed():
    """Nine in ten rows are good; a rule that is often wrong counts for less."""
    rng = np.random.default_rng(0)
    n, rules = 4000, len(quality.RULES)
    good = rng.random(n) < 0.9
    right = np.array([0.95] * (rules - 1) + [0.55])
    given = np.where(rng.random((n, rules)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    given[rng.random((n, rules)) < 0.2] = 0
    pattern, inverse, count = np.unique(given, axis=0, return_inverse=True, return_counts=True)
    found = quality.fit_votes(pattern, count.astype(float))[inverse.ravel()]
    assert ((found >= 0.5) == good).mean() > 0.98
    assert (quality._unpack(quality._pattern(given)) == given).all()
