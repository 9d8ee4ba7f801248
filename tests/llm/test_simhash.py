import random
import re

import numpy as np
import pytest
import xxhash
from kinsheet.llm import queries, simhash
from kinsheet.llm.components import connected_components

from llm_helpers import split


def brute_fingerprint(text, shingle):
    words = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = max(len(words) - shingle + 1, 1) if words else 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_classes(prints, radius):
    """Component of each row number."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def check(rows, found, radius=4):
    prints = [brute_fingerprint(t, 4) for _, t in rows]
    classes = brute_classes(prints, radius)
    lowest = {}
    for (i, _), c in zip(rows, classes):
        if i is not None:
            lowest[c] = min(i, lowest.get(c, i))
    expected = [(i, p, lowest.get(c)) for (i, _), p, c in zip(rows, prints, classes)]
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_odd_rows(odd_docs, odd_rows):
    check([(i, t) for i, t, *_ in odd_rows], simhash.near_duplicates(odd_docs))


def test_query(spark, sf_dir, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    found = queries.op6_simhash(spark, sf_dir)
    assert found.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    check(rows, found.selectExpr("doc_id", "cast(conv(fingerprint, 16, -10) as long) fp", "component_id"))


def test_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_first(no_docs).count() == 0


def test_keep_first(odd_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] or 0 for r in kept.collect())
    # 2 copies 1, 4 is near 3, 7 and 5 are like 6 without words, rows without an id all stay
    assert ids == [0, 0, 1, 3, 5, 8, 9, 10, 12, 13, 14, 15, 16] or 11 in ids
    assert 2 not in ids and 6 not in ids and 7 not in ids and ids.count(3) == 1


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_forest_is_all_links(radius):
    rng = random.Random(radius)
    values = []
    for _ in range(40):
        seed = rng.getrandbits(64)
        values += [seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(7)]
    values = np.unique(np.array(values, dtype=np.uint64))
    label = simhash.forest(values, np.array([0]), radius)
    assert label.tolist() == brute_classes([int(v) for v in values], radius)


@pytest.mark.parametrize("pieces", [5, 6, 7])
def test_links_over_cells(spark, pieces, monkeypatch):
    """Small cells and any number of pieces give the same classes."""
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)
    rng = random.Random(1)
    hub = rng.getrandbits(63)
    values = {hub ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 3))) for _ in range(150)}
    values |= {rng.getrandbits(63) for _ in range(100)}
    ordered = sorted(values)
    nodes = spark.createDataFrame([(v,) for v in ordered], "fp long")
    links = simhash.near_links(nodes, 4, pieces)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    expected = brute_classes(ordered, 4)
    assert [roots.get(v, v) for v in ordered] == [ordered[c] for c in expected]


def test_pieces_grow_with_the_input():
    assert simhash.pieces_for(10, 4) == 5
    assert simhash.pieces_for(10**9, 4) == 6
    assert simhash.pieces_for(10**12, 4) > 6


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    roots = {r["node"]: r["root"] for r in connected_components(chain).collect()}
    assert roots == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
