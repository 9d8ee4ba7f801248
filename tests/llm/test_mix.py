from collections import Counter, defaultdict

import numpy as np
from kinsheet.llm import mix, queries

from llm_helpers import split


def check(rows, taken):
    sizes = Counter()
    for source, text in rows:
        sizes[source] += len(split(text))
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = dict(zip(sources, mix.targets([sizes[s] for s in sources])))
    words = defaultdict(int)
    for r in taken:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - aims[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        words[r["source"]] += r["taken"]
    assert all(abs(words[s] - aims[s]) <= 0.5 for s in sources)


def test_query(spark, sf_dir, documents):
    rows = [(r["source"], r["text"]) for r in documents.collect()]
    found = queries.op4_mix(spark, sf_dir).collect()
    assert len(found) == len(rows)
    check(rows, found)
    assert sorted(map(str, found)) == sorted(map(str, queries.op4_mix(spark, sf_dir).collect()))


def test_odd_rows(odd_docs, odd_rows):
    found = mix.Mix(odd_docs, 3).taken().collect()
    assert len(found) == len(odd_rows)
    check([(source, text) for _, text, _, source in odd_rows], found)


def test_no_rows(no_docs):
    assert mix.Mix(no_docs).taken().count() == 0
    assert mix.mixed_documents(no_docs).count() == 0


def test_targets():
    assert mix.targets([]) == [] and mix.targets([0, 0]) == [0, 0]
    assert mix.targets([600, 600, 600]) == [300, 600, 900]
    # the last source stops at three times its size; the rest is shared 1 : 2
    assert mix.targets([900, 900, 10]) == [(1810 - 30) / 3, (1810 - 30) * 2 / 3, 30]
    found = mix.targets([5, 1000, 1, 7, 30])
    assert abs(sum(found) - 1043) < 1e-9


def test_tree_keeps_quotas():
    quotas = [1000, 0, 17, 123_456]
    found = mix.split_quotas(quotas, 13, seed=4)
    assert found.sum(axis=1).tolist() == quotas
    assert np.ptp(found.sum(axis=0)) <= 1 and (found >= 0).all()
    assert (found == mix.split_quotas(quotas, 13, seed=4)).all()


def test_shards_are_disjoint_and_shuffled(odd_docs, monkeypatch):
    monkeypatch.setattr(mix, "SHARD_BLOCKS", 40)
    plan = mix.Mix(odd_docs, 1)
    rows = plan.draws.collect()
    assert plan.shards > 3
    keys = Counter((r["doc_id"], r["source"], r["digest"], r["nth"], r["block"], r["epoch"]) for r in rows)
    assert max(keys.values()) == 1
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == plan.shards and max(sizes.values()) - min(sizes.values()) <= 1
    order = plan.shuffled().where("shard = 0").collect()
    assert [r["place"] for r in order] == sorted(r["place"] for r in order)


def test_mixed_documents(odd_docs):
    plan = {}
    for r in mix.Mix(odd_docs, 5).taken().collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["taken"]
    mixed = mix.mixed_documents(odd_docs, 5)
    assert mixed.columns == odd_docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(split(r["text"]))
    assert words == Counter({i: n for i, n in plan.items() if n})


def test_documents_know_their_shards(odd_docs, monkeypatch):
    """The shards of a document are those of its draws, as the tree dealt them."""
    monkeypatch.setattr(mix, "SHARD_BLOCKS", 40)
    plan = mix.Mix(odd_docs, 1)
    held = defaultdict(set)
    for r in plan.draws.collect():
        held[r["doc_id"]].add(r["shard"])
    assert len(set().union(*held.values())) == plan.shards
    spans = defaultdict(set)
    for r in plan.taken().collect():
        assert (r["first_shard"] is None) == (r["taken"] == 0)
        if r["taken"]:
            spans[r["doc_id"]] |= {r["first_shard"], r["last_shard"]}
    assert spans.keys() == held.keys()
    assert all(spans[i] <= s and {min(s), max(s)} <= spans[i] for i, s in held.items())
