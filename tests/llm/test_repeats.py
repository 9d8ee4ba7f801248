import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import words
from kinsheet.llm import queries, repeats


def brute(rows):
    """Rows ``(id, text)`` with distinct ids, in any order."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            window = data[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def results(frame):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in frame.collect()}


@pytest.mark.parametrize("group, fold", [(1 << 15, 8 << 20), (2, 3000)])
def test_query(spark, sf_dir, documents, monkeypatch, group, fold):
    """Also with large groups dealt by hash, and with texts cut into parts."""
    monkeypatch.setattr(repeats, "GROUP_SEGMENTS", group)
    monkeypatch.setattr(repeats, "FOLD_BYTES", fold)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert results(queries.op7_repeats(spark, sf_dir)) == brute(rows)


def test_passages_and_runs(spark):
    rng = random.Random(6)
    shared = [words(rng, 40) for _ in range(4)]
    rows = []
    for i in range(60):
        text = words(rng, rng.randint(0, 60)) + rng.choice(shared) + words(rng, 5) + rng.choice(shared)
        rows.append((i, text[: rng.randint(0, len(text))]))
    rows += [(100, "ab" * 300), (101, "a" * 99), (102, "a" * 100), (103, "a" * 101), (104, "é" * 500)]
    rows += [(105, shared[0] * 40), (-5, shared[1]), (106, "x" + shared[1][:99]), (107, "x" + shared[1][:100])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert results(repeats.remove_repeats(frame)) == brute(rows)


def test_odd_rows(odd_docs, odd_rows):
    distinct = {i: t for i, t, *_ in odd_rows if i is not None}
    plain = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert results(repeats.remove_repeats(plain)) == brute(distinct.items())
    found = repeats.remove_repeats(odd_docs).collect()
    assert len(found) == len(odd_rows)
    # three rows of document 3 are one document: none is a copy of the others
    same = [r for r in found if r["doc_id"] == 3]
    assert len(same) == 3 and len({r["n_removed"] for r in same}) == 1 and same[0]["n_removed"] == 0


def test_no_rows(no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0


def test_interleave_finds_all_repeats():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    for depth in (1, 4, 9, 30):
        ends = np.arange(depth, len(data) + 1)
        window, block = repeats.interleave(data, ends, np.zeros(len(ends), dtype=np.int64), depth)
        strings = [data[e - depth : e].tobytes() for e in ends]
        by_block = {}
        for w, b in zip(window.tolist(), block.tolist()):
            by_block.setdefault(b, set()).add(w)
        expected = {}
        for i, s in enumerate(strings):
            expected.setdefault(s, set()).add(i)
        assert sorted(map(sorted, by_block.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


def test_windows_are_placed_alike():
    """Equal windows have equal anchors at equal places, whatever stands around them."""
    rng = random.Random(8)
    core = rng.randbytes(400)
    placed = []
    for before in (b"", rng.randbytes(77), rng.randbytes(300)):
        data = np.frombuffer(before + core + rng.randbytes(50), dtype=np.uint8)
        anchor, first, count = repeats.segments(data, np.full(len(data), len(data)), 100)
        at = np.repeat(anchor, count)
        start = np.concatenate([np.arange(f, f + c) for f, c in zip(first, count)])
        assert start.tolist() == list(range(len(data) - 99))
        placed.append(at[len(before) : len(before) + 301].tolist())
    assert placed[0] == placed[1] == placed[2]


@pytest.mark.parametrize("run", [1023, 1024, 1025, 2046, 2047, 5000])
def test_runs_longer_than_a_span(monkeypatch, run):
    """A repeated run whose length does not fit into a span is removed as one that fits."""
    monkeypatch.setattr(repeats, "FOLD_BYTES", 700)
    text = "b" * 150 + "a" * (run + 1) + "c" * 150
    part = pa.RecordBatch.from_pydict({"doc_id": [4], "version": [0], "text": [text]})
    cuts = []
    for most in (1 << 24, 1 << 10):
        monkeypatch.setattr(repeats, "SPAN", most)
        rows = [r for b in repeats._fold(part) for r in b.to_pylist()]
        spans = [r["span"] for r in rows if r["kind"] == 1]
        cuts.append(repeats._cut(text.encode(), spans))
    assert cuts[0][1] > run - 100 and cuts[0] == cuts[1]


def test_windows_of_large_groups_are_folded(spark, monkeypatch):
    """A passage in many documents, with other bytes around it, is one row a window and task."""
    rng = random.Random(14)
    shared = words(rng, 40)[:150]
    rows = [(i, words(rng, 5) + shared + words(rng, 5)) for i in range(80)]
    batch = pa.RecordBatch.from_pydict(
        {
            "doc_id": [i for i, _ in rows],
            "version": [0] * len(rows),
            "text": [t for _, t in rows],
            "wanted": [[{"anchor": 1, "span": len(t)}] for _, t in rows],
        }
    )
    out = [r for b in repeats._folded_windows(batch) for r in b.to_pylist()]
    bodies = [r["body"] for r in out if r["body"] is not None]
    assert len(bodies) == len(set(bodies))
    spans = {}
    for r in out:
        if r["body"] is None:
            spans.setdefault(r["doc_id"], []).append(r["span"])
    expected = brute(rows)
    assert {i: repeats._cut(t.encode(), spans.get(i))[:4] for i, t in rows} == expected
    monkeypatch.setattr(repeats, "GROUP_SEGMENTS", 2)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert results(repeats.remove_repeats(frame)) == expected
