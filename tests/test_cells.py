"""How often names are copied to cells, and what leaves a cell."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinsheet.operators import grid
from kinsheet.operators.vectors import pivot_rows
from kinsheet.plans import similar
from kinsheet.schemas import RECORD_COLUMNS

STAT_TYPES = ", ".join(f"{c} long" for c in grid.STATS)
ROW = f"level string, part string, bucket long, side int, name string, payload array<double>, {STAT_TYPES}"


def name_rows(spark, count, size=8, sides=1):
    """Names with one object each, in the order of their numbers."""
    rng = np.random.default_rng(2)
    rows = [
        ("software", "", 0, n % sides, f"n{n:05}", v, 0, n, 0, n, 0, n, 1, 1, n, n)
        for n, v in enumerate(rng.normal(size=(count, size)).tolist())
    ]
    return spark.createDataFrame(rows, ROW)


@pytest.mark.parametrize("sides", [1, 2])
def test_copies_of_a_name_do_not_follow_the_number_of_names(spark, sides):
    copies = []
    for count in (400, 1600):
        cells = grid._cells(name_rows(spark, count, sides=sides), sides == 2, 4, False)
        held = cells.agg(F.sum(F.size("names"))).first()[0]
        copies.append(held / count)
    assert copies[1] <= copies[0] <= 17


def test_number_of_centres_is_bounded(spark, monkeypatch):
    wanted = []

    def sampled(rows, count):
        wanted.append(count)
        return sample(rows, count)

    sample = similar.sample_centres
    monkeypatch.setattr(similar, "sample_centres", sampled)
    rng = np.random.default_rng(3)
    values = {f"n{n}": v for n, v in enumerate(rng.normal(size=(150, 6)).tolist())}
    rows = [
        ("software", n, i, *["G" if c == "group_id" else n if c == "software_name" else "" for c in RECORD_COLUMNS])
        for i, n in enumerate(values)
    ]
    columns = ", ".join(f"{c} string" for c in RECORD_COLUMNS)
    objects = spark.createDataFrame(rows, f"level string, object_id string, obj_seq long, {columns}")
    vectors = spark.createDataFrame(list(values.items()), "norm_name string, vec array<double>")
    similar.find_similar(objects, vectors, threshold=0.5, top_k=2, block_rows=2)
    assert wanted == [32]


def test_a_cell_cuts_pairs_of_both_directions_as_a_whole(spark, monkeypatch):
    """However few scores are held at a time, a name leaves a cell with top_k partners."""
    count, top_k = 120, 2
    cells = grid._cells(name_rows(spark, count), False, count, False).toArrow()
    monkeypatch.setattr(grid, "_PRODUCT_CELLS", count)  # one row a step
    monkeypatch.setattr(grid, "_PENDING_PAIRS", 50)
    task = grid._cell_task(0.1, top_k, False, False)
    found = pa.Table.from_batches(list(task(iter(cells.to_batches()))))
    left = found.column("a_name").to_pylist()
    assert max(left.count(n) for n in set(left)) <= top_k
    pairs = sorted(zip(left, found.column("b_name").to_pylist()))
    units = np.array([r["payload"] for r in name_rows(spark, count).collect()])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    scores = units @ units.T
    expected = []
    for a in range(count):
        later = [b for b in range(a + 1, count) if scores[a, b] >= 0.1]
        best = sorted(later, key=lambda b: -scores[a, b])[:top_k]
        expected += [(f"n{a:05}", f"n{b:05}") for b in best]
    assert pairs == sorted(expected)


@pytest.mark.parametrize("threshold", [0.2, 0.6])
def test_names_visit_only_pivots_ahead_of_their_home(spark, threshold):
    rows = name_rows(spark, 300, size=5).drop("bucket")
    vectors = {r["name"]: np.array(r["payload"]) for r in rows.collect()}
    pivots = [v.tolist() for v in list(vectors.values())[:6]]
    cells = {}
    for r in pivot_rows(rows, threshold, pivots).select("name", "bucket").collect():
        cells.setdefault(r["name"], set()).add(r["bucket"])
    centres = np.array(pivots) / np.linalg.norm(pivots, axis=1, keepdims=True)
    for name, v in vectors.items():
        home = int(np.argmax(centres @ (v / np.linalg.norm(v))))
        assert max(cells[name]) == home
    names = list(vectors)
    for i, a in enumerate(names):
        for b in names[:i]:
            u, v = vectors[a], vectors[b]
            if u @ v >= threshold * np.linalg.norm(u) * np.linalg.norm(v):
                assert cells[a] & cells[b]
