import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsheet import session
from kinsheet.operators import grid, metric, sequence
from kinsheet.operators import vectors as vector_module
from kinsheet.operators.objects import with_norm_name
from kinsheet.operators.vectors import model_vectors
from kinsheet.plans import similar as similar_module
from kinsheet.plans.report import ordered_results, result_table
from kinsheet.plans.similar import find_similar
from kinsheet.schemas import RECORD_COLUMNS, RECORD_SCHEMA, VECTOR_SCHEMA

OBJECT_FIELDS = (
    "level string, object_id string, obj_seq long, "
    + ", ".join(f"{c} string" for c in RECORD_COLUMNS)
)


def objects(spark, rows, level="software"):
    """Rows ``(group, id, name)`` in input order."""
    data = []
    for seq, (group, object_id, name) in enumerate(rows):
        head = (group, "P001", "平台", "S001", "系统")
        tail = (object_id, name, "", "") if level == "software" else ("SW1", "软件", object_id, name)
        data.append((level, object_id, seq, *head, *tail))
    return spark.createDataFrame(data, OBJECT_FIELDS)


def vectors(spark, table):
    data = [(name, [float(x) for x in vec]) for name, vec in table.items()]
    return spark.createDataFrame(data, VECTOR_SCHEMA)


def found(results):
    rows = ordered_results(results).collect()
    return [
        (
            (r["a"]["group_id"], r["a"]["module_id"] or r["a"]["software_id"]),
            r["b"] and (r["b"]["group_id"], r["b"]["module_id"] or r["b"]["software_id"]),
            r["rank"],
            r["score"],
            r["label"],
        )
        for r in rows
    ]


def search(spark, rows, table, **options):
    options = {"block_rows": 2, **options}
    return found(find_similar(objects(spark, rows), vectors(spark, table), **options))


def directed(*targets):
    return {"mode": "cross", "anchor_group": "A", "target_groups": list(targets)}


def test_within_has_no_self_or_mirrored_pairs(spark):
    rows = [("A", "SW001", "同名软件"), ("A", "SW002", "同名软件"), ("A", "SW003", "其他软件")]
    got = search(spark, rows, {"同名软件": [1, 0], "其他软件": [0.9, 0.1]})
    pairs = [(a[1], b[1]) for a, b, *_ in got]
    assert pairs == [("SW001", "SW002"), ("SW001", "SW003"), ("SW002", "SW003")]
    assert [r[2] for r in got] == [1, 2, 1]


def test_cross_goes_from_earlier_groups(spark):
    rows = [("A", "SW001", "n"), ("A", "SW002", "n"), ("B", "SW001", "n")]
    got = search(spark, rows, {"n": [1, 0]}, mode="cross")
    assert [(a, b) for a, b, *_ in got] == [
        (("A", "SW001"), ("B", "SW001")),
        (("A", "SW002"), ("B", "SW001")),
    ]
    rows = [("B", "1", "n"), ("A", "1", "n"), ("C", "1", "n")]
    got = search(spark, rows, {"n": [1, 0]}, mode="cross")
    assert {(a[0], b[0]) for a, b, *_ in got} == {("B", "A"), ("B", "C"), ("A", "C")}


def test_directed_pairs_only_leave_the_anchor(spark):
    rows = [("B", "B01", "n"), ("A", "A01", "n"), ("C", "C01", "n"), ("D", "D01", "n")]
    got = search(spark, rows, {"n": [1, 0]}, **directed("B", "C"))
    assert [(a[0], b[0]) for a, b, *_ in got] == [("A", "B"), ("A", "C")]


def test_directed_top_k_is_over_all_targets(spark):
    rows = [("A", "A01", "a"), ("B", "B01", "third"), ("C", "C01", "best"), ("D", "D01", "second")]
    table = {"a": [1, 0], "best": [1, 0], "second": [0.9, 0.43589], "third": [0.8, 0.6]}
    got = search(spark, rows, table, threshold=0.0, top_k=2, **directed("B", "C", "D"))
    assert [(b[0], rank) for _, b, rank, *_ in got] == [("C", 1), ("D", 2)]


def test_ties_go_by_group_then_id_text(spark):
    rows = [("A", "A01", "n"), ("C", "C02", "n"), ("B", "B1000", "n"), ("B", "B101", "n")]
    got = search(spark, rows, {"n": [1, 0]}, **directed("C", "B"))
    assert [b[1] for _, b, *_ in got] == ["B1000", "B101", "C02"]


def test_directed_unmatched_lists_anchor_objects_only(spark):
    rows = [("B", "B01", "t"), ("A", "A01", "a"), ("C", "C01", "t")]
    got = search(
        spark, rows, {"a": [1, 0], "t": [0, 1]}, threshold=0.9, include_unmatched=True, **directed("B", "C")
    )
    assert got == [(("A", "A01"), None, 0, None, "无匹配")]


def test_unmatched_is_one_sided(spark):
    rows = [("A", "1", "n"), ("A", "2", "n"), ("B", "1", "n")]
    got = search(spark, rows, {"n": [1, 0]}, include_unmatched=True)
    assert [(a, rank) for a, _, rank, *_ in got] == [
        (("A", "1"), 1),
        (("A", "2"), 0),
        (("B", "1"), 0),
    ]


def test_equal_names_are_labelled_exact_and_clamped(spark):
    rows = [("A", "1", "同名软件"), ("A", "2", " 同名 软件")]
    (row,) = search(spark, rows, {"同名软件": [1.0] * 7})
    assert row[3:] == (1.0, "名称完全相同")


def test_equal_names_still_need_the_threshold(spark):
    assert search(spark, [("A", "1", "n"), ("A", "2", "n")], {"n": [0, 0]}) == []


def test_bands_and_tolerance(spark):
    names = {"a": [1, 0]}
    for name, cosine in {"b": 0.95, "c": 0.87, "d": 0.8, "e": 0.6, "f": -0.5}.items():
        names[name] = [cosine, math.sqrt(1 - cosine**2)]
    rows = [("A", n, n) for n in names]
    got = search(spark, rows, names, threshold=0.0, top_k=9)
    from_a = {b[1]: label for a, b, _, _, label in got if a[1] == "a"}
    assert from_a == {"b": "极高相似", "c": "高相似", "d": "中等相似", "e": "低相似"}

    near = 0.84999995
    table = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [near, math.sqrt(1 - near**2)])], "norm_name string, vec array<double>"
    )
    got = found(find_similar(objects(spark, [("A", "1", "a"), ("A", "2", "b")]), table))
    assert [r[4] for r in got] == ["中等相似"]


def test_levels_never_mix(spark):
    rows = [("A", "1", "n"), ("A", "2", "n")]
    both = objects(spark, rows).unionByName(objects(spark, rows, level="module"))
    results = find_similar(both, vectors(spark, {"n": [1, 0]}), mode="all")
    assert [r["level"] for r in ordered_results(results).collect()] == ["software", "module"]
    only = find_similar(both, vectors(spark, {"n": [1, 0]}), levels=["module"])
    assert [r["level"] for r in only.collect()] == ["module"]


def test_bad_input_is_refused(spark):
    rows = objects(spark, [("A", "1", "a"), ("A", "2", "b")])
    with pytest.raises(ValueError, match="no vector"):
        find_similar(rows, vectors(spark, {"a": [1, 0]}))
    with pytest.raises(ValueError, match="NaN"):
        find_similar(rows, vectors(spark, {"a": [1, 0], "b": [1, float("nan")]}))
    with pytest.raises(ValueError, match="sizes"):
        find_similar(rows, vectors(spark, {"a": [1, 0], "b": [1]}))
    twice = vectors(spark, {"a": [1, 0], "b": [1, 0]}).unionByName(vectors(spark, {"a": [0, 1]}))
    with pytest.raises(ValueError, match="more than one"):
        find_similar(rows, twice)
    with pytest.raises(ValueError, match="threshold"):
        find_similar(rows, threshold=1.5)
    with pytest.raises(ValueError, match="top_k"):
        find_similar(rows, top_k=0)
    suffix = objects(spark, [("A", "1", "模块")], level="module")
    with pytest.raises(ValueError, match="empty after"):
        find_similar(suffix, drop_module_suffix=True)


def test_no_objects_no_rows(spark):
    assert search(spark, [], {"a": [1, 0]}) == []


def test_module_suffix_only_for_modules(spark):
    rows = [("A", "1", "评测模块"), ("A", "2", "评测")]
    both = objects(spark, rows).unionByName(objects(spark, rows, level="module"))
    names = with_norm_name(both, drop_module_suffix=True).where("object_id = '1'")
    assert {r["level"]: r["norm_name"] for r in names.collect()} == {
        "software": "评测模块",
        "module": "评测",
    }


def test_encoder_gets_distinct_names_in_batches(spark):
    def load():
        def encode(texts, *, batch_size, max_length):
            assert len(texts) <= batch_size == 2 and max_length == 9
            return np.array([[len(t), t.count("a")] for t in texts])

        return encode

    rows = [("A", str(i), n) for i, n in enumerate(["aa", "aaaa", "aa", "bbb", "c"])]
    provider = model_vectors(load, batch_size=2, max_length=9)
    got = found(find_similar(objects(spark, rows), provider, threshold=0.99))
    assert {(a[1], b[1]) for a, b, *_ in got} == {("0", "1"), ("0", "2"), ("1", "2"), ("3", "4")}


def test_encoder_runs_in_several_tasks(spark):
    """Few bytes of names are still spread; each task loads its own model."""
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda texts, *, batch_size, max_length: np.ones((len(texts), 2))

    names = spark.createDataFrame([(f"n{i}",) for i in range(200)], "norm_name string")
    assert model_vectors(load, tasks=3)(names).count() == 200
    assert loads.value == 3


# --- against a plain nested loop ---------------------------------------------------------


def plain_search(rows, score, mode, threshold, top_k, anchor=None, targets=()):
    order = {}
    for group, *_ in rows:
        order.setdefault(group, len(order))
    matches = defaultdict(list)
    for i, (ga, ia, na) in enumerate(rows):
        for j, (gb, ib, nb) in enumerate(rows):
            same = ga == gb
            if anchor:
                allowed = ga == anchor and gb in targets
            elif same:
                allowed = mode != "cross" and i < j
            else:
                allowed = mode != "within" and order[ga] < order[gb]
            if allowed and score(na, nb) + 1e-7 >= threshold:
                matches[ga, ia].append((-score(na, nb), gb, ib))
    return sorted(
        (a, (gb, ib), rank, round(-s, 9))
        for a, options in matches.items()
        for rank, (s, gb, ib) in enumerate(sorted(options)[:top_k], 1)
    )


def random_rows(seed, names, count=90):
    """A third of all objects share one name and most share one group; ids are shuffled."""
    rng = random.Random(seed)
    ids = [f"{i:03d}" for i in range(count)]
    rng.shuffle(ids)
    return [
        (
            rng.choice(["G2", "G2", "G2", "G1", "G3"]),
            object_id,
            names[0] if rng.random() < 0.34 else rng.choice(names),
        )
        for object_id in ids
    ]


MODES = [("within", {}), ("cross", {}), ("all", {})]
MODES += [("cross", {"anchor_group": "G2", "target_groups": ["G3", "G1"]})]
SHAPES = [{}, {"block_rows": 3, "range_bits": 2}, {"block_rows": 4, "range_bits": 4, "pivots": 3}]


@pytest.mark.parametrize(("mode", "scope"), MODES)
@pytest.mark.parametrize("shape", SHAPES)
def test_dense_search_equals_nested_loop(spark, mode, scope, shape):
    rng = np.random.default_rng(5)
    names = [f"n{i}" for i in range(14)]
    table = {n: np.round(rng.normal(size=4), 1).tolist() for n in names}
    table["n3"] = table["n2"]  # distinct names with one vector: real ties

    def score(a, b):
        u, v = (np.array(table[x], dtype="f4").astype("f8") for x in (a, b))
        return round(float(u @ v / np.linalg.norm(u) / np.linalg.norm(v)), 12)

    rows = random_rows(7, names)
    options = {"mode": mode, "threshold": 0.4, "top_k": 3, **scope, **shape}
    got = found(find_similar(objects(spark, rows), vectors(spark, table), **options))
    expected = plain_search(
        rows, score, mode, 0.4, 3, scope.get("anchor_group"), scope.get("target_groups", ())
    )
    assert sorted((a, b, rank, round(s, 9)) for a, b, rank, s, _ in got) == expected


def gram_cosine(a, b):
    def counts(name):
        return Counter(name[i : i + 3] for i in range(max(len(name) - 2, 1)))

    x, y = counts(a), counts(b)
    dot = sum(x[g] * y[g] for g in x)
    squares = [sum(c * c for c in z.values()) for z in (x, y)]
    return round(dot / math.sqrt(squares[0] * squares[1]), 12)


@pytest.mark.parametrize(("mode", "scope"), MODES)
@pytest.mark.parametrize("threshold", [0.0, 0.45, 0.8])
def test_gram_search_equals_nested_loop(spark, monkeypatch, mode, scope, threshold):
    monkeypatch.setattr(vector_module, "SMALL_SCOPE", 0)
    rng = random.Random(3)
    names = ["".join(rng.choices("ab中", k=rng.randint(1, 9))) for _ in range(25)]
    rows = random_rows(9, names)
    options = {"mode": mode, "threshold": threshold, "top_k": 4, "block_rows": 3, "range_bits": 3}
    got = found(find_similar(objects(spark, rows), **options, **scope))
    expected = plain_search(
        rows, gram_cosine, mode, threshold, 4, scope.get("anchor_group"), scope.get("target_groups", ())
    )
    assert sorted((a, b, rank, round(s, 9)) for a, b, rank, s, _ in got) == expected


def test_within_and_cross_make_all(spark):
    rows = random_rows(11, ["x", "y"], count=24)
    table = vectors(spark, {"x": [1, 0], "y": [0.9, 0.1]})

    def pairs(mode):
        got = found(find_similar(objects(spark, rows), table, mode=mode, top_k=1000))
        return {(a, b, round(s, 9)) for a, b, _, s, _ in got}

    assert pairs("within") | pairs("cross") == pairs("all")
    assert not pairs("within") & pairs("cross")


def test_module_results_sort_after_software(spark):
    rows = [("A", "2", "n"), ("A", "10", "n"), ("A", "3", "n")]
    both = objects(spark, rows).unionByName(objects(spark, rows, level="module"))
    results = ordered_results(find_similar(both, vectors(spark, {"n": [1, 0]}))).collect()
    assert [r["level"] for r in results] == ["software"] * 3 + ["module"] * 3
    assert [r["a"]["software_id"] for r in results[:3]] == ["10", "2", "2"]


# --- equal scores ------------------------------------------------------------------------


def template_rows(count, order):
    """Names of one template with a number; ids run along the rows, against them, or at random."""
    ids = {
        "along": list(range(count)),
        "against": list(range(count))[::-1],
        "random": random.Random(2).sample(range(count), count),
    }[order]
    groups = ["G2", "G1", "G3"]
    return [
        (groups[i * 3 // count], f"{ids[i]:05d}", f"inspection evaluation station {i:05d}")
        for i in range(count)
    ]


TIES = [(mode, scope, "random") for mode, scope in MODES]


@pytest.mark.parametrize(
    ("mode", "scope", "order"), [*TIES, ("within", {}, "along"), ("all", {}, "against")]
)
def test_ties_equal_nested_loop(spark, mode, scope, order):
    rows = template_rows(60, order)
    # some names twice, so that partners are not sure to come later
    rows += [(g, f"9{i}", n) for g, i, n in rows[::4]]
    options = {"mode": mode, "threshold": 0.8, "top_k": 3, "block_rows": 7, "range_bits": 3}
    got = found(find_similar(objects(spark, rows), **options, **scope))
    expected = plain_search(
        rows, gram_cosine, mode, 0.8, 3, scope.get("anchor_group"), scope.get("target_groups", ())
    )
    assert sorted((a, b, rank, round(s, 9)) for a, b, rank, s, _ in got) == expected


@pytest.mark.parametrize(("mode", "scope", "order"), [*TIES, ("within", {}, "against")])
def test_tied_names_store_few_pairs(spark, monkeypatch, mode, scope, order):
    """2,000 names that all score alike leave three pairs a name, not all pairs."""
    stored = []
    original = similar_module.materialize

    def count(df):
        out = original(df)
        if "b_name" in out.columns and "load" in out.columns:
            stored.append(out.count())
        return out

    monkeypatch.setattr(similar_module, "materialize", count)
    rows = template_rows(2000, order)
    table = {name: [1.0, 0.5] for _, _, name in rows}
    options = {"mode": mode, "threshold": 0.9, "top_k": 3, **scope}
    find_similar(objects(spark, rows), vectors(spark, table), **options)
    assert 0 < stored[0] <= 3 * 3 * 2000


@pytest.mark.parametrize("two_sided", [False, True])
def test_far_stripes_never_meet(spark, two_sided):
    """Clustered names: most cells are not made, and no similar pair is lost."""
    rng = np.random.default_rng(4)
    axes = rng.normal(size=(12, 24))
    axes /= np.linalg.norm(axes, axis=1, keepdims=True)
    data, kept = [], {0: {}, 1: {}}
    for n in range(480):
        vec = axes[n % 12] + rng.normal(size=24) * 0.02 if n % 60 else np.zeros(24)
        side = n // 12 % 2 if two_sided else 0
        kept[side][f"n{n}"] = vec
        data.append(("software", "", 0, side, f"n{n}", vec.tolist(), *[0] * len(grid.STATS)))
    data += [("module", *row[1:]) for row in data[:9]]
    stats = ", ".join(f"{c} long" for c in grid.STATS)
    rows = spark.createDataFrame(
        data, f"level string, part string, bucket long, side int, name string, payload array<double>, {stats}"
    )
    centres = metric.sample_centres(rows, 40)
    striped, cells = metric.metric_stripes(
        rows,
        centres,
        scope=grid.SCOPE,
        threshold=0.8,
        two_sided=two_sided,
        block_rows=10,
        stripe_rows=F.lit(10),
        stripe_values=1 << 20,
    )
    place = {(r["level"], r["name"]): r["stripe"] for r in striped.collect()}
    assert len(place) == len(data) == 489
    made = {(r["level"], r["x"], r["y"]) for r in cells.collect()}
    assert len(made) == cells.count()
    stripes = [
        {place["software", n] for n in side} for side in (kept[0], kept[1 if two_sided else 0])
    ]
    possible = len(stripes[0]) * len(stripes[1]) if two_sided else len(stripes[0]) * (len(stripes[0]) + 1) // 2
    assert sum(level == "software" for level, *_ in made) < possible / 3
    similar = 0
    for a, u in kept[0].items():
        for b, v in kept[1 if two_sided else 0].items():
            size = np.linalg.norm(u) * np.linalg.norm(v)
            if a != b and size and u @ v >= 0.8 * size:
                similar += 1
                x, y = place["software", a], place["software", b]
                assert ("software", *((x, y) if two_sided else sorted((x, y)))) in made
    assert similar > 1000
    if not two_sided:
        assert [m for m in made if m[0] == "module"] == [("module", 0, 0)]


NUMBERED = [
    ({"mode": "within"}, 5),
    ({"mode": "within", "include_unmatched": True}, 6),
    ({"mode": "cross"}, 6),
    ({"mode": "all", "include_unmatched": True}, 6),
    ({"mode": "cross", "anchor_group": "B", "target_groups": ["A", "D"], "include_unmatched": True}, 6),
]


@pytest.mark.parametrize(("options", "stored_most"), NUMBERED)
def test_results_are_numbered_while_narrow(spark, monkeypatch, options, stored_most):
    """The same table as a sort of the results with both paths, none of which is stored."""
    rng = random.Random(5)
    names = [f"{w} {n}" for w in ("数据 评测", "plan of work", "x") for n in range(5)]
    rows = [
        (group, f"P{group}", f"p{group}", "S001", "s", f"SW{i}", rng.choice(names), f"M{m}" if m else "", "")
        for group in "BADC"
        for i in range(1, 7)
        for m in range(3)
    ]
    software = {(r[0], r[5]): r[6] for r in rows if not r[7]}
    data = [
        (*r[:6], software[r[0], r[5]], f"{r[7]}{r[5]}" if r[7] else "", rng.choice(names) if r[7] else "", seq)
        for seq, r in enumerate(rows)
    ]
    records = spark.createDataFrame(data, RECORD_SCHEMA)
    options = {"threshold": 0.6, "top_k": 2, **options}
    expected = result_table(similar_module.similarity_job(records, **options)[0]).collect()
    stored, keep = [], session.materialize

    def kept(df):
        stored.append(df.columns)
        return keep(df)

    for module in (session, similar_module, sequence):
        monkeypatch.setattr(module, "materialize", kept)
    got = result_table(similar_module.similarity_job(records, numbered=True, **options)[0])
    assert len(expected) > 20
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected))
    assert len(stored) <= stored_most
    assert not any({"a", "b", "platform_name"} & set(columns) for columns in stored)
