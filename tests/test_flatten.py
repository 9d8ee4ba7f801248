import random

import pytest
from pyspark.sql import functions as F

from kinsheet import session
from kinsheet.operators import sequence
from kinsheet.operators.outline import header_rows
from kinsheet.plans import flatten
from kinsheet.plans.flatten import HierarchyError, flatten_hierarchy, standard_records
from kinsheet.schemas import RECORD_COLUMNS, SHEET_SCHEMA

HEADER = ("序号", "应用系统名称")
SAMPLE = [
    HEADER,
    ("一", "平台一"),
    ("（一）", "系统一"),
    (None, "分类标题"),
    ("1", "软件一"),
    ("（1）", "模块一"),
    ("（2）", "模块二"),
    ("2", "软件二"),
]


def sheet(spark, rows, source="s", start=1):
    data = [(source, i, serial, name) for i, (serial, name) in enumerate(rows, start)]
    return spark.createDataFrame(data, SHEET_SCHEMA)


def records(result):
    rows = result.records.orderBy("source_id", "row_number").collect()
    return [tuple(r[c] for c in RECORD_COLUMNS) for r in rows]


def issues(result):
    return [r["issue"] for r in result.issues.orderBy("source_id", "row_number").collect()]


def test_sample_sheet(spark):
    result = flatten_hierarchy(sheet(spark, SAMPLE), "G001")
    counts = result.counts.first().asDict()
    assert counts == {
        "source_id": "s",
        "platform": 1,
        "system": 1,
        "software": 2,
        "module": 2,
        "excluded_categories": 1,
        "output_rows": 4,
        "warnings": 0,
    }
    excluded = result.excluded.first()
    assert (excluded["title"], excluded["source_row"], excluded["system_id"]) == ("分类标题", 4, "S001")
    path = ("G001", "P001", "平台一", "S001", "系统一", "SW001", "软件一")
    assert records(result) == [
        (*path, "", ""),
        (*path, "M0001", "模块一"),
        (*path, "M0002", "模块二"),
        (*path[:5], "SW002", "软件二", "", ""),
    ]
    assert records(flatten_hierarchy(sheet(spark, SAMPLE), "G001")) == records(result)


def test_number_cells(spark):
    rows = [("s", 5, 1.0, "软件一")]
    numbers = spark.createDataFrame(rows, "source_id string, row_number long, serial double, name string")
    head = sheet(spark, SAMPLE[:3]).withColumn("serial", F.col("serial"))
    both = head.unionByName(numbers.withColumn("serial", F.col("serial").cast("int").cast("string")))
    assert records(flatten_hierarchy(both))[0][5] == "SW001"


def test_strict_raises_at_first_issue(spark):
    rows = [HEADER, ("一", "平台一"), ("（一）", "系统一"), ("（1）", "孤立模块"), ("?", "x")]
    with pytest.raises(HierarchyError, match="第 4 行：模块行缺少当前软件"):
        flatten_hierarchy(sheet(spark, rows), strict=True)
    lenient = flatten_hierarchy(sheet(spark, rows))
    assert issues(lenient) == ["第 4 行：模块行缺少当前软件，已跳过", "第 5 行：无法识别序号格式 '?'，已跳过"]
    assert records(lenient) == []


def test_parents_reset_and_orphans_take_no_id(spark):
    rows = [
        HEADER,
        ("（一）", "s-early"),
        ("1", "w-early"),
        ("（1）", "m-early"),
        ("一", "p1"),
        ("（1）", "orphan"),
        ("2", "w-no-system"),
        ("（一）", "s1"),
        ("（2）", "orphan too"),
        (None, "title"),
        ("3", "w1"),
        ("4", None),
        ("（3）", "m1"),
    ]
    result = flatten_hierarchy(sheet(spark, rows))
    got = [r[1:] for r in records(result)]
    assert got == [
        ("", "", "S001", "s-early", "SW001", "w-early", "", ""),
        ("", "", "S001", "s-early", "SW001", "w-early", "M0001", "m-early"),
        ("P001", "p1", "", "", "SW002", "w-no-system", "", ""),
        ("P001", "p1", "S002", "s1", "SW003", "w1", "", ""),
        ("P001", "p1", "S002", "s1", "SW003", "w1", "M0002", "m1"),
    ]
    assert [i.split("：")[1] for i in issues(result)] == [
        "系统行缺少当前平台",
        "软件行缺少当前平台或系统",
        "模块行缺少当前软件，已跳过",
        "软件行缺少当前平台或系统",
        "模块行缺少当前软件，已跳过",
        "序号 '4' 对应的名称为空，已跳过",
    ]
    title = result.excluded.first()
    assert (title["platform_id"], title["system_id"]) == ("P001", "S002")


def test_totals_are_compared_unevenly(spark):
    rows = [HEADER, ("合 计", "x"), (None, "合计"), (None, "合 计"), ("一", " 合计 ")]
    result = flatten_hierarchy(sheet(spark, rows))
    assert [r["title"] for r in result.excluded.collect()] == ["合 计"]
    assert result.counts.first()["platform"] == 0


def test_header_is_searched_in_thirty_rows(spark):
    above = [("一", "not data")] + [(None, None)] * 28
    assert records(flatten_hierarchy(sheet(spark, above + SAMPLE)))[0][1] == "P001"
    with pytest.raises(HierarchyError, match="no header"):
        flatten_hierarchy(sheet(spark, above + [(None, None)] + SAMPLE))
    lazy = flatten_hierarchy(sheet(spark, above + [(None, None)] + SAMPLE), check=False)
    assert records(lazy) == []


def test_many_sheets_and_sheet_choice(spark):
    both = sheet(spark, SAMPLE, "a").unionByName(sheet(spark, SAMPLE[:5], "b", start=3))
    assert [(r["source_id"], r["header_row"]) for r in header_rows(both).orderBy("source_id").collect()] == [
        ("a", 1),
        ("b", 3),
    ]
    result = flatten_hierarchy(both, F.col("source_id"))
    assert [r[0] for r in records(result)] == ["a"] * 4 + ["b"]
    assert len(records(flatten_hierarchy(both, source_id="b"))) == 1
    with pytest.raises(HierarchyError, match="no such sheet"):
        flatten_hierarchy(both, source_id="c")
    with pytest.raises(HierarchyError, match="blank"):
        flatten_hierarchy(both, " ")
    seqs = standard_records(result).orderBy("input_seq").collect()
    assert [r["input_seq"] for r in seqs] == [1, 2, 3, 4, 5]
    assert [r["group_id"] for r in seqs] == ["a"] * 4 + ["b"]


def test_ids_outgrow_their_padding(spark):
    rows = [HEADER, ("一", "p"), ("（一）", "s")] + [(str(i), f"w{i}") for i in range(1002)]
    got = records(flatten_hierarchy(sheet(spark, rows), chunk_bits=6))
    assert [r[5] for r in got[-4:]] == ["SW999", "SW1000", "SW1001", "SW1002"]


def plain_walk(rows):
    """The outline rules once more as a plain loop, for small random sheets."""
    made, count = [], {"P": 0, "S": 0, "W": 0, "M": 0}
    path = {"P": ("", ""), "S": ("", ""), "W": ("", "")}
    for kind, name in rows:
        if kind in path:
            count[kind] += 1
            form = {"P": "P%03d", "S": "S%03d", "W": "SW%03d"}[kind]
            path[kind] = (form % count[kind], name)
            for below in "PSW"["PSW".index(kind) + 1 :]:
                path[below] = ("", "")
        if kind == "W":
            made.append((*path["P"], *path["S"], *path["W"], "", ""))
        if kind == "M" and path["W"][0]:
            count["M"] += 1
            made.append((*path["P"], *path["S"], *path["W"], "M%04d" % count["M"], name))
    return made


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunk_size_never_changes_the_result(spark, seed):
    rng = random.Random(seed)
    serial = {"P": "一", "S": "（二）", "W": "3", "M": "（4）", "?": "x", "-": None}
    kinds = rng.choices("PSWM?-", [1, 2, 6, 30, 1, 1], k=400)
    rows = [(k, f"n{i}") for i, k in enumerate(kinds)]
    table = sheet(spark, [HEADER] + [(serial[k], n) for k, n in rows])
    expected = plain_walk(rows)
    for bits in (5, 7, 14):
        result = flatten_hierarchy(table, chunk_bits=bits)
        assert [r[1:] for r in records(result)] == expected


LOOSE_SHEET = "source_id string, row_number long, serial string, name string"


@pytest.mark.parametrize(
    ("row", "fault"),
    [
        (("a", None, "3", "软件三"), "no row number"),
        ((None, 9, "3", "软件三"), "no source"),
        (("a", 5, "3", "软件三"), "repeated row number"),
        (("a", 0, "3", "软件三"), "row number out of range"),
        (("a", 1 << 40, "3", "软件三"), "row number out of range"),
    ],
)
def test_rows_without_a_place_are_refused(spark, row, fault):
    rows = sheet(spark, SAMPLE, "a").unionByName(spark.createDataFrame([row], LOOSE_SHEET))
    with pytest.raises(HierarchyError, match=fault):
        flatten_hierarchy(rows)
    (found,) = flatten_hierarchy(rows, check=False).faults.collect()
    assert (found["source_id"], found["row_number"], found["fault"]) == (*row[:2], fault)


def test_blank_rows_need_no_place(spark):
    blank = spark.createDataFrame([("a", None, " ", None)], LOOSE_SHEET)
    rows = sheet(spark, SAMPLE, "a").unionByName(blank)
    assert flatten_hierarchy(rows).faults.isEmpty()


def test_empty_table_and_sheets_of_one_group_are_refused(spark):
    with pytest.raises(HierarchyError, match="no sheet"):
        flatten_hierarchy(sheet(spark, SAMPLE).limit(0))
    both = sheet(spark, SAMPLE, "a").unionByName(sheet(spark, SAMPLE, "b"))
    with pytest.raises(HierarchyError, match="duplicate ids"):
        flatten_hierarchy(both)
    assert len(records(flatten_hierarchy(both, F.col("source_id")))) == 8


def test_state_is_computed_once_for_all_uses(spark):
    """Rows are classified and carried once, not again for each output and for the summaries."""
    rows = SAMPLE + [("x-1", "未知"), ("㈡", "系统二"), *[(str(i), f"s{i}") for i in range(3, 1003)]]
    result = flatten_hierarchy(sheet(spark, rows), check=False, chunk_bits=6)
    for table in (result.records, result.excluded, result.counts):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "Window" not in plan
    last = records(result)[-1]
    assert last[RECORD_COLUMNS.index("software_id")] == "SW1002"
    assert last[RECORD_COLUMNS.index("system_id")] == "S002"


@pytest.mark.parametrize("check", [True, False])
def test_records_are_numbered_without_a_sort(spark, monkeypatch, check):
    """Only the offsets of sheets are stored for the numbers, not the records of the sheets."""
    rng = random.Random(8)
    serial = {"P": "一", "S": "（二）", "W": "3", "M": "（4）", "?": "x", "-": None}
    table = None
    for name in ("c", "a", "e", "b"):
        # The first rows of a sheet are modules, so some chunks start within a software and some without.
        kinds = "MM" + "".join(rng.choices("PSWM?-", [1, 2, 6, 60, 1, 1], k=200 if name != "e" else 0))
        rows = sheet(spark, [HEADER] + [(serial[k], f"{name}{i}") for i, k in enumerate(kinds)], name)
        table = rows if table is None else table.unionByName(rows)
    result = flatten_hierarchy(table, F.col("source_id"), check=check, chunk_bits=5)
    stored, keep = [], session.materialize

    def kept(df):
        stored.append(keep(df))
        return stored[-1]

    monkeypatch.setattr(flatten, "materialize", kept)
    monkeypatch.setattr(sequence, "materialize", kept)
    numbered = standard_records(result)
    assert [df.count() for df in stored] == [4]
    expected = result.records.orderBy("source_id", "row_number").collect()
    assert len(expected) > 300
    got = [tuple(r) for r in numbered.orderBy("input_seq").collect()]
    assert got == [(*[r[c] for c in RECORD_COLUMNS], i) for i, r in enumerate(expected, 1)]
