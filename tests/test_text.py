import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from kinsheet.functions import text


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    out = rows.select("i", expression(rows).alias("out")).orderBy("i").collect()
    return [r["out"] for r in out]


def level(serial, name):
    return lambda df: text.outline_level(
        text.normalized_serial(text.cell_text(df, "v")), text.display_name(F.lit(name))
    )


def test_serial_shapes(spark):
    serials = [" 六 ", "（二）", "（ 2 ）", None, "10.0", "㈠", "⑴", "①", "㊀", "⒈", "x-1", "12"]
    expected = ["platform", "system", "module", "category", "unknown", "system", "module"]
    expected += ["software", "platform", "unknown", "unknown", "software"]
    assert column(spark, serials, level(None, "名称")) == expected


def level_of_number(df):
    return text.outline_level(text.normalized_serial(text.cell_text(df, "v")), F.lit("n"))


def test_number_cells_are_not_their_text(spark):
    assert column(spark, [10.0, 10.5], level_of_number, "double") == ["software", "unknown"]
    assert column(spark, [7], level_of_number, "int") == ["software"]
    texts = column(spark, [10.0, 1e17, 2.5], lambda df: text.cell_text(df, "v"), "double")
    assert texts == ["10", "100000000000000000", "2.5"]
    assert column(spark, [True, None], lambda df: text.cell_text(df, "v"), "boolean") == ["True", None]


def test_blank_serial_without_name_is_unknown(spark):
    assert column(spark, [None], level(None, None)) == ["unknown"]


def test_serial_normalisation(spark):
    got = column(spark, [" （ １２ ） "], lambda df: text.normalized_serial(F.col("v")))
    assert got == ["(12)"]


def test_space_set_is_pythons(spark):
    spaces = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    assert len(spaces) == 29
    got = column(spark, [f"a{s}{s}b" for s in spaces], lambda df: text.display_name(F.col("v")))
    assert set(got) == {"a b"}
    assert set(column(spark, [f"{s}a{s}" for s in spaces], lambda df: text.record_cell(F.col("v")))) == {"a"}
    assert not any(column(spark, spaces, lambda df: text.has_text(F.col("v"))))


def test_bom_leaves_display_names_only(spark):
    values = ["﻿名﻿ 称", "﻿"]
    assert column(spark, values, lambda df: text.display_name(F.col("v"))) == ["名 称", ""]
    assert column(spark, values, lambda df: text.record_cell(F.col("v"))) == values


def test_record_cell_keeps_inner_spaces(spark):
    got = column(spark, ["  a  b ", None], lambda df: text.record_cell(F.col("v")))
    assert got == ["a  b", ""]


def comparable(**options):
    return lambda df: text.comparable_name(F.col("v"), **options)


def test_comparable_names(spark):
    values = ["  元数据  完整性评测模块  ", "ABC  软件", "Straße", "ΟΔΟΣ", "ＡＢ１ ㎏", "a¨"]
    got = column(spark, values, comparable())
    assert got[:2] == ["元数据完整性评测模块", "abc 软件"]
    for value, out in zip(values[2:], got[2:]):
        folded = " ".join(unicodedata.normalize("NFKC", value).split()).casefold()
        assert out == folded


def test_suffix_is_opt_in_and_cut_once(spark):
    values = ["评测模块", "模块", "评测模块模块", "模块化", "Abc 模块"]
    assert column(spark, values, comparable()) == [v.lower() for v in values]
    got = column(spark, values, comparable(drop_suffix=True))
    assert got == ["评测", "", "评测模块", "模块化", "abc"]


def test_cjk_spaces_can_stay(spark):
    assert column(spark, ["元 数"], comparable(join_cjk=False)) == ["元 数"]


@pytest.mark.parametrize("name", ["ſecret", "µ-unit", "İstanbul", "ǆ", "ﬁn"])
def test_case_folding_is_pythons(spark, name):
    expected = unicodedata.normalize("NFKC", name).casefold()
    assert column(spark, [name], comparable()) == [expected]


def test_common_widths_are_normalised_without_python(spark, monkeypatch):
    """Ideographs and full-width forms go through a built-in, all else through Python."""
    stable = [chr(c) for c in range(0x4E00, 0xA000)]
    assert all(unicodedata.normalize("NFKC", c) == c for c in stable)
    assert unicodedata.normalize("NFKC", text.WIDE) == text.NARROW
    values = ["（１２）", "ＡＢ　c～", "软件（一）", "plain", "", None, "㈠", "é", "ｶﾞ", "（①）", "１́"]
    expected = [v and unicodedata.normalize("NFKC", v) for v in values]
    assert column(spark, values, lambda df: text.nfkc(F.col("v"))) == expected

    def no_python(col):
        return F.when(col.isNotNull(), F.raise_error(F.lit("a text for Python")).cast("string"))

    monkeypatch.setattr(text, "_nfkc_udf", no_python)
    assert column(spark, values[:6], lambda df: text.nfkc(F.col("v"))) == expected[:6]


def test_even_spaces_stay_and_all_others_collapse(spark):
    values = ["a b", "a  b", " a", "a ", "a\tb", "a　 b", "\u0085a", "", " ", "　", None, "名 称"]
    expected = [v if v is None else " ".join(v.split()) for v in values]
    assert column(spark, values, lambda df: text.collapse_spaces(F.col("v"))) == expected
    stripped = [v if v is None else v.strip() for v in values]
    assert column(spark, values, lambda df: text.strip_spaces(F.col("v"))) == stripped


def test_ends_of_any_kind_of_space_are_stripped(spark):
    """The usual spaces go first; a rare one between, before or behind them still goes."""
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    values = [f"{s} 　{t}a {s}名{t}\t{s}" for s in spaces for t in (spaces[0], " ")]
    values += ["　", "~、", "\x7f ", "﻿ x", "名 "]
    assert column(spark, values, lambda df: text.strip_spaces(F.col("v"))) == [v.strip() for v in values]
    assert column(spark, values, lambda df: text.has_text(F.col("v"))) == [bool(v.strip()) for v in values]


def test_values_without_need_of_python_come_back_as_they_are():
    import pyarrow as pa

    nothing = pa.nulls(3, pa.string())
    assert text._per_distinct(nothing, None) is nothing
    some = pa.array(["b", None, "a", "b"])
    assert text._per_distinct(some, str.upper).to_pylist() == ["B", None, "A", "B"]
