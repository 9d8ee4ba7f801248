"""Cell and name cleaning as column expressions.

Everything stays in JVM expressions except Unicode NFKC and case folding, which
Spark has no built-in for. Those two run in Arrow-batched UDFs that receive null
for values where a built-in gives the same: pure ASCII, and for NFKC alone
ideographs and full-width forms.
"""

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsheet.schemas import CHINESE_NUMERALS, MODULE_SUFFIX

# The 29 characters Python counts as whitespace; Java's \s alone has six of them.
SPACE_SET = r"\t-\r\x1c-\x1f \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The first half of the intersection is one cheap range test that settles most characters.
SPACE = f"[[^!-~]&&[{SPACE_SET}]]"
OTHER_SPACE = f"[[^!-~ ]&&[{SPACE_SET}]]"  # any but the plain one
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
USUAL_SPACES = " \t\n\r\u3000"
# Unified ideographs stay as they are under NFKC, full-width forms become ASCII, and nothing of
# these combines with a neighbour: texts of them need no Python.
WIDE = "\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = " " + "".join(map(chr, range(0x21, 0x7F)))
PLAIN_WIDTHS = r"\A[\x00-\x7f\u3000\u4e00-\u9fff\uff01-\uff5e]*\z"
CJK = r"[\u3400-\u9fff]"
BOM = "\ufeff"


def _per_distinct(values: pa.Array, fn: Callable[[str], str]) -> pa.Array:
    if values.null_count == len(values):  # most batches: nothing for Python in them
        return values
    coded = values.dictionary_encode()
    known = pa.array([fn(v) for v in coded.dictionary.to_pylist()], type=pa.string())
    return known.take(coded.indices)


@F.arrow_udf(T.StringType())
def _nfkc_udf(values: pa.Array) -> pa.Array:
    return _per_distinct(values, lambda v: unicodedata.normalize("NFKC", v))


@F.arrow_udf(T.StringType())
def _nfkc_fold_udf(values: pa.Array) -> pa.Array:
    return _per_distinct(values, lambda v: unicodedata.normalize("NFKC", v).casefold())


@F.arrow_udf(T.StringType())
def quoted(values: pa.Array) -> pa.Array:
    """Python-style quoting of a serial for issue texts (only run on issue rows)."""
    return _per_distinct(values, repr)


def _non_ascii(col: Column) -> Column:
    return F.when(F.length(col) != F.octet_length(col), col)


def nfkc(col: Column) -> Column:
    wide = _non_ascii(col)
    plain = wide.rlike(PLAIN_WIDTHS)
    other = F.coalesce(_nfkc_udf(F.when(~plain, wide)), col)
    return F.when(plain, F.translate(wide, WIDE, NARROW)).otherwise(other)


def nfkc_fold(col: Column) -> Column:
    return F.coalesce(_nfkc_fold_udf(_non_ascii(col)), F.lower(col))


def _is_solid(character: Column) -> Column:
    """Whether it is surely no space: printable ASCII, or beyond the last space there is."""
    return ((character >= "!") & (character <= "~")) | (character > SPACES[-1])


def collapse_spaces(col: Column) -> Column:
    """Single plain spaces inside, none around; most cells are so already and only searched."""
    uneven = F.contains(col, F.lit("  ")) | F.startswith(col, F.lit(" ")) | F.endswith(col, F.lit(" "))
    collapsed = F.trim(F.regexp_replace(col, SPACE + "+", " "))
    return F.when(uneven | col.rlike(OTHER_SPACE), collapsed).otherwise(col)


def strip_spaces(col: Column) -> Column:
    """Without spaces at both ends; only cells with a rare space there meet all 29 of them."""
    short = F.btrim(col, F.lit(USUAL_SPACES))
    solid = _is_solid(F.substring(short, 1, 1)) & _is_solid(F.substring(short, -1, 1))
    return F.when(solid, short).otherwise(F.btrim(short, F.lit(SPACES)))


def has_text(col: Column, besides: str = "") -> Column:
    """Whether a cell holds anything but spaces; stops at the first such character.

    Most cells start with one, and of the others most have one that a range test settles.
    """
    first = F.substring(col, 1, 1)
    found = F.when((first >= "!") & (first <= "~"), True)
    found = found.otherwise(col.rlike(f"[!-~[^{SPACE_SET}{besides}]]"))
    return F.coalesce(found, F.lit(False))


def cell_text(df: DataFrame, column: str) -> Column:
    """Text of a raw cell: whole floats lose their fraction, booleans are capitalised."""
    col, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = F.when(col == F.floor(col), col.cast("decimal(38,0)").cast("string"))
        return F.coalesce(whole, col.cast("string"))
    return col.cast("string")


def display_name(col: Column) -> Column:
    bare = F.replace(col, F.lit(BOM), F.lit(""))
    return F.coalesce(collapse_spaces(bare), F.lit(""))


def normalized_serial(col: Column) -> Column:
    text = nfkc(F.coalesce(col, F.lit("")))
    return F.when(text.rlike(SPACE), F.regexp_replace(text, SPACE + "+", "")).otherwise(text)


def record_cell(col: Column) -> Column:
    return F.coalesce(strip_spaces(col.cast("string")), F.lit(""))


def outline_level(serial: Column, name: Column) -> Column:
    """Depth of a row from the shape of its normalised serial."""
    numeral = f"[{CHINESE_NUMERALS}]+"
    bracketed = (
        F.when(serial.rlike(r"\A\(\p{Nd}+\)\z"), "module")
        .when(serial.rlike(rf"\A\({numeral}\)\z"), "system")
        .otherwise("unknown")
    )
    return (
        F.when((serial == "") & (name != ""), "category")
        .when(F.startswith(serial, F.lit("(")), bracketed)
        .when(serial.rlike(r"\A\p{Nd}+\z"), "software")
        .when(serial.rlike(rf"\A{numeral}\z"), "platform")
        .otherwise("unknown")
    )


def comparable_name(
    name: Column,
    drop_suffix: Column | bool = False,
    join_cjk: bool = True,
) -> Column:
    """The text that is compared: folded, single-spaced, no spaces between CJK characters.

    Case folding neither makes nor removes spaces or CJK characters, so it can share
    one Python hop with NFKC ahead of the remaining built-in steps.
    """
    text = collapse_spaces(nfkc_fold(display_name(name)))
    if join_cjk:
        text = F.regexp_replace(text, rf"(?<={CJK}) (?={CJK})", "")
    if drop_suffix is False:
        return text
    cut = F.rtrim(F.regexp_replace(text, MODULE_SUFFIX + r"\z", ""))
    return F.when(F.lit(drop_suffix) if drop_suffix is True else drop_suffix, cut).otherwise(text)
