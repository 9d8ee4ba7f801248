"""Cosine, threshold and band as column expressions.

The block scorer does the heavy arithmetic; these forms serve small inputs, checks
and the presentation layer.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinsheet.schemas import LABEL_BANDS, LABEL_EXACT, LABEL_LOW

NORM_FLOOR = 1e-12
THRESHOLD_TOLERANCE = 1e-7


def norm(vec: Column) -> Column:
    squares = F.transform(vec, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def unit(vec: Column) -> Column:
    length = F.greatest(norm(vec), F.lit(NORM_FLOOR))
    return F.transform(vec, lambda x: x.cast("double") / length)


def cosine(unit_a: Column, unit_b: Column) -> Column:
    products = F.zip_with(unit_a, unit_b, lambda x, y: x * y)
    dot = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def reaches(score: Column, threshold: float) -> Column:
    return score + F.lit(THRESHOLD_TOLERANCE) >= F.lit(float(threshold))


def band(name_a: Column, name_b: Column, score: Column) -> Column:
    label = F.when(name_a == name_b, LABEL_EXACT)
    for floor, text in LABEL_BANDS:
        label = label.when(score >= F.lit(floor), text)
    return label.otherwise(LABEL_LOW)
