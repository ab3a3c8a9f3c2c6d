"""Column expressions for pixels, boxes, indices and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounding guard of ratios such as v / (max + EPSILON).
EPSILON = 1e-8


def clip(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def source_index(i: Column, source: Column, target: Column, rule: str = "half_even") -> Column:
    """Where target index i is sampled from: ``half_even`` spreads both ends, ``floor`` scales."""
    if rule == "floor":
        return F.floor(i * source / target).cast("int")
    if rule != "half_even":
        raise ValueError(f"no such rule: {rule}")
    step = (source - 1) / (target - 1)
    return F.when(target == 1, 0).otherwise(F.bround(i * F.when(target > 1, step), 0)).cast("int")


def axis_order(shape: Column) -> Column:
    """Axes of an array from its rank: channels lead in 4-D only where the first axis is 1 to 4."""
    first = F.try_element_at(shape, F.lit(1))
    return (
        F.when((F.size(shape) == 4) & first.between(1, 4), "CZYX")
        .when(F.size(shape) == 4, "ZYXC")
        .when(F.size(shape) == 3, "ZYX")
        .when(F.size(shape) == 5, "TCZYX")
    )


def slice_name(z: Column) -> Column:
    return F.format_string("%03d", z)


def prediction_file(z: Column) -> Column:
    return F.format_string("slice_%03d_pred.png", z)


def numbers(text: Column) -> Column:
    """'1,2,4' as an array of doubles."""
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("double"))


def class_rgb(cls: Column) -> Column:
    """Colour of a class: light green, moderate yellow, dense red, else black."""
    rgb = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    return (
        F.when(cls == 1, rgb(0, 255, 0)).when(cls == 2, rgb(255, 255, 0)).when(cls == 3, rgb(255, 0, 0)).otherwise(rgb(0, 0, 0))
    )


def to_byte(v: Column) -> Column:
    """A value of 0..1 as 0..255: scaled, clipped, then cut (not rounded)."""
    return F.least(F.greatest(v * 255, F.lit(0)), F.lit(255)).cast("int")


def shuffled(seed: int, *key: str) -> Column:
    """A reproducible random order: md5 of the seed and the key columns, whatever the partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *key))
