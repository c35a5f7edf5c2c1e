"""Arithmetic of seconds, samples, frames and shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 9223372036854775807


def second_to_sample(seconds: Column, rate: Column, half_up: bool = False) -> Column:
    """Sample at a time (float32 seconds), cut off, or as a count rounded half up; 0 at or before 0."""
    at = seconds.cast("float").cast("double") * rate + (0.5 if half_up else 0.0)
    return F.when((seconds.cast("float") <= 0) | (rate <= 0), F.lit(0).cast("long")).when(at >= float(MOST), F.lit(MOST)).otherwise(F.floor(at).cast("long"))


def frames_floor(samples: Column, ratio: int) -> Column:
    """Whole frames of ``ratio`` samples; null below 0."""
    return F.when(samples >= 0, ((samples - F.pmod(samples, F.lit(ratio))) / ratio).cast("long"))


def frames_ceil(samples: Column, ratio: int) -> Column:
    """Frames that hold all samples; null below 0."""
    return frames_floor(samples, ratio) + (F.pmod(samples, F.lit(ratio)) > 0).cast("long")


def ceil_to_multiple(value: Column, multiple: Column) -> Column:
    """The least multiple at or above a positive value; null if either isn't above 0, or beyond 64 bits."""
    more = F.pmod(multiple - F.pmod(value, multiple), multiple)
    return F.when((value > 0) & (multiple > 0) & (value <= F.lit(MOST) - more), value + more)


def percent(current: Column, total: Column) -> Column:
    """Whole percent done, half up, between 0 and 100; 100 of nothing."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), current / F.when(total > 0, total)))
    return F.when(total <= 0, 100).otherwise(F.floor(part * 100 + 0.5)).cast("int")


def elements(shape: Column) -> Column:
    """Elements of a shape; null if a dimension isn't above 0 or the product is beyond 64 bits."""
    fits = F.aggregate(shape, F.lit(1.0), lambda a, d: a * d) < float(MOST)
    product = F.aggregate(shape, F.lit(1).cast("long"), lambda a, d: F.try_multiply(a, d.cast("long")))
    return F.when(F.forall(shape, lambda d: d > 0) & fits, product)


def shape_matches(shape: Column, model: Column) -> Column:
    """Whether a shape fits a model's, whose dimensions of 0 or less match any."""
    pairs = F.zip_with(shape, model, lambda a, b: (b <= 0) | a.eqNullSafe(b))
    return (F.size(shape) == F.size(model)) & F.forall(pairs, lambda x: F.coalesce(x, F.lit(False)))


def emission_shape(shape: Column) -> Column:
    """(frames, vocabulary) of an emission tensor of rank 2, or 3 with a batch of 1; null otherwise."""
    two = F.when(F.size(shape) == 2, shape).when((F.size(shape) == 3) & (F.get(shape, F.lit(0)) == 1), F.slice(shape, 2, 2))
    return F.when(F.forall(two, lambda d: d > 0), two)


def first_not_finite(values: Column) -> Column:
    """Index of the first value that is null, NaN or infinite; null if all are finite."""
    bad = F.transform(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.nullif(F.array_position(bad, True) - 1, F.lit(-1))
