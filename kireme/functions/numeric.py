"""Integer arithmetic of the quantized scorers, as columns and in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

I16 = (-32768, 32767)
I32 = (-(1 << 31), (1 << 31) - 1)


def clamp(v: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def requant_i16(v: Column) -> Column:
    """(v + 256) >> 9, clamped to 16 bits."""
    return clamp(F.shiftright(v.cast("long") + 256, 9), *I16).cast("int")


def saturate_i32(v: Column) -> Column:
    return clamp(v, *I32).cast("int")


def relu_dot(acc: Column, w2: Column) -> Column:
    """Sum of w2 * max(acc, 0) over two arrays."""
    return F.aggregate(F.zip_with(acc, w2, lambda a, w: F.greatest(a.cast("long"), F.lit(0).cast("long")) * w.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


def fused_i16(b1: Column, blocks: Column, w2: Column) -> Column:
    """The saturating scorer over an array of blocks: each block is added in turn and clamped, then ReLU and dot."""
    acc = F.aggregate(blocks, b1, lambda a, block: F.zip_with(a, block, lambda x, y: clamp(x + y, *I16)))
    return relu_dot(acc, w2)


def bce(y: Column, t: Column) -> Column:
    """Binary cross-entropy of a logit, stable at both ends."""
    return F.greatest(y, F.lit(0.0)) - y * t + F.log1p(F.exp(-F.abs(y)))


def quantized(x: Column, scale: Column) -> Column:
    """x in units of ``scale``, halves away from zero, clamped to 16 bits but for the lowest value."""
    return clamp(F.sign(x) * F.floor(F.abs(x) / scale + 0.5), -I16[1], I16[1]).cast("int")


def scale_of(largest: Column) -> Column:
    """The unit in which the largest absolute value is 32767; 1 where all are zero."""
    return F.when(largest > 0, largest / I16[1]).otherwise(1.0)


def round_away(x: np.ndarray) -> np.ndarray:
    """Nearest integer, halves away from zero."""
    whole = np.trunc(x)
    return np.where(np.abs(x - whole) >= 0.5, whole + np.sign(x), whole)


def add_saturated(acc: np.ndarray, block: np.ndarray) -> np.ndarray:
    return np.clip(acc.astype(np.int32) + block, *I16).astype(np.int16)


def requant(v: np.ndarray) -> np.ndarray:
    return np.clip((np.asarray(v, np.int64) + 256) >> 9, *I16).astype(np.int16)
