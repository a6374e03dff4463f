"""Scalar expressions on ratings, similarities and scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 6

# A mean over 64 ratings can end exactly on half of the last kept digit, where
# the order of summation would decide the rounding.  The nudge decides it.
_HALF_NUDGE = 1e-10


def stable_round(value: Column, digits: int = SCORE_DIGITS) -> Column:
    """Round so that values on a rounding boundary always go up."""
    return F.round(value + F.lit(_HALF_NUDGE), digits)


def stable_round_array(values: np.ndarray, digits: int = SCORE_DIGITS) -> np.ndarray:
    """The same for an array."""
    return np.round(values + _HALF_NUDGE, digits)


def half_scale(cosine: Column) -> Column:
    """Map a cosine from [-1, 1] to a weight in [0, 1]."""
    return F.lit(0.5) + F.lit(0.5) * cosine


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null for a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def implicit_confidence(rating: Column) -> Column:
    """Rating on a 1-5 scale to a signed confidence around zero."""
    return rating - F.lit(2.5)


def implicit_truth(confidence: Column) -> Column:
    """1.0 for a positive confidence, else 0.0."""
    return F.when(confidence > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def clamp_unit(value: Column) -> Column:
    """Clamp to [0, 1]."""
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))


def dot(left: Column, right: Column) -> Column:
    """Dot product of two equally long arrays."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )


def scale_by(vector: Column, factors: list[float]) -> Column:
    """Element-wise product of an array with fixed factors."""
    if not factors:
        return vector
    weights = F.array(*[F.lit(float(x)) for x in factors])
    return F.zip_with(vector, weights, lambda a, b: a * b)


def hash_percent(*parts: Column | str, seed: int) -> Column:
    """A reproducible value in 0..99 from the md5 of ``part:part:...:seed``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100


def hash_text(*parts: Column | str, seed: int) -> Column:
    """The md5 of ``part:part:...:seed`` in hex; a uniform, reproducible sort key."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed))))
