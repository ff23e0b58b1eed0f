"""Column expressions for special functions, portable draws and dot products."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Asymptotic series of digamma and log-gamma in 1/z, used after shifting the argument by 8.
SHIFT = 8
DIGAMMA_SERIES = [1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132]
LOG_GAMMA_SERIES = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _horner(y, coefficients):
    out = coefficients[-1] * y
    for c in reversed(coefficients[:-1]):
        out = (out + c) * y
    return out


def _digamma(x, log):
    z = x + SHIFT
    back = 1 / x
    for j in range(1, SHIFT):
        back = back + 1 / (x + j)
    return log(z) - 0.5 / z - _horner(1 / (z * z), DIGAMMA_SERIES) - back


def _log_gamma(x, log):
    z = x + SHIFT
    rising = x
    for j in range(1, SHIFT):
        rising = rising * (x + j)
    y = 1 / z
    series = _horner(y * y, LOG_GAMMA_SERIES) * z
    return (z - 0.5) * log(z) - z + HALF_LOG_2PI + series - log(rising)


def digamma(x: Column) -> Column:
    return _digamma(x, F.ln)


def log_gamma(x: Column) -> Column:
    return _log_gamma(x, F.ln)


def digamma_np(x: np.ndarray) -> np.ndarray:
    return _digamma(x, np.log)


def log_gamma_np(x: np.ndarray) -> np.ndarray:
    return _log_gamma(x, np.log)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def clean_round(x: Column, digits: int = 6) -> Column:
    """Rounding that never yields a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def uniform_of(digest: Column, word: int = 0) -> Column:
    """A uniform in (0, 1) from one of the four 32-bit words of an md5 digest."""
    bits = F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(4294967296.0)


def hash_order(seed, key: Column) -> Column:
    """A string whose order is a shuffle of the keys that any engine with md5 can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def _gamma_of(digest: Column, first_word: int, shape: float) -> Column:
    """One Gamma(shape, 1) draw: Wilson-Hilferty cube of a Box-Muller normal.

    Shapes below 10 are raised by whole steps first and brought back by the exact recursion
    Gamma(s) = Gamma(s + 1) * U ** (1 / s), since the cube is accurate for larger shapes only.
    """
    lift = max(0, math.ceil(10 - shape))
    s = shape + lift
    normal = F.sqrt(-2.0 * F.ln(uniform_of(digest, first_word))) * F.cos(
        2.0 * math.pi * uniform_of(digest, first_word + 1)
    )
    draw = s * F.pow(1.0 - 1.0 / (9.0 * s) + normal / (3.0 * math.sqrt(s)), F.lit(3.0))
    for j in range(lift):
        extra = F.md5(F.concat(digest, F.lit(f":{first_word}:{j}")))
        draw = draw * F.pow(uniform_of(extra), F.lit(1.0 / (shape + j)))
    return draw


def gamma_pairs(seed, role: str, key: Column, n_components: int, shape: float) -> Column:
    """``n_components`` independent (g, r) pairs per key, each Gamma(shape, 1); same on any partitioning."""
    prefix = F.concat_ws(":", F.lit(str(seed)), F.lit(role), key.cast("string"))
    numbers = F.sequence(F.lit(0), F.lit(n_components - 1))

    def draw(p: Column) -> Column:
        digests = F.transform(numbers, lambda k: F.md5(F.concat(p, F.lit(":"), k.cast("string"))))
        return F.transform(
            digests,
            lambda h: F.struct(_gamma_of(h, 0, shape).alias("g"), _gamma_of(h, 2, shape).alias("r")),
        )

    # as a lambda variable the prefix is built once per key, not once per component
    return F.transform(F.array(prefix), draw)[0]
