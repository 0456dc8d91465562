"""Special functions as column expressions, and scalar ones for parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015328606
_SHIFT = 8
#: Bernoulli coefficients of the asymptotic series of digamma in 1/x**2.
_SERIES = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760)


def digamma(x: Column) -> Column:
    """ψ(x) for x > 0 in plain arithmetic, so that it stays in generated code; about 1e-15 off at most.

    The argument is moved up by eight, where the asymptotic series needs six terms.
    """
    x = x.cast("double")
    y = x + _SHIFT
    out = F.log(y) - 0.5 / y
    inv = 1.0 / (y * y)
    power = inv
    for c in _SERIES:
        out = out - power * c
        power = power * inv
    for i in range(_SHIFT):
        out = out - 1.0 / (x + i)
    return out


def digamma_value(x: float) -> float:
    """ψ(x) of a number."""
    y, out = x, 0.0
    while y < 10:
        out -= 1 / y
        y += 1
    out += math.log(y) - 0.5 / y
    inv = power = 1 / (y * y)
    for c in _SERIES:
        out -= power * c
        power *= inv
    return out


def trigamma_value(x: float) -> float:
    """ψ'(x) of a number."""
    out = 0.0
    while x < 12:
        out += 1 / (x * x)
        x += 1
    inv = 1 / (x * x)
    return out + 1 / x + inv / 2 + inv / x * (1 / 6 - inv * (1 / 30 - inv * (1 / 42 - inv * (1 / 30 - inv * 5 / 66))))


def unit_ball_volume(dim: int, p: float = 2.0, radius: float = 1.0) -> float:
    """Volume of the ball of a radius under the Minkowski norm ``p`` (``math.inf``: Chebyshev)."""
    if math.isinf(p):
        return (2 * radius) ** dim
    if p == 2:
        return math.pi ** (dim / 2) * radius**dim / math.gamma(dim / 2 + 1)
    return (2 * radius * math.gamma(1 + 1 / p)) ** dim / math.gamma(1 + dim / p)
