"""Edge-weight kernels: functions of a correlation column, all inside code generation.

A kernel maps a correlation ``c`` to a weight; it may take ``sigma`` or ``n``. NaN correlations are dropped before
(``nan_policy='drop'``) or taken as 0 (``nan_policy='zero_corr'``), see ``layerwalk.operators.layers``.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Kernel = Callable[..., Column]


def power(c: Column, n: float = 30) -> Column:
    """abs((c + 1) / 2) ** n."""
    return F.pow(F.abs(0.5 * (c + 1)), F.lit(float(n)))


def gaussian_shifted(c: Column, sigma: float = 0.05) -> Column:
    """exp(-((1 - (c + 1) / 2) / sigma)**2 / 2)."""
    return F.exp(-0.5 * F.pow((1 - 0.5 * (c + 1)) / sigma, F.lit(2.0)))


def exponential_shifted(c: Column, sigma: float = 0.05) -> Column:
    """exp(-(1 - (c + 1) / 2) / sigma)."""
    return F.exp(-(1 - 0.5 * (c + 1)) / sigma)


def gaussian_abs(c: Column, sigma: float = 0.05) -> Column:
    """exp(-((1 - abs(c)) / sigma)**2 / 2)."""
    return F.exp(-0.5 * F.pow((1 - F.abs(c)) / sigma, F.lit(2.0)))


def exponential_abs(c: Column, sigma: float = 0.01) -> Column:
    """exp(-(1 - abs(c)) / sigma)."""
    return F.exp(-(1 - F.abs(c)) / sigma)


def absolute(c: Column) -> Column:
    """abs(c); what is not finite becomes 0."""
    return F.coalesce(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.abs(c)), F.lit(0.0))


def sign(c: Column) -> Column:
    """Sign of the correlation as -1, 0 or 1."""
    return F.signum(c).cast("int")


def thresholded_sign(c: Column, least: float = 0.1) -> Column:
    """1 above ``least``, -1 below its negative, else 0."""
    return F.when(c > least, 1).when(c < -least, -1).otherwise(0)


KERNELS: dict[str, Kernel] = {
    "power": power, "gaussian_shifted": gaussian_shifted, "exponential_shifted": exponential_shifted,
    "gaussian_abs": gaussian_abs, "exponential_abs": exponential_abs, "absolute": absolute,
}
#: Kernels whose all-pairs form keeps self-loops of weight 1.
KEEPS_DIAGONAL = frozenset({"power", "gaussian_shifted", "exponential_shifted"})


def apply(kernel: str | Kernel, c: Column, sigma: float | None = None, n: float | None = None) -> Column:
    """A kernel by name or a user's callable on ``c``; only parameters that it accepts are passed on."""
    if isinstance(kernel, str):
        if kernel not in KERNELS:
            raise ValueError(f"unknown kernel {kernel!r}; known: {', '.join(KERNELS)}")
        kernel = KERNELS[kernel]
    try:
        takes = inspect.signature(kernel).parameters
    except (TypeError, ValueError):
        takes = {}
    given = {k: v for k, v in (("sigma", sigma), ("n", n)) if v is not None and k in takes}
    return kernel(c, **given)


def inverse_threshold(kernel: str, weight: float, sigma: float | None = None, n: float | None = None) -> float | None:
    """The least abs(c) (or c, for a shifted kernel) whose weight reaches ``weight``; None where there is no such rule."""
    import math

    if not 0 < weight <= 1:
        return None
    if kernel == "exponential_abs":
        return 1 + (sigma or 0.01) * math.log(weight)
    if kernel == "gaussian_abs":
        return 1 - (sigma or 0.05) * math.sqrt(-2 * math.log(weight))
    return None
