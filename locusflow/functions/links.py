"""Links from a variant's argument to its heritability, as Column and as array expressions.

A link has a value and its first two derivatives in both forms.  ``register`` compares
the forms with each other and the derivatives with differences, so a wrong one is
refused before any fit uses it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import numeric


@dataclass(frozen=True)
class Link:
    """(value, first, second derivative), before the denominator, of columns and of arrays."""

    name: str
    columns: Callable[[Column], tuple[Column, Column, Column]]
    arrays: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _logistic(x: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + small), small / (1 + small))


def _softplus_arrays(x: np.ndarray):
    p = _logistic(x)
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x))), p, p * (1 - p)


def _exponential_columns(x: Column):
    return F.exp(x), F.exp(x), F.exp(x)


LINKS: dict[str, Link] = {}
_POINTS = np.linspace(-4, 4, 33)


def check(link: Link, spark: SparkSession | None = None, points: np.ndarray = _POINTS) -> None:
    """Raises ValueError for a negative value, a wrong derivative, or (with a session) forms
    that differ."""
    step = 1e-4
    value, first, second = (np.asarray(v, float) for v in link.arrays(points))
    ahead, back = link.arrays(points + step), link.arrays(points - step)
    if (value < 0).any() or not np.isfinite(value).all():
        raise ValueError(f"link {link.name}: values must be finite and not negative")
    for got, k, what in ((first, 0, "first"), (second, 1, "second")):
        want = (np.asarray(ahead[k], float) - np.asarray(back[k], float)) / (2 * step)
        if not np.allclose(got, want, rtol=1e-5, atol=1e-6):
            raise ValueError(f"link {link.name}: the {what} derivative is wrong")
    if spark is not None:
        rows = spark.createDataFrame([(float(x),) for x in points], "x double").select("x", *[c.cast("double").alias(f"c{k}") for k, c in enumerate(link.columns(F.col("x")))]).orderBy("x").collect()
        if not np.allclose(np.array([tuple(r)[1:] for r in rows]).T, [value, first, second], rtol=1e-9, atol=1e-12):
            raise ValueError(f"link {link.name}: the column form differs from the array form")


def register(link: Link, spark: SparkSession | None = None) -> Link:
    """Makes a link known by its name, once it has passed ``check``."""
    check(link, spark)
    LINKS[link.name] = link
    return link


def named(name: str | Link) -> Link:
    if isinstance(name, Link):
        return name
    if name not in LINKS:
        raise ValueError(f"no link {name}; there are {sorted(LINKS)}")
    return LINKS[name]


register(Link("softplus", lambda x: numeric.link(x, 1.0), _softplus_arrays))
register(Link("exponential", _exponential_columns, lambda x: (np.exp(x), np.exp(x), np.exp(x))))
