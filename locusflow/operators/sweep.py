"""Running sums and carried values over ordered rows, without one task for all of them.

Rows fall into ranges of their order value; inside a range a window runs, and what
crosses a range's border is carried over from the ranges before it.  The ranges'
totals are rows of the same kind, ``FAN`` times fewer, so they are swept the same way:
four levels cover every 64-bit order value, and no window has more than ``FAN`` order
values in a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordinal import fresh_name

#: Order values of a range, as a power of two, and levels above the rows.
BITS, LEVELS = 16, 3


def _joined(how: str, *parts: Column) -> Column:
    """Parts of a running total put together; a missing part adds nothing."""
    if how == "max":
        return F.greatest(*parts)
    total = F.coalesce(parts[0], F.lit(0))
    for p in parts[1:]:
        total = total + F.coalesce(p, F.lit(0))
    return total


def _carried(sums: DataFrame, how: str, levels: int = LEVELS) -> DataFrame:
    """(_at, _before): what the ranges before each range come to; ``sums`` are (_at, _x)."""
    f = getattr(F, how)
    up = F.shiftright("_at", BITS) if levels > 1 else F.pmod(F.shiftright("_at", BITS), F.lit(1))  # both signs meet at the top
    w = W.partitionBy("_up").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    inside = sums.withColumn("_up", up).withColumn("_in", f("_x").over(w))
    if levels == 1:
        return inside.select("_at", F.col("_in").alias("_before"))
    above = _carried(inside.groupBy(F.col("_up").alias("_at")).agg(f("_x").alias("_x")), how, levels - 1)
    above = above.select(F.col("_at").alias("_up"), F.col("_before").alias("_over"))
    return inside.join(above, "_up").select("_at", _joined(how, F.col("_over"), F.col("_in")).alias("_before"))


def running(df: DataFrame, value: Column, order: str, name: str, how: str = "sum", ties: tuple[str, ...] = (), inclusive: bool = False) -> DataFrame:
    """Adds the running ``how`` (sum or max) of ``value`` over all rows in the order of the long
    column ``order`` and then ``ties``: of the rows before, or with ``inclusive`` up to the row
    itself.  A sum of nothing is 0, a maximum of nothing null; rows without an order go first."""
    f = getattr(F, how)
    at, x, part = (fresh_name(df.columns, c) for c in ("_range", "_value", "_inside"))
    w = W.partitionBy(at).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    rows = df.withColumn(at, F.coalesce(F.shiftright(F.col(order).cast("long"), BITS), F.lit(-(1 << 47)))).withColumn(x, value)
    rows = rows.withColumn(part, f(x).over(w))
    before = _carried(rows.groupBy(F.col(at).alias("_at")).agg(f(x).alias("_x")), how)
    out = rows.join(before.withColumnRenamed("_at", at), at)
    return out.withColumn(name, _joined(how, F.col("_before"), F.col(part))).drop(at, x, part, "_before")
