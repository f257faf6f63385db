"""Running sums and maxima along a sequence, without one task for the whole of it.

A sequence is cut into stretches that are in order; windows run within stretches and over one row for each stretch, so a
long sequence is many tasks. Rows are brought to their stretches once, and what is joined with them later comes by
stretch, so the rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "_part"


def stretched(rows: DataFrame, by: str, part: Column) -> DataFrame:
    """The rows, each stretch in one task; ``_part`` names the stretch. All that follows reads this one exchange."""
    return rows.withColumn(PART, part.cast("long")).repartition(by, PART)


def along(cut: DataFrame, by: str, order: str, sums: dict[str, Column] | None = None, latest: dict[str, Column] | None = None, before: dict[str, Column] | None = None, marks: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Adds running columns within each ``by`` to stretched rows: ``sums`` (of what isn't negative) up to and with the row,
    ``latest`` the greatest value up to and with it, ``before`` the greatest value before it, and ``marks`` the value that a
    sum had at the last row before it where a condition holds."""
    sums, latest, before, marks = sums or {}, latest or {}, before or {}, marks or {}
    here = Window.partitionBy(by, PART).orderBy(order)
    upto, ahead = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select("*", *[F.sum(c).over(upto).alias(f"_l_{n}") for n, c in sums.items()], *[F.max(c).over(upto).alias(f"_l_{n}") for n, c in latest.items()], *[F.max(c).over(ahead).alias(f"_l_{n}") for n, c in before.items()])
    at = {n: F.when(c, F.col(f"_l_{s}")) for n, (c, s) in marks.items()}
    source, total = cut, {n: F.sum(c) for n, c in sums.items()}
    if marks:
        source, total = local, {n: F.max(f"_l_{n}") for n in sums}
        local = local.select("*", *[F.max(c).over(ahead).alias(f"_l_{n}") for n, c in at.items()])
    totals = source.groupBy(by, PART).agg(*[c.alias(f"_t_{n}") for n, c in total.items()], *[F.max(c).alias(f"_t_{n}") for n, c in {**latest, **before, **at}.items()])
    earlier = Window.partitionBy(by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("*", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.max(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in {**latest, **before}])
    carried = carried.select(by, PART, *[f"_b_{n}" for n in {**sums, **latest, **before}], *[F.max(F.col(f"_t_{n}") + F.col(f"_b_{s}")).over(earlier).alias(f"_b_{n}") for n, (_, s) in marks.items()])
    both = local.join(carried, [by, PART])
    return both.select(
        *cut.columns,
        *[(F.col(f"_b_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_b_{n}", f"_l_{n}").alias(n) for n in {**latest, **before}],
        *[F.coalesce(F.col(f"_l_{n}") + F.col(f"_b_{s}"), F.col(f"_b_{n}")).alias(n) for n, (_, s) in marks.items()],
    )


def by_stretch(rows: DataFrame, by: str, table: DataFrame, how: str, cut: DataFrame) -> DataFrame:
    """Rows that were made of the stretches of ``cut``, with the columns of a table that has a row for each ``by``; joined by
    stretch, so that neither the rows move nor one task gets all rows of a ``by``."""
    parts = cut.select(by, PART).distinct()
    return rows.join(parts.join(table, by), [by, PART], how)


def running(rows: DataFrame, by: str, part: Column, order: str, **columns) -> DataFrame:
    """``along`` for rows that aren't stretched yet."""
    return along(stretched(rows, by, part), by, order, **columns).drop(PART)
