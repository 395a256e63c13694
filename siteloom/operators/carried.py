"""Running values along a contig without a task that sees the whole contig.

Rows are range-partitioned by (keys, order) and written once, so that each row keeps its range. Inside a range, windows
give running sums and maxima and the row beside. What a range adds or needs at its borders is one row for each range and
key; only keys that lie in several ranges have any, so the table of borders, which is broadcast, has at most two rows a
range, however many keys and rows there are. The result doesn't depend on the number of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.sources.shared import stored

#: The column that tells a row's range.
RANGE = "_range"


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` in ranges of (keys, order), written; rows equal in both stay in some order of their own."""
    by = [*keys, *order]
    return stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(RANGE, F.spark_partition_id()), "ranged")


def carried(t: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """A table of :func:`ranged` with more columns along ``order`` within ``keys``.

    ``sums`` and ``maxima`` run up to the row (``inclusive``) or up to the one before it (then 0 and null at the first row);
    ``before`` and ``after`` are values of the rows beside, null at the ends.
    """
    sums, maxima, before, after = sums or {}, maxima or {}, before or {}, after or {}
    place = F.struct(*order, "_tie")
    t = t.withColumn("_tie", F.monotonically_increasing_id())
    t = t.withColumns({f"_v_{n}": c for group in (sums, maxima, before, after) for n, c in group.items()})
    values = [*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums], *[F.max(f"_v_{n}").alias(f"_b_{n}") for n in maxima]]
    values += [F.max_by(F.struct(f"_v_{n}"), place).alias(f"_b_{n}") for n in before] + [F.min_by(F.struct(f"_v_{n}"), place).alias(f"_b_{n}") for n in after]
    borders = t.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("_rows"), *values)
    by_key = Window.partitionBy(*keys)
    along = by_key.orderBy(RANGE)
    up_to = along.rowsBetween(Window.unboundedPreceding, -1)
    borders = borders.withColumn("_ranges", F.count(F.lit(1)).over(by_key)).where("_ranges > 1")
    borders = borders.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(RANGE).alias("_k_range"), *[F.sum(f"_b_{n}").over(up_to).alias(f"_c_{n}") for n in sums], *[F.max(f"_b_{n}").over(up_to).alias(f"_c_{n}") for n in maxima],
        *[F.lag(f"_b_{n}").over(along)[f"_v_{n}"].alias(f"_c_{n}") for n in before], *[F.lead(f"_b_{n}").over(along)[f"_v_{n}"].alias(f"_c_{n}") for n in after])
    same = F.col(RANGE) == F.col("_k_range")
    for k in keys:
        same = same & t[k].eqNullSafe(F.col(f"_k_{k}"))
    j = t.join(F.broadcast(borders), same, "left")
    w = Window.partitionBy(RANGE, *keys).orderBy(*order, "_tie")
    rows = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    out = {n: F.coalesce(F.sum(f"_v_{n}").over(rows), F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums}
    out |= {n: F.greatest(F.max(f"_v_{n}").over(rows), f"_c_{n}") for n in maxima}
    out |= {n: F.when(first, F.col(f"_c_{n}")).otherwise(F.lag(f"_v_{n}").over(w)) for n in before}
    out |= {n: F.when(last, F.col(f"_c_{n}")).otherwise(F.lead(f"_v_{n}").over(w)) for n in after}
    made = [*sums, *maxima, *before, *after]
    return j.withColumns(out).drop("_tie", "_k_range", *[f"_k_{k}" for k in keys], *[f"_v_{n}" for n in made], *[f"_c_{n}" for n in made])


def in_blocks(df: DataFrame, position: Column, reach_back: int, reach_ahead: int, block: int) -> DataFrame:
    """Rows dealt into blocks of ``block`` along ``position``, and into those whose rows they reach, as copies.

    ``_block`` is the block, ``_own`` whether the row belongs to it. A row needs those up to ``reach_back`` before it and
    ``reach_ahead`` after it.
    """
    touched = F.sequence(F.floor((position - reach_ahead) / block), F.floor((position + reach_back) / block))
    return df.withColumn("_home", F.floor(position / block)).withColumn("_block", F.explode(touched)).withColumn("_own", F.col("_block") == F.col("_home")).drop("_home")
