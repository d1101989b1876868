"""Running totals, ranks and exact quantiles over a global order, without a one-task sort.

A plain window over "all rows ordered by score" is a single task. Here rows are
first folded to distinct order keys (so a value held by a third of all rows is
one row), range-partitioned on the key, summed inside each partition, and
shifted by the totals of the partitions before it. Only those totals, one row
per partition and group, pass through a single window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialise


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """One row per distinct (by, order) with its sums, and running sums in that order.

    Adds for every sum `x`: `x` itself, `cum_x` (up to and including the row)
    and `all_x` (the whole group).
    """
    folded = df.groupBy(*by, *order).agg(*[c.alias(n) for n, c in sums.items()])
    direction = F.desc if descending else F.asc
    keys = [direction(c) for c in order]
    placed = folded.repartitionByRange(*[F.asc(c) for c in by], *keys).withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy(*by, "__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    # Written once: totals and rows below must see the same partition numbers, and callers read the result often.
    local = materialise(placed.withColumns({f"cum_{n}": F.sum(n).over(inside) for n in sums}))
    totals = local.groupBy(*by, "__part").agg(*[F.sum(n).alias(f"__t_{n}") for n in sums])
    group = Window.partitionBy(*by)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *[F.col(c).alias(f"__by_{c}") for c in by],
        F.col("__part").alias("__by_part"),
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(group).alias(f"all_{n}") for n in sums],
    )
    on = F.col("__part") == F.col("__by_part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    # No hint: the totals are one row per partition and group, and AQE sees their measured size.
    joined = local.join(shifts, on)
    return joined.select(
        *by,
        *order,
        *sums,
        *[(F.col(f"cum_{n}") + F.col(f"__b_{n}")).alias(f"cum_{n}") for n in sums],
        *[f"all_{n}" for n in sums],
    )


def _name(q: float) -> str:
    return "q" + f"{q * 100:g}".replace(".", "_")


def value_runs(df: DataFrame, by: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """Running counts per distinct known value (`n`, `cum_n`, `all_n`), with further sums if given."""
    return running_totals(df.filter(F.col(value).isNotNull()), by, [value], {"n": F.count(F.lit(1)), **sums})


def quantiles_of_runs(runs: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """Linearly interpolated quantiles read off `value_runs`.

    A value covers the 0-based ranks [cum_n - n, cum_n); the wanted rank is q * (all_n - 1).
    """
    names = list(names or [_name(q) for q in qs])

    def holds(rank: Column) -> Column:
        return (F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n"))

    parts = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("all_n") - 1)
        parts.append(F.max(F.when(holds(F.floor(pos)), F.col(value))).alias(f"__lo{i}"))
        parts.append(F.max(F.when(holds(F.ceil(pos)), F.col(value))).alias(f"__hi{i}"))
    out = runs.groupBy(*by).agg(F.max("all_n").alias("n"), *parts)

    def between(i: int, q: float) -> Column:
        pos = F.lit(float(q)) * (F.col("n") - 1)
        return F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (pos - F.floor(pos))

    return out.select(*by, "n", *[between(i, q).alias(name) for i, (q, name) in enumerate(zip(qs, names))])


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles per group, from counts of distinct values.

    `percentile` keeps every distinct value of a group in one task's memory;
    this keeps them spread over the cluster.
    """
    return quantiles_of_runs(value_runs(df, by, value), by, value, qs, names)


def row_positions(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct rows with the 0-based range of positions their copies take: [first_pos, first_pos + copies)."""
    runs = running_totals(df, by, order, {"copies": F.count(F.lit(1))})
    return runs.withColumn("first_pos", F.col("cum_copies") - F.col("copies")).withColumnRenamed(
        "all_copies", "group_rows"
    ).drop("cum_copies")


COPY_BLOCK = 65_536


def expand(df: DataFrame, copies: str = "copies", first: str | None = None, position: str = "position") -> DataFrame:
    """Undo the folding: one row per copy. Copies are generated in blocks, so no array grows with them.

    With `first`, the position of a row's first copy, every copy has its own in `position`.
    """
    n = F.col(copies)
    blocks = df.withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / F.lit(COPY_BLOCK))))
    )
    size = F.least(n - F.col("__block") * COPY_BLOCK, F.lit(COPY_BLOCK)).cast("int")
    out = blocks.withColumn("__copy", F.explode(F.sequence(F.lit(1), size)))
    if first is not None:
        out = out.withColumn(position, F.col(first) + F.col("__block") * COPY_BLOCK + F.col("__copy") - 1)
    return out.drop("__copy", "__block")
