"""Row numbers without an order, and a shuffle of them without a sort.

A shuffle of n rows is a bijection of 0 .. n - 1 that every row works out by
itself: a Feistel network over pairs (position // s, position % s). Its domain
r * s is hardly larger than n; positions that land beyond n are sent through it
again until they do not, which keeps the map a bijection of 0 .. n - 1.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 4
#: Times a position may be sent on. Fewer than r numbers lie beyond n, a share of less than 1 / s of the domain.
AGAIN = 64
_ROW_BITS = 33


def number_rows(staged: DataFrame, row_id: str = "__id", position: str = "__at") -> tuple[DataFrame, int]:
    """`position` from 0 without gaps, and the number of rows, for rows written with `monotonically_increasing_id`.

    Such an id holds the partition and the row's number in it, so only the sizes of the partitions, one row each, are
    added up.
    """
    part, nth = F.shiftright(row_id, _ROW_BITS), F.col(row_id).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = staged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    n = sizes.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    placed = staged.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn(position, F.col("__start") + nth).drop("__part", "__start"), n


def row_cuts(staged: DataFrame, row_id: str = "__id") -> tuple[Callable[[int], int], int]:
    """As `number_rows`, for intervals of positions: the id of the row at a position, and the number of rows.

    One number per partition comes to the driver. Filters on ids reach the scan, and no pass joins the sizes again.
    Positions beyond the last row have an id above all others.
    """
    sizes = staged.groupBy(F.shiftright(row_id, _ROW_BITS).alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    parts = sorted((r.part, r.rows) for r in sizes.collect())
    ends = list(accumulate(rows for _, rows in parts))

    def id_at(position: int) -> int:
        i = bisect_right(ends, position)
        if i == len(parts):
            return (parts[-1][0] + 1) << _ROW_BITS if parts else 0
        part, rows = parts[i]
        return (part << _ROW_BITS) + position - (ends[i] - rows)

    return id_at, ends[-1] if ends else 0


def shuffled_position(position: Column, n: int, seed: str) -> Column:
    """Where the shuffle named by `seed` puts a position of 0 .. n - 1."""
    r = max(1, math.isqrt(max(n - 1, 0)) + 1)
    s = max(1, -(-n // r))

    def once(x: Column) -> Column:
        high, low = F.call_function("div", x, F.lit(s).cast("bigint")), F.pmod(x, F.lit(s).cast("bigint"))
        for k in range(ROUNDS):
            high = F.pmod(high + F.pmod(F.xxhash64(F.lit(f"{seed}/{k}/high"), low), F.lit(r).cast("bigint")), F.lit(r).cast("bigint"))
            low = F.pmod(low + F.pmod(F.xxhash64(F.lit(f"{seed}/{k}/low"), high), F.lit(s).cast("bigint")), F.lit(s).cast("bigint"))
        return high * s + low

    again = F.sequence(F.lit(1), F.lit(min(max(r, s) + 1, AGAIN)))
    return F.aggregate(again, once(position.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
