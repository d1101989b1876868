"""Running state that no finite look-back bounds, over chunks: runs, counts within a run, distance to the last mark.

Every chunk works its rows out as if nothing came before and reports one row: flips, last flip, counts, last marks at
the end of the rows it owns. Those rows are chained in order of chunks, and what enters a chunk is added to its rows.
All of it is sums and maxima of positions, so the result is the same for any chunk size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import series, so_far
from barloom.operators.chunks import ChunkKey
from barloom.session import materialise


def scan_runs(
    df: DataFrame,
    by: ChunkKey,
    flip: Column | None = None,
    run_id: str | None = None,
    bar: str | None = None,
    counts: dict[str, Column] | None = None,
    marks: dict[str, Column] | None = None,
) -> DataFrame:
    """Add state columns; rows before a chunk's live ones have none.

    flip: 0/1, where a run begins. run_id: runs so far, this one included. bar: rows since the run began. counts: per
    name, the sum of a whole number (0/1 for flags) over the run so far. marks: per name, rows since a condition last
    held, null before it first did.
    """
    counts, marks = counts or {}, marks or {}
    flip = F.lit(0) if flip is None else flip.cast("int")
    w = series(by, "bar_idx")
    run = so_far(w)
    kept = df.columns
    flags = {f"__f_{n}": F.when(by.live, c).otherwise(0) for n, c in counts.items()}
    local = df.withColumns({"__flip": F.when(by.live, flip).otherwise(0), **flags})
    local = local.withColumns(
        {
            "__flips": F.sum("__flip").over(run),
            "__last": F.last(F.when(F.col("__flip") == 1, F.col("bar_idx")), ignorenulls=True).over(run),
            **{f"__c_{n}": F.sum(f"__f_{n}").over(run) for n in counts},
            **{f"__m_{n}": F.last(F.when(by.live & c, F.col("bar_idx")), ignorenulls=True).over(run) for n, c in marks.items()},
        }
    )
    # Flagged rows of the chunk before its current run.
    outside = {
        f"__b_{n}": F.last(F.when(F.col("__flip") == 1, F.col(f"__c_{n}") - F.col(f"__f_{n}")), ignorenulls=True).over(run) for n in counts
    }
    local = materialise(local.withColumns(outside).drop("__flip", *flags), "runs")
    state = ["__flips", "__last", *[f"__c_{n}" for n in counts], *[f"__b_{n}" for n in counts], *[f"__m_{n}" for n in marks]]
    # A chunk that owns no row hands on nothing of its own, but is handed what came before.
    last = F.max_by(F.struct(*state), F.when(by.owned, F.col("bar_idx"))).alias("e")
    ends = local.groupBy(*by).agg(last).select(*by, "e.*")
    before = Window.partitionBy(*by.series).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    def latest(c: str) -> Column:
        return F.last(c, ignorenulls=True).over(before)

    ends = ends.withColumns({f"__t_{n}": total(f"__c_{n}") for n in counts})
    ends = ends.withColumns({f"__b_{n}": F.col(f"__b_{n}") + F.col(f"__t_{n}") for n in counts})
    enter = ends.select(
        *by,
        total("__flips").alias("__e_flips"),
        latest("__last").alias("__e_last"),
        *[F.col(f"__t_{n}").alias(f"__e_c_{n}") for n in counts],
        *[latest(f"__b_{n}").alias(f"__e_b_{n}") for n in counts],
        *[latest(f"__m_{n}").alias(f"__e_m_{n}") for n in marks],
    )
    joined = local.join(enter, list(by))
    out = {}
    if run_id:
        out[run_id] = F.col("__flips") + F.col("__e_flips")
    if bar:
        out[bar] = F.col("bar_idx") - F.coalesce("__last", "__e_last")
    for n in counts:
        entered = F.col(f"__e_c_{n}")
        outside_run = F.coalesce(F.col(f"__b_{n}") + entered, F.col(f"__e_b_{n}"), F.lit(0))
        out[n] = F.col(f"__c_{n}") + entered - outside_run
    for n in marks:
        out[n] = F.col("bar_idx") - F.coalesce(f"__m_{n}", f"__e_m_{n}")
    out = {n: F.when(by.live, c) for n, c in out.items()}
    return joined.select(*[c for c in kept if c not in out], *[c.alias(n) for n, c in out.items()])
