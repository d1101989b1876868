"""Deterministic samples, thinning, splits and folds.

Samples are ordered by a hash of the row, so they do not depend on how data is
partitioned. Where a true order matters (thinning, folds) positions come from
`ordered.row_positions`; identical rows are one folded row there, and a cut may
run through its copies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.ordered import expand, row_positions
from barloom.operators.shuffling import number_rows, row_cuts
from barloom.session import materialise


def row_hash(columns: Sequence[str], seed: int = 0) -> Column:
    """md5 of the seed and the row's values."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


HASH_DIGITS = 4


def _join_groups(df: DataFrame, groups: DataFrame, by: Sequence[str], staged: bool = False) -> DataFrame:
    """Add the columns of a one-row-per-group table; a missing key is a group like any other.

    `staged` writes that table first: the planner then sees its size before it plans how `df` is joined.
    """
    if not by:
        return df.crossJoin(F.broadcast(groups))
    named = groups.select(*[F.col(c).alias(f"__k_{c}") for c in by], *[c for c in groups.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    joined = df.join(materialise(named) if staged else named, on)
    return joined.drop(*[f"__k_{c}" for c in by])


def _smallest_hashes(
    hashed: DataFrame, by: Sequence[str], limit: Callable[[DataFrame], DataFrame], columns: Sequence[str]
) -> DataFrame:
    """The rows with the smallest hashes, as many per group as `limit` says.

    Rows are never sorted as a whole. The leading hash digits split them evenly into
    16 ** HASH_DIGITS buckets; bucket counts (combined map-side) show which buckets lie
    wholly inside the limit and which one it runs through. Rows of the former pass a
    filter; only the latter's, a 1 / 65536 share, are folded and ranked. `limit` turns
    (by, __rows) into the same with `__limit`.
    """
    bucketed = hashed.withColumn("__b", F.substring("__h", 1, HASH_DIGITS))
    counts = materialise(bucketed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n")))
    limits = limit(counts.groupBy(*by).agg(F.sum("__n").alias("__rows")))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cum = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    cum = _join_groups(cum, limits.select(*by, "__limit"), by)
    room = F.col("__limit") - F.col("__before")
    cut = (room > 0) & (room < F.col("__n"))
    # One row per group: the last bucket wholly taken, the bucket cut and how many of its rows are taken.
    plan = cum.groupBy(*by).agg(
        F.max(F.when(room >= F.col("__n"), F.col("__b"))).alias("__whole"),
        F.max(F.when(cut, F.col("__b"))).alias("__cut"),
        F.max(F.when(cut, room)).alias("__room"),
    )
    whole = F.col("__b") <= F.coalesce("__whole", F.lit(""))
    kept = materialise(
        _join_groups(bucketed, plan, by, staged=True)
        .withColumn("__in", whole)
        .filter(F.col("__in") | (F.col("__b") == F.col("__cut")))
    )
    others = [c for c in columns if c not in by]
    folded = kept.filter(~F.col("__in")).groupBy(*by, "__h", *others).agg(
        F.count(F.lit(1)).alias("__n"), F.max("__room").alias("__room")
    )
    rank = Window.partitionBy(*by).orderBy("__h", *others).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__room") - F.coalesce(F.sum("__n").over(rank), F.lit(0))
    folded = folded.withColumn("copies", F.least(F.col("__n"), left)).filter("copies > 0")
    return kept.filter("__in").select(*columns).unionByName(expand(folded).select(*columns))


def sample_n(df: DataFrame, n: int, by: Sequence[str] = (), seed: int = 0, keys: Sequence[str] | None = None) -> DataFrame:
    """Exactly min(n, rows) rows, per group of `by` if given. `keys` is what the hash reads (default: all)."""
    hashed = df.withColumn("__h", row_hash(keys or df.columns, seed))
    return _smallest_hashes(hashed, list(by), lambda sizes: sizes.withColumn("__limit", F.lit(n)), df.columns)


def balanced_sample(
    df: DataFrame, max_rows: int, label: str = "label", by: Sequence[str] = (), seed: int = 0, keys: Sequence[str] | None = None
) -> DataFrame:
    """At most max_rows rows per group: half from class 1, the rest from class 0. All rows if they fit."""

    def limit(sizes: DataFrame) -> DataFrame:
        # One row per group and class.
        whole = Window.partitionBy(*by)
        total = F.sum("__rows").over(whole)
        ones = F.sum(F.when(F.col(label) == 1, F.col("__rows")).otherwise(0)).over(whole)
        positives = F.least(ones, F.lit(max_rows // 2))
        value = (
            F.when(total <= max_rows, F.col("__rows"))
            .when(F.col(label) == 1, positives)
            .otherwise(F.lit(max_rows) - positives)
        )
        return sizes.withColumn("__limit", value)

    hashed = df.withColumn("__h", row_hash(keys or df.columns, seed))
    return _smallest_hashes(hashed, [*by, label], limit, df.columns)


def ordered_thin(df: DataFrame, k: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """k rows evenly spread over the order (all rows if there are no more than k).

    The kept positions are floor(i * (n-1) / (k-1)), i = 0..k-1. How many of them fall on a
    folded row's positions is counted, not joined.
    """
    columns = df.columns
    placed = row_positions(df, list(by), [*order, *[c for c in columns if c not in (*by, *order)]])
    n = F.col("group_rows")

    def kept_below(pos: Column) -> Column:
        # Number of i with floor(i * (n-1) / (k-1)) < pos, that is i < pos * (k-1) / (n-1).
        if k == 1:
            return F.when(pos > 0, 1).otherwise(0)
        num, den = pos * (k - 1), n - 1
        return F.least(F.call_function("div", num + den - 1, den), F.lit(k))

    first, after = F.col("first_pos"), F.col("first_pos") + F.col("copies")
    kept = F.when(n <= k, F.col("copies")).otherwise(kept_below(after) - kept_below(first))
    return expand(placed.withColumn("copies", kept).filter("copies > 0")).select(*columns)


def year_split(df: DataFrame, splits: dict[str, Sequence[int]], year: str = "year") -> DataFrame:
    """`split` by year; rows of no split are dropped."""
    value = F.lit(None).cast("string")
    for name, years in splits.items():
        value = F.when(F.col(year).isin(list(years)), F.lit(name)).otherwise(value)
    return df.withColumn("split", value).filter(F.col("split").isNotNull())


def _cut(placed: DataFrame, bounds: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Split folded rows at fold bounds [lo, hi); bounds hold a few rows per group."""
    # Folds times groups: a few rows, set by arguments and the number of groups. Rows of a hot group stay where they are.
    joined = placed.join(F.broadcast(bounds), list(on)) if on else placed.crossJoin(F.broadcast(bounds))
    start = F.greatest(F.col("first_pos"), F.col("lo"))
    end = F.least(F.col("first_pos") + F.col("copies"), F.col("hi"))
    return joined.withColumn("copies", end - start).filter("copies > 0").select(*columns, *[c for c in bounds.columns if c not in (*on, "lo", "hi")], "copies")


def in_order(df: DataFrame, order: Sequence[str], row_id: str = "__id") -> DataFrame:
    """The rows in a total order (ties are told apart by the other columns), with an id that grows along it.

    To be written once; `shuffling.number_rows` and `row_cuts` make positions of the ids. One range shuffle and one sort:
    copies of a row are told apart by where they were read, so a common row is spread over partitions as others are.
    """
    kinds, rest = dict(df.dtypes), [c for c in df.columns if c not in order]
    # As in a grouping, -0.0 is 0.0.
    zeros = {c: F.col(c) + F.lit(0.0).cast(kinds[c]) for c in df.columns if kinds[c] in ("double", "float")}
    told = df.withColumns({**zeros, "__copy": F.monotonically_increasing_id()})
    return told.orderBy(*order, *rest, "__copy").select(*df.columns, F.monotonically_increasing_id().alias(row_id))


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with their 0-based `position` in a total order (ties are told apart by the other columns).

    Folds over positions are interval filters, so rows are written once however many folds look at them.
    """
    placed, _ = number_rows(materialise(in_order(df, order), "ordered"), "__id", "position")
    return placed.select(*df.columns, F.col("position").cast("bigint").alias("position"))


def ts_fold_bounds(n: int, k: int) -> list[tuple[int, int]]:
    """Per expanding fold: train rows are the positions below the first number, test rows go on to the second."""
    size = n // (k + 1)
    return [(n - (k - f) * size, n - (k - f) * size + size) for f in range(k)]


def ts_folds(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """Expanding time folds: for fold f the test rows follow all train rows.

    One row per distinct input row, fold and role (`train` / `test`), with `copies`.
    """
    columns = df.columns
    placed = row_positions(df, [], [*order, *[c for c in columns if c not in order]])
    size = F.floor(F.col("n") / F.lit(k + 1))
    n = placed.agg(F.max("group_rows").alias("n"))
    folds = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.col("n") - (F.lit(k) - F.col("fold")) * size
    both = folds.select(
        "fold",
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("role"), F.lit(0).cast("bigint").alias("lo"), start.alias("hi")),
                F.struct(F.lit("test").alias("role"), start.alias("lo"), (start + size).alias("hi")),
            )
        ).alias("b"),
    ).select("fold", "b.*")
    return _cut(placed, both, (), columns)


def strat_folds(df: DataFrame, k: int, label: str, order: Sequence[str]) -> DataFrame:
    """Contiguous folds inside each class; `copies` as in `ts_folds`.

    Classes are lined up by first appearance and their rows dealt to folds in
    turn; that fixes how many rows of each class a fold gets.
    """
    columns = df.columns
    placed = row_positions(df, [label], [*order, *[c for c in columns if c not in (*order, label)]])
    sizes = placed.groupBy(label).agg(
        F.max("group_rows").alias("n"), F.min(F.struct(*order, label)).alias("__first")
    )
    return _cut(placed, _strat_bounds(sizes, k, label), (label,), columns)


def _strat_bounds(sizes: DataFrame, k: int, label: str) -> DataFrame:
    """The positions [lo, hi) of every fold in every class, from the classes' `n` and first rows."""
    # One row per class.
    before = Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    folds = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

    def start(shift: int) -> Column:
        f = F.col("fold") + shift
        full_end = F.floor((F.col("__at") + F.col("n")) / F.lit(k)) * f
        rest_end = F.least(F.pmod(F.col("__at") + F.col("n"), F.lit(k)), f)
        full_begin = F.floor(F.col("__at") / F.lit(k)) * f
        rest_begin = F.least(F.pmod(F.col("__at"), F.lit(k)), f)
        return full_end + rest_end - full_begin - rest_begin

    return folds.select(label, "fold", start(0).alias("lo"), start(1).alias("hi"))


def strat_fold_ids(staged: DataFrame, k: int, label: str, order: Sequence[str], row_id: str = "__id") -> list[list[tuple[int, int]]]:
    """The folds of `strat_folds` as intervals [lo, hi) of ids, one per class, of rows written by `in_order` of label and order.

    A fold's rows of one class lie side by side there. Rows without a label are in no fold.
    """
    id_at, _ = row_cuts(staged, row_id)
    classes = staged.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias(row_id))
    # One row per class: its first row.
    firsts = staged.join(F.broadcast(classes), row_id).select(label, "n", row_id, F.struct(*order, label).alias("__first"))
    firsts = materialise(firsts, "classes")
    starts, at = {}, 0
    for r in firsts.orderBy(row_id).select(label, "n").collect():
        starts[r[label]], at = at, at + r.n
    folds = [[] for _ in range(k)]
    for r in _strat_bounds(firsts.drop(row_id), k, label).orderBy(label).collect():
        if r[label] is not None and r.lo < r.hi:
            folds[r.fold].append((id_at(starts[r[label]] + r.lo), id_at(starts[r[label]] + r.hi)))
    return folds


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (classes * n_class) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("__n"), F.count(F.lit(1)).alias("__k"))
    return counts.crossJoin(F.broadcast(total)).select(
        label, "rows", (F.col("__n") / (F.col("__k") * F.col("rows"))).alias("weight")
    )
