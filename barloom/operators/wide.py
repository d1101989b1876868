"""Statistics of many columns at once, on wide rows: exact quantiles, bin counts, and moments of pairs of columns.

Rows are never turned into (feature, value) form. Every task reads its rows as
Arrow columns and sends small tables of counts or sums, whose size is set by
the number of columns and bins; Spark adds them up.

Quantiles are found by refining histograms. Doubles are mapped to 64-bit
numbers of the same order; the first pass counts by their leading bits, each
further pass counts only inside the buckets that hold a wanted rank. Once those
hold few values, the last pass counts distinct values. Ranks are counted over
all rows, so the result is exact whatever the distribution; a value held by a
third of the rows is one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import finite

#: Leading bits of the first pass, bits of each further one, values of a bucket that are told apart at once.
FIRST_BITS, NEXT_BITS, FEW = 16, 8, 4096
#: Columns handled in one pass; columns in a block of pairs.
TOGETHER, BLOCK = 128, 128
_TOP = 1 << 64


def plain_doubles(df: DataFrame, features: Sequence[str], *ids: str | Column) -> DataFrame:
    """`ids`, then the features as doubles, non-finite values missing."""
    return df.select(*ids, *[finite(F.col(f).cast("double")).alias(f) for f in features])


def order_bits(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles; both zeros are one number."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def from_order_bits(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ (_TOP - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def known_values(column: pa.Array) -> np.ndarray:
    """The values of a column of doubles that are not null."""
    return column.drop_null().to_numpy(zero_copy_only=False) if column.null_count else column.to_numpy(zero_copy_only=False)


# --- quantiles -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Interval:
    """Numbers [low, high) of a feature, counted in steps of 2 ** shift; `below` known values are smaller."""

    low: int
    high: int
    shift: int
    below: int


def _count(df: DataFrame, features: Sequence[str], plan: list[list[Interval]]) -> list[list[dict[int, int]]]:
    """Rows per bucket of every interval. What reaches the driver is bounded by features, ranks and buckets."""
    names = list(features)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i, intervals in enumerate(plan):
                if not intervals:
                    continue
                bits = np.sort(order_bits(known_values(batch.column(names[i]))))
                for k, part in enumerate(intervals):
                    first = np.searchsorted(bits, np.uint64(part.low), "left")
                    last = len(bits) if part.high >= _TOP else np.searchsorted(bits, np.uint64(part.high), "left")
                    if first == last:
                        continue
                    buckets, n = np.unique((bits[first:last] - np.uint64(part.low)) >> np.uint64(part.shift), return_counts=True)
                    if (i, k) in held:
                        old, old_n = held[i, k]
                        buckets, at = np.unique(np.concatenate((old, buckets)), return_inverse=True)
                        n = np.bincount(at, weights=np.concatenate((old_n, n))).astype(np.int64)
                    held[i, k] = (buckets, n)
        for (i, k), (buckets, n) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), i, np.int32)), pa.array(np.full(len(n), k, np.int32)), pa.array(buckets.view(np.int64)), pa.array(n)],
                names=["feature", "part", "bucket", "n"],
            )

    counted = df.mapInArrow(work, "feature int, part int, bucket bigint, n bigint").groupBy("feature", "part", "bucket").agg(F.sum("n").alias("n"))
    out: list[list[dict[int, int]]] = [[{} for _ in intervals] for intervals in plan]
    for r in counted.collect():
        out[r["feature"]][r["part"]][r["bucket"]] = r["n"]
    return out


def _refined(part: Interval, buckets: dict[int, int], ranks: list[int]) -> dict[int, Interval | float]:
    """For each of `ranks` inside the interval: its bucket as a finer interval, or its value once the bucket is one number."""
    out: dict[int, Interval | float] = {}
    below, left = part.below, sorted(ranks)
    for bucket in sorted(buckets):
        n = buckets[bucket]
        while left and left[0] < below + n:
            low = part.low + (bucket << part.shift)
            if part.shift == 0:
                out[left.pop(0)] = from_order_bits(low)
            else:
                shift = 0 if n <= FEW else max(part.shift - NEXT_BITS, 0)
                out[left.pop(0)] = Interval(low, low + (1 << part.shift), shift, below)
        below += n
    return out


def wide_quantiles(df: DataFrame, features: Sequence[str], qs: Sequence[float]) -> dict[str, tuple[int, list[float]]]:
    """Per feature the number of known values and their quantiles, linearly interpolated; no known value: an empty list.

    `df` is scanned two to six times, once per pass; features are doubles (see `plain_doubles`).
    """
    out: dict[str, tuple[int, list[float]]] = {}
    for first in range(0, len(features), TOGETHER):
        some = list(features[first : first + TOGETHER])
        narrow = df.select(*some)
        whole = Interval(0, _TOP, 64 - FIRST_BITS, 0)
        counts = _count(narrow, some, [[whole] for _ in some])
        sizes = [sum(c[0].values()) for c in counts]
        wanted = [sorted({r for q in qs for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}) if n else [] for n in sizes]
        found: list[dict[int, float]] = [{} for _ in some]
        open_: list[dict[Interval, list[int]]] = [{whole: w} if w else {} for w in wanted]
        plan = [[whole] for _ in some]
        while True:
            following: list[dict[Interval, list[int]]] = [{} for _ in some]
            for i, parts in enumerate(open_):
                for part, ranks in parts.items():
                    for rank, told in _refined(part, counts[i][plan[i].index(part)], ranks).items():
                        if isinstance(told, Interval):
                            following[i].setdefault(told, []).append(rank)
                        else:
                            found[i][rank] = told
            open_ = following
            if not any(open_):
                break
            plan = [list(parts) for parts in open_]
            counts = _count(narrow, some, plan)
        for i, f in enumerate(some):
            values = []
            for q in qs if sizes[i] else ():
                at = q * (sizes[i] - 1)
                low, high = found[i][math.floor(at)], found[i][math.ceil(at)]
                values.append(low + (high - low) * (at - math.floor(at)))
            out[f] = (sizes[i], values)
    return out


# --- bins ----------------------------------------------------------------------------------------------


def right_closed(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """1-based bin (edge, next edge]; the lowest value belongs to the first bin."""
    return np.maximum(np.searchsorted(edges, values, "left"), 1)


def left_closed(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """1-based bin [edge, next edge), the last bin closed (0 where there is one edge only); len(edges) outside them."""
    bins = np.searchsorted(edges, values, "right")
    bins[values == edges[-1]] = len(edges) - 1
    bins[(values < edges[0]) | (values > edges[-1])] = len(edges)
    return bins


def wide_bins(df: DataFrame, features: Sequence[str], edges: dict[str, Sequence[float]], group: str, weight: str, place) -> DataFrame:
    """(group, feature, bin, rows, weight): known values per bin of every feature with edges, and the sum of `weight`.

    `df` has the features as doubles, `group` as a whole number (null is a group) and `weight` as a whole number.
    `place` is `right_closed` or `left_closed`.
    """
    cuts = {f: np.array(edges[f], float) for f in features if len(edges[f])}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int | None, int], list[int]] = {}
        names = list(cuts)
        for batch in batches:
            labels, group_at = np.unique(np.array([_NO_GROUP if g is None else g for g in batch.column(group).to_pylist()], np.int64), return_inverse=True)
            weights = np.nan_to_num(batch.column(weight).to_numpy(zero_copy_only=False).astype(float))
            for i, f in enumerate(names):
                column = batch.column(f)
                known = ~np.asarray(column.is_null())
                wide = len(cuts[f]) + 1
                cell = group_at[known] * wide + place(known_values(column), cuts[f])
                rows = np.bincount(cell, minlength=len(labels) * wide)
                sums = np.bincount(cell, weights=weights[known], minlength=len(labels) * wide)
                for at in np.flatnonzero(rows).tolist():
                    total = held.setdefault((i, int(labels[at // wide]), at % wide), [0, 0])
                    total[0] += int(rows[at])
                    total[1] += int(sums[at])
        if held:
            keys = list(held)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if g == _NO_GROUP else g for _, g, _ in keys], pa.int64()),
                    pa.array([names[i] for i, _, _ in keys]),
                    pa.array([b for _, _, b in keys], pa.int32()),
                    pa.array([held[k][0] for k in keys], pa.int64()),
                    pa.array([held[k][1] for k in keys], pa.int64()),
                ],
                names=["group", "feature", "bin", "rows", "weight"],
            )

    counted = df.select(group, weight, *cuts).mapInArrow(work, "group bigint, feature string, bin int, rows bigint, weight bigint")
    return counted.groupBy("group", "feature", "bin").agg(F.sum("rows").alias("rows"), F.sum("weight").alias("weight"))


_NO_GROUP = -(1 << 63)


def few_values(df: DataFrame, features: Sequence[str], most: int) -> dict[str, int]:
    """Distinct known values per feature, counted up to `most`: a task sends no more than so many of each."""
    names = list(features)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0) for _ in names]
        for batch in batches:
            for i, f in enumerate(names):
                if len(held[i]) < most:
                    held[i] = np.unique(np.concatenate((held[i], known_values(batch.column(f)) + 0.0)))[:most]
        for f, values in zip(names, held):
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(values), pa.string()), pa.array(values, pa.float64())], names=["feature", "value"])

    told = df.select(*names).mapInArrow(work, "feature string, value double").groupBy("feature").agg(F.count_distinct("value").alias("n"))
    found = {r["feature"]: r["n"] for r in told.collect()}
    return {f: min(found.get(f, 0), most) for f in names}


# --- pairs ---------------------------------------------------------------------------------------------

PAIRS = "feature_a string, feature_b string, pairs bigint, corr double"
#: Below this standard deviation a column does not vary.
FLAT = 1e-12


def pair_correlations(df: DataFrame, features: Sequence[str], least: int = 50) -> DataFrame:
    """(feature_a, feature_b, pairs, corr) for all a < b in list order, each over the rows where both are known.

    corr is 0 below `least` such rows or where either side does not vary on them. Every task adds up Gram matrices of
    values and of presence, in blocks of BLOCK columns; a block is merged in one place, pairs are never rows of data.
    Values are centred on each column's mean first, so that sums of squares keep their digits.
    """
    names = list(features)
    rows = plain_doubles(df, names)
    means = rows.agg(*[F.avg(f).alias(f) for f in names]).first() if names else {}
    centre = np.array([means[f] or 0.0 for f in names])
    spans = [(a, min(a + BLOCK, len(names))) for a in range(0, len(names), BLOCK)]
    blocks = [(i, j) for i in range(len(spans)) for j in range(i, len(spans))]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in names], axis=1)
            seen = (~np.isnan(x)).astype(float)
            x = np.where(seen == 1, x - centre, 0.0)
            made = []
            for i, j in blocks:
                (a, b), (c, d) = spans[i], spans[j]
                xa, xb, sa, sb = x[:, a:b], x[:, c:d], seen[:, a:b], seen[:, c:d]
                made.append(np.stack([sa.T @ sb, xa.T @ sb, sa.T @ xb, (xa * xa).T @ sb, sa.T @ (xb * xb), xa.T @ xb]))
            total = made if total is None else [t + m for t, m in zip(total, made)]
        if total is not None:
            for k, t in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([t.tobytes()], pa.binary())], names=["block", "sums"])

    def told(block: int, sums: np.ndarray) -> pa.RecordBatch:
        (a, b), (c, d) = (spans[k] for k in blocks[block])
        n, sx, sy, sxx, syy, sxy = sums.reshape(6, b - a, d - c)
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
            value = (sxy / n - sx / n * (sy / n)) / np.sqrt(vx * vy)
        good = (n >= least) & (vx > FLAT**2) & (vy > FLAT**2) & np.isfinite(value)
        left, right = np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij")
        take = left < right
        return pa.RecordBatch.from_arrays(
            [
                pa.array([names[i] for i in left[take].tolist()], pa.string()),
                pa.array([names[i] for i in right[take].tolist()], pa.string()),
                pa.array(n[take].astype(np.int64)),
                pa.array(np.where(good, value, 0.0)[take]),
            ],
            names=["feature_a", "feature_b", "pairs", "corr"],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for batch in batches:
            for k, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block is not None and k != block:
                    yield told(block, total)
                    total = None
                more = np.frombuffer(sums)
                block, total = k, more if total is None else total + more
        if block is not None:
            yield told(block, total)

    added = rows.mapInArrow(add_up, "block int, sums binary").repartition("block").sortWithinPartitions("block")
    return added.mapInArrow(merge, PAIRS)
