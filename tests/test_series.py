"""Windows, weighted means, ranks, chunks and indicators against pandas and plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.windows import ExactSums, roll_std, series
from barloom.operators import chunks, cycles, ewm, resample, scaling
from barloom.operators import indicators as ind
from barloom.operators.rolling_rank import Rank, add_ranks


def column(df, name, order="ts"):
    return np.array([np.nan if r[name] is None else float(r[name]) for r in df.orderBy(order).select(name).collect()])


def close_to(a, b):
    np.testing.assert_allclose(a, np.asarray(b, dtype=float), rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def frame(make_bars, walk):
    rows = walk(260, seed=1)
    return make_bars(rows), pd.DataFrame(rows, columns=["open", "high", "low", "close"])


def test_smoothed_equals_pandas(frame):
    df, pdf = frame
    out = ewm.add_smoothed(df, ema=(8,), rsi_periods=(14,), atr_periods=(14,)).cache()
    close_to(column(out, "ema_8"), pdf.close.ewm(span=8, min_periods=8, adjust=False).mean())
    delta = pdf.close.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    loss = (-delta.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    close_to(column(out, "rsi_14"), 100 - 100 / (1 + gain / loss.replace(0, np.nan)))


@pytest.mark.parametrize("chunk", [7, 64, 1000])
def test_continuous_ewm_does_not_depend_on_chunks(frame, chunk):
    df, pdf = frame
    spec = [ewm.Ewm.span("e", "close", 21), ewm.Ewm("d", "diff", 0.1, 5)]
    src = df.withColumn("diff", F.col("close") - F.lag("close").over(series()))
    out = ewm.add_ewm_continuous(src, spec, chunk_rows=chunk).cache()
    close_to(column(out, "e"), pdf.close.ewm(span=21, min_periods=21, adjust=False).mean())
    close_to(column(out, "d"), pdf.close.diff().ewm(alpha=0.1, min_periods=5, adjust=False).mean())


@pytest.mark.parametrize("chunk", [40, 77, 500])
def test_halo_chunks_equal_one_window(frame, chunk):
    df, pdf = frame
    cut = chunks.halo_chunks(chunks.with_bar_idx(df), back=29, chunk_rows=chunk)
    out = chunks.trim(cut.withColumn("s", roll_std("close", 30, series(("symbol", "chunk"), "bar_idx"))))
    assert out.count() == len(pdf)
    close_to(column(out, "s"), pdf.close.rolling(30).std())


def test_bar_idx_counts_on_over_slices(frame):
    df, pdf = frame
    hourly = df.withColumn("ts", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.unix_seconds(F.col("ts").cast("timestamp")) % 100000 / 60)))
    out = chunks.with_bar_idx(hourly, slice_days=7)
    assert column(out, "bar_idx").tolist() == list(range(len(pdf)))


@pytest.mark.parametrize("past_only", [False, True])
def test_exact_sums(frame, past_only):
    df, pdf = frame
    w = series()
    exact = ExactSums(w)
    df = df.withColumn("p", F.round(F.col("close") * 100).cast("bigint"))
    df = df.withColumn("p", F.when(F.col("p") % 7 != 0, F.col("p")))
    x = (pdf.close * 100).round()
    x = x.where(x % 7 != 0)
    ref = (x.shift(1) if past_only else x).rolling(20, min_periods=10)
    out = exact.prepare(df, ["p"], [20], past_only=past_only)
    out = out.withColumns({"m": exact.mean("p", 20, 10), "s": exact.std("p", 20, 10)}).cache()
    close_to(column(out, "m"), ref.mean())
    close_to(column(out, "s"), ref.std())


def test_ranks_equal_loops(frame):
    df, pdf = frame
    df = df.withColumn("v", F.round(F.when(F.col("close") * 10 % 5 > 0.5, F.col("close")), 0))
    v = column(df, "v")
    out = add_ranks(df, [Rank("mid", "v", 30, 10), Rank("pct", "v", 30, 10, "pct")]).cache()
    mid, pct = [], []
    for i, x in enumerate(v):
        past = v[max(0, i - 30) : i]
        past = past[~np.isnan(past)]
        ok = not np.isnan(x) and len(past) >= 10
        mid.append((((past < x).sum() + 0.5 * (past == x).sum()) / len(past) - 0.5) * 2 if ok else np.nan)
        now = v[max(0, i - 29) : i + 1]
        now = now[~np.isnan(now)]
        ok = not np.isnan(x) and len(now) >= 10
        pct.append(((now < x).sum() + ((now == x).sum() + 1) / 2) / len(now) if ok else np.nan)
    close_to(column(out, "mid"), mid)
    close_to(column(out, "pct"), pct)


def test_wma_zscore_flat_window(make_bars):
    df = make_bars([(5, 5, 5, 5)] * 16 + [(6, 6, 6, 6)])
    z = column(scaling.add_wma_zscore(df, ["close"]), "close__wmaz14p")
    assert np.isnan(z[:14]).all() and z[14] == 0 and z[15] == 0 and np.isnan(z[16])


def test_flat_prices_give_missing_not_errors(make_bars):
    df = make_bars([(5, 5, 5, 5)] * 60)
    out = ind.add_bb_family(ewm.add_smoothed(df, rsi_periods=(14,), atr_periods=(14,)), (20,))
    out = ind.add_stochastic(ind.add_adx(ind.add_rsi_simple(out))).cache()
    for name in ("bb20_pos", "bb20_z", "rsi_14", "rsi_simple", "sto14", "adx14"):
        assert np.isnan(column(out, name)).all(), name


def test_supertrend_equals_loop(frame):
    df, pdf = frame
    out = ind.add_supertrend(ewm.add_smoothed(df, atr_periods=(20,)), mult=1.0).cache()
    atr = column(out, "atr20")
    mid = (pdf.high + pdf.low).to_numpy() / 2
    up, lo, rising, want = mid + atr, mid - atr, True, []
    for i, c in enumerate(pdf.close):
        if i and not np.isnan(up[i - 1]):
            if c > up[i - 1]:
                rising = True
            elif c < lo[i - 1]:
                rising = False
        want.append(lo[i] if rising else up[i])
    close_to(column(out, "supertrend20x3"), want)


def test_asof_takes_the_latest_at_or_before(make_bars, walk):
    df = make_bars(walk(40))
    htf = resample.resample(df, 300).withColumnRenamed("close", "htf_close").select("symbol", "year", "ts", "htf_close")
    out = resample.asof_backward(df, htf)
    a = df.select("ts", "close").orderBy("ts").toPandas()
    b = htf.select("ts", "htf_close").orderBy("ts").toPandas()
    close_to(column(out, "htf_close"), pd.merge_asof(a, b, on="ts").htf_close)


def test_features_do_not_see_the_future(make_bars, walk):
    rows = walk(200, seed=5)
    other = rows[:150] + walk(50, seed=77)

    def build(r):
        df = ewm.add_smoothed(make_bars(r), ema=(5, 8, 9, 20, 21), rsi_periods=(14,), atr_periods=(14, 20))
        df = ind.add_supertrend(ind.add_psar(ind.add_bb_family(ind.add_norm_scale(df), (20,))))
        df = cycles.add_cycle_touch(cycles.add_signal_cycle(df))
        return cycles.add_ma_cycle(df).orderBy("ts").toPandas().iloc[:150]

    pd.testing.assert_frame_equal(build(rows), build(other))
