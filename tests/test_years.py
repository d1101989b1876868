"""Chains over chunks: state and look-back that run on across chunks and years, against plain loops and one whole window."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.windows import roll_sum, series
from barloom.operators import chunks, cycles, ewm, signals
from barloom.operators import indicators as ind
from barloom.operators.chunks import ChunkKey, look_back, looks_back, over_chunks, step
from barloom.operators.state_scan import scan_runs

EMAS = step(ewm.add_smoothed, ema=(5, 9, 20, 21), atr_periods=(20,))


@pytest.fixture(scope="module")
def over_new_year(make_bars, walk):
    """Two symbols of minute bars that run from one year into the next."""
    start = dt.datetime(2023, 12, 31, 21, 0)
    a, b = walk(420, seed=3), walk(230, seed=4)
    return make_bars(a, "a", start=start).unionByName(make_bars(b, "b", start=start))


def rows(df, columns):
    return [tuple(r) for r in df.orderBy("symbol", "ts").select("symbol", "ts", *columns).collect()]


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:2] == y[:2]
        for u, v in zip(x[2:], y[2:]):
            assert (u is None) == (v is None), (x, y)
            assert u is None or u == pytest.approx(v, rel=1e-9, abs=1e-9), (x, y)


def whole(df, steps):
    """The chain over one window per symbol: the year in the key is one constant."""
    df = df.withColumn("__year", F.col("year")).withColumn("year", F.lit(0))
    for s in steps:
        df = s.run(df, ("symbol", "year"))
    return df


CHAINS = {
    "cycle": ([EMAS, step(cycles.add_signal_cycle)], ["signal_dir", "cycle_id", "cycle_bar", "cycle_changed", "cycle_phase", "cycle_age_clip", "bars_since_mid"]),
    "touch": (
        [EMAS, step(cycles.add_signal_cycle), step(cycles.add_cycle_touch, body_window=30, body_min=10)],
        ["first_touch_ma20", "cycle_touch_count", "close_cross_ma20", "strong_body", "strong_body_confirm"],
    ),
    "ages": (
        [EMAS, step(ind.add_norm_scale, window=40, min_periods=10), step(cycles.add_ma_cycle)],
        ["ma5_ma20_cycle_id", "ma5_ma20_cycle_bar", "ma5_ma20_spread_slope_r", "ma5_ma20_first_touch_ma20", "ma5_ma20_touch_ma20_count_clip"],
    ),
    "supertrend": ([EMAS, step(ind.add_supertrend, mult=0.5)], ["supertrend_up", "supertrend20x3"]),
    "fs03": ([step(signals.add_fs03)], list(signals.FS03_COLUMNS)),
    "bands": ([step(ind.add_bb_family, periods=(10, 40))], ["bb10_pos", "bb40_z", "bb40_mid_slope_5", "bb40_squeeze"]),
    "v2": (
        [step(ind.add_norm_scale, window=40, min_periods=10), step(ind.add_bb_family_v2, periods=(10,), rank_window=50, rank_min=5)],
        ["bb10_width_rank", "bb10_squeeze_dir_raw"],
    ),
    "vwap": ([step(ind.add_vwap_session)], ["vwap_session"]),
    "overlay": ([EMAS, step(ind.add_overlay, lines={"ema_20": 20}, atr="atr20", rank_window=40, rank_min=5)], ["ema_20_ov_std", "ema_20_ov_distance_lag13", "ema_20_ov_acceleration5"]),
}


@pytest.mark.parametrize("chunk", [16, 97, 100_000])
@pytest.mark.parametrize("name", list(CHAINS))
def test_chains_do_not_depend_on_chunks_or_years(over_new_year, name, chunk):
    steps, columns = CHAINS[name]
    got = over_chunks(over_new_year, *steps, chunk_rows=chunk)
    assert not {"chunk", "is_core"} & set(got.columns)
    same(rows(got, columns), rows(whole(over_new_year, steps), columns))


def test_the_year_in_the_key_restarts(over_new_year):
    steps, _ = CHAINS["cycle"]
    df = over_new_year
    for s in steps:
        df = s.run(df, ("symbol", "year"))
    first = df.groupBy("symbol", "year").agg(F.min_by("cycle_id", "ts").alias("id"), F.min_by("cycle_bar", "ts").alias("bar")).collect()
    assert len(first) == 4 and all((r["id"], r["bar"]) == (1, 0) for r in first)


def loop(flips, counted, marked):
    out, run, bar, count, since = [], 0, None, 0, None
    for f, c, m in zip(flips, counted, marked):
        if f:
            run, bar, count = run + 1, 0, 0
        elif bar is not None:
            bar += 1
        count += c
        since = 0 if m else (None if since is None else since + 1)
        out.append((run, bar, count, since))
    return out


@pytest.mark.parametrize("rows_in_chunk", [1, 2, 5, 13, 64, 1000])
@pytest.mark.parametrize("density", [0.02, 0.4])
def test_scan_equals_a_loop(spark, rows_in_chunk, density):
    rng = random.Random(rows_in_chunk)
    data, want = [], {}
    for s, n in (("a", 200), ("b", 1), ("c", 65)):
        flips = [int(rng.random() < density) for _ in range(n)]
        counted = [rng.randint(0, 3) for _ in range(n)]
        marked = [rng.random() < density for _ in range(n)]
        data += [(s, i, f, c, m) for i, (f, c, m) in enumerate(zip(flips, counted, marked))]
        want |= {(s, i): x for i, x in enumerate(loop(flips, counted, marked))}
    rng.shuffle(data)
    df = spark.createDataFrame(data, "symbol string, bar_idx long, f int, c int, m boolean")
    for back, used in ((0, 0), (1, 0), (1, 1)):
        size = max(rows_in_chunk, back)
        key = ChunkKey(("symbol",), size, back, used)
        halo = chunks.halo_chunks(df, back, chunk_rows=size)
        out = chunks.trim(scan_runs(halo, key, F.col("f"), "run", "bar", {"n": F.col("c")}, {"ago": F.col("m")}))
        got = {(r.symbol, r.bar_idx): (r.run, r.bar, r.n, r.ago) for r in out.collect()}
        assert got == want


def test_reaches_add_up():
    assert look_back(ind.add_rolling_stats, {"windows": (5, 30)}) == 31
    assert look_back(ind.add_donchian, {}) == 55
    with pytest.raises(ValueError, match="add_psar"):
        look_back(ind.add_psar, {})

    @looks_back(2)
    def twice(df, by):
        return df.withColumn("s", roll_sum("close", 3, series(by)))

    assert step(twice).reach() == 2
    with pytest.raises(ValueError, match="halo"):
        ChunkKey(("symbol",), 10, 11)


def test_empty_frame(over_new_year):
    steps, columns = CHAINS["touch"]
    assert over_chunks(over_new_year.filter("symbol = 'z'"), *steps).select(*columns).collect() == []


def test_ewm_of_values_missing_at_first(over_new_year):
    """Missing values before the first known one, over several chunks."""
    df = over_new_year.withColumn("x", F.when(F.col("ts") >= F.lit("2023-12-31 23:30:00").cast("timestamp_ntz"), F.col("close")))
    spec = [ewm.Ewm("e", "x", 0.2, 3)]
    got = rows(ewm.add_ewm_continuous(df, spec, chunk_rows=23), ["e"])
    same(got, rows(ewm.add_ewm(df.withColumn("year", F.lit(0)), spec), ["e"]))
    assert np.isfinite([r[2] for r in got if r[2] is not None]).all()
