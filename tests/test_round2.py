"""Prices of more than two decimals, wide integers, real CSV layouts, feature lists, AUC without a value."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators, labels, models, selection, thresholds, transforms
from barloom.sources import bars as sources


def fine_walk(n, seed=0):
    rng = np.random.default_rng(seed)
    close = np.round(1.1 + np.cumsum(rng.normal(0, 0.0008, n)), 5)
    open_ = np.round(np.concatenate([[1.1], close[:-1]]), 5)
    high = np.round(np.maximum(open_, close) + np.abs(rng.normal(0, 0.0004, n)), 5)
    low = np.round(np.minimum(open_, close) - np.abs(rng.normal(0, 0.0004, n)), 5)
    return list(zip(open_.tolist(), high.tolist(), low.tolist(), close.tolist()))


def test_labels_of_five_decimals(make_bars):
    rows, r1, horizon = fine_walk(300), 0.004, 60
    scaled = [[round(v * 100_000) for v in row] for row in rows]
    want = []
    for i in range(len(rows)):
        got = None
        if i < len(rows) - 2:
            entry = scaled[i + 1][0]
            up, down = entry + 400, entry - 400
            for o, h, lo, c in scaled[i + 1 : i + 2 + horizon]:
                tp, sl = lo <= up <= h, lo <= down <= h
                if tp or sl:
                    got = int(c < o) if tp and sl else int(tp)
                    break
                if o <= down or o >= up:
                    got = int(o >= up)
                    break
        want.append(got)
    df = labels.buy_labels(make_bars(rows), r1, horizon)
    assert [r.label for r in df.orderBy("ts").collect()] == want
    assert 0 in want and 1 in want
    entries = [r.entry_price for r in df.orderBy("ts").collect()]
    assert entries[0] == pytest.approx(rows[1][0], abs=1e-9)


def test_bands_of_five_decimals(make_bars):
    rows = fine_walk(60, seed=1)
    got = [r.bb20_std for r in indicators.bands(make_bars(rows), (20,)).orderBy("ts").collect()]
    close = np.array([r[3] for r in rows])
    assert got[18] is None
    assert np.allclose(got[19:], [np.std(close[i - 19 : i + 1], ddof=1) for i in range(19, 60)], rtol=1e-9)


def test_large_volumes_do_not_overflow(make_bars):
    rows = fine_walk(130, seed=2)
    frame = make_bars(rows).withColumn("volume", 1e10 + F.minute("ts") * 1e7)
    got = [r.volume_z_100 for r in indicators.add_volume_z(frame).orderBy("ts").collect()]
    volume = np.array([1e10 + (i % 60) * 1e7 for i in range(130)])
    want = [(volume[i] - volume[i - 99 : i + 1].mean()) / volume[i - 99 : i + 1].std(ddof=1) for i in range(99, 130)]
    assert np.allclose(got[99:], want)


def test_bar_files_of_several_layouts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "XAU_m1.csv").write_text("dates,open,low,high,close,volume\n2024-01-01 00:00:00,1,0.5,2,1.5,7\nbad,1,1,1,1,1\n")
    (tmp_path / "a" / "EUR.csv").write_text("dates,open,high,low,close\n2023-12-31 23:59:00,1,2,0.5,1.5\n2024-01-01 00:00:00,,2,0.5,1.5\n")
    (tmp_path / "more.csv").write_text(",symbol,spread,close,open,low,high,dates,volume\n0,GBP,9,1.5,1,0.5,2,2024-01-01 00:00:00,x\n")
    (tmp_path / "empty.csv").write_text("")
    got = sources.read_bar_csv(spark, str(tmp_path)).orderBy("symbol").collect()
    day, eve = dt.datetime(2024, 1, 1), dt.datetime(2023, 12, 31, 23, 59)
    assert [(r.symbol, r.ts, r.open, r.high, r.low, r.close, r.volume, r.year) for r in got] == [
        ("EUR", eve, 1, 2, 0.5, 1.5, None, 2023),
        ("GBP", day, 1, 2, 0.5, 1.5, None, 2024),
        ("XAU", day, 1, 2, 0.5, 1.5, 7, 2024),
    ]
    assert sources.read_bar_csv(spark, str(tmp_path), [2023]).count() == 1


def test_importance_files(spark, tmp_path):
    for run, text in (
        ("run_a", "feature,mean_abs_shap,gain\nx,0.5,9\ny,0.25,8\n"),
        ("run_b", ",feature,kind,gain\n0,x,float,3\n1,z,float,\n"),
        ("run_c", "name,value\nx,1\n"),
    ):
        (tmp_path / run / "deep").mkdir(parents=True)
        (tmp_path / run / "importance.csv").write_text(text)
    got = {(r.run, r.feature): r.importance for r in sources.read_importances(spark, str(tmp_path)).collect()}
    assert got[("run_a", "x")] == 0.5 and got[("run_a", "y")] == 0.25
    assert {k for k in got if k[0] == "run_b"} == {("run_b", "x"), ("run_b", "z")}


def test_auc_of_zero_is_zero(spark):
    rows = [(1, 0.1), (1, 0.2), (0, 0.8), (0, 0.9)]
    assert models.auc(spark.createDataFrame(rows, "label int, score double")) == 0.0
    assert models.auc(spark.createDataFrame([(1, 0.1)], "label int, score double")) == 0.5


def test_bounds_of_zero_count(spark):
    totals = spark.createDataFrame([(0.5, 10, 90.0), (0.6, 5000, 50.0)], "threshold double, resolved long, winrate double")
    loose = thresholds.pick_threshold(totals, "A" if "A" in thresholds.CHOICES else next(iter(thresholds.CHOICES)), lowest=0)
    assert loose.count() == 1


def test_prune_keeps_the_stronger_of_each_close_pair(spark):
    rng = np.random.default_rng(4)
    n = 400
    y = rng.integers(0, 2, n)
    base = y + rng.normal(0, 0.6, n)
    columns = {
        "strong": base,
        "copy": base + rng.normal(0, 0.05, n),
        "weak": base + rng.normal(0, 0.9, n),
        "guard": -base + rng.normal(0, 0.1, n),
        "other": rng.normal(0, 1, n),
    }
    rows = [(*(float(c[i]) for c in columns.values()), int(y[i])) for i in range(n)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", label int")
    kept, table = selection.corr_prune(frame, list(columns), 0.9, protected=["guard"])
    assert kept == ["weak", "guard", "other"]
    assert {(r.kept_feature, r.dropped_feature) for r in table.collect()} == {("guard", "strong"), ("guard", "copy")}
    kept, _ = selection.corr_prune(frame, list(columns), 0.9)
    assert len({"strong", "copy", "guard"} & set(kept)) == 1


def test_reduced_variants(spark):
    names = ["tod_sin", "sig_x", "buy_signal", "atr14", "close_diff_lag_5", "close_diff_lag_55", "bb20_bb100_pos_diff", "x_rank_500"]
    names += ["bb20_mid_gap_atr_rollmean_5", "bb100_mid_gap_atr_rollstd_5", "ema_8_ov_velocity1", "ema_8_ov_distance_lag3", "plain"]
    frame = spark.createDataFrame([(n,) for n in names], "feature string")
    got = {}
    for r in transforms.variant_catalog(frame).collect():
        got.setdefault(r.variant, set()).add(r.feature)
    base = {"tod_sin", "sig_x", "buy_signal"}
    assert set(got) == set(transforms.REDUCED_VARIANTS)
    assert got["fs14r00_fs03_like_light"] == base | {"close_diff_lag_5"}
    assert got["fs14r04_bb20_rolling_atr"] == base | {"bb20_mid_gap_atr_rollmean_5", "bb20_bb100_pos_diff"}
    assert got["fs14r06_all_no_raw_atr"] == set(names) - {"atr14", "plain", "close_diff_lag_5", "close_diff_lag_55"}


def test_gate_sets_name_absent_columns():
    with pytest.raises(ValueError, match="h4_ret"):
        transforms.gate_feature_set(["tod_sin"], "h4_time_core")


@pytest.mark.parametrize("horizon,block", [(30, 4), (90, None)])
def test_labels_run_on_across_the_year(make_bars, walk, horizon, block):
    """Bars before and after New Year are one series; with the year in the key they are two."""
    rows = walk(240, seed=11)
    start = dt.datetime(2023, 12, 31, 22, 0)
    whole = make_bars(rows, start=start)
    apart = make_bars(rows)
    assert whole.select("year").distinct().count() == 2
    for label, column in (
        (lambda f, **k: labels.buy_labels(f, 2.0, horizon, block=block, **k), "label"),
        (lambda f, **k: labels.two_sided_labels(f, 2.0, horizon, skip_first=20, block=block, **k), "buy_label"),
        (lambda f, **k: labels.short_horizon_labels(f, 0.8, 5, skip_first=20, **k), "buy_label"),
    ):
        across, single = ([r[column] for r in label(f).orderBy("ts").collect()] for f in (whole, apart))
        assert across == single
        restarted = [r[column] for r in label(whole, by=("symbol", "year")).orderBy("ts").collect()]
        assert restarted != across


def test_labels_do_not_depend_on_chunks(make_bars, walk, monkeypatch):
    from barloom.operators import chunks

    frame = make_bars(walk(300, seed=12))
    want = [r.label for r in labels.buy_labels(frame, 2.0, 50, block=5).orderBy("ts").collect()]
    monkeypatch.setattr(chunks.halo_chunks, "__defaults__", (0, 7))
    assert [r.label for r in labels.buy_labels(frame, 2.0, 50, block=5).orderBy("ts").collect()] == want
