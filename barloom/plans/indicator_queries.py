"""Queries for technical indicators and overlay normalisation. Long windows are shortened to the test bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators.ewm import add_smoothed
from barloom.plans.common import (
    BARS,
    SO_FAR,
    W,
    bands_sql,
    bars,
    bb_pos,
    ewm_sql,
    full,
    lag_,
    query,
    r,
    rs,
    show,
    smoothed_sql,
    span,
)
from barloom.plans.window_queries import KEYS, _midrank_sql, _pctrank_sql

TR = f"greatest(high - low, abs(high - {lag_('close')}), abs(low - {lag_('close')}))"
_SPANS = (8, 13, 21, 34, 55, 89, 144)
_GAPS = ((8, 21), (8, 55), (21, 55), (34, 89), (55, 144))
_EMAF = [
    *[f"ema_{k}_{n}" for n in _SPANS for k in ("dist", "slope")],
    *[f"ema_gap_{a}_{b}" for a, b in _GAPS],
]


@query(
    "ema_features",
    f"""WITH RECURSIVE {BARS},{ewm_sql('bars', [span(n) for n in sorted({*_SPANS, 5, 20, 50, 200})])}
      SELECT symbol, ts, {', '.join(f"{r(f'(close - ema_{n}) * 100', f'ema_dist_{n}')}, {r(f'(ema_{n} - ' + lag_(f'ema_{n}') + ') * 100', f'ema_slope_{n}')}" for n in _SPANS)},
      {', '.join(r(f'(ema_{a} - ema_{b}) * 100', f'ema_gap_{a}_{b}') for a, b in _GAPS)},
      coalesce(ema_5 > ema_20 AND ema_20 > ema_50 AND ema_50 > ema_200, false)::INTEGER AS ema_stack_bull,
      coalesce(ema_5 < ema_20 AND ema_20 < ema_50 AND ema_50 < ema_200, false)::INTEGER AS ema_stack_bear FROM ew""",
)
def ema_features(spark, sf_dir):
    df = add_smoothed(bars(spark, sf_dir), ema=(*_SPANS, 5, 20, 50, 200))
    df = ind.add_ema_stack(ind.add_ema_features(df, _SPANS, _GAPS))
    return show(df, KEYS, [*_EMAF, "ema_stack_bull", "ema_stack_bear"])


_RSI_LAGS = (1, 3, 5, 8, 13)


@query(
    "rsi_wilder",
    f"""WITH RECURSIVE {smoothed_sql(rsi=(14, 50))} SELECT symbol, ts, {r('rsi_14')}, {r('rsi_50')}, {r('rsi_14 - rsi_50', 'rsi_gap_14_50')},
      {', '.join(r(lag_('rsi_14', k), f'rsi14_lag_{k}') for k in _RSI_LAGS)} FROM sm""",
)
def rsi_wilder(spark, sf_dir):
    from barloom.functions.windows import lag, series

    w = series()
    df = add_smoothed(bars(spark, sf_dir), rsi_periods=(14, 50))
    df = df.withColumns(
        {"rsi_gap_14_50": F.col("rsi_14") - F.col("rsi_50"), **{f"rsi14_lag_{k}": lag("rsi_14", k, w) for k in _RSI_LAGS}}
    )
    return show(df, KEYS, ["rsi_14", "rsi_50", "rsi_gap_14_50", *[f"rsi14_lag_{k}" for k in _RSI_LAGS]])


RSI_SIMPLE = f"""
rs1 AS (SELECT *, coalesce(greatest(close - {lag_('close')}, 0), 0) AS up, coalesce(greatest({lag_('close')} - close, 0), 0) AS dn FROM bars),
rs2 AS (SELECT *, {full('avg', 'up', 14)} AS g, {full('avg', 'dn', 14)} AS l FROM rs1),
rs3 AS (SELECT *, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN l = 0 AND g > 0 THEN 100.0 END AS rsi_simple FROM rs2)"""


@query(
    "rsi_simple",
    f"""WITH {BARS},{RSI_SIMPLE} SELECT symbol, ts, {r('rsi_simple')}, {r('rsi_simple - 50', 'rsi_center')},
      {r(f"rsi_simple - {lag_('rsi_simple', 3)}", 'rsi_slope3')}, {r(f"rsi_simple - {lag_('rsi_simple', 10)}", 'rsi_slope10')} FROM rs3""",
)
def rsi_simple(spark, sf_dir):
    return show(ind.add_rsi_simple(bars(spark, sf_dir)), KEYS, ["rsi_simple", "rsi_center", "rsi_slope3", "rsi_slope10"])


@query("atr_wilder", f"WITH RECURSIVE {smoothed_sql(atr=(14, 20))} SELECT symbol, ts, {rs(['atr14', 'atr20'])} FROM sm")
def atr_wilder(spark, sf_dir):
    return show(add_smoothed(bars(spark, sf_dir), atr_periods=(14, 20)), KEYS, ["atr14", "atr20"])


@query(
    "atr_simple",
    f"""WITH {BARS}, t AS (SELECT *, round({TR}, 2) AS tr FROM bars), a AS (SELECT *, {full('avg', 'tr', 14)} AS atr, row_number() OVER ({W}) AS rn FROM t),
      num AS (SELECT * REPLACE (round(atr, 9) AS atr) FROM a)
      SELECT symbol, ts, {r('atr', 'atr_simple')}, {r(_pctrank_sql('atr', 100, 20), 'atr_rank')} FROM num b""",
)
def atr_simple(spark, sf_dir):
    df = ind.add_atr_simple(bars(spark, sf_dir), rank_window=100, rank_min=20)
    return show(df, KEYS, ["atr_simple", "atr_rank"])


@query(
    "bollinger",
    f"""WITH {BARS},{bands_sql('bars', (20,))} SELECT symbol, ts, {r(bb_pos(20), 'bb20_pos')}, {r('(bb20_upper - bb20_lower) * 100', 'bb20_width')},
      {r('(close - bb20_lower) * 100', 'bb20_lower_dist')} FROM bb""",
)
def bollinger(spark, sf_dir):
    return show(ind.add_bollinger(bars(spark, sf_dir)), KEYS, ["bb20_pos", "bb20_width", "bb20_lower_dist"])


_P = (20, 50, 100)
_FAM = [
    f"bb{p}_{k}"
    for p in _P
    for k in (
        "mid", "upper", "lower", "pos", "z", "width", "mid_dist", "upper_dist", "lower_dist", "mid_slope_1",
        "mid_slope_5", "width_slope_1", "width_slope_5", "squeeze", "expansion", "lower_reversion_raw", "outer_low",
    )
]


def _fam_sql(periods, name: str = "fam", source: str = "bb") -> str:
    cols = []
    for p in periods:
        w = f"(bb{p}_upper - bb{p}_lower)"
        wl = lambda k, p=p: f"({lag_(f'bb{p}_upper', k)} - {lag_(f'bb{p}_lower', k)})"
        cols += [
            f"{bb_pos(p)} AS bb{p}_pos",
            f"(close - bb{p}_mid) / nullif(bb{p}_std, 0) AS bb{p}_z",
            f"{w} * 100 AS bb{p}_width",
            f"(close - bb{p}_mid) * 100 AS bb{p}_mid_dist",
            f"(bb{p}_upper - close) * 100 AS bb{p}_upper_dist",
            f"(close - bb{p}_lower) * 100 AS bb{p}_lower_dist",
            *[f"(bb{p}_mid - {lag_(f'bb{p}_mid', k)}) * 100 AS bb{p}_mid_slope_{k}" for k in (1, 5)],
            *[f"({w} - {wl(k)}) * 100 AS bb{p}_width_slope_{k}" for k in (1, 5)],
        ]
    flags = ", ".join(
        f"""coalesce(bb{p}_width_slope_5 < 0, false)::INTEGER AS bb{p}_squeeze, coalesce(bb{p}_width_slope_5 > 0, false)::INTEGER AS bb{p}_expansion,
        coalesce(bb{p}_pos <= 0.20, false)::INTEGER AS bb{p}_lower_reversion_raw, coalesce(bb{p}_pos < 0.0, false)::INTEGER AS bb{p}_outer_low"""
        for p in periods
    )
    return f"\n{name}_raw AS (SELECT *, {', '.join(cols)} FROM {source}),\n{name} AS (SELECT *, {flags} FROM {name}_raw)"




def _mixed(cols, digits: int = 5) -> str:
    return ", ".join(c if c.startswith("bb_") or c.endswith(("squeeze", "expansion", "reversion_raw", "outer_low")) else r(c, c, digits) for c in cols)


@query("bb_family", f"WITH {BARS},{bands_sql('bars', _P)},{_fam_sql(_P)} SELECT symbol, ts, {_mixed(_FAM)} FROM fam")
def bb_family(spark, sf_dir):
    return show(ind.add_bb_family(bars(spark, sf_dir), _P), KEYS, _FAM, 5)


_CROSS = [
    "bb20_bb50_pos_diff", "bb20_bb100_pos_diff", "bb50_bb100_pos_diff", "bb20_width_over_bb50", "bb20_width_over_bb100",
    "bb50_width_over_bb100", "bb_lower_agree_20_50", "bb_lower_agree_20_100", "bb_lower_agree_all", "bb_trend_context_buy",
]
_LOW = {"b": "(bb20_pos <= 0.20 AND bb50_pos <= 0.35)", "c": "(bb20_pos <= 0.20 AND bb100_pos <= 0.40)"}
_CROSS_SQL = f"""
cr AS (SELECT *, bb20_pos - bb50_pos AS bb20_bb50_pos_diff, bb20_pos - bb100_pos AS bb20_bb100_pos_diff, bb50_pos - bb100_pos AS bb50_bb100_pos_diff,
  bb20_width / nullif(bb50_width, 0) AS bb20_width_over_bb50, bb20_width / nullif(bb100_width, 0) AS bb20_width_over_bb100,
  bb50_width / nullif(bb100_width, 0) AS bb50_width_over_bb100,
  coalesce({_LOW['b']}, false)::INTEGER AS bb_lower_agree_20_50, coalesce({_LOW['c']}, false)::INTEGER AS bb_lower_agree_20_100,
  coalesce({_LOW['b']} AND {_LOW['c']}, false)::INTEGER AS bb_lower_agree_all,
  (coalesce(bb50_mid_slope_5 > 0, false) OR coalesce(bb100_mid_slope_5 > 0, false))::INTEGER AS bb_trend_context_buy FROM fam)"""


@query("bb_cross", f"WITH {BARS},{bands_sql('bars', _P)},{_fam_sql(_P)},{_CROSS_SQL} SELECT symbol, ts, {_mixed(_CROSS)} FROM cr")
def bb_cross(spark, sf_dir):
    return show(ind.add_bb_cross(ind.add_bb_family(bars(spark, sf_dir), _P), _P), KEYS, _CROSS, 5)


_BEH = [
    f"bb20_{k}"
    for k in (
        "pos_cycle_sin", "pos_cycle_cos", "width_atr", "mid_gap_atr_rollmean_20", "mid_gap_atr_rollstd_20",
        "lower_gap_atr_rollmean_20", "lower_gap_atr_rollstd_20", "pos_rank_500", "z_rank_500", "width_atr_rank_500",
    )
]
_CLIP = "least(greatest(bb20_pos, -0.5), 1.5)"


@query(
    "bb_behavior",
    f"""WITH RECURSIVE {smoothed_sql(atr=(14,))},{bands_sql('sm', (20,))},{_fam_sql((20,))},
      gaps AS (SELECT *, CASE WHEN bb20_pos IS NOT NULL THEN {_CLIP} END AS pc, bb20_width / nullif(atr14 * 100, 0) AS width_atr,
        (close - bb20_mid) / nullif(atr14, 0) AS mg, (close - bb20_lower) / nullif(atr14, 0) AS lg FROM fam),
      num AS (SELECT * EXCLUDE (rn), row_number() OVER ({W}) AS rn FROM gaps)
      SELECT symbol, ts, {r('sin(2 * pi() * pc)', 'bb20_pos_cycle_sin', 5)}, {r('cos(2 * pi() * pc)', 'bb20_pos_cycle_cos', 5)}, {r('width_atr', 'bb20_width_atr', 5)},
      {', '.join(f"{r(full('avg', s, 20), f'bb20_{n}_gap_atr_rollmean_20', 5)}, {r(full('stddev_samp', s, 20), f'bb20_{n}_gap_atr_rollstd_20', 5)}" for n, s in (('mid', 'mg'), ('lower', 'lg')))},
      {r('CASE WHEN bb20_pos IS NOT NULL THEN ' + _midrank_sql('bb20_pos', 60, 20) + ' END', 'bb20_pos_rank_500', 5)},
      {r('CASE WHEN bb20_z IS NOT NULL THEN ' + _midrank_sql('bb20_z', 60, 20) + ' END', 'bb20_z_rank_500', 5)},
      {r('CASE WHEN width_atr IS NOT NULL THEN ' + _midrank_sql('width_atr', 60, 20) + ' END', 'bb20_width_atr_rank_500', 5)} FROM num b""",
)
def bb_behavior(spark, sf_dir):
    df = ind.add_bb_family(add_smoothed(bars(spark, sf_dir), atr_periods=(14,)), (20,))
    return show(ind.add_bb_behavior(df, (20,), (20,), 60, 20), KEYS, _BEH, 5)


NORM_SQL = f"""
nb AS (SELECT *, round(abs(close - open), 2) AS body_, round(high - low, 2) AS rng_ FROM %s),
nr AS (SELECT *, round({full('max', 'body_', 200, 50)} - {full('min', 'body_', 200, 50)}, 2) AS spread_, {full('avg', 'rng_', 200, 50)} AS mean_rng FROM nb),
ns AS (SELECT *, nullif(coalesce(nullif(spread_, 0), mean_rng), 0) AS norm_scale FROM nr)"""


@query("norm_scale", f"WITH {BARS},{NORM_SQL % 'bars'} SELECT symbol, ts, {r('norm_scale')} FROM ns")
def norm_scale(spark, sf_dir):
    return show(ind.add_norm_scale(bars(spark, sf_dir)), KEYS, ["norm_scale"])


_NORM = [*[f"ret{n}_r" for n in ind.RETURN_STEPS], "vol30", "vol60", "vol120", "range_r", "body_r", "body_abs_r"]


@query(
    "norm_returns",
    f"""WITH {BARS},{NORM_SQL % 'bars'}, p AS (SELECT *, close / nullif({lag_('close')}, 0) - 1 AS pct FROM ns)
      SELECT symbol, ts, {', '.join(r(f"(close - {lag_('close', n)}) / norm_scale", f'ret{n}_r') for n in ind.RETURN_STEPS)},
      {', '.join(r(f"({full('stddev_samp', 'pct', n)}) * 100", f'vol{n}', 3) for n in (30, 60, 120))},
      {r('(high - low) / norm_scale', 'range_r')}, {r('(close - open) / norm_scale', 'body_r')}, {r('abs((close - open) / norm_scale)', 'body_abs_r')} FROM p""",
)
def norm_returns(spark, sf_dir):
    df = ind.add_norm_returns(ind.add_norm_scale(bars(spark, sf_dir)))
    vols = [F.round(f"vol{n}", 3).alias(f"vol{n}") for n in (30, 60, 120)]
    return df.select(*KEYS, *vols, *[F.round(c, 6).alias(c) for c in _NORM if not c.startswith("vol")])


_V2P = (10, 20, 50)
_V2 = [
    f"bb{p}_{k}"
    for p in _V2P
    for k in (
        "pos", "width_r", "z", "dist_mid_r", "dist_upper_r", "dist_lower_r", "width_rank", "break_upper", "break_lower",
        "squeeze", "reversion_raw", "squeeze_dir_raw", "width_signal",
    )
]


def v2_sql(periods, rank_window: int, rank_min: int) -> str:
    """CTEs on `ns` (bars with norm_scale) giving `v2`."""
    raw = ", ".join(
        f"""{bb_pos(p)} AS bb{p}_pos, bb{p}_upper - bb{p}_lower AS w{p}, (bb{p}_upper - bb{p}_lower) / norm_scale AS bb{p}_width_r,
        (close - bb{p}_mid) / nullif(bb{p}_std, 0) AS bb{p}_z, (close - bb{p}_mid) / norm_scale AS bb{p}_dist_mid_r,
        (close - bb{p}_upper) / norm_scale AS bb{p}_dist_upper_r, (close - bb{p}_lower) / norm_scale AS bb{p}_dist_lower_r,
        coalesce(close > bb{p}_upper, false)::INTEGER AS bb{p}_break_upper, coalesce(close < bb{p}_lower, false)::INTEGER AS bb{p}_break_lower"""
        for p in periods
    )
    ranks = ", ".join(f"{_pctrank_sql(f'w{p}', rank_window, rank_min, 'v2_num')} AS bb{p}_width_rank" for p in periods)
    flags = ", ".join(
        f"""coalesce(bb{p}_width_rank <= 0.20, false)::INTEGER AS bb{p}_squeeze,
        CASE WHEN bb{p}_pos <= 0.20 THEN 1 WHEN bb{p}_pos >= 0.80 THEN -1 ELSE 0 END AS bb{p}_reversion_raw,
        CASE WHEN bb{p}_width_rank <= 0.35 AND bb{p}_pos >= 0.80 THEN 1 WHEN bb{p}_width_rank <= 0.35 AND bb{p}_pos <= 0.20 THEN -1 ELSE 0 END AS bb{p}_squeeze_dir_raw,
        CASE WHEN bb{p}_width_rank >= 0.50 THEN 1 ELSE -1 END AS bb{p}_width_signal"""
        for p in periods
    )
    return f"""{bands_sql('ns', periods, 'vb')},
v2_raw AS (SELECT *, {raw} FROM vb), v2_num AS (SELECT *, row_number() OVER ({W}) AS rn FROM v2_raw),
v2_rank AS (SELECT b.*, {ranks} FROM v2_num b), v2 AS (SELECT *, {flags} FROM v2_rank)"""


_INTS = ("break_upper", "break_lower", "squeeze", "reversion_raw", "squeeze_dir_raw", "width_signal")


@query(
    "bb_family_v2",
    f"WITH {BARS},{NORM_SQL % 'bars'},{v2_sql(_V2P, 100, 20)} SELECT symbol, ts, {', '.join(c if c.endswith(_INTS) else r(c, c, 5) for c in _V2)} FROM v2",
)
def bb_family_v2(spark, sf_dir):
    df = ind.add_bb_family_v2(ind.add_norm_scale(bars(spark, sf_dir)), _V2P, 100, 20)
    return show(df, KEYS, _V2, 5)


_OV = [
    *[f"%s_ov_{k}" for k in ("value", "distance", "pct_distance")],
    *[f"%s_ov_{k}_lag{n}" for k in ("value", "distance", "pct_distance") for n in ind.OVERLAY_LAGS],
    *[f"%s_ov_velocity{v}" for v in (1, 3, 5, 8)],
    *[f"%s_ov_velocity{v}_lag{k}" for v in (1, 3, 5, 8) for k in (1, 3)],
    *[f"%s_ov_acceleration{k}" for k in (1, 3, 5)],
    "%s_ov_std",
]
_LINES = {"ema_21": 21, "bb20_lower": 20}


def _ov_sql() -> tuple[str, str]:
    a, b, cols = [], [], []
    for n, win in _LINES.items():
        p = f"{n}_ov"
        a += [f"({n} - close) / nullif(atr14, 0) AS {p}_value", f"({n} - close) / nullif(close, 0) AS {p}_pct_distance"]
        a += [f"({n} - {lag_(n, v)}) / nullif(atr14, 0) AS {p}_velocity{v}" for v in (1, 3, 5, 8)]
        b.append(f"{full('stddev_samp', f'{p}_value', win)} AS {n}_sd")
        cols += [r(f"{p}_value", f"{p}_{k}", 5) for k in ("value", "distance")] + [r(f"{p}_pct_distance", f"{p}_pct_distance", 5)]
        for k in ind.OVERLAY_LAGS:
            cols += [r(lag_(f"{p}_value", k), f"{p}_{x}_lag{k}", 5) for x in ("value", "distance")]
            cols.append(r(lag_(f"{p}_pct_distance", k), f"{p}_pct_distance_lag{k}", 5))
        for v in (1, 3, 5, 8):
            cols.append(r(f"{p}_velocity{v}", f"{p}_velocity{v}", 5))
            cols += [r(lag_(f"{p}_velocity{v}", k), f"{p}_velocity{v}_lag{k}", 5) for k in (1, 3)]
        cols += [r(f"{p}_velocity{k} - {lag_(f'{p}_velocity{k}', k)}", f"{p}_acceleration{k}", 5) for k in (1, 3, 5)]
        cols.append(r(f"CASE WHEN {n}_sd IS NOT NULL THEN {_midrank_sql(f'{n}_sd', 60, 20)} END", f"{p}_std", 5))
    ctes = f"""ov1 AS (SELECT *, {', '.join(a)} FROM bb), ov2 AS (SELECT *, {', '.join(b)} FROM ov1),
num AS (SELECT * EXCLUDE (rn), row_number() OVER ({W}) AS rn FROM ov2)"""
    return ctes, ", ".join(cols)


_OV_CTES, _OV_COLS = _ov_sql()


@query(
    "overlay_norm",
    f"WITH RECURSIVE {smoothed_sql(ema=(21,), atr=(14,))},{bands_sql('sm', (20,))},{_OV_CTES} SELECT symbol, ts, {_OV_COLS} FROM num b",
)
def overlay_norm(spark, sf_dir):
    df = ind.bands(add_smoothed(bars(spark, sf_dir), ema=(21,), atr_periods=(14,)), (20,))
    df = ind.add_overlay(df, _LINES, rank_window=60, rank_min=20)
    return show(df, KEYS, [c % n for n in _LINES for c in _OV], 5)


_LINE_NAMES = [n for n in ind.OVERLAY_LINES]


def all_lines(df):
    """Every overlay line of the catalog on a bar frame."""
    df = add_smoothed(df, ema=(8, 13, 20, 21, 34, 55, 89, 144, 200), atr_periods=(14, 20))
    df = ind.add_keltner(ind.bands(df, (20, 50, 100, 200)))
    df = ind.add_vwap_session(ind.add_vwap_rolling(ind.add_donchian(df)))
    return ind.add_supertrend(ind.add_psar(ind.add_ichimoku(df)))


@query("overlay_lines")
def overlay_lines(spark, sf_dir):
    """All lines of the catalog, normalised; the value columns, one row per bar."""
    df = ind.add_overlay(all_lines(bars(spark, sf_dir)), ind.OVERLAY_LINES, rank_window=60, rank_min=20, parts=("std",))
    return show(df, KEYS, [f"{n}_ov_{k}" for n in _LINE_NAMES for k in ("value", "std")], 5)


_KC = ["keltner20_mid", "keltner20_upper", "keltner20_lower"]


@query(
    "keltner",
    f"""WITH RECURSIVE {smoothed_sql(ema=(20,), atr=(20,))} SELECT symbol, ts, {r('ema_20', 'keltner20_mid')}, {r('ema_20 + 1.5 * atr20', 'keltner20_upper')},
      {r('ema_20 - 1.5 * atr20', 'keltner20_lower')} FROM sm""",
)
def keltner(spark, sf_dir):
    return show(ind.add_keltner(add_smoothed(bars(spark, sf_dir), ema=(20,), atr_periods=(20,))), KEYS, _KC)


@query(
    "vwap_rolling",
    f"WITH {BARS}, v AS (SELECT *, close * volume AS cv FROM bars) SELECT symbol, ts, {r('(' + full('sum', 'cv', 100) + ') / nullif(' + full('sum', 'volume', 100) + ', 0)', 'vwap100', 9)} FROM v",
)
def vwap_rolling(spark, sf_dir):
    return show(ind.add_vwap_rolling(bars(spark, sf_dir)), KEYS, ["vwap100"], 9)


@query(
    "vwap_session",
    f"""WITH {BARS} SELECT symbol, ts, {r('sum((high + low + close) / 3 * nullif(volume, 0)) OVER d / nullif(sum(nullif(volume, 0)) OVER d, 0)', 'vwap_session')}
      FROM bars WINDOW d AS (PARTITION BY symbol, ts::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
)
def vwap_session(spark, sf_dir):
    return show(ind.add_vwap_session(bars(spark, sf_dir)), KEYS, ["vwap_session"])


_ICHI = ["ichimoku_tenkan", "ichimoku_kijun", "ichimoku_span_a_raw", "ichimoku_span_b_raw"]


def _mid(n: int) -> str:
    return f"(({full('max', 'high', n)}) + ({full('min', 'low', n)})) / 2"


@query(
    "ichimoku",
    f"""WITH {BARS}, i AS (SELECT *, {_mid(9)} AS ten, {_mid(26)} AS kij, {_mid(52)} AS spb FROM bars)
      SELECT symbol, ts, {r('ten', 'ichimoku_tenkan')}, {r('kij', 'ichimoku_kijun')}, {r('(ten + kij) / 2', 'ichimoku_span_a_raw')}, {r('spb', 'ichimoku_span_b_raw')} FROM i""",
)
def ichimoku(spark, sf_dir):
    return show(ind.add_ichimoku(bars(spark, sf_dir)), KEYS, _ICHI)


def _psar_sql(clamp_first: bool) -> str:
    h, lo = "h1", "l1"
    if clamp_first:
        low, high = "least(s0, l1, coalesce(l2, l1))", "greatest(s0, h1, coalesce(h2, h1))"
    else:
        low = "CASE WHEN l2 IS NULL THEN s0 ELSE least(s0, l1, l2) END"
        high = "CASE WHEN h2 IS NULL THEN s0 ELSE greatest(s0, h1, h2) END"
    return f"""
pn AS (SELECT *, row_number() OVER ({W}) AS rn, {lag_('high')} AS h1, {lag_('high', 2)} AS h2, {lag_('low')} AS l1, {lag_('low', 2)} AS l2 FROM bars),
pr AS (
  SELECT symbol, year, rn, low AS sar, true AS up, 0.02::DOUBLE AS af, high AS ep FROM pn WHERE rn = 1
  UNION ALL
  SELECT symbol, year, rn, CASE WHEN up THEN CASE WHEN low < s THEN ep ELSE s END ELSE CASE WHEN high > s THEN ep ELSE s END END,
    CASE WHEN up THEN NOT low < s ELSE high > s END,
    CASE WHEN (up AND low < s) OR (NOT up AND high > s) THEN 0.02
         WHEN (up AND high > ep) OR (NOT up AND low < ep) THEN least(af + 0.02, 0.2) ELSE af END,
    CASE WHEN up THEN CASE WHEN low < s THEN low WHEN high > ep THEN high ELSE ep END
         ELSE CASE WHEN high > s THEN high WHEN low < ep THEN low ELSE ep END END
  FROM (SELECT *, CASE WHEN up THEN {low} ELSE {high} END AS s FROM (
    SELECT n.symbol, n.year, n.rn, n.high, n.low, n.h1, n.h2, n.l1, n.l2, p.up, p.af, p.ep, p.sar + p.af * (p.ep - p.sar) AS s0
    FROM pr p JOIN pn n ON n.symbol = p.symbol AND n.year = p.year AND n.rn = p.rn + 1))),
ps AS (SELECT * FROM pn JOIN pr USING (symbol, year, rn))"""


@query(
    "psar",
    f"""WITH RECURSIVE {BARS},{_psar_sql(False)},{NORM_SQL % 'ps'} SELECT symbol, ts, {r('sar', 'psar')}, {r('(close - sar) / norm_scale', 'psar_dist_r')},
      sign(round(close - sar, 9))::INTEGER AS psar_side FROM ns""",
)
def psar(spark, sf_dir):
    from barloom.functions.scalars import safe_div, sign

    df = ind.add_norm_scale(ind.add_psar(bars(spark, sf_dir)))
    gap = F.col("close") - F.col("psar")
    df = df.withColumns({"psar_dist_r": safe_div(gap, "norm_scale"), "psar_side": sign(F.round(gap, 9))})
    return show(df, KEYS, ["psar", "psar_dist_r", "psar_side"])


@query("psar_clamped", f"WITH RECURSIVE {BARS},{_psar_sql(True)} SELECT symbol, ts, {r('sar', 'psar')} FROM ps")
def psar_clamped(spark, sf_dir):
    return show(ind.add_psar(bars(spark, sf_dir), clamp_first=True), KEYS, ["psar"])


@query(
    "supertrend",
    f"""WITH RECURSIVE {smoothed_sql(atr=(20,))}, b1 AS (SELECT *, (high + low) / 2 + 3 * atr20 AS u, (high + low) / 2 - 3 * atr20 AS d FROM sm),
      b2 AS (SELECT *, CASE WHEN close > {lag_('u')} THEN 1 WHEN close < {lag_('d')} THEN 0 END AS flip FROM b1),
      b3 AS (SELECT *, coalesce(last_value(flip IGNORE NULLS) {SO_FAR}, 1)::INTEGER AS supertrend_up FROM b2)
      SELECT symbol, ts, supertrend_up, {r('CASE WHEN supertrend_up = 1 THEN d ELSE u END', 'supertrend20x3')} FROM b3""",
)
def supertrend(spark, sf_dir):
    df = ind.add_supertrend(add_smoothed(bars(spark, sf_dir), atr_periods=(20,)))
    return show(df, KEYS, ["supertrend_up", "supertrend20x3"])


_STO = ["sto14", "sto14_d3", "stoch_spread", "stoch_slope3"]


@query(
    "stochastic",
    f"""WITH {BARS}, a AS (SELECT *, {full('min', 'low', 14)} AS lo, {full('max', 'high', 14)} AS hi FROM bars),
      b AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS k FROM a), c AS (SELECT *, {full('avg', 'k', 3)} AS d3 FROM b)
      SELECT symbol, ts, {r('k', 'sto14')}, {r('d3', 'sto14_d3')}, {r('k - d3', 'stoch_spread')}, {r(f"k - {lag_('k', 3)}", 'stoch_slope3')} FROM c""",
)
def stochastic(spark, sf_dir):
    return show(ind.add_stochastic(bars(spark, sf_dir)), KEYS, _STO)


_ADX = ["plus_di14", "minus_di14", "di_spread", "di_abs", "adx14", "adx_slope3", "adx_slope10"]


@query(
    "adx",
    f"""WITH {BARS}, a AS (SELECT *, {TR} AS tr, high - {lag_('high')} AS um, {lag_('low')} - low AS dm FROM bars),
      b AS (SELECT *, CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END AS p, CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END AS m FROM a),
      c AS (SELECT *, 100 * ({full('avg', 'p', 14)}) / nullif({full('avg', 'tr', 14)}, 0) AS pdi, 100 * ({full('avg', 'm', 14)}) / nullif({full('avg', 'tr', 14)}, 0) AS mdi FROM b),
      d AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM c), e AS (SELECT *, {full('avg', 'dx', 14)} AS adx FROM d)
      SELECT symbol, ts, {r('pdi', 'plus_di14')}, {r('mdi', 'minus_di14')}, {r('pdi - mdi', 'di_spread')}, {r('abs(pdi - mdi)', 'di_abs')}, {r('adx', 'adx14')},
      {r(f"adx - {lag_('adx', 3)}", 'adx_slope3')}, {r(f"adx - {lag_('adx', 10)}", 'adx_slope10')} FROM e""",
)
def adx(spark, sf_dir):
    return show(ind.add_adx(bars(spark, sf_dir)), KEYS, _ADX)


@query(
    "volume_z",
    f"WITH {BARS} SELECT symbol, ts, {r('(volume - (' + full('avg', 'volume', 100) + ')) / nullif(' + full('stddev_samp', 'volume', 100) + ', 0)', 'volume_z_100')} FROM bars",
)
def volume_z(spark, sf_dir):
    return show(ind.add_volume_z(bars(spark, sf_dir)), KEYS, ["volume_z_100"])
