"""Queries for cycles, signals, gates and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import safe_div
from barloom.operators import cycles, labels, signals, thresholds
from barloom.operators import indicators as ind
from barloom.operators.chunks import with_candle
from barloom.operators.ewm import add_smoothed
from barloom.operators.resample import asof_backward, htf_features, resample
from barloom.plans.bar_queries import _HTF_SQL
from barloom.plans.common import (
    BARS,
    HORIZON,
    R1,
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
    scored,
    SCORED,
    show,
    smoothed_sql,
    span,
)
from barloom.plans.indicator_queries import NORM_SQL, RSI_SIMPLE, v2_sql
from barloom.plans.window_queries import KEYS
from barloom.session import materialise


def runs_sql(source: str, dir_expr: str, name: str, p: str) -> str:
    """CTE `<name>`: source with <p>_dir, <p>_id, <p>_bar, <p>_changed, numbered by islands of equal direction."""
    return f"""
{name}_a AS (SELECT *, {dir_expr} AS {p}_dir FROM {source}),
{name}_b AS (SELECT *, CASE WHEN {lag_(f'{p}_dir')} IS NULL OR {lag_(f'{p}_dir')} <> {p}_dir THEN 1 ELSE 0 END AS {p}_changed FROM {name}_a),
{name}_c AS (SELECT *, (sum({p}_changed) {SO_FAR})::BIGINT AS {p}_id FROM {name}_b),
{name} AS (SELECT *, (row_number() OVER (PARTITION BY symbol, year, {p}_id ORDER BY ts) - 1)::BIGINT AS {p}_bar FROM {name}_c)"""


def dir_sql(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({a} - {b}, 0) < 0 THEN -1 ELSE 1 END"


def touch_sql(source: str, line: str, name: str, p: str, first: str, count: str) -> str:
    return f"""
{name}_t AS (SELECT *, coalesce(low <= {line} AND high >= {line}, false)::INTEGER AS tch FROM {source}),
{name}_u AS (SELECT *, sum(tch) OVER (PARTITION BY symbol, year, {p}_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS tc FROM {name}_t),
{name} AS (SELECT * EXCLUDE (tch, tc), (tch = 1 AND tc = 1)::INTEGER AS {first}, least(tc, 10)::INTEGER AS {count} FROM {name}_u)"""


_EMAS = (5, 9, 20, 21)
_BASE = f"{BARS},{ewm_sql('bars', [span(n) for n in _EMAS])}"
SIG = f"""{_BASE},{runs_sql('ew', dir_sql('ema_9', 'ema_21'), 'cy', 'sig')},
ph1 AS (SELECT *, abs(ema_9 - ema_21) AS spread FROM cy), ph2 AS (SELECT *, spread - {lag_('spread', 3)} AS slope FROM ph1),
ph3 AS (SELECT *, {full('sum', 'slope', 3)} AS slope3 FROM ph2),
ph4 AS (SELECT *, CASE WHEN sig_bar > 8 AND slope3 < 0 THEN 2 WHEN sig_bar > 3 AND slope >= 0 THEN 1 ELSE 0 END AS cycle_phase,
  row_number() OVER ({W}) AS pos FROM ph3),
ph AS (SELECT *, coalesce(pos - last_value(CASE WHEN cycle_phase = 1 THEN pos END IGNORE NULLS) {SO_FAR}, 0)::BIGINT AS bars_since_mid FROM ph4)"""


def _smooth(spark, sf_dir):
    return add_smoothed(bars(spark, sf_dir), ema=_EMAS)


@query(
    "cycles",
    f"WITH RECURSIVE {_BASE},{runs_sql('ew', dir_sql('ema_9', 'ema_21'), 'cy', 'sig')} SELECT symbol, ts, sig_dir AS signal_dir, sig_id AS cycle_id, sig_bar AS cycle_bar, sig_changed AS cycle_changed FROM cy",
)
def cycle_runs(spark, sf_dir):
    df = _smooth(spark, sf_dir).withColumn("signal_dir", cycles.direction("ema_9", "ema_21"))
    df = cycles.add_runs(df, "signal_dir", "cycle")
    return df.select("symbol", "ts", "signal_dir", "cycle_id", F.col("cycle_bar").cast("bigint").alias("cycle_bar"), "cycle_changed")


@query(
    "cycle_phase",
    f"""WITH RECURSIVE {SIG} SELECT symbol, ts, cycle_phase, least(sig_bar, 60)::BIGINT AS cycle_age_clip, (cycle_phase = 0)::INTEGER AS phase_start,
      (cycle_phase = 1)::INTEGER AS phase_middle, (cycle_phase = 2)::INTEGER AS phase_end, bars_since_mid FROM ph""",
)
def cycle_phase(spark, sf_dir):
    df = cycles.add_signal_cycle(_smooth(spark, sf_dir))
    longs = [F.col(c).cast("bigint").alias(c) for c in ("cycle_age_clip", "bars_since_mid")]
    return df.select("symbol", "ts", "cycle_phase", "phase_start", "phase_middle", "phase_end", *longs)


TOUCH = f"""{SIG},{touch_sql('ph', 'ema_20', 'tou', 'sig', 'first_touch_ma20', 'cycle_touch_count')},
sb AS (SELECT *, sign(coalesce(close - ema_20, 0)) AS side, round(abs(close - open), 2) AS body FROM tou),
sc AS (SELECT *, coalesce({lag_('side')}, 0) AS pside, CASE WHEN count(body) OVER b >= 50 THEN quantile_cont(body, 0.7) OVER b END AS cut FROM sb
  WINDOW b AS ({W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
tq AS (SELECT *, (pside <> 0 AND side <> 0 AND pside <> side)::INTEGER AS close_cross_ma20,
  coalesce(abs(close - open) > cut, false)::INTEGER AS strong_body FROM sc),
tw AS (SELECT *, (strong_body = 1 AND sign(close - open) = sig_dir)::INTEGER AS strong_body_confirm FROM tq)"""


@query(
    "cycle_touch",
    f"WITH RECURSIVE {TOUCH} SELECT symbol, ts, first_touch_ma20, cycle_touch_count, close_cross_ma20, strong_body, strong_body_confirm FROM tw",
)
def cycle_touch(spark, sf_dir):
    df = cycles.add_cycle_touch(cycles.add_signal_cycle(_smooth(spark, sf_dir)))
    return df.select("symbol", "ts", "first_touch_ma20", "cycle_touch_count", "close_cross_ma20", "strong_body", "strong_body_confirm")


_MA = [
    "signal_dir", "cycle_bar", "cycle_bar_clip", "cycle_bar_log", "cycle_start", "cycle_age_0_3", "cycle_age_4_10", "cycle_age_11_30",
    "cycle_age_31_plus", "spread_r", "spread_slope_r", "price_extension_r", "first_touch_ma20", "touch_ma20_count_clip",
]


@query(
    "cycle_ages",
    f"""WITH RECURSIVE {_BASE},{NORM_SQL % 'ew'},{runs_sql('ns', dir_sql('ema_5', 'ema_20'), 'ma', 'c')},{touch_sql('ma', 'ema_20', 'mt', 'c', 'f1', 'tc10')},
      mu AS (SELECT *, (ema_5 - ema_20) / norm_scale AS spread_r FROM mt)
      SELECT symbol, ts, c_dir AS signal_dir, c_bar AS cycle_bar, least(c_bar, 120)::BIGINT AS cycle_bar_clip, {r('ln(1 + c_bar)', 'cycle_bar_log')},
      (c_bar = 0)::INTEGER AS cycle_start, (c_bar <= 3)::INTEGER AS cycle_age_0_3, (c_bar BETWEEN 4 AND 10)::INTEGER AS cycle_age_4_10,
      (c_bar BETWEEN 11 AND 30)::INTEGER AS cycle_age_11_30, (c_bar >= 31)::INTEGER AS cycle_age_31_plus, {r('spread_r')},
      {r(f"spread_r - {lag_('spread_r', 3)}", 'spread_slope_r')}, {r('(close - ema_20) / norm_scale * c_dir', 'price_extension_r')},
      f1 AS first_touch_ma20, tc10 AS touch_ma20_count_clip FROM mu""",
)
def cycle_ages(spark, sf_dir):
    df = cycles.add_ma_cycle(ind.add_norm_scale(_smooth(spark, sf_dir)))
    df = df.select("symbol", "ts", *[F.col(f"ma5_ma20_{c}").alias(c) for c in _MA])
    df = df.withColumns({c: F.col(c).cast("bigint") for c in ("cycle_bar", "cycle_bar_clip")})
    return show(df, KEYS, _MA)


_GEN = [
    "signal_dir", "bar", "bar_clip", "bar_log", "start", "changed", "age_0_3", "age_4_10", "age_11_30", "age_31_60", "age_61_plus",
    "price_extension", "first_touch_ref", "touch_ref_count_clip",
]


def _gen_sql(name: str, p: str) -> str:
    return f"""SELECT symbol, ts, '{name}' AS cycle, {p}_dir AS signal_dir, {p}_bar AS bar, least({p}_bar, 120)::BIGINT AS bar_clip, {r(f'ln(1 + {p}_bar)', 'bar_log', 5)},
      ({p}_bar = 0)::INTEGER AS start, {p}_changed AS changed, ({p}_bar <= 3)::INTEGER AS age_0_3, ({p}_bar BETWEEN 4 AND 10)::INTEGER AS age_4_10,
      ({p}_bar BETWEEN 11 AND 30)::INTEGER AS age_11_30, ({p}_bar BETWEEN 31 AND 60)::INTEGER AS age_31_60, ({p}_bar >= 61)::INTEGER AS age_61_plus,
      {r(f'(close - bb20_mid) / norm_scale * {p}_dir', 'price_extension', 5)}, f1 AS first_touch_ref, tc10 AS touch_ref_count_clip FROM {p}_t"""


_REV = f"CASE WHEN {bb_pos(20)} <= 0.20 THEN 1 WHEN {bb_pos(20)} >= 0.80 THEN -1 ELSE 0 END"


@query(
    "cycle_generic",
    f"""WITH {BARS},{NORM_SQL % 'bars'},{bands_sql('ns', (20,))},
      {runs_sql('bb', dir_sql('close', 'bb20_mid'), 'g1', 'm')},{touch_sql('g1', 'bb20_mid', 'm_t', 'm', 'f1', 'tc10')},
      {runs_sql('bb', _REV, 'g2', 'v')},{touch_sql('g2', 'bb20_mid', 'v_t', 'v', 'f1', 'tc10')}
      {_gen_sql('mid', 'm')} UNION ALL {_gen_sql('reversion', 'v')}""",
)
def cycle_generic(spark, sf_dir):
    """A price/line cycle and a signal cycle of the 20-bar band, one row per bar and cycle."""
    df = ind.bands(ind.add_norm_scale(bars(spark, sf_dir)), (20,))
    pos = ind.band_position(20)
    df = df.withColumn("raw", F.when(pos <= 0.20, 1).when(pos >= 0.80, -1).otherwise(0))
    df = cycles.add_cycle_columns(df, "mid", "bb20_mid", line="bb20_mid")
    return generic_rows(cycles.add_cycle_columns(df, "reversion", "bb20_mid", signal="raw"))


def generic_rows(df):
    both = F.array(*[F.struct(F.lit(p).alias("cycle"), *[F.col(f"{p}_{c}").alias(c) for c in _GEN]) for p in ("mid", "reversion")])
    out = df.select("symbol", "ts", F.explode(both).alias("c")).select("symbol", "ts", "c.*")
    out = out.withColumns({c: F.col(c).cast("bigint") for c in ("bar", "bar_clip")})
    return show(out, (*KEYS, "cycle"), _GEN, 5)


# --- signals -------------------------------------------------------------------------------------------

SIGNALS_SQL = f"""{smoothed_sql(ema=(8, 55), rsi=(14,))},{bands_sql('sm', (20,))},
si AS (SELECT * EXCLUDE (rn), (close - open) * 100 AS ret_1, {bb_pos(20)} AS bb20_pos, (close - bb20_mid) / nullif(bb20_std, 0) AS z20, (close - ema_8) * 100 AS ed8,
  (close - ema_55) * 100 AS ed55, round((close - {lag_('close')}) * 100) AS dc, (hour(ts) BETWEEN 7 AND 21)::INTEGER AS session_london_ny,
  (hour(ts) BETWEEN 12 AND 21)::INTEGER AS session_ny FROM bb),
sj AS (SELECT *, {full('sum', 'dc', 10)} AS rs10 FROM si),
sk AS (SELECT *, coalesce(bb20_pos < 0.18 AND rsi_14 < 45, false)::INTEGER AS sig_bb_reversion_buy,
  coalesce(ed55 > 0 AND ed8 < 0 AND ret_1 > 0, false)::INTEGER AS sig_pullback_trend_buy,
  coalesce(rs10 > 0 AND z20 > -0.5 AND z20 < 1.5, false)::INTEGER AS sig_momentum_buy FROM sj),
sg AS (SELECT *, (sig_bb_reversion_buy = 1 OR sig_pullback_trend_buy = 1 OR (sig_momentum_buy = 1 AND session_london_ny = 1))::INTEGER AS buy_signal FROM sk)"""


def signalled(spark, sf_dir):
    return signals.add_buy_signals(signals.add_signal_inputs(bars(spark, sf_dir)))


@query("buy_signals", f"WITH RECURSIVE {SIGNALS_SQL} SELECT symbol, ts, {', '.join(signals.SIGNALS)} FROM sg")
def buy_signals(spark, sf_dir):
    return signalled(spark, sf_dir).select("symbol", "ts", *signals.SIGNALS)


_ANG = {"tod": "(hour(ts) * 60 + minute(ts)) / 1440.0", "dow": "(isodow(ts) - 1) / 5.0"}


@query(
    "fs03_features",
    f"""WITH RECURSIVE {SIGNALS_SQL} SELECT symbol, ts, {', '.join(f"{r(lag_('dc', k), f'close_diff_lag_{k}')}, {r(lag_('ret_1', k), f'body_lag_{k}')}" for k in signals.FS03_LAGS)},
      {', '.join(r(f'{f}(2 * pi() * {a})', f'{n}_{f}') for n, a in _ANG.items() for f in ('sin', 'cos'))}, {', '.join(signals.SIGNALS)} FROM sg""",
)
def fs03_features(spark, sf_dir):
    return show(signals.add_fs03(bars(spark, sf_dir)), KEYS, signals.FS03_COLUMNS)


# Days of the month as splits: the bars of the test tables span one month.
DAY_SPLIT = "CASE WHEN day(ts) <= 20 THEN 'train' WHEN day(ts) <= 25 THEN 'valid' ELSE 'test' END"


def day_split(df):
    day = F.dayofmonth("ts")
    return df.withColumn("split", F.when(day <= 20, "train").when(day <= 25, "valid").otherwise("test"))


def lab_sql(source: str, horizon: int = HORIZON, r1: float = R1) -> str:
    """CTE `lab`: source with label, label_res, entry_index, entry_price; every bar meets every bar of its horizon."""
    lv = int(r1 * 100)
    return f"""
la AS (SELECT *, row_number() OVER ({W}) - 1 AS candle, count(*) OVER (PARTITION BY symbol, year) AS n_candles, lead(open) OVER ({W}) AS nxt,
  round(open * 100)::BIGINT AS po, round(high * 100)::BIGINT AS ph_, round(low * 100)::BIGINT AS pl, round(close * 100)::BIGINT AS pc FROM {source}),
lb AS (SELECT *, CASE WHEN candle < n_candles - 2 THEN round(nxt * 100)::BIGINT END AS e FROM la),
lc AS (SELECT symbol, year, candle, arg_min(v, j) AS label FROM (
  SELECT x.symbol, x.year, x.candle, y.candle AS j,
    CASE WHEN (y.pl <= x.e + {lv} AND x.e + {lv} <= y.ph_) AND (y.pl <= x.e - {lv} AND x.e - {lv} <= y.ph_) THEN CASE WHEN y.pc < y.po THEN 1 ELSE 0 END
         WHEN y.pl <= x.e + {lv} AND x.e + {lv} <= y.ph_ THEN 1 WHEN y.pl <= x.e - {lv} AND x.e - {lv} <= y.ph_ THEN 0
         WHEN least(y.po, x.e) <= x.e - {lv} AND x.e - {lv} <= greatest(y.po, x.e) THEN 0
         WHEN least(y.po, x.e) <= x.e + {lv} AND x.e + {lv} <= greatest(y.po, x.e) THEN 1 END AS v
  FROM lb x JOIN lb y ON x.symbol = y.symbol AND x.year = y.year AND y.candle > x.candle AND y.candle <= x.candle + 1 + {horizon})
  WHERE v IS NOT NULL GROUP BY ALL),
lab AS (SELECT lb.*, lc.label::INTEGER AS label, CASE WHEN lc.label IS NULL THEN 'No res' WHEN lc.label = 1 THEN 'Win' ELSE 'Lose' END AS label_res,
  CASE WHEN e IS NOT NULL THEN candle + 1 ELSE -1 END AS entry_index, e / 100.0 AS entry_price FROM lb LEFT JOIN lc USING (symbol, year, candle))"""


_G = list(signals.GATE_COLUMNS)
EDGE_SQL = f"""{_HTF_SQL},
sig_moves AS (SELECT *, close - {lag_('close')} AS dclose FROM bars),
sig_parts AS (SELECT *, CASE WHEN dclose IS NOT NULL THEN greatest(dclose, 0.0) END AS up, CASE WHEN dclose IS NOT NULL THEN greatest(-dclose, 0.0) END AS down FROM sig_moves),
{ewm_sql('sig_parts', [span(8), span(55), ('g14', 'up', 1 / 14, 14), ('l14', 'down', 1 / 14, 14)], 'se')},
sm AS (SELECT *, 100.0 - 100.0 / (1.0 + g14 / nullif(l14, 0)) AS rsi_14 FROM se),{SIGNALS_SQL[SIGNALS_SQL.index('bb_raw AS') - 1:]},
{lab_sql('sg')},
edge AS (SELECT lab.*, {', '.join(f'h4.{c}' for c in _G)}, {DAY_SPLIT.replace('ts', 'lab.ts')} AS split
  FROM lab ASOF LEFT JOIN h4 ON lab.symbol = h4.symbol AND lab.year = h4.year AND lab.ts >= h4.ts
  WHERE lab.buy_signal = 1 AND lab.label IS NOT NULL)"""


def edge_rows(spark, sf_dir):
    """Candidate rows with the higher-timeframe columns gates read, their label and split."""
    b = materialise(bars(spark, sf_dir))
    sig = signals.add_buy_signals(signals.add_signal_inputs(b))
    keep = ["symbol", "year", "ts", "open", "high", "low", "close", "session_london_ny", "session_ny", *signals.SIGNALS]
    lab = labels.buy_labels(sig.select(*keep), R1, HORIZON)
    htf = htf_features(resample(b, 4 * 3600), "h4").select("symbol", "year", "ts", *_G)
    rows = asof_backward(lab, htf).filter("buy_signal = 1 AND label IS NOT NULL")
    return day_split(rows)


def quantile_table(rows):
    """q20..q80 of every gate column on the training rows."""
    return signals.fit_gate_quantiles(rows.filter("split = 'train'"), _G)


_Q_SQL = f"""ql AS (UNPIVOT (SELECT {', '.join(_G)} FROM edge WHERE split = 'train') ON {', '.join(_G)} INTO NAME "column" VALUE value),
qt AS (SELECT "column", {', '.join(f"quantile_cont(value, {v}) AS {k}" for k, v in signals.GATE_QUANTILES.items())} FROM ql GROUP BY "column")"""


@query("gate_quantiles", f'WITH RECURSIVE {EDGE_SQL},{_Q_SQL} SELECT "column", {rs(list(signals.GATE_QUANTILES))} FROM qt')
def gate_quantiles(spark, sf_dir):
    return show(quantile_table(edge_rows(spark, sf_dir)), ("column",), list(signals.GATE_QUANTILES))


def _gate_sql(name: str) -> str:
    out = []
    for kind, column, arg in signals.GATES[name]:
        if kind == "flag":
            out.append(f"{column} = 1")
        else:
            out.append(f"""{column} {'>' if kind == 'above' else '<'} (SELECT {arg} FROM qt WHERE "column" = '{column}')""")
    cond = " AND ".join(out) or "true"
    return f"coalesce({cond}, false)::INTEGER AS gate_{name}"


_GATED = f"""{EDGE_SQL},{_Q_SQL}, gated AS (SELECT edge.*, {', '.join(_gate_sql(g) for g in signals.GATES)} FROM edge)"""
_GATE_COLS = [f"gate_{g}" for g in signals.GATES]


def gated_rows(spark, sf_dir):
    # Used twice: for the training quantiles and for the gates themselves.
    rows = materialise(edge_rows(spark, sf_dir))
    return signals.add_gates(rows, quantile_table(rows))


@query("gates", f"WITH RECURSIVE {_GATED} SELECT symbol, ts, split, {', '.join(_GATE_COLS)} FROM gated")
def gates(spark, sf_dir):
    return gated_rows(spark, sf_dir).select("symbol", "ts", "split", *_GATE_COLS)


_SCAN_SQL = f"""{_GATED},
gl AS (UNPIVOT (SELECT split, label, {', '.join(_GATE_COLS)} FROM gated) ON {', '.join(_GATE_COLS)} INTO NAME gname VALUE hit),
sc0 AS (SELECT split, replace(gname, 'gate_', '') AS gate, sum(hit)::BIGINT AS rows, sum(hit * label)::BIGINT AS wins,
  sum(hit * (1 - label))::BIGINT AS losses, count(*) AS n FROM gl GROUP BY ALL),
scan AS (SELECT split, gate, rows, wins, losses, wins + losses AS resolved, CASE WHEN wins + losses > 0 THEN round(wins * 100.0 / (wins + losses), 4) ELSE 0.0 END AS winrate,
  round(rows * 100.0 / n, 4) AS coverage FROM sc0)"""


def _scan(spark, sf_dir):
    return thresholds.gate_scan(gated_rows(spark, sf_dir), _GATE_COLS)


@query("gate_scan", f"WITH RECURSIVE {_SCAN_SQL} SELECT split, gate, rows, wins, losses, resolved, winrate::DOUBLE AS winrate, coverage::DOUBLE AS coverage FROM scan")
def gate_scan(spark, sf_dir):
    return _scan(spark, sf_dir).select("split", "gate", "rows", "wins", "losses", "resolved", "winrate", "coverage")


_SPL = ("train", "valid", "test")


@query(
    "gate_pivot",
    f"""WITH RECURSIVE {_SCAN_SQL} SELECT gate, {', '.join(f"max(CASE WHEN split = '{s}' THEN winrate END)::DOUBLE AS {s}_wr, max(CASE WHEN split = '{s}' THEN resolved END) AS {s}_resolved" for s in _SPL)} FROM scan GROUP BY gate""",
)
def gate_pivot(spark, sf_dir):
    return thresholds.gate_pivot(_scan(spark, sf_dir), _SPL)


# --- entry modes and orders ----------------------------------------------------------------------------

_ENTRY_SQL = f"""{TOUCH},{NORM_SQL % 'tw'},{RSI_SIMPLE.replace('FROM bars', 'FROM ns')},{bands_sql('rs3', (20,))},
en AS (SELECT *, {bb_pos(20)} AS pos20, abs((close - ema_20) / norm_scale) AS zone, row_number() OVER ({W}) - 1 AS candle,
  count(*) OVER (PARTITION BY symbol, year) AS nc FROM (SELECT * EXCLUDE (rn, pos) FROM bb)),
eo AS (SELECT *, (first_touch_ma20 = 1 OR close_cross_ma20 = 1 OR coalesce(zone <= 0.35, false)) AS near FROM en)"""
_ENTRY = {
    "signal_any": "true",
    "ma20_zone": "near",
    "ma20_confirm": "near AND strong_body_confirm = 1",
    "bb_reversion": "(sig_dir = 1 AND pos20 < 0.25 AND rsi_simple < 48) OR (sig_dir = -1 AND pos20 > 0.75 AND rsi_simple > 52)",
    "trend_pullback": "zone <= 0.55 AND strong_body_confirm = 1",
}


@query(
    "entry_modes",
    f"""WITH RECURSIVE {_ENTRY_SQL} SELECT symbol, ts, {', '.join(f"coalesce(cycle_phase >= {p} AND ({c}), false)::INTEGER AS {m}_{p}" for m, c in _ENTRY.items() for p in (0, 1))}
      FROM eo WHERE candle >= 250 AND candle < nc - 2""",
)
def entry_modes(spark, sf_dir):
    df = cycles.add_cycle_touch(cycles.add_signal_cycle(_smooth(spark, sf_dir)))
    df = ind.add_bollinger(ind.add_rsi_simple(ind.add_norm_scale(df)))
    df = with_candle(df.withColumn("price_zone_ma20_r", safe_div(F.col("close") - F.col("ema_20"), "norm_scale")))
    flags = [signals.entry_mode(m, p).cast("int").alias(f"{m}_{p}") for m in signals.ENTRY_MODES for p in (0, 1)]
    return df.filter(signals.away_from_ends()).select("symbol", "ts", *flags)


_BBE_SQL = f"""{BARS},{NORM_SQL % 'bars'},{v2_sql((20, 50), 100, 20)},
{runs_sql('v2', 'bb20_reversion_raw', 'h1', 'rv')},{runs_sql('h1', dir_sql('close', 'bb20_mid'), 'h2', 'md')},
{touch_sql('h2', 'bb20_mid', 'h3', 'md', 'mft', 'mtc')}"""
_UP, _DN = "rv_dir = 1", "rv_dir = -1"
_BBE = {
    "bb_any": "true",
    "mid_cycle_start": "rv_bar <= 3",
    "mid_cycle_4_10": "rv_bar BETWEEN 4 AND 10",
    "mid_cycle_11_30": "rv_bar BETWEEN 11 AND 30",
    "first_mid_touch": "mft = 1",
    "pullback_mid": "rv_bar BETWEEN 3 AND 30 AND mtc >= 1 AND bb20_pos BETWEEN 0.35 AND 0.65",
    "lower_reversion": "bb20_pos <= 0.20 AND bb20_z <= -0.8",
    "upper_reversion": "bb20_pos >= 0.80 AND bb20_z >= 0.8",
    "outer_reversion": f"({_UP} AND bb20_pos <= 0.25) OR ({_DN} AND bb20_pos >= 0.75)",
    "squeeze_breakout": f"bb20_width_rank <= 0.35 AND (({_UP} AND bb20_pos >= 0.70) OR ({_DN} AND bb20_pos <= 0.30))",
    "bb20_bb50_agree": f"({_UP} AND bb50_pos >= 0.50) OR ({_DN} AND bb50_pos <= 0.50)",
}


@query(
    "bb_entry_modes",
    f"WITH {_BBE_SQL} SELECT symbol, ts, {', '.join(f'coalesce({c}, false)::INTEGER AS {m}' for m, c in _BBE.items())} FROM h3",
)
def bb_entry_modes(spark, sf_dir):
    df = ind.add_bb_family_v2(ind.add_norm_scale(bars(spark, sf_dir)), (20, 50), 100, 20)
    df = cycles.add_cycle_columns(df, "bb20_reversion", "bb20_mid", signal="bb20_reversion_raw")
    df = cycles.add_cycle_columns(df, "bb20_mid", "bb20_mid", line="bb20_mid")
    flags = [
        signals.bb_entry_mode(m, 20, "bb20_reversion_signal_dir", "bb20_reversion_bar", slow=50).cast("int").alias(m)
        for m in signals.BB_ENTRY_MODES
    ]
    return df.select("symbol", "ts", *flags)


@query(
    "orders_from_scores",
    f"WITH {SCORED} SELECT l_orderkey, l_linenumber, ts, score, (score >= 0.55 AND buy_signal = 1 AND session = 1)::INTEGER AS \"order\" FROM scored",
)
def orders_from_scores(spark, sf_dir):
    order = signals.order_from_score("score", 0.55, "session")
    return scored(spark, sf_dir).select("l_orderkey", "l_linenumber", "ts", "score", order.alias("order"))


@query(
    "orders_two_sided",
    f"""WITH {SCORED}, t AS (SELECT *, CASE WHEN session = 1 THEN 1 ELSE -1 END AS s FROM scored)
      SELECT l_orderkey, l_linenumber, ts, {', '.join(
        f"CASE WHEN '{m}' <> 'sell_only' AND buy_signal = 1 AND s = 1 AND score >= 0.54 THEN 1 WHEN '{m}' <> 'buy_only' AND buy_signal = 1 AND s = -1 AND score_b >= 0.52 THEN -1 ELSE 0 END AS {m}"
        for m in ('both', 'buy_only', 'sell_only'))} FROM t""",
)
def orders_two_sided(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("s", F.when(F.col("session") == 1, 1).otherwise(-1))
    modes = [
        signals.two_sided_order(F.col("buy_signal") == 1, "s", "score", "score_b", 0.54, 0.52, m).alias(m)
        for m in ("both", "buy_only", "sell_only")
    ]
    return df.select("l_orderkey", "l_linenumber", "ts", *modes)


@query(
    "order_levels",
    f"""WITH {BARS}, d AS (SELECT *, sign(open - close)::INTEGER AS o, lead(open) OVER ({W}) AS e FROM bars)
      SELECT symbol, ts, o AS "order", {r('e', 'entry', 5)}, {r('e - o * 6.0', 'sl', 5)}, {r('e + o * 9.0', 'tp', 5)}, 'market' AS type,
      CASE WHEN o = 1 THEN 'buy' ELSE 'sell' END AS side FROM d WHERE o <> 0 AND e IS NOT NULL""",
)
def order_levels(spark, sf_dir):
    """Orders against each bar's direction."""
    df = bars(spark, sf_dir).withColumn("order", F.signum(F.col("open") - F.col("close")).cast("int"))
    out = signals.add_order_levels(df, r1=6.0, rr=1.5)
    return out.select("symbol", "ts", "order", "entry", "sl", "tp", "type", "side")
