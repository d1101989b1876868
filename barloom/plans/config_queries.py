"""Queries for configuration sweeps, on the lines as two-sided candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import configs
from barloom.plans.common import query
from barloom.plans.label_queries import two_sided_rows
from barloom.session import materialise

BUY = (0.50, 0.54, 0.58)
SELL = (0.48, 0.52, 0.56)
GROUPS = {"blend_a": ("score", "score_b"), "blend_b": ("score_b", "score")}
MODES = ("signal_any", "early_line", "small_lot")
PHASES = (0, 1)
SIDES = ("both", "buy_only", "sell_only")
SESSIONS = ("all", "active", "ny", "h1_active")
YEARS = (1995, 1996, 1997, 1998)
KEYS = configs.KEYS


def grid(spark):
    return configs.config_grid(spark, list(GROUPS), BUY, SELL, MODES, PHASES, SIDES, SESSIONS)


def per_year(spark, sf_dir):
    modes = {"signal_any": F.lit(True), "early_line": F.col("l_linenumber") <= 2, "small_lot": F.col("l_quantity") <= 20}
    folded = configs.fold_rows(two_sided_rows(spark, sf_dir), GROUPS, modes, BUY, SELL)
    return configs.evaluate_configs(folded, grid(spark), YEARS, BUY, SELL, MODES, PHASES, SESSIONS)


def summary(spark, sf_dir):
    return configs.config_summary(per_year(spark, sf_dir))


def _vals(name: str, values) -> str:
    cells = ", ".join(f"('{v}')" if isinstance(v, str) else f"({v}::DOUBLE)" if isinstance(v, float) else f"({v}::INTEGER)" for v in values)
    return f"(VALUES {cells}) v_{name}({name})"


_GRID_SQL = f"""grid AS (SELECT * FROM {_vals('grp', GROUPS)}, {_vals('buy_threshold', BUY)}, {_vals('sell_threshold', SELL)}, {_vals('entry_mode', MODES)},
  {_vals('min_phase', PHASES)}, {_vals('side_mode', SIDES)}, (VALUES ('all', 0, 23, 12), ('active', 7, 22, 12), ('ny', 13, 22, 12), ('h1_active', 7, 22, 6)) s(session_mode, h0, h1, lastm))"""
# Every configuration meets every candidate row of its side, as the sweep is defined. Rows are folded first only
# to keep the check itself affordable; the folding keeps every distinct combination a configuration can tell apart.
_ROWS_SQL = """raw_ AS (SELECT year(l_shipdate)::INTEGER AS year, month(l_shipdate) AS mon, l_suppkey % 24 AS hr, l_linenumber % 3 AS phase,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS side, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS won,
  l_linenumber <= 2 AS early, l_quantity <= 20 AS small,
  (3500 + 150 * round(l_discount * 100)::INTEGER + 100 * round(l_tax * 100)::INTEGER + 20 * l_quantity::INTEGER) / 10000.0::DOUBLE AS sa,
  (3400 + 100 * round(l_discount * 100)::INTEGER + 150 * round(l_tax * 100)::INTEGER + 22 * l_quantity::INTEGER) / 10000.0::DOUBLE AS sb FROM lineitem WHERE year(l_shipdate) <= 1998),
cand AS (SELECT 'blend_a' AS grp, year, mon, hr, phase, side, early, small, CASE WHEN side = 1 THEN sa ELSE sb END AS sc, won FROM raw_
  UNION ALL SELECT 'blend_b', year, mon, hr, phase, side, early, small, CASE WHEN side = 1 THEN sb ELSE sa END, won FROM raw_),
rows_ AS (SELECT grp, year, mon <= 6 AS h1, hr, phase, side, early, small, CASE WHEN side = 1 THEN (sc >= 0.50)::INT + (sc >= 0.54)::INT + (sc >= 0.58)::INT
    ELSE (sc >= 0.48)::INT + (sc >= 0.52)::INT + (sc >= 0.56)::INT END AS lvl, count(*) AS n, sum((won = 1)::INT) AS w, sum((won = -1)::INT) AS l FROM cand GROUP BY ALL)"""
_PER_YEAR_SQL = f"""WITH {_GRID_SQL},{_ROWS_SQL}, yrs AS (SELECT unnest([1995, 1996, 1997, 1998])::INTEGER AS year),
py AS (SELECT g.grp, g.buy_threshold, g.sell_threshold, g.entry_mode, g.min_phase, g.side_mode, g.session_mode, y.year,
  coalesce(sum(r.n), 0)::BIGINT AS raw, coalesce(sum(r.w), 0)::BIGINT AS wins, coalesce(sum(r.l), 0)::BIGINT AS losses
  FROM grid g CROSS JOIN yrs y LEFT JOIN rows_ r ON r.grp = g.grp AND r.year = y.year AND r.phase >= g.min_phase AND r.hr BETWEEN g.h0 AND g.h1 AND (g.lastm = 12 OR r.h1)
    AND (g.entry_mode = 'signal_any' OR (g.entry_mode = 'early_line' AND r.early) OR (g.entry_mode = 'small_lot' AND r.small))
    AND ((r.side = 1 AND g.side_mode <> 'sell_only' AND r.lvl >= CASE g.buy_threshold WHEN 0.50 THEN 1 WHEN 0.54 THEN 2 ELSE 3 END)
      OR (r.side = -1 AND g.side_mode <> 'buy_only' AND r.lvl >= CASE g.sell_threshold WHEN 0.48 THEN 1 WHEN 0.52 THEN 2 ELSE 3 END))
  GROUP BY ALL),
pw AS (SELECT *, wins + losses AS resolved, (CASE WHEN wins + losses > 0 THEN round(wins * 100.0 / (wins + losses), 2) ELSE 0 END)::DOUBLE AS winrate FROM py)"""
_K = 'grp AS "group", buy_threshold, sell_threshold, entry_mode, min_phase, side_mode, session_mode'
_SUM_SQL = f"""{_PER_YEAR_SQL}, su AS (SELECT grp, buy_threshold, sell_threshold, entry_mode, min_phase, side_mode, session_mode, min(winrate) AS min_winrate, min(resolved) AS min_resolved,
  sum(resolved)::BIGINT AS total_resolved, sum(wins)::BIGINT AS total_wins, sum(losses)::BIGINT AS total_losses,
  (CASE WHEN sum(resolved) > 0 THEN round(sum(wins) * 100.0 / sum(resolved), 2) ELSE 0 END)::DOUBLE AS weighted_winrate FROM pw GROUP BY ALL)"""
_S = "min_winrate, min_resolved, total_resolved, total_wins, total_losses, weighted_winrate"
_ORDER = "min_winrate DESC, weighted_winrate DESC, min_resolved DESC, total_resolved DESC, grp, buy_threshold, sell_threshold, entry_mode, min_phase, side_mode, session_mode"


@query("config_proxy", f"{_PER_YEAR_SQL} SELECT {_K}, year, raw, wins, losses, resolved, winrate FROM pw")
def config_proxy(spark, sf_dir):
    return per_year(spark, sf_dir)


@query("config_summary", f"{_SUM_SQL} SELECT {_K}, {_S} FROM su")
def config_summary(spark, sf_dir):
    return summary(spark, sf_dir)


@query("config_grid", f"{_SUM_SQL} SELECT {_K}, total_resolved, weighted_winrate FROM su WHERE total_resolved > 0")
def config_grid(spark, sf_dir):
    """The grid's combinations that resolve anything."""
    out = summary(spark, sf_dir).filter("total_resolved > 0")
    return out.select(*KEYS, "total_resolved", "weighted_winrate")


@query("pending_configs", f"{_SUM_SQL} SELECT {_K} FROM su WHERE min_resolved < 10")
def pending_configs(spark, sf_dir):
    """Configurations left when those with volume in every year are done."""
    return configs.pending(grid(spark), summary(spark, sf_dir).filter("min_resolved >= 10"))


@query(
    "best_configs",
    f"""{_SUM_SQL}, t AS (SELECT *, CASE WHEN session_mode LIKE 'h1\\_%' ESCAPE '\\' AND min_resolved >= 20 AND min_winrate >= 55 THEN 0 WHEN min_resolved >= 40 AND min_winrate >= 55 THEN 1
      WHEN min_resolved >= 80 AND min_winrate >= 52 THEN 2 ELSE 3 END AS tier FROM su)
      SELECT {_K}, {_S} FROM t WHERE tier = (SELECT min(tier) FROM t) ORDER BY {_ORDER} LIMIT 10""",
)
def best_configs(spark, sf_dir):
    return configs.best_configs(summary(spark, sf_dir), configs.proxy_tiers(20, 40, 80, 55.0, 52.0), 10)


@query(
    "diversified_topk",
    f"""{_SUM_SQL}, t AS (SELECT *, CASE WHEN min_resolved >= 20 AND min_winrate >= 45 AND min_resolved >= 60 THEN 0 WHEN min_resolved >= 20 AND min_winrate >= 45 THEN 1 WHEN min_resolved >= 20 THEN 2 ELSE 3 END AS tier FROM su),
      e AS (SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t)),
      p AS (SELECT * FROM e WHERE min_resolved <= 2000 OR NOT EXISTS (SELECT 1 FROM e WHERE min_resolved <= 2000)),
      o AS (SELECT *, row_number() OVER (ORDER BY {_ORDER.replace('total_resolved DESC, ', '')}) AS rk FROM p),
      f AS (SELECT *, (row_number() OVER (PARTITION BY grp, entry_mode, side_mode, session_mode ORDER BY rk) = 1)::INTEGER AS lead_ FROM o),
      k AS (SELECT *, coalesce(sum(lead_) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM f),
      d AS (SELECT *, (row_number() OVER (ORDER BY rk))::INTEGER AS place FROM k WHERE lead_ = 1 OR seen >= 10)
      SELECT {_K}, {_S}, place FROM d WHERE place <= 20""",
)
def diversified_topk(spark, sf_dir):
    eligible = configs.band_eligible(materialise(summary(spark, sf_dir)), 20, 60, 2000, 45.0)
    return configs.diversified_topk(eligible, ("group", "entry_mode", "side_mode", "session_mode"), 20)
