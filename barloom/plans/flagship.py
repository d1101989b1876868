"""The whole chain in one query: events, bars, features, signal, first-touch label, score, threshold table."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import labels, thresholds
from barloom.operators import indicators as ind
from barloom.plans.common import BARS, HORIZON, R1, bands_sql, bars, bb_pos, query
from barloom.plans.cycle_queries import lab_sql
from barloom.plans.indicator_queries import RSI_SIMPLE

GRID = (0.3, 0.5, 0.7, 0.9)


@query(
    "flagship",
    f"""WITH {BARS},{RSI_SIMPLE},{bands_sql('rs3', (20,))},
      s AS (SELECT *, round(1 - least(greatest({bb_pos(20)}, 0), 1), 6) AS score, ({bb_pos(20)} < 0.5 AND rsi_simple < 60)::INTEGER AS buy_signal FROM bb),
      {lab_sql('s')}, c AS (SELECT * FROM lab WHERE buy_signal = 1 AND label IS NOT NULL)
      SELECT g.threshold, k.symbol, count(c.label) AS resolved, coalesce(sum(c.label), 0)::BIGINT AS wins, coalesce(sum(1 - c.label), 0)::BIGINT AS losses,
        (CASE WHEN count(c.label) > 0 THEN round(sum(c.label) * 100.0 / count(c.label), 4) ELSE 0 END)::DOUBLE AS winrate
      FROM (VALUES {', '.join(f'({t}::DOUBLE)' for t in GRID)}) g(threshold) CROSS JOIN (SELECT DISTINCT symbol FROM bars) k
      LEFT JOIN c ON c.symbol = k.symbol AND c.score >= g.threshold GROUP BY ALL""",
)
def flagship(spark, sf_dir):
    df = ind.add_bollinger(ind.add_rsi_simple(bars(spark, sf_dir)))
    pos = F.col("bb20_pos")
    df = df.select(
        "symbol", "year", "ts", "open", "high", "low", "close",
        F.round(1.0 - F.when(pos.isNotNull(), F.least(F.greatest(pos, F.lit(0.0)), F.lit(1.0))), 6).alias("score"),
        F.coalesce((pos < 0.5) & (F.col("rsi_simple") < 60), F.lit(False)).cast("int").alias("buy_signal"),
    )
    lab = labels.buy_labels(df, R1, HORIZON)
    out = thresholds.threshold_table(lab, GRID, by=("symbol",), allowed=F.col("buy_signal") == 1)
    return out.select("threshold", "symbol", "resolved", "wins", "losses", "winrate")
