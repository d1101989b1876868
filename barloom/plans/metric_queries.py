"""Queries for probability metrics, thresholds and objectives, on the scored lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import metrics, thresholds
from barloom.operators.sampling import year_split
from barloom.plans.common import SCORED, SPLITS, query, r, rs, scored, show

GRID = thresholds.GRID


def split_rows(spark, sf_dir):
    return year_split(scored(spark, sf_dir), SPLITS)


# Positions by score within a split, ties halved: the rank-sum form of the AUC.
_RANKS = f"""WITH {SCORED},
rk AS (SELECT split, score, label, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0 AS rk FROM scored),
m AS (SELECT split, count(*) AS samples, avg(label) AS positive_rate, avg((score >= 0.5)::INT) AS pred_positive_rate, avg(((score >= 0.5)::INT = label)::INT) AS accuracy,
  (sum(CASE WHEN label = 1 THEN rk END)::DOUBLE - sum(label)::DOUBLE * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * sum(1 - label)) AS auc,
  avg((label - score) * (label - score)) AS brier, -avg(CASE WHEN label = 1 THEN ln(score) ELSE ln(1 - score) END) AS logloss FROM rk GROUP BY split)"""
_PM = ["positive_rate", "pred_positive_rate", "accuracy", "auc", "brier", "logloss"]


@query("prob_metrics", f"{_RANKS} SELECT split, samples, {rs(_PM)} FROM m")
def prob_metrics(spark, sf_dir):
    return show(metrics.prob_metrics(split_rows(spark, sf_dir), ["split"]), ("split", "samples"), _PM)


_CUM = f"""WITH {SCORED}, d AS (SELECT split, score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER (PARTITION BY split) AS an, sum(pos) OVER (PARTITION BY split) AS ap FROM d
  WINDOW w AS (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query("avg_precision", f"{_CUM} SELECT split, {r('sum(pos::DOUBLE / ap * cp / cn)', 'avg_precision')} FROM c GROUP BY split")
def avg_precision(spark, sf_dir):
    return show(metrics.avg_precision(split_rows(spark, sf_dir), ["split"]), ("split",), ("avg_precision",))


_PD = ["prob_mean", "prob_std", "prob_p50", "prob_p90", "prob_p95", "prob_p99"]


@query(
    "prob_distribution",
    f"""WITH {SCORED} SELECT split, {r('avg(score)', 'prob_mean')}, {r('stddev_pop(score)', 'prob_std')},
      {', '.join(r(f'quantile_cont(score, {q})', f'prob_p{p}') for q, p in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))} FROM scored GROUP BY split""",
)
def prob_distribution(spark, sf_dir):
    return show(metrics.prob_distribution(split_rows(spark, sf_dir), ["split"]), ("split",), _PD)


@query(
    "roc_points",
    f"""{_CUM} SELECT split, score AS threshold, {r('(cn - cp)::DOUBLE / (an - ap)', 'fpr')}, {r('cp::DOUBLE / ap', 'tpr')} FROM c
      UNION ALL SELECT DISTINCT split, NULL, 0.0, 0.0 FROM d""",
)
def roc_points(spark, sf_dir):
    return show(metrics.roc_points(split_rows(spark, sf_dir), ["split"]), ("split", "threshold"), ("fpr", "tpr"))


@query(
    "pr_points",
    f"""{_CUM} SELECT split, score AS threshold, {r('cp::DOUBLE / ap', 'recall')}, {r('cp::DOUBLE / cn', 'precision')} FROM c
      UNION ALL SELECT DISTINCT split, NULL, 0.0, 1.0 FROM d""",
)
def pr_points(spark, sf_dir):
    return show(metrics.pr_points(split_rows(spark, sf_dir), ["split"]), ("split", "threshold"), ("recall", "precision"))


_EDGES = ", ".join(f"quantile_cont(score, {i / 10})" for i in range(11))


@query(
    "calibration",
    f"""WITH {SCORED}, e AS (SELECT split, list_distinct([{_EDGES}]) AS edges FROM scored GROUP BY split),
      b AS (SELECT s.split, score, label, greatest(len(list_filter(edges, lambda x: x < score)), 1)::INTEGER AS bin FROM scored s JOIN e USING (split))
      SELECT split, bin, count(*) AS rows, {r('avg(score)', 'mean_score')}, {r('avg(label)', 'observed_rate')} FROM b GROUP BY split, bin""",
)
def calibration(spark, sf_dir):
    out = metrics.calibration(split_rows(spark, sf_dir), ["split"])
    return show(out, ("split", "bin", "rows"), ("mean_score", "observed_rate"))


@query(
    "confusion",
    f"""WITH {SCORED}, k AS (SELECT split, label, pred FROM (SELECT DISTINCT split FROM scored), range(2) a(label), range(2) b(pred))
      SELECT k.split, k.label::INTEGER AS label, k.pred::INTEGER AS pred, count(s.score) AS rows FROM k LEFT JOIN scored s
      ON s.split = k.split AND s.label = k.label AND (s.score >= 0.6)::INT = k.pred GROUP BY ALL""",
)
def confusion(spark, sf_dir):
    return metrics.confusion(split_rows(spark, sf_dir), 0.6, ["split"])


@query(
    "score_hist",
    f"""WITH {SCORED}, m AS (SELECT min(score) AS lo, max(score) AS hi FROM scored)
      SELECT label, least(floor((score - lo) / (hi - lo) * 40) + 1, 40)::INTEGER AS bin, count(*) AS rows FROM scored, m GROUP BY ALL""",
)
def score_hist(spark, sf_dir):
    return metrics.score_hist(scored(spark, sf_dir), 40)


# --- thresholds ----------------------------------------------------------------------------------------

_GRID_SQL = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in GRID) + ") g(threshold)"


def _curve_sql(score: str = "score", name: str = "curve", cond: str = "buy_signal = 1 AND session = 1") -> str:
    return f"""{name} AS (SELECT g.threshold, y.year, count(s.label) AS resolved, coalesce(sum(s.label), 0)::BIGINT AS wins, coalesce(sum(1 - s.label), 0)::BIGINT AS losses,
  CASE WHEN count(s.label) > 0 THEN round(sum(s.label) * 100.0 / count(s.label), 4) ELSE 0.0 END::DOUBLE AS winrate
  FROM {_GRID_SQL} CROSS JOIN (SELECT DISTINCT year FROM scored) y LEFT JOIN scored s ON s.year = y.year AND s.{score} >= g.threshold AND {cond} GROUP BY ALL)"""


def curve(spark, sf_dir, score: str = "score", thresholds_: tuple = GRID):
    ok = (F.col("buy_signal") == 1) & (F.col("session") == 1)
    return thresholds.threshold_table(scored(spark, sf_dir), thresholds_, score=score, allowed=ok)


_CC = ("threshold", "year", "resolved", "wins", "losses", "winrate")
CURVE = f"WITH {SCORED},{_curve_sql()}"


@query("threshold_table", f"{CURVE} SELECT {', '.join(_CC)} FROM curve")
def threshold_table(spark, sf_dir):
    return curve(spark, sf_dir).select(*_CC)


@query("session_table", f"WITH {SCORED},{_curve_sql('score', 'curve', 'session = 1')} SELECT {', '.join(_CC)} FROM curve")
def session_table(spark, sf_dir):
    return thresholds.threshold_table(scored(spark, sf_dir), GRID, allowed=F.col("session") == 1).select(*_CC)


_TOT = f"""tot AS (SELECT threshold, sum(resolved)::BIGINT AS resolved, sum(wins)::BIGINT AS wins, sum(losses)::BIGINT AS losses, min(resolved) AS min_year_deals,
  sum(wins) * 100.0 / nullif(sum(resolved), 0) AS winrate FROM curve GROUP BY threshold)"""
_TC = ("threshold", "resolved", "wins", "losses", "min_year_deals")


@query("threshold_totals", f"{CURVE},{_TOT} SELECT {', '.join(_TC)}, {r('winrate')} FROM tot")
def threshold_totals(spark, sf_dir):
    return show(thresholds.threshold_totals(curve(spark, sf_dir)), _TC, ("winrate",))


@query(
    "yearly_total",
    f"""{CURVE} SELECT coalesce(year::VARCHAR, 'TOTAL') AS year, sum(resolved)::BIGINT AS resolved, sum(wins)::BIGINT AS wins, sum(losses)::BIGINT AS losses, max(wins) AS max_wins,
      (CASE WHEN sum(resolved) > 0 THEN round(sum(wins) * 100.0 / sum(resolved), 4) ELSE 0 END)::DOUBLE AS winrate FROM curve WHERE threshold = 0.55 GROUP BY ROLLUP (year)""",
)
def yearly_total(spark, sf_dir):
    one = curve(spark, sf_dir, thresholds_=(0.55,)).withColumn("max_wins", F.col("wins"))
    return thresholds.yearly_total(one, ("resolved", "wins", "losses"), ("max_wins",)).select(
        "year", "resolved", "wins", "losses", "max_wins", "winrate"
    )


@query(
    "monthly_winrate",
    f"""WITH {SCORED} SELECT strftime(ts, '%Y-%m') AS month, count(*) FILTER (score >= 0.6) AS resolved, coalesce(sum(label) FILTER (score >= 0.6), 0)::BIGINT AS wins, 0.6::DOUBLE AS threshold,
      {r('CASE WHEN count(*) FILTER (score >= 0.6) > 0 THEN sum(label) FILTER (score >= 0.6) * 100.0 / count(*) FILTER (score >= 0.6) ELSE 0 END', 'winrate')} FROM scored GROUP BY month""",
)
def monthly_winrate(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return show(thresholds.win_table(df, ("month",), 0.6), ("month", "resolved", "wins", "threshold"), ("winrate",))


@query(
    "compare_curves",
    f"""WITH {SCORED},{_curve_sql('score', 'ca')},{_curve_sql('score_b', 'cb')},
      a AS (SELECT * FROM ca WHERE threshold <= 0.55), b AS (SELECT * FROM cb WHERE threshold >= 0.53)
      SELECT threshold, year, a.resolved AS resolved_a, b.resolved AS resolved_b, a.winrate AS winrate_a, b.winrate AS winrate_b,
      b.resolved - a.resolved AS resolved_diff, {r('b.winrate - a.winrate', 'winrate_diff', 4)} FROM a FULL JOIN b USING (threshold, year)""",
)
def compare_curves(spark, sf_dir):
    """Curves of the two scores over overlapping parts of the grid: unmatched steps stay."""
    a = curve(spark, sf_dir, "score", tuple(t for t in GRID if t <= 0.55))
    b = curve(spark, sf_dir, "score_b", tuple(t for t in GRID if t >= 0.53))
    out = thresholds.compare_curves(a, b)
    return show(out, ("threshold", "year"), ("resolved_a", "resolved_b", "winrate_a", "winrate_b", "resolved_diff", "winrate_diff"), 4)


def _totals(spark, sf_dir):
    return thresholds.threshold_totals(curve(spark, sf_dir))


# Bounds are set to the volumes of the test tables; the rules are the same.
_BOUNDS = {"a": (2200, None, None), "b": (1000, 2500, 1800), "c": (500, None, 1500), "e": (500, None, 1200)}
_PICK = ("threshold", "resolved", "wins")


def _pick_sql(rule: str) -> str:
    lo, hi, goal = _BOUNDS[rule]
    weight = thresholds.CHOICES[rule][3]
    inside = f"resolved >= {lo}" + (f" AND resolved <= {hi}" if hi else "")
    score = "winrate" if goal is None else f"winrate - {weight} * abs(resolved - {goal}) / {float(goal)}"
    order = "score DESC NULLS LAST" + ("" if goal is None else ", winrate DESC NULLS LAST") + ", resolved DESC, threshold"
    return f"""{CURVE},{_TOT}, s AS (SELECT *, {score} AS score, ({inside}) AS inside FROM tot),
      v AS (SELECT * FROM s WHERE inside OR NOT EXISTS (SELECT 1 FROM s WHERE inside))
      SELECT threshold, resolved, wins, {r('winrate')}, {r('score')} FROM v ORDER BY {order} LIMIT 1"""


def _pick(rule: str):
    def run(spark, sf_dir):
        lo, hi, goal = _BOUNDS[rule]
        out = thresholds.pick_threshold(_totals(spark, sf_dir), rule, lowest=lo, highest=hi, target=goal)
        return show(out, _PICK, ("winrate", "score"))

    return run


for _rule in _BOUNDS:
    query(f"pick_threshold_{_rule}", _pick_sql(_rule))(_pick(_rule))


@query(
    "pick_threshold_d",
    f"""{CURVE},{_TOT}, s AS (SELECT *, CASE WHEN resolved >= 800 THEN winrate - abs(resolved - 1500) / 1500.0 END AS score FROM tot),
      el AS (SELECT * FROM s WHERE resolved >= 800), bo AS (SELECT * FROM el WHERE resolved <= 2600),
      v AS (SELECT *, 1 AS o FROM bo UNION ALL SELECT *, 2 FROM el WHERE NOT EXISTS (SELECT 1 FROM bo) UNION ALL SELECT *, 3 FROM s WHERE NOT EXISTS (SELECT 1 FROM el))
      SELECT threshold, resolved, wins, {r('winrate')}, {r('score')} FROM v ORDER BY o, score DESC NULLS LAST, winrate DESC NULLS LAST, threshold LIMIT 1""",
)
def pick_threshold_d(spark, sf_dir):
    return show(thresholds.pick_threshold_guarded(_totals(spark, sf_dir), 800, 1500, 2600), _PICK, ("winrate", "score"))


@query(
    "totals_at_threshold",
    f"""{CURVE} SELECT sum(resolved)::BIGINT AS resolved, sum(wins)::BIGINT AS wins, sum(losses)::BIGINT AS losses, min(resolved) AS min_year_deals,
      (CASE WHEN sum(resolved) > 0 THEN round(sum(wins) * 100.0 / sum(resolved), 4) ELSE 0 END)::DOUBLE AS winrate FROM curve WHERE threshold = 0.56""",
)
def totals_at_threshold(spark, sf_dir):
    return thresholds.totals_at(curve(spark, sf_dir), 0.56)


_OBJ = [f"objective_{n}" for n in ("balanced", "volume", "stable", "edge", "guarded", "valid")]


def _run_sql(score: str) -> str:
    return f"""SELECT '{score}' AS run, c.*, t.threshold AS pick FROM c_{score} c, (
      SELECT threshold FROM (SELECT threshold, sum(resolved) AS rr, sum(wins) * 100.0 / nullif(sum(resolved), 0) AS wr FROM c_{score} GROUP BY threshold)
      ORDER BY (rr >= 2200) DESC, wr DESC NULLS LAST, rr DESC, threshold LIMIT 1) t"""


def _auc_sql(score: str) -> str:
    return f"""SELECT '{score}' AS run, (sum(CASE WHEN label = 1 THEN rk END)::DOUBLE - sum(label)::DOUBLE * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * sum(1 - label)) AS auc
      FROM (SELECT label, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk FROM scored)"""


@query(
    "run_objectives",
    f"""WITH {SCORED},{_curve_sql('score', 'c_score')},{_curve_sql('score_b', 'c_score_b')},
      runs AS ({_run_sql('score')} UNION ALL {_run_sql('score_b')}), aucs AS ({_auc_sql('score')} UNION ALL {_auc_sql('score_b')}),
      t AS (SELECT run, sum(resolved)::DOUBLE AS rs, sum(resolved)::BIGINT AS resolved, (CASE WHEN sum(resolved) > 0 THEN round(sum(wins) * 100.0 / sum(resolved), 4) ELSE 0 END)::DOUBLE AS wr,
        min(resolved)::DOUBLE AS m, stddev_samp(winrate) AS sd, min(winrate) AS mn, min(CASE WHEN winrate <> 0 THEN winrate END) AS mk,
        sum(CASE WHEN year IN (1999, 2000) THEN greatest(0, 3000 - resolved) END) AS s12, sum(CASE WHEN year = 2001 THEN greatest(0, 1200 - resolved) END) AS s3
        FROM runs WHERE threshold = pick GROUP BY run),
      o AS (SELECT t.*, auc, greatest(0, 1 - abs(rs - 8500) / 8500) AS near, -100 + rs / 3000 AS sparse, greatest(0, rs - 6500) / 6500 AS many, least(1, rs / 4200) AS fullv FROM t JOIN aucs USING (run))
      SELECT run, resolved, wr, {r('wr + 6 * near + 3 * least(1, m / 2500) + 2 * auc', 'objective_balanced', 5)},
        {r('wr + 4 * near + 2 * auc - 0.65 * sd - 1.25 * greatest(0, 54 - mn) - (0.0015 * s12 + 0.0005 * s3)', 'objective_volume', 5)},
        {r('wr + (auc - 0.5) * 100 - greatest(0, 7000 - rs) / 220 - greatest(0, rs - 12000) / 500 - greatest(0, 1000 - m) / 55 - greatest(0, 55 - coalesce(mk, 0)) * 1.15', 'objective_stable', 5)},
        {r('wr + 2 * least(1, rs / 7000) + 2 * auc - 0.45 * coalesce(sd, 10) - greatest(0, 1000 - m) / 300', 'objective_edge', 5)},
        {r('CASE WHEN rs < 3000 THEN sparse ELSE wr + 2 * auc + 2 * fullv - many END', 'objective_guarded', 5)},
        {r('CASE WHEN rs < 3000 THEN sparse ELSE wr + 2 * auc + 2 * fullv - many END', 'objective_valid', 5)} FROM o""",
)
def run_objectives(spark, sf_dir):
    """The two scores as two runs: each picks a threshold, then gets the six scores."""
    names = ("score", "score_b")

    def tagged(make):
        out = None
        for n in names:
            part = make(n).withColumn("run", F.lit(n))
            out = part if out is None else out.unionByName(part)
        return out

    curves = tagged(lambda n: curve(spark, sf_dir, n))
    chosen = thresholds.pick_threshold(thresholds.threshold_totals(curves, ("run",)), "a", by=("run",))
    rows = tagged(lambda n: scored(spark, sf_dir).select("label", F.col(n).alias("s")))
    auc = metrics.prob_metrics(rows, ["run"], "label", "s")
    out = thresholds.run_objectives(curves, auc, chosen, ("run",), (1999, 2000, 2001))
    return show(out, ("run", "resolved", "wr"), _OBJ, 5)
