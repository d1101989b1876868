"""Queries for labels, candidates, samples, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import labels, sampling, thresholds
from barloom.plans.common import BARS, FEATURES, HORIZON, R1, SCORED, SPLITS, W, bars, query, r, scored, show
from barloom.plans.cycle_queries import SIGNALS_SQL, day_split, lab_sql, signalled
from barloom.plans.window_queries import KEYS

_LAB = ["label", "label_res", "entry_index", "entry_price"]


@query("first_touch_label", f"WITH {BARS},{lab_sql('bars')} SELECT symbol, ts, label, label_res, entry_index, {r('entry_price', 'entry_price', 2)} FROM lab")
def first_touch_label(spark, sf_dir):
    df = labels.buy_labels(bars(spark, sf_dir), R1, HORIZON)
    return show(df.withColumn("entry_index", F.col("entry_index").cast("bigint")), KEYS, _LAB, 2)


def _two_sql(horizon: int, skip: int, r1: float = R1) -> str:
    lv = int(r1 * 100)
    return f"""{BARS},
la AS (SELECT *, row_number() OVER ({W}) - 1 AS candle, count(*) OVER (PARTITION BY symbol, year) AS n, lead(open) OVER ({W}) AS nxt FROM bars),
lb AS (SELECT symbol, year, ts, candle, n, round(open * 100)::BIGINT AS po, round(high * 100)::BIGINT AS ph, round(low * 100)::BIGINT AS pl, round(close * 100)::BIGINT AS pc,
  CASE WHEN candle < n - 2 AND candle >= {skip} THEN round(nxt * 100)::BIGINT END AS e FROM la),
lc AS (SELECT x.symbol, x.year, x.candle, arg_min(CASE WHEN y.ph >= x.e + {lv} AND y.pl <= x.e - {lv} THEN CASE WHEN y.pc >= y.po THEN 1 ELSE -1 END
    WHEN y.ph >= x.e + {lv} THEN 1 ELSE -1 END, y.candle) AS v
  FROM lb x JOIN lb y ON x.symbol = y.symbol AND x.year = y.year AND y.candle > x.candle AND y.candle <= x.candle + {horizon}
    AND (y.ph >= x.e + {lv} OR y.pl <= x.e - {lv}) GROUP BY ALL),
two AS (SELECT lb.symbol, lb.year, lb.ts, coalesce(lc.v, 0)::INTEGER AS buy_label, (-coalesce(lc.v, 0))::INTEGER AS sell_label FROM lb LEFT JOIN lc USING (symbol, year, candle))"""


@query("two_sided_label", f"WITH {_two_sql(HORIZON, 250)} SELECT symbol, ts, buy_label, sell_label FROM two")
def two_sided_label(spark, sf_dir):
    return labels.two_sided_labels(bars(spark, sf_dir), R1, HORIZON).select("symbol", "ts", "buy_label", "sell_label")


@query("short_horizon_label", f"WITH {_two_sql(7, 250)} SELECT symbol, ts, buy_label, sell_label FROM two")
def short_horizon_label(spark, sf_dir):
    return labels.short_horizon_labels(bars(spark, sf_dir), R1).select("symbol", "ts", "buy_label", "sell_label")


_CAND = ["bb20_pos", "rsi_14", "ema_dist_55", "z_close_20"]


@query(
    "candidates",
    f"""WITH RECURSIVE {SIGNALS_SQL},{lab_sql('sg')} SELECT symbol, ts, label, {r('bb20_pos', 'bb20_pos', 5)}, {r('rsi_14', 'rsi_14', 5)}, {r('ed55', 'ema_dist_55', 5)}, {r('z20', 'z_close_20', 5)}
      FROM lab WHERE buy_signal = 1 AND label IS NOT NULL AND bb20_pos IS NOT NULL AND rsi_14 IS NOT NULL AND ed55 IS NOT NULL AND z20 IS NOT NULL AND year = 2024""",
)
def candidates(spark, sf_dir):
    df = labels.buy_labels(signalled(spark, sf_dir), R1, HORIZON)
    return show(labels.candidates(df, _CAND, [2024]), (*KEYS, "label"), _CAND, 5)


@query(
    "label_audit",
    f"""WITH RECURSIVE {SIGNALS_SQL},{lab_sql('sg')} SELECT symbol, year, count(*) AS rows, sum(buy_signal)::BIGINT AS buy_candidates, count(label) AS resolved,
      sum((label = 1)::INT)::BIGINT AS wins, sum((label = 0)::INT)::BIGINT AS losses, round(sum((label = 1)::INT) * 100.0 / count(label), 4)::DOUBLE AS resolved_wr_pct FROM lab GROUP BY symbol, year""",
)
def label_audit(spark, sf_dir):
    return thresholds.label_audit(labels.buy_labels(signalled(spark, sf_dir), R1, HORIZON), ("symbol", "year"))


@query(
    "leakage_checks",
    f"""WITH {BARS}, s AS (SELECT ts, CASE WHEN day(ts) <= 20 THEN 'train' WHEN day(ts) <= 25 THEN 'valid' ELSE 'test' END AS split FROM bars),
      m AS (SELECT max(CASE WHEN split = 'train' THEN ts END) < min(CASE WHEN split = 'valid' THEN ts END) AS a,
        max(CASE WHEN split = 'valid' THEN ts END) < min(CASE WHEN split = 'test' THEN ts END) AS b FROM s)
      SELECT 'no_forbidden_columns_in_features' AS "check", 1 AS ok UNION ALL SELECT 'no_future_name_suspects', 0 UNION ALL
      SELECT 'train_before_valid', a::INTEGER FROM m UNION ALL SELECT 'valid_before_test', b::INTEGER FROM m""",
)
def leakage_checks(spark, sf_dir):
    """One of the names checked is suspicious on purpose."""
    return thresholds.leakage_checks(day_split(bars(spark, sf_dir)), ["bb20_pos", "next_open_gap"])


# --- lineitem: splits, weights, samples, folds ---------------------------------------------------------

# The text hashed for sampling: integers only, so that both engines print it alike.
_HASH_KEYS = ["l_orderkey", "l_linenumber", "k_qty", "k_price", "k_ship"]
_KEYED = f"""keyed AS (SELECT year, label, l_orderkey, l_linenumber, l_quantity::BIGINT AS k_qty, round(l_extendedprice * 100)::BIGINT AS k_price, epoch(ts)::BIGINT AS k_ship FROM scored)"""


def _hash_sql(seed: int) -> str:
    return "md5(concat_ws('|', " + f"'{seed}', " + ", ".join(f"{k}::VARCHAR" for k in _HASH_KEYS) + "))"


def _keyed(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "year",
        "label",
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").cast("bigint").alias("k_qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("k_price"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("k_ship"),
    )


_KCOLS = "year, label, l_orderkey, l_linenumber, k_qty, k_price, k_ship"


@query(
    "balanced_sample",
    f"""WITH {SCORED},{_KEYED}, h AS (SELECT *, {_hash_sql(7)} AS h FROM keyed),
      y AS (SELECT *, row_number() OVER (PARTITION BY year, label ORDER BY h) AS rn, sum(label) OVER (PARTITION BY year) AS np, count(*) OVER (PARTITION BY year) AS na FROM h),
      p AS (SELECT {_KCOLS} FROM y WHERE na <= 1000 OR (label = 1 AND rn <= least(np, 500)) OR (label = 0 AND rn <= 1000 - least(np, 500))),
      h2 AS (SELECT *, {_hash_sql(8)} AS h FROM p),
      z AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS rn, sum(label) OVER () AS np, count(*) OVER () AS na FROM h2)
      SELECT {_KCOLS} FROM z WHERE na <= 4000 OR (label = 1 AND rn <= least(np, 2000)) OR (label = 0 AND rn <= 4000 - least(np, 2000))""",
)
def balanced_sample(spark, sf_dir):
    """Two levels: at most 1000 rows per year, then 4000 in all, half per class."""
    per_year = sampling.balanced_sample(_keyed(spark, sf_dir), 1000, by=("year",), seed=7, keys=_HASH_KEYS)
    return sampling.balanced_sample(per_year, 4000, seed=8, keys=_HASH_KEYS)


@query(
    "uniform_sample",
    f"WITH {SCORED},{_KEYED}, h AS (SELECT *, row_number() OVER (ORDER BY {_hash_sql(3)}) AS rn FROM keyed) SELECT {_KCOLS} FROM h WHERE rn <= 5000",
)
def uniform_sample(spark, sf_dir):
    return sampling.sample_n(_keyed(spark, sf_dir), 5000, seed=3, keys=_HASH_KEYS)


_ORDER = ["k_ship", "l_orderkey", "l_linenumber", "k_qty", "k_price"]


@query(
    "ordered_thin",
    f"""WITH {SCORED},{_KEYED}, n AS (SELECT *, row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1 AS pos, count(*) OVER () AS n FROM keyed),
      want AS (SELECT (i * (n.n - 1)) // 999 AS pos FROM range(1000) t(i), (SELECT count(*) AS n FROM keyed) n)
      SELECT {_KCOLS} FROM n WHERE pos IN (FROM want)""",
)
def ordered_thin(spark, sf_dir):
    return sampling.ordered_thin(_keyed(spark, sf_dir), 1000, _ORDER)


@query(
    "year_split",
    f"WITH {SCORED} SELECT split, year, count(*) AS rows, {r('avg(label)', 'positive_rate')} FROM scored GROUP BY split, year",
)
def year_split(spark, sf_dir):
    df = sampling.year_split(scored(spark, sf_dir), SPLITS)
    out = df.groupBy("split", "year").agg(F.count(F.lit(1)).alias("rows"), F.avg("label").alias("positive_rate"))
    return show(out, ("split", "year"), ("rows", "positive_rate"))


@query(
    "ts_folds",
    f"""WITH {SCORED},{_KEYED}, n AS (SELECT *, row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1 AS pos, count(*) OVER () AS n FROM keyed),
      f AS (SELECT n.*, fold, n - (3 - fold) * (n // 4) AS start FROM n, range(3) t(fold))
      SELECT fold::INTEGER AS fold, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role, count(*) AS rows, sum(label)::BIGINT AS positives, min(k_ship) AS first_ship, max(k_ship) AS last_ship
      FROM f WHERE pos < start + n // 4 GROUP BY ALL""",
)
def ts_folds(spark, sf_dir):
    df = sampling.ts_folds(_keyed(spark, sf_dir), 3, _ORDER)
    return df.groupBy("fold", "role").agg(
        F.sum("copies").alias("rows"), F.sum(F.col("label") * F.col("copies")).alias("positives"),
        F.min("k_ship").alias("first_ship"), F.max("k_ship").alias("last_ship"),
    )


@query(
    "strat_folds",
    f"""WITH {SCORED},{_KEYED}, c AS (SELECT label, count(*) AS n, min(({', '.join(_ORDER)}, label)) AS f FROM keyed GROUP BY label),
      o AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at FROM c),
      s AS (SELECT label, fold, (SELECT count(*) FROM range(start_at, start_at + n) g(p) WHERE p % 5 = fold) AS size FROM o, range(5) t(fold)),
      b AS (SELECT label, fold, sum(size) OVER (PARTITION BY label ORDER BY fold) - size AS lo, sum(size) OVER (PARTITION BY label ORDER BY fold) AS hi FROM s),
      n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {', '.join(_ORDER)}) - 1 AS pos FROM keyed)
      SELECT n.label, fold::INTEGER AS fold, count(*) AS rows, min(k_ship) AS first_ship, max(k_ship) AS last_ship FROM n JOIN b ON n.label = b.label AND pos >= lo AND pos < hi GROUP BY ALL""",
)
def strat_folds(spark, sf_dir):
    df = sampling.strat_folds(_keyed(spark, sf_dir), 5, "label", _ORDER)
    return df.groupBy("label", "fold").agg(
        F.sum("copies").alias("rows"), F.min("k_ship").alias("first_ship"), F.max("k_ship").alias("last_ship")
    )


@query(
    "class_weights",
    f"WITH {SCORED} SELECT label, count(*) AS rows, {r('(SELECT count(*) FROM scored) / (2.0 * count(*))', 'weight')} FROM scored GROUP BY label",
)
def class_weights(spark, sf_dir):
    return show(sampling.class_weights(scored(spark, sf_dir)), ("label", "rows"), ("weight",))


@query(
    "side_dataset",
    f"""WITH t AS (SELECT year(l_shipdate)::INTEGER AS year, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS lab,
        CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS sig FROM lineitem)
      SELECT year, count(*) AS rows, sum((lab = 1)::INT)::BIGINT AS wins, {r('min(CASE year WHEN 1995 THEN 0.5 WHEN 1996 THEN 0.75 WHEN 1997 THEN 1.0 WHEN 1998 THEN 1.25 WHEN 1999 THEN 1.5 END)::DOUBLE', 'weight')}
      FROM t WHERE year BETWEEN 1995 AND 1999 AND lab <> 0 AND sig = 1 GROUP BY year""",
)
def side_dataset(spark, sf_dir):
    df = two_sided_rows(spark, sf_dir)
    out = labels.side_rows(df, "won", "side", 1, list(FEATURES), [1995, 1996, 1997, 1998, 1999])
    return out.groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("y").cast("bigint")).alias("wins"), F.min("weight").alias("weight")
    )


def two_sided_rows(spark, sf_dir):
    """Lines as two-sided candidates: side from the line status, +1 / -1 / 0 from the return flag."""
    from barloom.plans.common import load

    base = scored(spark, sf_dir)
    flag = load(spark, sf_dir, "lineitem")
    won = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)
    side = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    qty = F.col("l_quantity").cast("int")
    disc, tax = F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    return flag.select(
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        (F.col("l_suppkey") % 24).cast("int").alias("hour"),
        (F.col("l_linenumber") % 3).cast("int").alias("phase"),
        "l_linenumber",
        side.alias("side"),
        won.alias("won"),
        *FEATURES,
        ((3500 + 150 * disc + 100 * tax + 20 * qty) / 10000.0).alias("score"),
        ((3400 + 100 * disc + 150 * tax + 22 * qty) / 10000.0).alias("score_b"),
    )
