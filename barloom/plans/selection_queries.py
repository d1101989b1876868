"""Queries for feature statistics, scaling, selection and drift, on the scored lines and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import candle_shape
from barloom.operators import scaling, selection, wide, signals, transforms
from barloom.plans.common import FEATURES, LONG, SCORED, SPLITS, bars, load, query, r, rs, scored, show
from barloom.plans.cycle_queries import SIGNALS_SQL
from barloom.plans.metric_queries import split_rows
from barloom.session import materialise, shared_folder, small_table
from barloom.sources import bars as src

FS = list(FEATURES)
_ID = ("l_orderkey", "l_linenumber", "ts")
_LS = f"WITH {SCORED},{LONG}"


@query(
    "robust_clip_scale",
    f"""{_LS}, q AS (SELECT feature, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM long WHERE split = 'train' GROUP BY feature),
      k AS (SELECT l.feature, lo, hi, least(greatest(value, lo), hi) AS v FROM long l JOIN q USING (feature) WHERE split = 'train'),
      s AS (SELECT feature, any_value(lo) AS lo, any_value(hi) AS hi, quantile_cont(v, 0.5) AS med, coalesce(nullif(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 0), 1) AS sc FROM k GROUP BY feature)
      SELECT l_orderkey, l_linenumber, ts, {', '.join(r(f"(least(greatest({f}, (SELECT lo FROM s WHERE feature = '{f}')), (SELECT hi FROM s WHERE feature = '{f}')) - (SELECT med FROM s WHERE feature = '{f}')) / (SELECT sc FROM s WHERE feature = '{f}')", f'{f}_scaled') for f in FS)} FROM scored""",
)
def robust_clip_scale(spark, sf_dir):
    """Fitted on the training years, applied to all rows."""
    df = scored(spark, sf_dir)
    stats = scaling.fit_robust(df.filter(F.col("year").isin(list(SPLITS["train"]))), FS)
    return show(scaling.apply_robust(df, stats, FS), _ID, [f"{f}_scaled" for f in FS])


@query(
    "standard_scale",
    f"""WITH {SCORED}, s AS (SELECT {', '.join(f'avg({f}) AS m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1) AS d_{f}' for f in FS)} FROM scored WHERE split = 'train')
      SELECT l_orderkey, l_linenumber, ts, {', '.join(r(f'({f} - m_{f}) / d_{f}', f'{f}_scaled', 5) for f in FS)} FROM scored, s""",
)
def standard_scale(spark, sf_dir):
    df = scored(spark, sf_dir)
    stats = scaling.fit_standard(df.filter(F.col("year").isin(list(SPLITS["train"]))), FS)
    return show(scaling.apply_standard(df, stats, FS), _ID, [f"{f}_scaled" for f in FS], 5)


def _with_flat(df):
    """One column that never changes and one that is often missing."""
    return df.withColumns(
        {"flat": F.lit(3.0), "sparse": F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))}
    )


_WIDE = [*FS, "flat", "sparse"]
_WIDE_SQL = f"wide AS (SELECT *, 3.0::DOUBLE AS flat, CASE WHEN l_linenumber = 1 THEN l_quantity END AS sparse FROM scored)"


@query(
    "constant_filter",
    f"WITH {SCORED},{_WIDE_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(DISTINCT coalesce({f}, 0)) AS nunique, {r(f'stddev_samp(coalesce({f}, 0))', 'std', 5)}, CASE WHEN count(DISTINCT coalesce({f}, 0)) > 1 AND stddev_samp(coalesce({f}, 0)) > 1e-12 THEN 'keep' ELSE 'constant' END AS status FROM wide"
        for f in _WIDE
    ),
)
def constant_filter(spark, sf_dir):
    return show(selection.constant_filter(_with_flat(scored(spark, sf_dir)), _WIDE), ("feature", "nunique"), ("std", "status"), 5)


def _corr_sql(x: str, y: str = "label") -> str:
    return f"CASE WHEN stddev_pop(coalesce({x}, 0)) <= 1e-12 THEN 0.0 ELSE corr(coalesce({x}, 0), {y}) END"


@query(
    "label_corr",
    f"WITH {SCORED},{_WIDE_SQL} "
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, {r(_corr_sql(f), 'label_corr')}, {r('abs(' + _corr_sql(f) + ')', 'abs_label_corr')} FROM wide WHERE split = 'train'" for f in _WIDE),
)
def label_corr(spark, sf_dir):
    df = _with_flat(split_rows(spark, sf_dir).filter("split = 'train'"))
    return show(selection.label_corr(df, _WIDE), ("feature",), ("label_corr", "abs_label_corr"))


_PAIRS = [(a, b) for i, a in enumerate([*FS, "sparse"]) for b in [*FS, "sparse"][i + 1 :]]


@query(
    "corr_matrix",
    f"WITH {SCORED},{_WIDE_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr(coalesce({a}, 0), coalesce({b}, 0))', 'corr')} FROM wide" for a, b in _PAIRS),
)
def corr_matrix(spark, sf_dir):
    out = selection.corr_matrix(_with_flat(scored(spark, sf_dir)), [*FS, "sparse"])
    return show(out, ("feature_a", "feature_b"), ("corr",))


def embedding_frame(spark, sf_dir):
    """Embedding elements as features, some nearly repeated, some missing by a rule, one known in few rows."""
    df = load(spark, sf_dir, "embeddings")
    dims = df.agg(F.max(F.size("embedding"))).first()[0] or 0
    cols = {f"e{i}": F.when((F.col("vec_id") + i) % 7 != 0, F.col("embedding")[i].cast("double")) for i in range(dims)}
    cols |= {f"near{i}": (F.col("embedding")[i] + F.col("embedding")[dims - 1] * 0.1).cast("double") for i in range(min(dims, 8))}
    cols["rare"] = F.when(F.col("vec_id") < 40, F.col("embedding")[0].cast("double"))
    return df.select("vec_id", (F.col("label") % 2).cast("int").alias("label"), *[c.alias(n) for n, c in cols.items()]), list(cols)


@query(
    "pair_corr",
    f"""WITH el AS (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings), v AS (
        SELECT vec_id, i AS at, 'e' || i AS feature, embedding[i + 1]::DOUBLE AS x FROM el WHERE (vec_id + i) % 7 <> 0
        UNION ALL SELECT vec_id, 1000 + i, 'near' || i, (embedding[i + 1] + embedding[-1] * 0.1::DOUBLE)::DOUBLE FROM el WHERE i < 8
        UNION ALL SELECT vec_id, 2000, 'rare', embedding[1]::DOUBLE FROM embeddings WHERE vec_id < 40),
      p AS (SELECT a.feature AS feature_a, b.feature AS feature_b, count(*) AS pairs, corr(a.x, b.x) AS c FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.at < b.at GROUP BY ALL)
      SELECT feature_a, feature_b, pairs, {r('CASE WHEN pairs < 50 THEN 0 ELSE c END', 'corr')} FROM p""",
)
def pair_corr(spark, sf_dir):
    """Correlation of every pair of features over the rows where both are known."""
    df, features = embedding_frame(spark, sf_dir)
    return show(wide.pair_correlations(df, features).filter("pairs > 0"), ("feature_a", "feature_b", "pairs"), ("corr",))


@query("corr_prune")
def corr_prune(spark, sf_dir):
    df, features = embedding_frame(spark, sf_dir)
    _, dropped = selection.corr_prune(df, features, 0.9, protected=["near0", "e1"])
    return dropped


@query("corr_forward")
def corr_forward(spark, sf_dir):
    df, features = embedding_frame(spark, sf_dir)
    kept = selection.corr_forward(df, features, 40, 0.9, force_tokens=("near0",))
    return small_table(spark, [(i, f) for i, f in enumerate(kept)], "position int, feature string")


_BIN = """
ed AS (SELECT feature, list_distinct([%s]) AS edges FROM long WHERE value IS NOT NULL GROUP BY feature),
bn AS (SELECT l.feature, l.label, l.value, greatest(len(list_filter(edges, lambda x: x < value)), 1) AS bin FROM long l JOIN ed USING (feature))""" % ", ".join(f"quantile_cont(value, {i / 10})" for i in range(11))
_MI = f"""{_LS},{_BIN}, cl AS (SELECT feature, bin, label, count(*) AS n FROM bn GROUP BY ALL),
mi AS (SELECT feature, sum(n / tn * ln(n * tn / (bnn * ln_))) AS mutual_info FROM (SELECT *, sum(n) OVER (PARTITION BY feature)::DOUBLE AS tn, sum(n) OVER (PARTITION BY feature, bin)::DOUBLE AS bnn,
  sum(n) OVER (PARTITION BY feature, label)::DOUBLE AS ln_ FROM cl) GROUP BY feature)"""


@query("binned_mi", f"{_MI} SELECT feature, {r('mutual_info', 'mutual_info', 8)} FROM mi")
def binned_mi(spark, sf_dir):
    return show(selection.binned_mi(scored(spark, sf_dir), FS), ("feature",), ("mutual_info",), 8)


_LIFT = f"""dl AS (SELECT feature, bin, count(*) AS count, avg(label) AS mean FROM bn GROUP BY ALL)"""


@query(
    "decile_lift",
    f"{_LS},{_BIN},{_LIFT} SELECT feature, (row_number() OVER (PARTITION BY feature ORDER BY bin))::INTEGER AS decile, count, {r('mean')} FROM dl",
)
def decile_lift(spark, sf_dir):
    return show(selection.decile_lift(scored(spark, sf_dir), FS), ("feature", "decile", "count"), ("mean",))


_CORRS = "co AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, label)) AS abs_label_corr FROM scored" for f in FS) + ")"
_METRICS = f"""{_MI},{_CORRS},{_LIFT}, sp AS (SELECT feature, max(mean) - min(mean) AS importance FROM dl GROUP BY feature),
met AS (SELECT * FROM co JOIN mi USING (feature) JOIN sp USING (feature))"""
_RANKED = f"""{_METRICS}, rk AS (SELECT *, {', '.join(f"rank() OVER (ORDER BY {m} DESC) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0 AS {m}_rank" for m in ('importance', 'abs_label_corr', 'mutual_info'))} FROM met)"""
_MS = ("importance", "abs_label_corr", "mutual_info")


def feature_scores(spark, sf_dir):
    """Three scores per feature: |corr with label|, mutual information, spread of the decile means."""
    df = scored(spark, sf_dir)
    cells = selection.label_bins(df, FS)
    spread = cells.groupBy("feature").agg((F.max("mean") - F.min("mean")).alias("importance"))
    corr = selection.label_corr(df, FS).select("feature", "abs_label_corr")
    return corr.join(selection.mi_of_bins(cells), "feature").join(spread, "feature")


@query(
    "preselect_rank",
    f"""{_RANKED}, c AS (SELECT *, ({' + '.join(f'{m}_rank' for m in _MS)}) / 3 AS combined_rank, (feature = 'l_tax')::INTEGER AS protected FROM rk)
      SELECT feature, {rs([f'{m}_rank' for m in _MS])}, {r('combined_rank')}, protected, (row_number() OVER (ORDER BY protected DESC, combined_rank, feature))::INTEGER AS position FROM c""",
)
def preselect_rank(spark, sf_dir):
    out = selection.preselect_rank(feature_scores(spark, sf_dir), _MS, ["l_tax"])
    return show(out, ("feature",), (*[f"{m}_rank" for m in _MS], "combined_rank", "protected", "position"))


@query(
    "selection_score",
    f"""{_METRICS}, o AS (SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS l1_rank, row_number() OVER (ORDER BY mutual_info DESC, feature) AS rf_rank,
        row_number() OVER (ORDER BY abs_label_corr DESC, feature) AS label_corr_rank FROM met),
      t AS (SELECT feature, CASE WHEN l1_rank <= 2 THEN l1_rank END::INTEGER AS featurewiz_rank, l1_rank::INTEGER AS l1_rank, CASE WHEN rf_rank <= 3 THEN rf_rank END::INTEGER AS rf_rank, label_corr_rank::INTEGER AS label_corr_rank FROM o)
      SELECT feature, featurewiz_rank, l1_rank, rf_rank, label_corr_rank, (feature = 'l_tax')::INTEGER AS protected,
        ((feature = 'l_tax')::INT * 1000 + greatest(0, 300 - coalesce(featurewiz_rank, 9999)) + greatest(0, 200 - coalesce(l1_rank, 9999)) + greatest(0, 200 - coalesce(rf_rank, 9999)) + greatest(0, 100 - coalesce(label_corr_rank, 9999)))::DOUBLE AS selection_score FROM t""",
)
def selection_score(spark, sf_dir):
    """Rank tables of different length, outer-joined."""
    from pyspark.sql import Window

    scores = materialise(feature_scores(spark, sf_dir))

    def ranks(metric: str, name: str, first: int):
        rank = F.row_number().over(Window.orderBy(F.desc(metric), "feature"))
        return scores.select("feature", rank.alias(name)).filter(F.col(name) <= first)

    tables = {
        "featurewiz_rank": ranks("importance", "featurewiz_rank", 2),
        "l1_rank": ranks("importance", "l1_rank", 99),
        "rf_rank": ranks("mutual_info", "rf_rank", 3),
        "label_corr_rank": ranks("abs_label_corr", "label_corr_rank", 99),
    }
    return selection.selection_score(tables, ["l_tax"])


@query(
    "signal_rank",
    f"""{_METRICS} SELECT feature, {r('abs_label_corr')}, {r('mutual_info', 'mutual_info', 8)},
      {r('(rank() OVER (ORDER BY abs_label_corr) + (count(*) OVER (PARTITION BY abs_label_corr) - 1) / 2.0) / count(*) OVER () + (rank() OVER (ORDER BY mutual_info) + (count(*) OVER (PARTITION BY mutual_info) - 1) / 2.0) / count(*) OVER ()', 'rank_score')} FROM met""",
)
def signal_rank(spark, sf_dir):
    df = scored(spark, sf_dir)
    out = selection.signal_rank(selection.label_corr(df, FS), selection.binned_mi(df, FS))
    return out.select(
        "feature", F.round("abs_label_corr", 6).alias("abs_label_corr"), F.round("mutual_info", 8).alias("mutual_info"), F.round("rank_score", 6).alias("rank_score")
    )


_RUNS = [*FS, "bb_qty"]
_IMP = "imp AS (" + " UNION ALL ".join(f"SELECT year AS run, '{f}' AS feature, abs(corr({'l_quantity' if f == 'bb_qty' else f}, label)) AS importance FROM scored GROUP BY year" for f in _RUNS) + ")"


def run_importance(spark, sf_dir):
    """Each year as a run: |corr with label| of every feature, one of them under an excluded name."""
    df = scored(spark, sf_dir).withColumn("bb_qty", F.col("l_quantity"))
    table = selection.label_corr(df, _RUNS, by=("year",))
    return table.select(F.col("year").alias("run"), "feature", F.col("abs_label_corr").alias("importance"))


_VOTES_SQL = f"""WITH {SCORED},{_IMP}, t AS (SELECT run, feature, importance, row_number() OVER (PARTITION BY run ORDER BY importance DESC, feature) AS rn FROM imp
        WHERE NOT regexp_matches(lower(feature), '^bb|^bband|_bb|boll') AND feature IN ('l_quantity', 'l_extendedprice', 'l_discount'))
      SELECT feature, count(*) AS votes, {r('max(importance)', 'max_importance')} FROM t WHERE rn = 1 GROUP BY feature"""


@query("importance_votes", _VOTES_SQL)
def importance_votes(spark, sf_dir):
    available = small_table(spark, [("l_quantity",), ("l_extendedprice",), ("l_discount",)], "feature string")
    out = selection.importance_votes(run_importance(spark, sf_dir), available)
    return show(out, ("feature", "votes"), ("max_importance",))


@query("importance_files", _VOTES_SQL)
def importance_files(spark, sf_dir):
    """The same votes from importance tables written as CSV files, one folder a run, and found by their header."""
    path = shared_folder(spark, "importance-files")
    table = run_importance(spark, sf_dir).withColumnRenamed("importance", "mean_abs_shap")
    table.select("run", "feature", "mean_abs_shap").write.partitionBy("run").option("header", True).csv(path)
    available = small_table(spark, [("l_quantity",), ("l_extendedprice",), ("l_discount",)], "feature string")
    out = selection.importance_votes(src.read_importances(spark, path), available)
    return show(out, ("feature", "votes"), ("max_importance",))


_CAT = [("l_quantity", "size"), ("l_extendedprice", "size"), ("l_discount", "terms"), ("l_tax", "terms"), ("bb_qty", "size")]


@query(
    "family_mass",
    f"""WITH {SCORED},{_IMP}, c AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _CAT)}) v(feature, family)),
      m AS (SELECT family, sum(importance) AS mass, count(DISTINCT feature) AS n_features FROM imp JOIN c USING (feature) GROUP BY family)
      SELECT family, n_features, {r('mass')}, {r('mass / sum(mass) OVER ()', 'share')} FROM m""",
)
def family_mass(spark, sf_dir):
    catalog = small_table(spark, _CAT, "feature string, family string")
    return show(selection.family_mass(run_importance(spark, sf_dir), catalog), ("family", "n_features"), ("mass", "share"))


@query(
    "feature_usage",
    f"""WITH {SCORED},{_IMP}, t AS (SELECT run, feature, row_number() OVER (PARTITION BY run ORDER BY importance DESC, feature) AS rn FROM imp)
      SELECT feature, count(DISTINCT run) AS models FROM t WHERE rn <= 3 GROUP BY feature""",
)
def feature_usage(spark, sf_dir):
    """Each year's three best features as a model's feature list."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "feature"))), 1, 3)
    models = run_importance(spark, sf_dir).groupBy(F.col("run").alias("model")).agg(best.alias("b"))
    return selection.feature_usage(models.select("model", F.col("b.feature").alias("features")))


@query(
    "feature_intersect",
    f"""WITH {SCORED},{_IMP}, t AS (SELECT run, feature, row_number() OVER (PARTITION BY run ORDER BY importance DESC, feature) AS rn FROM imp)
      SELECT feature FROM t WHERE run = 1995 AND rn <= 3 INTERSECT SELECT feature FROM t WHERE run = 1996 AND rn <= 3""",
)
def feature_intersect(spark, sf_dir):
    """Features among the three best of both 1995 and 1996."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("importance"), "feature"))
    best = run_importance(spark, sf_dir).withColumn("rn", rank).filter("rn <= 3")
    return best.filter("run = 1995").select("feature").join(best.filter("run = 1996"), "feature", "left_semi")


@query(
    "psi_drift",
    f"""{_LS}, cu AS (SELECT feature, list_sort(list_distinct([{', '.join(f"quantile_cont(value, {i / 10})" for i in range(11))}])) AS e FROM long WHERE split = 'train' GROUP BY feature),
      bi AS (SELECT l.feature, l.split, l.year, CASE WHEN value < e[1] OR value > e[-1] THEN NULL WHEN value = e[-1] THEN len(e) - 1 ELSE len(list_filter(e, lambda x: x <= value)) END AS bin FROM long l JOIN cu USING (feature)),
      ex AS (SELECT feature, bin, count(*) AS n FROM bi WHERE split = 'train' AND bin IS NOT NULL GROUP BY ALL),
      ac AS (SELECT feature, year, bin, count(*) AS n FROM bi WHERE bin IS NOT NULL GROUP BY ALL),
      y AS (SELECT DISTINCT feature, year FROM bi),
      f AS (SELECT y.feature, y.year, greatest(ex.n / sum(ex.n) OVER w, 1e-6) AS e, greatest(coalesce(ac.n, 0) / sum(coalesce(ac.n, 0)) OVER w, 1e-6) AS a
        FROM y JOIN ex ON ex.feature = y.feature LEFT JOIN ac ON ac.feature = y.feature AND ac.year = y.year AND ac.bin = ex.bin WINDOW w AS (PARTITION BY y.feature, y.year))
      SELECT feature, year, {r('sum((a - e) * ln(a / e))', 'psi')} FROM f GROUP BY feature, year""",
)
def psi_drift(spark, sf_dir):
    out = selection.psi(scored(spark, sf_dir), FS, F.col("year").isin(list(SPLITS["train"])), "year")
    return show(out, ("feature", "year"), ("psi",))


@query(
    "feature_quality",
    f"WITH {SCORED},{_WIDE_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, 'double' AS dtype, {r(f'avg(({f} IS NULL)::INT)', 'missing_rate')}, count(DISTINCT {f}) AS n_unique FROM wide" for f in _WIDE),
)
def feature_quality(spark, sf_dir):
    out = selection.feature_quality(_with_flat(scored(spark, sf_dir)), _WIDE)
    return show(out, ("feature", "dtype", "n_unique"), ("missing_rate",))


# --- feature sets by name ------------------------------------------------------------------------------


def named_frame(spark, sf_dir):
    """A bar frame with the columns the named sets pick from."""
    df = signals.add_fs03(bars(spark, sf_dir))
    shape = candle_shape()
    df = df.withColumns({k: shape[k] for k in ("hl_range", "upper_wick", "lower_wick", "body_abs", "close_pos_range")})
    names = [
        "ret_1", "hl_range", "upper_wick", "lower_wick", "body_abs", "close_pos_range",
        *[c for c in signals.FS03_COLUMNS if not c.startswith("sig_") and c != "buy_signal"],
        "z_close_20", "ret_sum_10", "bb20_pos", "rsi_14", "ema_dist_8", "ema_dist_55", "session_london_ny", "session_ny", *signals.SIGNALS,
    ]
    return df.select("symbol", "ts", *names), names


_SETS = {
    "fs01_price_action": ["ret_1", "hl_range", "upper_wick", "lower_wick", "body_abs", "close_pos_range"],
    "fs02_lags_short": ["ret_1", "hl_range", "close_diff_lag_5", "close_diff_lag_13", "close_diff_lag_21", "body_lag_5", "body_lag_13", "body_lag_21"],
    "fs03_lags_cycle": ["lag", "angle"],
    "fs04_rolling_short": ["close_diff_lag_5", "body_lag_5", "ema_dist_55", "z_close_20", "ret_sum_10", "bb20_pos", "rsi_14"],
    "fs06_ema_trend": ["ema_dist_8", "ema_dist_55"],
    "fs07_bb_rsi_reversion": ["bb20_pos", "rsi_14", "lower_wick", "close_pos_range"],
    "fs08_time_session": ["angle", "session_london_ny", "session_ny"],
    "fs09_mtf_fast": ["ret_1", "bb20_pos", "rsi_14"],
    "fs10_mtf_full_all": ["all"],
}
_N_LAG, _N_ANGLE, _N_ALL = 8, 4, 6 + 8 + 4 + 6 + 2 + 4


def _set_rows_sql() -> str:
    exact = {
        "ret_1": "ret_1", "hl_range": "high", "upper_wick": "high", "lower_wick": "low", "body_abs": "ret_1", "close_pos_range": "nullif(high - low, 0)",
        "ema_dist_8": "ed8", "ema_dist_55": "ed55", "z_close_20": "z20", "ret_sum_10": "rs10", "bb20_pos": "bb20_pos", "rsi_14": "rsi_14",
        "session_london_ny": "session_london_ny", "session_ny": "session_ny",
        **{f"close_diff_lag_{k}": f"dc{k}" for k in (5, 8, 13, 21)}, **{f"body_lag_{k}": f"bd{k}" for k in (5, 8, 13, 21)},
    }
    lagged = [f"{k}{n}" for n in (5, 8, 13, 21) for k in ("dc", "bd")]
    parts = []
    for name, cols in _SETS.items():
        need: list[str] = []
        count = 4
        for c in cols:
            if c == "lag":
                need += lagged
                count += _N_LAG
            elif c == "angle":
                count += _N_ANGLE
            elif c == "all":
                need += [*exact.values()]
                count = _N_ALL
            else:
                need.append(exact[c])
                count += 1
        cond = " AND ".join(f"{x} IS NOT NULL" for x in need) or "true"
        parts.append(f"SELECT '{name}' AS feature_set, {count}::INTEGER AS n_features, count(*) FILTER ({cond}) AS complete_rows FROM fx")
    return " UNION ALL ".join(parts)


@query(
    "feature_sets",
    f"""WITH RECURSIVE {SIGNALS_SQL}, fx AS (SELECT *, {', '.join(f"lag(dc, {k}) OVER ww AS dc{k}, lag(ret_1, {k}) OVER ww AS bd{k}" for k in (5, 8, 13, 21))} FROM sg
      WINDOW ww AS (PARTITION BY symbol, year ORDER BY ts)) {_set_rows_sql()}""",
)
def feature_sets(spark, sf_dir):
    """Columns in each named set and rows complete in all of them; one aggregate for all sets."""
    df, names = named_frame(spark, sf_dir)
    sets = {n: transforms.feature_set(names, n) for n in _SETS}
    counts = df.agg(*[F.sum(_complete(cols).cast("bigint")).alias(n) for n, cols in sets.items()])
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("feature_set"), F.lit(len(cols)).alias("n_features"), F.col(n).alias("complete_rows"))
            for n, cols in sets.items()
        ]
    )
    return counts.select(F.explode(cells).alias("c")).select("c.*")


def _complete(cols):
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return ok


@query(
    "feature_catalog",
    f"""WITH RECURSIVE {SIGNALS_SQL}, fx AS (SELECT *, {', '.join(f"lag(dc, {k}) OVER ww AS dc{k}, lag(ret_1, {k}) OVER ww AS bd{k}" for k in (5, 8, 13, 21))} FROM sg
        WINDOW ww AS (PARTITION BY symbol, year ORDER BY ts))
      SELECT 'signal' AS family, 4::BIGINT AS features, count(*) * 4 AS known FROM fx
      UNION ALL SELECT 'candle', 6, count(*) * 5 + count(nullif(high - low, 0)) FROM fx
      UNION ALL SELECT 'lags', 8, {' + '.join(f'count({k}{n})' for n in (5, 8, 13, 21) for k in ('dc', 'bd'))} FROM fx
      UNION ALL SELECT 'rolling', 2, count(z20) + count(rs10) FROM fx UNION ALL SELECT 'ema', 2, count(ed8) + count(ed55) FROM fx
      UNION ALL SELECT 'rsi', 1, count(rsi_14) FROM fx UNION ALL SELECT 'bb_overlay', 1, count(bb20_pos) FROM fx""",
)
def feature_catalog(spark, sf_dir):
    """Features per family and how many of their values are known."""
    df, names = named_frame(spark, sf_dir)
    row = df.agg(*[F.count(n).alias(n) for n in names])
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("known")) for n in names])
    known = row.select(F.explode(cells).alias("c")).select("c.*")
    return transforms.feature_catalog(known).groupBy("family").agg(
        F.count(F.lit(1)).alias("features"), F.sum("known").alias("known")
    )
