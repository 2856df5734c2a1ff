"""Queries over measures: correlations, agreement, stability, contrasts, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.numeric import clamp, r6, safe_corr, stars
from tessera.operators import models, statistics
from tessera.plans import inputs
from tessera.plans.inputs import META_SQL, PAIRS_SQL
from tessera.session import stored, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: r as SQL, null for a constant side.
def _r(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


BASE_SQL = f"{META_SQL}, base AS (SELECT m.*, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS gc, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS pd, CAST(m.pID % 97 AS DOUBLE) AS wer FROM meta m JOIN documents d ON d.doc_id = m.pID)"


def _base(spark, sf_dir):
    m = inputs.meta(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pID"), "text")
    less = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c)))).cast("double")
    return m.join(d, "pID").select(*m.columns, less("e").alias("gc"), less(" ").alias("pd"), (F.col("pID") % 97).cast("double").alias("wer"))


@query(f"WITH {BASE_SQL} SELECT srcID, count(*) AS n, round(abs({_r('gc', 'mmse')}), 6) + 0 AS gc, round(abs({_r('pd', 'mmse')}), 6) + 0 AS pd FROM base GROUP BY srcID HAVING count(*) >= 2")
def corr_by_source(spark, sf_dir):
    c = statistics.correlate_by(_base(spark, sf_dir), "srcID", "mmse", ["gc", "pd"])
    return c.select("srcID", "n", r6(F.col("gc")).alias("gc"), r6(F.col("pd")).alias("pd"))


@query(f"WITH {BASE_SQL} SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, round({_r('gc', 'mmse')}, 6) + 0 AS gc, round({_r('pd', 'mmse')}, 6) + 0 AS pd FROM base GROUP BY ROLLUP (lang) HAVING count(*) >= 2")
def corr_rollup(spark, sf_dir):
    c = statistics.correlate_by(_base(spark, sf_dir), "lang", "mmse", ["gc", "pd"], absolute=False, include_all=True)
    return c.select("lang", "n", r6(F.col("gc")).alias("gc"), r6(F.col("pd")).alias("pd"))


@query(f"""WITH {BASE_SQL}, c AS (SELECT srcID, avg(wer) AS wer, abs({_r('gc', 'mmse')}) AS gc, abs({_r('pd', 'mmse')}) AS pd FROM base GROUP BY srcID HAVING count(*) >= 2)
SELECT 'gc' AS metric, round({_r('gc', 'wer')}, 6) + 0 AS r_vs_wer, round({_r('atanh(gc)', 'wer')}, 6) + 0 AS z_vs_wer FROM c WHERE gc IS NOT NULL AND gc < 1 AND wer > 0
UNION ALL SELECT 'pd', round({_r('pd', 'wer')}, 6) + 0, round({_r('atanh(pd)', 'wer')}, 6) + 0 FROM c WHERE pd IS NOT NULL AND pd < 1 AND wer > 0""")
def meta_correlation(spark, sf_dir):
    b = _base(spark, sf_dir)
    c = statistics.correlate_by(b, "srcID", "mmse", ["gc", "pd"]).join(b.groupBy("srcID").agg(F.avg("wer").alias("wer")), "srcID")
    long = statistics.long_form(c.where("wer > 0"), ["srcID", "wer"], ["gc", "pd"]).where("value is not null and value < 1")
    return long.groupBy("metric").agg(r6(safe_corr(F.col("value"), F.col("wer"))).alias("r_vs_wer"), r6(safe_corr(F.atanh("value"), F.col("wer"))).alias("z_vs_wer"))


@query()
def corr_p_values(spark, sf_dir):
    inputs.start(spark)
    c = statistics.long_form(statistics.correlate_by(_base(spark, sf_dir), "srcID", "mmse", ["gc", "pd"], absolute=False), ["srcID", "n"], ["gc", "pd"], "metric", "r")
    return c.withColumn("p", statistics.pearson_p_of("r", "n"))


PAIR_SQL = """
v AS (SELECT event_type AS srcID, user_id AS pID, avg(value) AS v FROM events GROUP BY 1, 2),
ab AS (SELECT s.srcID, s.pID, h.v AS a, s.v AS b FROM v s JOIN v h ON s.pID = h.pID AND h.srcID = 'view' WHERE s.srcID <> 'view' AND h.v IS NOT NULL AND s.v IS NOT NULL)
"""


@query(f"""WITH {PAIR_SQL}, k AS (SELECT *, rank() OVER (PARTITION BY srcID ORDER BY a) + (count(*) OVER (PARTITION BY srcID, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY srcID ORDER BY b) + (count(*) OVER (PARTITION BY srcID, b) - 1) / 2.0 AS rb,
(a - avg(a) OVER (PARTITION BY srcID)) / nullif(stddev_pop(a) OVER (PARTITION BY srcID), 0) AS za, (b - avg(b) OVER (PARTITION BY srcID)) / nullif(stddev_pop(b) OVER (PARTITION BY srcID), 0) AS zb FROM ab)
SELECT srcID, count(*) AS n, round({_r('a', 'b')}, 6) + 0 AS pearson_r, round({_r('ra', 'rb')}, 6) + 0 AS spearman_rho, round(avg(abs(za - zb)), 6) + 0 AS mad_z FROM k GROUP BY srcID HAVING count(*) >= 3""")
def agreement_metrics(spark, sf_dir):
    a = statistics.agreement(inputs.measures(spark, sf_dir), "srcID", "pID", "value", "view")
    return a.select("srcID", "n", *(r6(F.col(c)).alias(c) for c in ("pearson_r", "spearman_rho", "mad_z")))


def _stability(mode):
    def f(spark, sf_dir):
        return statistics.stability(inputs.measures(spark, sf_dir), "srcID", "pID", "value", "view", mode).select(r6(F.col("stability")).alias("stability"))

    return f


QUERIES["feature_stability_m0"], QUERIES["feature_stability_m1"] = _stability(0), _stability(1)
ORACLES["feature_stability_m0"] = f"WITH {PAIR_SQL}, d AS (SELECT srcID, avg(abs(a - b) / nullif((abs(a) + abs(b)) / 2, 0)) AS d FROM ab GROUP BY srcID) SELECT round(avg(d), 6) + 0 AS stability FROM d"
ORACLES["feature_stability_m1"] = f"WITH {PAIR_SQL}, d AS (SELECT srcID, avg(abs(a - b)) AS d FROM ab GROUP BY srcID) SELECT round(avg(d), 6) + 0 AS stability FROM d"


@query("""WITH r AS (SELECT event_type AS srcID, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT srcID, round(avg(value), 6) + 0 AS trimmed FROM r WHERE rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1) GROUP BY srcID""")
def trimmed_mean_rank(spark, sf_dir):
    return statistics.trimmed_by_rank(inputs.measures(spark, sf_dir), "srcID", "value").select("srcID", r6(F.col("trimmed")).alias("trimmed"))


@query("""WITH q AS (SELECT event_type AS srcID, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi, count(value) AS n FROM events GROUP BY 1)
SELECT srcID, round(avg(CASE WHEN n < 3 OR (value >= lo AND value <= hi) THEN value END), 6) + 0 AS trimmed FROM events JOIN q ON event_type = srcID GROUP BY srcID""")
def trimmed_mean_quantile(spark, sf_dir):
    return statistics.trimmed_by_quantile(inputs.measures(spark, sf_dir), "srcID", "value").select("srcID", r6(F.col("trimmed")).alias("trimmed"))


@query(f"""WITH {PAIRS_SQL}, w AS (SELECT srcID, wer, CASE WHEN pID % 2 = 1 THEN 1 ELSE 0 END AS ad FROM wer), k AS (SELECT *, rank() OVER (PARTITION BY srcID ORDER BY wer) + (count(*) OVER (PARTITION BY srcID, wer) - 1) / 2.0 AS rk FROM w)
SELECT srcID, format('{{:.1f}} $\\pm$ {{:.1f}}', 100 * avg(CASE WHEN ad = 1 THEN wer END), 100 * stddev_samp(CASE WHEN ad = 1 THEN wer END)) AS ad_cell,
round(avg(CASE WHEN ad = 1 THEN wer END) - avg(CASE WHEN ad = 0 THEN wer END), 6) + 0 AS delta, round(sum(CASE WHEN ad = 1 THEN rk END) - sum(ad) * (sum(ad) + 1) / 2.0, 6) + 0 AS u FROM k GROUP BY srcID""")
def wer_dx_table(spark, sf_dir):
    from tessera.plans.queries_text import _wer

    w = _wer(spark, sf_dir).withColumn("ad", (F.col("pID") % 2 == 1).cast("int"))
    u = statistics.rank_sum(w, "srcID", "ad", "wer").select("srcID", r6(F.col("u")).alias("u"))
    of = lambda k: F.when(F.col("ad") == k, F.col("wer"))
    cell = F.format_string("%.1f $\\pm$ %.1f", 100 * F.avg(of(1)), 100 * F.stddev_samp(of(1)))
    return w.groupBy("srcID").agg(cell.alias("ad_cell"), r6(F.avg(of(1)) - F.avg(of(0))).alias("delta")).join(u, "srcID")


@query(f"""WITH {META_SQL}, k AS (SELECT lang, CASE WHEN dx = 'ProbableAD' THEN 1 ELSE 0 END AS y, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM meta)
SELECT lang, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0), 6) + 0 AS auc FROM k GROUP BY lang""")
def auc_rank(spark, sf_dir):
    m = inputs.meta(spark, sf_dir).withColumn("y", (F.col("dx") == "ProbableAD").cast("int"))
    return statistics.rank_sum(m, "lang", "y", "n_chars").select("lang", r6(F.col("auc")).alias("auc"))


@query("""WITH l AS (SELECT l_returnflag AS srcID, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_discount AS DOUBLE) AS discount FROM lineitem)
SELECT srcID, 'quantity' AS x, 'price' AS y, round(""" + _r("quantity", "price") + """, 2) + 0 AS r FROM l GROUP BY srcID
UNION ALL SELECT srcID, 'quantity', 'discount', round(""" + _r("quantity", "discount") + """, 2) + 0 FROM l GROUP BY srcID
UNION ALL SELECT srcID, 'price', 'discount', round(""" + _r("price", "discount") + """, 2) + 0 FROM l GROUP BY srcID""")
def corr_matrix_long(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("srcID"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_discount").cast("double").alias("discount"))
    pairs = [("quantity", "price"), ("quantity", "discount"), ("price", "discount")]
    wide = li.groupBy("srcID").agg(*(safe_corr(F.col(x), F.col(y)).alias(f"{x}|{y}") for x, y in pairs))
    long = statistics.long_form(wide, ["srcID"], [f"{x}|{y}" for x, y in pairs], "pair", "r")
    return long.select("srcID", F.split("pair", r"\|")[0].alias("x"), F.split("pair", r"\|")[1].alias("y"), (F.round("r", 2) + 0.0).alias("r"))


@query("""SELECT o_orderpriority AS grp, round(regr_slope(CAST(o_totalprice AS DOUBLE), o_custkey), 6) + 0 AS slope, round(regr_intercept(CAST(o_totalprice AS DOUBLE), o_custkey), 2) + 0 AS intercept FROM orders GROUP BY 1""")
def ols_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    y = F.col("o_totalprice").cast("double")
    return o.groupBy(F.col("o_orderpriority").alias("grp")).agg(r6(F.regr_slope(y, F.col("o_custkey"))).alias("slope"), (F.round(F.regr_intercept(y, F.col("o_custkey")), 2) + 0.0).alias("intercept"))


@query("""WITH e AS (SELECT event_type AS srcID, value FROM events), q AS (SELECT srcID, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.99) AS p99 FROM e GROUP BY 1)
SELECT srcID, round(p1, 6) + 0 AS p1, round(q1, 6) + 0 AS q1, round(median, 6) + 0 AS median, round(q3, 6) + 0 AS q3, round(p99, 6) + 0 AS p99,
round(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END), 6) + 0 AS low, round(max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END), 6) + 0 AS high FROM e JOIN q USING (srcID) GROUP BY ALL""")
def box_stats(spark, sf_dir):
    b = statistics.box_stats(inputs.measures(spark, sf_dir), ["srcID"], "value")
    return b.select("srcID", *(r6(F.col(c)).alias(c) for c in ("p1", "q1", "median", "q3", "p99", "low", "high")))


@query(f"WITH {META_SQL} SELECT pID, CAST(CASE WHEN dx = 'ProbableAD' THEN 1 ELSE 0 END AS INTEGER) AS y_cls, mmse AS y_reg, greatest(least(CAST(n_chars AS DOUBLE) / 100, 25.0), 0.0)::DOUBLE AS size, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_code FROM meta WHERE mmse IS NOT NULL")
def ml_features(spark, sf_dir):
    m = inputs.meta(spark, sf_dir).where("mmse is not null")
    codes = m.select("lang").distinct().withColumn("lang_code", F.dense_rank().over(Window.orderBy("lang")) - 1)
    return m.join(codes, "lang").select("pID", (F.col("dx") == "ProbableAD").cast("int").alias("y_cls"), F.col("mmse").alias("y_reg"), clamp(F.col("n_chars").cast("double") / 100, 0.0, 25.0).alias("size"), F.col("lang_code").cast("int").alias("lang_code"))


#: The 52 bits of a key that folds go by.
FOLD_SQL = "CAST('0x' || substr(md5(CAST(pID AS VARCHAR)), 1, 13) AS BIGINT)"


@query(f"WITH {META_SQL} SELECT pID, CAST({FOLD_SQL} % 5 AS INTEGER) AS fold, CAST((row_number() OVER (PARTITION BY dx ORDER BY {FOLD_SQL}, CAST(pID AS VARCHAR)) - 1) % 5 AS INTEGER) AS strat_fold FROM meta")
def fold_assign(spark, sf_dir):
    m = inputs.meta(spark, sf_dir)
    return models.stratified_folds(m.select("pID", "dx", models.fold("pID", 5).alias("fold")), "dx", "pID", 5, "strat_fold").drop("dx")


def _oof(spark, sf_dir, kind):
    inputs.start(spark)
    b = _base(spark, sf_dir).withColumn("y", F.col("mmse") if kind == "linear" else (F.col("dx") == "ProbableAD").cast("double"))
    # Plain folds for numbers, stratified ones for classes.
    folded = b.withColumn("fold", models.fold("pID", 5)) if kind == "linear" else models.stratified_folds(b, "dx", "pID", 5)
    return models.out_of_fold(folded, "lang", "pID", "y", ["gc", "pd", "n_chars"], kind, (0.0, 30.0) if kind == "linear" else None)


#: Ordinary least squares on three centred features by Cramer's rule, for each language and
#: held-out fold on all other folds, and the clipped predictions of the held-out rows.
_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"


def _ols_sql() -> str:
    x = ("gc", "pd", "len")
    cov = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    cols = ", ".join([*(f"avg({c}) AS m{i}" for i, c in enumerate(x)), "avg(mmse) AS my", *(f"covar_pop({x[i]}, {x[j]}) AS c{i}{j}" for i in range(3) for j in range(i, 3)), *(f"covar_pop({c}, mmse) AS y{i}" for i, c in enumerate(x))])
    det = _DET.format(*sum(cov, []))
    slopes = ", ".join(f"{_DET.format(*(f'y{i}' if j == k else cov[i][j] for i in range(3) for j in range(3)))} / {det} AS b{k}" for k in range(3))
    value = " + ".join(["my", *(f"b{i} * ({c} - m{i})" for i, c in enumerate(x))])
    return f"""{BASE_SQL}, f AS (SELECT *, n_chars::DOUBLE AS len, CAST({FOLD_SQL} % 5 AS INTEGER) AS fold FROM base WHERE mmse IS NOT NULL),
    t AS (SELECT k.lang, k.fold, {cols} FROM (SELECT DISTINCT lang, fold FROM f) k JOIN f ON f.lang = k.lang AND f.fold <> k.fold GROUP BY k.lang, k.fold),
    w AS (SELECT *, {slopes} FROM t), oof AS (SELECT f.lang, pID, mmse AS y_true, greatest(0, least(30, {value})) AS oof_pred, f.fold FROM f JOIN w ON f.lang = w.lang AND f.fold = w.fold)"""


OLS_SQL = _ols_sql()


@query(f"WITH {OLS_SQL} SELECT lang, pID, y_true, round(oof_pred, 6) + 0 AS oof_pred, fold FROM oof")
def oof_regression(spark, sf_dir):
    return _oof(spark, sf_dir, "linear").withColumn("oof_pred", r6(F.col("oof_pred")))


@query()
def oof_classification(spark, sf_dir):
    return _oof(spark, sf_dir, "logistic")


@query(f"WITH {OLS_SQL} SELECT round(sqrt(avg((y_true - oof_pred) ** 2)), 6) + 0 AS rmse, round(avg((y_true - oof_pred) ** 2), 6) + 0 AS mse, round(avg(abs(y_true - oof_pred)), 6) + 0 AS mae, round(1 - sum((y_true - oof_pred) ** 2) / nullif(var_pop(y_true) * count(*), 0), 6) + 0 AS r2, round({_r('y_true', 'oof_pred')}, 6) + 0 AS r FROM oof")
def oof_metrics(spark, sf_dir):
    m = statistics.regression_metrics(_oof(spark, sf_dir, "linear"), "y_true", "oof_pred")
    return m.select(*(r6(F.col(c)).alias(c) for c in m.columns))


@query(f"WITH {OLS_SQL} SELECT lang, fold, round(sqrt(avg((y_true - oof_pred) ** 2)), 6) + 0 AS rmse, round(avg(abs(y_true - oof_pred)), 6) + 0 AS mae, round(1 - sum((y_true - oof_pred) ** 2) / nullif(var_pop(y_true) * count(*), 0), 6) + 0 AS r2, round({_r('y_true', 'oof_pred')}, 6) + 0 AS r FROM oof GROUP BY lang, fold")
def oof_regression_by_fold(spark, sf_dir):
    """Regression metrics of the out-of-fold predictions themselves, per language and fold."""
    m = statistics.regression_metrics_by(_oof(spark, sf_dir, "linear"), ["lang", "fold"], "y_true", "oof_pred")
    return m.select("lang", "fold", *(r6(F.col(c)).alias(c) for c in ("rmse", "mae", "r2", "r")))


@query()
def oof_model_choice(spark, sf_dir):
    """Errors of three regressions on the same folds."""
    inputs.start(spark)
    b = models.leave_groups_out(_base(spark, sf_dir).withColumn("y", F.col("mmse")), "srcID").withColumn("all", F.lit("all"))
    out = None
    for kind in sorted(models.REGRESSIONS):
        one = models.out_of_fold(b, "all", "pID", "y", ["gc", "pd", "n_chars"], kind, (0.0, 30.0))
        one = statistics.regression_metrics(one, "y_true", "oof_pred").select(F.lit(kind).alias("model"), *(r6(F.col(c)).alias(c) for c in ("rmse", "mae", "r2", "r")))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def oof_class_metrics(spark, sf_dir):
    """Accuracy, F1 and AUC of the out-of-fold probabilities themselves, per language and fold."""
    m = statistics.classification_metrics(_oof(spark, sf_dir, "logistic"), ["lang", "fold"], "y_true", "oof_proba_pos")
    return m.select("lang", "fold", "n", *(r6(F.col(c)).alias(c) for c in ("acc", "f1", "auc")))


@query()
def oof_class_spread(spark, sf_dir):
    """Mean and deviation over the folds of the same metrics, all languages together."""
    m = statistics.classification_metrics(_oof(spark, sf_dir, "logistic"), ["fold"], "y_true", "oof_proba_pos")
    return statistics.fold_spread(m, ["acc", "f1", "auc"]).select("metric", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


@query()
def oof_leave_group_out(spark, sf_dir):
    inputs.start(spark)
    b = _base(spark, sf_dir).withColumn("y", F.col("mmse"))
    return models.out_of_fold(models.leave_groups_out(b, "lang"), "srcID", "pID", "y", ["gc", "pd", "n_chars"], "linear", (0.0, 30.0))


@query()
def oof_multiclass(spark, sf_dir):
    inputs.start(spark)
    b = _base(spark, sf_dir).withColumn("fold", models.fold("pID", 5))
    return models.out_of_fold_classes(b, "dx", "pID", "lang", ["gc", "pd", "n_chars"], [r.lang for r in b.select("lang").distinct().collect() if r.lang])


PRED_SQL = f"{META_SQL}, p AS (SELECT pID, CAST({FOLD_SQL} % 5 AS INTEGER) AS fold, CASE WHEN dx = 'ProbableAD' THEN 1 ELSE 0 END AS y, mmse, (n_chars % 101) / 100.0::DOUBLE AS proba, CAST(n_chars % 29 AS DOUBLE) AS pred FROM meta)"
CLASS_SQL = f"""{PRED_SQL}, k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY proba) + (count(*) OVER (PARTITION BY fold, proba) - 1) / 2.0 AS rk, proba >= 0.5 AS hit FROM p),
c AS (SELECT fold, count(*) AS n, avg(CASE WHEN (y = 1) = hit THEN 1.0 ELSE 0.0 END) AS acc, coalesce(2.0 * sum(CASE WHEN y = 1 AND hit THEN 1 ELSE 0 END) / nullif(sum(y) + sum(hit::INT), 0), 0) AS f1,
(sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auc FROM k GROUP BY fold)"""


def _predicted(spark, sf_dir):
    m = inputs.meta(spark, sf_dir)
    return m.select("pID", models.fold("pID", 5).alias("fold"), (F.col("dx") == "ProbableAD").cast("int").alias("y"), "mmse", (F.col("n_chars") % 101 / 100.0).alias("proba"), (F.col("n_chars") % 29).cast("double").alias("pred"))


@query(f"WITH {CLASS_SQL} SELECT fold, n, round(acc, 6) + 0 AS acc, round(f1, 6) + 0 AS f1, round(auc, 6) + 0 AS auc FROM c")
def class_metrics_by_fold(spark, sf_dir):
    m = statistics.classification_metrics(_predicted(spark, sf_dir), ["fold"], "y", "proba")
    return m.select("fold", "n", *(r6(F.col(c)).alias(c) for c in ("acc", "f1", "auc")))


@query(f"WITH {CLASS_SQL}, l AS (SELECT 'acc' AS metric, acc AS v FROM c UNION ALL SELECT 'f1', f1 FROM c UNION ALL SELECT 'auc', auc FROM c) SELECT metric, round(avg(v), 6) + 0 AS mean, round(stddev_pop(v), 6) + 0 AS sd FROM l GROUP BY metric")
def class_metrics_spread(spark, sf_dir):
    s = statistics.fold_spread(statistics.classification_metrics(_predicted(spark, sf_dir), ["fold"], "y", "proba"), ["acc", "f1", "auc"])
    return s.select("metric", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


@query(f"""WITH {PRED_SQL} SELECT fold, round(sqrt(avg((mmse - pred) ** 2)), 6) + 0 AS rmse, round(avg(abs(mmse - pred)), 6) + 0 AS mae, round(1 - sum((mmse - pred) ** 2) / nullif(var_pop(mmse) * count(*), 0), 6) + 0 AS r2,
round({_r('mmse', 'pred')}, 6) + 0 AS r FROM p WHERE mmse IS NOT NULL GROUP BY fold""")
def regression_metrics_by_fold(spark, sf_dir):
    m = statistics.regression_metrics_by(_predicted(spark, sf_dir), ["fold"], "mmse", "pred")
    return m.select("fold", *(r6(F.col(c)).alias(c) for c in ("rmse", "mae", "r2", "r")))


@query(f"WITH {META_SQL} SELECT pID, " + ", ".join(f"CAST(CASE WHEN lang = '{c}' THEN 1 ELSE 0 END AS INTEGER) AS is_{c}" for c in ("de", "en", "es", "fr")) + " FROM meta")
def one_hot_labels(spark, sf_dir):
    return models.one_hot(inputs.meta(spark, sf_dir).select("pID", "lang"), "lang", ["de", "en", "es", "fr"]).drop("lang")


def _wer_flagged(spark, sf_dir):
    from tessera.plans.queries_text import _wer

    return _wer(spark, sf_dir).withColumn("ad", (F.col("pID") % 2 == 1).cast("int"))


CELL_SQL = f"""{PAIRS_SQL}, w AS (SELECT srcID, pID, 100 * wer AS wer, CASE WHEN pID % 2 = 1 THEN 1 ELSE 0 END AS ad FROM wer), k AS (SELECT *, rank() OVER (PARTITION BY srcID ORDER BY wer) + (count(*) OVER (PARTITION BY srcID, wer) - 1) / 2.0 AS rk FROM w),
t AS (SELECT srcID, sum(t ** 3 - t) AS tie_term FROM (SELECT srcID, wer, count(*)::DOUBLE AS t FROM w GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {CELL_SQL} SELECT k.srcID, format('{{:.1f}} $\\pm$ {{:.1f}}', avg(CASE WHEN ad = 0 THEN wer END), stddev_samp(CASE WHEN ad = 0 THEN wer END)) AS cn_cell,
format('{{:.1f}} $\\pm$ {{:.1f}}', avg(CASE WHEN ad = 1 THEN wer END), stddev_samp(CASE WHEN ad = 1 THEN wer END)) AS ad_cell, round(avg(CASE WHEN ad = 1 THEN wer END) - avg(CASE WHEN ad = 0 THEN wer END), 6) + 0 AS delta,
round(sum(CASE WHEN ad = 1 THEN rk END) - sum(ad) * (sum(ad) + 1) / 2.0, 6) + 0 AS u, CAST(sum(ad) AS BIGINT) AS n1, CAST(sum(1 - ad) AS BIGINT) AS n0, any_value(tie_term) AS tie_term, round({_r('wer', 'CAST(pID % 31 AS DOUBLE)')}, 6) + 0 AS r
FROM k JOIN t ON k.srcID = t.srcID GROUP BY k.srcID""")
def wer_table_cells(spark, sf_dir):
    # Distances are computed once for the cells, the rank sums and the correlation.
    w = stored(_wer_flagged(spark, sf_dir), "wer-flagged")
    r = w.groupBy("srcID").agg(r6(safe_corr(100 * F.col("wer"), (F.col("pID") % 31).cast("double"))).alias("r"))
    c = statistics.group_cells(w, "srcID", "ad", "wer").join(r, "srcID")
    return c.withColumns({"delta": r6(F.col("delta")), "u": r6(F.col("u"))})


@query()
def wer_table_rows(spark, sf_dir):
    """The table's rows with significance marks: Mann-Whitney for the difference, Pearson
    for the correlation with the score."""
    inputs.start(spark)
    c = wer_table_cells(spark, sf_dir)
    p = statistics.mann_whitney_p_of("u", "n1", "n0", "tie_term")
    mark = lambda x: stars(F.col(x))
    c = c.withColumn("p", p).withColumn("p_r", statistics.pearson_p_of("r", (F.col("n1") + F.col("n0")).cast("long")))
    return c.select(
        "srcID", "cn_cell", "ad_cell", F.concat(F.format_string("%.1f", "delta"), mark("p")).alias("delta"),
        F.when(F.col("r").isNull(), "NaN").otherwise(F.concat(F.format_string("%.2f", "r"), mark("p_r"))).alias("r_score"), "p", "p_r",
    )


@query()
def agreement_p_values(spark, sf_dir):
    inputs.start(spark)
    a = statistics.agreement(inputs.measures(spark, sf_dir), "srcID", "pID", "value", "view")
    return a.withColumns({"pearson_p": statistics.pearson_p_of("pearson_r", "n"), "spearman_p": statistics.pearson_p_of("spearman_rho", "n")})


@query()
def corr_matrix_labels(spark, sf_dir):
    """Correlations as labels: r with two places and its stars, over complete rows."""
    inputs.start(spark)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("srcID"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_discount").cast("double").alias("discount")).na.drop()
    pairs = [("quantity", "price"), ("quantity", "discount"), ("price", "discount")]
    wide = li.groupBy("srcID").agg(F.count(F.lit(1)).alias("n"), *(safe_corr(F.col(x), F.col(y)).alias(f"{x}|{y}") for x, y in pairs))
    long = statistics.long_form(wide, ["srcID", "n"], [f"{x}|{y}" for x, y in pairs], "pair", "r").withColumn("p", statistics.pearson_p_of("r", "n"))
    return long.select("srcID", F.split("pair", r"\|")[0].alias("x"), F.split("pair", r"\|")[1].alias("y"), "p", F.concat(F.format_string("%.2f", F.round("r", 2) + 0.0), stars(F.col("p"))).alias("label"))


@query(f"""WITH {BASE_SQL}, c AS (SELECT srcID, avg(wer) AS wer, abs({_r('gc', 'mmse')}) AS gc, abs({_r('pd', 'mmse')}) AS pd FROM base GROUP BY srcID HAVING count(*) >= 2),
x AS (SELECT srcID, wer, unnest(['gc', 'pd']) AS metric, unnest([gc, pd]) AS v FROM c),
z AS (SELECT *, CASE WHEN v < 1 THEN atanh(v) END AS z FROM x),
o AS (SELECT metric, {_r('v', 'CASE WHEN v IS NOT NULL THEN wer END')} AS rv, {_r('z', 'CASE WHEN z IS NOT NULL THEN wer END')} AS rz FROM z GROUP BY metric)
SELECT srcID, metric, round(wer, 4) + 0 AS wer, round(v, 4) + 0 AS r_value, round(z, 4) + 0 AS z_value, round(rv, 4) + 0 AS r_vs_wer, round(rz, 4) + 0 AS z_vs_wer
FROM z JOIN o USING (metric) ORDER BY metric, wer, srcID""")
def meta_correlation_tables(spark, sf_dir):
    """The four tables side by side, as column groups r_ and z_: each source's value, and the
    metric's correlation with the sources' word error rates."""
    b = _base(spark, sf_dir)
    c = statistics.correlate_by(b, "srcID", "mmse", ["gc", "pd"]).join(b.groupBy("srcID").agg(F.avg("wer").alias("wer")), "srcID")
    long = statistics.long_form(c, ["srcID", "wer"], ["gc", "pd"]).withColumn("z", F.when(F.col("value") < 1, F.atanh("value")))
    over = long.groupBy("metric").agg(safe_corr(F.col("value"), F.col("wer")).alias("r_vs_wer"), safe_corr(F.col("z"), F.col("wer")).alias("z_vs_wer"))
    r4 = lambda x: F.round(F.col(x), 4) + 0.0
    joined = long.join(over, "metric").orderBy("metric", "wer", "srcID")
    return joined.select("srcID", "metric", r4("wer").alias("wer"), r4("value").alias("r_value"), r4("z").alias("z_value"), r4("r_vs_wer").alias("r_vs_wer"), r4("z_vs_wer").alias("z_vs_wer"))


@query("""SELECT o_orderpriority AS grp, round(avg(p), 6) + 0 AS loo_mean, round(max(z), 6) + 0 AS top_z FROM (
SELECT o_orderpriority, (sum(x) OVER w - x) / nullif(count(*) OVER w - 1, 0) AS p, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS z FROM (SELECT o_orderpriority, CAST(o_custkey AS DOUBLE) AS x FROM orders) WINDOW w AS (PARTITION BY o_orderpriority)) GROUP BY 1""")
def leave_one_out_mean(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").cast("double").alias("x"))
    # One row a group is joined back; no window holds a group.
    sums = x.groupBy("o_orderpriority").agg(F.sum("x").alias("s"), F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("d"))
    met = x.join(sums, "o_orderpriority")
    p = met.select("o_orderpriority", F.try_divide(F.col("s") - F.col("x"), F.col("n") - 1).alias("p"), F.try_divide(F.col("x") - F.col("m"), F.col("d")).alias("z"))
    return p.groupBy(F.col("o_orderpriority").alias("grp")).agg(r6(F.avg("p")).alias("loo_mean"), r6(F.max("z")).alias("top_z"))
