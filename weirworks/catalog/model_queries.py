"""Features, regression models, tuning and clustering."""

from __future__ import annotations

from itertools import combinations
from statistics import NormalDist

from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from weirworks.catalog.cleaning_queries import _FLAGGED, _SITES
from weirworks.catalog.registry import bucket_sql, query, r, rounded, union_all
from weirworks.catalog.tables import PERIODS, sites, sites_flagged, table
from weirworks.functions.columns import quoted, row_mean
from weirworks.operators import charts, clusters, features, groups, linear_folds, regression, tuning
from weirworks.operators.ensembles import StackingRegressor, VotingRegressor
from weirworks.operators.rules import drop_missing, fill_constant
from weirworks.plans import modelling
from weirworks.session import materialised, scratch_path
from weirworks.sources import sinks

LINE = ("l_quantity", "l_discount", "l_tax")
PRICE = "l_extendedprice"
SITE_FEATURES = ("events_1995", "events_1996", "events_1997", "events_1998", "balance")
SITE_TARGET = "mean_events"
TREES = 100  # the library's default


def lines(spark, sf_dir):
    """Line items with a row key."""
    wanted = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE, PRICE]
    rows = table(spark, sf_dir, "lineitem", wanted)
    return rows.withColumn("line_key", F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", PRICE))


def open_site_rows(spark, sf_dir):
    """Model input with gaps: the first four yearly counts and the balance, to predict the mean of all years."""
    measured = sites(spark, sf_dir).withColumn(SITE_TARGET, row_mean(PERIODS))
    return measured.select("site_id", *SITE_FEATURES, SITE_TARGET)


def site_rows(spark, sf_dir):
    """Model input without gaps: a missing count is 0, so that every site is used."""
    return materialised(fill_constant(open_site_rows(spark, sf_dir), 0), "model-rows")


# ---- features ---------------------------------------------------------------------------------


@query(
    "interaction_features",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join([*LINE, *[r(f"{a} * {b}", f"{a}_x_{b}") for a, b in combinations(LINE, 2)]])
    + " FROM lineitem",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", *LINE])
    return rounded(features.interaction_features(rows, LINE))


@query(
    "polynomial_features",
    f"""SELECT l_orderkey, l_linenumber, l_quantity, l_discount, {r('l_quantity * l_quantity', 'l_quantity^2')},
    {r('l_quantity * l_discount', 'l_quantity l_discount')}, {r('l_discount * l_discount', 'l_discount^2')},
    {r('l_quantity * l_quantity * l_quantity', 'l_quantity^3')},
    {r('l_quantity * l_quantity * l_discount', 'l_quantity^2 l_discount')},
    {r('l_quantity * l_discount * l_discount', 'l_quantity l_discount^2')},
    {r('l_discount * l_discount * l_discount', 'l_discount^3', 6)} FROM lineitem""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"])
    made = features.polynomial_features(rows, ["l_quantity", "l_discount"], degree=3)
    return rounded(made.drop("l_discount^3")).select(
        "*", F.round(F.col("l_discount") * F.col("l_discount") * F.col("l_discount"), 6).alias("l_discount^3")
    )


_SCORED = union_all(
    [
        f"""SELECT '{c}' AS feature, {r(f'corr({c}, {PRICE})', 'r')},
        {r(f'corr({c}, {PRICE}) ^ 2 / (1 - corr({c}, {PRICE}) ^ 2) * (count(*) - 2)', 'score')} FROM lineitem"""
        for c in LINE
    ]
)


@query("f_scores", _SCORED)
def _(spark, sf_dir):
    return rounded(features.f_scores(table(spark, sf_dir, "lineitem", [*LINE, PRICE]), LINE, PRICE))


@query("select_univariate", f"SELECT * FROM ({_SCORED}) q ORDER BY score DESC NULLS LAST, feature LIMIT 2")
def _(spark, sf_dir):
    scores = features.f_scores(table(spark, sf_dir, "lineitem", [*LINE, PRICE]), LINE, PRICE)
    return rounded(features.select_best(scores, 2))


def _bin(column: str) -> str:
    return f"len(list_filter(list_distinct(e_{column}), lambda e: {column} > e))"


_EDGES = ", ".join(
    f"quantile_cont({c}, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e_{c}" for c in (*LINE, PRICE)
)


@query(
    "select_mutual_info",
    f"""WITH e AS (SELECT {_EDGES} FROM lineitem),
    b AS ({union_all([f"SELECT '{c}' AS feature, {_bin(c)} AS x, {_bin(PRICE)} AS y FROM lineitem, e" for c in LINE])}),
    n AS (SELECT feature, x, y, count(*) * 1.0 AS n FROM b GROUP BY ALL),
    m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny,
            sum(n) OVER (PARTITION BY feature) AS total FROM n)
    SELECT feature, {r('sum(n / total * ln(n * total / (nx * ny)))', 'score')} FROM m GROUP BY feature
    ORDER BY score DESC, feature LIMIT 2""",
)
def _(spark, sf_dir):
    scores = features.mutual_information(table(spark, sf_dir, "lineitem", [*LINE, PRICE]), LINE, PRICE)
    return rounded(features.select_best(scores, 2))


@query("select_rfe")
def _(spark, sf_dir):
    return features.select_rfe(site_rows(spark, sf_dir), SITE_FEATURES, SITE_TARGET, keep=2)


@query("select_importance")
def _(spark, sf_dir):
    return features.select_importance(site_rows(spark, sf_dir), SITE_FEATURES, SITE_TARGET, trees=TREES)


@query("top_features")
def _(spark, sf_dir):
    table_ = features.importance_table(site_rows(spark, sf_dir), SITE_FEATURES, SITE_TARGET, trees=TREES)
    return groups.top_features(table_, 3)


def vectors(spark, sf_dir):
    """Embeddings with one column per dimension."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(d) for i, d in enumerate(DIMS)])


DIMS = tuple(f"d{i}" for i in range(64))
_VECTORS = "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {d}" for i, d in enumerate(DIMS))


@query("pca")
def _(spark, sf_dir):
    return features.pca(vectors(spark, sf_dir), "vec_id", DIMS)


# ---- scaling, metrics, checks -----------------------------------------------------------------


@query(
    "standard_scale",
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINE)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(r(f"({c} - m_{c}) / s_{c}", c) for c in LINE)
    + " FROM lineitem, s",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", *LINE])
    return rounded(regression.standard_scale(rows, LINE))


def guessed(spark, sf_dir):
    """Line items with a fixed-rate guess of the price as the prediction."""
    return lines(spark, sf_dir).withColumn("guess", F.col("l_quantity") * 2100.0)


_GUESS = "lineitem, LATERAL (SELECT l_quantity * 2100.0 AS guess) g"


def _metrics_sql(key: str) -> str:
    return f"""SELECT {key + ', ' if key else ''}
      CASE WHEN var_pop({PRICE}) > 0 THEN 1 - avg(({PRICE} - guess) ^ 2) / var_pop({PRICE}) END AS r2,
      sqrt(avg(({PRICE} - guess) ^ 2)) AS rmse, avg(abs({PRICE} - guess)) AS mae,
      avg(({PRICE} - guess) ^ 2) AS mse, count(*) AS n FROM {_GUESS} {'GROUP BY ' + key if key else ''}"""


@query(
    "regression_metrics",
    f"SELECT {r('r2', 'r2')}, {r('rmse', 'rmse', 3)}, {r('mae', 'mae', 3)}, {r('mse', 'mse', 1)}, n "
    f"FROM ({_metrics_sql('')}) q",
)
def _(spark, sf_dir):
    found = regression.regression_metrics(guessed(spark, sf_dir), PRICE, "guess")
    return found.select(
        F.round("r2", 4).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"),
        F.round("mse", 1).alias("mse"), "n",
    )


@query(
    "metric_checks",
    f"""SELECT l_suppkey, {r('r2', 'primary_metric')}, abs(rmse - sqrt(mse)) <= 1e-6 AS rmse_consistent,
    true AS f1_consistent, r2 <= 1 AND rmse >= 0 AND mse >= 0 AND mae >= 0 AS in_bounds, r2 >= 0.7 AS good
    FROM ({_metrics_sql('l_suppkey')}) q""",
)
def _(spark, sf_dir):
    per_supplier = regression.regression_metrics(guessed(spark, sf_dir), PRICE, "guess", ["l_suppkey"])
    return rounded(regression.metric_checks(per_supplier)).select(
        "l_suppkey", "primary_metric", "rmse_consistent", "f1_consistent", "in_bounds", "good"
    )


_PROPOSALS = """SELECT p_partkey, p_size * 5 - 5 AS n_estimators, p_size % 12 AS max_depth,
  CAST(p_partkey % 40 AS INT) AS min_samples_split, CAST(p_partkey % 3 AS INT) AS min_samples_leaf FROM part"""


@query(
    "param_sanity",
    f"""SELECT *, CASE WHEN n_estimators <= 0 THEN 'n_estimators' WHEN max_depth <= 0 THEN 'max_depth'
    WHEN min_samples_split < 2 THEN 'min_samples_split' WHEN min_samples_leaf < 1 THEN 'min_samples_leaf'
    WHEN min_samples_split > pow(2, max_depth) THEN 'split_exceeds_depth' END AS problem FROM ({_PROPOSALS}) q""",
)
def _(spark, sf_dir):
    # Every part stands for one proposed parameter set.
    proposals = spark.sql(_PROPOSALS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return regression.param_checks(proposals)


@query(
    "residuals",
    f"SELECT l_orderkey, {PRICE} AS actual, guess AS predicted, {r(f'{PRICE} - guess', 'residual')} FROM {_GUESS}",
)
def _(spark, sf_dir):
    return rounded(charts.residuals(guessed(spark, sf_dir), "l_orderkey", PRICE, "guess"))


@query(
    "fit_line",
    f"""SELECT {r(f'least(min({PRICE}), min(guess))', 'line_low')}, {r(f'greatest(max({PRICE}), max(guess))', 'line_high')},
    {r(f'1 - avg(({PRICE} - guess) ^ 2) / var_pop({PRICE})', 'r2')} FROM {_GUESS}""",
)
def _(spark, sf_dir):
    return rounded(charts.fit_line(charts.residuals(guessed(spark, sf_dir), "l_orderkey", PRICE, "guess")))


_QQ = ", ".join(f"({i / 100}, {NormalDist().inv_cdf(i / 100)!r})" for i in range(1, 100))


@query(
    "qq_points",
    f"""WITH g(prob, z) AS (VALUES {_QQ}),
    s AS (SELECT unnest(quantile_cont({PRICE} - guess, [{', '.join(str(i / 100) for i in range(1, 100))}])) AS x,
            generate_subscripts(range(99), 1) AS i FROM {_GUESS}),
    p AS (SELECT prob, z, x FROM s JOIN g ON round(prob * 100) = i)
    SELECT CAST(prob AS DOUBLE) AS prob, {r('z', 'normal_quantile')}, {r('x', 'sample_quantile')},
      {r('(SELECT regr_slope(x, z) FROM p)', 'slope')}, {r('(SELECT regr_intercept(x, z) FROM p)', 'intercept')} FROM p""",
)
def _(spark, sf_dir):
    return rounded(charts.qq_points(charts.residuals(guessed(spark, sf_dir), "l_orderkey", PRICE, "guess")))


# ---- training and prediction ------------------------------------------------------------------


@query(
    "train_test_split",
    f"{_SITES} SELECT site_id, balance, events_1995, {bucket_sql('site_id', 10_000)} < 8000 AS is_train FROM sites",
)
def _(spark, sf_dir):
    return regression.mark_split(sites(spark, sf_dir).select("site_id", "balance", "events_1995"), "site_id")


def _fit_and_measure(spark, sf_dir, name):
    _, metrics = regression.train_regressor(
        site_rows(spark, sf_dir), "site_id", SITE_FEATURES, SITE_TARGET, name, trees=TREES
    )
    return metrics.select(F.lit(name).alias("model"), "*")


@query("train_regressor")
def _(spark, sf_dir):
    _, metrics = regression.train_regressor(lines(spark, sf_dir), "line_key", LINE, PRICE, trees=TREES)
    return metrics


@query("model_random_forest")
def _(spark, sf_dir):
    return _fit_and_measure(spark, sf_dir, "random_forest")


@query("model_gbt")
def _(spark, sf_dir):
    return _fit_and_measure(spark, sf_dir, "gradient_boosting")


@query("model_adaboost")
def _(spark, sf_dir):
    return _fit_and_measure(spark, sf_dir, "adaboost")


@query("model_tree")
def _(spark, sf_dir):
    return _fit_and_measure(spark, sf_dir, "decision_tree")


def _one_feature_terms(spark, sf_dir, name, digits):
    rows = table(spark, sf_dir, "lineitem", ["l_quantity", PRICE])
    model = regression.scaled_pipeline(["l_quantity"], regression.make_regressor(name, PRICE)).fit(rows)
    return rounded(regression.linear_terms(model, ["l_quantity"], rows), digits)


def _terms_sql(slope: str, digits: int) -> str:
    """Intercept and slope of a one-feature fit, given the slope."""
    return f"""WITH s AS (SELECT avg(l_quantity) AS mx, avg({PRICE}) AS my, stddev_pop(l_quantity) AS sx, count(*) AS n,
      covar_pop({PRICE}, l_quantity) AS c FROM lineitem), w AS (SELECT *, {slope} AS slope FROM s)
      SELECT 'intercept' AS term, {r('my - slope * mx', 'value', digits)} FROM w
      UNION ALL SELECT 'l_quantity', {r('slope', 'value', digits)} FROM w"""


@query("model_linear", _terms_sql("c / (sx * sx)", 3))
def _(spark, sf_dir):
    return _one_feature_terms(spark, sf_dir, "linear_regression", 3)


@query("model_ridge", _terms_sql("n * c / sx / (n + 1.0) / sx", 3))
def _(spark, sf_dir):
    return _one_feature_terms(spark, sf_dir, "ridge", 3)


@query("model_lasso", _terms_sql("sign(c) * greatest(abs(c / sx) - 1.0, 0) / sx", 1))
def _(spark, sf_dir):
    return _one_feature_terms(spark, sf_dir, "lasso", 1)


def _site_model(spark, sf_dir):
    rows = drop_missing(open_site_rows(spark, sf_dir), [*SITE_FEATURES, SITE_TARGET])
    regressor = regression.make_regressor("random_forest", SITE_TARGET, trees=TREES)
    return regression.scaled_pipeline(SITE_FEATURES, regressor).fit(rows)


@query(
    "batch_predict",
    f"""{_SITES}, m AS (SELECT regr_slope(events_2000, events_1995) AS b, regr_intercept(events_2000, events_1995) AS a
      FROM sites WHERE events_1995 IS NOT NULL AND events_2000 IS NOT NULL)
    SELECT site_id, {r('a + b * events_1995', 'prediction')} FROM sites, m""",
)
def _(spark, sf_dir):
    rows = materialised(sites(spark, sf_dir).select("site_id", "events_1995", "events_2000"), "model-rows")
    regressor = regression.make_regressor("linear_regression", "events_2000")
    complete = drop_missing(rows, ["events_1995", "events_2000"])
    model = regression.scaled_pipeline(["events_1995"], regressor).fit(complete)
    return rounded(regression.batch_predict(model, rows, "site_id", ["events_1995"]))


@query("model_save_load", f"{_SITES} SELECT site_id, true AS same FROM sites")
def _(spark, sf_dir):
    model = _site_model(spark, sf_dir)
    stored = sinks.load_model(spark, sinks.save_model(model, scratch_path(spark, "model")))
    rows = sites(spark, sf_dir)
    before = regression.batch_predict(model, rows, "site_id", SITE_FEATURES)
    after = regression.batch_predict(stored, rows, "site_id", SITE_FEATURES)
    both = before.withColumnRenamed("prediction", "before").join(
        after.withColumnRenamed("prediction", "after"), "site_id"
    )
    return both.select("site_id", F.col("before").eqNullSafe(F.col("after")).alias("same"))


def _voting():
    names = ("random_forest", "gradient_boosting", "adaboost")
    return VotingRegressor({n: regression.make_regressor(n, SITE_TARGET, trees=TREES) for n in names})


def _stacking():
    names = ("random_forest", "decision_tree", "linear_regression")
    members = {n: regression.make_regressor(n, SITE_TARGET, trees=TREES) for n in names}
    return StackingRegressor(members, SITE_TARGET)


@query("voting_ensemble")
def _(spark, sf_dir):
    rows = site_rows(spark, sf_dir)
    model = regression.scaled_pipeline(SITE_FEATURES, _voting()).fit(rows)
    return model.transform(rows).select("site_id", quoted(SITE_TARGET), "prediction")


@query("stacking_ensemble")
def _(spark, sf_dir):
    rows = regression.mark_folds(site_rows(spark, sf_dir), "site_id")
    model = regression.scaled_pipeline(SITE_FEATURES, _stacking()).fit(rows)
    return model.transform(rows).select("site_id", quoted(SITE_TARGET), "prediction")


@query(
    "composite_save_load",
    f"""{_SITES} SELECT site_id, model, true AS same FROM sites,
    (VALUES ('adaboost'), ('stacking'), ('voting')) AS m(model)""",
)
def _(spark, sf_dir):
    # Predictions of each composed model before it is stored and after it is read back; the boosted trees are the voting's.
    rows = regression.mark_folds(site_rows(spark, sf_dir), "site_id")
    voting = regression.scaled_pipeline(SITE_FEATURES, _voting()).fit(rows)
    boosted = PipelineModel([*voting.stages[:-1], voting.stages[-1].members["adaboost"]])
    stacking = regression.scaled_pipeline(SITE_FEATURES, _stacking()).fit(rows)
    parts = []
    for name, model in (("adaboost", boosted), ("stacking", stacking), ("voting", voting)):
        stored = sinks.load_model(spark, sinks.save_model(model, scratch_path(spark, "model")))
        before = model.transform(rows).select("site_id", *SITE_FEATURES, F.col("prediction").alias("before"))
        both = stored.transform(before)
        parts.append(
            both.select("site_id", F.lit(name).alias("model"), F.col("before").eqNullSafe(F.col("prediction")).alias("same"))
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- tuning and comparison --------------------------------------------------------------------


@query("cross_validate")
def _(spark, sf_dir):
    estimator = tuning.forest_of({"n_estimators": TREES}, SITE_TARGET)
    return tuning.cross_validate(site_rows(spark, sf_dir), "site_id", SITE_FEATURES, SITE_TARGET, estimator)


# One feature and a straight line: every fold has a closed form.
_FOLDED = f"""{_SITES}, d AS (SELECT coalesce(events_1995, 0) AS x, coalesce(balance, 0) AS y, {bucket_sql('site_id', 5)} AS fold FROM sites),
  m AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM range(5) f(fold) JOIN d ON d.fold <> f.fold GROUP BY f.fold),
  s AS (SELECT d.fold, avg((y - a - b * x) ^ 2) AS mse, avg(abs(y - a - b * x)) AS mae, var_pop(y) AS v FROM d JOIN m USING (fold) GROUP BY d.fold),
  l AS (SELECT 'r2' AS metric, fold, 1 - mse / v AS score FROM s UNION ALL SELECT 'neg_mean_squared_error', fold, -mse FROM s
        UNION ALL SELECT 'neg_mean_absolute_error', fold, -mae FROM s)"""


@query(
    "cross_validate_line",
    f"""{_FOLDED} SELECT metric, CAST(fold AS INTEGER) AS fold, {r('score', 'score')}, {r('avg(score) OVER w', 'mean')},
    {r('stddev_pop(score) OVER w', 'std')} FROM l WINDOW w AS (PARTITION BY metric)""",
)
def _(spark, sf_dir):
    rows = fill_constant(sites(spark, sf_dir).select("site_id", "events_1995", "balance"), 0)
    estimator = LinearRegression(labelCol="balance", featuresCol="features", solver="normal")
    return rounded(tuning.cross_validate(rows, "site_id", ["events_1995"], "balance", estimator))


@query("grid_search")
def _(spark, sf_dir):
    rows = site_rows(spark, sf_dir)
    return tuning.search_table(rows, tuning.grid_search(rows, "site_id", SITE_FEATURES, SITE_TARGET))


@query("random_search")
def _(spark, sf_dir):
    rows = site_rows(spark, sf_dir)
    return tuning.search_table(rows, tuning.random_search(rows, "site_id", SITE_FEATURES, SITE_TARGET))


@query("adaptive_search")
def _(spark, sf_dir):
    rows = site_rows(spark, sf_dir)
    return tuning.search_table(rows, tuning.adaptive_search(rows, "site_id", SITE_FEATURES, SITE_TARGET))


@query("compare_models")
def _(spark, sf_dir):
    return tuning.compare_models(site_rows(spark, sf_dir), "site_id", SITE_FEATURES, SITE_TARGET)


@query("model_comparison_table")
def _(spark, sf_dir):
    found = linear_folds.compare_linear(site_rows(spark, sf_dir), "site_id", SITE_FEATURES, SITE_TARGET)
    return charts.comparison_table(found)


_LINE_SLOPES = {
    "linear_regression": "c / (sx * sx)",
    "ridge": "n * c / sx / (n + 1.0) / sx",
    "lasso": "sign(c) * greatest(abs(c / sx) - 1.0, 0) / sx",
}


@query(
    "model_comparison_line",
    f"""{_SITES}, d AS (SELECT coalesce(events_1995, 0) AS x, coalesce(balance, 0) AS y, {bucket_sql('site_id', 5)} AS fold FROM sites),
  s AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, count(*) AS n, covar_pop(y, x) AS c
        FROM range(5) f(fold) JOIN d ON d.fold <> f.fold GROUP BY f.fold),
  m AS ({union_all([f"SELECT '{name}' AS model, fold, mx, my, {slope} AS b FROM s" for name, slope in _LINE_SLOPES.items()])}),
  e AS (SELECT model, d.fold, 1 - avg((y - my - b * (x - mx)) ^ 2) / var_pop(y) AS score FROM d JOIN m USING (fold) GROUP BY model, d.fold)
  SELECT model, {r('avg(score)', 'score', 6)}, {r('stddev_pop(score)', 'spread', 6)} FROM e GROUP BY model""",
)
def _(spark, sf_dir):
    rows = fill_constant(sites(spark, sf_dir).select("site_id", "events_1995", "balance"), 0)
    found = linear_folds.compare_linear(rows, "site_id", ["events_1995"], "balance")
    return rounded(charts.comparison_table(found), 6)


@query("learning_curve")
def _(spark, sf_dir):
    return linear_folds.linear_learning_curve(site_rows(spark, sf_dir), "site_id", SITE_FEATURES, SITE_TARGET)


@query(
    "learning_curve_line",
    f"""{_SITES}, d AS (SELECT coalesce(events_1995, 0) AS x, coalesce(balance, 0) AS y, {bucket_sql('site_id', 5)} AS fold,
      {bucket_sql('site_id', 10000, 43)} AS share FROM sites),
  m AS (SELECT i, f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS train, count(*) AS n
        FROM range(1, 11) p(i), range(5) f(fold), d WHERE d.fold <> f.fold AND d.share < i * 1000 GROUP BY i, f.fold),
  e AS (SELECT i, m.fold, any_value(train) AS train, any_value(n) AS n, 1 - avg((y - a - b * x) ^ 2) / var_pop(y) AS valid
        FROM m JOIN d USING (fold) GROUP BY i, m.fold)
  SELECT CAST(i AS DOUBLE) / 10 AS fraction, {r('avg(n)', 'train_rows', 6)}, {r('avg(train)', 'train_mean', 6)},
    {r('stddev_pop(train)', 'train_std', 6)}, {r('avg(valid)', 'valid_mean', 6)}, {r('stddev_pop(valid)', 'valid_std', 6)}
  FROM e GROUP BY i""",
)
def _(spark, sf_dir):
    rows = fill_constant(sites(spark, sf_dir).select("site_id", "events_1995", "balance"), 0)
    return rounded(linear_folds.linear_learning_curve(rows, "site_id", ["events_1995"], "balance"), 6)


@query("model_workflow")
def _(spark, sf_dir):
    path = scratch_path(spark, "workflow-model")
    return modelling.long_form(
        modelling.model_workflow(open_site_rows(spark, sf_dir), "site_id", SITE_FEATURES, SITE_TARGET, path)
    )


# ---- clustering -------------------------------------------------------------------------------


@query(
    "cluster_features",
    f"""{_FLAGGED}, t AS (SELECT site_id, balance, events_1995, events_2001,
      CASE bathing_flag WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS b,
      CASE priority_flag WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS p FROM sites_flagged),
    m AS (SELECT quantile_cont(events_1995, 0.5) AS m1, quantile_cont(events_2001, 0.5) AS m2,
      quantile_cont(b, 0.5) AS mb, quantile_cont(p, 0.5) AS mp FROM t)
    SELECT site_id, balance, coalesce(events_1995, m1) AS events_1995, coalesce(events_2001, m2) AS events_2001,
      CAST(coalesce(b, mb) AS DOUBLE) AS bathing_flag, CAST(coalesce(p, mp) AS DOUBLE) AS priority_flag FROM t, m""",
)
def _(spark, sf_dir):
    optional = ["events_2001", "trend", "bathing_flag", "priority_flag"]
    return clusters.cluster_features(sites_flagged(spark, sf_dir), "site_id", ["balance", "events_1995"], optional, "flag")


def _centre(prefix: str = "") -> str:
    return " + ".join(f"({prefix}{d} - c.{d}) ^ 2" for d in DIMS)


@query(
    "cluster_metrics",
    f"""WITH v AS ({_VECTORS} FROM embeddings),
    c AS (SELECT label, count(*) AS n, {', '.join(f'avg({d}) AS {d}' for d in DIMS)} FROM v GROUP BY label),
    w AS (SELECT v.label, avg(sqrt({_centre('v.')})) AS s, sum({_centre('v.')}) AS inside
          FROM v JOIN c ON v.label = c.label GROUP BY v.label),
    g AS (SELECT {', '.join(f'avg({d}) AS {d}' for d in DIMS)}, count(*) AS n FROM v),
    pairs AS (SELECT a.label, max((wa.s + wc.s) / sqrt({_centre('a.')})) AS worst FROM c a JOIN c ON a.label <> c.label
              JOIN w wa ON wa.label = a.label JOIN w wc ON wc.label = c.label GROUP BY a.label),
    between_ AS (SELECT sum(c.n * ({_centre('g.')})) AS b FROM c, g)
    SELECT (SELECT count(*) FROM c) AS clusters, {r('(SELECT avg(worst) FROM pairs)', 'davies_bouldin')},
      {r('''(SELECT b FROM between_) / ((SELECT count(*) FROM c) - 1) /
         ((SELECT sum(inside) FROM w) / ((SELECT n FROM g) - (SELECT count(*) FROM c)))''', 'calinski_harabasz')}""",
)
def _(spark, sf_dir):
    return rounded(clusters.separation(vectors(spark, sf_dir), DIMS, "label"))


_NORM = " + ".join(f"{d} * {d}" for d in DIMS)
_DOT = " + ".join(f"v.{d} * c.{d}" for d in DIMS)


@query(
    "cluster_silhouette",
    f"""WITH v AS (SELECT *, {_NORM} AS norm FROM ({_VECTORS} FROM embeddings) q),
    c AS (SELECT label, count(*) AS n, sum(norm) AS norms, {', '.join(f'sum({d}) AS {d}' for d in DIMS)} FROM v GROUP BY label),
    d AS (SELECT v.vec_id, v.label = c.label AS own, c.n,
            (c.n * v.norm + c.norms - 2 * ({_DOT})) / (CASE WHEN v.label = c.label THEN c.n - 1 ELSE c.n END) AS far
          FROM v, c WHERE NOT (v.label = c.label AND c.n = 1)),
    s AS (SELECT vec_id, min(far) FILTER (NOT own) AS b, max(far) FILTER (own) AS a FROM d GROUP BY vec_id),
    t AS (SELECT count(*) AS n, avg(coalesce((b - a) / greatest(a, b), 0)) AS score FROM s)
    SELECT n, {r('score', 'silhouette_squared')}, CASE WHEN score > 0.7 THEN 'Excellent' WHEN score > 0.5 THEN 'Good'
      WHEN score > 0.3 THEN 'Fair' ELSE 'Poor' END AS quality FROM t""",
)
def _(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    score = F.lit(clusters.silhouette(rows, DIMS, "label"))
    sized = rows.agg(F.count("*").alias("n"))
    return rounded(sized.select("n", score.alias("silhouette_squared"), clusters.quality_label(score).alias("quality")))


@query(
    "cluster_quality_label",
    """SELECT CASE WHEN l_discount * 10 > 0.7 THEN 'Excellent' WHEN l_discount * 10 > 0.5 THEN 'Good'
    WHEN l_discount * 10 > 0.3 THEN 'Fair' ELSE 'Poor' END AS quality, count(*) AS n FROM lineitem GROUP BY quality""",
)
def _(spark, sf_dir):
    score = F.col("l_discount") * 10
    rows = table(spark, sf_dir, "lineitem", ["l_discount"])
    return rows.groupBy(clusters.quality_label(score).alias("quality")).agg(F.count("*").alias("n"))


SITE_AXES = ("balance", "events_1995", "events_2001")


def _cluster_rows(spark, sf_dir):
    return fill_constant(sites(spark, sf_dir).select("site_id", *SITE_AXES), 0, SITE_AXES)


@query("find_k")
def _(spark, sf_dir):
    rows = _cluster_rows(spark, sf_dir)
    chosen, curve = clusters.find_k(rows, SITE_AXES)
    return clusters.elbow_curve(rows, curve, chosen)


@query("elbow_curve")
def _(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    chosen, curve = clusters.find_k(rows, DIMS)
    return clusters.elbow_curve(rows, curve, chosen)


@query("assign_clusters")
def _(spark, sf_dir):
    return clusters.assign_clusters(_cluster_rows(spark, sf_dir), "site_id", SITE_AXES, k=4)


@query("cluster_profile")
def _(spark, sf_dir):
    assigned = clusters.assign_clusters(_cluster_rows(spark, sf_dir), "site_id", SITE_AXES, k=4)
    return clusters.cluster_profile(assigned, SITE_AXES)


@query("cluster_workflow")
def _(spark, sf_dir):
    return modelling.long_form(
        modelling.cluster_workflow(sites_flagged(spark, sf_dir), "site_id", ["balance", "events_1995"], ["events_2001"])
    )
