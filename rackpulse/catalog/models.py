"""Evaluation, regression, neighbours, classifiers and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from rackpulse.catalog import tables as t
from rackpulse.catalog.tables import SAMPLES, fixed, sql_cpu_class, sql_fixed
from rackpulse.functions.status import cpu_load_class
from rackpulse.models import estimators
from rackpulse.operators import evaluate, neighbours, profile

CLASSES = (0, 1)
EMBEDDING_SIZE = 64
# Small enough that the given tables fill several blocks, so routing and merging run too.
KNN_BLOCK_ROWS = 128

# -- evaluation --------------------------------------------------------------------


def _outcomes(spark, d):
    """Quality as the actual class, toxicity as the predicted one."""
    return evaluate.outcome_counts(t.read(spark, d, "labels"), "quality", "toxic")


def confusion_percent(spark, d):
    rows = evaluate.confusion_percent(_outcomes(spark, d), (0, 1, 2))
    return rows.select("actual", "predicted", "n", fixed("pct").alias("pct"))


CONFUSION = f"""
WITH g AS (SELECT * FROM (VALUES (0), (1), (2)) a(actual), (VALUES (0), (1), (2)) p(predicted)),
tot AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT g.actual, g.predicted, count(l.doc_id) AS n, {sql_fixed('count(l.doc_id) * 100.0::DOUBLE / any_value(tot.n)')} AS pct
FROM g LEFT JOIN labels l ON l.quality = g.actual AND l.toxic = g.predicted LEFT JOIN tot ON tot.quality = g.actual
GROUP BY 1, 2"""


def accuracy(spark, d):
    return evaluate.accuracy(_outcomes(spark, d)).select(fixed("accuracy", 6).alias("accuracy"))


def one_vs_rest_auc(spark, d):
    rows = evaluate.one_vs_rest_auc(_outcomes(spark, d), (0, 1, 2))
    return rows.select("class", fixed("auc", 6).alias("auc"))


def _sql_auc(c: int) -> str:
    hits = f"count(*) FILTER (quality = {c} AND toxic = {c}) * 1.0::DOUBLE / count(*) FILTER (quality = {c})"
    misses = f"count(*) FILTER (quality <> {c} AND toxic <> {c}) * 1.0::DOUBLE / count(*) FILTER (quality <> {c})"
    return f"SELECT {c} AS class, {sql_fixed(f'({hits} + {misses}) / 2', 6)} AS auc FROM labels"


def _priced(spark, d):
    """List price by quantity as a prediction of the extended price."""
    return t.read(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("load"), (F.col("l_quantity") * 1500).alias("prediction"), "l_quantity",
    )


def regression_metrics(spark, d):
    row = evaluate.regression_metrics(_priced(spark, d), "load", "prediction", 1)
    return row.select("n", *[fixed(c, 5).alias(c) for c in ("rmse", "mae", "r2", "adjr2")])


REGRESSION = f"""
WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem),
f AS (SELECT count(*) AS n, sum((y - p) * (y - p)) AS sse, avg(abs(y - p)) AS mae, var_pop(y) * count(*) AS sst FROM e)
SELECT n, {sql_fixed('sqrt(sse / n)', 5)} AS rmse, {sql_fixed('mae', 5)} AS mae, {sql_fixed('1 - sse / sst', 5)} AS r2,
  {sql_fixed('1 - (sse / sst) * (n - 1) / (n - 2)', 5)} AS adjr2 FROM f"""


def experiment_median(spark, d):
    """Median accuracy over the labels of each source, taken as experiments."""
    labels = t.read(spark, d, "labels").join(t.read(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    runs = labels.groupBy("source", "lang").agg(
        F.avg((F.col("quality") == F.col("toxic")).cast("double")).alias("accuracy"), F.count("*").cast("double").alias("size")
    )
    medians = evaluate.experiment_medians(runs, ["lang"], ["accuracy", "size"])
    return medians.select("lang", fixed("accuracy", 6).alias("accuracy"), fixed("size").alias("size"))


EXPERIMENT_MEDIAN = f"""
WITH r AS (SELECT source, lang, avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*) AS size
  FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT lang, {sql_fixed('median(accuracy)', 6)} AS accuracy, {sql_fixed('median(size)')} AS size FROM r GROUP BY 1"""


def outcome_buckets(spark, d):
    rows = t.read(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("actual"), (F.col("l_linestatus") == "F").cast("int").alias("predicted"),
        (F.col("l_extendedprice") / 100).alias("cpu_power"),
    )
    found = profile.outcome_buckets(rows, "actual", "predicted", "cpu_power", 50.0)
    return found.select("actual", "predicted", "bucket", "n", fixed("low").alias("low"), fixed("high").alias("high"))


OUTCOME_BUCKETS = f"""
SELECT CAST(l_returnflag = 'R' AS INT) AS actual, CAST(l_linestatus = 'F' AS INT) AS predicted,
  CAST(floor(l_extendedprice / 100 / 50) AS BIGINT) AS bucket, count(*) AS n,
  {sql_fixed('min(l_extendedprice / 100)')} AS low, {sql_fixed('max(l_extendedprice / 100)')} AS high
FROM lineitem GROUP BY 1, 2, 3"""

# -- fitted models --------------------------------------------------------------------


def _line(spark, d):
    return t.read(spark, d, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("load"))


def _coefficients(spark, model):
    last = model.pipeline.stages[-1]
    frame = spark.createDataFrame([(float(last.coefficients[0]), float(last.intercept))], "slope double, intercept double")
    return frame.select(fixed("slope").alias("slope"), fixed("intercept", 3).alias("intercept"))


def ols_fit(spark, d):
    return _coefficients(spark, estimators.fit(_line(spark, d), "reg", "lir", ["l_quantity"], "load"))


def ridge_fit(spark, d):
    return _coefficients(spark, estimators.fit(_line(spark, d), "reg", "rir", ["l_quantity"], "load"))


def _sql_fit(alpha: float) -> str:
    slope = f"(covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + {alpha}))"
    return f"""
SELECT {sql_fixed('slope')} AS slope, {sql_fixed('my - slope * mx', 3)} AS intercept
FROM (SELECT {slope} AS slope, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem) f"""


def gaussian_bayes(spark, d):
    """Predicted class of every sample, counted per actual class."""
    rows = t.samples(spark, d).select(
        (F.col("power_px") - 1).alias("overall_power"), "exhaust_temp",
        cpu_load_class("cpuload_total", 4.0).cast("double").alias("load"),
    )
    model = estimators.fit(rows, "multi", "nbc", ["overall_power", "exhaust_temp"], "load")
    return evaluate.outcome_counts(model.transform(rows), "load", "prediction")


GAUSSIAN_BAYES = f"""
WITH {SAMPLES}, s AS (
  SELECT row_number() OVER () AS id, power_px - 1 AS x1, exhaust_temp AS x2,
    {sql_cpu_class('cpuload_total', 4.0)} AS load FROM smp),
eps AS (SELECT 1e-9::DOUBLE * greatest(var_pop(x1), var_pop(x2)) AS e FROM s),
c AS (SELECT load AS k, ln(count(*) / (SELECT count(*) FROM s)::DOUBLE) AS prior, avg(x1) AS m1, avg(x2) AS m2,
  var_pop(x1) + any_value(e) AS v1, var_pop(x2) + any_value(e) AS v2 FROM s, eps GROUP BY 1),
p AS (SELECT id, arg_max(k, prior - 0.5::DOUBLE * (ln(v1) + (x1 - m1) * (x1 - m1) / v1 + ln(v2) + (x2 - m2) * (x2 - m2) / v2)) AS predicted
  FROM s, c GROUP BY id)
SELECT s.load AS actual, p.predicted, count(*) AS n FROM s JOIN p USING (id) GROUP BY 1, 2"""


def _vectors(spark, d):
    return t.read(spark, d, "embeddings")


def knn_classify(spark, d):
    """Every vector classified by its five nearest, itself included as in a training score."""
    v = _vectors(spark, d)
    found = neighbours.nearest_neighbours(v, v, "vec_id", "vec_id", "embedding", "label", estimators.NEIGHBOURS_CLASS, KNN_BLOCK_ROWS)
    return neighbours.vote(found).select(F.col("query_id").alias("vec_id"), F.col("prediction").cast("int").alias("prediction"))


def knn_regress(spark, d):
    v = _vectors(spark, d)
    found = neighbours.nearest_neighbours(v, v, "vec_id", "vec_id", "embedding", "label", estimators.NEIGHBOURS_REG, KNN_BLOCK_ROWS)
    return neighbours.mean_label(found).select(F.col("query_id").alias("vec_id"), fixed("prediction", 6).alias("prediction"))


_NEAREST = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rn
  FROM v a CROSS JOIN v b)"""
KNN_CLASSIFY = f"""{_NEAREST},
c AS (SELECT vec_id, label, count(*) AS n FROM r WHERE rn <= 5 GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS best FROM c)
SELECT vec_id, label AS prediction FROM w WHERE best = 1"""
KNN_REGRESS = f"""{_NEAREST}
SELECT vec_id, {sql_fixed('avg(label)', 6)} AS prediction FROM r WHERE rn <= 11 GROUP BY 1"""


def _named_vectors(spark, d):
    rows = estimators.vector_features(_vectors(spark, d), "embedding", EMBEDDING_SIZE)
    return rows.withColumn("label", F.col("label").cast("double")), [f"f{i}" for i in range(EMBEDDING_SIZE)]


def _classifier(method: str):
    """Binary task for the trees, four classes for the logistic fits, the two class tasks there are."""
    ctype = "multi" if method == "lor" else "binary"

    def run(spark, d):
        rows, names = _named_vectors(spark, d)
        classes = F.least("label", F.lit(3.0)) if ctype == "multi" else (F.col("label") > 4).cast("double")
        rows = rows.withColumn("label", classes)
        model = estimators.fit(rows, ctype, method, names, "label")
        return evaluate.outcome_counts(model.transform(rows), "label", "prediction")

    return run


def _regressor(method: str):
    def run(spark, d):
        rows, names = _named_vectors(spark, d)
        model = estimators.fit(rows, "reg", method, names, "label")
        return evaluate.regression_metrics(model.transform(rows), "label", "prediction", len(names))

    return run


def svr_poly(spark, d):
    """Cubic fit of event values on three features."""
    rows = t.read(spark, d, "events").select(
        F.col("value").alias("load"), F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.hour("ts").cast("double").alias("hour"), (F.length("event_type") * 1.0).alias("kind"),
    )
    names = ["k", "hour", "kind"]
    model = estimators.fit(rows, "reg", "svr_poly", names, "load")
    return evaluate.regression_metrics(model.transform(rows), "load", "prediction", len(names))


# -- fits on one half of the events, predictions of the other half, held against the rule the target follows --------


def _halves(spark, d, target):
    """Events with features and a target by a known rule; even ids train, odd ids are predicted."""
    k = F.get_json_object("props", "$.k").cast("int")
    group = F.floor(k / 25)
    rows = t.read(spark, d, "events").select(
        "event_id", F.floor(k / 10).cast("double").alias("tens"), F.hour("ts").cast("double").alias("hour"),
        *[(F.when(group == i, 10.0).otherwise(0.0) + k / 100.0).alias(f"g{i}") for i in range(4)], F.col("value").alias("x"),
    ).withColumn("label", target)
    return rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")


def _axis_rule():
    return ((F.col("tens") >= 4) & (F.col("hour") < 12)) | (F.col("tens") == 9)


def _ruled(method: str, ctype: str, names: tuple[str, ...], target):
    def run(spark, d):
        train, test = _halves(spark, d, target())
        model = estimators.fit(train, ctype, method, list(names), "label")
        return model.transform(test).select("event_id", F.col("prediction").cast("int").alias("predicted"))

    return run


def _sql_ruled(rule: str) -> str:
    return f"""
WITH e AS (SELECT event_id, hour(ts) AS h, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_id % 2 = 1)
SELECT event_id, CAST({rule} AS INT) AS predicted FROM e"""


SQL_AXIS_RULE = "CASE WHEN (k >= 40 AND h < 12) OR k >= 90 THEN 1 ELSE 0 END"


def _line_fit(method: str, target):
    """Robust fit of an exact relation: every prediction must lie within a hundredth of the target's range."""
    def run(spark, d):
        train, test = _halves(spark, d, target())
        model = estimators.fit(train, "reg", method, ["tens"], "label")
        scored = model.transform(test)
        width = train.agg(F.max("label") - F.min("label")).scalar()
        return scored.select("event_id", (F.abs(F.col("prediction") - F.col("label")) <= width / 100).alias("near"))

    return run


NEAR = "SELECT event_id, true AS near FROM events WHERE event_id % 2 = 1"

QUERIES = {
    "confusion_percent": (confusion_percent, CONFUSION),
    "accuracy": (
        accuracy,
        f"SELECT {sql_fixed('avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END)', 6)} AS accuracy FROM labels",
    ),
    "one_vs_rest_auc": (one_vs_rest_auc, f"{_sql_auc(0)} UNION ALL {_sql_auc(1)}"),
    "regression_metrics": (regression_metrics, REGRESSION),
    "experiment_median": (experiment_median, EXPERIMENT_MEDIAN),
    "outcome_buckets": (outcome_buckets, OUTCOME_BUCKETS),
    "ols_fit": (ols_fit, _sql_fit(0.0)),
    "ridge_fit": (ridge_fit, _sql_fit(estimators.RIDGE_ALPHA)),
    "gaussian_bayes": (gaussian_bayes, GAUSSIAN_BAYES),
    "knn_classify": (knn_classify, KNN_CLASSIFY),
    "knn_regress": (knn_regress, KNN_REGRESS),
    "logistic_regression": (_classifier("lor"), None),
    "decision_tree": (_classifier("dt"), None),
    "random_forest": (_classifier("rf"), None),
    "svr_linear": (_regressor("svr_lin"), None),
    "svr_poly": (svr_poly, None),
    "svr_rbf": (_regressor("svr_rbf"), None),
    "decision_tree_rule": (_ruled("dt", "binary", ("tens", "hour"), lambda: _axis_rule().cast("double")), _sql_ruled(SQL_AXIS_RULE)),
    "random_forest_rule": (_ruled("rf", "binary", ("tens", "hour"), lambda: _axis_rule().cast("double")), _sql_ruled(SQL_AXIS_RULE)),
    "logistic_rule": (
        _ruled("lor", "multi", ("g0", "g1", "g2", "g3"), lambda: sum((F.when(F.col(f"g{i}") >= 10, i).otherwise(0) for i in range(4)), F.lit(0)).cast("double")),
        _sql_ruled("k // 25"),
    ),
    "svr_linear_line": (_line_fit("svr_lin", lambda: F.col("tens") * 3 + 7), NEAR),
    "svr_poly_cubic": (_line_fit("svr_poly", lambda: F.col("tens") * F.col("tens") * F.col("tens") / 10 - F.col("tens")), NEAR),
}
