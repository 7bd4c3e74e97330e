"""The forest: the same trees whichever way they grow, splits beside plain loops, whole work on rows of no pattern."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rackpulse.models import estimators, forest

NAMES = ["a", "b", "c", "d"]


def noise(spark, n, classes=3):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(n, 3)), rng.integers(0, classes, n)
    rows = [(*map(float, v), float(i % 7), float(k)) for i, (v, k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*NAMES, "y"])).repartition(3)


def fitted(df, monkeypatch, together=50_000, at_once=1 << 27, trees=6):
    monkeypatch.setattr(estimators, "TREES", trees)
    monkeypatch.setattr(forest, "TOGETHER", together)
    monkeypatch.setattr(forest, "COUNT_BYTES", at_once)
    return estimators.fit(df, "multi", "rf", NAMES, "y")


def predicted(model, df):
    return sorted(tuple(r) for r in model.transform(df).collect())


def test_trees_are_the_same_grown_by_levels_or_by_rows(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "rows")
    noise(spark, 600).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    whole = fitted(df, monkeypatch)
    unseen = noise(spark, 900).where("a > 0").withColumn("b", F.col("b") / 2)
    expected, gains = predicted(whole, unseen), whole.importances()
    for together, at_once in ((60, 1 << 27), (150, 1 << 17)):
        model = fitted(df, monkeypatch, together, at_once)
        assert model.pipeline.stages[-1].trees.where("root > 0").count() > 12
        assert predicted(model, unseen) == expected
        assert model.importances() == pytest.approx(gains)


def test_rows_without_a_pattern_are_learned_whole(spark, monkeypatch):
    df = noise(spark, 1500).withColumn("y", F.least("y", F.lit(1.0)))
    model = fitted(df, monkeypatch, trees=40)
    # A row that few trees have drawn may be outvoted.
    assert model.transform(df).where("prediction <> y").count() < 15
    # The trees are a table; a node costs its rows, not a table of all bins.
    sizes = model.pipeline.stages[-1].trees.where("root > 0").select(F.size("feature").alias("n"))
    assert sizes.agg(F.count("*"), F.min("n") > 300).first() == (40, True)
    assert sum(model.importances().values()) == pytest.approx(1.0)


def test_repeated_rows_count_as_often_as_they_come(spark, monkeypatch):
    rows = [(1.0, 0.0, 0.0, 0.0, 0.0)] * 30 + [(1.0, 0.0, 0.0, 0.0, 1.0)] * 90 + [(2.0, 0.0, 0.0, 0.0, 0.0)] * 40
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*NAMES, "y"]))
    found = fitted(df, monkeypatch, trees=15).transform(df).groupBy("a", "prediction").count().collect()
    assert {tuple(r) for r in found} == {(1.0, 1.0, 120), (2.0, 0.0, 40)}


def test_first_split_equals_plain_loops():
    rng = np.random.default_rng(2)
    bins, y, w = rng.integers(0, 9, (80, 3)).astype(np.uint8), rng.integers(0, 3, 80), rng.integers(1, 4, 80).astype(float)
    feature, split, left, votes, _ = forest.grow(bins, y, w, 0, 1, 3, 30, 3, 30)
    gini = lambda at: sum(w[at & (y == c)].sum() ** 2 for c in range(3)) / w[at].sum()
    best = max((gini(bins[:, f] <= s) + gini(bins[:, f] > s), -f, -s) for f in range(3) for s in range(8))
    assert (feature[0], split[0], left[0]) == (-best[1], -best[2], 1)
    assert votes[0] == pytest.approx([w[y == c].sum() / w.sum() for c in range(3)])
    assert len(forest.grow(bins, y, w, 0, 1, 3, 30, 3, 2)[0]) <= 7


def test_saved_forest_predicts_the_same(spark, monkeypatch, tmp_path):
    df = noise(spark, 300)
    model = fitted(df, monkeypatch, together=50)
    model.save(str(tmp_path / "model"))
    again = estimators.load(str(tmp_path / "model"), NAMES, "y")
    assert predicted(again, df) == predicted(model, df) and again.importances() == pytest.approx(model.importances())
    assert again.transform(df.limit(0)).count() == 0


@pytest.mark.parametrize("label", [None, -1.0, 0.5])
def test_labels_must_be_classes(spark, label):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, label)], "a double, y double")
    assembled = estimators.VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    with pytest.raises(Exception, match="labels must be"):
        forest.Forest(labelCol="y", featuresCol="features", predictionCol="prediction", numTrees=2).fit(assembled)
