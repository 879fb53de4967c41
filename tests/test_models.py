"""Classifiers, tuning, importance, jobs and stream scoring."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from discern.operators import classifiers as C
from discern.operators import tuning
from discern.operators.importance import permutation_importance, tree_importances, with_donor
from discern.operators.split import with_fold
from discern.plans import inputs as I
from discern.plans.jobs import deep_classifier, dense_multiclass, second_stage, sparse_binary
from discern.sources import read_libsvm, scratch_path, write_libsvm, write_split
from discern.streaming.scoring import score_stream, write_scores


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        label = i % 3
        x = rng.normal(size=4) + np.array([3.0 * (label == 0), 3.0 * (label == 1), 0, 0])
        rows.append((i, float(label), *x.tolist(), Vectors.dense(x)))
    df = spark.createDataFrame(rows, ["id", "label", "a", "b", "c", "d", "features"])
    return df.repartition(2).cache()


def test_linear_scores_follow_from_the_coefficients(blobs):
    model = C.classifier("logistic_regression", regParam=0.01).fit(blobs)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    for r in model.transform(blobs).limit(50).collect():
        raw = weights @ r.features.toArray() + bias
        assert np.allclose(r.rawPrediction.toArray(), raw) and r.prediction == raw.argmax()


def test_logistic_gradient_vanishes(blobs):
    model = C.classifier("logistic_regression", maxIter=500, tol=1e-10).fit(blobs)
    rows = model.transform(blobs).collect()
    x = np.array([r.features.toArray() for r in rows])
    residual = np.array([r.probability.toArray() for r in rows])
    residual[np.arange(len(rows)), [int(r.label) for r in rows]] -= 1
    assert np.abs(residual.T @ x).max() / len(rows) < 1e-4


def test_naive_bayes_closed_form(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 5, size=(80, 6)).astype(float), np.arange(80) % 2
    rows = spark.createDataFrame([(float(c), Vectors.dense(v)) for c, v in zip(y, x)], ["label", "features"])
    model = C.classifier("naive_bayes").fit(rows)
    lam = 1e-4
    for c in (0, 1):
        s = x[y == c].sum(axis=0)
        assert model.pi[c] == pytest.approx(np.log(40 + lam) - np.log(80 + 2 * lam), abs=1e-12)
        assert np.allclose(model.theta.toArray()[c], np.log(s + lam) - np.log(s.sum() + 6 * lam), atol=1e-12)


def test_inputs_are_checked(spark, blobs):
    negative = spark.createDataFrame([(0.0, Vectors.dense(-1.0, 2.0)), (1.0, Vectors.dense(1.0, 2.0))], ["label", "features"])
    with pytest.raises(Exception, match="(?i)nonnegative|negative"):
        C.classifier("naive_bayes").fit(negative)
    with pytest.raises(Exception, match="(?i)label|class"):
        C.classifier("linear_svm").fit(blobs)
    with pytest.raises(ValueError, match="input layer"):
        C.check_layers(blobs, [5, 3, 2])
    with pytest.raises(ValueError, match="fold_width"):
        C.perceptron(spark.createDataFrame([(0.0, Vectors.sparse(3_231_949, [1], [1.0]))], ["label", "features"]), 2)
    with pytest.raises(Exception, match="label outside"):
        C.checked_labels(blobs, 2).collect()
    assert C.checked_labels(blobs, 3).count() == 300
    with pytest.raises(ValueError, match="unknown classifier"):
        C.classifier("oracle")


def test_perceptron_layers_and_parameter_counts(spark, blobs):
    assert C.perceptron_layers(blobs, (16, 32), 3) == [4, 16, 32, 3]
    shape = spark.createDataFrame([(4, 3)], "w int, c int")
    counts = {r.layer: r.n_params for r in C.layer_params(shape, "w", "c", (16, 32)).collect()}
    assert counts == {0: 80, 1: 544, 2: 99, -1: 723}
    model = C.perceptron(blobs, 3, (5,), maxIter=5).fit(blobs)
    assert model.weights.size == 5 * 5 + 6 * 3


def test_preset_grids_have_the_published_sizes():
    sizes = {"logistic_regression": 24, "decision_tree": 32, "random_forest": 108, "linear_svm": 8,
             "logistic_regression_sparse": 8, "random_forest_sparse": 32}
    for name, size in sizes.items():
        estimator = C.classifier("random_forest" if name == "random_forest_sparse" else name)
        assert len(tuning.preset_grid(estimator, name, "reference")) == size
        assert len(tuning.preset_grid(estimator, name)) <= 4


def test_cross_validation_equals_the_stock_one(blobs):
    tree = C.classifier("decision_tree")
    points = tuning.grid(tree, {"maxDepth": [1, 3], "impurity": ["gini", "entropy"]})
    mine = tuning.cross_validate(blobs, tree, points, ["id"], 3, refit=True)
    found = {r.point: r.avg_metric for r in mine.results.collect()}
    stock = CrossValidator(
        estimator=tree, estimatorParamMaps=points, evaluator=MulticlassClassificationEvaluator(metricName="f1"),
        numFolds=3, foldCol="fold",
    ).fit(with_fold(blobs, ["id"], 3))
    assert [found[i] for i in range(4)] == pytest.approx(stock.avgMetrics, abs=1e-12)
    best = max(range(4), key=lambda i: (stock.avgMetrics[i], -i))
    assert mine.results.filter("best").collect()[0].point == best
    assert mine.model.transform(blobs).filter("label = prediction").count() > 250


def test_stages_before_the_model_are_fitted_per_fold(blobs):
    pipeline = Pipeline(stages=[PCA(k=2, inputCol="features", outputCol="p"), C.classifier("decision_tree", featuresCol="p")])
    result = tuning.cross_validate(blobs, pipeline, tuning.grid(pipeline, {"maxDepth": [2, 4]}), ["id"], 3)
    assert result.results.count() == 2 and len(result.model.stages) == 2
    with pytest.raises(ValueError, match="last stage"):
        tuning.cross_validate(blobs, pipeline, [{pipeline.getStages()[0].k: 1}], ["id"], 3)
    with pytest.raises(ValueError, match="unknown metric"):
        tuning.cross_validate(blobs, pipeline, [{}], ["id"], 3, metric="luck")


def test_donor_is_a_permutation(blobs):
    rows = with_donor(blobs.select("id", "a", "b"), ["a", "b"], ["id"], buckets=4).collect()
    assert sorted((r.a, r.b) for r in rows) == sorted((r.donor_a, r.donor_b) for r in rows)
    assert sum(r.a == r.donor_a for r in rows) < 5


def test_donors_follow_the_hash_order_across_slices(spark):
    """The row before in the bucket's whole order, though only slices of a bucket are sorted by a task."""
    from hashlib import md5

    rows = spark.range(500).select("id", (F.col("id") * 3).alias("a"))
    donors = with_donor(rows, ["a"], ["id"], buckets=3, seed=8)
    expected, buckets = {}, {}
    for i in range(500):
        digest = md5(f"8:{i}".encode()).hexdigest()
        buckets.setdefault(int(digest[:8], 16) % 3, []).append((digest, i))
    for own in buckets.values():
        order = [i for _, i in sorted(own)]
        expected |= {i: 3 * order[k - 1] for k, i in enumerate(order)}
    assert {r.id: r.donor_a for r in donors.collect()} == expected
    windows = [line for line in donors._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line and "_order" in line]
    assert windows and all("_slice" in line for line in windows)
    twice = rows.unionAll(rows.withColumn("a", F.col("a") + 1)).unionAll(rows.limit(3))
    found = with_donor(twice, ["a"], ["id"], buckets=3).collect()
    assert sorted(r.a for r in found) == sorted(r.donor_a for r in found) and len(found) == 1003


def test_importances_find_the_columns_that_matter(blobs):
    model = C.classifier("random_forest", numTrees=10).fit(blobs)
    loss = {r.feature: r.importance for r in permutation_importance(blobs, model, ["a", "b", "c", "d"], ["id"]).collect()}
    assert min(loss["a"], loss["b"]) > 0.2 and max(abs(loss["c"]), abs(loss["d"])) < 0.1
    tree = {r.feature: r.importance for r in tree_importances(blobs, model, ["a", "b", "c", "d"]).collect()}
    assert sum(tree.values()) == pytest.approx(1) and min(tree["a"], tree["b"]) > max(tree["c"], tree["d"])


def test_dense_job_indexes_labels_and_tunes(spark, blobs):
    table = blobs.select("id", "a", "b", "c", "d", (F.col("label") + 5).cast("int").alias("kind"))
    result = dense_multiclass(
        table, ["id"], ["a", "b", "c", "d"], "kind", C.classifier("logistic_regression"),
        {"regParam": [0.1, 0.01], "maxIter": [20]}, components=3, folds=3,
    )
    assert result.reports["multiclass"].collect()[0].accuracy > 0.8
    assert result.reports["tuning"].count() == 2
    assert {"rawPrediction", "probability", "prediction", "label"} <= set(result.predictions.columns)


def test_sparse_job(spark, sf_dir):
    rows = I.hashed_urls(spark, sf_dir, 1 << 18).withColumn("label", F.col("label") * 2 - 1)
    result = sparse_binary(rows, ["page_id"], C.classifier("linear_svm"))
    report = result.reports["binary"].collect()[0]
    assert report.total > 0 and report.accuracy == 1.0
    assert result.reports["areas"].collect()[0].auc_roc == pytest.approx(report.auc_roc_hard)
    assert "probability" not in result.predictions.columns
    sampled = sparse_binary(rows, ["page_id"], C.classifier("naive_bayes"), fraction=0.9, limit=30)
    assert 0 < sampled.predictions.count() < 30
    narrow = sparse_binary(rows, ["page_id"], C.classifier("decision_tree"), width=512)
    assert narrow.predictions.select("features").first()[0].size == 512


def test_files_without_ids(spark, blobs, tmp_path):
    path = str(tmp_path / "svm")
    write_libsvm(blobs.withColumn("label", (F.col("label") > 0).cast("double")), path)
    rows = read_libsvm(spark, path, 4)
    results = [
        sparse_binary(part, None, C.classifier("decision_tree")) for part in (rows, rows.repartition(5).unionAll(rows))
    ]
    once, twice = (r.reports["binary"].collect()[0].total for r in results)
    assert twice == 2 * once  # copies fall on the same side


def test_rows_without_label_are_scored_but_not_trained_on(blobs):
    gaps = blobs.drop("features").withColumn("label", F.when(F.col("id") % 5 != 0, F.col("label")))
    result = dense_multiclass(gaps, ["id"], ["a", "b", "c", "d"], "label", C.classifier("decision_tree"), components=None)
    scored = result.predictions
    assert scored.filter("label is null").count() > 0
    assert scored.filter("prediction is null").count() == 0
    report = result.reports["multiclass"].collect()[0]
    assert report.n == scored.filter("label is not null").count()


def test_hand_off_to_second_stage(spark, blobs):
    from discern.operators.split import with_split

    path = scratch_path(spark, "handoff")
    write_split(with_split(blobs, ["id"]), path, ["a", "b", "c", "d"], "label")
    result = second_stage(spark, path, 4, 3, hidden=(8,), maxIter=60)
    counts = result.reports["counts"].agg(F.sum("n")).collect()[0][0]
    assert counts == with_split(blobs, ["id"]).filter("split = 1").count()
    assert result.reports["macro"].collect()[0].accuracy > 0.7


def test_deep_job_reports(blobs):
    result = deep_classifier(blobs.drop("features"), ["id"], ["a", "b", "c", "d"], "label", 3, hidden=(8,), folds=3, maxIter=60)
    assert set(result.reports) == {"tuning", "validation", "test", "matrix", "importance"}
    assert result.reports["matrix"].count() == 9
    assert result.reports["validation"].collect()[0].accuracy > 0.7
    assert result.reports["importance"].count() == 4


def test_stream_scores_equal_batch_scores(spark, blobs, tmp_path):
    model = C.classifier("decision_tree").fit(blobs)
    source = str(tmp_path / "in")
    blobs.select("id", "features").write.parquet(source)
    rows = spark.readStream.schema(blobs.select("id", "features").schema).parquet(source)
    out = str(tmp_path / "out")
    run = write_scores(score_stream(rows, model, "id"), out, str(tmp_path / "state"))
    run.awaitTermination(60)
    scored = {r.id: r.prediction for r in spark.read.parquet(out).collect()}
    assert scored == {r.id: r.prediction for r in model.transform(blobs).collect()}


def test_vectors_leave_as_arrays(blobs):
    from discern.operators.cleaning import result_columns

    scored = C.classifier("decision_tree").fit(blobs).transform(blobs)
    out = result_columns(scored, "id")
    assert out.columns == ["id", "label", "Predicted_label", "probability"]
    assert dict(out.dtypes)["probability"] == "array<double>"
