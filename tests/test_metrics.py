"""Metrics against recorded figures, Spark's evaluators and hand-made cases."""

import math

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from discern.operators import metrics as M
from discern.operators.curves import auc

# Recorded counts (prediction, label) of three models on 3,230 rows with
# Matthews correlation, ROC area and precision-recall area from the anchors 1 and first.
RECORDED = {
    "svm": ((1918, 69, 905, 338), 0.7350873359923633, 0.8466757576702307, 0.8809396531166327, 0.8551504698298571),
    "lr": ((1933, 54, 1153, 90), 0.9055804378063441, 0.9502089405755269, 0.9553596420423565, 0.9346098058428205),
    "nb": ((1866, 121, 1132, 111), 0.8485441585953132, 0.924902048350481, 0.9242485041969178, 0.8802761617126853),
}

# A recorded 13 x 13 confusion matrix of 91 rows, actual by predicted.
MATRIX = [
    [43, 2, 0, 2, 1, 1, 0, 0, 0, 0, 0, 0, 2],
    [5, 5, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1],
    [0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [4, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0],
    [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0],
    [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0],
    [2, 1, 0, 1, 0, 0, 0, 0, 0, 6, 0, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1],
    [0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
]


def pairs(spark, counts):
    """Rows ``prediction, label`` from (prediction, label, n)."""
    df = spark.createDataFrame([(float(p), float(y), n) for p, y, n in counts if n], "prediction double, label double, n int")
    return df.select("prediction", "label", F.explode(F.sequence(F.lit(1), "n"))).select("prediction", "label")


def one(df):
    return df.collect()[0].asDict()


@pytest.mark.parametrize("name", sorted(RECORDED))
def test_recorded_binary_models(spark, name):
    (n00, n10, n11, n01), mcc, roc, pr_one, pr_first = RECORDED[name]
    rows = pairs(spark, [(0, 0, n00), (1, 0, n10), (1, 1, n11), (0, 1, n01)])
    report = one(M.binary_report(rows))
    assert (report["total"], report["correct"], report["wrong"]) == (3230, n00 + n11, n10 + n01)
    assert (report["tp"], report["fp"], report["tn"], report["fn"]) == (n11, n10, n00, n01)
    assert report["mcc"] == pytest.approx(mcc, abs=1e-12)
    assert report["auc_roc_hard"] == pytest.approx(roc, abs=1e-12)
    assert report["correct_ratio"] == pytest.approx((n00 + n11) / 3230, abs=1e-15)
    areas = one(auc(rows, score="prediction"))
    assert areas["auc_roc"] == pytest.approx(roc, abs=1e-12)
    assert areas["auc_pr_one"] == pytest.approx(pr_one, abs=1e-12)
    assert areas["auc_pr_first"] == pytest.approx(pr_first, abs=1e-12)
    swapped = one(M.binary_report(rows, positive=0.0))
    assert swapped["mcc"] == pytest.approx(mcc, abs=1e-12)
    assert (swapped["tp"], swapped["tn"]) == (n00, n11)


def test_recorded_matrix(spark):
    cells = [(p, y, n) for y, row in enumerate(MATRIX) for p, n in enumerate(row)]
    rows = pairs(spark, cells)
    counts = M.confusion(rows)
    report = one(M.multiclass_report(counts))
    assert report["n"] == 91 and report["accuracy"] == pytest.approx(60 / 91)
    assert report["test_error"] == pytest.approx(31 / 91)
    full = {(r.actual, r.predicted): r.n for r in M.confusion_matrix(counts, 13).collect()}
    assert len(full) == 169 and all(full[(y, p)] == n for p, y, n in cells)
    assert one(M.mean_class_error(counts))["accuracy_pct"] == pytest.approx(100 * 60 / 91)
    macro = one(M.macro_report(counts, 17))
    defined = [y for y in range(13) if sum(MATRIX[y])]
    assert macro["recall_excluded"] == 17 - len(defined)
    assert macro["macro_recall"] == pytest.approx(sum(MATRIX[y][y] / sum(MATRIX[y]) for y in defined) / len(defined))


def test_hand_made_multiclass(spark):
    rows = pairs(spark, [(0, 0, 1), (1, 1, 1), (2, 1, 1), (1, 2, 1), (3, 1, 1)])
    report = one(M.multiclass_report(M.confusion(rows)))
    assert report["accuracy"] == pytest.approx(0.4)
    assert report["weighted_precision"] == pytest.approx(0.5)
    assert report["weighted_recall"] == pytest.approx(0.4)
    assert report["weighted_f1"] == pytest.approx(0.44)


def test_agrees_with_spark_evaluators(spark, sf_dir):
    from discern.plans.inputs import rule_classes, rule_predictions

    rows = rule_classes(spark, sf_dir)
    report = one(M.multiclass_report(M.confusion(rows)))
    names = {"accuracy": "accuracy", "weightedPrecision": "weighted_precision", "weightedRecall": "weighted_recall", "f1": "weighted_f1"}
    for metric, column in names.items():
        found = MulticlassClassificationEvaluator(metricName=metric).evaluate(rows)
        assert report[column] == pytest.approx(found, abs=1e-12)
    assert report["weighted_recall"] == pytest.approx(report["accuracy"], abs=1e-12)
    scored = rule_predictions(spark, sf_dir)
    areas = one(auc(scored))
    for metric, column in {"areaUnderROC": "auc_roc", "areaUnderPR": "auc_pr_first"}.items():
        evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", metricName=metric, numBins=0)
        assert areas[column] == pytest.approx(evaluator.evaluate(scored), abs=1e-9)


def test_area_is_the_same_range_by_range(spark):
    rows = spark.range(20_000).select(
        (F.pmod(F.xxhash64("id"), F.lit(7)) < 3).cast("double").alias("label"),
        # a third of the rows share one score
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_003)) / 1e5).alias("score"),
    )
    single, ranges = one(auc(rows.coalesce(1))), one(auc(rows))
    for name in single:
        assert ranges[name] == pytest.approx(single[name], abs=1e-12)


def test_undefined_figures_are_null(spark):
    empty = spark.createDataFrame([], "prediction double, label double, score double")
    report = one(M.binary_report(empty))
    assert report["total"] == 0 and report["mcc"] is None and report["accuracy"] is None
    assert one(auc(empty))["auc_roc"] is None
    assert one(M.multiclass_report(M.confusion(empty)))["accuracy"] is None
    single = spark.createDataFrame([(1.0, 1.0, 0.3), (0.0, 1.0, 0.7)], "prediction double, label double, score double")
    assert one(M.binary_report(single))["mcc"] is None
    assert set(one(auc(single)).values()) == {None}


def test_class_never_predicted_and_null_labels(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (0.0, None)], "prediction double, label double")
    counts = M.confusion(rows)
    report = one(M.multiclass_report(counts))
    assert report["n"] == 2 and report["weighted_precision"] == pytest.approx(0.25)
    macro = one(M.macro_report(counts))
    assert macro["precision_excluded"] == 1 and macro["macro_precision"] == pytest.approx(0.5)
    binary = one(M.binary_report(rows))
    assert binary["total"] == 2 and binary["correct"] + binary["wrong"] == 2


def test_large_counts_do_not_overflow(spark):
    n = 10**12
    counts = spark.createDataFrame([(n, n // 3, n, n // 7)], "tp long, fp long, tn long, fn long")
    value = counts.select(M.mcc().alias("m")).collect()[0].m
    tp, fp, tn, fn = n, n // 3, n, n // 7
    expected = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    assert value == pytest.approx(expected, rel=1e-12)


def test_wide_matrix(spark):
    rows = pairs(spark, [(0, 0, 3), (1, 0, 2), (1, 1, 4)])
    wide = {r.actual: (r.p_0, r.p_1) for r in M.confusion_wide(M.confusion_matrix(M.confusion(rows)), 2).collect()}
    assert wide == {0.0: (3, 2), 1.0: (0, 4)}
