"""Classification metrics from one aggregate of (actual, predicted) counts.

``confusion`` is the only step that reads the scored rows.  It returns at most
classes x classes rows, and every multi-class figure is computed from those.
Figures without a value (no rows, one class only) are null, never an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``actual, predicted, n`` for the pairs that occur; rows without a label are left out."""
    return (
        scored.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(F.col(label).cast("double").alias("actual"), F.col(prediction).cast("double").alias("predicted"))
        .agg(F.count("*").alias("n"))
    )


def per_class(counts: DataFrame, *keys: str) -> DataFrame:
    """``class, n_actual, n_predicted, n_correct`` with precision, recall and F1.

    A figure whose denominator is zero is null.  ``keys`` keep several models apart.
    """
    correct = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("p"), correct.alias("c")),
        F.struct(
            F.col("predicted").alias("class"),
            F.lit(0).cast("bigint").alias("a"),
            F.col("n").alias("p"),
            F.lit(0).cast("bigint").alias("c"),
        ),
    )
    totals = (
        counts.select(*keys, F.inline(sides))
        .groupBy(*keys, "class")
        .agg(F.sum("a").alias("n_actual"), F.sum("p").alias("n_predicted"), F.sum("c").alias("n_correct"))
    )
    precision = F.try_divide(F.col("n_correct"), F.col("n_predicted"))
    recall = F.try_divide(F.col("n_correct"), F.col("n_actual"))
    f1 = F.try_divide(2 * F.col("n_correct"), F.col("n_actual") + F.col("n_predicted"))
    return totals.withColumns({"precision": precision, "recall": recall, "f1": f1})


def multiclass_report(counts: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, test error and precision, recall, F1 weighted by class size, in one row.

    The balanced accuracy is the mean recall; with two classes it is also the ROC
    area of the hard predictions.
    """
    classes = per_class(counts, *keys)
    total = F.sum("n_actual")

    def weighted(figure: str) -> Column:
        return F.try_divide(F.sum(F.col("n_actual") * F.coalesce(F.col(figure), F.lit(0.0))), total)

    accuracy = F.try_divide(F.sum("n_correct"), total)
    return classes.groupBy(*keys).agg(
        F.coalesce(total, F.lit(0)).alias("n"),
        accuracy.alias("accuracy"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
        F.avg("recall").alias("balanced_accuracy"),
        (1 - accuracy).alias("test_error"),
    )


def class_figures(classes: Sequence[tuple[int, int, int]]) -> dict[str, float | None]:
    """The figures of :func:`multiclass_report` from (actual, predicted, correct) counts in class order.

    Sums are exact up to the last rounding, so equal counts give equal figures.
    """
    n = sum(a for a, _, _ in classes)
    if n == 0:
        return dict.fromkeys(("accuracy", "weighted_precision", "weighted_recall", "weighted_f1", "balanced_accuracy"))

    def weighted(part: Callable[[int, int, int], tuple[int, int]]) -> float:
        pairs = [(a, *part(a, p, c)) for a, p, c in classes]
        return math.fsum(a * (top / below) for a, top, below in pairs if below) / n

    recalls = [c / a for a, _, c in classes if a]
    return {
        "accuracy": sum(c for _, _, c in classes) / n,
        "weighted_precision": weighted(lambda a, p, c: (c, p)),
        "weighted_recall": weighted(lambda a, p, c: (c, a)),
        "weighted_f1": weighted(lambda a, p, c: (2 * c, a + p)),
        "balanced_accuracy": math.fsum(recalls) / len(recalls),
    }


def macro_report(counts: DataFrame, num_classes: int | None = None) -> DataFrame:
    """Unweighted averages over the classes for which a figure is defined.

    Precision needs a prediction of the class, recall a row of it, F1 both.  With
    ``num_classes`` the excluded counts include classes that never occur at all.
    """
    classes = per_class(counts)
    known = F.lit(num_classes) if num_classes is not None else F.count("*")
    both = (F.col("n_actual") > 0) & (F.col("n_predicted") > 0)
    f1 = F.when(both, F.col("f1"))
    return classes.agg(
        F.try_divide(F.sum("n_correct"), F.sum("n_actual")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg(f1).alias("macro_f1"),
        (known - F.count("precision")).cast("bigint").alias("precision_excluded"),
        (known - F.count("recall")).cast("bigint").alias("recall_excluded"),
        (known - F.count(f1)).cast("bigint").alias("f1_excluded"),
    )


def mean_class_error(counts: DataFrame) -> DataFrame:
    """Mean of 1 - recall over the classes that have rows, and accuracy in percent."""
    return per_class(counts).agg(
        (1 - F.avg("recall")).alias("mean_per_class_error"),
        (100 * F.try_divide(F.sum("n_correct"), F.sum("n_actual"))).alias("accuracy_pct"),
    )


def confusion_matrix(counts: DataFrame, num_classes: int | None = None) -> DataFrame:
    """Every cell of the matrix, empty ones as 0.

    Without ``num_classes`` the classes are those seen on either side.  The counts are
    read once: the cells, as many as the result has rows, come together in one row.
    """
    cell = F.struct("actual", "predicted")
    seen = F.flatten(F.collect_list(F.array("actual", "predicted")))
    classes = F.array_sort(F.array_distinct(seen))
    if num_classes is not None:
        classes = F.array([F.lit(float(i)) for i in range(num_classes)])
        counts = counts.filter(F.col("actual").isin(*range(num_classes)) & F.col("predicted").isin(*range(num_classes)))
    whole = counts.agg(F.map_from_entries(F.collect_list(F.struct(cell, F.col("n")))).alias("found"), classes.alias("classes"))
    cells = whole.select("found", "classes", F.explode("classes").alias("actual")).select(
        "found", "actual", F.explode("classes").alias("predicted")
    )
    return cells.select("actual", "predicted", F.coalesce(F.try_element_at("found", cell), F.lit(0)).cast("bigint").alias("n"))


def confusion_wide(cells: DataFrame, num_classes: int) -> DataFrame:
    """One row per actual class, one column ``p_<class>`` per predicted class."""
    columns = [
        F.coalesce(F.sum(F.when(F.col("predicted") == i, F.col("n"))), F.lit(0)).alias(f"p_{i}")
        for i in range(num_classes)
    ]
    return cells.groupBy("actual").agg(*columns)


def binary_counts(label: str, prediction: str, positive: float) -> list[Column]:
    y, p = F.col(label), F.col(prediction)
    hit, miss = y == p, y != p
    is_positive = p == F.lit(positive)
    return [
        F.count("*").alias("total"),
        F.count_if(hit).alias("correct"),
        F.count_if(miss).alias("wrong"),
        F.count_if(is_positive & hit).alias("tp"),
        F.count_if(is_positive & miss).alias("fp"),
        F.count_if(~is_positive & hit).alias("tn"),
        F.count_if(~is_positive & miss).alias("fn"),
    ]


def mcc(tp: str = "tp", fp: str = "fp", tn: str = "tn", fn: str = "fn") -> Column:
    """Matthews correlation; in doubles, since the products overflow a bigint."""
    a, b, c, d = (F.col(x).cast("double") for x in (tp, fp, tn, fn))
    return F.try_divide(a * c - b * d, F.sqrt((a + b) * (a + d) * (c + b) * (c + d)))


def binary_report(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", positive: float = 1.0
) -> DataFrame:
    """Counts, their share of the total, rates and Matthews correlation, from one scan.

    Rows without a label or prediction are left out, as in :func:`confusion`.
    ``auc_roc_hard`` is the ROC area of the hard predictions, which is the balanced
    accuracy.
    """
    known = F.col(label).isNotNull() & F.col(prediction).isNotNull()
    counts = scored.filter(known).agg(*binary_counts(label, prediction, positive))
    share = {f"{c}_ratio": F.try_divide(F.col(c), F.col("total")) for c in ("correct", "wrong", "tp", "fp", "tn", "fn")}
    sensitivity = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    specificity = F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    return counts.withColumns(share).withColumns(
        {
            "accuracy": F.try_divide(F.col("correct"), F.col("correct") + F.col("wrong")),
            "auc_roc_hard": (sensitivity + specificity) / 2,
            "mcc": mcc(),
        }
    )


def evaluator_params(df: DataFrame, evaluator: Evaluator) -> DataFrame:
    """``param, value`` of an evaluator, and the size of the frame it is meant for."""
    values = {param.name: str(value) for param, value in evaluator.extractParamMap().items()}
    pairs = F.array(*[F.struct(F.lit(k).alias("param"), F.lit(v).alias("value")) for k, v in sorted(values.items())])
    return df.agg(F.count("*").alias("n_rows")).select(F.inline(pairs), "n_rows")
