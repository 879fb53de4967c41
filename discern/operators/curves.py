"""Areas under the ROC and precision-recall curves, exact at any number of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discern.operators.ranking import prefix_sums


def score_counts(scored: DataFrame, label: str, score: str, positive: float = 1.0) -> DataFrame:
    """``score, tp, fp`` per distinct score.  Equal scores become one row before any sort."""
    rows = scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    hit = F.col(label).cast("double") == F.lit(positive)
    return rows.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp")
    )


def auc(
    scored: DataFrame,
    label: str = "label",
    score: str = "score",
    positive: float = 1.0,
) -> DataFrame:
    """``auc_roc, auc_pr_first, auc_pr_one`` in one row.

    Both curves are summed by trapezoids over the distinct scores, highest first.
    The precision-recall curve starts at recall 0 with the precision of the first
    point (``first``) or with precision 1 (``one``).  A class without rows makes the
    areas null.
    """
    counts = score_counts(scored, label, score, positive)
    curve = prefix_sums(counts, [F.col("score").desc()], ["tp", "fp"])
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    tp_before, fp_before = F.col("before_tp").cast("double"), F.col("before_fp").cast("double")
    precision = (tp_before + tp) / (tp_before + tp + fp_before + fp)
    precision_before = F.try_divide(tp_before, tp_before + fp_before)

    def pr_area(start: Column) -> Column:
        return F.sum(tp * (precision + F.coalesce(precision_before, start)) / 2)

    positives, negatives = F.sum(tp), F.sum(fp)
    both = (positives > 0) & (negatives > 0)
    return curve.agg(
        F.when(both, F.try_divide(F.sum(fp * (2 * tp_before + tp) / 2), positives * negatives)).alias("auc_roc"),
        F.when(both, F.try_divide(pr_area(precision), positives)).alias("auc_pr_first"),
        F.when(both, F.try_divide(pr_area(F.lit(1.0)), positives)).alias("auc_pr_one"),
    )


def auc_sketch(
    scored: DataFrame,
    label: str = "label",
    score: str = "score",
    positive: float = 1.0,
    low: float = 0.0,
    high: float = 1.0,
    bins: int = 10_000,
) -> DataFrame:
    """``auc_roc, error, n_bins``: the ROC area from counts in equal bins of the score, and how far off it can be.

    The counts of any parts of the rows can be added, so one aggregate does and nothing is sorted
    but the bins.  Where a bin holds both classes their order in it is unknown: the exact area lies
    within ``error`` of the given one.  Scores outside ``low .. high`` go to the end bins, and NaN is
    left out like null.  A class without rows makes the figures null.
    """
    if bins < 1 or not low < high:
        raise ValueError(f"no bins between {low} and {high}")
    value = F.col(score).cast("double")
    rows = scored.filter(F.col(label).isNotNull() & value.isNotNull() & ~F.isnan(value))
    at = F.floor((F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / (high - low) * bins)
    hit = F.col(label).cast("double") == F.lit(positive)
    counts = rows.groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"))
    # at most ``bins`` rows come here
    above = F.coalesce(F.sum("tp").over(Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    curve = counts.select("tp", "fp", above.alias("above"))
    tp, fp, before = (F.col(c).cast("double") for c in ("tp", "fp", "above"))
    all_pairs = F.sum(tp) * F.sum(fp)
    return curve.agg(
        F.try_divide(F.sum(fp * (2 * before + tp)), 2 * all_pairs).alias("auc_roc"),
        F.try_divide(F.sum(fp * tp), 2 * all_pairs).alias("error"),
        F.count("*").alias("n_bins"),
    )
