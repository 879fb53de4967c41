"""Whole jobs: prepare, split, train or tune, score, evaluate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discern.functions.hashing import content_id
from discern.operators.classifiers import HIDDEN_LAYERS, perceptron
from discern.operators.curves import auc
from discern.operators.features import assembler, fold_width, principal_components, with_known_index
from discern.operators.importance import permutation_importance
from discern.operators.metrics import binary_report, confusion, confusion_matrix, macro_report, multiclass_report
from discern.operators.rounds import fit_in_rounds
from discern.operators.split import (
    SPARSE_SPLIT_SEED,
    SPLIT_SEED,
    sample_with_replacement,
    shuffled_top,
    stored_split,
)
from discern.operators.tuning import DEFAULT_FOLDS, cross_validate, grid, preset_of
from discern.sources.handoff import read_split
from discern.sources.scratch import materialize


@dataclass(frozen=True)
class JobResult:
    """A fitted model, its predictions on the test rows, and reports by name."""

    model: Model
    predictions: DataFrame
    reports: dict[str, DataFrame]


def _tuned(
    training: DataFrame,
    pipeline: Pipeline,
    values: Mapping[str, Sequence[object]] | str | None,
    ids: Sequence[str],
    folds: int | None,
    metric: str,
    parallelism: int,
    ledger: str | None,
    sparse: bool = False,
    weigh: bool = False,
) -> tuple[Model, dict[str, DataFrame]]:
    if values is None:
        return pipeline.fit(training), {}
    own = DEFAULT_FOLDS
    if isinstance(values, str):
        values, own = preset_of(pipeline.getStages()[-1], values, sparse)
    tuned = cross_validate(
        training, pipeline, grid(pipeline, values), ids, folds or own, metric=metric, parallelism=parallelism, ledger=ledger, share_depths=True, weigh=weigh
    )
    return tuned.model, {"tuning": tuned.results}


def _stored_counts(predictions: DataFrame) -> DataFrame:
    """The confusion counts, written once: all reports of a job come from one scan of its scored rows."""
    return materialize(confusion(predictions), "counts")


def _identified(df: DataFrame, ids: Sequence[str] | None) -> tuple[DataFrame, Sequence[str]]:
    """Rows read from CSV or LIBSVM have no id; their content stands in for it."""
    if ids is not None:
        return df, ids
    return df.withColumn("row_id", content_id(df.columns)), ["row_id"]


def _labelled(parts: Sequence[DataFrame], index: bool = True) -> list[DataFrame]:
    """Turn the stored ``_raw`` labels into ``label``; rows without one are scored but not trained on."""
    if index:
        raw = parts[0].select("_raw")
        for part in parts[1:]:
            raw = raw.unionAll(part.select("_raw"))
        labels = StringIndexer(inputCol="_raw", outputCol="label", handleInvalid="skip").fit(raw).labels
        ready = [with_known_index(part, "_raw", labels) for part in parts]
    else:
        ready = [part.withColumn("label", F.col("_raw").cast("double")) for part in parts]
    training, *rest = [part.drop("_raw") for part in ready]
    return [training.filter(F.col("label").isNotNull()), *rest]


def dense_multiclass(
    df: DataFrame,
    ids: Sequence[str] | None,
    features: Sequence[str],
    label: str,
    estimator: Estimator,
    values: Mapping[str, Sequence[object]] | str | None = None,
    components: int | None = 50,
    folds: int | None = None,
    weights: Sequence[float] = (80, 20),
    seed: int = SPLIT_SEED,
    metric: str = "f1",
    parallelism: int = 1,
    index_labels: bool = True,
    ledger: str | None = None,
    weigh: bool = False,
) -> JobResult:
    """Wide numeric table to a tuned multi-class model and its reports.

    ``values`` is the grid, or ``"reference"`` or ``"small"`` for the classifier's published or everyday
    one (``None`` fits once); ``folds`` are the published number unless given, and ``ledger`` is a
    folder from which an ended search goes on.  PCA belongs to the pipeline and
    sees training rows only.  Labels are indexed by frequency over all rows, so no
    class number stays empty; ``index_labels=False`` takes them as they are.
    ``weigh`` is for features of few values (``cross_validate``).
    """
    df, ids = _identified(df, ids)
    columns = df.select(*ids, F.col(label).alias("_raw"), *features)
    rows = assembler(features).transform(columns).select(*ids, "_raw", "features")
    training, test = _labelled(stored_split(rows, ids, weights, seed), index_labels)
    stages: list[Estimator] = []
    if components is not None:
        stages.append(principal_components(training, components))
        estimator = estimator.copy({estimator.getParam("featuresCol"): "pca_features"})
    model, reports = _tuned(training, Pipeline(stages=[*stages, estimator]), values, ids, folds, metric, parallelism, ledger, weigh=weigh)
    predictions = model.transform(test)
    counts = _stored_counts(predictions)
    reports |= {
        "multiclass": multiclass_report(counts),
        "macro": macro_report(counts),
        "matrix": confusion_matrix(counts),
    }
    return JobResult(model, predictions, reports)


def sparse_binary(
    df: DataFrame,
    ids: Sequence[str] | None,
    estimator: Estimator,
    values: Mapping[str, Sequence[object]] | str | None = None,
    width: int | None = None,
    folds: int | None = None,
    weights: Sequence[float] = (80, 20),
    seed: int = SPARSE_SPLIT_SEED,
    metric: str = "balancedAccuracy",
    parallelism: int = 1,
    fraction: float | None = None,
    limit: int | None = None,
    ledger: str | None = None,
) -> JobResult:
    """Sparse rows ``ids, label, features`` to a binary model and its reports.

    The two labels are indexed by frequency (0 the more frequent).  Linear models
    and naive Bayes keep the full width; give ``width`` for trees and perceptrons.
    ``fraction`` draws rows with replacement first, ``limit`` then keeps that many of
    them; both are off unless asked for.  ``ids`` may be ``None`` for rows without an id.
    """
    df, ids = _identified(df, ids)
    if fraction is not None:
        df = sample_with_replacement(df, ids, fraction).drop("copy")
    if limit is not None:
        df = shuffled_top(df, ids, limit)
    rows = df.select(*ids, F.col("label").alias("_raw"), "features")
    training, test = _labelled(stored_split(fold_width(rows, width) if width else rows, ids, weights, seed))
    model, reports = _tuned(training, Pipeline(stages=[estimator]), values, ids, folds, metric, parallelism, ledger, True)
    predictions = model.transform(test)
    margin = "probability" if "probability" in predictions.columns else "rawPrediction"
    scored = predictions.select("label", "prediction", F.get(vector_to_array(margin), F.lit(1)).alias("score"))
    scored = materialize(scored, "scored")
    reports |= {
        "binary": binary_report(scored),
        "areas": auc(scored, score="prediction"),
        "score_areas": auc(scored),
    }
    return JobResult(model, predictions, reports)


def second_stage(
    spark: SparkSession,
    path: str,
    n_features: int,
    num_classes: int,
    hidden: Sequence[int] = HIDDEN_LAYERS["second_stage"],
    train: object = 0,
    test: object = 1,
    **params: object,
) -> JobResult:
    """A deeper classifier on the split that a first job handed over as CSV."""
    training = materialize(read_split(spark, path, train, n_features, num_classes), "second")
    rows = read_split(spark, path, test, n_features, num_classes)
    model = perceptron(training, num_classes, hidden, **params).fit(training)
    predictions = model.transform(rows)
    counts = _stored_counts(predictions)
    return JobResult(model, predictions, {"macro": macro_report(counts, num_classes), "counts": counts})


def deep_classifier(
    df: DataFrame,
    ids: Sequence[str],
    features: Sequence[str],
    label: str,
    num_classes: int,
    hidden: Sequence[int] = HIDDEN_LAYERS["deep"],
    folds: int | None = None,
    weights: Sequence[float] = (60, 20, 20),
    seed: int = SPLIT_SEED,
    rounds: int | None = None,
    **params: object,
) -> JobResult:
    """A deep net with a training, a validation and a test part, and importances.

    With ``folds`` the training part is also cross-validated at these settings.  With ``rounds`` the
    validation part decides how long the net is trained (``fit_in_rounds``; ``maxIter`` is then
    the steps of a round), and the report ``rounds`` tells how.
    """
    rows = df.select(*ids, *features, F.col(label).cast("double").alias("label"))
    vectors = assembler(features)
    training, validation, test = (vectors.transform(part) for part in stored_split(rows, ids, weights, seed))
    net = perceptron(training, num_classes, hidden, **params)
    reports: dict[str, DataFrame] = {}
    if folds is not None:
        reports["tuning"] = cross_validate(
            training.select(*ids, "label", "features"), net, grid(net, {}), ids, folds, refit=False
        ).results
    if rounds is None:
        model = net.fit(training)
    else:
        more = {k: v for k, v in params.items() if k != "maxIter"}
        steps = {"iterations": params["maxIter"]} if "maxIter" in params else {}
        trained = fit_in_rounds(training, validation, num_classes, hidden, rounds, **steps, **more)
        model, reports["rounds"] = trained.model, trained.log
    predictions = model.transform(test)
    counts = _stored_counts(predictions)
    reports |= {
        "validation": multiclass_report(_stored_counts(model.transform(validation))),
        "test": multiclass_report(counts),
        "matrix": confusion_matrix(counts, num_classes),
        "importance": permutation_importance(test, model, features, ids),
    }
    return JobResult(model, predictions, reports)
