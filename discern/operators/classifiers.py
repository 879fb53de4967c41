"""Classifiers by name, with the checks that ought to fail before a long fit does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discern.operators.features import vector_width
from discern.operators.perceptron import Perceptron

# Settings of the published experiments.
DEFAULTS: dict[str, dict[str, object]] = {
    "logistic_regression": {},
    "logistic_regression_sparse": {"maxIter": 10000, "regParam": 0.001, "tol": 0.001, "aggregationDepth": 3},
    "decision_tree": {"seed": 12345},
    "random_forest": {"seed": 12345},
    "linear_svm": {"maxIter": 10, "regParam": 0.1, "aggregationDepth": 3},
    "naive_bayes": {"smoothing": 0.0001},
    "multilayer_perceptron": {"blockSize": 128, "seed": 1234, "tol": 1e-4, "maxIter": 1000},
}
HIDDEN_LAYERS: dict[str, tuple[int, ...]] = {
    "multilayer_perceptron": (16, 32),
    "deep": (32, 64, 128),
    "second_stage": (256, 256, 256),
}

_CLASSES = {
    "logistic_regression": LogisticRegression,
    "logistic_regression_sparse": LogisticRegression,
    "decision_tree": DecisionTreeClassifier,
    "random_forest": RandomForestClassifier,
    "linear_svm": LinearSVC,
    "naive_bayes": NaiveBayes,
    "multilayer_perceptron": Perceptron,
}


def classifier(name: str, **params: object) -> Estimator:
    """An estimator with the published settings, any of them replaced by ``params``."""
    if name not in _CLASSES:
        raise ValueError(f"unknown classifier {name!r}; choose from {sorted(_CLASSES)}")
    return _CLASSES[name](**{**DEFAULTS[name], **params})


def perceptron_layers(
    df: DataFrame, hidden: Sequence[int], num_classes: int, features: str = "features"
) -> list[int]:
    """Layer sizes with the input layer read off the data."""
    return [vector_width(df, features), *hidden, num_classes]


def perceptron(
    df: DataFrame,
    num_classes: int,
    hidden: Sequence[int] = HIDDEN_LAYERS["multilayer_perceptron"],
    features: str = "features",
    **params: object,
) -> Perceptron:
    """A multilayer perceptron that fits ``df``.

    Equal rows are summed first (``discern.operators.perceptron``).  The solver makes blocks dense.  A width that would
    fill a task's memory is refused: cut it first.
    """
    layers = perceptron_layers(df, hidden, num_classes, features)
    block = int(params.get("blockSize", DEFAULTS["multilayer_perceptron"]["blockSize"]))
    if layers[0] * block * 8 > 1 << 28:
        raise ValueError(
            f"a dense block of {block} rows x {layers[0]} features is over 256 MB; "
            "reduce the width with fold_width or hashed_terms first"
        )
    return classifier("multilayer_perceptron", layers=layers, featuresCol=features, **params)


def check_layers(df: DataFrame, layers: Sequence[int], features: str = "features") -> None:
    """Fail clearly when a hand-made first layer differs from the width of the data."""
    width = vector_width(df, features)
    if layers[0] != width:
        raise ValueError(f"input layer has {layers[0]} nodes but {features} has {width} entries")


def checked_labels(df: DataFrame, num_classes: int, label: str = "label") -> DataFrame:
    """The same rows; a label other than 0 .. num_classes - 1 stops the job that reads it."""
    y = F.col(label).cast("double")
    bad = y.isNull() | (y < 0) | (y >= num_classes) | (y != F.floor(y))
    text = F.concat(F.lit(f"label outside 0..{num_classes - 1}: "), F.coalesce(y.cast("string"), F.lit("null")))
    return df.withColumn(label, F.when(bad, F.raise_error(text).cast("double")).otherwise(y))


def last_stage(model: Model) -> Model:
    return model.stages[-1] if hasattr(model, "stages") else model


def layer_params(df: DataFrame, width: str, classes: str, hidden: Sequence[int]) -> DataFrame:
    """``layer, n_params`` of a perceptron whose ends are columns ``width`` and ``classes`` of ``df``.

    A layer with ``a`` inputs and ``b`` outputs has (a + 1) * b parameters.  Layer -1
    is the total.
    """
    sizes = F.array(F.col(width), *[F.lit(h) for h in hidden], F.col(classes)).cast("array<bigint>")
    steps = len(hidden) + 1
    per_layer = [(F.get(sizes, F.lit(i)) + 1) * F.get(sizes, F.lit(i + 1)) for i in range(steps)]
    rows = [F.struct(F.lit(i).alias("layer"), n.alias("n_params")) for i, n in enumerate(per_layer)]
    rows.append(F.struct(F.lit(-1).alias("layer"), sum(per_layer[1:], per_layer[0]).alias("n_params")))
    return df.select(F.inline(F.array(*rows)))


def fit_on(df: DataFrame, estimator: Estimator, *before: Estimator) -> Model:
    """Fit ``estimator`` after ``before``, all on the same rows."""
    return Pipeline(stages=[*before, estimator]).fit(df)
