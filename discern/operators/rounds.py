"""Training of a net in rounds that a validation part decides about."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model
from pyspark.sql import DataFrame

from discern.operators.classifiers import HIDDEN_LAYERS, perceptron
from discern.operators.tuning import DIGITS, METRICS, fold_scores


@dataclass(frozen=True)
class Rounds:
    """The model of the best round, and ``log(round, iterations, figure, chosen)``."""

    model: Model
    log: DataFrame


def fit_in_rounds(
    training: DataFrame,
    validation: DataFrame,
    num_classes: int,
    hidden: Sequence[int] = HIDDEN_LAYERS["deep"],
    rounds: int = 10,
    iterations: int = 40,
    patience: int = 2,
    metric: str = "f1",
    label: str = "label",
    **params: object,
) -> Rounds:
    """A perceptron trained ``iterations`` solver steps at a time, each round from the last one's weights.

    After each round the validation part is scored; ``patience`` rounds without a better figure end
    the training, and so does a round that changes no weight.  The first round with the best figure is
    the answer, so later rounds that only fit the training rows closer are not.  Rows without a
    label are not scored; a validation part without any labelled row is an error.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose from {sorted(METRICS)}")
    if rounds < 1 or iterations < 1 or patience < 1:
        raise ValueError("rounds, iterations and patience must be positive")
    net = perceptron(training, num_classes, hidden, labelCol=label, maxIter=iterations, **params)
    log: list[tuple[int, int, float]] = []
    best, best_round, model = None, 0, None
    for number in range(rounds):
        own = net if model is None else net.copy({net.initialWeights: model.weights})
        before, model = model, own.fit(training)
        figure = fold_scores([model], validation, label, metric)[0]
        if figure is None:
            raise ValueError("the validation part has no labelled rows")
        log.append((number, (number + 1) * iterations, figure))
        if best is None or round(figure, DIGITS) > round(log[best_round][2], DIGITS):
            best, best_round = model, number
        settled = before is not None and np.array_equal(before.weights.toArray(), model.weights.toArray())
        if settled or number - best_round >= patience:
            break
    rows = [(*entry, entry[0] == best_round) for entry in log]
    return Rounds(best, training.sparkSession.createDataFrame(rows, "round int, iterations int, figure double, chosen boolean"))
