"""Grid search with k-fold cross-validation on hash folds."""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.param import Param
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discern.operators.binning import binned_cells, can_bin, ready_cells, tree_estimators
from discern.operators.features import vector_width
from discern.operators.metrics import class_figures, per_class
from discern.operators.nested import Group, depth_groups, stopped_predictions
from discern.operators.split import with_fold
from discern.sources.scratch import discard, materialize, scratch_path

# Grids of the published experiments, by classifier.
REFERENCE_GRIDS: dict[str, dict[str, list[object]]] = {
    "logistic_regression": {"regParam": [0.1, 0.01], "maxIter": [10, 50, 100, 10000], "tol": [0.1, 0.01, 0.001]},
    "decision_tree": {"maxDepth": [3, 5, 10, 20], "impurity": ["gini", "entropy"], "maxBins": [3, 5, 10, 20]},
    "random_forest": {
        "maxDepth": [3, 5, 10],
        "featureSubsetStrategy": ["auto", "all"],
        "impurity": ["gini", "entropy"],
        "maxBins": [3, 5, 10],
        "numTrees": [3, 5, 10],
    },
    "linear_svm": {"maxIter": [100, 1000], "regParam": [0.001, 0.0001], "tol": [0.01, 0.001]},
    "logistic_regression_sparse": {"maxIter": [100, 1000], "regParam": [0.001, 0.0001], "tol": [0.01, 0.001]},
    "random_forest_sparse": {
        "maxDepth": [3, 5],
        "featureSubsetStrategy": ["auto", "all"],
        "impurity": ["gini", "entropy"],
        "maxBins": [3, 5],
        "numTrees": [2, 3],
    },
}
REFERENCE_FOLDS = {"random_forest": 5}
DEFAULT_FOLDS = 10

# Grids for everyday runs.
SMALL_GRIDS: dict[str, dict[str, list[object]]] = {
    "logistic_regression": {"regParam": [0.1, 0.01], "maxIter": [20]},
    "decision_tree": {"maxDepth": [3, 5], "impurity": ["gini", "entropy"]},
    "random_forest": {"maxDepth": [3, 5], "numTrees": [3, 5]},
    "linear_svm": {"regParam": [0.01, 0.001], "maxIter": [20]},
    "logistic_regression_sparse": {"regParam": [0.01, 0.001], "maxIter": [20]},
    "random_forest_sparse": {"maxDepth": [3, 5], "numTrees": [2, 3]},
}
PRESETS = {"reference": REFERENCE_GRIDS, "small": SMALL_GRIDS}

# Models whose predictions are counted in one scan of a validation fold.
MODELS_PER_SCAN = 24

# Equal rows are joined into rows of a weight, none of more than about this part of all rows: solvers
# correct the scale of a feature by the largest weights, and so by less than a hundred-thousandth.
PIECES = 1 << 17
WEIGHT = "_n"

# The driver-side eigen solver of PCA keeps static state and fails when two run at once.
_ONE_SOLVER = Lock()

METRICS = {
    "accuracy": "accuracy",
    "balancedAccuracy": "balanced_accuracy",
    "f1": "weighted_f1",
    "weightedPrecision": "weighted_precision",
    "weightedRecall": "weighted_recall",
}
# Means are compared to this many digits; equal ones go to the first point of the grid.
DIGITS = 12


@dataclass(frozen=True)
class TunedModel:
    """``results`` has one row per grid point; ``model`` is refitted on all rows."""

    model: Model | None
    params: dict[str, object]
    results: DataFrame


def grid(estimator: Estimator, values: Mapping[str, Sequence[object]]) -> list[dict[Param, object]]:
    """All combinations of ``values``; an empty mapping is the single point of the defaults."""
    owner = estimator.getStages()[-1] if isinstance(estimator, Pipeline) else estimator
    builder = ParamGridBuilder()
    for name, choices in values.items():
        builder = builder.addGrid(owner.getParam(name), list(choices))
    return builder.build()


def preset_grid(estimator: Estimator, name: str, preset: str = "small") -> list[dict[Param, object]]:
    return grid(estimator, PRESETS[preset][name])


def preset_of(estimator: Estimator, preset: str, sparse: bool = False) -> tuple[dict[str, list[object]], int]:
    """The values and the number of folds of a named preset for a classifier."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; choose from {sorted(PRESETS)}")
    kinds = {"LogisticRegression": "logistic_regression", "DecisionTreeClassifier": "decision_tree", "RandomForestClassifier": "random_forest", "LinearSVC": "linear_svm"}
    name = kinds.get(type(estimator).__name__)
    if name is not None and sparse and f"{name}_sparse" in PRESETS[preset]:
        name += "_sparse"
    if name not in PRESETS[preset]:
        raise ValueError(f"no grid {preset!r} for {type(estimator).__name__}")
    return dict(PRESETS[preset][name]), REFERENCE_FOLDS.get(name, DEFAULT_FOLDS)


def predictions_side_by_side(models: Sequence[Model], rows: DataFrame, label: str) -> DataFrame:
    """``label, model, prediction``: every model applied to the same scan of ``rows``."""
    scored = rows
    for i, model in enumerate(models):
        extra = {model.getParam("predictionCol"): f"_p{i}"}
        extra |= {model.getParam(p): "" for p in ("rawPredictionCol", "probabilityCol") if model.hasParam(p)}
        scored = model.copy(extra).transform(scored)
    pairs = F.array(
        *[F.struct(F.lit(i).alias("model"), F.col(f"_p{i}").alias("prediction")) for i in range(len(models))]
    )
    kept = [WEIGHT] if WEIGHT in rows.columns else []
    return scored.select(F.col(label).alias("label"), *kept, F.inline(pairs))


def _class_counts(predictions: DataFrame) -> dict[int, list[tuple]]:
    """``label, model, prediction`` to (class, rows, predictions, hits) of every model, in class order."""
    counts = (
        predictions.filter(F.col("label").isNotNull())
        .groupBy("model", F.col("label").cast("double").alias("actual"), F.col("prediction").alias("predicted"))
        .agg((F.sum(WEIGHT) if WEIGHT in predictions.columns else F.count("*")).cast("long").alias("n"))
    )
    # whole counts, one row per model and class: the figure does not depend on the order of a shuffle
    totals = per_class(counts, "model").select("model", "class", "n_actual", "n_predicted", "n_correct").collect()
    found: dict[int, list[tuple]] = {}
    for model, *whole in sorted(tuple(row) for row in totals):
        found.setdefault(model, []).append(tuple(whole))
    return found


def _figure(classes: list[tuple], metric: str) -> float | None:
    return class_figures([c[1:] for c in classes])[METRICS[metric]] if classes else None


def fold_scores(models: Sequence[Model], rows: DataFrame, label: str, metric: str) -> list[float | None]:
    """One figure per model; at most ``MODELS_PER_SCAN`` models share a scan."""
    scores: list[float | None] = []
    for start in range(0, len(models), MODELS_PER_SCAN):
        chunk = models[start : start + MODELS_PER_SCAN]
        found = _class_counts(predictions_side_by_side(chunk, rows, label))
        scores += [_figure(found.get(i, []), metric) for i in range(len(chunk))]
    return scores


class Ledger:
    """Whole counts of finished (fold, point) pairs, kept between runs below ``path``.

    A search is known by its grid, its estimators' settings, its folds and a fingerprint of its
    rows; another one has a folder of its own.  Each record is a table that counts once its writer
    has finished, so a driver that dies leaves nothing half done.
    """

    _SCHEMA = "point int, class double, n_actual long, n_predicted long, n_correct long"

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{key}"

    def known(self) -> dict[int, dict[int, list[tuple]]]:
        """Counts by fold and point."""
        found: dict[int, dict[int, list[tuple]]] = {}
        for fold, folder in finished_tables(self.spark, self.path):
            for point, name, *whole in sorted(map(tuple, self.spark.read.schema(self._SCHEMA).parquet(folder).collect()), key=str):
                own = found.setdefault(fold, {}).setdefault(point, [])
                if name is not None:  # a point without any row to be scored has one record without a class
                    own.append((name, *whole))
        return {f: {p: sorted(c) for p, c in points.items()} for f, points in found.items()}

    def add(self, fold: int, counts: Mapping[int, list[tuple]]) -> None:
        rows = [(p, *c) for p, own in counts.items() for c in own or [(None, None, None, None)]]
        name = f"fold-{fold}-{'-'.join(map(str, sorted(counts)[:3]))}-{uuid.uuid4().hex[:8]}"
        self.spark.createDataFrame(rows, self._SCHEMA).coalesce(1).write.parquet(f"{self.path}/{name}")


def finished_tables(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(fold, folder) of the records below ``path`` whose writers have finished."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [status.getPath() for status in files.listStatus(root)]
    return [(int(p.getName().split("-")[1]), p.toString()) for p in found if files.exists(hadoop(p, "_SUCCESS"))]


def search_key(folded: DataFrame, stages: Sequence[Estimator], param_maps: Sequence[Mapping[Param, object]], k: int, label: str, share: object) -> str:
    """A fingerprint of a search: settings, grid, folds, and the rows in any order."""
    settings = [[type(s).__name__, sorted((p.name, repr(v)) for p, v in s.extractParamMap().items())] for s in stages]
    # a default output name holds the stage's own number
    settings = re.sub(r"_[0-9a-f]{12}(__)?", "_", json.dumps(settings))
    grid_ = [sorted((p.name, repr(v)) for p, v in point.items()) for point in param_maps]
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(folded.columns)]).cast("decimal(38,0)")
    n, total = folded.agg(F.count("*"), F.sum(row)).first()
    text = json.dumps([settings, grid_, k, label, share, sorted(folded.dtypes), n, str(total)])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def can_weigh(head: Estimator, points: Sequence[Mapping[Param, object]]) -> bool:
    """Whether a fit of rows with weights is the fit of that many rows: forests draw rows, some nets know no weights."""
    if not isinstance(head, (DecisionTreeClassifier, LinearSVC, LogisticRegression)) or head.isSet("weightCol"):
        return False
    if not isinstance(head, DecisionTreeClassifier):
        return True
    least = head.getParam("minInstancesPerNode")  # counts rows, whatever they weigh
    return all(point.get(least, head.getOrDefault(least)) == 1 for point in points)


def weighted_rows(df: DataFrame, path: str) -> DataFrame:
    """Equal rows of ``df`` as few rows with a ``WEIGHT``; their table is written to ``path``."""
    counted = materialize(df.groupBy(*df.columns).agg(F.count("*").alias("_all")), "weighted", path=path)
    most = -(-(counted.agg(F.sum("_all")).first()[0] or 1) // PIECES)
    parts = F.ceil(F.col("_all") / F.lit(most)).cast("long")
    pieces = counted.select("*", parts.alias("_parts"), F.explode(F.sequence(F.lit(1).cast("long"), parts)).alias("_part"))
    share = F.floor(F.col("_all") / F.col("_parts")) + (F.col("_part") <= F.col("_all") % F.col("_parts")).cast("long")
    return pieces.select(*df.columns, share.cast("double").alias(WEIGHT))


def cross_validate(
    df: DataFrame,
    estimator: Estimator,
    param_maps: Sequence[dict[Param, object]],
    ids: Sequence[str],
    k: int = DEFAULT_FOLDS,
    label: str = "label",
    metric: str = "f1",
    parallelism: int = 1,
    refit: bool = True,
    ledger: str | None = None,
    share_depths: bool | None = None,
    weigh: bool = False,
    share_trees: bool = False,
    bins: bool = False,
) -> TunedModel:
    """Pick the grid point with the best mean ``metric`` over ``k`` folds.

    The rows are written once, sorted by fold and id inside each file, so that a validation
    fold is read without the pages of the others and forests draw from one order of rows.  Stages before the last are fitted once per fold, on its
    training rows.  ``parallelism`` fits of a fold run side by side, each with its own copy
    of the fold in memory; all its models are then scored in shared scans.  Folds follow from the row ids, so another partitioning or a
    retry gives the same ones.

    Tree points that differ in depth only share one fit of the deepest, stopped at each depth
    (``discern.operators.nested``): always where that changes nothing, with ``share_depths=True`` also
    in forests that draw columns for each node, with ``False`` never.  With ``share_trees`` besides, forests that differ in
    their number of trees (more than one) share a fit as well: the smaller one is the first trees of the larger.  With ``ledger``, a folder that
    outlives the driver, the counts of every finished fold and point are kept there, and a search
    that is run again fits only what is not there.

    ``weigh`` is for features of few values: rows that are equal but for their ids become rows with weights
    (at least ``PIECES`` of them, if there are as many), for the fits and the scores.  It holds for
    linear models and single trees without weights of their own; stages before the last see all rows.

    ``bins`` is for trees and forests on few features: the bins are chosen once for the search, and rows of
    equal bins are joined (``discern.operators.binning``), where every point splits nodes of one row, forests draw
    alike and no stage is before them.  The winner is refitted on the rows as they are.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose from {sorted(METRICS)}")
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
    before, head = stages[:-1], stages[-1]
    if any(param.parent != head.uid for point in param_maps for param in point):
        raise ValueError("the grid may only vary the last stage")
    spark = df.sparkSession
    path, light_path = scratch_path(spark, "folds"), scratch_path(spark, "weighted")
    bins = bins and not before and can_bin(head, param_maps)
    weigh = weigh and not bins and can_weigh(head, param_maps)
    drawn = bins and isinstance(head, RandomForestClassifier)
    try:
        folded = with_fold(df, ids, k)
        if before or not (weigh or bins):
            folded = materialize(folded, "folds", sort_by=["fold", *ids], path=path)
            if isinstance(head, RandomForestClassifier):  # draws go by partition, and a folder is listed in any order
                folded = spark.read.schema(folded.schema).parquet(*sorted(folded.inputFiles()))
        whole = folded  # of weighted or binned rows the ones they come from
        if weigh:
            folded = weighted_rows(folded.drop(*(c for c in ids if c != label)), light_path)
            head = head.copy({head.weightCol: WEIGHT})
        elif bins:
            folded = materialize(binned_cells(folded, ids, label, head, param_maps, WEIGHT), "cells", path=light_path)
            head = head if drawn else head.copy({head.weightCol: WEIGHT})
        settings = [share_depths, share_trees, "bins"] if bins else [share_depths, True] if share_trees else share_depths
        book = Ledger(spark, ledger, search_key(folded, stages, param_maps, k, label, settings)) if ledger else None
        width = vector_width(folded, head.getOrDefault("featuresCol")) if drawn else None
        groups = depth_groups(head, param_maps, share_depths, share_trees, drawn, width)
        means, folds = _mean_scores(folded, whole, before, head, groups, len(param_maps), label, metric, parallelism, book, drawn)
        best = max(range(len(param_maps)), key=lambda i: (means[i] is not None, round(means[i] or 0.0, DIGITS), -i))
        model = None
        if refit:
            fixed = Pipeline(stages=before).fit(whole.drop("fold")).stages if before else []
            light = PipelineModel(fixed).transform((whole if bins else folded).drop("fold"))
            model = PipelineModel([*fixed, (stages[-1] if bins else head).copy(param_maps[best]).fit(light)])
    finally:
        discard(spark, path)
        discard(spark, light_path)
    points = [{p.name: v for p, v in point.items()} for point in param_maps]
    rows = [(i, _describe(points[i]), metric, means[i], folds, i == best) for i in range(len(param_maps))]
    schema = "point int, params string, metric string, avg_metric double, folds int, best boolean"
    return TunedModel(model, points[best], spark.createDataFrame(rows, schema))


def _mean_scores(
    folded: DataFrame,
    whole: DataFrame,
    before: Sequence[Estimator],
    head: Estimator,
    groups: Sequence[Group],
    n_points: int,
    label: str,
    metric: str,
    parallelism: int,
    book: Ledger | None,
    drawn: bool = False,
) -> tuple[list[float | None], int]:
    """Mean score per grid point, and the number of folds that have rows."""
    present = [row[0] for row in folded.select("fold").distinct().collect()]  # at most k rows
    if len(present) < 2:
        raise ValueError("cross-validation needs rows in at least two folds")
    on_thread = inheritable_thread_target(folded.sparkSession)
    known = book.known() if book else {}

    def score_fold(fold: int) -> list[float | None]:
        counts = dict(known.get(fold, {}))
        missing = [g for g in groups if not set(g.depths) <= set(counts)]
        if missing:
            training = folded.filter(F.col("fold") != fold).drop("fold")
            validation = folded.filter(F.col("fold") == fold).drop("fold")
            if before:
                with _ONE_SOLVER:
                    fixed = Pipeline(stages=before).fit(whole.filter(F.col("fold") != fold).drop("fold"))
                training, validation = fixed.transform(training), fixed.transform(validation)
            if drawn:
                training, drew = ready_cells(training, label, max(len(tree_estimators(head, g.deepest)) for g in missing))
        for start in range(0, len(missing), MODELS_PER_SCAN):
            chunk = missing[start : start + MODELS_PER_SCAN]
            if drawn:
                trees = [tree_estimators(head, g.deepest) for g in chunk]
                jobs = [(estimator, training.where(F.col(weight) > 0)) for own in trees for t, (estimator, weight) in enumerate(own) if t in drew]
                grown = iter(list(fits.map(on_thread(lambda job: job[0].fit(job[1])), jobs)))
                models = [[next(grown) if t in drew else None for t in range(len(own))] for own in trees]
            else:
                models = list(fits.map(on_thread(lambda g: head.fit(training, dict(g.deepest))), chunk))
            plain = [i for i, g in enumerate(chunk) if len(g.depths) == 1 and not drawn]  # fitted as they are
            nested = [i for i, g in enumerate(chunk) if len(g.depths) > 1 or drawn]
            fresh: dict[int, list[tuple]] = {p: [] for g in chunk for p in g.depths}
            if plain:
                found = _class_counts(predictions_side_by_side([models[i] for i in plain], validation, label))
                fresh |= {next(iter(chunk[plain[i]].depths)): c for i, c in found.items()}
            if nested:
                fresh |= _class_counts(stopped_predictions([models[i] for i in nested], [chunk[i] for i in nested], validation, label, fits, [c for c in (WEIGHT,) if c in folded.columns]))
            if book:
                book.add(fold, fresh)
            counts |= fresh
        return [_figure(counts[i], metric) for i in range(n_points)]

    # Folds run side by side only where a fold has too few fits to keep all threads busy,
    # so the driver never holds the models of many folds at once.
    abreast = max(1, parallelism // len(groups))
    with ThreadPoolExecutor(parallelism) as fits, ThreadPoolExecutor(abreast) as folds:
        per_fold = list(folds.map(on_thread(score_fold), sorted(present)))
    return [_mean([scores[i] for scores in per_fold]) for i in range(n_points)], len(present)


def _describe(point: Mapping[str, object]) -> str:
    return ", ".join(f"{name}={value}" for name, value in sorted(point.items())) or "defaults"


def _mean(scores: Sequence[float | None]) -> float | None:
    known = [score for score in scores if score is not None]
    return math.fsum(known) / len(known) if known else None
