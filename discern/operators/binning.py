"""Rows of a tree search as weighted cells.

A tree sees a feature in at most ``maxBins`` bins.  Here the bins of a search are chosen once, from
all rows' features, and rows that agree in fold, label and bins become one cell with their number.
Single trees are fitted on cells by weight.  A forest draws each row a Poisson number of times for
each tree; here the number comes from a hash of the row's id, before the rows are joined, and every
tree is fitted by itself on the cells that it drew.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discern.functions.hashing import HASHES
from discern.operators.split import poisson_cuts

Point = Mapping[Param, object]

# Classes that Spark's classifiers count by themselves.
MOST_CLASSES = 100


def _values(head: Estimator, points: Sequence[Point], name: str) -> list:
    param = head.getParam(name)
    return [point.get(param, head.getOrDefault(param)) for point in points]


def can_bin(head: Estimator, points: Sequence[Point]) -> bool:
    """Whether fits on cells are fits of the rows: nothing may count rows whatever they weigh, and forests must draw alike."""
    if not isinstance(head, (DecisionTreeClassifier, RandomForestClassifier)) or head.isSet("weightCol") or head.isDefined("thresholds"):
        return False
    if any(n != 1 for n in _values(head, points, "minInstancesPerNode")):
        return False
    if isinstance(head, DecisionTreeClassifier):
        return True
    drawing = set(zip(_values(head, points, "bootstrap"), _values(head, points, "subsamplingRate"), _values(head, points, "seed")))
    return len(drawing) == 1 and all(b for b, _, _ in drawing) and min(_values(head, points, "numTrees")) > 1


def feature_values(rows: DataFrame, array: str, width: int, most: int) -> list[list[float]]:
    """Of each feature the lower ends of its bins: all its values if they are at most ``most``, else the least and quantiles."""
    if not width:
        return []
    cells = [F.get(array, F.lit(i)) for i in range(width)]
    shares = [i / most for i in range(1, most)]
    asked = [[F.approx_count_distinct(c, 0.05), F.min(c), F.percentile_approx(c, F.array(*map(F.lit, shares)), 10000)] for c in cells]
    found = rows.agg(*[a.alias(f"c{i}_{k}") for i, own in enumerate(asked) for k, a in enumerate(own)]).first()
    # the sets are bounded by the estimate of their sizes
    few = [i for i in range(width) if found[f"c{i}_0"] <= 2 * most]
    sets = rows.agg(*[F.collect_set(cells[i]).alias(f"c{i}") for i in few]).first() if few else {}
    out = []
    for i in range(width):
        values = set(sets[f"c{i}"]) if i in few else None
        if values is None or len(values) > most:
            values = {found[f"c{i}_1"], *(found[f"c{i}_2"] or [])} - {None}
        out.append(sorted(v + 0.0 for v in values))
    return out


def draws(ids: Sequence[str], seed: int, tree: int, rate: float) -> Column:
    """How often a forest's tree takes a row, Poisson with mean ``rate``: by a hash of the id, so copies of an id are drawn together."""
    number = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(tree), *[F.col(f"`{c}`") for c in ids]), 32)
    return sum(((number >= F.lit(math.ceil(cut * HASHES))).cast("int") for cut in poisson_cuts(rate)), F.lit(0))


def drawn_weight(tree: int) -> str:
    return f"_drawn_{tree}"


def binned_cells(folded: DataFrame, ids: Sequence[str], label: str, head: Estimator, points: Sequence[Point], weight: str) -> DataFrame:
    """``fold``, label and features of the cells, their number of rows as ``weight``, and what each tree of a forest drew."""
    name = head.getOrDefault("featuresCol")
    x = vector_to_array(F.col(f"`{name}`"))
    odd = F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    checked = F.when(x.isNull() | odd, F.raise_error(F.lit("a feature vector is null or holds NaN or an infinite value"))).otherwise(x)
    trees = range(max(_values(head, points, "numTrees"))) if isinstance(head, RandomForestClassifier) else []
    own = [draws(ids, int(head.getOrDefault("seed")) & 0x7FFFFFFF, t, float(_values(head, points, "subsamplingRate")[0])).alias(drawn_weight(t)) for t in trees]
    rows = folded.select("fold", F.col(f"`{label}`").alias("_label"), checked.alias("_x"), *own)
    first = rows.select(F.size("_x").alias("width")).first()
    width = first["width"] if first else 0
    bins = feature_values(rows.select("_x"), "_x", width, max(_values(head, points, "maxBins")))
    rows = rows.select("fold", "_label", *[F.get("_x", F.lit(i)).alias(f"_x{i}") for i in range(width)], *[drawn_weight(t) for t in trees])
    many = [i for i in range(width) if len(bins[i]) > 1]
    if many:
        splits = [[-math.inf, *bins[i][1:], math.inf] for i in many]
        rows = Bucketizer(splitsArray=splits, inputCols=[f"_x{i}" for i in many], outputCols=[f"_b{i}" for i in many]).transform(rows)
    sums = [F.sum(drawn_weight(t)).cast("double").alias(drawn_weight(t)) for t in trees]
    cells = rows.groupBy("fold", "_label", *[f"_b{i}" for i in many]).agg(F.count("*").cast("double").alias(weight), *sums)
    back = [F.element_at(F.array(*map(F.lit, bins[i])), F.col(f"_b{i}").cast("int") + 1) if i in many else F.lit(bins[i][0]) for i in range(width)]
    vector = array_to_vector(F.array(*back).cast("array<double>")).alias(name, metadata=folded.schema[name].metadata)
    return cells.select("fold", F.col("_label").alias(label), vector, weight, *[drawn_weight(t) for t in trees])


def ready_cells(training: DataFrame, label: str, trees: int) -> tuple[DataFrame, list[int]]:
    """Cells whose label tells all trees the number of classes, and the trees that drew a row; all, if none did."""
    found = training.agg(F.max(f"`{label}`").alias("most"), *[F.sum(drawn_weight(t)).alias(f"t{t}") for t in range(trees)]).first()
    drew = [t for t in range(trees) if found[f"t{t}"]] or list(range(trees))
    most = float(found["most"] if found["most"] is not None else -1.0)
    if not (0 <= most < MOST_CLASSES and most.is_integer()):
        return training, drew  # a fit refuses these labels
    known = {"ml_attr": {"type": "nominal", "name": label, "num_vals": int(most) + 1}}
    return training.withColumn(label, F.col(f"`{label}`").alias(label, metadata=known)), drew


def tree_estimators(head: RandomForestClassifier, point: Point) -> list[tuple[RandomForestClassifier, str]]:
    """The trees of a forest, each with the weight that it is fitted on."""
    trees, subset, seed = (_values(head, [point], name)[0] for name in ("numTrees", "featureSubsetStrategy", "seed"))
    one = {"numTrees": 1, "bootstrap": False, "subsamplingRate": 1.0, "featureSubsetStrategy": "sqrt" if subset == "auto" else subset}
    made = []
    for t in range(trees):
        settings = {**one, "weightCol": drawn_weight(t), "seed": int(seed) + t}
        made.append((head.copy({**point, **{head.getParam(k): v for k, v in settings.items()}}), drawn_weight(t)))
    return made
