"""One deep tree model in place of a shallower one for every depth of a grid.

A tree grows level by level, and where a node splits depends on the rows in it alone.  So the tree
of a smaller depth is the deep one stopped at that depth, each stopped node answering with the class
counts that it has kept.  Nodes are read as a table from the saved model; rows walk down once
and leave their answer at every depth that is asked for.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import Executor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.param import Param
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discern.sources.scratch import discard, scratch_path

DEPTH, TREES, SUBSET = "maxDepth", "numTrees", "featureSubsetStrategy"


@dataclass(frozen=True)
class Group:
    """Points that differ in depth, or in depth and trees, only: the fit of the largest, and the depth of each point by its place."""

    deepest: Mapping[Param, object]
    depths: Mapping[int, int]
    # by place the trees of a smaller forest, where the fit has more
    trees: Mapping[int, int] = field(default_factory=dict)


def exact_depths(head: Estimator, point: Mapping[Param, object]) -> bool:
    """Whether a stopped deep model is what a separate fit gives.

    A forest that draws columns for each node draws others at another depth, so its stopped form is
    a forest of that depth with draws of its own.
    """
    if isinstance(head, DecisionTreeClassifier):
        return True
    trees, subset = (point.get(head.getParam(p), head.getOrDefault(p)) for p in ("numTrees", "featureSubsetStrategy"))
    return subset == "all" or (subset == "auto" and trees == 1)


def sees_all_columns(subset: str, width: int) -> bool:
    """Whether a forest of several trees draws all columns for each node: its trees are then those without draws."""
    return subset == "all" or (subset in ("auto", "sqrt") and math.ceil(math.sqrt(width)) == width)


def depth_groups(head: Estimator, points: Sequence[Mapping[Param, object]], share: bool | None = None, share_trees: bool = False, drawn: bool = False, width: int | None = None) -> list[Group]:
    """Points by what they have besides the depth; a group of one is fitted as it is.

    ``share``: ``None`` joins points where that changes nothing, ``True`` also in forests that draw
    columns, ``False`` never.  ``share_trees`` with ``True`` also joins forests of two trees or more that differ in their number:
    trees are drawn and grown apart, so the first ones of a forest are a smaller forest with draws of
    its own.  One tree alone draws no rows, and stays apart.  Forests ``drawn`` tree by tree
    (``discern.operators.binning``) share trees wherever they share depths, as that changes nothing in them.
    ``width``, the number of features, joins drawn forests that see all columns under another name.
    """
    own_depth = [int(p.get(head.getParam(DEPTH), head.getOrDefault(DEPTH))) if head.hasParam(DEPTH) else 0 for p in points]
    alone = [Group(p, {i: own_depth[i]}) for i, p in enumerate(points)]
    if share is False or not isinstance(head, (DecisionTreeClassifier, RandomForestClassifier)) or head.isDefined("thresholds"):
        return alone
    depth = head.getParam(DEPTH)
    many = head.getParam(TREES) if (drawn or share and share_trees) and isinstance(head, RandomForestClassifier) else None

    def trees(i: int) -> int:
        return int(points[i].get(many, head.getOrDefault(TREES))) if many else 1

    found: dict[object, list[int]] = defaultdict(list)
    for i, point in enumerate(points):
        free = {DEPTH, TREES} if trees(i) > 1 else {DEPTH}
        subset = head.getParam(SUBSET) if drawn and width else None
        if subset and sees_all_columns(point.get(subset, head.getOrDefault(subset)), width):
            point = {**point, subset: "all"}
        rest = (trees(i) > 1, *sorted((p.name, repr(v)) for p, v in point.items() if p.name not in free))
        found[rest if share or exact_depths(head, point) else i].append(i)
    groups = []
    for own in found.values():
        depths = {i: own_depth[i] for i in own}
        if len({trees(i) for i in own}) > 1:
            largest = {**points[own[0]], depth: max(depths.values()), many: max(map(trees, own))}
            groups.append(Group(largest, depths, {i: trees(i) for i in own}))
        else:
            groups.append(Group(points[max(own, key=lambda i: depths[i])], depths))
    return groups


def joined(forests: Sequence[Model], spark: SparkSession) -> Model:
    """The trees of several forests as one, which is saved at once."""
    java = spark.sparkContext._jvm.org.apache.spark.ml.classification
    trees = [tree for forest in forests for tree in forest._java_obj.trees()]
    array = spark.sparkContext._gateway.new_array(java.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    first = forests[0]
    made = java.RandomForestClassificationModel(first.uid, array, first.numFeatures, max(f.numClasses for f in forests))
    return RandomForestClassificationModel(made)


def node_tables(models: Sequence[Model], spark: SparkSession, pool: Executor, root: str) -> DataFrame:
    """``model, tree, id, prediction, stats, left, right, feature, values, categories`` of the nodes of all models.

    A leaf has -1 for its children.  ``values`` is the threshold, or the categories that go left.
    The models are saved below ``root``.
    """
    list(pool.map(lambda i: models[i].write().save(f"{root}/m{i}"), range(len(models))))
    parts = []
    for kind in (False, True):
        paths = [f"{root}/m{i}/data" for i, m in enumerate(models) if hasattr(m, "trees") == kind]
        if not paths:
            continue
        rows = spark.read.parquet(*paths).withColumn("model", F.regexp_extract(F.input_file_name(), r"/m(\d+)/data/", 1).cast("int"))
        rows = rows.select("model", F.col("treeID").alias("tree"), "nodeData.*") if kind else rows.withColumn("tree", F.lit(0))
        parts.append(rows.select(
            "model", "tree", "id", "prediction", F.col("impurityStats").alias("stats"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
            F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("values"), F.col("split.numCategories").alias("categories"),
        ))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def stopped_tree(nodes: Sequence, depths: Sequence[int]) -> dict:
    """Arrays of one tree, and for each depth the class shares with which each node answers there.

    A pair of ends with one prediction is one end in a fitted tree: what a stopped tree merges
    that way answers with the counts of the node above.
    """
    nodes = sorted(nodes, key=lambda n: n["id"])
    left, right = (np.array([n[c] for n in nodes], np.int64) for c in ("left", "right"))
    stats = np.array([n["stats"] for n in nodes], float)
    level, chosen = np.zeros(len(nodes), np.int64), stats.argmax(axis=1)
    inner = np.flatnonzero(left >= 0)
    for i in inner.tolist():  # a node comes before its children
        level[left[i]] = level[right[i]] = level[i] + 1
    answers = {}
    for depth in depths:
        end = (left < 0) | (level >= depth)
        for i in reversed(inner.tolist()):
            if not end[i]:
                end[i] = bool(end[left[i]] and end[right[i]] and chosen[left[i]] == chosen[right[i]])
        source = np.arange(len(nodes))
        for i in inner.tolist():
            if end[i]:  # all below answers with this node
                source[left[i]] = source[right[i]] = source[i]
        total = stats.sum(axis=1, keepdims=True)
        answers[depth] = np.divide(stats, total, out=np.zeros_like(stats), where=total > 0)[source]
    left_values = [set(n["values"]) if n["categories"] >= 0 and n["left"] >= 0 else None for n in nodes]
    threshold = np.array([n["values"][0] if n["left"] >= 0 and n["categories"] < 0 and n["values"] else np.inf for n in nodes])
    return {
        "left": left, "right": right, "feature": np.array([n["feature"] for n in nodes], np.int64), "threshold": threshold,
        "categories": {i: s for i, s in enumerate(left_values) if s is not None}, "answers": answers,
    }


def _walkers(models: Sequence[Sequence[dict]], points: Sequence[Sequence[tuple[int, int, int]]], label: int, vector: int, kept: Sequence[str] = ()):
    """The function that workers run: rows to (label, model, prediction, kept columns), ``model`` being a point's place."""
    used = np.unique(np.concatenate([t["feature"][t["left"] >= 0] for m in models for t in m] or [np.zeros(0, np.int64)]))

    def columns(vectors: pa.StructArray) -> np.ndarray:
        import pyarrow.compute as pc

        stored = vectors.field("values")
        lengths = pc.fill_null(pc.list_value_length(stored), 0).to_numpy(zero_copy_only=False)
        values = stored.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(vectors)), lengths)
        sparse = np.repeat(pc.fill_null(vectors.field("type"), 0).to_numpy(zero_copy_only=False) == 0, lengths)
        indices = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        indices[sparse] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(vectors), len(used)))
        if len(used):
            at = np.minimum(np.searchsorted(used, indices), len(used) - 1)
            known = used[at] == indices
            out[rows[known], at[known]] = values[known]
        return out

    def walk(tree: dict, x: np.ndarray, depths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        node, place = np.zeros(len(x), np.int64), np.searchsorted(used, tree["feature"])
        everyone = np.arange(len(x))
        for level in range(max(depths) + 1):
            if level in depths:
                yield level, tree["answers"][level][node]
            going = everyone[tree["left"][node] >= 0]
            if not len(going):
                for depth in depths:
                    if depth > level:
                        yield depth, tree["answers"][depth][node]
                return
            here = node[going]
            value = x[going, place[here]]
            goes_left = value <= tree["threshold"][here]
            for i in np.unique(here).tolist() if tree["categories"] else ():
                if i in tree["categories"]:
                    own = here == i
                    goes_left[own] = np.isin(value[own], list(tree["categories"][i]))
            node[going] = np.where(goes_left, tree["left"][here], tree["right"][here])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = columns(batch.column(vector))
            for trees, own in zip(models, points):
                depths = sorted({d for _, d, _ in own})
                votes = dict.fromkeys(depths, 0.0)
                asked = []
                for grown, tree in enumerate(trees, 1):
                    for depth, share in walk(tree, x, depths):
                        votes[depth] = votes[depth] + share
                    # a point without a number of trees takes all of them
                    asked += [(point, votes[depth].argmax(axis=1).astype(float)) for point, depth, most in own if grown == (most or len(trees))]
                for point, found in asked:
                    names = ["label", "model", "prediction", *kept]
                    more = [batch.column(vector + 1 + i) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([batch.column(label), pa.array(np.full(len(found), point, np.int32)), pa.array(found), *more], names=names)

    return run


# A tree of a forest that drew no row: it has no vote.
NO_TREE = {"id": 0, "stats": [0.0], "left": -1, "right": -1, "feature": -1, "values": [], "categories": -1}


def stopped_predictions(models: Sequence[Model | Sequence[Model | None]], groups: Sequence[Group], rows: DataFrame, label: str, pool: Executor, kept: Sequence[str] = ()) -> DataFrame:
    """``label, model, prediction`` and the ``kept`` doubles of the row, of every point of ``groups``: one scan of ``rows``, one walk a tree.

    ``models`` are the fits of the groups' deepest points, or lists of a forest's trees, ``None`` for one that drew no row;
    ``model`` is the place of a point in the grid.
    """
    spark = rows.sparkSession
    root = scratch_path(spark, "trees")
    nodes: dict[tuple[int, int], list] = defaultdict(list)
    flat = list(pool.map(lambda m: joined([t for t in m if t is not None], spark) if isinstance(m, list) else m, models))
    for node in node_tables(flat, spark, pool, root).collect():  # the nodes of models that the driver holds
        nodes[node["model"], node["tree"]].append(node)
    discard(spark, root)
    made = []
    for i, (model, g) in enumerate(zip(models, groups)):
        own = iter([nodes[key] for key in sorted(nodes) if key[0] == i])
        grown = [[NO_TREE] if t is None else next(own) for t in model] if isinstance(model, list) else own
        made.append([stopped_tree(tree, sorted(set(g.depths.values()))) for tree in grown])
    features = next(t for m in models for t in (m if isinstance(m, list) else [m]) if t is not None).getOrDefault("featuresCol")
    run = _walkers(made, [[(p, d, g.trees.get(p, 0)) for p, d in sorted(g.depths.items())] for g in groups], 0, 1, kept)
    known: Column = F.col(label).isNotNull()
    return rows.where(known).select(F.col(label).cast("double").alias("label"), features, *kept).mapInArrow(run, ", ".join(["label double, model int, prediction double", *[f"{c} double" for c in kept]]))
