"""Feature importances: those of a tree model, and by permutation for any model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discern.functions.hashing import hash_bucket, hash_hex
from discern.operators.classifiers import last_stage

PERMUTE_SEED = 31337
# Rows exchange values within buckets, each sorted by one task: about one for 100,000 rows, and several rows in each.
BUCKETS = 32
# Hex digits of the order by which a bucket is cut into slices, each of them sorted on its own.
SLICE_DIGITS = 3


def after_assembling(model: Model, features: str = "features") -> list[Model]:
    """The stages of a fitted model that follow the one that makes ``features``."""
    stages = list(model.stages) if isinstance(model, PipelineModel) else [model]
    made = [i for i, s in enumerate(stages) if s.hasParam("outputCol") and s.getOrDefault("outputCol") == features]
    return stages[made[-1] + 1 :] if made else stages


def tree_importances(df: DataFrame, model: Model, names: Sequence[str]) -> DataFrame:
    """``feature, importance`` of a fitted tree or forest, with the rows it was scored for."""
    if len(after_assembling(model)) > 1:
        raise ValueError("the importances belong to the outputs of earlier stages, not to the columns")
    values = last_stage(model).featureImportances.toArray()
    pairs = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.lit(float(v)).alias("importance")) for n, v in zip(names, values)]
    )
    return df.agg(F.count("*").alias("n_rows")).select(F.inline(pairs), "n_rows")


def with_donor(
    df: DataFrame,
    columns: Sequence[str],
    ids: Sequence[str],
    buckets: int = BUCKETS,
    seed: int = PERMUTE_SEED,
) -> DataFrame:
    """Add ``donor_<c>``: the values of another row, so that each row gives its values once.

    Rows fall into hash buckets of their (unique) id; inside a bucket each row takes
    from the row before it in hash order, the first one from the last.  The permutation
    depends on the ids, the seed and the number of ``buckets`` alone.

    A bucket is sorted in slices of the hash order, 4,096 at most, so a task's rows do not follow
    from the number of buckets.  A slice's first row takes from the last row of the slice before,
    by a broadcast table of one row a slice.
    """
    # of the hash's digits the bucket takes the first eight, so the slice's rows lie in all buckets
    keyed = df.withColumns({"_bucket": hash_bucket(ids, seed, buckets), "_order": hash_hex(ids, seed)})
    keyed = keyed.withColumn("_slice", F.substring("_order", 1, SLICE_DIGITS))
    packed = F.struct(*columns)
    # equal ids: the values decide, so that the slice's last row is the same one here and below
    order = [F.col(c) for c in ["_order", *ids, *columns]]
    ends = keyed.groupBy("_bucket", "_slice").agg(F.max_by(packed, F.struct(*order)).alias("_end"))
    slices = Window.partitionBy("_bucket").orderBy("_slice")
    whole = slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ends.select("_bucket", "_slice", F.coalesce(F.lag("_end").over(slices), F.last("_end").over(whole)).alias("_before"))
    window = Window.partitionBy("_bucket", "_slice").orderBy(*order)
    donor = F.coalesce(F.lag(packed).over(window), F.col("_before"))
    return (
        keyed.join(F.broadcast(before), ["_bucket", "_slice"])
        .withColumn("_donor", donor)
        .select(*df.columns, *[F.col(f"_donor.{c}").alias(f"donor_{c}") for c in columns])
    )


def permuted_accuracy(
    rows: DataFrame, columns: Sequence[str], predict, label: str = "label"
) -> DataFrame:
    """Accuracy as is and with one column at a time taken from the donor, in one scan.

    ``predict`` maps a dict of columns to a prediction column.
    """
    own = {c: F.col(c) for c in columns}
    hits: list[Column] = [F.avg((predict(own) == F.col(label)).cast("double")).alias("base")]
    for i, c in enumerate(columns):
        changed = {**own, c: F.col(f"donor_{c}")}
        hits.append(F.avg((predict(changed) == F.col(label)).cast("double")).alias(f"a_{i}"))
    one = rows.agg(F.count("*").alias("n_rows"), *hits)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col("base").alias("accuracy"), F.col(f"a_{i}").alias("permuted_accuracy"))
            for i, c in enumerate(columns)
        ]
    )
    return one.select(F.inline(pairs), "n_rows").withColumn("importance", F.col("accuracy") - F.col("permuted_accuracy"))


def permutation_importance(
    df: DataFrame,
    model: Model,
    columns: Sequence[str],
    ids: Sequence[str],
    label: str = "label",
    buckets: int = BUCKETS,
    features: str = "features",
) -> DataFrame:
    """Loss of accuracy of a fitted classifier when one feature column is permuted.

    ``columns`` are the numeric columns that make up the feature vector, in order.  Of a
    pipeline all stages after the one that assembles ``features`` are applied.
    One shuffle provides the donors.  Each row is then scored as it is and once per
    column inside the same stage, and only one hit count per column leaves a task.
    """
    stages = after_assembling(model, features)
    head = stages[-1]
    rows = with_donor(df.select(*ids, F.col(label), *columns), columns, ids, buckets)
    own = F.array(*[F.col(c).cast("double") for c in columns])
    donor = F.array(*[F.col(f"donor_{c}").cast("double") for c in columns])
    variants = rows.select(
        F.col(label).cast("double").alias("_label"),
        own.alias("_own"),
        donor.alias("_donor"),
        F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1))).alias("_changed"),
    )
    mixed = F.transform(
        F.arrays_zip("_own", "_donor"),
        lambda pair, i: F.when(i == F.col("_changed"), pair["_donor"]).otherwise(pair["_own"]),
    )
    scored = variants.select("_label", "_changed", array_to_vector(mixed).alias(features))
    for stage in stages[:-1]:
        scored = stage.transform(scored)
    extra = {head.getParam("predictionCol"): "_prediction"}
    extra |= {head.getParam(p): "" for p in ("rawPredictionCol", "probabilityCol") if head.hasParam(p)}
    scored = head.copy(extra).transform(scored)
    hits = scored.groupBy("_changed").agg(F.avg((F.col("_prediction") == F.col("_label")).cast("double")).alias("a"))
    by_column = hits.agg(F.map_from_entries(F.collect_list(F.struct("_changed", "a"))).alias("a"))  # one entry per column
    names = F.array(*[F.lit(c) for c in columns])
    return (
        by_column.select("a", F.posexplode(names).alias("_i", "feature"))
        .select("feature", F.col("a")[F.lit(-1)].alias("accuracy"), F.col("a")[F.col("_i")].alias("permuted_accuracy"))
        .withColumn("importance", F.col("accuracy") - F.col("permuted_accuracy"))
    )
