"""Cases that once gave wrong results."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from discern.operators import classifiers as C
from discern.operators import features as X
from discern.operators import metrics as M
from discern.operators.importance import permutation_importance, tree_importances
from discern.operators.profile import profile
from discern.operators.ranking import prefix_sums
from discern.operators.split import sample_with_replacement, with_split
from discern.operators.tuning import cross_validate, grid
from discern.sources.tables import spread


def test_many_copies_a_row(spark):
    rows = spark.range(400)
    n = sample_with_replacement(rows, ["id"], 300.0).groupBy("id").count().toPandas()["count"]
    assert abs(n.mean() - 300) < 3 * np.sqrt(300 / 400) and 200 < n.min() and n.max() < 400
    with pytest.raises(ValueError):
        sample_with_replacement(rows, ["id"], 1e6)


def test_fine_part_is_not_empty(spark):
    parts = with_split(spark.range(1_000_000), ["id"], (99.999, 0.001)).groupBy("split").count().collect()
    assert {r.split for r in parts} == {0, 1} and min(r["count"] for r in parts) < 40


def test_fold_width_without_entries_and_with_null(spark):
    schema = StructType([StructField("id", LongType()), StructField("features", VectorUDT())])
    rows = [(1, Vectors.sparse(9, {})), (2, None), (3, Vectors.sparse(9, {1: 2.0, 5: 1.0})), (4, Vectors.dense(range(9)))]
    for some in (rows, rows[:1], rows[:2]):
        table = spark.createDataFrame(some, schema).coalesce(1)
        got = {r.id: r.features for r in X.fold_width(table, 4).collect()}
        assert got[1].toArray().tolist() == [0, 0, 0, 0] and (2 not in got or got[2] is None)
    got = {r.id: r.features for r in X.fold_width(spark.createDataFrame(rows, schema).coalesce(1), 4).collect()}
    assert got[3].toArray().tolist() == [0, 3, 0, 0] and got[4].toArray().tolist() == [0 + 4 + 8, 1 + 5, 2 + 6, 3 + 7]


def test_covariance_at_large_means_and_unequal_lengths(spark):
    x = np.random.default_rng(1).normal(1e8, 1.0, (500, 3))
    table = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").repartition(5)
    want = np.cov(x.T)
    for r in X.covariance(table).collect():
        assert r.covariance == pytest.approx(want[r.i, r.j], abs=1e-6)
    with pytest.raises(PySparkException):
        X.covariance(spark.createDataFrame([([1.0],), ([2.0, 3.0, 4.0],)], "features array<double>")).collect()


def test_importance_through_a_pipeline(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3)) * [1, 5, 1]
    rows = [(i, *map(float, v), float(v[0] > 0)) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "id long, a double, b double, c double, label double")
    vectors = X.assembler(["a", "b", "c"])
    lr = C.classifier("logistic_regression", featuresCol="pca_features", maxIter=50, regParam=0.0)
    model = Pipeline(stages=[vectors, X.principal_components(vectors.transform(table), 3), lr]).fit(table)
    own = model.transform(table).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    found = {r.feature: r for r in permutation_importance(table, model, ["a", "b", "c"], ["id"], buckets=4).collect()}
    assert found["a"].accuracy == pytest.approx(own) and own > 0.9
    assert found["a"].importance > 0.3 and abs(found["b"].importance) < 0.1
    tree = C.classifier("decision_tree", featuresCol="pca_features")
    model = Pipeline(stages=[vectors, X.principal_components(vectors.transform(table), 3), tree]).fit(table)
    with pytest.raises(ValueError):
        tree_importances(table, model, ["a", "b", "c"])


def test_profile_counts_zero_once(spark):
    table = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (float("nan"),), (None,)], "v double")
    assert profile(table).first().n_distinct == 3


def test_winner_does_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(3)
    rows = [(i, Vectors.dense(rng.normal(size=2)), float(i % 3)) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, features vector, label double") if False else spark.createDataFrame(
        [(i, v, y) for i, v, y in rows], StructType([StructField("id", LongType()), StructField("features", VectorUDT())]).add("label", "double")
    )
    tree = C.classifier("decision_tree")
    winners = set()
    for parts in (1, 3, 7):
        result = cross_validate(table.repartition(parts), tree, grid(tree, {"maxDepth": [2, 3, 2]}), ["id"], 3, refit=False).results
        scores = [r.avg_metric for r in result.orderBy("point").collect()]
        assert scores[0] == scores[2]
        winners.add(tuple(r.point for r in result.where("best").collect()))
    assert len(winners) == 1


def test_class_figures_agree_with_the_report(spark):
    counts = spark.createDataFrame([(0.0, 0.0, 5), (0.0, 1.0, 2), (1.0, 1.0, 7), (2.0, 0.0, 1), (2.0, 3.0, 4)], "actual double, predicted double, n long")
    classes = [tuple(r) for r in M.per_class(counts).orderBy("class").select("n_actual", "n_predicted", "n_correct").collect()]
    report, figures = M.multiclass_report(counts).first(), M.class_figures(classes)
    assert all(report[k] == pytest.approx(v) for k, v in figures.items())


def test_prefix_sums_in_ranges(spark):
    table = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"), (F.col("id") % 5).alias("a"), (F.col("id") / 3).alias("b"))
    rows = prefix_sums(table.repartition(6), [F.col("v")], ["a", "b"]).orderBy("v").collect()
    a = b = 0
    for r in rows:
        assert r.before_a == a and r.before_b == pytest.approx(b)
        a, b = a + r.a, b + r.b


def test_spread_is_the_callers_choice(spark):
    assert spread(spark.range(100).coalesce(1), ["id"], 3).rdd.getNumPartitions() == 3


def test_ragged_embeddings_are_refused(spark, tmp_path):
    from discern.plans.inputs import embedding_table

    rows = [(1, [1.0, 2.0], 0), (2, [1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(PySparkException):
        embedding_table(spark, str(tmp_path)).collect()


def test_category_index_keeps_its_metadata(spark):
    table = spark.createDataFrame([("x", 1.0), ("y", 2.0), (None, 3.0), ("x", 4.0)], "c string, v double")
    indexed = X.index_categories(table)
    assert sorted(r.c for r in indexed.collect()) == [0.0, 0.0, 1.0, 2.0]
    assert indexed.schema["c"].metadata["ml_attr"] == {"type": "nominal", "name": "c", "num_vals": 3}


def test_first_n_without_a_sort(spark):
    """Any number of rows, with a hot id and null ids, is what the shuffled order starts with."""
    from discern.operators.split import shuffle_rows, shuffled_top

    rows = spark.createDataFrame([(k % 300 if k % 3 else 7,) for k in range(900)] + [(None,)] * 5, "id long").repartition(4)
    order = [r.id for r in shuffle_rows(rows, ["id"]).collect()]
    for n in (0, 1, 10, 90, 400, 905, 2000):
        got = shuffled_top(rows, ["id"], n)
        assert sorted(map(str, (r.id for r in got.collect()))) == sorted(map(str, order[:n])), n
