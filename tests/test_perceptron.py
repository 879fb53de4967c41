"""The perceptron's own fit: Spark's weights, equal rows read once, rows that no fit may take."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from discern.operators import classifiers as C
from discern.operators import perceptron as P
from discern.operators.features import assembler

SCHEMA = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])

@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    made = spark.range(0, 256, 1, 1).select((n % 3).cast("double").alias("label"), (n * 37 % 101 / 101.0 + n % 3).alias("a"), (n * 53 % 89 / 89.0).alias("b"))
    return assembler(["a", "b"]).transform(made).select("label", "features").cache()


@pytest.mark.parametrize("steps", [0, 1, 8, 30])
def test_weights_are_those_of_sparks_solver(rows, steps):
    """Whole blocks in one partition, so that Spark weighs all rows alike."""
    settings = {"layers": [2, 5, 4, 3], "maxIter": steps, "seed": 3, "blockSize": 128, "tol": 1e-4}
    theirs = MultilayerPerceptronClassifier(**settings).fit(rows)
    ours = C.classifier("multilayer_perceptron", **settings).fit(rows)
    assert np.allclose(ours.weights.toArray(), theirs.weights.toArray(), rtol=1e-5, atol=1e-6)
    assert type(ours) is type(theirs) and ours.getMaxIter() == steps
    assert ours.transform(rows).select("prediction").collect() == theirs.transform(rows).select("prediction").collect()


def test_equal_rows_are_read_once(rows):
    """Copies change what rows weigh, not how many rows a pass of the solver reads."""
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("copy")
    assert P.distinct_rows(copies, "label", "features").count() == P.distinct_rows(rows, "label", "features").count()
    assert P.distinct_rows(copies, "label", "features").agg(F.sum("n")).first()[0] == 50 * 256
    nets = [C.perceptron(rows, 3, (5,), maxIter=10, seed=3).fit(df).weights.toArray() for df in (rows, copies)]
    assert np.allclose(*nets, rtol=1e-5, atol=1e-6)


def test_sparse_and_dense_rows_weigh_alike(spark):
    dense = [(float(i % 2), Vectors.dense([i % 2, 0.0, i / 9])) for i in range(9)]
    mixed = [(y, Vectors.sparse(3, list(enumerate(v))) if i % 2 else v) for i, (y, v) in enumerate(dense)]
    nets = [C.classifier("multilayer_perceptron", layers=[3, 4, 2], maxIter=5).fit(spark.createDataFrame(r, ["label", "features"])) for r in (dense, mixed)]
    assert np.allclose(nets[0].weights.toArray(), nets[1].weights.toArray(), rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("bad", [(2.0, [1.0, 2.0]), (None, [1.0, 2.0]), (0.5, [1.0, 2.0]), (1.0, None), (1.0, [1.0]), (1.0, [1.0, float("nan")])])
def test_rows_that_no_fit_may_take(spark, bad):
    rows = [(0.0, Vectors.dense([0.0, 1.0])), (bad[0], bad[1] and Vectors.dense(bad[1]))]
    with pytest.raises(Exception, match="label outside|no feature vector|NaN|wide"):
        C.classifier("multilayer_perceptron", layers=[2, 3, 2], maxIter=2).fit(spark.createDataFrame(rows, SCHEMA))



def test_no_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        C.classifier("multilayer_perceptron", layers=[2, 3, 2]).fit(spark.createDataFrame([], SCHEMA))


def test_deep_net_of_the_search_is_the_published_one(spark, tmp_path, monkeypatch):
    """cv_deep_mlp trains the 32-64-128 net with the published stopping rules, in every fold."""
    from discern.plans import catalog
    from discern.plans.inputs import LINE_ID, LINE_NUMERIC

    n = F.col("id")
    ids = [(n * k).alias(c) for k, c in enumerate(LINE_ID, 1)]
    lines = spark.range(60).select(*ids, (n % 50 + 1).cast("double").alias("l_quantity"), *[F.lit(0.0).alias(c) for c in LINE_NUMERIC[1:]])
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    fits, fit = [], P.Perceptron.fit

    def short(self, df, params=None):
        fits.append((list(self.getLayers()), self.getMaxIter(), self.getTol(), self.getSeed()))
        return fit(self.copy({self.maxIter: 1}), df, params)

    monkeypatch.setattr(P.Perceptron, "fit", short)
    assert [r.folds for r in catalog.cv_deep_mlp(spark, str(tmp_path)).collect()] == [3]
    assert fits == [([51, *C.HIDDEN_LAYERS["deep"], 4], 1000, 1e-4, 1234)] * 3
