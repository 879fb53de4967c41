"""Sources, cleaning, splits, samples and features."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from discern.operators import cleaning, features, split
from discern.operators.profile import profile
from discern.operators.ranking import global_row_number
from discern.sources import (
    materialize,
    persisted,
    read_labelled_csv,
    read_libsvm,
    read_wide_csv,
    scratch_path,
    wide_schema,
    write_libsvm,
)
from discern.sources.scratch import scratch_root


def write_text(path, text):
    with open(path, "w") as out:
        out.write(text)
    return str(path)


def test_missing_tokens(spark, tmp_path):
    path = write_text(tmp_path / "a.csv", "1,?,3,1\n2,5,?,2\n?,?,?,1\n4,8,9,2\n")
    rows = read_wide_csv(spark, path)
    assert [t for _, t in rows.dtypes] == ["string", "string", "string", "int"]
    clean = cleaning.cast_columns(cleaning.replace_token(rows, {"?": "0"}))
    assert [t for _, t in clean.dtypes] == ["double", "double", "double", "int"]
    assert clean.agg(F.sum("_c0"), F.sum("_c1"), F.sum("_c2")).collect()[0][:] == (7.0, 13.0, 12.0)
    assert [t for _, t in read_wide_csv(spark, path, missing="?").dtypes] == ["int"] * 4
    typed = read_wide_csv(spark, path, wide_schema(3), missing="?")
    assert typed.filter(F.col("_c1").isNull()).count() == 2
    assert cleaning.all_but_last(typed) == ["_c0", "_c1", "_c2"]
    assert cleaning.reverse_columns(typed).columns == ["_c3", "_c2", "_c1", "_c0"]


def test_string_columns_do_not_assemble(spark):
    rows = spark.createDataFrame([("a", 1.0)], "s string, x double")
    with pytest.raises(Exception, match="not supported"):
        features.assembler(["s", "x"]).transform(rows)


def test_libsvm(spark, tmp_path):
    path = write_text(tmp_path / "a.svm", "-1 1:0.5 7:1\n+1 3:1\n-1 2:2\n")
    rows = read_libsvm(spark, path)
    vectors = [r.features for r in rows.collect()]
    assert {v.size for v in vectors} == {7} and vectors[0] == Vectors.sparse(7, [0, 6], [0.5, 1.0])
    out = str(tmp_path / "copy")
    write_libsvm(rows, out)
    wide = read_libsvm(spark, out, 100)
    assert sorted((r.label, r.features.size, r.features.indices.tolist()) for r in wide.collect()) == [
        (-1.0, 100, [0, 6]),
        (-1.0, 100, [1]),
        (1.0, 100, [2]),
    ]


def test_label_outside_range_stops(spark, tmp_path):
    path = write_text(tmp_path / "a.csv", "1,2,0\n3,4,5\n")
    assert read_labelled_csv(spark, path, 2, 6).count() == 2
    with pytest.raises(Exception, match="label outside"):
        read_labelled_csv(spark, path, 2, 5).collect()
    first = read_labelled_csv(spark, write_text(tmp_path / "b.csv", "1,2,0.5\n"), 0, 2, n_columns=3).collect()[0]
    assert first.label == 1.0 and first.features == Vectors.dense(2.0, 0.5)


def test_scratch_uses_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert scratch_root(spark) == root.rstrip("/")
    df = spark.range(10).withColumn("part", (F.col("id") % 2).cast("int"))
    table = materialize(df, "test", ["part"])
    assert table.dtypes == df.dtypes and table.count() == 10
    with persisted(df) as cached:
        assert cached.storageLevel.useMemory and cached.count() == 10
    assert not df.storageLevel.useMemory
    assert "PartitionFilters: [isnotnull(part" in table.filter("part = 1")._jdf.queryExecution().toString()


def test_profile_exact_and_sketched(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", 2.0), (2, None, 2.0)], "i int, s string, d double")
    expected = {("i", "int", 3, 0, 2), ("s", "string", 3, 1, 1), ("d", "double", 3, 1, 1)}
    assert {tuple(r) for r in profile(rows).collect()} == expected
    assert {tuple(r) for r in profile(rows, exact=False).collect()} == expected
    assert {tuple(r) for r in profile(rows, ["i"]).collect()} == {("i", "int", 3, 0, 2)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), weights=st.lists(st.integers(1, 9), min_size=2, max_size=4))
def test_split_is_disjoint_complete_and_stable(spark, seed, weights):
    rows = spark.range(500)
    parts = [{r.id for r in p.collect()} for p in split.hash_split(rows, ["id"], weights, seed)]
    assert sum(map(len, parts)) == 500 and set().union(*parts) == set(range(500))
    again = [{r.id for r in p.collect()} for p in split.hash_split(rows.repartition(7), ["id"], weights, seed)]
    assert parts == again


def test_split_keeps_rows_with_null_ids(spark):
    rows = spark.createDataFrame([(None, 1), (1, None), (None, None), (2, 2)], "a int, b int")
    assert sum(p.count() for p in split.hash_split(rows, ["a", "b"])) == 4
    stored = split.stored_split(rows, ["a", "b"], (1, 1))
    assert sum(p.count() for p in stored) == 4 and stored[0].columns == ["a", "b"]


def test_folds_and_samples(spark):
    rows = spark.range(20_000)
    sizes = [r["count"] for r in split.with_fold(rows, ["id"], 10).groupBy("fold").count().collect()]
    assert len(sizes) == 10 and min(sizes) > 1800
    drawn = split.sample_with_replacement(rows, ["id"], 0.5)
    per_row = {r.id: r["count"] for r in drawn.groupBy("id").count().collect()}
    assert abs(sum(per_row.values()) / 20_000 - 0.5) < 0.02
    share = sum(1 for n in per_row.values() if n >= 2) / 20_000
    assert abs(share - (1 - 1.5 * math.exp(-0.5))) < 0.01
    again = split.sample_with_replacement(rows.repartition(5), ["id"], 0.5)
    assert again.exceptAll(drawn).isEmpty() and again.count() == drawn.count()
    top = [r.id for r in split.shuffled_top(rows, ["id"], 50).collect()]
    assert len(set(top)) == 50 and top != sorted(top)
    assert top == [r.id for r in split.shuffled_top(rows.repartition(3), ["id"], 50).collect()]


def test_label_index_is_the_stock_indexers(spark):
    rows = spark.createDataFrame([(x,) for x in (-1.0, 1.0, 1.0, -1.0, 3.0)], "label double")
    found = {float(r.value): r.label_index for r in features.label_index(rows, "label").collect()}
    assert found == {-1.0: 0, 1.0: 1, 3.0: 2}
    labels = StringIndexer(inputCol="label", outputCol="i").fit(rows).labels
    assert [float(x) for x in labels] == sorted(found, key=found.get)


def test_global_row_number_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    numbered = global_row_number(rows, [F.col("v").desc()]).collect()
    assert [r.row_number for r in sorted(numbered, key=lambda r: -r.v)] == list(range(5000))


def test_fold_width_against_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = []
    for i in range(60):
        index = np.sort(rng.choice(1000, size=rng.integers(0, 30), replace=False))
        vectors.append((i, Vectors.sparse(1000, index.tolist(), rng.normal(size=len(index)).tolist())))
    vectors.append((60, Vectors.dense(rng.normal(size=1000))))
    rows = spark.createDataFrame(vectors, ["id", "features"]).repartition(4)
    folded = features.fold_width(rows, 37)
    assert features.vector_width(folded) == 37
    for r in folded.collect():
        expected = np.zeros(37)
        np.add.at(expected, np.arange(1000) % 37, vectors[r.id][1].toArray())
        assert r.features.size == 37 and np.allclose(r.features.toArray(), expected)


def test_workers_do_not_need_the_package(tmp_path):
    from pyspark import cloudpickle

    pickled = tmp_path / "fold"
    pickled.write_bytes(cloudpickle.dumps(features._vector_folder(1, 8)))
    code = f"import pickle; print(callable(pickle.load(open({str(pickled)!r}, 'rb'))))"
    run = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True)
    assert run.stdout.strip() == "True", run.stderr


def test_covariance_and_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 1e4
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(5)
    expected = np.cov(x, rowvar=False)
    for r in features.covariance(rows, "v").collect():
        assert r.covariance == pytest.approx(expected[r.i, r.j], rel=1e-7, abs=1e-6)
    centred = spark.createDataFrame([(i, Vectors.dense(r - x.mean(axis=0))) for i, r in enumerate(x)], ["id", "features"])
    model = features.principal_components(centred, 6).fit(centred)
    pc = model.pc.toArray()
    assert np.allclose(pc.T @ pc, np.eye(6), atol=1e-9)
    values = np.sort(np.linalg.eigvalsh(expected))[::-1]
    assert np.allclose(model.explainedVariance.toArray(), values / values.sum(), atol=1e-9)
    scores = np.array([r.p for r in model.transform(centred).select(vector_to_array("pca_features").alias("p")).collect()])
    assert np.allclose(np.sort(scores.var(axis=0, ddof=1))[::-1], values)


def test_pca_refuses_what_does_not_fit(spark):
    rows = spark.createDataFrame([(Vectors.sparse(70_000, [1], [1.0]),)], ["features"])
    with pytest.raises(ValueError, match="too many"):
        features.principal_components(rows, 5)
    with pytest.raises(ValueError, match="k must lie"):
        features.principal_components(spark.createDataFrame([(Vectors.dense(1, 2),)], ["features"]), 3)


def test_categories_and_imputer(spark):
    rows = spark.createDataFrame([("a", 1.0, 5), ("b", None, 7), ("a", 3.0, 5)], "s string, x double, y int")
    indexed = {tuple(r) for r in features.index_categories(rows, "y").collect()}
    assert indexed == {(0.0, 1.0, 0.0), (1.0, None, 1.0), (0.0, 3.0, 0.0)}
    joined = {tuple(r) for r in features.index_categories(rows.union(spark.createDataFrame([(None, 0.0, 9)], rows.schema))).collect()}
    assert joined == {(0.0, 1.0, 5), (1.0, None, 7), (0.0, 3.0, 5), (2.0, 0.0, 9)}
    filled = features.imputer(["x"]).fit(rows).transform(rows)
    assert sorted(r.x for r in filled.collect()) == [1.0, 2.0, 3.0]


def test_hashed_terms_keep_the_whole_text(spark):
    text = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "  ")], "id int, text string")
    counted = features.hashed_terms(rows, "text", 1 << 10).select("id", vector_to_array("features").alias("v")).collect()
    assert {r.id: sum(r.v) for r in counted} == {1: 30_000.0, 2: 0.0, 3: 0.0}


def test_plans_prune_columns(spark, sf_dir):
    from discern.plans.catalog import QUERIES

    plan = QUERIES["confusion_long"](spark, sf_dir)._jdf.queryExecution().toString()
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert sorted(c.split(":")[0] for c in read.split(",")) == ["l_linenumber", "l_quantity"]
    assert os.path.basename(scratch_path(spark, "x")).startswith("x-")
