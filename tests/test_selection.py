"""Supervised selection of features and the sketched curve area against plain versions."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from discern.operators.curves import auc, auc_sketch
from discern.operators.selection import best_features, chi_squared, reduced, selector


def vectors(spark, rows):
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])
    return spark.createDataFrame(rows, schema)


def plain(rows):
    rows = [(y, x.toArray()) for y, x in rows if y is not None and x is not None]
    labels, there = np.array([y for y, _ in rows]), np.array([x for _, x in rows]) != 0
    out = {}
    for place in np.flatnonzero(there.any(axis=0)).tolist():
        own, total = there[:, place], 0.0
        for y in np.unique(labels):
            for side in (own, ~own):
                expected = side.sum() * (labels == y).sum() / len(labels)
                total += ((side & (labels == y)).sum() - expected) ** 2 / expected if expected else 0.0
        out[place] = (int(own.sum()), total)
    return out


def test_chi_squared(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        y = float(rng.integers(3))
        x = (rng.random(30) < 0.2).astype(float) * rng.normal(size=30)
        x[5] = y == 1
        x[7] = 1.0  # in every row
        x[9] = 0.0  # in none
        x[11] = x[12] = float(y == 2 and k % 2)  # a tie
        rows.append((y, Vectors.dense(x) if k % 3 else Vectors.sparse(30, {i: v for i, v in enumerate(x.tolist()) if v or i == 9})))
    rows += [(None, Vectors.dense(np.ones(30))), (1.0, None)]
    table = vectors(spark, rows)
    want = plain(rows)
    got = {r.place: (r.n_rows, r.statistic) for r in chi_squared(table).collect()}
    assert got.keys() == want.keys() and 9 not in got and got[7] == (300, 0.0)
    for place, (n, statistic) in want.items():
        assert got[place][0] == n and got[place][1] == pytest.approx(statistic, abs=1e-9)
    order = sorted(want, key=lambda p: (-round(want[p][1], 9), p))
    best = best_features(table.repartition(5), 6).orderBy("rank").collect()
    assert [r.place for r in best] == order[:6] and [r["rank"] for r in best] == list(range(1, 7))
    assert best[0].place == 5 and order.index(12) == order.index(11) + 1
    assert best_features(table, 1000).count() == len(want)
    cut = reduced(table.where("label IS NOT NULL AND features IS NOT NULL"), selector(table, 6))
    kept = sorted(order[:6])
    assert sorted(tuple(r.features.toArray()) for r in cut.collect()) == sorted(tuple(x.toArray()[kept]) for y, x in rows if y is not None and x is not None)


def test_nothing_to_select(spark):
    empty = vectors(spark, [])
    assert chi_squared(empty).count() == 0 and best_features(empty, 3).count() == 0
    with pytest.raises(ValueError):
        selector(empty, 3)
    with pytest.raises(ValueError):
        best_features(empty, 0)


def test_wide_vectors_stay_sparse(spark):
    rows = [(float(k % 2), Vectors.sparse(1 << 28, {k % 2 * 200_000_000: 1.0, 1 + k: 2.0})) for k in range(50)]
    stage = selector(vectors(spark, rows), 2)
    assert stage.getIndices() == [0, 200_000_000]
    assert {(r.label, tuple(r.features.toArray())) for r in reduced(vectors(spark, rows), stage).collect()} == {(0.0, (1.0, 0.0)), (1.0, (0.0, 1.0))}


@pytest.mark.parametrize("bins", [1, 7, 100, 5000])
def test_sketched_area_is_within_its_bound(spark, bins):
    rng = np.random.default_rng(bins)
    rows = [(float(y), float(s)) for y, s in zip(rng.integers(0, 2, 2000), rng.normal(0.5, 0.3, 2000).round(2))]
    rows = [(y, s + 0.1 * y) for y, s in rows] + [(1.0, None), (None, 0.5)]
    table = spark.createDataFrame(rows, "label double, score double")
    exact = auc(table).first().auc_roc
    got = auc_sketch(table, bins=bins).first()
    assert abs(got.auc_roc - exact) <= got.error + 1e-12 and got.n_bins <= bins
    if bins == 1:
        assert (got.auc_roc, got.error) == (0.5, 0.5)
    one_class = auc_sketch(table.where(F.col("label") == 1)).first()
    assert one_class.auc_roc is None and one_class.error is None
    assert auc_sketch(table.limit(0)).first().auc_roc is None


def test_presence_is_counted_a_few_rows_at_a_time():
    """However many rows a batch holds, what is counted at once has a bounded number of stored entries."""
    import pyarrow as pa

    from discern.operators.selection import _presence

    rng = np.random.default_rng(6)
    sizes = [0, 3, 40, 0, 7, 7, 0, 1, 20, 5]
    indices = [sorted(rng.choice(50, n, replace=False).tolist()) for n in sizes] + [None]
    vector = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    cells = [None if i is None else {"type": 0, "size": 50, "indices": i, "values": [1.0] * len(i)} for i in indices]
    labels = [float(k % 2) for k in range(len(cells))]
    batch = pa.RecordBatch.from_arrays([pa.array(labels), pa.array(cells, vector)], names=["label", "features"])
    counts = {}
    parts = list(_presence(10)(iter([batch])))
    assert len(parts) > 4 and all(pa.compute.sum(p.column(2)).as_py() in (None, 20, 40) or pa.compute.sum(p.column(2)).as_py() <= 10 for p in parts)
    for part in parts:
        for r in part.to_pylist():
            counts[r["place"], r["label"]] = counts.get((r["place"], r["label"]), 0) + r["n"]
    expected = {}
    for y, own in zip(labels, indices):
        for i in own or []:
            expected[i, y] = expected.get((i, y), 0) + 1
    assert counts == expected
