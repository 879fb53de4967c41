"""Grid search: depths that share a fit, and searches that go on where they were ended."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorIndexer
from pyspark.sql import functions as F

from discern.operators import nested as N
from discern.operators import tuning as T
from discern.operators.features import assembler


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes that take several levels to tell apart, some of them noise; a category and a constant."""
    n = F.col("id")
    table = spark.range(600).select(
        n, (n * 37 % 101).cast("double").alias("a"), (n * 53 % 17).cast("double").alias("b"), (n % 4).cast("double").alias("c"), F.lit(1.0).alias("d")
    )
    label = ((F.col("a") / 13).cast("int") + (F.col("b") > 6).cast("int") * 2 + (F.col("c") == 2).cast("int")) % 3
    noisy = F.when(n % 11 == 0, (label + 1) % 3).otherwise(label)
    out = assembler(["a", "b", "c", "d"]).transform(table.withColumn("label", noisy.cast("double"))).select("id", "label", "features")
    return VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=4).fit(out).transform(out).drop("features").withColumnRenamed("indexed", "features").cache()


def scores(result):
    return {r.point: (r.params, r.avg_metric, r.best) for r in result.results.collect()}


@pytest.mark.parametrize("make", [
    lambda: DecisionTreeClassifier(seed=1), lambda: RandomForestClassifier(seed=1, numTrees=3, featureSubsetStrategy="all"),
])
def test_stopped_trees_are_separate_fits(rows, make):
    head = make()
    points = T.grid(head, {"maxDepth": [1, 2, 4, 9], "maxBins": [4, 32]})
    assert [len(g.depths) for g in N.depth_groups(head, points)] == [4, 4]
    one, many = (T.cross_validate(rows, head, points, ["id"], 3, parallelism=4, share_depths=s, refit=False) for s in (None, False))
    assert scores(one) == scores(many) and len({s[1] for s in scores(one).values()}) > 4


def test_every_row_gets_the_prediction_of_the_separate_fit(rows):
    """Row by row, also where the shallow forest merges ends that the deep one keeps apart."""
    from concurrent.futures import ThreadPoolExecutor

    for head in (DecisionTreeClassifier(seed=3), RandomForestClassifier(seed=3, numTrees=4, featureSubsetStrategy="all")):
        points = T.grid(head, {"maxDepth": [0, 1, 3, 5, 8]})
        (group,) = N.depth_groups(head, points)
        with ThreadPoolExecutor(2) as pool:
            got = N.stopped_predictions([head.fit(rows, dict(group.deepest))], [group], rows.withColumn("label", F.col("id").cast("double")), "label", pool)
            got = {(int(r.label), r.model): r.prediction for r in got.collect()}
        for i, point in enumerate(points):
            apart = {(r.id, i): r.prediction for r in head.fit(rows, point).transform(rows).collect()}
            assert all(got[k] == v for k, v in apart.items()), i


def test_groups(spark):
    forest = RandomForestClassifier(numTrees=5)
    points = T.grid(forest, {"maxDepth": [3, 5], "featureSubsetStrategy": ["auto", "all"], "numTrees": [1, 4]})
    exact = N.depth_groups(forest, points)
    # one tree sees all columns; four trees of "auto" draw them
    assert sorted(len(g.depths) for g in exact) == [1, 1, 2, 2, 2]
    assert sorted(len(g.depths) for g in N.depth_groups(forest, points, True)) == [2, 2, 2, 2]
    assert len(N.depth_groups(forest, points, False)) == 8
    reference = T.preset_grid(DecisionTreeClassifier(), "decision_tree", "reference")
    assert (len(reference), len(N.depth_groups(DecisionTreeClassifier(), reference))) == (32, 8)
    reference = T.preset_grid(forest, "random_forest", "reference")
    assert (len(reference), len(N.depth_groups(forest, reference, True))) == (108, 36)
    limited = DecisionTreeClassifier().setThresholds([0.5, 0.5])
    assert len(N.depth_groups(limited, T.grid(limited, {"maxDepth": [1, 2]}))) == 2


class Dies(DecisionTreeClassifier):
    """Counts its fits and ends the driver's loop at a given one."""

    fits, last = 0, 10**9

    def fit(self, dataset, params=None):
        if Dies.fits >= Dies.last:
            raise KeyboardInterrupt
        Dies.fits += 1
        return super().fit(dataset, params)


def test_search_goes_on_where_it_was_ended(rows, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "MODELS_PER_SCAN", 2)  # a record after every two fits
    head = Dies(seed=5)
    points = T.grid(head, {"maxDepth": [2, 4], "maxBins": [4, 8, 16], "impurity": ["gini"]})

    def search(table=rows, folder="book", **more):
        Dies.fits = 0
        return T.cross_validate(table, head, points, ["id"], 4, ledger=str(tmp_path / folder), **more)

    whole = T.cross_validate(rows, head, points, ["id"], 4)
    Dies.last = 7  # of 4 folds x 3 groups
    with pytest.raises(KeyboardInterrupt):
        search(refit=False)
    done = Dies.fits
    assert done == 7
    Dies.last = 10**9
    again = search(rows.repartition(5))
    # a fold has 2 + 1 fits; the seventh was not recorded, as the one beside it died; one more for the winner
    assert Dies.fits == 12 - 6 + 1 and scores(again) == scores(whole) and again.params == whole.params
    assert search(refit=False).model is None and Dies.fits == 0  # all is there
    # other rows, another grid and other settings are other searches
    search(rows.where("id < 500"), refit=False)
    assert Dies.fits == 12
    Dies.fits = 0
    T.cross_validate(rows, head, points[:2], ["id"], 4, ledger=str(tmp_path / "book"), refit=False)
    assert Dies.fits > 0
    # a record whose writer has not finished does not count
    for mark in (tmp_path / "book").glob("*/*/_SUCCESS"):
        mark.unlink()
    search(refit=False)
    assert Dies.fits == 12
    Dies.fits = 0


def test_smaller_forests_are_the_first_trees(rows):
    """Points that differ in their number of trees share a fit, whose first trees vote for the smaller ones."""
    from concurrent.futures import ThreadPoolExecutor

    head = RandomForestClassifier(seed=1, featureSubsetStrategy="all")
    points = T.grid(head, {"maxDepth": [2, 4], "numTrees": [1, 2, 5]})
    groups = N.depth_groups(head, points, True, True)
    assert sorted(len(g.depths) for g in groups) == [2, 4] and len(N.depth_groups(head, points)) == 3
    (group,) = [g for g in groups if g.trees]
    assert {(group.depths[i], group.trees[i]) for i in group.depths} == {(d, n) for d in (2, 4) for n in (2, 5)}
    model = head.fit(rows, dict(group.deepest))
    with ThreadPoolExecutor(2) as pool:
        got = N.stopped_predictions([model], [group], rows, "label", pool).groupBy("model").agg(F.sum("prediction").alias("s"), F.count("*").alias("n"))
        got = {r.model: (r.s, r.n) for r in got.collect()}
    votes = None
    for k, tree in enumerate(model.trees, 1):
        own = np.array([r.p for r in tree.transform(rows).select("id", F.col("probability").alias("p")).orderBy("id").collect()])
        votes = own if votes is None else votes + own
        for i in group.depths:
            if group.depths[i] == 4 and group.trees[i] == k:
                assert got[i] == (float(votes.argmax(axis=1).sum()), len(votes))


@pytest.mark.parametrize("make", [lambda: DecisionTreeClassifier(seed=1), lambda: LogisticRegression(regParam=0.01)])
def test_weighted_rows_give_the_same_search(spark, monkeypatch, make):
    """Rows equal but for their ids are one row with a weight; scores and the refitted model stay."""
    n = F.col("id")
    few = spark.range(600).select("id", (n % 2).cast("double").alias("label"), (n % 5).cast("double").alias("a"), (n % 3 + n % 2).cast("double").alias("b"))
    few = assembler(["a", "b"]).transform(few).select("id", "label", "features")
    monkeypatch.setattr(T, "PIECES", 300)
    light = T.weighted_rows(few.drop("id"), f"{T.scratch_path(spark, 'light')}")
    assert light.count() < 400 and light.agg(F.sum(T.WEIGHT), F.max(T.WEIGHT)).first()[:] == (600.0, 2.0)
    head = make()
    grown = {"maxDepth": [1, 3]} if isinstance(head, DecisionTreeClassifier) else {"maxIter": [2, 20]}
    found = [T.cross_validate(few, head, T.grid(head, grown), ["id"], 3, weigh=w) for w in (False, True)]
    assert scores(found[0]) == scores(found[1])
    told = [f.model.transform(few).orderBy("id").select("prediction").collect() for f in found]
    assert told[0] == told[1]
    assert not T.can_weigh(RandomForestClassifier(), [{}])


@pytest.fixture
def light(spark):
    """600 rows of a rule on two features with few values, each row 20 times under ids of its own."""
    n = F.col("id")
    table = spark.range(12_000).select(n, (n % 600 * 37 % 11).cast("double").alias("a"), (n % 600 * 53 % 7).cast("double").alias("b"))
    label = ((F.col("a") / 3).cast("int") + (F.col("b") > 3).cast("int")) % 3
    return assembler(["a", "b"]).transform(table.withColumn("label", label.cast("double"))).select("id", "label", "features")


def watch_fits(monkeypatch, kind):
    sizes, fit = [], kind.fit

    def counted(self, df, params=None):
        sizes.append(df.count())
        return fit(self, df, params)

    monkeypatch.setattr(kind, "fit", counted)
    return sizes


def test_binned_trees_are_fitted_on_cells(light, monkeypatch):
    """with no more values than bins the cells give the same figures, from far fewer rows."""
    head = DecisionTreeClassifier(seed=1)
    points = T.grid(head, {"maxDepth": [1, 3], "maxBins": [16], "minInfoGain": [0.0, 10.0]})
    plain = T.cross_validate(light, head, points, ["id"], 3)
    sizes = watch_fits(monkeypatch, DecisionTreeClassifier)
    cells = T.cross_validate(light, head, points, ["id"], 3, bins=True)
    assert scores(cells) == scores(plain) and cells.params == plain.params
    assert len(sizes) == 7 and max(sizes[:6]) <= 2 * 77 and sizes[6] == 12_000  # the winner sees the rows
    assert cells.model.stages[-1].toDebugString.split("\n")[1:] == plain.model.stages[-1].toDebugString.split("\n")[1:]


def test_binned_forests_draw_rows_and_fit_cells(light, monkeypatch):
    """a Poisson number of each row for each tree; a smaller forest is the first trees of a larger."""
    head = RandomForestClassifier(seed=5, featureSubsetStrategy="all", maxBins=16)
    points = T.grid(head, {"maxDepth": [3, 6], "numTrees": [3, 5]})
    sizes = watch_fits(monkeypatch, RandomForestClassifier)
    one, many = (T.cross_validate(light, head, points, ["id"], 3, bins=True, refit=False, share_depths=s) for s in (None, False))
    assert scores(one) == scores(many) and max(sizes) <= 2 * 77 and len(sizes) == 3 * 5 + 3 * 16
    assert scores(one)[2][1] > 0.99  # deep enough for the rule
    from discern.operators import binning as B

    drawn = light.select(*[B.draws(["id"], 5, t, 1.0).alias(f"t{t}") for t in range(2)])
    got = drawn.agg(*[F.avg("t0"), F.var_pop("t0"), F.avg((F.col("t1") == 0).cast("int")), F.corr("t0", "t1")]).first()
    assert np.allclose(got, [1, 1, np.exp(-1), 0], atol=0.05)


def test_bins_of_features_with_many_values(spark):
    """More values than bins: quantiles, none of them empty, and a value that is rare stays apart where all fit."""
    n = F.col("id")
    table = spark.range(10_000).select((n * 7919 % 10_007 / 10_007.0).alias("a"), F.when(n == 17, 5.0).otherwise(n % 3).cast("double").alias("b"), F.lit(2.0).alias("c"))
    from discern.operators.binning import feature_values

    a, b, c = feature_values(table.select(F.array("a", "b", "c").alias("x")), "x", 3, 8)
    assert len(a) == 8 and np.allclose(a, np.arange(8) / 8, atol=0.01) and b == [0.0, 1.0, 2.0, 5.0] and c == [2.0]


def test_bins_are_refused_where_rows_are_counted():
    from discern.operators.binning import can_bin

    tree, forest = DecisionTreeClassifier(), RandomForestClassifier()
    assert can_bin(tree, [{}]) and can_bin(forest, T.grid(forest, {"numTrees": [2, 3]}))
    assert not can_bin(tree, [{tree.minInstancesPerNode: 2}]) and not can_bin(forest, T.grid(forest, {"numTrees": [1, 3]}))
    assert not can_bin(forest.copy({forest.bootstrap: False}), [{}]) and not can_bin(LogisticRegression(), [{}])


def test_reference_forests_are_fitted_on_cells(spark, tmp_path, monkeypatch):
    """the published forest search fits cells, not rows, and points that see the same columns share a fit."""
    from discern.plans import catalog

    spark.range(4000).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    values = {"maxDepth": [2, 10], "featureSubsetStrategy": ["auto", "all"], "maxBins": [3, 10], "numTrees": [3, 4]}
    monkeypatch.setattr(catalog, "preset_grid", lambda forest, *_: T.grid(forest, values))
    sizes = watch_fits(monkeypatch, RandomForestClassifier)
    found = catalog.cv_reference_rf(spark, str(tmp_path)).collect()
    assert len(found) == 16 and {r.folds for r in found} == {5}
    assert max(sizes) <= 4 * 8 and len(sizes) == 5 * 2 * 4  # cells of four folds; two numbers of bins, four trees
    # what the trees tell apart: the first class or two, by depth and bins, and all of them
    figures = {r.params: r.avg_metric for r in found}
    assert [v for p, v in figures.items() if "maxBins=10, maxDepth=10" in p] == [1.0] * 4 and len(set(figures.values())) == 2


def test_points_that_see_all_columns_share_a_fit():
    """with one or two features the root of their number is all of them."""
    forest = RandomForestClassifier()
    points = T.grid(forest, {"maxDepth": [3, 5], "featureSubsetStrategy": ["auto", "all", "log2"], "numTrees": [3, 4]})
    assert [len(N.depth_groups(forest, points, True, drawn=True, width=w)) for w in (1, 2, 3, None)] == [2, 2, 3, 3]
    assert len(N.depth_groups(forest, points, False, drawn=True, width=1)) == 12
    assert len(N.depth_groups(forest, points, True, True, width=1)) == 3  # Spark draws these otherwise


def test_trees_that_draw_no_row_or_not_all_classes(spark):
    """a tree without rows has no vote, and one that missed the last class votes among all classes."""
    n = F.col("id")
    from discern.operators import binning as B
    from discern.operators.split import with_fold

    n = F.col("id")
    few = spark.range(5).select("id", F.greatest(n - 2, F.lit(0)).cast("double").alias("label"), n.cast("double").alias("a"))
    few = assembler(["a"]).transform(few).select("id", "label", "features")
    drawn = with_fold(few, ["id"], 2).select("fold", "label", *[B.draws(["id"], 2, t, 1.0).alias(f"t{t}") for t in range(4)]).collect()
    taken = [[r.label for r in drawn if r.fold != fold and r[f"t{t}"]] for fold in (0, 1) for t in range(4)]
    assert [] in taken and any(own and max(own) < max(r.label for r in drawn) for own in taken)
    head = RandomForestClassifier(seed=2)
    points = T.grid(head, {"maxDepth": [1, 3], "numTrees": [3, 4]})
    one, many = (T.cross_validate(few, head, points, ["id"], 2, bins=True, refit=False, parallelism=4, share_depths=s) for s in (True, False))
    assert scores(one) == scores(many) and len(scores(one)) == 4
