"""The registered queries: each takes (spark, directory) and returns a DataFrame.

All of them run over whole tables.  Doubles are rounded so that another engine,
which adds in another order, prints the same figures.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discern.operators import classifiers as C
from discern.operators import features as X
from discern.operators import metrics as M
from discern.operators.cleaning import (
    all_but_last,
    cast_columns,
    first_predictions,
    replace_token,
    result_columns,
    reverse_columns,
)
from discern.operators.curves import auc, auc_sketch
from discern.operators.importance import permutation_importance, permuted_accuracy, tree_importances, with_donor
from discern.operators.profile import distinct_count, profile
from discern.operators.rounds import fit_in_rounds
from discern.operators.selection import best_features, reduced, selector
from discern.operators.split import (
    SPARSE_SPLIT_SEED,
    sample_with_replacement,
    shuffled_top,
    stored_split,
    with_fold,
    with_split,
)
from discern.operators.tuning import DEFAULT_FOLDS, REFERENCE_FOLDS, cross_validate, grid, preset_grid
from discern.operators.wide_pca import project_wide, wide_components
from discern.plans import inputs as I
from discern.plans.jobs import deep_classifier, dense_multiclass, second_stage, sparse_binary
from discern.sources.handoff import read_split, write_split
from discern.sources.libsvm import read_libsvm, write_libsvm
from discern.sources.scratch import materialize, scratch_path
from discern.sources.tables import read_table, spread
from discern.sources.wide_csv import read_wide_csv, write_wide_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MISSING_COLUMNS = ["f10", "f11", "f12", "f13", "f14"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [name for name, dtype in df.dtypes if dtype == "double"]
    return df.withColumns({name: F.round(name, digits) for name in doubles})


def column_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n_present, total`` from one aggregate over all columns."""
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n_present"), F.sum(c).alias("total")).alias(c)
        for c in columns
    ]
    one = df.agg(*pairs)
    return one.select(F.inline(F.array(*[F.col(c) for c in columns])))


# --- sources, sinks, cleaning -------------------------------------------------


def _embedding_csv(spark: SparkSession, directory: str) -> str:
    """The wide table as headless CSV, ``?`` standing in five columns of every seventh row."""
    table = I.embedding_table(spark, directory)
    token = F.col("vec_id") % 7 == 0
    marked = table.withColumns(
        {c: F.when(token, F.lit("?")).otherwise(F.col(c).cast("string")) for c in MISSING_COLUMNS}
    )
    path = scratch_path(spark, "csv")
    write_wide_csv(marked.drop("vec_id"), path)
    return path


@query
def csv_roundtrip_clean(spark: SparkSession, directory: str) -> DataFrame:
    rows = read_wide_csv(spark, _embedding_csv(spark, directory))
    clean = cast_columns(replace_token(rows, {"?": "0"}))
    return rounded(column_totals(clean, clean.columns))


@query
def csv_drop_and_assemble(spark: SparkSession, directory: str) -> DataFrame:
    rows = read_wide_csv(spark, _embedding_csv(spark, directory))
    numeric = rows.drop(*X.string_columns(rows)).withColumnRenamed(rows.columns[-1], "label")
    vectors = X.assembler(all_but_last(numeric)).transform(numeric)
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return rounded(
        vectors.groupBy("label").agg(
            F.count("*").alias("n"), F.max(F.size(values)).alias("width"), F.sum(total).alias("total")
        )
    )


@query
def csv_missing_as_null(spark: SparkSession, directory: str) -> DataFrame:
    rows = read_wide_csv(spark, _embedding_csv(spark, directory), missing="?")
    return rounded(column_totals(rows, rows.columns))


@query
def libsvm_roundtrip_stats(spark: SparkSession, directory: str) -> DataFrame:
    letters = I.letter_table(spark, directory).withColumn("label", (F.col("lang") == "en").cast("double"))
    path = scratch_path(spark, "libsvm")
    write_libsvm(X.assembler(I.LETTER_COLUMNS).transform(letters), path)
    rows = read_libsvm(spark, path, len(I.LETTER_COLUMNS))
    stats = rows.groupBy("label").agg(
        F.count("*").alias("n"), Summarizer.metrics("numNonZeros", "sum").summary(F.col("features")).alias("s")
    )
    add = lambda vector: F.aggregate(vector_to_array(vector), F.lit(0.0), lambda a, b: a + b)
    return stats.select("label", "n", add("s.numNonZeros").alias("nnz"), add("s.sum").alias("total"))


@query
def split_handoff_counts(spark: SparkSession, directory: str) -> DataFrame:
    table = with_split(I.embedding_table(spark, directory), ["vec_id"])
    names = I.embedding_names(table)
    path = scratch_path(spark, "handoff")
    write_split(table, path, names, "label")
    parts = [
        read_split(spark, path, i, len(names), 10).select(F.lit(i).alias("split"), "label", "features") for i in (0, 1)
    ]
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, b: a + b)
    both = parts[0].unionAll(parts[1])
    return rounded(both.groupBy("split", "label").agg(F.count("*").alias("n"), F.sum(total).alias("total")))


@query
def table_profile(spark: SparkSession, directory: str) -> DataFrame:
    return profile(read_table(spark, directory, "lineitem"))


@query
def document_profile(spark: SparkSession, directory: str) -> DataFrame:
    return profile(read_table(spark, directory, "documents"))


@query
def reversed_columns(spark: SparkSession, directory: str) -> DataFrame:
    """``labels`` with its columns reversed; the cells by position show the new order."""
    turned = reverse_columns(read_table(spark, directory, "labels"))
    cells = [F.struct(F.lit(i).alias("position"), F.col(c).cast("bigint").alias("value")) for i, c in enumerate(turned.columns)]
    return turned.select(F.inline(F.array(*cells))).groupBy("position", "value").agg(F.count("*").alias("n"))


@query
def label_distinct(spark: SparkSession, directory: str) -> DataFrame:
    read_table(spark, directory, "embeddings").createOrReplaceTempView("discern_embeddings")
    return spark.sql("SELECT DISTINCT label FROM discern_embeddings")


@query
def label_count_distinct(spark: SparkSession, directory: str) -> DataFrame:
    return distinct_count(read_table(spark, directory, "embeddings").select("label"))


@query
def scored_result(spark: SparkSession, directory: str) -> DataFrame:
    return result_columns(I.rule_predictions(spark, directory), "doc_id", "score")


@query
def first_scores(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_table(spark, directory, "documents").select("doc_id")
    scores = I.rule_predictions(spark, directory).select("doc_id", "prediction")
    return first_predictions(documents.join(scores, "doc_id", "left"), ["doc_id"])


# --- splits and samples -------------------------------------------------------


@query
def hash_split_2way(spark: SparkSession, directory: str) -> DataFrame:
    return with_split(read_table(spark, directory, "documents").select("doc_id"), ["doc_id"])


@query
def hash_split_3way(spark: SparkSession, directory: str) -> DataFrame:
    lines = read_table(spark, directory, "lineitem").select(*I.LINE_ID, "l_quantity")
    parts = with_split(lines, I.LINE_ID, (60, 20, 20))
    return parts.groupBy("split").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query
def hash_folds(spark: SparkSession, directory: str) -> DataFrame:
    lines = read_table(spark, directory, "lineitem").select(*I.LINE_ID, "l_quantity")
    folds = with_fold(lines, I.LINE_ID, 10)
    return folds.groupBy("fold").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query
def shuffle_tenth(spark: SparkSession, directory: str) -> DataFrame:
    """A tenth of all line items, the first of the shuffled order, without sorting all of them."""
    lines = read_table(spark, directory, "lineitem").select(*I.LINE_ID)
    return shuffled_top(lines, I.LINE_ID, lines.count() // 10)


@query
def shuffle_top_n(spark: SparkSession, directory: str) -> DataFrame:
    return shuffled_top(read_table(spark, directory, "lineitem").select(*I.LINE_ID), I.LINE_ID, 1000)


@query
def sample_copies(spark: SparkSession, directory: str) -> DataFrame:
    return sample_with_replacement(read_table(spark, directory, "lineitem").select(*I.LINE_ID), I.LINE_ID, 0.1)


# --- features -----------------------------------------------------------------


@query
def label_index(spark: SparkSession, directory: str) -> DataFrame:
    documents = read_table(spark, directory, "documents")
    parts = [X.label_index(documents, c).withColumn("column_name", F.lit(c)) for c in ("lang", "source")]
    return parts[0].unionAll(parts[1])


@query
def category_index(spark: SparkSession, directory: str) -> DataFrame:
    lines = read_table(spark, directory, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    columns = ["l_returnflag", "l_linestatus", "l_linenumber"]
    indexed = X.categorical(columns).fit(lines).transform(lines)
    return indexed.groupBy(*columns, *[f"{c}_index" for c in columns]).agg(F.count("*").alias("n"))


@query
def all_categories(spark: SparkSession, directory: str) -> DataFrame:
    """Every string column and the label as numbers."""
    rows = read_table(spark, directory, "documents").select("lang", "source", F.length("lang").alias("label"))
    indexed = X.index_categories(rows, "label")
    return indexed.groupBy("lang", "source", "label").agg(F.count("*").alias("n"))


@query
def assembled_feature_sums(spark: SparkSession, directory: str) -> DataFrame:
    table = I.embedding_table(spark, directory)
    vectors = X.assembler(all_but_last(table.drop("vec_id"))).transform(table)
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return rounded(vectors.select("vec_id", F.size(values).alias("width"), total.alias("total")))


@query
def impute_mean(spark: SparkSession, directory: str) -> DataFrame:
    table = I.embedding_table(spark, directory)
    gaps = table.withColumns({c: F.when(F.col("vec_id") % 7 != 0, F.col(c)) for c in MISSING_COLUMNS})
    filled = X.imputer(MISSING_COLUMNS).fit(gaps).transform(gaps)
    return rounded(filled.select("vec_id", *MISSING_COLUMNS))


@query
def hashed_term_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Terms per document after hashing and after folding; both keep every word of the text."""
    documents = spread(read_table(spark, directory, "documents").select("doc_id", "text"), ["doc_id"])
    vectors = X.hashed_terms(documents, "text", 1 << 18).drop("text")
    folded = X.fold_width(vectors, 64)
    return folded.select(
        "doc_id", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, b: a + b).alias("n_terms")
    )


@query
def feature_covariance(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(X.covariance(read_table(spark, directory, "embeddings"), "embedding"), 8)


@query
def pca_rotation_norms(spark: SparkSession, directory: str) -> DataFrame:
    """Squared length of every row after PCA to full width, which is a rotation."""
    rows = I.embedding_vectors(spark, directory)
    model = X.principal_components(rows, X.vector_width(rows)).fit(rows)
    length = F.aggregate(vector_to_array("pca_features"), F.lit(0.0), lambda a, b: a + b * b)
    return rounded(model.transform(rows).select("vec_id", length.alias("squared_length")))


@query
def pca_explained_variance(spark: SparkSession, directory: str) -> DataFrame:
    rows = I.embedding_vectors(spark, directory)
    model = X.principal_components(rows, 50).fit(rows)
    shares = F.array(*[F.lit(float(v)) for v in model.explainedVariance])
    return rows.agg(F.count("*").alias("n_rows")).select(F.posexplode(shares).alias("component", "share"), "n_rows")


@query
def pca_spectrum(spark: SparkSession, directory: str) -> DataFrame:
    """Sum and sum of squares of all variance shares: the trace and the squared norm of the covariance, scaled."""
    rows = I.embedding_vectors(spark, directory)
    shares = [float(v) for v in X.principal_components(rows, X.vector_width(rows)).fit(rows).explainedVariance]
    figures = rows.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(len(shares)).alias("n_components"),
        F.lit(math.fsum(shares)).alias("share_sum"),
        F.lit(math.fsum(v * v for v in shares)).alias("share_squares"),
    )
    return rounded(figures)


@query
def wide_pca_lengths(spark: SparkSession, directory: str) -> DataFrame:
    """Length of every document's centred vector, 2**18 wide, in terms of its components."""
    rows = I.wide_letters(spark, directory)
    found = project_wide(rows, wide_components(rows, 26))
    square = F.aggregate("components", F.lit(0.0), lambda a, b: a + b * b)
    return found.select("doc_id", F.round(F.sqrt(square), 4).alias("length"))


@query
def wide_pca_spectrum(spark: SparkSession, directory: str) -> DataFrame:
    """Trace and norm of the covariance of 2**18 columns from the variances of its components."""
    rows = I.wide_letters(spark, directory)
    found = wide_components(rows, 26)
    shares = F.array(*[F.lit(v) for v in found.variances])
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    squares = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b * b)
    # the means of the loadings' table are those of the input's columns
    counts = found.loadings.agg(F.count("*").alias("n_features"), F.sum("mean").alias("mean_letters"))
    return counts.select("n_features", F.round("mean_letters", 4).alias("mean_letters"), F.round(total, 3).alias("variance"), F.round(F.sqrt(squares), 3).alias("norm"))


# --- naive Bayes and trees with a closed form ---------------------------------


def _letter_bayes(spark: SparkSession, directory: str):
    rows = I.letter_table(spark, directory)
    indexer = StringIndexer(inputCol="lang", outputCol="label").fit(rows.select("lang"))
    training, test = stored_split(rows, ["doc_id"])
    stages = [indexer, X.assembler(I.LETTER_COLUMNS), C.classifier("naive_bayes")]
    return Pipeline(stages=stages).fit(training), indexer.labels, test


@query
def nb_model(spark: SparkSession, directory: str) -> DataFrame:
    """Log prior and log likelihoods of a language model over letters."""
    model, labels, _ = _letter_bayes(spark, directory)
    bayes = C.last_stage(model)
    prior, theta = bayes.pi.toArray(), bayes.theta.toArray()
    rows = []
    for c, label in enumerate(labels):
        rows.append((label, "prior", float(prior[c])))
        rows += [(label, term, float(theta[c, i])) for i, term in enumerate(I.LETTER_COLUMNS)]
    return rounded(spark.createDataFrame(rows, "lang string, term string, value double"))


@query
def nb_predictions(spark: SparkSession, directory: str) -> DataFrame:
    model, labels, test = _letter_bayes(spark, directory)
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)
    return named.transform(model.transform(test)).select("doc_id", "lang", "predicted")


@query
def stump_gini(spark: SparkSession, directory: str) -> DataFrame:
    """The two leaves of a tree of depth 1: range of the split column, rows, class shares."""
    rows = X.assembler(["quantity"]).transform(I.line_rules(spark, directory)).select("quantity", "label", "features")
    rows = materialize(rows, "stump")
    model = C.classifier("decision_tree", maxDepth=1, maxBins=64, leafCol="leaf").fit(rows)
    scored = model.transform(rows)
    shares = vector_to_array("probability")
    return rounded(
        scored.groupBy("leaf").agg(
            F.min("quantity").alias("low"),
            F.max("quantity").alias("high"),
            F.count("*").alias("n"),
            *[F.max(shares[i]).alias(f"share_{i}") for i in range(4)],
        )
    )


# --- classifiers --------------------------------------------------------------


def _confusion_of(model, test: DataFrame, label: str = "label") -> DataFrame:
    return M.confusion(model.transform(test), label)


def _quantity_split(spark: SparkSession, directory: str) -> tuple[DataFrame, ...]:
    rows = I.quantity_vectors(spark, directory)
    return stored_split(rows, I.LINE_ID, keep=["label", "big", "features"])


def _numeric_split(spark: SparkSession, directory: str) -> tuple[DataFrame, ...]:
    return stored_split(I.numeric_vectors(spark, directory), I.LINE_ID)


@query
def lr_multinomial(spark: SparkSession, directory: str) -> DataFrame:
    training, test = _quantity_split(spark, directory)
    return _confusion_of(C.classifier("logistic_regression", maxIter=50).fit(training), test)


@query
def svm_quantity(spark: SparkSession, directory: str) -> DataFrame:
    training, test = _quantity_split(spark, directory)
    return _confusion_of(C.classifier("linear_svm", labelCol="big", regParam=0.001).fit(training), test, "big")


@query
def mlp_multiclass(spark: SparkSession, directory: str) -> DataFrame:
    training, test = _quantity_split(spark, directory)
    return _confusion_of(C.perceptron(training, 4, maxIter=40).fit(training), test)


@query
def deep_mlp(spark: SparkSession, directory: str) -> DataFrame:
    training, test = _quantity_split(spark, directory)
    return _confusion_of(C.perceptron(training, 4, C.HIDDEN_LAYERS["deep"], maxIter=40).fit(training), test)


@query
def dt_multiclass(spark: SparkSession, directory: str) -> DataFrame:
    training, test = _numeric_split(spark, directory)
    return _confusion_of(C.classifier("decision_tree", maxDepth=3, maxBins=64).fit(training), test)


@query
def rf_multiclass(spark: SparkSession, directory: str) -> DataFrame:
    training, test = _numeric_split(spark, directory)
    forest = C.classifier("random_forest", maxDepth=3, maxBins=64, numTrees=5, featureSubsetStrategy="all")
    return _confusion_of(forest.fit(training), test)


def _url_split(spark: SparkSession, directory: str, width: int | None = None) -> tuple[DataFrame, ...]:
    rows = I.hashed_urls(spark, directory, 1 << 18)
    if width is not None:
        rows = X.fold_width(rows, width)
    return stored_split(rows, ["page_id"], seed=SPARSE_SPLIT_SEED)


@query
def lr_binary_sparse(spark: SparkSession, directory: str) -> DataFrame:
    training, test = _url_split(spark, directory)
    return _confusion_of(C.classifier("logistic_regression_sparse").fit(training), test)


@query
def svm_linear(spark: SparkSession, directory: str) -> DataFrame:
    training, test = _url_split(spark, directory)
    return _confusion_of(C.classifier("linear_svm").fit(training), test)


@query
def dt_sparse(spark: SparkSession, directory: str) -> DataFrame:
    training, test = _url_split(spark, directory, 1 << 12)
    return _confusion_of(C.classifier("decision_tree").fit(training), test)


@query
def rf_sparse(spark: SparkSession, directory: str) -> DataFrame:
    training, test = _url_split(spark, directory, 1 << 10)
    return _confusion_of(C.classifier("random_forest").fit(training), test)


@query
def mlp_hashed(spark: SparkSession, directory: str) -> DataFrame:
    training, test = _url_split(spark, directory, 1 << 8)
    return _confusion_of(C.perceptron(training, 2, maxIter=30).fit(training), test)


@query
def best_words(spark: SparkSession, directory: str) -> DataFrame:
    """The 200 hashed words of the training documents that tell toxic ones best."""
    training, _ = stored_split(I.hashed_documents(spark, directory), ["doc_id"])
    return rounded(best_features(training, 200), 4)


def _selected_urls(spark: SparkSession, directory: str, k: int) -> tuple[DataFrame, ...]:
    rows = I.noisy_urls(spark, directory, 1 << 18)
    training, test = stored_split(rows, ["page_id"], seed=SPARSE_SPLIT_SEED, keep=["label", "features"])
    stage = selector(training, k)
    return reduced(training, stage), reduced(test, stage)


@query
def dt_selected(spark: SparkSession, directory: str) -> DataFrame:
    """A tree on the best 8 of 262,144 hashed URL parts; one label in seven is wrong."""
    training, test = _selected_urls(spark, directory, 8)
    return _confusion_of(C.classifier("decision_tree", maxDepth=2).fit(training), test)


@query
def mlp_selected(spark: SparkSession, directory: str) -> DataFrame:
    """A perceptron on the best 8 hashed URL parts; one label in seven is wrong."""
    training, test = _selected_urls(spark, directory, 8)
    return _confusion_of(C.perceptron(training, 2).fit(training), test)


@query
def nb_sparse(spark: SparkSession, directory: str) -> DataFrame:
    """Naive Bayes over all words of the labelled documents, as a binary report."""
    training, test = stored_split(I.hashed_documents(spark, directory), ["doc_id"])
    return rounded(M.binary_report(C.classifier("naive_bayes").fit(training).transform(test)))


@query
def lr_documents(spark: SparkSession, directory: str) -> DataFrame:
    rows = I.hashed_documents(spark, directory)
    result = sparse_binary(rows, ["doc_id"], C.classifier("logistic_regression_sparse", maxIter=50))
    return rounded(result.reports["binary"])


@query
def mlp_folded(spark: SparkSession, directory: str) -> DataFrame:
    training, test = stored_split(I.folded_vectors(spark, directory), I.LINE_ID, keep=["label", "features"])
    return _confusion_of(C.perceptron(training, 2, maxIter=40).fit(training), test)


@query
def dense_job_lines(spark: SparkSession, directory: str) -> DataFrame:
    """The whole dense job: wide table, PCA, tuned logistic regression, full matrix."""
    values = {"regParam": [0.1, 0.01], "maxIter": [20]}
    result = dense_multiclass(
        I.quantity_table(spark, directory),
        I.LINE_ID,
        I.QUANTITY_COLUMNS,
        "label",
        C.classifier("logistic_regression"),
        values,
        components=len(I.QUANTITY_COLUMNS),
        folds=3,
        parallelism=6,
        weigh=True,
    )
    return result.reports["matrix"]


@query
def sparse_job_urls(spark: SparkSession, directory: str) -> DataFrame:
    """The whole sparse job at full width, as a binary report with curve areas."""
    rows = I.hashed_urls(spark, directory, 1 << 18)
    result = sparse_binary(rows, ["page_id"], C.classifier("logistic_regression_sparse"))
    counts = result.reports["binary"].select("total", "correct", "wrong", "tp", "fp", "tn", "fn", "accuracy", "mcc")
    area = result.reports["score_areas"].select("auc_roc").scalar()
    return rounded(counts.withColumn("auc_roc", area))


@query
def dense_pca_lr(spark: SparkSession, directory: str) -> DataFrame:
    table = I.embedding_table(spark, directory)
    names = I.embedding_names(table)
    values = {"regParam": [0.1, 0.01], "maxIter": [20]}
    result = dense_multiclass(table, ["vec_id"], names, "label", C.classifier("logistic_regression"), values, folds=3)
    return rounded(result.reports["multiclass"])


@query
def deep_validated(spark: SparkSession, directory: str) -> DataFrame:
    table = I.embedding_table(spark, directory)
    names = I.embedding_names(table)
    result = deep_classifier(table, ["vec_id"], names, "label", 10, maxIter=40)
    parts = [result.reports[p].withColumn("part", F.lit(p)) for p in ("validation", "test")]
    return rounded(parts[0].unionAll(parts[1]))


def _deep_rounds(spark: SparkSession, directory: str):
    parts = stored_split(I.quantity_vectors(spark, directory), I.LINE_ID, (60, 20, 20), keep=["label", "features"])
    return fit_in_rounds(parts[0], parts[1], 4), parts


@query
def deep_rounds(spark: SparkSession, directory: str) -> DataFrame:
    """A 32-64-128 net trained in rounds: what the best one by the validation part says of both other parts."""
    found, (_, validation, test) = _deep_rounds(spark, directory)
    parts = [_confusion_of(found.model, rows).withColumn("part", F.lit(name)) for name, rows in (("validation", validation), ("test", test))]
    return parts[0].unionAll(parts[1])


@query
def deep_rounds_log(spark: SparkSession, directory: str) -> DataFrame:
    """The validation figure after each round of that net, and the round that is taken."""
    return rounded(_deep_rounds(spark, directory)[0].log)


@query
def second_stage_mlp(spark: SparkSession, directory: str) -> DataFrame:
    table = with_split(I.embedding_table(spark, directory), ["vec_id"])
    names = I.embedding_names(table)
    path = scratch_path(spark, "stage")
    write_split(table, path, names, "label")
    return second_stage(spark, path, len(names), 10, maxIter=15).reports["counts"]


@query
def second_stage_lines(spark: SparkSession, directory: str) -> DataFrame:
    """All line items through the CSV hand-off into a net with three hidden layers."""
    path = scratch_path(spark, "stage")
    write_split(with_split(I.step_table(spark, directory), I.LINE_ID), path, I.STEP_COLUMNS, "label")
    return second_stage(spark, path, len(I.STEP_COLUMNS), 4, (16, 16, 16), maxIter=60).reports["counts"]


@query
def deep_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Validation and test reports of a deep net on line items."""
    rows = I.step_table(spark, directory)
    result = deep_classifier(rows, I.LINE_ID, I.STEP_COLUMNS, "label", 4, (16, 16), maxIter=60)
    parts = [result.reports[p].withColumn("part", F.lit(p)) for p in ("validation", "test")]
    return rounded(parts[0].unionAll(parts[1]))


@query
def layer_param_counts(spark: SparkSession, directory: str) -> DataFrame:
    shape = read_table(spark, directory, "embeddings").agg(
        F.max(F.size("embedding")).alias("width"), F.count_distinct("label").alias("classes")
    )
    parts = [
        C.layer_params(shape, "width", "classes", hidden).withColumn("net", F.lit(name))
        for name, hidden in C.HIDDEN_LAYERS.items()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# --- tuning -------------------------------------------------------------------


def _tuned(rows: DataFrame, estimator, values, ids=I.LINE_ID, metric: str = "f1", weigh: bool = False, bins: bool = False) -> DataFrame:
    points = grid(estimator, values)
    return rounded(cross_validate(rows, estimator, points, ids, 3, metric=metric, parallelism=4, refit=False, weigh=weigh, bins=bins).results)


@query
def cv_grid_lr(spark: SparkSession, directory: str) -> DataFrame:
    values = {"regParam": [0.1, 0.01], "maxIter": [20]}
    return _tuned(I.quantity_vectors(spark, directory), C.classifier("logistic_regression"), values, weigh=True)


@query
def cv_grid_dt(spark: SparkSession, directory: str) -> DataFrame:
    """The first point of each depth may not split at all, so the second one must win."""
    values = {"maxDepth": [3, 4], "minInfoGain": [10.0, 0.0]}
    return _tuned(I.numeric_vectors(spark, directory), C.classifier("decision_tree", maxBins=64), values, bins=True)


@query
def cv_reference_dt(spark: SparkSession, directory: str) -> DataFrame:
    """The published tree grid, 32 points over 10 folds: 8 fits a fold, stopped at four depths each."""
    tree = C.classifier("decision_tree")
    points = preset_grid(tree, "decision_tree", "reference")
    result = cross_validate(I.halving_table(spark, directory), tree, points, ["o_orderkey"], DEFAULT_FOLDS, parallelism=8, refit=False, weigh=True)
    return rounded(result.results)


@query
def cv_reference_rf(spark: SparkSession, directory: str) -> DataFrame:
    """The published forest grid, 108 points over 5 folds: 10 trees a fold for each impurity and number of bins, each scored at three depths, after 3, 5 and 10 of them."""
    forest = C.classifier("random_forest")
    points = preset_grid(forest, "random_forest", "reference")
    rows, folds = I.halving_table(spark, directory), REFERENCE_FOLDS["random_forest"]
    return rounded(cross_validate(rows, forest, points, ["o_orderkey"], folds, parallelism=8, refit=False, share_depths=True, share_trees=True, bins=True).results)


@query
def tuned_refit(spark: SparkSession, directory: str) -> DataFrame:
    """Tune on the training part, refit the best point on all of it, score the test part.

    The first point never splits, so a wrong choice shows in the test part.
    """
    training, test = _numeric_split(spark, directory)
    tree = C.classifier("decision_tree", maxDepth=3, maxBins=64)
    tuned = cross_validate(training, tree, grid(tree, {"minInfoGain": [10.0, 0.0]}), I.LINE_ID, 3, parallelism=4, bins=True)
    return _confusion_of(tuned.model, test)


@query
def cv_grid_rf(spark: SparkSession, directory: str) -> DataFrame:
    values = {"maxDepth": [3], "numTrees": [3, 5]}
    forest = C.classifier("random_forest", maxBins=64, featureSubsetStrategy="all")
    return _tuned(I.numeric_vectors(spark, directory), forest, values, bins=True)


@query
def cv_grid_svm(spark: SparkSession, directory: str) -> DataFrame:
    values = {"regParam": [0.01, 0.001]}
    rows = I.quantity_vectors(spark, directory).select(*I.LINE_ID, F.col("big").alias("label"), "features")
    return _tuned(rows, C.classifier("linear_svm"), values, metric="balancedAccuracy", weigh=True)


@query
def cv_grid_lr_sparse(spark: SparkSession, directory: str) -> DataFrame:
    values = {"regParam": [0.001, 0.0001], "maxIter": [100]}
    rows = I.hashed_urls(spark, directory, 1 << 18)
    return _tuned(rows, C.classifier("logistic_regression_sparse"), values, ["page_id"], "balancedAccuracy")


@query
def cv_grid_rf_sparse(spark: SparkSession, directory: str) -> DataFrame:
    values = {"maxDepth": [3, 5], "numTrees": [2, 3]}
    rows = X.fold_width(I.hashed_urls(spark, directory, 1 << 18), 1 << 8)
    return _tuned(rows, C.classifier("random_forest"), values, ["page_id"], "balancedAccuracy")


@query
def cv_deep_mlp(spark: SparkSession, directory: str) -> DataFrame:
    """The published deep net, 32-64-128, trained until it settles or for the published 1000 iterations, in every fold."""
    rows = I.quantity_vectors(spark, directory)
    return _tuned(rows, C.perceptron(rows, 4, C.HIDDEN_LAYERS["deep"]), {})


# --- evaluation ---------------------------------------------------------------


@query
def multiclass_report(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(M.multiclass_report(M.confusion(I.rule_classes(spark, directory))))


@query
def test_error(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(M.multiclass_report(M.confusion(I.rule_predictions(spark, directory))).select("n", "test_error"))


@query
def auc_roc_hard(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(auc(I.rule_predictions(spark, directory), score="prediction").select("auc_roc"))


@query
def auc_roc_score(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(auc(I.rule_predictions(spark, directory)).select("auc_roc"))


@query
def auc_pr_first(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(auc(I.rule_predictions(spark, directory)).select("auc_pr_first"))


@query
def auc_pr_one(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(auc(I.rule_predictions(spark, directory)).select("auc_pr_one"))


@query
def auc_many_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Nearly every row has a score of its own, so the curve is summed range by range."""
    lines = read_table(spark, directory, "lineitem").select(
        (F.col("l_quantity") > 25).cast("double").alias("label"),
        (F.col("l_extendedprice") + 100 * F.col("l_quantity")).alias("score"),
    )
    return rounded(auc(lines))


@query
def auc_sketched(spark: SparkSession, directory: str) -> DataFrame:
    """The same area from counts in 2048 bins, with its bound of error."""
    lines = read_table(spark, directory, "lineitem").select(
        (F.col("l_quantity") > 25).cast("double").alias("label"),
        (F.col("l_extendedprice") + 100 * F.col("l_quantity")).alias("score"),
    )
    return rounded(auc_sketch(lines, high=131072.0, bins=2048), 9)


@query
def binary_report(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(M.binary_report(I.rule_predictions(spark, directory)))


@query
def mcc(spark: SparkSession, directory: str) -> DataFrame:
    """Matthews correlation with either class taken as the positive one."""
    rows = I.rule_predictions(spark, directory)
    parts = [M.binary_report(rows, positive=p).select(F.lit(p).alias("positive"), "tp", "fn", "mcc") for p in (0.0, 1.0)]
    return rounded(parts[0].unionAll(parts[1]))


@query
def confusion_long(spark: SparkSession, directory: str) -> DataFrame:
    return M.confusion(I.rule_classes(spark, directory))


@query
def confusion_matrix_full(spark: SparkSession, directory: str) -> DataFrame:
    return M.confusion_matrix(M.confusion(I.rule_classes(spark, directory)), 6)


@query
def confusion_matrix_wide(spark: SparkSession, directory: str) -> DataFrame:
    return M.confusion_wide(M.confusion_matrix(M.confusion(I.rule_classes(spark, directory))), 4)


@query
def mean_class_error(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(M.mean_class_error(M.confusion(I.rule_classes(spark, directory))).select("mean_per_class_error"))


@query
def accuracy_pct(spark: SparkSession, directory: str) -> DataFrame:
    return rounded(M.mean_class_error(M.confusion(I.rule_classes(spark, directory))).select("accuracy_pct"))


@query
def macro_report(spark: SparkSession, directory: str) -> DataFrame:
    rows = I.rule_classes(spark, directory).withColumn("prediction", F.least(F.col("prediction"), F.lit(2.0)))
    return rounded(M.macro_report(M.confusion(rows), 6))


@query
def evaluator_params(spark: SparkSession, directory: str) -> DataFrame:
    evaluator = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="prediction")
    return M.evaluator_params(I.rule_predictions(spark, directory), evaluator)


@query
def feature_importance(spark: SparkSession, directory: str) -> DataFrame:
    rows = materialize(I.numeric_vectors(spark, directory).select("label", "features"), "importance")
    model = C.classifier("decision_tree", maxDepth=2, maxBins=64).fit(rows)
    return rounded(tree_importances(rows, model, I.LINE_NUMERIC))


@query
def rule_permutation_importance(spark: SparkSession, directory: str) -> DataFrame:
    columns = ["l_quantity", "l_discount"]
    lines = I.line_rules(spark, directory).select(*I.LINE_ID, "l_quantity", "l_discount", "big")
    rows = with_donor(lines, columns, I.LINE_ID, buckets=8)

    def rule(c):
        return ((c["l_quantity"] > 25) | (c["l_discount"] > 0.08)).cast("double")

    return rounded(permuted_accuracy(rows, columns, rule, "big"))


@query
def model_permutation_importance(spark: SparkSession, directory: str) -> DataFrame:
    training, test = _numeric_split(spark, directory)
    model = C.classifier("decision_tree", maxDepth=3, maxBins=64).fit(training)
    return rounded(permutation_importance(test, model, I.LINE_NUMERIC, I.LINE_ID, buckets=8))
