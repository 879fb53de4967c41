"""Training inputs built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.ml.feature import HashingTF, OneHotEncoder

from discern.functions.hashing import hash32
from discern.functions.text import LETTERS, letter_counts
from discern.operators.features import assembler, fold_width, hashed_terms
from discern.sources.tables import read_table, spread

LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LETTER_COLUMNS = [f"n_{letter}" for letter in LETTERS]


def embedding_width(spark: SparkSession, directory: str) -> int:
    """Length of the longest embedding vector."""
    return read_table(spark, directory, "embeddings").agg(F.max(F.size("embedding"))).first()[0]


def embedding_table(spark: SparkSession, directory: str) -> DataFrame:
    """``vec_id, f0 .. fN, label``: a wide numeric table with the label last; vectors of another width are an error."""
    width = embedding_width(spark, directory)
    known = F.col("embedding").isNull() | (F.size("embedding") == width)
    checked = F.when(known, F.col("embedding")).otherwise(F.raise_error(F.lit(f"an embedding is not {width} wide")))
    values = [F.get(checked, F.lit(i)).cast("double").alias(f"f{i}") for i in range(width)]
    return spread(read_table(spark, directory, "embeddings"), ["vec_id"]).select("vec_id", *values, "label")


def labelled_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that have labels; ``label`` is 1.0 for toxic ones."""
    documents = read_table(spark, directory, "documents").select("doc_id", "text", "lang", "n_chars")
    documents = spread(documents, ["doc_id"])
    labels = read_table(spark, directory, "labels").select("doc_id", "quality", F.col("toxic").cast("double").alias("label"))
    return documents.join(labels, "doc_id")


def hashed_documents(spark: SparkSession, directory: str, width: int = 1 << 18) -> DataFrame:
    """``doc_id, label, features``: hashed word counts of the whole text."""
    return hashed_terms(labelled_documents(spark, directory), "text", width).select("doc_id", "label", "features")


def letter_table(spark: SparkSession, directory: str) -> DataFrame:
    """``doc_id, lang, n_a .. n_z`` of every document."""
    documents = spread(read_table(spark, directory, "documents").select("doc_id", "lang", "text"), ["doc_id"])
    return documents.select("doc_id", "lang", *letter_counts(F.col("text")))


def wide_letters(spark: SparkSession, directory: str, width: int = 1 << 18) -> DataFrame:
    """``doc_id, features``: letter counts of the whole text at hashed places of a very wide sparse vector."""
    documents = spread(read_table(spark, directory, "documents").select("doc_id", "text"), ["doc_id"])
    letters = F.translate(F.coalesce("text", F.lit("")), LETTERS.upper(), LETTERS)
    tokens = F.filter(F.split(F.regexp_replace(letters, "[^a-z]", ""), ""), lambda x: x != "")
    hashed = HashingTF(inputCol="tokens", outputCol="features", numFeatures=width).transform(documents.select("doc_id", tokens.alias("tokens")))
    return hashed.select("doc_id", "features")


def url_table(spark: SparkSession, directory: str) -> DataFrame:
    """``page_id, url, label``; ``label`` is 1.0 for URLs that carry a query string."""
    pages = spread(read_table(spark, directory, "pages").select("page_id", "url"), ["page_id"])
    return pages.select("page_id", "url", F.contains(F.col("url"), F.lit("?")).cast("double").alias("label"))


def hashed_urls(spark: SparkSession, directory: str, width: int) -> DataFrame:
    return hashed_terms(url_table(spark, directory), "url", width, kind="url").select("page_id", "label", "features")


def noisy_urls(spark: SparkSession, directory: str, width: int) -> DataFrame:
    """As :func:`hashed_urls`, with the label reversed on every seventh page, which no feature tells."""
    wrong = F.coalesce(F.col("page_id") % 7 == 0, F.lit(False))
    label = F.when(wrong, 1 - F.col("label")).otherwise(F.col("label"))
    return hashed_urls(spark, directory, width).withColumn("label", label)


def line_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Line items with labels that follow from the quantity, one in seven of them wrong.

    ``clean`` is the quantity in four steps of 13; line number 7 gets the next class
    as its ``label``.  ``big`` is 1.0 for quantities over 25, reversed on line 7.
    """
    q = F.col("l_quantity").cast("int")
    clean = F.floor((q - 1) / 13).cast("int")
    noisy = F.col("l_linenumber") == 7
    big = (q > 25).cast("int")
    lines = read_table(spark, directory, "lineitem").select(*LINE_ID, *LINE_NUMERIC)
    return spread(lines, LINE_ID).select(
        *LINE_ID,
        *LINE_NUMERIC,
        q.alias("quantity"),
        clean.alias("clean"),
        F.when(noisy, (clean + 1) % 4).otherwise(clean).cast("double").alias("label"),
        F.when(noisy, 1 - big).otherwise(big).cast("double").alias("big"),
    )


def quantity_vectors(spark: SparkSession, directory: str) -> DataFrame:
    """Line items with the quantity one-hot encoded in ``features``."""
    # quantities are whole numbers up to 50, so the encoder needs no pass over the data
    every = spark.range(51).select(F.col("id").cast("int").alias("quantity"))
    encoder = OneHotEncoder(inputCols=["quantity"], outputCols=["features"], dropLast=False).fit(every)
    return encoder.transform(line_rules(spark, directory)).select(*LINE_ID, "quantity", "label", "big", "features")


# One flag less than there are quantities: all of them would add up to a constant.
QUANTITY_COLUMNS = [f"q_{i}" for i in range(1, 50)]


def quantity_table(spark: SparkSession, directory: str) -> DataFrame:
    """Line items with a flag column per quantity but the last, label last: a wide numeric table."""
    flags = [(F.col("quantity") == i).cast("double").alias(f"q_{i}") for i in range(1, 50)]
    return line_rules(spark, directory).select(*LINE_ID, *flags, F.col("label").cast("int").alias("label"))


def folded_vectors(spark: SparkSession, directory: str) -> DataFrame:
    """One-hot quantities folded to 26 entries; ``label`` is 1.0 for the upper half of them, wrong on line 7."""
    rows = quantity_vectors(spark, directory)
    upper = (F.col("quantity") % 26 >= 13).cast("int")
    label = F.when(F.col("l_linenumber") == 7, 1 - upper).otherwise(upper).cast("double")
    return fold_width(rows.select(*LINE_ID, label.alias("label"), "features"), 26)


def step_table(spark: SparkSession, directory: str) -> DataFrame:
    """Line items with one flag per line number, and a class that depends on the line number.

    ``clean`` is half the line number; quantity 50 gets the next class as its ``label``.
    """
    number, clean = F.col("l_linenumber"), F.floor(F.col("l_linenumber") / 2).cast("int")
    lines = spread(read_table(spark, directory, "lineitem").select(*LINE_ID, "l_quantity"), LINE_ID)
    return lines.select(
        *LINE_ID,
        *[(number == i).cast("double").alias(f"line_{i}") for i in range(1, 8)],
        F.when(F.col("l_quantity") == 50, (clean + 1) % 4).otherwise(clean).alias("label"),
    )


STEP_COLUMNS = [f"line_{i}" for i in range(1, 8)]


def numeric_vectors(spark: SparkSession, directory: str) -> DataFrame:
    """Line items with their four amounts in ``features``."""
    rows = assembler(LINE_NUMERIC).transform(line_rules(spark, directory))
    return rows.select(*LINE_ID, *LINE_NUMERIC, "label", "big", "features")


def embedding_vectors(spark: SparkSession, directory: str) -> DataFrame:
    """``vec_id, label, features`` of the embeddings, indexable as ``f0 .. fN``."""
    table = embedding_table(spark, directory)
    return assembler(embedding_names(table)).transform(table).select("vec_id", "label", "features")


def embedding_names(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c.startswith("f")]


#: Seed of the hash whose trailing zero bits deal orders to classes.
HALVING_SEED = 65537


def halving_table(spark: SparkSession, directory: str) -> DataFrame:
    """Orders with a class in 0 .. 7, each class but the last half as large as the one before.

    The one feature is the class itself, so a tree of depth d with b bins tells apart the first
    min(d, b - 1) classes and takes the rest for the next one.
    """
    h = hash32(["o_orderkey"], HALVING_SEED)
    zeros = F.bit_count(h.bitwiseAND(-h) - 1)
    orders = spread(read_table(spark, directory, "orders").select("o_orderkey"), ["o_orderkey"])
    rows = orders.select("o_orderkey", F.least(zeros, F.lit(7)).cast("double").alias("label"))
    return assembler(["part"]).transform(rows.withColumn("part", F.col("label"))).select("o_orderkey", "label", "features")


def rule_predictions(spark: SparkSession, directory: str) -> DataFrame:
    """A fixed rule in place of a model on documents: ``label, prediction, score``."""
    documents = read_table(spark, directory, "documents").select("doc_id", "n_chars")
    labels = read_table(spark, directory, "labels").select("doc_id", "toxic")
    return documents.join(labels, "doc_id").select(
        "doc_id",
        F.col("toxic").cast("double").alias("label"),
        (F.col("n_chars") % 2).cast("double").alias("prediction"),
        (F.col("n_chars") % 101 / 100.0).alias("score"),
    )


def rule_classes(spark: SparkSession, directory: str) -> DataFrame:
    """A fixed rule in place of a model on line items: label and prediction in 0 .. 3."""
    return read_table(spark, directory, "lineitem").select(
        *LINE_ID,
        (F.col("l_quantity").cast("int") % 4).cast("double").alias("label"),
        (F.col("l_linenumber") % 4).cast("double").alias("prediction"),
    )
