"""A training corpus from ``documents``: the stages, in order, and a run over all of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from discern.llm.common import WORD, fresh, lean, stored, text_slices
from discern.llm.language_id import UNKNOWN, predict, train
from discern.llm.minhash import near_duplicates, words_of
from discern.llm.mixing import mix
from discern.llm.packing import pack
from discern.llm.queries import tokenizer_path
from discern.llm.suffix import remove_repeats

#: Below this value of the language's regression a text is in no known language.  The values of all
#: languages sum to about 1, so among many languages the limit follows their number.
LEAST_SCORE, LEAST_SHARE = 0.3, 1.15


def _boxed(docs: DataFrame, **own: Column) -> DataFrame:
    """The columns of ``docs`` in one column ``row`` and the named ones beside it: no name can clash."""
    return docs.select(*[c.alias(name) for name, c in own.items()], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _unboxed(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The boxed columns again, some of them changed."""
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the collection; texts without a letter go.

    Where no document has a language there is nothing to judge by, and all documents stay.
    """
    model = train(docs, F.col("doc_id").isNotNull())
    if model is None:
        return docs
    least = min(LEAST_SCORE, LEAST_SHARE / len(model["names"]))
    lang, score = fresh(docs, "lang_pred", "score")
    found = predict(docs, model, names=(lang, score))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text in the second column to the SHA-256 of its words in lower case; null without words."""
    for batch in batches:
        for rows in text_slices(batch, 500_000):
            words = [words_of(t) for t in rows.column(1).to_pylist()]
            keys = [hashlib.sha256(w).hexdigest() if w else None for w in words]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(keys, pa.string()), *rows.columns[2:]], names=["doc_id", "key", *rows.schema.names[2:]])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least id; a row without id only if no copy has one.

    Near copies share four fifths of their shingles of five words.  Rows are judged by their words, not
    by their ids: rows with the same words are one class, and one row stands for it.  Rows without
    words stay.
    """
    kept = stored(spark, "near-dedup")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # two hashes of all its columns stand for a row: only these are grouped, and a text is moved once, if at all
    marks = {"mark": F.xxhash64(row), "mark2": F.xxhash64(F.lit(1), row)}
    slim = docs.select(F.col("doc_id"), F.col("text"), *[c.alias(name) for name, c in marks.items()])
    schema = StructType([slim.schema["doc_id"], StructField("key", StringType()), *slim.schema.fields[2:]])
    keyed = kept.keep_texts(slim.mapInArrow(lean(_word_keys), schema), "keyed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "mark2")
    one = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min(order).alias("one"))
    one = kept.keep(one.select("key", "one.doc_id", "one.mark", "one.mark2"), "classes")
    # a class without an id, or whose id stands for several classes, goes by a hash of its key
    several = one.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = kept.keep(several.select(F.col("doc_id").alias("several")), "several")
    named = one
    if several.isEmpty():
        named = named.withColumn("several", F.lit(None).cast("long"))
    else:
        named = named.join(several, F.col("doc_id") == F.col("several"), "left")
    own = F.col("doc_id").isNotNull() & F.col("several").isNull()
    named = named.withColumn("id", F.when(own, F.col("doc_id").cast("long")).otherwise(F.xxhash64("key")))
    # rows that are equal in all columns share their marks, and one of them stands for them
    equal = Window.partitionBy("mark", "mark2").orderBy("mark")
    whole = _boxed(docs, **marks).withColumn("place", F.row_number().over(equal)).where("place = 1")
    whole = whole.join(named.select("mark", "mark2", "id", "key", "doc_id"), ["mark", "mark2"]).select("id", "key", "doc_id", "row")
    whole = kept.keep(whole, "rows")
    found = near_duplicates(whole, id_col="id", text_col="row.text").select(F.col("doc_id").alias("id"), "component_id")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    first = whole.select("id", "key", "doc_id").join(found, "id").groupBy("component_id").agg(F.min_by("key", rank).alias("key"))
    rows = whole.join(first.select("key"), "key", "left_semi")
    blank = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return _unboxed(rows, docs.columns).unionByName(blank)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that also occur earlier.

    A character that a cut leaves incomplete goes with the cut.
    """
    cleaned = remove_repeats(_boxed(docs, doc_id=F.col("doc_id"), text=F.col("text")), carry=("row",), as_text=True)
    text = F.when(F.size("removed") == 0, F.col("row.text")).otherwise(F.col("kept"))
    return _unboxed(cleaned, docs.columns, text=text, n_chars=F.length(text).cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for the first pass over a document and one for the second."""
    mixed = mix(_boxed(docs, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source")), carry=("row",))
    rows = mixed.withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("own", F.filter("spans", lambda s: s["times"] >= F.col("pass")))
    count = F.aggregate("own", F.lit(0), lambda n, s: n + (s["to"] - s["from"]).cast("int"))
    words = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("own", lambda s: F.slice(words, s["from"] + 1, s["to"] - s["from"]))), " ")
    rows = rows.withColumn("some", count).where(F.col("some") > 0)
    text = F.when(F.col("some") == F.col("size"), F.col("row.text")).otherwise(cut)
    return _unboxed(rows, docs.columns, text=text, n_chars=F.length(text).cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: SQL has neither the tokenizer nor the kernel; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written before the next reads it."""
    kept = stored(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = kept.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            kept.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
