"""A bounded, balanced sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(id_col: Column, parts: int) -> Column:
    """Remainder of the CRC-32 of the id as text; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts))


def balanced_sample(rows: DataFrame, per_label: int, most: int, seed: int = 5, marks: DataFrame | None = None) -> DataFrame:
    """``per_label`` distinct rows of each label, drawn by a seeded hash; all of them, where there are fewer.

    ``rows(id, text, label)``: equal rows are one, so neither a repeated row nor a repeated id changes
    who else is drawn.  Labels of another table come as ``marks(id, label)``, one row an id: only hashes of
    the rows are shuffled to them, never the texts.  With so many labels that ``most`` rows would be passed, every label gives
    its first drawn row before any gives its second, and so on.  ``per_label`` and ``most`` are the
    documented bounds of what a classifier is fitted on.  Returns id, text, label.
    """
    keyed = rows.withColumn("_key", F.xxhash64(F.lit(seed), "id", "text"))
    if marks is None:
        keyed, own = keyed.where(F.col("label").isNotNull()), ["label", "_key"]
        light = keyed.select(*own)
    else:
        own = ["id", "_key"]
        light = keyed.select(*own).join(marks.where(F.col("label").isNotNull()), "id")
    order = Window.partitionBy("label").orderBy("_key")
    drawn = light.distinct().withColumn("_place", F.row_number().over(order))
    drawn = drawn.where(F.col("_place") <= per_label).orderBy("_place", "_key", "label").limit(most).drop("_place")
    # at most ``most`` keys: the bound of this broadcast is a parameter; copies meet map-side
    chosen = keyed.join(F.broadcast(drawn), own)
    return chosen.groupBy("label", "_key").agg(F.first("id").alias("id"), F.first("text").alias("text")).select("id", "text", "label")
