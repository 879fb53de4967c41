"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discern.sources.scratch import discard, materialize, scratch_path

__all__ = ["WORD", "discard", "fresh", "lean", "lower_ascii", "materialize", "read", "scratch_path", "stored", "word_count"]

#: A word: a run of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Of an Arrow batch of whole texts.  Spark's own 64 MB are held, rounded up, by each task and by its worker.
TEXT_BATCH = "2m"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session's settings for the length of a ``with`` block."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class stored:
    """Scratch tables of one operator: each is written once, and dropped when no longer needed."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark, self.operator, self.paths = spark, operator, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The table as written.  Shuffle files of the job that wrote it are not kept after it."""
        self.paths[name] = scratch_path(self.spark, f"{self.operator}-{name}")
        with held(self.spark, {_CLEAN_UP: "true"}):
            return materialize(df, name, path=self.paths[name])

    def keep_texts(self, df: DataFrame, name: str) -> DataFrame:
        """``keep`` for a job that hands whole texts to Python workers: in Arrow batches of ``TEXT_BATCH``."""
        with held(self.spark, {_BATCH_BYTES: TEXT_BATCH}):
            return self.keep(df, name)

    def drop(self, *names: str) -> None:
        for name in names:
            discard(self.spark, self.paths.pop(name))


def per_worker(key: str, make):
    """A value that a Python worker makes once and keeps for its later tasks."""
    import sys
    import types

    home = sys.modules.setdefault("_discern_llm_worker", types.ModuleType("_discern_llm_worker"))
    if key not in home.__dict__:
        home.__dict__[key] = make()
    return home.__dict__[key]


def lean(run):
    """``run`` on the batches of a task; then the worker gives the system back what it no longer uses.

    An idle worker is kept for later tasks, and what it has freed but holds counts beside the next stages.
    """

    def until_done(batches):
        yield from run(batches)
        give_back()

    return until_done


def give_back() -> None:
    """Free pages of this process to the system: Arrow's, and where the C library can (glibc) the rest."""
    import ctypes
    import sys

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def text_slices(batch, most: int = 2_000_000, column: int = 1):
    """An Arrow batch as slices of about ``most`` bytes of the text in ``column``, or one longer text."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
