"""Splits, folds, shuffles and samples that depend on a row's id only."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discern.functions.hashing import HASHES, hash32, hash_bucket, hash_hex, hash_unit
from discern.sources.scratch import materialize

# Seeds of the published experiments.
SPLIT_SEED = 5043
SPARSE_SPLIT_SEED = 12345
FOLD_SEED = 7919
SAMPLE_SEED = 104729
# Each number of copies is one literal in the plan.
MOST_COPIES = 1000


def split_number(ids: Sequence[str], weights: Sequence[float], seed: int = SPLIT_SEED) -> Column:
    """0, 1, ... in the proportion of ``weights``."""
    total = float(sum(weights))
    cuts, running = [], 0.0
    for weight in weights[:-1]:
        running += weight
        cuts.append(round(running / total * HASHES))
    bucket = hash32(ids, seed)
    if len(cuts) == 1:
        return (bucket >= cuts[0]).cast("int")

    def number(b: Column) -> Column:
        return sum((F.when(b >= F.lit(cut), 1).otherwise(0) for cut in cuts), F.lit(0))

    return _bound(bucket, number)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_split(
    df: DataFrame, ids: Sequence[str], weights: Sequence[float] = (80, 20), seed: int = SPLIT_SEED, name: str = "split"
) -> DataFrame:
    return df.withColumn(name, split_number(ids, weights, seed))


def hash_split(
    df: DataFrame, ids: Sequence[str], weights: Sequence[float] = (80, 20), seed: int = SPLIT_SEED
) -> tuple[DataFrame, ...]:
    """The parts of ``df`` as separate frames: disjoint, complete, repeatable."""
    number = split_number(ids, weights, seed)
    return tuple(df.filter(number == i) for i in range(len(weights)))


def stored_split(
    df: DataFrame,
    ids: Sequence[str],
    weights: Sequence[float] = (80, 20),
    seed: int = SPLIT_SEED,
    keep: Sequence[str] | None = None,
) -> tuple[DataFrame, ...]:
    """As :func:`hash_split`, with the rows written once, one directory per part.

    Use it before a fit: the part is read without touching the others, and neither
    the preparation nor the hashes are repeated on each pass of the solver.
    """
    rows = with_split(df, ids, weights, seed)
    rows = materialize(rows.select(*(keep or df.columns), "split"), "split", ["split"])
    return tuple(rows.filter(F.col("split") == i).drop("split") for i in range(len(weights)))


def with_fold(df: DataFrame, ids: Sequence[str], k: int, seed: int = FOLD_SEED, name: str = "fold") -> DataFrame:
    return df.withColumn(name, hash_bucket(ids, seed, k).cast("int"))


def shuffle_rows(df: DataFrame, ids: Sequence[str], seed: int = SAMPLE_SEED) -> DataFrame:
    """Rows in an order that looks random and is the same on every run."""
    return df.orderBy(hash_hex(ids, seed), *ids)


def shuffled_top(df: DataFrame, ids: Sequence[str], n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """``n`` rows drawn without replacement: the first ``n`` of the shuffled order, in that order.

    The n-th smallest hash is found by counting, 16 bits of it at a time, in two scans that give
    the driver at most 65,536 counts each; rows below it are then kept by a filter.  Only rows with
    that very hash, copies of one id as a rule, go through one task that chooses among them; the
    order of the answer is made by ranges.
    """
    if n <= 0:
        return df.limit(0)
    hashed = hash32(ids, seed)
    left, low, kept = n, 0, None
    for shift in (16, 0):
        cells = df.select(hashed.alias("h")) if kept is None else df.select(hashed.alias("h")).filter(kept)
        cell = F.shiftright("h", shift)
        found = sorted(tuple(r) for r in cells.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect())
        for low, count in found:
            if count >= left:
                break
            left -= count
        else:
            return shuffle_rows(df, ids, seed)  # no more rows than asked for
        kept = F.shiftright("h", shift) == low
    below = df.filter(hashed < low)
    same = df.filter(hashed == low)
    return shuffle_rows(below.unionAll(shuffle_rows(same, ids, seed).limit(left)), ids, seed)


def poisson_cuts(rate: float) -> list[float]:
    """Upper ends of the cumulative Poisson distribution, to the 32-bit hash resolution.

    Terms come from their logarithms, so that large rates start above zero.
    """
    if not 0 < rate <= MOST_COPIES:
        raise ValueError(f"a rate between 0 and {MOST_COPIES} copies a row is needed, not {rate}")
    cuts, terms, k = [], [], 0
    while not cuts or cuts[-1] < 1 - 2.0**-33:
        terms.append(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)))
        cuts.append(math.fsum(terms))
        k += 1
        if k > rate and terms[-1] < 2.0**-60:
            break
    return cuts[:-1]


def sample_with_replacement(
    df: DataFrame, ids: Sequence[str], fraction: float, seed: int = SAMPLE_SEED, copy: str = "copy"
) -> DataFrame:
    """Each row a Poisson(``fraction``) number of times, ``copy`` numbering its copies.

    The number of copies comes from the row's hash, so the sample does not change
    with partitioning or on a retry, and no shuffle is needed.
    """
    first, *more = poisson_cuts(fraction)
    more = more or [math.inf]
    unit = hash_unit(ids, seed)

    def copies(u: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(cut) for cut in more]), lambda cut: cut <= u)) + 1

    number = _bound(unit, copies)
    return df.filter(unit >= F.lit(first)).withColumn(copy, F.explode(F.sequence(F.lit(1), number)))
