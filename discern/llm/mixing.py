"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Words are seats: they go to the sources by the highest quotients target / (2 k + 1).  A source's
documents are laid end to end in a seeded order and cut into equal blocks, of ``BLOCK`` words or, in
a small source, of a ``BLOCK``-th of it; the blocks that its words make up go to its shards by
the same rule.
Within a shard a seeded permutation picks the blocks that are taken once more than the others,
so no list of blocks is ever built: each document finds its own taken words by arithmetic.
"""

from __future__ import annotations

import heapq
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discern.llm.common import stored, word_count

BLOCK = 64
#: Shards of a source.  A shard of a source is sorted by one task.
SHARDS = 256
#: Weights by rank of the source; they repeat.
WEIGHTS = (5, 2, 1)


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1); a party stops at ``most``, ties go to the first.

    Starts from seats that every party is sure of and gives the rest one at a time, so the cost
    is in the number of parties, not of seats.
    """
    votes, most = votes.astype(float), most.astype(np.int64)
    total, seats = votes.sum(), int(min(seats, most.sum()))
    if seats <= 0 or total <= 0:
        return np.zeros(len(votes), np.int64)
    # A divisor a little above the final one under-serves everybody.
    divisor = total / seats * (1 + (len(votes) + 1) / seats)
    won = np.minimum(np.floor(votes / divisor + 0.5).astype(np.int64), most)
    while won.sum() > seats:
        divisor *= 1 + 1 / seats
        won = np.minimum(np.floor(votes / divisor + 0.5).astype(np.int64), most)
    queue = [(-v / (2 * k + 1), i) for i, (v, k, m) in enumerate(zip(votes, won, most)) if k < m]
    heapq.heapify(queue)
    for _ in range(seats - int(won.sum())):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        won[i] += 1
        if won[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * won[i] + 1), i))
    return won


def source_targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes(source, source_size)``, one row a source, to those with ``target``.

    Targets are the weights times a common level, cut at ``limit`` times the source's size; the
    level is where they sum to ``share`` of all sizes.  Walking the sources by the level at which
    they are cut, those before the answer are full and the rest share what is left by weight.
    One task sees one row a source.
    """
    rank = Window.orderBy(F.col("source").isNull(), F.col("_order"))
    by_level = Window.orderBy("_level", F.col("source").isNull(), F.col("_order"))
    all_rows = Window.partitionBy(F.lit(0))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    zero = F.lit(0.0)
    # Spark compares strings by their UTF-8 bytes, which is by code point.
    rows = sizes.withColumn("_order", F.col("source").cast("binary")).withColumn("_w", weight)
    rows = rows.withColumn("_cap", F.col("source_size") * limit).withColumn("_level", F.col("_cap") / F.col("_w"))
    rows = rows.withColumn("_left", F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("_cap").over(before), zero))
    rows = rows.withColumn("_open", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), zero))
    rows = rows.withColumn("_cut", F.col("_level") * F.col("_open") < F.col("_left"))
    level = F.max(F.when(~F.col("_cut"), F.col("_left") / F.col("_open"))).over(all_rows)
    return rows.withColumn("_at", level).select(
        "source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_at"), F.col("_cap"))).alias("target")
    )


def _seats_of_sources(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("source", na_position="last", kind="stable").reset_index(drop=True)
    size = rows["source_size"].to_numpy(np.int64)
    words = sainte_lague(rows["target"].to_numpy(), round(float(rows["target"].sum())), 2 * size)
    rows["block"] = np.clip(size // BLOCK, 1, BLOCK)
    rows["seats"] = (2 * words + rows["block"]) // (2 * rows["block"])
    return rows[["source", "source_size", "target", "block", "seats"]]


def _quotas_of_shards(rows: pd.DataFrame) -> pd.DataFrame:
    """Integer quotas for the shards of one source, and the permutation that selects blocks."""
    rows = rows.sort_values("shard").reset_index(drop=True)
    ends = rows["size"].cumsum().to_numpy()
    starts = ends - rows["size"].to_numpy()
    block = int(rows["block"].iloc[0])
    first = -(-starts // block)  # a block belongs to the shard it starts in
    count = -(-ends // block) - first
    rows["start"], rows["first"], rows["count"] = starts, first, count
    rows["quota"] = sainte_lague(count, int(rows["seats"].iloc[0]), 2 * count)
    steps = []
    for n, draw in zip(count.tolist(), rows["draw"].tolist()):
        step = abs(draw) % max(n, 1) or 1
        while gcd(step, max(n, 1)) > 1:
            step += 1
        steps.append(step)
    rows["step"] = steps
    return rows[["source", "shard", "start", "first", "count", "quota", "step", "shift"]]


def mix(
    docs: DataFrame, share: float = 1.5, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """What a mix of the sources takes of every row.

    Size of a row: its words (null: 0).  Returns the id, source, size, source_size, target (both of
    the row's source), taken (words the mix takes, repeats counted, at most twice the size), spans
    (word ranges [from, to) with the times each is taken) and the columns named in ``carry``.
    Rows with a null source form one source, weighed last.  Rows without words take nothing.  Repeated rows count as often as they occur.  Order within a
    source follows a seeded hash of the id and text, so reruns agree.
    """
    spark = docs.sparkSession
    kept = stored(spark, "mixing")
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col)))
    columns = [
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("_key"),
        F.pmod(F.shiftrightunsigned(key, 17), F.lit(SHARDS)).cast("int").alias("shard"),
    ]
    rows = kept.keep(docs.select(*columns), "sizes")
    cells = rows.groupBy("source", "shard").agg(F.sum("size").alias("size"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), share)
    seats = (
        targets.withColumn("_all", F.lit(0))
        .groupBy("_all")
        .applyInPandas(lambda p: _seats_of_sources(p), "source string, source_size long, target double, block long, seats long")
    )
    seats = kept.keep(seats, "seats")
    drawn = cells.withColumn("draw", F.xxhash64(F.lit(seed), F.lit("step"), "source", "shard").bitwiseAND(F.lit((1 << 40) - 1)))
    drawn = drawn.withColumn("shift", F.xxhash64(F.lit(seed), F.lit("shift"), "source", "shard").bitwiseAND(F.lit((1 << 40) - 1)))
    quotas = (
        drawn.join(seats, drawn["source"].eqNullSafe(seats["source"]))
        .select(drawn["source"], "shard", "size", "draw", "shift", "block", "seats")
        .groupBy("source")
        .applyInPandas(
            lambda p: _quotas_of_shards(p),
            "source string, shard int, start long, first long, count long, quota long, step long, shift long",
        )
    )
    quotas = quotas.join(seats.withColumnRenamed("source", "_s"), quotas["source"].eqNullSafe(F.col("_s"))).drop("_s", "seats")
    quotas = kept.keep(_with_prior(quotas), "quotas")
    inside = Window.partitionBy("source", "shard").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    carried = [f"_carry_{c}" for c in carry]
    whole = docs.select(*columns, *[F.col(c).alias(x) for c, x in zip(carry, carried)]) if carry else rows
    laid = whole.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    q = quotas.withColumnsRenamed({"source": "_qs", "shard": "_qshard"})
    laid = laid.join(q, laid["source"].eqNullSafe(q["_qs"]) & (laid["shard"] == q["_qshard"]))
    laid = laid.withColumn("_at", F.col("start") + F.col("_before"))
    times = (
        "if(b >= first, if(count = 0, 0, quota div count + if(pmod((b - first) * step + shift, count) < quota % count, 1, 0)),"
        " if(p_count = 0 OR p_count IS NULL, 0, p_quota div p_count + if(pmod((b - p_first) * p_step + p_shift, p_count) < p_quota % p_count, 1, 0)))"
    )
    spans = (
        "transform(sequence(_at div block, (_at + size - 1) div block), b -> struct("
        f"int(greatest(b * block, _at) - _at) AS from, int(least((b + 1) * block, _at + size) - _at) AS to, int({times}) AS times))"
    )
    empty = "cast(array() AS array<struct<from: int, to: int, times: int>>)"
    return laid.select(
        F.col("_id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        F.expr(f"if(size = 0, {empty}, filter({spans}, x -> x.times > 0))").alias("spans"),
        *[F.col(x).alias(c) for c, x in zip(carry, carried) if c not in (id_col, source_col)],
    ).withColumn("taken", F.expr("aggregate(spans, 0L, (n, x) -> n + (x.to - x.from) * x.times)"))


def _with_prior(quotas: DataFrame) -> DataFrame:
    """Adds, as p_..., the last earlier shard of the source that owns a block.

    The first words of a shard can lie in a block that starts before it; there the quota of the
    shard that owns the block counts.
    """
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("count") > 0, F.struct("first", "count", "quota", "step", "shift")), ignorenulls=True).over(before)
    rows = quotas.withColumn("_o", owner)
    return rows.select("*", *[F.col(f"_o.{c}").alias(f"p_{c}") for c in ("first", "count", "quota", "step", "shift")]).drop("_o")
