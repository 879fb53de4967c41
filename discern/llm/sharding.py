"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Equal texts share a ring position, so copies stay together as long as a shard can hold them.
The ring is cut into a fixed number of cells; a shard that is full passes the cell on to the
next shard clockwise.  No shard gets more than ``1 + slack`` times its equal share of the
bytes, so all are near equal, and cells only move past full shards.  A group of copies larger
than ``HEAVY`` of a shard's share leaves its cell and is divided into parts; equal rows are counted
first and dealt to the parts by number, so one row that fills half the table is divided as well.
Only DataFrame and SQL functions are used.  The state that is not spread out is one row a cell or
part, whose number is bounded by parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discern.llm.common import stored

CELLS = 1 << 13
NODES = 64
#: Parts of a group of copies that is heavier than this part of a shard's share.
PARTS, HEAVY = 64, 0.25
#: Equal rows are dealt as at most this many units.
UNITS = 1 << 10
#: Ranges of one shard within which the rows are numbered.
RANGES = 1 << 10
_RING = 1 << 62


def _ring_order(shards: int) -> str:
    """Shards in the order in which their virtual nodes follow ``position`` clockwise."""
    node = f"pmod(shiftrightunsigned(xxhash64('node', s, v), 2) - position, {_RING}L)"
    nearest = f"array_min(transform(sequence(0, {NODES - 1}), v -> {node}))"
    return f"transform(array_sort(transform(sequence(0, {shards - 1}), s -> struct({nearest} AS d, s AS s))), x -> x.s)"


def _fold(shards: int) -> str:
    """Places the units of one sorted array: the first shard clockwise with room, else the emptiest."""
    room = "element_at(filter(u.ring, s -> acc.loads[s] + u.size <= capacity), 1)"
    target = f"coalesce(try_{room}, cast(array_position(acc.loads, array_min(acc.loads)) - 1 AS int))"
    step = (
        f"transform(array({target}), t -> named_struct("
        "'loads', transform(acc.loads, (l, i) -> if(i = t, l + u.size, l)),"
        "'placed', concat(acc.placed, array(t))))[0]"
    )
    start = f"named_struct('loads', array_repeat(0L, {shards}), 'placed', cast(array() AS array<int>))"
    return f"aggregate(units, {start}, (acc, u) -> {step}, acc -> acc.placed)"


def place_cells(loads: DataFrame, shards: int, slack: float) -> DataFrame:
    """``loads(cell, part, size)`` to (cell, part, shard).

    At most ``CELLS`` cells and ``PARTS * shards / HEAVY`` parts come together in one row.
    """
    share = F.sum("size").over(Window.partitionBy(F.lit(0))) / F.lit(shards)
    units = loads.select("cell", "part", "size", share.alias("share"), F.expr("shiftrightunsigned(xxhash64('cell', cell, part), 2)").alias("position"))
    rows = units.select(
        F.ceil(F.col("share") * (1 + slack)).alias("capacity"),
        F.struct((-F.col("size")).alias("order"), "cell", "part", "size", F.expr(_ring_order(shards)).alias("ring")).alias("unit"),
    )
    packed = rows.agg(F.max("capacity").alias("capacity"), F.array_sort(F.collect_list("unit")).alias("units"))
    placed = packed.select(F.explode(F.arrays_zip("units", F.expr(_fold(shards)).alias("placed"))).alias("x"))
    return placed.select("x.units.cell", "x.units.part", F.col("x.placed").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, slack: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A shard and a place in it for every row, by the law ``bytes``: sizes near equal.

    Size of a row: the UTF-8 bytes of its text (null: none) plus 1.  Rows with equal texts go to
    one shard unless together they exceed a quarter of its share; rows without text are spread by
    id.  ``slot`` numbers the rows of each shard from 0 without gaps, by id within hashed ranges.
    Null ids are ordinary rows.  Rows with equal id and text are interchangeable: they are counted
    and travel as one row until the slots are dealt, so the result does not depend on the
    partitioning.  Returns the id, size, text_crc32 (0 without text), law, shard, slot, and a null
    grown_shard, which only the law ``key`` has.
    """
    kept = stored(docs.sparkSession, "sharding")
    raw = F.col(text_col).cast("binary")
    group = F.when(F.col(text_col).isNull(), F.xxhash64(F.lit("none"), F.col(id_col))).otherwise(F.xxhash64(F.col(text_col)))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("_size"),
        F.coalesce(F.crc32(raw), F.lit(0).cast("long")).alias("_crc"),
        group.alias("group"),
    )
    equal = rows.groupBy("_id", "_size", "_crc", "group").agg(F.count(F.lit(1)).alias("n"))
    units = equal.withColumn("unit", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(UNITS)).cast("int") - 1)))
    own = F.expr(f"n div {UNITS}") + (F.col("unit") < F.col("n") % UNITS).cast("long")
    units = kept.keep(units.withColumn("n", F.when(F.col("n") > UNITS, own).otherwise(F.lit(1).cast("long"))), "units")
    groups = units.groupBy("group").agg(F.sum(F.col("_size") * F.col("n")).alias("whole"))
    # shards / HEAVY rows at most, as is the bound of the broadcast
    least = units.agg((F.sum(F.col("_size") * F.col("n")) * HEAVY / shards).alias("least"))
    heavy = groups.where(F.col("whole") > least.scalar()).select("group", F.lit(True).alias("heavy"))
    placeable = units.join(F.broadcast(heavy), "group", "left").select(
        "_id", "_size", "_crc", "n", "unit",
        F.when(F.col("heavy"), F.col("group")).otherwise(F.pmod("group", F.lit(CELLS))).alias("cell"),
        F.when(F.col("heavy"), F.pmod(F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(PARTS)) + F.col("unit"), F.lit(PARTS)))
        .otherwise(F.lit(-1)).cast("int").alias("part"),
        F.pmod(F.xxhash64(F.lit("range"), "_id", "group", "unit"), F.lit(RANGES)).cast("int").alias("range"),
    )
    cells = place_cells(placeable.groupBy("cell", "part").agg(F.sum(F.col("_size") * F.col("n")).alias("size")), shards, slack)
    # CELLS + PARTS * shards / HEAVY rows of a few numbers: the bound of this broadcast is a parameter.
    placed = placeable.join(F.broadcast(cells), ["cell", "part"]).select("_id", "_size", "_crc", "n", "unit", "range", "shard")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "range").agg(F.sum("n").alias("rows"))
    offsets = counts.select("shard", "range", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")).alias("before"))
    within = Window.partitionBy("shard", "range").orderBy("_id", "_crc", "_size", "unit").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0).cast("long")))
    # shards * RANGES rows at most.
    numbered = numbered.join(F.broadcast(offsets), ["shard", "range"])
    slots = F.sequence(F.col("before") + F.col("first"), F.col("before") + F.col("first") + F.col("n") - 1)
    return numbered.withColumn("slot", F.explode(slots)).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
