"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected to eight dimensions by several seeded rotations and decoded to the
nearest point of the E8 lattice, which packs its cells as tightly as eight dimensions allow.  A
vector is filed under its own cell and asks in the neighbouring cells whose centres are nearest to
it.  Pairs that meet are confirmed by the cosine in double precision.  Equal vectors are one class
and are compared once; a crowded cell is compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discern.llm.common import stored
from discern.llm.graph import components
from discern.llm.top_k import usable

#: A pair at cosine 0.9 meets in a table with probability 0.5 (measured), at 0.95 with 0.87; an
#: unrelated pair with 0.0008.  For many more rows raise SCALE, and TABLES with it.
TABLES, PROBES = 12, 16
#: Lattice units of a unit vector's length.
SCALE = 2.6
#: Bits of the angle sketch that pairs in a cell are first compared by.
SKETCH = 128
#: Members of a block of one cell.
BLOCK = 512


def nearest_integers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest point of the lattice of integer vectors with an even sum, and its squared distance."""
    rounded = np.rint(x)
    off = x - rounded
    odd = np.flatnonzero(np.abs(rounded.sum(axis=1)) % 2 == 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    rounded[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return rounded, ((x - rounded) ** 2).sum(axis=1)


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points in half units: even-sum integer vectors, or the same moved by one half."""
    whole, d_whole = nearest_integers(x)
    half, d_half = nearest_integers(x - 0.5)
    return (2 * np.where((d_whole <= d_half)[:, None], whole, half + 0.5)).astype(np.int64)


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8 in half units: a cell's neighbours."""
    grid = np.array(np.meshgrid(*[[-1, 1]] * 8)).reshape(8, -1).T
    halves = grid[(grid == -1).sum(axis=1) % 2 == 0]
    pairs = []
    for i in range(8):
        for j in range(i):
            for a in (-2, 2):
                for b in (-2, 2):
                    pairs.append([a if k == i else b if k == j else 0 for k in range(8)])
    return np.vstack([halves, np.array(pairs)]).astype(np.int64)


def rotations(width: int, seed: int = 17) -> np.ndarray:
    """``TABLES`` projections to eight dimensions that keep lengths on average."""
    rng = np.random.default_rng(seed + width)
    out = []
    for _ in range(TABLES):
        basis = np.linalg.qr(rng.normal(size=(max(width, 8), 8)))[0][:width]
        out.append(basis * np.sqrt(max(width, 8) / 8) * SCALE)
    return np.array(out)


def _key(points: np.ndarray, table: int, width: int) -> np.ndarray:
    key = np.full(points.shape[:-1], table * 1_000_003 + width, np.uint64)
    for d in range(8):
        key = (key + points[..., d].astype(np.uint64)) * np.uint64(0xC6A4A7935BD1E995)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vector and table: the key of its own cell, and of the ``PROBES`` nearest neighbouring cells."""
    width, steps = unit.shape[1], shortest_vectors()
    home, probes = [], []
    for t, turn in enumerate(rotations(width)):
        x = unit @ turn
        point = decode(x)
        # of all neighbours at one distance the nearest to x is the one most along x - point
        along = (2 * x - point) @ steps.T
        best = np.argpartition(-along, PROBES, axis=1)[:, :PROBES]
        home.append(_key(point, t, width))
        probes.append(_key(point[:, None, :] + steps[best], t, width))
    return np.stack(home, axis=1), np.stack(probes, axis=1)


def sketches(unit: np.ndarray) -> np.ndarray:
    """The sides of ``SKETCH`` seeded planes on which each vector lies, as integers."""
    planes = np.random.default_rng(23).normal(size=(SKETCH, unit.shape[1]))
    return np.packbits(unit @ planes.T > 0, axis=1).view(np.int64)


def most_differences(threshold: float) -> int:
    """Sketch bits in which a pair at the threshold differs, and 6.5 deviations."""
    p = np.arccos(threshold) / np.pi
    return int(np.ceil(SKETCH * p + 6.5 * np.sqrt(SKETCH * p * (1 - p))))


def _filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(cell, id, home, sketch): each vector under its own cells, and asking in the neighbouring ones."""
    for batch in batches:
        for _, rows in batch.groupby("width"):
            for at in range(0, len(rows), 1024):
                part = rows.iloc[at : at + 1024]
                x = np.vstack(part["vector"].to_numpy()).astype(float)
                x /= np.abs(x).max(axis=1)[:, None]  # no square may leave the range
                x /= np.sqrt((x**2).sum(axis=1))[:, None]
                (home, probes), sides = cells(x), sketches(x)
                rows_of = np.concatenate([np.repeat(np.arange(len(x)), TABLES), np.repeat(np.arange(len(x)), TABLES * PROBES)])
                ids = part["id"].to_numpy()
                yield pd.DataFrame(
                    {
                        "cell": np.concatenate([home.ravel(), probes.ravel()]),
                        "id": ids[rows_of],
                        "home": np.repeat([True, False], [home.size, probes.size]),
                        **{f"s{k}": sides[rows_of, k] for k in range(SKETCH // 64)},
                    }
                )


def _confirm(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), "<f8") for v in batch.column(c)] for c in (2, 3))
            good = [bool(np.dot(a, b) >= threshold * np.sqrt(np.dot(a, a) * np.dot(b, b))) for a, b in zip(x, y)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as doubles, divided by their largest component so that no square leaves the range."""
    for batch in batches:
        batch["raw"] = [(np.asarray(v, "<f8") / np.abs(np.asarray(v, "<f8")).max()).tobytes() for v in batch["vector"]]
        yield batch[["id", "raw"]]


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Direct links and components of vectors whose cosine is ``threshold`` or more.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id,
    link with nothing; neither do vectors of different lengths.  Every row of the input gives one
    row.  Rows that repeat an id are one vector if they are equal; an id on different vectors stands
    for each of them by itself: each has its own links, all of which are counted, and its own
    component, which is named by the least id in it.  Returns vec_id, n_links, component_id, kept;
    without an id the component is null and the row is kept.
    """
    kept = stored(vectors.sparkSession, "lattice")
    taken = usable(F.col(vector_col)) & F.exists(vector_col, lambda x: x != 0) & F.col(id_col).isNotNull()
    # -0.0 and 0.0 are one value
    plain = F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(taken, plain).alias("vector"))
    rows = rows.withColumn("class", F.when(F.col("vector").isNotNull(), F.sha2(F.to_json(F.struct("vector")), 256)))
    there = rows.where(F.col("vector").isNotNull())
    # one row for each id of a class before the classes are counted
    ids = there.groupBy("class", "vec_id").agg(F.first("vector").alias("vector"))
    classes = ids.groupBy("class").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = kept.keep(classes, "least")
    # a class whose least id is that of several classes goes by a hash
    several = classes.groupBy("least").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = kept.keep(several.select(F.col("least").alias("several")), "several")
    if unique := several.isEmpty():
        classes = classes.withColumn("id", F.col("least"))
    else:
        classes = classes.join(several, F.col("least") == F.col("several"), "left")
        classes = classes.withColumn("id", F.when(F.col("several").isNull(), F.col("least")).otherwise(F.xxhash64("class")))
    classes = kept.keep(classes.select("class", "id", "least", "copies", "vector"), "classes")
    first = classes.select("id", "vector", F.size("vector").alias("width"))
    packed = kept.keep(first.mapInPandas(_packed, "id long, raw binary"), "packed")
    filed = kept.keep(first.mapInPandas(_filed, "cell long, id long, home boolean, s0 long, s1 long"), "filed")
    busy = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).where("n > 1 AND homes > 0")
    busy = busy.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = filed.join(busy, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = kept.keep(members, "members")
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    asks = members.select("cell", F.col("id").alias("x"), F.col("home").alias("own"), F.col("block").alias("i"), F.explode(blocks).alias("j"),
                          F.col("s0").alias("x0"), F.col("s1").alias("x1"))
    homes = members.where("home").select("cell", F.col("id").alias("y"), F.col("block").alias("j"), F.explode(blocks).alias("i"),
                                         F.col("s0").alias("y0"), F.col("s1").alias("y1"))
    differ = F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))) + F.bit_count(F.col("x1").bitwiseXOR(F.col("y1")))
    met = asks.join(homes, ["cell", "i", "j"]).where(
        ((F.col("x") < F.col("y")) | (~F.col("own") & (F.col("x") > F.col("y")))) & (differ <= most_differences(threshold))
    )
    pairs = kept.keep(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    both = pairs.join(packed.toDF("b", "raw_b"), "b").join(packed.toDF("a", "raw_a"), "a").select("a", "b", "raw_a", "raw_b")
    links = kept.keep(both.mapInArrow(_confirm(threshold), "a long, b long"), "links")
    labels = components(links, kept, "components")
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    linked = ends.join(classes.select(F.col("id").alias("other"), "copies"), "other").groupBy("id").agg(F.sum("copies").alias("others"))
    whole = classes.drop("vector").join(linked, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    whole = whole.withColumn("label", F.coalesce("label", "id"))
    if unique:
        whole = whole.withColumn("component", F.col("label"))
    else:
        whole = whole.join(whole.groupBy("label").agg(F.min("least").alias("component")), "label")
    whole = whole.select("class", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    whole = kept.keep(whole, "whole")
    answer = rows.select("vec_id", "class").join(whole, "class", "left")
    component = F.coalesce("component", "vec_id")
    return answer.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
