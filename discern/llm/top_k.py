"""Exact top-k by inner product: ball trees with branch and bound, one for each shard of the rows.

Nodes are visited by their upper bound, query x centre + |query| x radius.  A first round asks
only one shard for each query; its kth score is shared with all shards in the second round, where
most subtrees fall below it at once.  Every shard answers with its own best k ids, and the best k of
those answers are the result, whatever the sharding.  Equal rows of one id are one row; an id's
different vectors may lie in several shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discern.llm.common import stored

LEAF = 32
#: Rows of a shard, and queries that travel together.
SHARD_ROWS, QUERY_BLOCK = 1024, 64
#: Integer products are exact in doubles below this; larger ones are made with integers.
_EXACT = float(1 << 52)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


class BallTree:
    """Rows split at the median of their widest direction until a leaf holds at most ``LEAF``."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.order = rows, np.arange(len(rows))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left child, right child
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._build(0, len(rows))
        self.centre, self.radius = np.array(self.centres), np.array(self.radii)
        self.sorted = self.rows[self.order]  # a node's rows lie side by side
        self.largest = max(1.0, float(np.abs(rows).max()))

    def _build(self, lo: int, hi: int) -> int:
        own = self.rows[self.order[lo:hi]]
        centre = own.mean(axis=0)
        node = len(self.nodes)
        self.nodes.append((lo, hi, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
        if hi - lo > LEAF and self.radii[node] > 0:
            far = own[((own - centre) ** 2).sum(axis=1).argmax()]
            middle = (hi - lo) // 2
            by = np.argpartition((own - centre) @ (far - centre), middle)
            self.order[lo:hi] = self.order[lo:hi][by]
            left = self._build(lo, lo + middle)
            self.nodes[node] = (lo, hi, left, self._build(lo + middle, hi))
        return node

    def best(self, query: np.ndarray, own_id: int, ids: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """(score, -id) of the best ``k`` ids with a row not below ``floor``, by their best row; ties to the smaller id."""
        bounds = self.centre @ query + np.sqrt(query @ query) * self.radius
        bounds += 1e-9 * (np.abs(bounds) + 1)  # never prune by rounding
        exact = np.abs(query).sum() * self.largest < _EXACT
        found: list[tuple[int, int]] = []
        held: dict[int, int] = {}  # the best score of each id in found
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            lo, hi, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            if exact:
                scores = (self.sorted[lo:hi] @ query).astype(np.int64)
            else:
                scores = np.array([sum(int(a) * int(b) for a, b in zip(r, query)) for r in self.sorted[lo:hi]], dtype=object)
            high = np.flatnonzero(scores >= floor)
            if not len(high):
                continue
            for score, i in zip(scores[high].tolist(), ids[self.order[lo:hi][high]].tolist()):
                if i == own_id:
                    continue
                if i in held:
                    if score > held[i]:
                        found[found.index((held[i], -i))] = (score, -i)
                        heapq.heapify(found)
                        held[i] = score
                elif len(found) < k:
                    heapq.heappush(found, (score, -i))
                    held[i] = score
                elif (score, -i) > found[0]:
                    del held[-heapq.heapreplace(found, (score, -i))[1]]
                    held[i] = score
            if len(found) == k:
                floor = max(floor, found[0][0])
        return found


def _matrix(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, "<f8").reshape(-1, width)


def _search(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Each row: one shard and the query blocks that ask it."""
    for batch in batches:
        for width, ids, rows, blocks in zip(batch["width"], batch["ids"], batch["rows"], batch["blocks"]):
            ids, rows = np.frombuffer(ids, "<i8"), _matrix(rows, width)
            tree, out = BallTree(rows), []
            for block in blocks:
                queries = _matrix(block["rows"], width)
                for query_id, query, floor in zip(np.frombuffer(block["ids"], "<i8"), queries, np.frombuffer(block["floors"], "<f8")):
                    out += [(query_id, -minus, score) for score, minus in tree.best(query, query_id, ids, k, floor)]
            table = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
            # beyond 64 bits a score is held at their end
            table["score"] = [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in table["score"]]
            yield table.astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one group as one row with packed ids, vectors and floors."""
    return pd.DataFrame(
        {
            "width": [int(rows["width"].iloc[0])],
            "home": [int(rows["home"].iloc[0])],
            "ids": [rows["id"].to_numpy("<i8").tobytes()],
            "rows": [np.concatenate([np.asarray(v, "<f8") for v in rows["vector"]]).tobytes()],
            "floors": [rows["floor"].to_numpy("<f8").tobytes()],
        }
    )


_PACKED = "width int, home int, ids binary, rows binary, floors binary"


def _blocks(queries: DataFrame, by: list[str]) -> DataFrame:
    return queries.groupBy("width", *by).applyInPandas(lambda p: _pack(p), _PACKED)


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The ``k`` highest integer inner products of each query with all other rows.

    Components become floor(scale * x) in double precision.  ``queries`` selects the query rows.
    Rows without id, and vectors that are null, empty or hold null or non-finite components, take
    no part; vectors are compared only with vectors of their own length.  All rows with the
    query's id are its own.  Ties go to the smaller id; with fewer candidates all are returned.
    An id on several rows keeps its best score once; a query id on several vectors asks with each
    of them, and a candidate's score is the best of these.  Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    kept = stored(spark, "top-k")
    rows = kept.keep(
        vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"),
            F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"),
            F.size(vector_col).alias("width"),
            queries.alias("asks"),
        ).groupBy("id", "vector", "width").agg(F.max("asks").alias("asks")),
        "rows",
    )
    widths = rows.groupBy("width").count().collect()  # as many rows as vector lengths
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = max(1, -(-max(w["count"] for w in widths) // shard_rows))
    hashed = rows.withColumn("home", F.pmod(F.xxhash64(F.lit("shard"), "id", "vector"), F.lit(shards)).cast("int"))
    hashed = hashed.withColumn("floor", F.lit(float("-inf")))
    packed = kept.keep(_blocks(hashed, ["home"]).drop("floors"), "shards")
    asks = hashed.where("asks").select("id", "vector", "width", "home", "floor")
    sub = F.pmod(F.xxhash64(F.lit("block"), "id", "vector"), F.lit(max(1, shard_rows // QUERY_BLOCK))).cast("int")
    per_home = _blocks(asks.withColumn("sub", sub), ["home", "sub"])

    def answers(blocks: DataFrame) -> DataFrame:
        lists = blocks.groupBy("width", "home").agg(F.collect_list(F.struct("ids", "rows", "floors")).alias("blocks"))
        work = packed.join(lists, ["width", "home"]).select("width", "ids", "rows", "blocks")
        work = work.repartition(shards, F.xxhash64("ids"))
        return work.mapInPandas(lambda it: _search(it, k), "query_id long, vec_id long, score long")

    first = answers(per_home).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    kth = kept.keep(kth, "kth")
    # In the second round every shard sees every query, block by block, with the shared score.
    known = asks.drop("floor").join(kth, "id", "left").withColumn("floor", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))))
    blocks = F.pmod(F.xxhash64(F.lit("block"), "id", "vector"), F.lit(max(1, shards * shard_rows // (QUERY_BLOCK * 50)))).cast("int")
    spread = _blocks(known.drop("kth").withColumn("block", blocks), ["block"])
    spread = spread.withColumn("home", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    every = answers(spread).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = every.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
