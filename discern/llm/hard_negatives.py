"""Hard negatives by spanning-tree bounds.

Anchors travel in blocks; each block has the minimum spanning tree of its anchors, made once.  In a
shard of candidates the tree is walked from its root, which is scored in full.  Along an edge of
length d an inner product with x changes by at most d |x|, so every candidate's score at a child
lies in its interval at the parent, widened by that much.  Only candidates whose interval meets
the window that the anchor asks for are scored again, which makes their interval a point.

Two rounds: positives first (window: what can still be among the first of the same label), then
negatives (windows: from 0.3 to 0.9 of each positive's score).  Every shard answers with its own
first rows, and the first of those answers are the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discern.llm.common import stored
from discern.llm.top_k import usable

#: Candidates of a shard and anchors of a block, at most about.
SHARD_ROWS, BLOCK_ANCHORS = 8192, 1024
#: Integer products are exact in doubles below this; larger ones are made with integers.
_EXACT = float(1 << 52)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents (-1: the root, which is the first) and edge lengths of a minimum spanning tree, by Prim's method."""
    n = len(points)
    parent, near = np.full(n, -1), np.full(n, np.inf)
    length, done = np.zeros(n), np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        done[at] = True
        apart = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        closer = ~done & ((apart < near) | (parent < 0))
        near[closer], parent[closer] = apart[closer], at
        at = int(np.where(done, np.inf, np.nan_to_num(near, nan=np.finfo(float).max, posinf=np.finfo(float).max)).argmin())
        length[at] = near[at]
    return parent, length


def walk(
    anchors: np.ndarray, rows: np.ndarray, parent: np.ndarray, length: np.ndarray,
    window: Callable[[int, np.ndarray, np.ndarray], np.ndarray], use: Callable[[int, np.ndarray, np.ndarray], None],
) -> int:
    """Visit every anchor of the tree with bounds for the scores of all rows; returns how many were scored.

    ``window(i, low, high)`` gives the rows to score for anchor i, ``use(i, rows, scores)`` gets them.
    """
    children: list[list[int]] = [[] for _ in anchors]
    below = np.ones(len(anchors), np.int64)
    order, stack = [], [0]
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            children[p].append(i)
    while stack:
        order.append(stack.pop())
        stack += children[order[-1]]
    for i in reversed(order):
        below[i] += sum(int(below[c]) for c in children[i])
    norm, anchor_norm = np.sqrt((rows**2).sum(axis=1)), np.sqrt((anchors**2).sum(axis=1))
    exact = np.abs(anchors).max(initial=1) * np.abs(rows).max(initial=1) * rows.shape[1] < _EXACT
    scored = 0

    def score(i: int, which: np.ndarray) -> np.ndarray:
        if exact:
            return (rows[which] @ anchors[i]).astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(r, anchors[i])) for r in rows[which]], dtype=object)

    # the largest subtree comes last, so few intervals are held at once
    todo: list[tuple[int, np.ndarray | None, np.ndarray | None]] = [(0, None, None)]
    while todo:
        i, low, high = todo.pop()
        if low is None:
            everything = np.arange(len(rows))
            own = score(i, everything)
            low = own.astype(float)
            high = low.copy()
            scored += len(rows)
            asked = window(i, low, high)
            use(i, asked, own[asked])
        else:
            # a little more than the length, so that rounding never narrows an interval
            reach = norm * (length[i] * (1 + 1e-9) + 1e-9 * (anchor_norm[i] + anchor_norm[parent[i]]))
            low, high = np.nan_to_num(low - reach, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(high + reach, nan=np.inf, posinf=np.inf, neginf=-np.inf)
            asked = window(i, low, high)
            own = score(i, asked)
            low[asked] = high[asked] = own.astype(float)
            scored += len(asked)
            use(i, asked, own)
        # a stack is read from its end: the smallest subtrees go last onto it
        todo += [(c, low, high) for c in sorted(children[i], key=lambda c: -int(below[c]))]
    return scored


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k], np.int64)
    if len(ids) > 4 * k:  # all of the k highest scores and their equals
        enough = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return enough[np.lexsort((ids[enough], -scores[enough]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _int64(values: list[int]) -> pa.Array:
    return pa.array([min(max(int(v), _LOW), _HIGH) for v in values], pa.int64())


def positives_in(anchors: dict, shard: dict, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(anchor, row, score) of the first ``k`` rows of each anchor's label, and the number of scores made."""
    same = {x: np.flatnonzero(shard["labels"] == x) for x in np.unique(anchors["labels"]).tolist()}
    out: list[tuple[int, int, int]] = []

    def own(i: int) -> np.ndarray:
        which = same[int(anchors["labels"][i])]
        return which[shard["ids"][which] != anchors["ids"][i]]

    def window(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        which = own(i)
        if len(which) <= k:
            return which
        return which[high[which] >= np.partition(low[which], len(which) - k)[len(which) - k]]

    def use(i: int, which: np.ndarray, scores: np.ndarray) -> None:
        best = _first(shard["ids"][which], scores, k)
        out.extend((int(anchors["ids"][i]), int(v), int(s)) for v, s in zip(shard["ids"][which][best], scores[best]))

    return out, walk(anchors["rows"], shard["rows"], anchors["parent"], anchors["length"], window, use)


def negatives_in(anchors: dict, shard: dict, k: int, low_percent: int, high_percent: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(anchor, positive, its score, row, score) of the first ``k`` rows in each window, and the number of scores made."""
    out: list[tuple[int, int, int, int, int]] = []
    other = {x: np.flatnonzero(shard["labels"] != x) for x in np.unique(anchors["labels"]).tolist()}

    def window(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        which = other[int(anchors["labels"][i])]
        a, b = low[which], high[which]
        asked = np.zeros(len(which), bool)
        for _, positive in anchors["positives"][i]:
            if positive < 0:
                continue  # the window is empty
            least, most = positive * low_percent / 100, positive * high_percent / 100
            meets = (b >= least - 1) & (a <= most + 1)
            sure = a[(a >= least + 1) & (b <= most - 1)]
            if len(sure) > k:  # what is certainly below k rows of the window is not among its first
                meets &= b >= np.partition(sure, len(sure) - k)[len(sure) - k]
            asked |= meets
        return which[asked]

    def use(i: int, which: np.ndarray, scores: np.ndarray) -> None:
        for positive_id, positive in anchors["positives"][i]:
            if scores.dtype == object or positive * max(low_percent, high_percent, 100) > _EXACT:
                inside = np.array([low_percent * positive <= 100 * int(s) <= high_percent * positive for s in scores], bool)
            else:
                inside = (100 * scores >= low_percent * positive) & (100 * scores <= high_percent * positive)
            ids, found = shard["ids"][which][inside], scores[inside]
            best = _first(ids, found, k)
            out.extend((int(anchors["ids"][i]), positive_id, positive, int(v), int(s)) for v, s in zip(ids[best], found[best]))

    return out, walk(anchors["rows"], shard["rows"], anchors["parent"], anchors["length"], window, use)


_PACKED = "width int, part int, ids binary, labels binary, rows binary, parent binary, length binary, positives binary"


def _pack(tree: bool):
    """The rows of one (width, part) as one row of packed arrays; with the spanning tree for anchors."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        width = rows["width"][0].as_py()
        vectors = rows["vector"].chunks
        values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors])
        parent = length = np.zeros(0)
        if tree:
            parent, length = spanning_tree(values.reshape(-1, width))
        blobs = [rows["id"].to_numpy().astype("<i8"), rows["label"].to_numpy().astype("<i8"), values.astype("<f8"), parent.astype("<i8"), length.astype("<f8")]
        return pa.table(
            {"width": pa.array([width], pa.int32()), "part": pa.array([rows["part"][0].as_py()], pa.int32()),
             **{n: pa.array([b.tobytes()], pa.binary()) for n, b in zip(("ids", "labels", "rows", "parent", "length"), blobs)}, "positives": pa.array([None], pa.binary())}
        )

    return run


def _opened(row: dict) -> dict:
    ids = np.frombuffer(row["ids"], "<i8")
    out = {"ids": ids, "labels": np.frombuffer(row["labels"], "<i8"), "rows": np.frombuffer(row["rows"], "<f8").reshape(len(ids), -1)}
    if row["parent"]:
        out |= {"parent": np.frombuffer(row["parent"], "<i8"), "length": np.frombuffer(row["length"], "<f8")}
    if row["positives"] is not None:
        # an anchor without a positive has no row in the list
        held: dict[int, list[tuple[int, int]]] = {}
        for anchor, positive, score in np.frombuffer(row["positives"], "<i8").reshape(-1, 3).tolist():
            held.setdefault(anchor, []).append((positive, score))
        out["positives"] = [sorted(held.get(i, [])) for i in ids.tolist()]
    return out


def _unit(schema: pa.Schema, answer):
    """One shard (side 0) and one block of anchors (side 1) to the rows of ``schema``."""

    def run(rows: pa.Table) -> pa.Table:
        sides = {r["side"]: r for r in rows.to_pylist()}
        if len(sides) < 2:
            return schema.empty_table()
        found, _ = answer(_opened(sides[1]), _opened(sides[0]))
        columns = list(zip(*found)) or [[]] * len(schema)
        return pa.table([_int64(list(c)) for c in columns], schema=schema)

    return run


def hard_negatives(
    vectors: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: float = 256.0,
    shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """For each anchor and each of its first positives the first rows of other labels whose scores are in a window.

    Components become floor(scale * x) in double precision; a row's score is its integer inner
    product with the anchor, higher ones first, ties by smaller id.  Positives: an anchor's first
    ``n_positives`` other rows of its label.  Negatives: rows of other labels with
    low_percent * positive <= 100 * negative <= high_percent * positive; a negative positive score
    leaves no such row.  Rows with a null id or label and vectors that are null, empty or hold null or
    non-finite components take no part; vectors are compared only with vectors of their own length.
    An id on several rows is one row, that of the least label, then the least vector.  Scores
    beyond 64 bits are held at their end.  Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    spark = vectors.sparkSession
    kept = stored(spark, "hard-negatives")
    label = F.col("label") if label is None else label
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asks"),
    )
    rows = rows.where("label IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "vector", "asks")).alias("row")).select("id", "row.*")
    rows = kept.keep(rows.mapInArrow(_scaled(scale), "id long, label long, vector array<double>, asks boolean").withColumn("width", F.size("vector")), "rows")
    sizes = rows.groupBy("width").agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / shard_rows)).cast("int").alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.count_if("asks") / block_anchors)).cast("int").alias("blocks"),
    )
    sizes = kept.keep(sizes, "sizes")  # a row for each vector length
    dealt = rows.join(sizes, "width")

    def part(number: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(number), "id"), F.col(number)).cast("int").alias("part")

    shards = dealt.select("id", "label", "vector", "width", part("shards")).groupBy("width", "part").applyInArrow(_pack(False), _PACKED)
    shards = kept.keep(shards, "shards")
    asked = dealt.where("asks").select("id", "label", "vector", "width", part("blocks")).groupBy("width", "part").applyInArrow(_pack(True), _PACKED)
    asked = kept.keep(asked, "anchors")

    def units(blocks: DataFrame, fields: tuple[str, ...], answer) -> DataFrame:
        """Every shard with every block of its width, as one group each."""
        left = shards.join(sizes, "width").select(F.lit(0).alias("side"), F.col("part").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *shards.drop("part").columns)
        right = blocks.join(sizes, "width").select(F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.col("part").alias("block"), *shards.drop("part").columns)
        schema = pa.schema([(f, pa.int64()) for f in fields])
        return left.unionByName(right).groupBy("width", "shard", "block").applyInArrow(_unit(schema, answer), ", ".join(f"{f} long" for f in fields))

    found = units(asked, ("anchor_id", "positive_id", "positive_score"), lambda a, s: positives_in(a, s, n_positives))
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = kept.keep(found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= n_positives).drop("r"), "positives")
    # the anchors' blocks again, with the positives of their anchors
    of_block = dealt.where("asks").select(F.col("id").alias("anchor_id"), "width", part("blocks")).join(positives, "anchor_id")
    lists = of_block.groupBy("width", "part").applyInArrow(_listed, "width int, part int, positives binary")
    asked = asked.drop("positives").join(lists, ["width", "part"])
    fields = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    found = units(asked, fields, lambda a, s: negatives_in(a, s, n_negatives, low_percent, high_percent))
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _scaled(scale: float):
    def run(batches):
        for batch in batches:
            vector = batch.column(2)
            values = np.floor(vector.flatten().to_numpy(zero_copy_only=False) * scale)
            lengths = pa.compute.list_value_length(vector).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(values)), batch.column(3)], names=["id", "label", "vector", "asks"]
            )

    return run


def _listed(rows: pa.Table) -> pa.Table:
    """The positives of one block of anchors as packed (anchor, positive, score)."""
    packed = np.stack([rows[c].to_numpy() for c in ("anchor_id", "positive_id", "positive_score")], axis=1).astype("<i8")
    return pa.table({"width": rows["width"][:1], "part": rows["part"][:1], "positives": pa.array([packed.tobytes()], pa.binary())})
