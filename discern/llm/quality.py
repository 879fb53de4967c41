"""Quality classifier: a convolutional network on bytes, in numpy.

A document is cut into overlapping chunks that cover all of it.  Each byte is embedded; filters of
eight bytes slide by four; each filter's response is max-pooled over the chunk.  The chunks'
pooled responses, by mean and by maximum, go through one logistic layer to a probability.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discern.llm.common import text_slices
from discern.llm.sampling import balanced_sample

#: Bytes of a chunk and from one chunk to the next; of a filter and from one place to the next.
CHUNK, HOP, WIDTH, STRIDE = 1024, 896, 8, 4
EMBED, FILTERS = 8, 32
#: Training rows of each label, at most.
PER_LABEL = 5000
EPOCHS, BATCH, RATE, CHUNKS_A_STEP = 12, 64, 0.01, 4


def chunks(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover the whole text; the last is filled with zero bytes."""
    count = 1 + max(0, -(-(len(text) - CHUNK) // HOP))
    padded = np.zeros((count - 1) * HOP + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


def responses(model: dict, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk and filter the largest response and its place."""
    half = CHUNK // STRIDE
    # a filter is two halves of STRIDE bytes, so each half needs one product a place
    seen = model["embed"][bytes_].reshape(len(bytes_) * half, STRIDE * EMBED)
    both = (seen @ model["halves"]).reshape(len(bytes_), half, 2 * FILTERS)
    total = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]
    return total.max(axis=1), total


def pooled(model: dict, bytes_: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document: mean and maximum over its chunks of the rectified responses."""
    parts = [responses(model, bytes_[i : i + 64])[0] for i in range(0, len(bytes_), 64)]
    hidden = np.maximum(np.concatenate(parts) + model["bias"], 0)
    starts = np.cumsum(counts) - counts
    return np.hstack([np.add.reduceat(hidden, starts, axis=0) / counts[:, None], np.maximum.reduceat(hidden, starts, axis=0)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 9) -> dict:
    """Adam on the logistic loss; each step sees up to CHUNKS_A_STEP random chunks of each document."""
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filter": rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    cut = [chunks(t) for t in texts]
    share = len(labels) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))
    step, steps = 0, EPOCHS * (-(-len(texts) // BATCH))
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            picked = [cut[i] if len(cut[i]) <= CHUNKS_A_STEP else cut[i][rng.choice(len(cut[i]), CHUNKS_A_STEP, replace=False)] for i in rows]
            counts = np.array([len(c) for c in picked])
            owner = np.repeat(np.arange(len(rows)), counts)
            bytes_ = np.concatenate(picked)
            model = _halved(p)
            top, total = responses(model, bytes_)
            place = total.argmax(axis=1)
            hidden = np.maximum(top + p["bias"], 0)
            starts = np.cumsum(counts) - counts
            largest = np.maximum.reduceat(hidden, starts, axis=0)
            both = np.hstack([np.add.reduceat(hidden, starts, axis=0) / counts[:, None], largest])
            y = labels[rows]
            slope = ((_sigmoid(both @ p["out"] + p["out_bias"]) - y) * share[y] / len(rows)).astype(np.float32)
            g = {"out": both.T @ slope, "out_bias": slope.sum(keepdims=True)}
            back = slope[:, None] * p["out"][None, :]
            d = (back[:, :FILTERS] / counts[:, None])[owner] + back[:, FILTERS:][owner] * (hidden == largest[owner])
            d = (d * (hidden > 0)).astype(np.float32)
            g["bias"] = d.sum(axis=0)
            # only the place of the largest response carries the gradient
            window = bytes_[np.arange(len(bytes_))[:, None, None], place[:, :, None] * STRIDE + np.arange(WIDTH)]
            seen = p["embed"][window].reshape(len(bytes_), FILTERS, WIDTH * EMBED)
            g["filter"] = np.einsum("nf,nfk->kf", d, seen)
            spread = (d[:, :, None] * p["filter"].T[None]).reshape(-1, EMBED)
            g["embed"] = np.stack([np.bincount(window.ravel(), spread[:, k], minlength=256) for k in range(EMBED)], axis=1)
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, v in p.items():
                m, s = moments[k]
                m += 0.1 * (g[k].reshape(v.shape) - m)
                s += 0.001 * (g[k].reshape(v.shape) ** 2 - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return _halved(p)


def _halved(p: dict) -> dict:
    middle = STRIDE * EMBED
    return {**p, "halves": np.hstack([p["filter"][:middle], p["filter"][middle:]])}


def score(model: dict, texts: list[bytes]) -> np.ndarray:
    cut = [chunks(t) for t in texts]
    counts = np.array([len(c) for c in cut])
    return _sigmoid((pooled(model, np.concatenate(cut), counts) @ model["out"] + model["out_bias"]).astype(float))


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if parts:
        rows = pd.concat(parts, ignore_index=True)
        rows = rows.sort_values(["id", "label", "text"], na_position="first")
        texts = [(t or "").encode() for t in rows["text"]]
        yield pd.DataFrame({"model": [pickle.dumps(fit(texts, rows["label"].to_numpy(np.int64)))]})


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str) -> dict | None:
    """A model of up to PER_LABEL distinct rows of each label; None without any labelled row."""
    marked = labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
    marked = marked.agg(F.min(F.col(label_col).cast("int")).alias("label"), F.max(F.col(label_col).cast("int")).alias("other"))
    marked = marked.where("id IS NOT NULL AND label = other").select("id", "label")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = balanced_sample(texts, PER_LABEL, 2 * PER_LABEL, marks=marked).repartition(1).mapInPandas(_train, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def _scorer(model: dict | None):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 1_000_000):
                texts = [(t or "").encode() for t in rows.column(1).to_pylist()]
                values = score(model, texts) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32))], schema=schema
                )

    return run


def rate_quality(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    model: dict | None = None,
) -> DataFrame:
    """The probability that each whole text has label 1.

    Labels are learned only from rows that are not ``held_out``; labels other than 0 and 1 are
    ignored, and so are ids that have both; equal rows are learned once.  Null and empty texts are scored as an empty chunk;
    without any label the score is 0.5.  Rows with a null id are scored, never learned from; every
    row of the input gives one row.  Returns doc_id, held_out, score, predicted.
    """
    if model is None:
        model = train(docs, labels, F.coalesce(~held_out, F.lit(False)), id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")
