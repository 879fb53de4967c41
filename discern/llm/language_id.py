"""Language identification by a string kernel.

The kernel of two texts is the blended spectrum of their byte n-grams by presence: for each
length up to ``LONGEST`` the number of n-grams that both have, weighed, and divided by the root
of the same figure of each text with itself.  Landmarks from the training rows give Nystroem
features; a ridge regression against each language's indicator is fitted on them.  Kernel,
features and regression are linear in a text's n-gram presence once the landmarks are fixed, so
scoring a batch is one product of its presence rows with the folded weights.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from discern.llm.common import lean, text_slices
from discern.llm.sampling import balanced_sample

LONGEST = 3
#: Weight of the n-grams of each length.
WEIGHTS = (0.0, 1.0, 1.0, 2.0)
#: Training rows and landmarks: of each language, and in all, however many languages there are.
PER_LANGUAGE, LANDMARKS = 1200, 64
MOST_ROWS, MOST_LANDMARKS = 24_000, 1024
#: Bytes of a text that are cut into n-grams at once.
STRETCH = 1 << 20
#: Numbers that a product gathers at once.
CELLS = 1 << 20
RIDGE = 1e-3
UNKNOWN = "und"
_NOT_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def grams(text: str) -> list[np.ndarray]:
    """The distinct byte n-grams of each length as sorted integers.

    The text in lower case; ASCII characters that are no letters count as blanks.  A long text is
    taken in stretches that overlap by the longest n-gram but one byte.
    """
    whole = b" " + text.lower().encode().translate(_NOT_LETTERS) + b" "
    found: list[list[np.ndarray]] = [[] for _ in range(LONGEST)]
    for at in range(0, max(1, len(whole) - LONGEST + 1), STRETCH):
        b = np.frombuffer(whole[at : at + STRETCH + LONGEST - 1], np.uint8).astype(np.int32)
        code = b
        for n in range(1, LONGEST + 1):
            if n > 1:
                code = (code[:-1] << 8) | b[n - 1 :]
            ordered = np.sort(code)
            found[n - 1].append(ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered)
    return [parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) for parts in found]


class Presence:
    """N-gram presence over a vocabulary, and each text's kernel with itself.

    The vocabulary of each length is sorted; places are found by binary search.
    """

    def __init__(self, vocabulary: list[np.ndarray]):
        self.vocabulary = vocabulary
        self.bases = np.cumsum([0, *map(len, vocabulary)])
        self.size = int(self.bases[-1])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary places of all texts end to end, how many each text has, self-kernels."""
        places, counts, own = [], [], []
        for text in texts:
            found, kernel = [], 0.0
            for n, words in enumerate(grams(text), 1):
                kernel += WEIGHTS[n] * len(words)
                known = self.vocabulary[n - 1]
                if len(known):
                    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    found.append((at[known[at] == words] + self.bases[n - 1]).astype(np.int32))
            places += found
            counts.append(sum(map(len, found)))
            own.append(kernel)
        return np.concatenate(places or [np.zeros(0, np.int32)]), np.array(counts, np.int64), np.array(own)

    def product(self, texts: list[str], weights: np.ndarray) -> np.ndarray:
        """Presence rows times weights, divided by the root of the self-kernel."""
        places, counts, own = self.of(texts)
        out = np.zeros((len(texts), weights.shape[1]))
        starts = np.cumsum(counts) - counts
        for a, b in _blocks(counts * weights.shape[1]):
            filled = a + np.flatnonzero(counts[a:b])
            if len(filled):
                inside = places[starts[a] : starts[b - 1] + counts[b - 1]]
                out[filled] = np.add.reduceat(weights[inside], starts[filled] - starts[a], axis=0)
        return out / np.sqrt(np.maximum(own, 1e-12))[:, None]


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with sizes of up to ``CELLS`` in all, or a single one."""
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > CELLS:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


class Landmarks:
    """The landmarks by n-gram: which of them have it.  No table of n-grams times landmarks is made."""

    def __init__(self, presence: Presence, texts: list[str]):
        self.presence, self.count = presence, len(texts)
        places, counts, self.own = presence.of(texts)
        by = np.argsort(places, kind="stable")
        self.marks = np.repeat(np.arange(len(texts)), counts)[by]
        self.starts = np.searchsorted(places[by], np.arange(presence.size + 1))
        self.weight = np.concatenate([np.full(len(v), WEIGHTS[n]) for n, v in enumerate(presence.vocabulary, 1)])

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Normalized kernel of each text with each landmark."""
        places, counts, own = self.presence.of(texts)
        out = np.zeros((len(texts), self.count))
        held = self.starts[places + 1] - self.starts[places]
        upto = np.append(0, np.cumsum(held))
        ends = np.cumsum(counts)
        sizes = upto[ends] - upto[ends - counts]
        for a, b in _blocks(sizes):
            part = slice(ends[a] - counts[a], ends[b - 1])
            n = held[part]
            at = np.repeat(self.starts[places[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row = np.repeat(np.repeat(np.arange(b - a), counts[a:b]), n)
            shared = np.bincount(row * self.count + self.marks[at], np.repeat(self.weight[places[part]], n), (b - a) * self.count)
            out[a:b] = shared.reshape(b - a, self.count)
        return out / np.sqrt(np.maximum(own, 1e-12))[:, None] / np.sqrt(np.maximum(self.own, 1e-12))[None, :]

    def folded(self, values: np.ndarray) -> np.ndarray:
        """Of each n-gram its weight times the sum of ``values`` over the landmarks that have it."""
        out = np.zeros((self.presence.size, values.shape[1]))
        scaled = values / np.sqrt(np.maximum(self.own, 1e-12))[:, None]
        gram = np.repeat(np.arange(self.presence.size), np.diff(self.starts))
        for k in range(values.shape[1]):
            out[:, k] = np.bincount(gram, scaled[self.marks, k], self.presence.size)
        return out * self.weight[:, None]


def fit(texts: list[str], languages: list[str], seed: int = 3) -> dict:
    """Landmarks, Nystroem features and one-versus-rest kernel ridge regression, folded into one matrix."""
    names = sorted(set(languages))
    number = {name: k for k, name in enumerate(names)}
    label = np.array([number[x] for x in languages])
    order = np.random.default_rng(seed).permutation(len(texts))
    each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(names)))
    marks = np.concatenate([order[label[order] == k][:each] for k in range(min(len(names), MOST_LANDMARKS))])
    landmark_grams = [grams(texts[i]) for i in marks]
    vocabulary = [np.unique(np.concatenate([g[n] for g in landmark_grams])) for n in range(LONGEST)]
    landmarks = Landmarks(Presence(vocabulary), [texts[i] for i in marks])
    kernel = landmarks.kernel([texts[i] for i in marks])
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    kept = values > 1e-8 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])  # Nystroem: kernel with the landmarks to features
    features = np.vstack([landmarks.kernel(texts[i : i + 256]) for i in range(0, len(texts), 256)]) @ whiten
    features = np.hstack([features, np.ones((len(texts), 1))])
    target = (label[:, None] == np.arange(len(names))[None, :]).astype(float)
    # every language counts alike, whatever its share of the sample
    share = 1.0 / np.bincount(label)[label]
    gram = (features * share[:, None]).T @ features / len(names)
    solved = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), (features * share[:, None]).T @ target / len(names))
    return {"names": names, "vocabulary": vocabulary, "weights": landmarks.folded(whiten @ solved[:-1]), "offset": solved[-1]}


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b[[has_letter(t) for t in b["text"]]] for b in batches if len(b)]
    if any(map(len, parts)):
        rows = pd.concat(parts, ignore_index=True).sort_values(["label", "id", "text"])
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows["text"].tolist(), rows["label"].tolist()))]})


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """A model of up to PER_LANGUAGE distinct rows of each language for which ``learn`` holds; None without any."""
    rows = docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    sample = balanced_sample(rows.where(F.col("text").isNotNull()), PER_LANGUAGE, MOST_ROWS)
    found = sample.repartition(1).mapInPandas(_train, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def _predictor(model: dict | None, column: int, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence(model["vocabulary"]) if model else None
        for batch in batches:
            for rows in text_slices(batch, column=column):
                texts = rows.column(column).to_pylist()
                found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                there = [i for i, t in enumerate(texts) if has_letter(t)]
                if model and there:
                    values = presence.product([texts[i] for i in there], model["weights"]) + model["offset"]
                    for i, k, v in zip(there, values.argmax(axis=1).tolist(), values.max(axis=1).tolist()):
                        found[i], scores[i] = model["names"][k], min(1.0, max(0.0, v))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*rows.schema.names, *names]
                )

    return run


def predict(docs: DataFrame, model: dict | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs``, then the predicted language and its score under ``names``, which replace columns of these names."""
    docs = docs.drop(*names)
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return docs.mapInArrow(lean(_predictor(model, docs.columns.index(text_col), names)), schema)


def identify(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: dict | None = None
) -> DataFrame:
    """Predict the language of every whole text.

    Trained on rows that are not ``held_out`` and have a language; without any, or for a text that
    is null or has no letter, the answer is ``und`` with score 0.  Rows with a null id are predicted,
    never trained on; every row of the input gives one row.  Returns doc_id, held_out, lang_pred,
    score (the regression's value for the predicted language, cut to 0..1).
    """
    if model is None:
        model = train(docs, F.coalesce(~held_out, F.lit(False)), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
