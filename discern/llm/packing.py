"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Words repeat, so each task finds the tokenizer's word pieces with array operations and has the
tokenizer encode each distinct piece once.  Only (id, piece, length) rows are then dealt into
packing shards of a fixed size.  A shard fills bins greedily, the largest that fits first, and
then replaces a bin's smallest document with two unpacked ones that fill its expanded gap better.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discern.llm.common import give_back, lean, per_worker, stored, text_slices

END_ID = 2
#: Pieces of a packing shard: large enough to waste next to nothing, small enough for one task.
SHARD_PIECES = 8192
#: Distinct word pieces a worker remembers.
REMEMBERED = 200_000
#: Bytes of text encoded at once; the arrays take about a hundred times as much.
SLICE_BYTES = 125_000

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: The characters with Unicode's White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    """White space, letter, number or other, for each code point."""
    import unicodedata

    first = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((first.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[_WHITE] = _SPACE
    return table


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next free one."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


def word_starts(code: np.ndarray, begins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the byte-level tokenizer's words start, in texts laid end to end from ``begins``.

    A word is a run of letters, numbers or other characters with one blank before it, or an
    English contraction, or white space up to the last one before a word.
    """
    kind, n = classes[code], len(code)
    first = np.zeros(n + 3, bool)
    first[begins] = True
    first[n:] = True
    start = first[: n + 3].copy()
    start[1:n] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n])
    start[last] = True
    start[last[code[last] == 0x20] + 1] = False
    quote = np.flatnonzero((code == 0x27) & start[:n])
    padded, letter = np.append(code, np.zeros(3, code.dtype)), np.append(kind == _LETTER, [False] * 3)
    quote = quote[letter[quote + 1] & ~first[quote + 1]]
    one = np.isin(padded[quote + 1], [ord(c) for c in "stmd"])
    pair = padded[quote + 1].astype(np.int64) * 0x110000 + padded[quote + 2]
    two = np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")]) & ~first[quote + 2]
    start[quote[one] + 1] = False
    start[quote[one] + 2] = True
    start[quote[two] + 1] = False
    start[quote[two] + 3] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Token ids of whole texts, each distinct word encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.classes = _classes()
        self._forget()
        give_back()  # the parsed file

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        tokenize, letters = self.model.tokenize, self.letters
        found = [[t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]
        self.flat = np.append(self.flat, np.array([i for ids in found for i in ids], np.int32))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(ids) for ids in found], dtype=np.int64))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
            elif text:
                plain.append(i)
        if not plain:
            return out
        joined = "".join(texts[i] for i in plain)
        code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(texts[i]) for i in plain])
        starts = word_starts(code, np.append(0, ends[:-1]), self.classes)
        lengths = np.diff(np.append(starts, len(code)))
        # the sum of a word's characters mixed with their places: no pattern gives two words one value
        place = np.arange(len(code)) - np.repeat(starts, lengths)
        mixed = (place.astype(np.uint64) << np.uint64(21) | code) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(by)
        mixed ^= mixed >> np.uint64(31)
        total = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
        hashes = total[starts + lengths] - total[starts]
        hashes ^= (hashes >> np.uint64(31)) + lengths.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        codes, distinct = pd.factorize(hashes)
        if len(self.known) + len(distinct) > REMEMBERED:
            self._forget()
        at = np.zeros(len(distinct), np.int64)
        at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # of each word, its first place
        new, slots = [], []
        for k, h in enumerate(distinct.tolist()):
            slot = self.known.get(h)
            if slot is None:
                slot = self.known[h] = len(self.known)
                new.append(k)
            slots.append(slot)
        self._learn([joined[s : s + n] for s, n in zip(starts[at[new]].tolist(), lengths[at[new]].tolist())])
        slot = np.array(slots, np.int64)[codes]
        sizes = np.diff(self.ends)[slot]
        stops = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.ends[slot] - (stops - sizes), sizes) + np.arange(stops[-1])]
        bounds = np.append(0, stops)[np.searchsorted(starts, np.append(0, ends))]
        for i, a, b in zip(plain, bounds[:-1].tolist(), bounds[1:].tolist()):
            out[i] = ids[a:b]
        return out


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, the first may be shorter."""
    first = length % size or size
    if length <= size:
        return [(0, length)] if length else []
    return [(0, first), *((s, size) for s in range(first, length, size))]


def _pieces(path: str, size: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(f"encoder {path}", lambda: Encoder(path))
        for batch in batches:
            for rows in text_slices(batch, SLICE_BYTES):
                out: list[list] = [[], [], [], [], []]
                texts = [t or "" for t in rows.column(1).to_pylist()]
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode(texts)):
                    raw = np.append(ids, np.int32(end_id)).astype("<u4").tobytes()
                    for k, (start, length) in enumerate(cut(len(ids) + 1, size)):
                        for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def best_two_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of lengths, each at most ``size`` in sum.  Lengths are between 1 and ``size``."""
    have, mask, bins = [0] * (size + 1), 0, []

    def largest(most: int) -> int:
        return (mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def take(x: int) -> None:
        nonlocal mask
        have[x] -= 1
        if not have[x]:
            mask ^= 1 << x

    for x in lengths:
        have[x] += 1
        mask |= 1 << x
    while mask:
        free, own = size, []
        while (x := largest(free)) > 0:
            # as many as fit, at once
            count = min(have[x], free // x)
            own += [x] * count
            free -= x * count
            have[x] -= count - 1
            take(x)
        if free and mask:
            small = own[-1]
            room, best, pair = free + small, small, None
            a = largest(room - 1)
            while a > 0 and 2 * a > best and best < room:
                b = largest(min(room - a, a))
                if b == a and have[a] < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = largest(a - 1)
            if pair:
                own.pop()
                have[small] += 1
                mask |= 1 << small
                for x in pair:
                    take(x)
                    own.append(x)
        bins.append(own)
    return bins


def _pack_shard(size: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows["length"].to_pylist()
        waiting: dict[int, list[int]] = defaultdict(list)
        for i in range(len(lengths) - 1, -1, -1):
            waiting[lengths[i]].append(i)
        base = rows["shard"][0].as_py() << 32
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for k, own in enumerate(best_two_fit(lengths, size)):
            place = 0
            for x in own:
                i = waiting[x].pop()
                sequence[i], offset[i] = base + k, place
                place += x
        kept = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def tokenized_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's tokens and the end id, cut into pieces of at most ``size``."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lean(_pieces(tokenizer, size, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, shard_pieces: int = SHARD_PIECES, **columns: object) -> DataFrame:
    """Pack documents into as few sequences of at most ``size`` tokens as the method can.

    A null or empty text is one piece of the end id alone.  Null and repeated ids are ordinary
    rows: every row is packed.  Returns per piece doc_id, piece, start, length, ids_crc32,
    sequence_id and offset.
    """
    kept = stored(docs.sparkSession, "packing")
    pieces = kept.keep_texts(tokenized_pieces(docs, tokenizer, size, **columns), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    # the row's place in the written table takes part, so copies of one row spread over all shards
    place = F.monotonically_increasing_id()
    shard = F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "piece", "ids_crc32", place), F.lit(shards)).cast("long")
    return (
        pieces.withColumn("shard", shard)
        .groupBy("shard")
        .applyInArrow(
            _pack_shard(size),
            "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
        )
    )
