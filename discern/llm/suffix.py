"""Removal of repeated 100-byte strings by suffix arrays.

A string can only repeat where its anchor does: the least of its hashed 24-byte grams.  So the
windows of all documents are split into runs with one anchor, and only runs whose anchor occurs
more than once are looked at.  Runs with equal bytes around the anchor are one context; all but
the first of them are repeats.  The contexts of one anchor are put into one shard; each shard
builds a suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's method, and
finds the windows that several contexts share.  The contexts of a frequent anchor are dealt over
several shards, whose sorted windows are then merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from discern.llm.common import lean, stored, text_slices

WINDOW, GRAM = 100, 24
REACH = WINDOW - GRAM + 1
#: Contexts of one anchor in one shard; bytes of a suffix array, which takes about a hundred times as much memory.
SHARD_CONTEXTS, SHARD_BYTES = 4096, 1 << 20
#: Bytes of text that a task hashes, cuts or joins at once.
SLICE_BYTES = 250_000
#: Repeated ids that are broadcast, the most frequent first; no other is on more than one row in as many.
HOT_IDS = 1000

_MIX = np.uint64(0xC6A4A7935BD1E995)
_BY = 0x9E3779B97F4A7C15


def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM = 16 + 8 bytes from each position, by doubling."""
    h = _letters(1)[data]
    for step in (1, 2, 4):
        h = h[:-step] * _MIX + (h[step:] ^ (h[step:] >> np.uint64(31)))
    eight = h
    sixteen = h[:-8] * _MIX + (h[8:] ^ (h[8:] >> np.uint64(31)))
    n = len(data) - GRAM + 1
    full = sixteen[:n] * _MIX + eight[16 : 16 + n]
    full = (full ^ (full >> np.uint64(32))) * _MIX
    return full ^ (full >> np.uint64(29))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first and last window, anchor's place, anchor's hash, context's hash.

    The anchor of a window is its gram with the least upper hash half, the last of equals.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none, none, none
    value = grams(data)
    place = np.arange(len(value), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    least = (value & ~low) | (low - place)
    for step in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: len(data) - WINDOW + 1], least[REACH - 64 :])
    at = (low - (least & low)).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, np.arange(len(at)), side="right")
    inside = np.arange(len(at)) + WINDOW <= ends[np.minimum(owner, len(ends) - 1)]
    begins = np.flatnonzero(inside & np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
    stops = np.flatnonzero(inside & np.append((at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~inside[1:], True))
    by = np.cumprod(np.full(len(data), _BY, np.uint64), dtype=np.uint64)
    undo = np.cumprod(np.full(len(data), pow(_BY, -1, 1 << 64), np.uint64), dtype=np.uint64)
    total = np.append(np.uint64(0), np.cumsum(_letters(2)[data] * by, dtype=np.uint64))
    context = (total[stops + WINDOW] - total[begins]) * undo[begins]
    context = (context ^ (context >> np.uint64(31))) * _MIX + ((stops - begins) * 128 + at[begins] - begins).astype(np.uint64)
    base = (ends - sizes)[owner[begins]]
    return owner[begins], begins - base, stops - base, at[begins] - begins, value[at[begins]].view(np.int64), context.view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, tie) to the runs of windows: anchor, context, document and the run as one number."""
    for batch in batches:
        for rows in text_slices(batch.filter(batch.column(0).is_valid()), SLICE_BYTES):
            owner, first, last, at, key, context = anchors([(t or "").encode() for t in rows.column(1).to_pylist()])
            ids, ties = (rows.column(c).to_numpy(zero_copy_only=False)[owner] for c in (0, 2))
            packed = (first << 16) | ((last - first) << 8) | at
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(context), pa.array(ids), pa.array(ties), pa.array(packed)], names=["key", "context", "doc_id", "tie", "run"]
            )


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the place of each.

    Larsson-Sadakane: sorted by seven bytes first; then groups of suffixes that agree so far are
    sorted by the rank of the suffix that many bytes on, which doubles the sorted prefix each time.
    Groups of one are finished and are not touched again.
    """
    n = len(data)
    padded = np.append(data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64))  # an end is less than any byte
    prefix = np.zeros(n, np.uint64)
    for k in range(7):
        prefix = (prefix << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(prefix, kind="stable")
    ordered = prefix[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    heads = np.flatnonzero(new)
    rank[order] = heads[np.cumsum(new) - 1]
    open_, step = np.flatnonzero(~(new & np.append(new[1:], True))), 7  # places in the order that are not final
    while len(open_):
        who = order[open_]
        pair = rank[who] * (n + 1) + rank[np.minimum(who + step, n)] + 1
        by = np.argsort(pair, kind="stable")
        order[open_] = who[by]
        pair = pair[by]
        fresh = np.append(True, pair[1:] != pair[:-1])
        rank[order[open_]] = open_[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    place = rank[:n]
    return order, place


def common_prefixes(data: np.ndarray, order: np.ndarray, place: np.ndarray, most: int, lane: int = 128) -> np.ndarray:
    """Kasai's method: of each suffix in order, the bytes it shares with the one before, up to ``most``.

    From one text position to the next the common prefix shrinks by at most one byte.  The text is
    walked in many lanes at once, each of ``lane`` positions.
    """
    n = len(data)
    before = np.where(place > 0, order[place - 1], n)
    ended = np.append(data.astype(np.int16), np.full(most + 1, -1, np.int16))
    other = np.append(data.astype(np.int16), np.full(most + 1, -2, np.int16))
    shared = np.zeros(n, np.int16)
    starts = np.arange(0, n, lane)
    length = np.zeros(len(starts), np.int64)
    for k in range(lane):
        at = starts + k
        going = np.flatnonzero(at < n)
        at = at[going]
        now = np.maximum(length[going] - 1, 0)
        prior, left = before[at], np.arange(len(at))
        while len(left):
            here = now[left]
            # either end of the text differs from everything
            more = (here < most) & (ended[np.minimum(at[left] + here, n)] == other[np.minimum(prior[left] + here, n)])
            left = left[more]
            now[left] += 1
        length[going] = now
        shared[at] = now
    return shared[order]


def shared_windows(contexts: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the contexts in sorted order: context, place in it, and the number of its class of equals."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    order, place = suffix_array(data)
    shared = common_prefixes(data, order, place, WINDOW)
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    is_window = np.zeros(len(data), bool)
    owner = np.repeat(np.arange(len(contexts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    is_window[begin[owner] + inside] = True
    which = np.full(len(data), -1, np.int64)
    which[begin[owner] + inside] = np.arange(len(owner))
    chosen = np.flatnonzero(is_window[order])
    # neighbours among the windows share the least of the common prefixes between them
    least = np.minimum.reduceat(np.append(shared, 0), chosen + 1)
    joined = np.append(False, least[:-1] >= WINDOW)
    group = np.cumsum(~joined) - 1
    number = which[order[chosen]]
    return owner[number], inside[number], group


def _intervals(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as (document, first, last) of consecutive starts."""
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    keep = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])) if len(doc) else np.zeros(0, bool)
    doc, start = doc[keep], start[keep]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)) if len(doc) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    return doc[heads], start[heads], start[np.append(heads[1:], len(doc)) - 1] if len(heads) else start


_JUDGED = "doc_id long, tie long, first long, last long, key long, part long, windows binary, docs binary, ties binary, starts binary"
_FOUND = "doc_id long, tie long, first long, last long"


def _numbered(doc: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each document in the order of (id, tie), and the id and tie of each number."""
    by = np.lexsort((tie, doc))
    new = np.append(True, (doc[by][1:] != doc[by][:-1]) | (tie[by][1:] != tie[by][:-1])) if len(by) else np.zeros(0, bool)
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(new) - 1
    return number, doc[by][new], tie[by][new]


def _judged(doc, tie, first, last) -> pa.RecordBatch:
    n = len(doc)
    blank = [pa.nulls(n, pa.int64())] * 2 + [pa.nulls(n, pa.binary())] * 4
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in (doc, tie, first, last)), *blank],
        names=["doc_id", "tie", "first", "last", "key", "part", "windows", "docs", "ties", "starts"],
    )


def _judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """One shard: later occurrences as intervals, and sorted windows of the anchors dealt over several shards."""
    contexts = [b.as_buffer().to_pybytes() for chunk in rows["bytes"].chunks for b in chunk]
    key, doc, tie, start, shards = (rows[c].to_numpy() for c in ("key", "doc_id", "tie", "start", "shards"))
    doc, ids, ties = _numbered(doc, tie)
    counts = np.array([len(c) for c in contexts], np.int64) - WINDOW + 1
    owner, inside, group = shared_windows(contexts, counts)
    window_doc, window_start = doc[owner], start[owner] + inside
    by = np.lexsort((window_start, window_doc, group))
    first = np.append(True, group[by][1:] != group[by][:-1])
    late, since, until = _intervals(window_doc[by][~first], window_start[by][~first])
    yield _judged(ids[late], ties[late], since, until)
    lead = np.sort(by[first])  # the first of each class, in the order of the suffixes
    lead = lead[shards[owner[lead]] > 1]
    if not len(lead):
        return
    text = [contexts[o][i : i + WINDOW] for o, i in zip(owner[lead].tolist(), inside[lead].tolist())]
    hashed = np.array([hash_bytes(t) for t in text], np.uint64)
    part = (hashed % shards[owner[lead]].astype(np.uint64)).astype(np.int64)
    lead_key = key[owner[lead]]
    by = np.lexsort((np.arange(len(lead)), part, lead_key))
    cut = np.flatnonzero(np.append(True, (lead_key[by][1:] != lead_key[by][:-1]) | (part[by][1:] != part[by][:-1])))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(by)]):
        own = by[a:b]
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.nulls(1, pa.int64())] * 4,
                pa.array([lead_key[own[0]]], pa.int64()), pa.array([part[own[0]]], pa.int64()),
                pa.array([b"".join(text[i] for i in own)], pa.binary()),
                pa.array([ids[window_doc[lead][own]].astype("<i8").tobytes()], pa.binary()),
                pa.array([ties[window_doc[lead][own]].astype("<i8").tobytes()], pa.binary()),
                pa.array([window_start[lead][own].astype("<i8").tobytes()], pa.binary()),
            ],
            names=["doc_id", "tie", "first", "last", "key", "part", "windows", "docs", "ties", "starts"],
        )


def hash_bytes(text: bytes) -> int:
    import zlib

    return zlib.crc32(text)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of whole (key, shard) groups of up to about SHARD_BYTES; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, shard = batch.column("key").to_numpy(), batch.column("shard").to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (shard[1:] != shard[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            group = batch.slice(a, b - a)
            if held and size >= SHARD_BYTES and (key[a], shard[a]) != last:
                yield from _judge(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(group)
            last, size = (key[a], shard[a]), size + int(pa.compute.sum(pa.compute.binary_length(group.column("bytes"))).as_py())
    if held:
        yield from _judge(pa.Table.from_batches(held))


def merge_sorted(slices: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct windows of several shards with (document, start): those that also occur earlier.

    Each slice is looked up in what has been merged so far by binary search.
    """
    merged, doc, start = slices[0]
    late_doc, late_start = [], []
    for windows, docs, starts in slices[1:]:
        at = np.searchsorted(merged, windows)
        near = np.minimum(at, len(merged) - 1)
        same = merged[near] == windows
        hit, i = near[same], np.flatnonzero(same)
        later = (docs[i] > doc[hit]) | ((docs[i] == doc[hit]) & (starts[i] > start[hit]))
        late_doc += [docs[i[later]], doc[hit[~later]]]
        late_start += [starts[i[later]], start[hit[~later]]]
        doc, start = doc.copy(), start.copy()
        doc[hit[~later]], start[hit[~later]] = docs[i[~later]], starts[i[~later]]
        rest = ~same
        merged = np.insert(merged, at[rest], windows[rest])
        doc, start = np.insert(doc, at[rest], docs[rest]), np.insert(start, at[rest], starts[rest])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(late_doc or none), np.concatenate(late_start or none)


def _merge(rows: pa.Table) -> pa.Table:
    slices, begin = [], 0
    docs, ties = (np.frombuffer(b"".join(rows[c].to_pylist()), "<i8") for c in ("docs", "ties"))
    number, ids, ties = _numbered(docs, ties)
    for w, s in zip(*(rows[c].to_pylist() for c in ("windows", "starts"))):
        # one more byte keeps zero bytes at a window's end
        plain = np.frombuffer(w, np.uint8).reshape(-1, WINDOW)
        ended = np.ascontiguousarray(np.hstack([plain, np.ones((len(plain), 1), np.uint8)])).view(f"S{WINDOW + 1}").ravel()
        by = np.argsort(ended, kind="stable")
        slices.append((ended[by], number[begin : begin + len(by)][by], np.frombuffer(s, "<i8")[by]))
        begin += len(by)
    doc, first, last = _intervals(*merge_sorted(slices))
    return pa.table({n: pa.array(c, pa.int64()) for n, c in (("doc_id", ids[doc]), ("tie", ties[doc]), ("first", first), ("last", last))})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tie, text, wanted runs) to contexts with their bytes."""
    for batch in batches:
        for rows in text_slices(batch, SLICE_BYTES, column=2):
            out: list[list] = [[], [], [], [], [], [], []]
            for doc_id, tie, text, wanted in zip(*(rows.column(i) for i in range(4))):
                raw, doc_id, tie = text.as_py().encode(), doc_id.as_py(), tie.as_py()
                for w in wanted.as_py():
                    first = w["run"] >> 16
                    last = first + (w["run"] >> 8 & 0xFF)
                    for column, value in zip(out, (w["key"], w["shard"], w["shards"], doc_id, tie, first, raw[first : last + WINDOW])):
                        column.append(value)
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=["key", "shard", "shards", "doc_id", "tie", "start", "bytes"]
            )


def _removed(as_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, intervals, carried columns) to the kept bytes and the removed spans."""
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    for rows in (r for batch in batches for r in text_slices(batch, SLICE_BYTES, column=0)):
        sizes, kept, spans = [], [], []
        for text, found in zip(rows.column(0), rows.column(1)):
            raw, own, pieces, at = (text.as_py() or "").encode(), [], [], 0
            for first, last in sorted((f["first"], f["last"]) for f in found.as_py() or ()):
                if own and first <= own[-1]["to"]:
                    own[-1]["to"] = max(own[-1]["to"], last + WINDOW)
                else:
                    own.append({"from": first, "to": last + WINDOW})
            for s in own:
                pieces.append(raw[at : s["from"]])
                at = s["to"]
            sizes.append(len(raw))
            left = b"".join([*pieces, raw[at:]])
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
            spans.append(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(spans, span), *rows.columns[2:]],
            names=["n_bytes", "kept", "removed", *rows.schema.names[2:]],
        )


def _documents(rows: DataFrame, kept: stored) -> tuple[DataFrame, DataFrame | None]:
    """Each (doc_id, text) once with its tie, and the ids that are on different texts, if any.

    The tie orders different texts under one id; it is 0 where an id has one text.
    """
    rows, text = rows.where("doc_id IS NOT NULL"), F.xxhash64(F.coalesce("text", F.lit("")))
    counted = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.min(text) < F.max(text)).alias("differ"))
    repeats = kept.keep(counted.where("n > 1"), "repeats")
    if repeats.isEmpty():
        return rows.withColumn("tie", F.lit(0).cast("long")), None
    # the most frequent ids are found without moving their texts; their copies meet map-side
    hot = kept.keep(repeats.orderBy(F.desc("n"), "doc_id").limit(HOT_IDS), "hot")
    rest = repeats.join(F.broadcast(hot.select("doc_id")), "doc_id", "left_anti")
    again = rows.join(F.broadcast(hot), "doc_id").unionByName(rows.join(rest, "doc_id"))
    again = again.withColumn("tie", F.when(F.col("differ"), text).otherwise(F.lit(0).cast("long")))
    again = again.groupBy("doc_id", "tie").agg(F.first("text").alias("text")).select("doc_id", "text", "tie")
    lone = rows.join(repeats, "doc_id", "left_anti").select("doc_id", "text", F.lit(0).cast("long").alias("tie"))
    several = repeats.where("differ").select("doc_id")
    return kept.keep(lone.unionByName(again), "documents"), None if several.isEmpty() else several


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), as_text: bool = False
) -> DataFrame:
    """Every text without the bytes of 100-byte strings that also start earlier.

    Earlier: in a document with a smaller id, or sooner in the same one; strings are judged on the
    input.  Texts are UTF-8 bytes (null: none), and strings never cross texts.  Rows without id
    have no place in that order: they are left whole and make nothing else a repeat.  Rows with one
    id and text are one document, judged once, whose copies all get its answer; different texts
    under one id follow each other by a hash.  Every row gives one row: n_bytes, kept (the bytes
    that stay), removed (the maximal removed runs as [from, to) in bytes), and the input's columns
    named in ``carry``.
    With ``as_text`` kept is a string; a character that a cut has left incomplete is not in it.
    """
    kept = stored(docs.sparkSession, "suffix")
    rows, several = _documents(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), kept)
    # every text is hashed once; the table is read for the anchors that repeat, then for their runs
    every = kept.keep_texts(rows.mapInArrow(lean(_runs), "key long, context long, doc_id long, tie long, run long"), "every")
    repeated = kept.keep(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    runs = kept.keep(every.join(repeated, "key").select("key", "context", "doc_id", "tie", "run"), "runs")
    kept.drop("every")
    contexts = runs.groupBy("key", "context").agg(F.min(F.struct("doc_id", "tie", "run")).alias("lead"))
    contexts = kept.keep(contexts, "contexts")
    # equal contexts: all but the first repeat with every window
    led = contexts.select("key", "context", "lead")
    same = runs.join(led, ["key", "context"]).where(F.struct("doc_id", "tie", "run") != F.col("lead"))
    first = F.shiftright("run", 16)
    same = same.select("doc_id", "tie", first.alias("first"), (first + F.shiftright("run", 8).bitwiseAND(F.lit(0xFF))).alias("last"))
    # different contexts of one anchor: their bytes go to the suffix arrays
    several_contexts = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several_contexts = several_contexts.select("key", F.ceil(F.col("n") / SHARD_CONTEXTS).cast("long").alias("shards"))
    wanted = contexts.select("key", "context", "lead.*").join(kept.keep(several_contexts, "several"), "key")
    wanted = wanted.withColumn("shard", F.pmod("context", F.col("shards")))
    lists = wanted.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("key", "shard", "shards", "run")).alias("wanted"))
    cut = rows.join(lists, ["doc_id", "tie"]).select("doc_id", "tie", "text", "wanted")
    cut = kept.keep_texts(cut.mapInArrow(lean(_cut), "key long, shard long, shards long, doc_id long, tie long, start long, bytes binary"), "cut")
    dealt = cut.repartition("key", "shard").sortWithinPartitions("key", "shard", "doc_id", "tie", "start")
    judged = kept.keep(dealt.mapInArrow(lean(_shards), _JUDGED), "judged")
    merged = judged.where("key IS NOT NULL").groupBy("key", "part").applyInArrow(_merge, _FOUND)
    found = same.unionByName(judged.where("doc_id IS NOT NULL").select("doc_id", "tie", "first", "last")).unionByName(merged)
    found = found.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    found = kept.keep(found, "found")
    kept.drop("cut", "judged", "runs", "contexts", "keys", *(["documents"] if "documents" in kept.paths else []))
    own = docs.select(F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_id"), *carry)
    tie = F.lit(0).cast("long")
    if several is not None:
        own = own.join(several.select(F.col("doc_id").alias("_several")), F.col("_id") == F.col("_several"), "left")
        tie = F.when(F.col("_several").isNotNull(), F.xxhash64(F.coalesce("_text", F.lit("")))).otherwise(tie)
    found = found.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "found")
    spans = own.withColumn("_tie", tie).join(found, ["_id", "_tie"], "left").select("_text", "found", *carry)
    span = ArrayType(StructType([StructField("from", LongType()), StructField("to", LongType())]))
    made = [StructField("n_bytes", LongType()), StructField("kept", StringType() if as_text else BinaryType()), StructField("removed", span)]
    return spans.mapInArrow(lean(lambda it: _removed(as_text, it)), StructType([*made, *docs.select(*carry).schema.fields]))
