"""Near-duplicate documents by b-bit MinHash.

Texts with the same words are one class and are compared once.  A class representative has
``HASHES`` minima over its word shingles: groups of them make band keys, and the low bits of each
are packed into three integers.  Within a band's bucket everybody is first compared with one
member; a pair goes on if its similarity, estimated from the packed bits by bit counts and
corrected for chance agreement, is near the threshold, and is then confirmed on full shingle sets.
Buckets whose members are not all connected by then get a second member.  What still is not
connected is filed again under its rarest shingles, as many as a link must share one of (prefix
filter).  Shingles that no other open text has bound the similarity of any pair, so copies with many
changes of their own are ruled out by counting.  Each key is compared with the text that has the
fewest such shingles, and only what can still be a link between components is compared in pairs: each
pair under the first key that both have, and only if counts and a longer signature allow a link.
So a large group of copies costs a few comparisons a document, and no link that could join two
components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discern.llm.common import lean, stored, text_slices
from discern.llm.graph import components

HASHES, ROWS, BITS = 96, 4, 2
#: Minima of one bit each that texts get which the buckets leave open, and the least estimate from
#: them of a pair that is looked at: six deviations below 0.8.
WIDE, WIDE_ESTIMATE = 1024, 0.6875
#: A pair is confirmed on its sets if the estimate is at least this: six deviations below 0.8.
ESTIMATE = 0.5
#: Members of a block of a key that several components share.
BLOCK = 1024
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: str | None) -> bytes:
    """The words in lower case (A-Z), one blank between them."""
    return b" ".join((text or "").encode().translate(_LOWER).split())


def shingles(sequences: list[bytes], width: int) -> list[np.ndarray]:
    """Of each word sequence the sorted distinct 64-bit hashes of its shingles.

    With fewer words than ``width`` the whole sequence is one shingle; without words there is none.
    """
    out = [np.zeros(0, np.uint64)] * len(sequences)
    filled = [i for i, s in enumerate(sequences) if s]
    if not filled:
        return out
    joined = np.frombuffer(b" ".join(sequences[i] for i in filled), np.uint8)
    gaps = np.flatnonzero(joined == 0x20)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(joined))
    # a word is the sum of its bytes mixed with their places in it: unlike a polynomial modulo 2**64
    # this gives no two words the same value by their pattern
    place = np.arange(len(joined)) - np.repeat(starts, np.diff(np.append(starts, len(joined))))
    value = (place.astype(np.uint64) << np.uint64(8) | joined) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        value = (value ^ (value >> np.uint64(shift))) * np.uint64(by)
    value ^= value >> np.uint64(31)
    total = np.append(np.uint64(0), np.cumsum(value, dtype=np.uint64))
    word = total[ends] - total[starts] + (ends - starts).astype(np.uint64)
    word = (word ^ (word >> np.uint64(32))) * _MIX
    counts = np.array([sequences[i].count(b" ") + 1 for i in filled])
    first = np.cumsum(counts) - counts
    padded = np.append(word, np.zeros(width, np.uint64))
    run = np.zeros(len(word), np.uint64)
    for k in range(width):
        run = run * np.uint64(0xC6A4A7935BD1E995) + padded[k : k + len(word)]
        run ^= run >> np.uint64(29)
    for i, start, count in zip(filled, first.tolist(), counts.tolist()):
        if count >= width:
            found = np.sort(run[start : start + count - width + 1])
            out[i] = found[np.append(True, found[1:] != found[:-1])]
        else:
            short = np.uint64(count)
            for w in word[start : start + count]:
                short = np.uint64((int(short) * 0xC6A4A7935BD1E995 + int(w)) & 0xFFFFFFFFFFFFFFFF)
                short ^= short >> np.uint64(29)
            out[i] = np.array([short], np.uint64)
    return out


def minima(sets: list[np.ndarray], seed: int = 1, hashes: int = HASHES) -> np.ndarray:
    """``hashes`` minima of each set, none of which is empty."""
    draw = np.random.default_rng(seed).integers(0, 1 << 32, (2, hashes), np.uint32)
    merged = np.concatenate(sets)
    merged = ((merged ^ (merged >> np.uint64(33))) * _MIX >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), hashes), np.uint32)
    for k in range(hashes):
        out[:, k] = np.minimum.reduceat(merged * (draw[0, k] | np.uint32(1)) + draw[1, k], starts)
    return out


def bands_and_bits(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (the band's number is part of the key) and packed low bits of minima."""
    wide = least.astype(np.uint64)
    keys = np.zeros((len(least), HASHES // ROWS), np.uint64)
    for r in range(ROWS):
        keys = (keys + wide[:, r::ROWS] + np.uint64(1)) * np.uint64(0xC6A4A7935BD1E995)
        keys ^= keys >> np.uint64(29)
    keys = (keys + np.arange(HASHES // ROWS, dtype=np.uint64)) * _MIX
    low = (wide * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(61)) & np.uint64((1 << BITS) - 1)
    a_word = 64 // BITS
    packed = np.zeros((len(least), HASHES // a_word), np.uint64)
    for k in range(HASHES):
        packed[:, k // a_word] |= low[:, k] << np.uint64(BITS * (k % a_word))
    return keys.view(np.int64), packed.view(np.int64)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 500_000):
                sequences = [words_of(t) for t in rows.column(1).to_pylist()]
                sets = shingles(sequences, width)
                there = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                bits: list = [None] * len(sets)
                if there:
                    keys, packed = bands_and_bits(minima([sets[i] for i in there]))
                    for i, k, b in zip(there, keys, packed):
                        bands[i], bits[i] = k, b
                digest = [hashlib.blake2b(s, digest_size=16).digest() if s else None for s in sequences]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "n_shingles", "bands", "bits"],
                )

    return run


def _wide_bits(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 200_000):
                sets = shingles([words_of(t) for t in rows.column(1).to_pylist()], width)
                least = minima(sets, 2, WIDE)
                bits = (least * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8)
                packed = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(list(packed), pa.list_(pa.int64()))], names=["id", "wide"])

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 500_000):
                sets = shingles([words_of(t) for t in rows.column(1).to_pylist()], width)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _grams(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 200_000):
                sets = shingles([words_of(t) for t in rows.column(1).to_pylist()], width)
                sizes = np.array([len(s) for s in sets], np.int64)
                ids = np.repeat(rows.column(0).to_numpy(zero_copy_only=False), sizes)
                flat = np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat), pa.array(np.repeat(sizes, sizes))], names=["id", "gram", "n"])

    return run


def rarest_shingles(grams: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """``grams(id, gram, n)`` to (id, n, common, bucket): each set's prefix in the order of frequency.

    Two linked sets share one of the first size - needed + 1 shingles of each, needed being the
    least overlap of a link; shingles of one set only are counted but not returned.  ``common`` has
    the frequency of the others.
    """
    found = grams.join(common, "gram", "left").withColumn("f", F.coalesce("f", F.lit(1)))
    own = Window.partitionBy("id")
    found = found.withColumn("place", F.row_number().over(own.orderBy("f", "gram"))).withColumn("common", F.sum((F.col("f") > 1).cast("long")).over(own))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return found.where((F.col("f") > 1) & (F.col("place") <= prefix)).select("id", "n", "common", F.col("gram").alias("bucket"))


def estimate(left: Column, right: Column) -> Column:
    """Similarity from packed bits: the share of equal slots, corrected for chance agreement."""
    differ = F.lit(0)
    for w in range(HASHES * BITS // 64):
        x = left[w].bitwiseXOR(right[w])
        any_bit = x
        for b in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, b))
        slots = sum(1 << (BITS * k) for k in range(64 // BITS))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(slots)))
    chance = 2.0**-BITS
    return ((1 - differ / F.lit(float(HASHES))) - chance) / (1 - chance)


def wide_estimate(left: Column, right: Column) -> Column:
    """Similarity from one bit of each of ``WIDE`` minima: half of the slots agree by chance."""
    differ = F.lit(0)
    for w in range(WIDE // 64):
        differ = differ + F.bit_count(left[w].bitwiseXOR(right[w]))
    return 1 - 2 * differ / F.lit(float(WIDE))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Words are runs without ASCII white space, A-Z in lower case.  Null, empty and blank texts have
    no shingles and are linked with nothing.  Every row of the input gives one row.  Repeated rows
    are copies with one id, and all of them get the same answer; an id on different texts is not
    checked for.  Without an id a row is part of the component of its copies, if any of them has an
    id, and is then not kept; else it has a null component and is kept.  Returns doc_id,
    n_shingles, component_id, kept.
    """
    kept = stored(docs.sparkSession, "minhash")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = kept.keep_texts(
        rows.mapInArrow(lean(_signatures(width)), "doc_id long, key binary, n_shingles long, bands array<long>, bits array<long>"), "signed"
    )
    classes = kept.keep(signed.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL"), "classes")
    first = signed.join(classes.withColumnRenamed("key", "_key"), (F.col("doc_id") == F.col("id")) & (F.col("key") == F.col("_key")), "left_semi")
    first = first.select(F.col("doc_id").alias("id"), "bits", "bands")
    exploded = first.select("id", "bits", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = kept.keep(exploded.join(shared, "band"), "members")
    links, labels = None, None

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Of the pairs (x, y) those that are links on their full shingle sets."""
        pairs = kept.keep(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"pairs-{name}")
        # as a table its size is known: where it is small enough to be broadcast, no text is shuffled
        wanted = kept.keep(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"wanted-{name}")
        sets = kept.keep_texts(rows.join(wanted, "doc_id").mapInArrow(lean(_full_sets(width)), "id long, set binary"), f"sets-{name}")
        with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        both = with_b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b")
        found = kept.keep(both.mapInArrow(lean(_confirm(percent)), "a long, b long"), f"links-{name}")
        kept.drop(f"sets-{name}", f"pairs-{name}", f"wanted-{name}")
        return found

    def unconnected() -> DataFrame:
        """Members of the buckets that hold more than one component, with their component."""
        if labels is None:
            return members.withColumn("label", F.col("id"))
        now = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        now = kept.keep(now, "labelled")
        open_ = now.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        return now.join(open_.select("band"), "band")

    for turn in range(2):
        open_ = kept.keep(unconnected(), f"open-{turn}")
        chosen = open_.groupBy("band").agg(
            F.min_by(F.struct("id", "bits", "label"), F.xxhash64(F.lit(turn), "id") if turn else F.col("id")).alias("c")
        )
        pairs = open_.join(chosen, "band").where(
            (F.col("label") != F.col("c.label")) & (estimate(F.col("bits"), F.col("c.bits")) >= ESTIMATE)
        )
        more = confirmed(pairs.select(F.col("id").alias("x"), F.col("c.id").alias("y")), f"star-{turn}")
        links = more if links is None else links.unionByName(more)
        labels = components(links, kept, f"components-{turn}")
        if turn:
            kept.drop("labelled")
        kept.drop(f"open-{turn}")
    # What is left is filed under its rarest shingles.
    open_ = kept.keep(unconnected().select(F.col("id").alias("doc_id")).distinct(), "open")
    grams = kept.keep_texts(rows.join(open_, "doc_id").mapInArrow(lean(_grams(width)), "id long, gram long, n long").distinct(), "grams")
    wide = rows.join(open_, "doc_id").mapInArrow(lean(_wide_bits(width)), "id long, wide array<long>").dropDuplicates(["id"])
    wide = kept.keep_texts(wide, "wide")
    kept.drop("labelled", "members")
    common = kept.keep(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "common")
    # a text carries all its keys, so that a pair is made under the first one that both have
    filed = rarest_shingles(grams, common, percent).groupBy("id", "n", "common").agg(F.array_sort(F.collect_list("bucket")).alias("keys"))
    filed = kept.keep(filed.join(wide, "id"), "filed")
    kept.drop("grams", "common", "wide")

    def possible(x: str, y: str) -> Column:
        """The labels differ, the common shingles suffice for a link, and the estimate does."""
        most = F.least(F.col(f"{x}.common"), F.col(f"{y}.common"))
        enough = 100 * most >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n") - most)
        return (F.col(f"{x}.label") != F.col(f"{y}.label")) & enough & (wide_estimate(F.col(f"{x}.wide"), F.col(f"{y}.wide")) >= WIDE_ESTIMATE)

    def mixed(name: str, earlier: bool) -> DataFrame:
        """The keys that hold more than one component: (bucket, row of a member, members).

        With ``earlier`` a member's row has those of its keys that come before this one.
        """
        now = filed.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        now = kept.keep(now, f"{name}-now")
        by_key = now.select("id", "label", F.explode("keys").alias("bucket"))
        both = by_key.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
        members = by_key.select("id", "bucket").join(both.select("bucket", "size"), "bucket").join(now if earlier else now.drop("keys"), "id")
        carried = ["id", "n", "common", "wide", "label"]
        if earlier:
            members = members.withColumn("earlier", F.filter("keys", lambda k: k < F.col("bucket")))
            carried.append("earlier")
        return kept.keep(members.select("bucket", F.struct(*carried).alias("x"), "size"), name)

    open_ = mixed("mixed", False)
    purest = F.struct(F.col("x.common") / F.col("x.n"), -F.col("x.id"))
    pairs = open_.join(open_.groupBy("bucket").agg(F.max_by("x", purest).alias("y")), "bucket").where(possible("x", "y"))
    links = links.unionByName(confirmed(pairs.select("x.id", "y.id").toDF("x", "y"), "purest"))
    labels = components(links, kept, "components-purest")
    # What may still be a link between components, in blocks of the members of a key.
    open_ = mixed("rest", True).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    open_ = open_.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "x.id"), F.col("blocks")).cast("int"))
    left = open_.select("bucket", "x", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = open_.select("bucket", F.col("x").alias("y"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))
    once = ~F.arrays_overlap("x.earlier", "y.earlier")
    rest = left.join(right, ["bucket", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("x.id") < F.col("y.id"))) & possible("x", "y") & once)
    rest = rest.select("x.id", "y.id").toDF("x", "y")
    links = links.unionByName(confirmed(rest, "pairs"))
    labels = components(links, kept, "components")
    whole = classes.join(labels, classes["id"] == labels["node"], "left").select("key", F.coalesce("label", "id").alias("component"))
    whole = kept.keep(whole, "whole")
    answer = signed.select("doc_id", "n_shingles", "key").join(whole, "key", "left")
    component = F.coalesce("component", F.when(F.col("n_shingles") == 0, F.col("doc_id")))
    return answer.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.col("doc_id").isNull() & component.isNull(), F.lit(False)).alias("kept"),
    )
