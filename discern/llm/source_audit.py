"""How far each source's words are from its language's and from the other sources'.

The vocabulary of a language is held in minimal acyclic transducers, one for each run of
``SHARD_TERMS`` kept terms in byte order; a term's ordinal in the language is the shard's first one
plus its place in the shard.  A first scan finds the kept terms, a second streams the texts through the
transducers and counts ordinals, and from there on only ordinals are moved, compared and ranked:
their order is the terms' order, so ties need no strings.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discern.llm.common import stored, text_slices
from discern.llm.transducer import Transducer
from discern.operators.ranking import global_row_number

#: Terms of one transducer.
SHARD_TERMS = 1 << 16
#: Transducers of up to this many bytes in all go to every worker; beyond, the words go to them.
MOST_BYTES = 64 << 20
#: Entries of a worker's table of counts before it is emptied.
HELD = 1 << 19
#: Sources times terms of one block of the comparison of sources.
CELLS = 1 << 20
UNIT = 1_000_000_000

# what is no part of a term becomes a blank, A-Z become a-z
_TO_TERMS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, A-Z in lower case."""
    return (text or "").encode().translate(_TO_TERMS).split()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str]]:
    """(lang, source, text) of each row, null as ''."""
    for batch in batches:
        for rows in text_slices(batch, column=2):
            yield from zip(*([x or "" for x in rows.column(c).to_pylist()] for c in range(3)))


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, term, n): in how many texts of the task a term occurs."""
    held: dict[str, Counter] = {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array([t.decode() for t in found], pa.string()), pa.array(found.values(), pa.int64())],
                    names=["lang", "term", "n"],
                )
        held.clear()

    entries = 0
    for lang, _, text in _rows(batches):
        own = held.setdefault(lang, Counter())
        entries -= len(own)
        own.update(set(terms(text)))
        entries += len(own)
        if entries >= HELD:
            yield from emptied()
            entries = 0
    yield from emptied()


def _shard(rows: pa.Table) -> pa.Table:
    """The kept terms of one shard to its transducer."""
    by = np.argsort(rows["ordinal"].to_numpy(), kind="stable").tolist()
    words = rows["term"].to_pylist()
    words = [words[i].encode() for i in by]
    first = int(rows["ordinal"].to_numpy().min())
    return pa.table(
        {"lang": [rows["lang"][0].as_py()], "shard": [rows["shard"][0].as_py()], "first": [first], "low": [words[0]], "blob": [Transducer.build(words).to_bytes()]},
        pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("first", pa.int64()), ("low", pa.binary()), ("blob", pa.binary())]),
    )


class Vocabulary:
    """The transducers of every language: ordinals of words."""

    def __init__(self, shards: list[tuple[str, int, bytes, bytes]]):
        self.by_lang: dict[str, list[tuple[int, bytes, Transducer]]] = {}
        for lang, first, low, blob in sorted(shards):
            self.by_lang.setdefault(lang, []).append((first, low, Transducer.from_bytes(blob)))

    def ordinals(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Of words in byte order the ordinals in the language, -1 for those that are not kept."""
        shards = self.by_lang.get(lang, [])
        out = np.full(len(words), -1, np.int64)
        cuts = [bisect_left(words, low) for _, low, _ in shards] + [len(words)]
        for (first, _, automaton), a, b in zip(shards, cuts, cuts[1:]):
            if a < b:
                place = automaton.ordinals(words[a:b])
                out[a:b] = np.where(place >= 0, place + first, -1)
        return out


class _Held:
    """Counts of (lang, source, ordinal) in a worker, as sorted numbers that are merged now and then."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.group, self.ordinal, self.n = [], [], []
        self.size = 0

    def add(self, group: tuple[str, str], ordinal: np.ndarray, n: np.ndarray) -> None:
        self.group.append(np.full(len(ordinal), self.groups.setdefault(group, len(self.groups)), np.int64))
        self.ordinal.append(ordinal)
        self.n.append(n)
        self.size += len(ordinal)
        if self.size >= 2 * HELD:
            self._merge()

    def _merge(self) -> None:
        group, ordinal, n = (np.concatenate(x) for x in (self.group, self.ordinal, self.n))
        by = np.lexsort((ordinal, group))
        group, ordinal = group[by], ordinal[by]
        heads = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (ordinal[1:] != ordinal[:-1])))
        self.group, self.ordinal, self.n = [group[heads]], [ordinal[heads]], [np.add.reduceat(n[by], heads)]
        self.size = len(heads)

    def emptied(self) -> Iterator[pa.RecordBatch]:
        if self.group:
            self._merge()
            names = list(self.groups)
            lang, source = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
            group = pa.array(self.group[0])
            yield pa.RecordBatch.from_arrays(
                [lang.take(group), source.take(group), pa.array(self.ordinal[0]), pa.array(self.n[0])], names=["lang", "source", "ordinal", "n"]
            )
        self.__init__()


def _recount(shards: list[tuple[str, int, bytes, bytes]]):
    """(lang, source, text) to (lang, source, ordinal, n); ordinal -1 with n 0 stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held = Vocabulary(shards), _Held()
        for lang, source, n, words in _word_counts(batches, lambda group: held.add(group, np.array([-1]), np.array([0]))):
            place = vocabulary.ordinals(lang, words)
            kept = place >= 0
            held.add((lang, source), place[kept], n[kept])
            if held.size >= HELD:
                yield from held.emptied()
        yield from held.emptied()

    return run


def _word_counts(batches: Iterator[pa.RecordBatch], seen) -> Iterator[tuple[str, str, np.ndarray, list[bytes]]]:
    """Of each stretch of about 4 MB of text and each group in it the words in byte order with their counts."""
    held: dict[tuple[str, str], Counter] = {}
    size = 0

    def emptied():
        for (lang, source), found in held.items():
            if found:
                words = sorted(found)
                yield lang, source, np.array([found[w] for w in words], np.int64), words
        held.clear()

    for lang, source, text in _rows(batches):
        if (lang, source) not in held:
            seen((lang, source))
        held.setdefault((lang, source), Counter()).update(terms(text))
        size += len(text)
        if size >= 4_000_000:
            yield from emptied()
            size = 0
    yield from emptied()


def _words_out(bounds: dict[str, list[bytes]]):
    """(lang, source, text) to (lang, source, term, n, shard) for transducers that stay where they are.

    A word's shard is the last whose lowest term is not above it; a word before the first is in none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "shard"]
        fresh: list[tuple[str, str]] = []
        for lang, source, n, words in _word_counts(batches, fresh.append):
            lows = bounds.get(lang, [])
            shard = np.array([bisect_right(lows, w) - 1 for w in words], np.int64)
            kept = np.flatnonzero(shard >= 0)
            k = len(kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array([words[i] for i in kept], pa.binary()),
                 pa.array(n[kept]), pa.array(shard[kept])], names=names)
        for lang, source in sorted(set(fresh)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([source], pa.string()), pa.array([b""], pa.binary()), pa.array([0], pa.int64()),
                 pa.array([-1], pa.int64())], names=names)

    return run


_COUNTS = "lang string, source string, ordinal long, n long"


def _recount_shard(words: pa.Table, shard: pa.Table) -> pa.Table:
    """The words that were dealt to one transducer, counted by ordinal."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("ordinal", pa.int64()), ("n", pa.int64())])
    if not words.num_rows or not shard.num_rows:
        return schema.empty_table()
    place = Transducer.from_bytes(shard["blob"][0].as_py()).ordinals(words["term"].to_pylist())
    kept = pa.array(place >= 0)
    found = pa.table([words["lang"], words["source"], pa.array(place + shard["first"][0].as_py()), words["n"]], schema=schema)
    return found.filter(kept)


def share(name: str, count: str, total: str, size: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + size)), exact, as ``name``."""
    return F.expr(f"1L + (cast({UNIT} AS decimal(12,0)) * cast({count} + 1 AS decimal(20,0))) div cast({total} + {size} AS decimal(20,0))").alias(name)


def _compare(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """One block of a language's ordinals: of each two sources the sum of f over the block's terms."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    names = groups["source"].to_pylist()
    if not names:
        return schema.empty_table()
    lang, width = groups["lang"][0].as_py(), groups["width"][0].as_py()
    number = {s: i for i, s in enumerate(names)}
    total = groups["total"].to_numpy()
    n = np.zeros((len(names), width), np.int64)
    if counts.num_rows:
        place = counts["ordinal"].to_numpy() - groups["low"][0].as_py()
        n[[number[s] for s in counts["source"].to_pylist()], place] = counts["n"].to_numpy()
    if n.max(initial=0) < (1 << 62) // UNIT:
        p = 1 + UNIT * (n + 1) // total[:, None]
    else:  # products beyond 64 bits
        p = (1 + UNIT * (n.astype(object) + 1) // total[:, None].astype(object)).astype(np.int64)
    a, b, value = [], [], []
    for i in range(len(names)):
        apart = p[i] - p
        sums = (apart * apart // p).sum(axis=1)
        a += [names[i]] * (len(names) - 1)
        b += names[:i] + names[i + 1 :]
        value.append(np.delete(sums, i))
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(np.concatenate(value))], schema=schema)


def source_audit(
    docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    shard_terms: int = SHARD_TERMS, most_bytes: int = MOST_BYTES, cells: int = CELLS,
) -> DataFrame:
    """Divergence of sources from each other (part ``pair``) and their terms from the language (part ``term``).

    Null text, lang and source count as ''.  A language keeps the terms that are in at least
    ``least_docs`` of its rows; repeated rows count as often as they occur, ids play no part.  A
    group is a (lang, source) that occurs.  With count occurrences of a kept term, N of all kept
    terms and V kept terms, p = 1 + floor(10**9 (count + 1) / (N + V)), and f = floor((p - q)**2 / q).
    ``pair``: for each other source of the language the sum of f, q being its p; 0 if V is 0.
    ``term``: the ``top`` highest f of terms that the group has and that are above the language's q.
    Ties go by the item's bytes.  An empty table gives no rows.  Returns lang, source, part, item,
    value, rank.
    """
    spark = docs.sparkSession
    kept = stored(spark, "source-audit")
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    # first scan: the vocabulary, in byte order
    found = rows.mapInArrow(_document_terms, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    found = kept.keep(found.where(F.col("n") >= least_docs).select("lang", "term"), "found")
    placed = kept.keep(global_row_number(found, [F.col("lang"), F.col("term")], "place").select("lang", "term", "place"), "placed")
    langs = placed.groupBy("lang").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("size"))
    langs = kept.keep(langs, "langs")
    named = placed.join(langs, "lang").select("lang", "term", (F.col("place") - F.col("start")).alias("ordinal"))
    named = kept.keep(named, "terms")
    kept.drop("found", "placed")
    sharded = named.withColumn("shard", F.expr(f"ordinal div {shard_terms}"))
    shards = sharded.groupBy("lang", "shard").applyInArrow(lambda t: _shard(t), "lang string, shard long, first long, low binary, blob binary")
    shards = kept.keep(shards, "shards")
    # second scan: texts through the transducers
    size = shards.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    if size <= most_bytes:
        held = [tuple(map(_plain, r)) for r in shards.select("lang", "first", "low", "blob").collect()]
        counted = rows.mapInArrow(_recount(held), _COUNTS)
    else:
        # one row for each shard_terms terms reaches the driver
        bounds: dict[str, list[bytes]] = {}
        for r in shards.select("lang", "shard", "low").orderBy("lang", "shard").collect():
            bounds.setdefault(r["lang"], []).append(bytes(r["low"]))
        words = rows.mapInArrow(_words_out(bounds), "lang string, source string, term binary, n long, shard long")
        words = kept.keep(words.groupBy("lang", "source", "term", "shard").agg(F.sum("n").alias("n")), "words")
        dealt = words.where("shard >= 0").groupBy("lang", "shard").cogroup(shards.groupBy("lang", "shard"))
        counted = dealt.applyInArrow(lambda w, s: _recount_shard(w, s), _COUNTS)
        counted = counted.unionByName(words.where("shard < 0").selectExpr("lang", "source", "-1L AS ordinal", "0L AS n"))
    counts = kept.keep(counted.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "counts")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"lang_total": F.sum("total").over(of_lang), "sources": F.count(F.lit(1)).over(of_lang)})
    groups = groups.join(langs.select("lang", "size"), "lang", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    groups = kept.keep(groups, "groups")
    counts = counts.where("ordinal >= 0")
    # terms of a group above the language
    both = counts.withColumn("in_lang", F.sum("n").over(Window.partitionBy("lang", "ordinal")))
    both = both.join(groups, ["lang", "source"]).select("lang", "source", "ordinal", share("p", "n", "total", "size"), share("q", "in_lang", "lang_total", "size"))
    both = both.where("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", "source", "ordinal", "value", "rank")
    by_term = ranked.join(named, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    # sources against each other, a block of ordinals at a time
    blocks = groups.withColumn("wide", F.expr(f"greatest(1L, {cells} div sources)"))
    dealt = counts.join(blocks.select("lang", "source", "wide"), ["lang", "source"])
    dealt = dealt.select("lang", F.expr("ordinal div wide").alias("block"), "source", "ordinal", "n")
    sides = blocks.where("size > 0").select(
        "lang", "source", (F.col("total") + F.col("size")).alias("total"), "size", "wide", F.explode(F.expr("sequence(0L, (size - 1) div wide)")).alias("block")
    )
    sides = sides.select("lang", "source", "total", "block", (F.col("block") * F.col("wide")).alias("low"), F.expr("least(wide, size - block * wide)").alias("width"))
    sums = dealt.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block"))
    sums = sums.applyInArrow(lambda c, g: _compare(c, g), "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.where("size = 0").select("lang", "source").join(other, "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.unionByName(pairs).withColumn("rank", F.row_number().over(order))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(by_term)


def _plain(value):
    return bytes(value) if isinstance(value, bytearray) else value
