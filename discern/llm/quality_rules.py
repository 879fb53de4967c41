"""Quality rules as a ledger of failure bits.

Every text is measured once and every rule is evaluated once; a ledger row holds the measurements
and one bit for each rule that the text fails.  A policy is a version and the rules it asks for, that
is, a bit mask: whether a document stays is one AND over its stored bits, and what a rule costs
is counted over the few distinct bit patterns, without going back to a text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discern.llm.common import stored, text_slices

#: Whole numbers of a text, in the order of the ledger's columns.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_upper", "n_lower",
)
#: Rules by bit, as SQL over the measurements that is true where a text fails.  New rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines > 4 AND 100 * n_dup_lines > 30 * n_lines"),
    ("few_letter_words", "100 * n_letter_words < 80 * n_words"),
    ("upper_case", "n_upper > n_lower"),
)
BASE = ("few_words", "repeated_words")
#: Rules of each version of the policy.
POLICIES: dict[str, tuple[str, ...]] = {
    "1": (*BASE, "short_words", "long_words"),
    "2": (*BASE, "short_words", "long_words", "symbols", "duplicate_lines"),
    "3": (*BASE, "short_words", "long_words", "symbols", "duplicate_lines", "few_letter_words", "upper_case"),
}
CURRENT = "3"

_SYMBOLS, _UPPER = b"#*$%&|<>", bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_NO_LETTERS = bytes(b for b in range(0x80) if not chr(b).isalpha())


def repeated_words(texts: Sequence[Sequence[bytes]]) -> np.ndarray:
    """Of each text the words that lie in a window of three words which the text has twice or more."""
    counts = np.array([len(words) for words in texts], np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.flatnonzero(owner[:-2] == owner[2:])  # where a window starts
    if not len(at):
        return np.zeros(len(texts), np.int64)
    # windows as exact numbers: two words, then these and a word, then these and the text
    key = ids[at] * len(number) + ids[at + 1]
    for more, size in ((ids[at + 2], len(number)), (owner[at], len(texts))):
        key = np.unique(key, return_inverse=True)[1] * size + more
    _, which, found = np.unique(key, return_inverse=True, return_counts=True)
    again = at[found[which] > 1]
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(owner[covered], minlength=len(texts))


def measure(texts: Sequence[str | None]) -> np.ndarray:
    """The figures named in ``MEASURES`` of whole texts, a row each."""
    found, split = [], []
    for text in texts:
        text = text or ""
        raw = text.encode()
        words = raw.split()  # the six ASCII blanks
        lines = [x for x in raw.split(b"\n") if x.strip()]
        split.append(words)
        found.append((
            len(words),
            len(text) - len(raw) + sum(map(len, words)),  # all code points but the blanks
            len(raw) - len(raw.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)),
            0,
            len(lines),
            sum(1 for w in words if w.translate(None, _NO_LETTERS)),
            len(raw) - len(raw.translate(None, _UPPER)),
            len(raw) - len(raw.translate(None, _LOWER)),
        ))
    out = np.array(found, np.int64).reshape(-1, len(MEASURES))
    out[:, MEASURES.index("n_repeat_words")] = repeated_words(split)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch):
            found = measure(rows.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(found[:, k]) for k in range(len(MEASURES)))], names=["doc_id", *MEASURES])


def mask(names: Sequence[str]) -> int:
    """The bits of the rules named."""
    bits = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    unknown = [n for n in names if n not in bits]
    if unknown:
        raise ValueError(f"unknown rules {unknown}; choose from {list(bits)}")
    return sum(bits[n] for n in set(names))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written ledger: doc_id, the measurements, and fail_bits.

    Every row of ``docs`` gives one row, whatever is null or repeated; a null text has no words.
    """
    kept = stored(docs.sparkSession, "quality-rules")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured = rows.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " + ".join(f"if({rule}, {1 << k}L, 0L)" for k, (_, rule) in enumerate(RULES))
    return kept.keep(measured.withColumn("fail_bits", F.expr(bits)), "ledger")


def failed(policy: Sequence[str], bits: str = "fail_bits") -> Column:
    """Which of the policy's rules a ledger row fails, as bits."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long"))


def apply_policy(entries: DataFrame, version: str = CURRENT, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """Ledger rows with base_failed, kept (by the policy of that version) and only_rule.

    ``base_failed`` stands for the rules in ``BASE``, which no policy lifts.  ``only_rule`` names
    the rule that alone keeps a document out, if there is one: without it the document would stay.
    """
    policy = {*policies[version], *BASE}
    bits = failed(sorted(policy))
    alone = F.when(F.bit_count(bits) == 1, F.element_at(F.array(*[F.lit(n) for n, _ in RULES]), F.length(F.bin(bits))))
    return entries.withColumns({"base_failed": failed(BASE) != 0, "kept": bits == 0, "only_rule": alone})


def ablations(entries: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """What each rule of each policy costs: version, rule, n_docs, n_kept, n_failed, n_only, n_kept_without.

    The ledger is reduced to its distinct bit patterns first, at most two to the number of rules;
    everything else is bitwise arithmetic on these.  ``n_only`` documents fail this rule alone.  An
    empty ledger gives no rows.
    """
    patterns = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    asked = F.array(*[
        F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit"),
                 F.lit(mask([*p, *BASE])).cast("long").alias("mask"))
        for v, p in policies.items() for r in sorted({*p, *BASE})
    ])
    rows = patterns.select("fail_bits", "n", F.inline(asked)).withColumn("bits", F.col("fail_bits").bitwiseAND(F.col("mask")))

    def total(where: Column) -> Column:
        return F.sum(F.when(where, F.col("n")).otherwise(0))

    kept, alone = F.col("bits") == 0, F.col("bits") == F.col("bit")
    return rows.groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"), total(kept).alias("n_kept"), total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(alone).alias("n_only"), total(kept | alone).alias("n_kept_without"),
    )


def quality_rules(docs: DataFrame, version: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measure, judge and mark every document: the ledger under the policy of ``version``.

    Null, empty and blank texts have no words, fail ``few_words`` and are not kept.  Rows with null
    or repeated ids are judged like any other; no row is dropped or merged.
    """
    return apply_policy(ledger(docs, id_col, text_col), version)
