"""URL filter: rules on hosts and path prefixes behind a blocked Bloom filter.

Every URL yields the (host suffix, path prefix) keys that a rule could have.  A blocked
Bloom filter of the listed keys (one 512-bit block a key, one bit in each of its eight words)
drops nearly all of them inside the scan; what passes goes through a hash join with the
rules, which removes the false positives.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discern.llm.common import lower_ascii

WORDS = 8
#: The filter is at most 2**14 blocks (1 MB), so its size is bounded whatever the list's.
MOST_BLOCKS = 1 << 14
KEYS_PER_BLOCK = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Canonical host and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + F.lit(1), F.length(rest))
    return lower_ascii(host), F.regexp_extract(after, r"^[^?#]*", 0)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _block(host: Column, path: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(blocks)).cast("int")


def _bits(host: Column, path: Column) -> list[Column]:
    """One bit for each word of the key's block."""
    second = F.xxhash64(path, host, F.lit(1))
    return [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(WORDS)
    ]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """One row: the filter of ``keys(rule_host, rule_path)`` as an array of blocks."""
    host, path = F.col("rule_host"), F.col("rule_path")
    bits = keys.select(_block(host, path, blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(host, path))])
    filled = bits.groupBy("block").agg(F.array(*[F.bit_or(f"w{i}") for i in range(WORDS)]).alias("words"))
    empty = keys.sparkSession.range(blocks).select(
        F.col("id").cast("int").alias("block"), F.array_repeat(F.lit(0).cast("long"), WORDS).alias("words")
    )
    every = filled.unionByName(empty).groupBy("block").agg(F.array(*[F.bit_or(F.col("words")[i]) for i in range(WORDS)]).alias("words"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "words"))), lambda b: b["words"]).alias("bits"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Judge every URL by the longest rule that fits it.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the URL's path
    starts with the rule's.  The longest rule (host and path together) wins, then the longer
    host; of contradicting rules with the same key ``block`` wins.  Rules with a null are ignored.
    A null URL, or one without ``://``, has an empty host and path.  A URL that no rule fits
    gets a null rule and the verdict ``allow``.  Rows are neither dropped nor merged, whatever
    is null or repeated.  Returns ``keep``, host, path, rule, verdict.
    """
    listed = (
        rules.dropna(subset=["host", "path", "verdict"])
        .groupBy(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))  # "block" > "allow"
    )
    # The shapes a rule can have: as many as distinct (labels, path length), never as rules.
    shapes = listed.groupBy(_labels(F.col("rule_host")).alias("labels"), F.length("rule_path").alias("chars")).count().collect()
    blocks = min(MOST_BLOCKS, max(1, 1 << (sum(s["count"] for s in shapes) // KEYS_PER_BLOCK).bit_length()))
    host, path = host_and_path(F.col(url))
    parsed = pages.select(*keep, host.alias("_host"), path.alias("_path"))
    if not shapes:
        return parsed.select(
            *keep, F.col("_host").alias("host"), F.col("_path").alias("path"),
            F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"),
        )
    host, path = F.col("_host"), F.col("_path")
    bits = bloom(listed, blocks).scalar()

    def possible(h: Column, p: Column) -> Column:
        words = F.element_at(bits, _block(h, p, blocks) + 1)
        hit = F.lit(True)
        for i, bit in enumerate(_bits(h, p)):
            hit = hit & (words[i].bitwiseAND(bit) != 0)
        return hit

    candidates = []
    for s in shapes:
        h, p = F.substring_index(host, ".", -s["labels"]), F.left(path, F.lit(s["chars"]))
        there = (_labels(host) >= s["labels"]) & (F.length(path) >= s["chars"])
        candidates.append(F.when(there & possible(h, p), F.struct(h.alias("h"), p.alias("p"))))
    urls = parsed.select("_host", "_path").distinct()
    hits = urls.select("_host", "_path", F.explode(F.array_compact(F.array(*candidates))).alias("key"))
    length = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    fits = (
        hits.join(listed, (F.col("key.h") == F.col("rule_host")) & (F.col("key.p") == F.col("rule_path")))
        .groupBy("_host", "_path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), length).alias("best"))
    )
    return parsed.join(fits, ["_host", "_path"], "left").select(
        *keep,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit("allow")).alias("verdict"),
    )
