"""Hashes of a row's id.

A bucket depends on the id and the seed alone: not on partitioning, file layout or
the order of rows.  It is therefore the same after a retry, and any SQL engine with
md5 gives the same one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(ids: Sequence[str]) -> Column:
    """One string from the id columns; null parts count as empty, so no row is lost."""
    return F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids])


def hash_hex(ids: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), row_key(ids)))


#: Number of values of :func:`hash32`.
HASHES = 1 << 32


def hash32(ids: Sequence[str], seed: int) -> Column:
    """First 32 bits of the md5 of ``seed:id`` as a non-negative bigint."""
    return F.conv(F.substring(hash_hex(ids, seed), 1, 8), 16, 10).cast("bigint")


def hash_bucket(ids: Sequence[str], seed: int, buckets: int) -> Column:
    return hash32(ids, seed) % F.lit(buckets)


def hash_unit(ids: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) per row."""
    return hash32(ids, seed) / F.lit(float(HASHES))


def content_id(columns: Sequence[str]) -> Column:
    """An id for rows that have none: a hash of their content, vectors included.

    Exact copies share it and therefore stay on the same side of every split.
    """
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])
