"""Column expressions shared by the operators."""

from discern.functions.hashing import content_id, hash32, hash_bucket, hash_unit, row_key
from discern.functions.text import letter_counts, url_tokens, word_tokens

__all__ = [
    "content_id",
    "hash32",
    "hash_bucket",
    "hash_unit",
    "letter_counts",
    "row_key",
    "url_tokens",
    "word_tokens",
]
