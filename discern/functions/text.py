"""Tokens and letter counts of text columns, always over the whole text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word_tokens(column: Column) -> Column:
    """Runs of non-blank characters."""
    return F.filter(F.split(column, r"\s+"), lambda token: token != F.lit(""))


def url_tokens(column: Column) -> Column:
    """Parts of a URL between its punctuation marks."""
    return F.filter(F.split(column, r"[/:?&=#.]+"), lambda token: token != F.lit(""))


def letter_count(column: Column, letter: str) -> Column:
    """How often an ASCII letter occurs, in either case."""
    rest = F.replace(F.replace(column, F.lit(letter)), F.lit(letter.upper()))
    return F.length(column) - F.length(rest)


def letter_counts(column: Column) -> list[Column]:
    """One count column per letter, named ``n_a .. n_z``."""
    return [letter_count(column, letter).alias(f"n_{letter}") for letter in LETTERS]
