"""Readers, writers and shared scratch tables."""

from discern.sources.handoff import read_labelled_csv, read_split, write_split
from discern.sources.libsvm import read_libsvm, write_libsvm
from discern.sources.scratch import materialize, persisted, scratch_path
from discern.sources.tables import read_table, register_tables, spread
from discern.sources.wide_csv import read_wide_csv, wide_schema, write_wide_csv

__all__ = [
    "materialize",
    "persisted",
    "read_labelled_csv",
    "read_libsvm",
    "read_split",
    "read_table",
    "read_wide_csv",
    "register_tables",
    "scratch_path",
    "spread",
    "wide_schema",
    "write_libsvm",
    "write_split",
    "write_wide_csv",
]
