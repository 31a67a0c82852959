"""Queries of this subpackage and their SQL, as __spark_entry__ lists them."""

from __future__ import annotations

from importlib import import_module

#: Modules of this subpackage that register queries.
MODULES = (
    "exact_dedup",
    "quality_rules",
    "packing",
    "byte_bpe",
    "quality_model",
    "line_dedup",
    "substring_dedup",
    "near_dedup",
    "warc",
    "license_scan",
)


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").QUERIES
    return out


def oracle_sql() -> dict:
    out = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").ORACLES
    return out
