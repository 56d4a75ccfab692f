"""Identifier handling for lineage references and catalog paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is stripped from a reference before it is compared.
_QUOTES = "`\"[]"
_SCHEMES = ("s3://", "repo://")


def tidy(text: Column) -> Column:
    """Lower-cased text without outer white space."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def bare_reference(ref: Column) -> Column:
    """A reference without outer white space, quotes, backticks and brackets, lower-cased."""
    return F.btrim(tidy(ref), F.lit(_QUOTES))


def segments(ref: Column) -> Column:
    """Path segments of a reference: split on dots and slashes, no empties."""
    cleaned = bare_reference(ref)
    for scheme in _SCHEMES:
        cleaned = F.replace(cleaned, F.lit(scheme), F.lit(""))
    return F.array_remove(F.split(cleaned, "[./]"), "")


def suffix(segs: Column, k: Column | int) -> Column:
    """The last ``k`` segments joined by dots."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.array_join(F.slice(segs, -k, k), ".")


def parent_path(external_id: Column) -> Column:
    """Everything before the last dot; empty when there is none."""
    return F.regexp_extract(external_id, r"(?s)^(.*)\.[^.]*$", 1)


def base_name(path: Column) -> Column:
    """Last path component."""
    return F.element_at(F.split(path, "/"), -1)


def asset_id(org: Column, source: Column, external_id: Column) -> Column:
    """Deterministic asset id, so that a re-run writes the same rows."""
    return F.sha2(
        F.concat_ws("\u0001", F.coalesce(org, F.lit("")), F.coalesce(source, F.lit("")), external_id), 256
    )
