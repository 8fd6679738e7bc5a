"""Deterministic document identity, and the names of evidence partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns that say where a row came from; they never enter a content identity.
PROVENANCE = ("host.name", "host.id", "prov.source_file", "prov.audit_id", "prov.parse_method", "prov.snapshot_id", "prov.table", "pipeline_version", "@timestamp")


def quoted(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def sanitize(part: Column) -> Column:
    """Lower case; whatever is not a letter, digit, dot, underscore or hyphen becomes a hyphen."""
    return F.regexp_replace(F.lower(part), "[^a-z0-9._-]", "-")


def index_name(case: Column, artifact: Column, host: Column) -> Column:
    return F.concat_ws("-", F.lit("case"), sanitize(case), sanitize(artifact), sanitize(host))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 20)


def natural_id(index: Column, *parts: Column) -> Column:
    """Identity from a natural key: index and parts joined by colons; a null part is empty."""
    return short_hash(F.concat_ws(":", index, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def content_id(index: Column, columns: list[str], skip: tuple[str, ...] = PROVENANCE) -> Column:
    """Identity from content: name=value of every column that is neither null nor provenance, sorted by name."""
    pairs = [F.when(quoted(c).isNotNull(), F.concat(F.lit(c + "="), quoted(c).cast("string"))) for c in sorted(columns) if c not in skip]
    return short_hash(F.concat_ws("\x1f", index, *pairs))


def natural_or_content_id(index: Column, key: list[str], columns: list[str], skip: tuple[str, ...] = PROVENANCE) -> Column:
    """The natural key where all its parts are non-empty, else the content."""
    whole = F.lit(True)
    for c in key:
        whole = whole & (F.coalesce(quoted(c).cast("string"), F.lit("")) != "")
    return F.when(whole, natural_id(index, *(quoted(c) for c in key))).otherwise(content_id(index, columns, skip))
