"""The read tools: search, count, get, compact, terms, time histogram, inventory, summary. All are plain plans that
prune partitions and push predicates down; only a caller's page of at most 200 rows is ever collected."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewire.functions.ids import quoted
from sedgewire.plans.querylang import Fields, compile_query, fields_of

# Fields that a search leaves out, as others hold the same, or they are long or say little.
COMPACT_DROP = (
    "ExtraFieldInfo", "Payload", "FilesLoaded", "Directories", "task.xml", "wer.full_text", "SourceFile", "Computer", "ExtraDataOffset", "HiddenRecord", "Keywords", "ChunkNumber", "pipeline_version",
    "prov.source_file", "prov.audit_id", "prov.parse_method", "UpdateSequenceNumber", "LogfileSequenceNumber", "SecurityId", "ReferenceCount", "NameType", "IsAds", "Is256", "RecordNumber", "EventRecordId",
    "ProcessId", "ThreadId", "UserId",
)
MOST_FIELDS = 150
MOST_HITS, MOST_OFFSET, MOST_BUCKETS, MOST_CHARS = 200, 10_000, 500, 500


@dataclass
class Page:
    """A page of hits, how many there are in all (exact, so never capped), and what to read."""

    rows: DataFrame
    total: int
    total_capped: bool = False


def _fields(df: DataFrame, fields: Fields | None) -> Fields:
    return fields or fields_of(df)


def time_range(df: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from start to end, both inclusive, compared in the column's own type so that scans can skip."""
    if start or end:
        kind = df.schema[ts].dataType.simpleString()
        if start:
            df = df.where(quoted(ts) >= F.lit(start).cast(kind))
        if end:
            df = df.where(quoted(ts) <= F.lit(end).cast(kind))
    return df


def matching(df: DataFrame, query: str = "*", ts: str = "@timestamp", start: str | None = None, end: str | None = None, fields: Fields | None = None) -> DataFrame:
    return time_range(df.where(compile_query(query, _fields(df, fields))), ts, start, end)


def search(df: DataFrame, query: str = "*", sort: str | None = None, limit: int = 50, offset: int = 0, ties: list[str] | None = None, **where) -> DataFrame:
    """A page of hits. sort is field:asc or field:desc (anything else is desc); rows without the field come last."""
    out = matching(df, query, **where)
    name, _, order = (sort or "").partition(":")
    keys: list[Column] = []
    if name in df.columns:
        keys.append(quoted(name).asc_nulls_last() if order == "asc" else quoted(name).desc_nulls_last())
    keys += [quoted(c).asc() for c in ties or []]
    out = out.orderBy(*keys) if keys else out
    return out.offset(min(max(offset, 0), MOST_OFFSET)).limit(min(max(limit, 0), MOST_HITS))


def search_page(df: DataFrame, query: str = "*", **options) -> Page:
    where = {k: v for k, v in options.items() if k in ("ts", "start", "end", "fields")}
    return Page(search(df, query, **options), matching(df, query, **where).count())


def count(df: DataFrame, query: str = "*", **where) -> DataFrame:
    return matching(df, query, **where).agg(F.count("*").alias("count"))


def get_event(df: DataFrame, doc_id, id_column: str = "_id") -> DataFrame:
    return df.where(quoted(id_column) == F.lit(doc_id)).limit(1)


def compact(df: DataFrame, drop: tuple[str, ...] = COMPACT_DROP, most: int = MOST_CHARS) -> DataFrame:
    """Long strings cut to `most` characters and dots; `_truncated` names the columns that were."""
    df = df.drop(*drop)
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    cut = [F.when(F.length(quoted(c)) > most, F.lit(c)) for c in strings]
    out = [F.when(F.length(quoted(c)) > most, F.concat(F.substring(quoted(c), 1, most), F.lit("..."))).otherwise(quoted(c)).alias(c) if c in strings else quoted(c) for c in df.columns]
    return df.select(*out, F.array_compact(F.array(*cut) if cut else F.array().cast("array<string>")).alias("_truncated"))


def terms(df: DataFrame, name: str, size: int = 50, query: str = "*", fields: Fields | None = None, **where) -> DataFrame:
    """The most frequent values: key and count, ties by key. A row counts once for each distinct value of an array."""
    known = _fields(df, fields)
    found = known.find(name)
    if found is None:
        raise ValueError(f"no field {name}")
    column, kind, _ = found
    rows = matching(df, query, fields=known, **where)
    rows = rows.select(F.explode(F.array_distinct(column)).alias("key")) if isinstance(kind, T.ArrayType) else rows.select(column.alias("key"))
    return rows.where("key is not null").groupBy("key").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key").limit(min(max(size, 0), MOST_BUCKETS))


def field_values(df: DataFrame, name: str, size: int = 50, **options) -> DataFrame:
    return terms(df, name, size, **options).select(F.col("key").alias("value"), "count", F.col("count").alias("doc_count"))


_UNITS = {"s": "second", "m": "minute", "h": "hour", "d": "day"}


def timeline(df: DataFrame, interval: str, ts: str = "@timestamp", query: str = "*", **where) -> DataFrame:
    """Rows per interval, aligned to 1970 UTC, empty intervals left out."""
    m = re.fullmatch(r"(\d+)([smhd])", interval)
    if not m or not int(m[1]):
        raise ValueError(f"interval {interval!r} is not a positive number of s, m, h or d")
    rows = matching(df, query, ts=ts, **where).where(quoted(ts).isNotNull())
    return rows.groupBy(F.window(quoted(ts), f"{m[1]} {_UNITS[m[2]]}").alias("w")).agg(F.count("*").alias("count")).select(F.col("w.start").alias("bucket"), "count").orderBy("bucket")


def time_span(df: DataFrame, ts: str = "@timestamp") -> DataFrame:
    return df.agg(F.min(quoted(ts)).alias("first_seen"), F.max(quoted(ts)).alias("last_seen"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Documents per table or partition name, sorted."""
    parts = [df.agg(F.lit(name).alias("index_name"), F.count("*").alias("docs")) for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("index_name")


def summary(df: DataFrame, artifact: str = "artifact", host: str = "host.name", ts: str = "@timestamp") -> DataFrame:
    """Per artifact: documents, hosts, first and last time, enrichment counters; sub-tables under their parent."""
    parent = F.regexp_replace(quoted(artifact), r"^(delim-(?:amcache|mftecmd|srumecmd|sqlecmd))-.*$", "$1")
    flag = lambda name, value: F.count_if(quoted(name) == F.lit(value)) if name in df.columns else F.lit(0).cast("long")
    return df.groupBy(parent.alias("artifact")).agg(
        F.count("*").alias("docs"), F.array_sort(F.collect_set(quoted(host))).alias("hosts"), F.min(quoted(ts)).alias("first_seen"), F.max(quoted(ts)).alias("last_seen"),
        flag("triage.checked", True).alias("triage_checked"), flag("triage.verdict", "SUSPICIOUS").alias("suspicious"), flag("threat_intel.checked", True).alias("intel_checked"), flag("threat_intel.verdict", "MALICIOUS").alias("malicious"),
    )


def catalogue(df: DataFrame, artifact: str = "artifact", most: int = MOST_FIELDS) -> DataFrame:
    """(artifact, fields, n_fields): the fields that hold anything in rows of an artifact, sorted, the first `most` named."""
    names = sorted(c for c in df.columns if c != artifact)
    seen = df.groupBy(quoted(artifact).alias("artifact")).agg(*(F.max(quoted(c).isNotNull()).alias(f"f{k}") for k, c in enumerate(names)))
    found = F.array_compact(F.array(*(F.when(F.col(f"f{k}"), F.lit(c)) for k, c in enumerate(names))))
    return seen.select("artifact", F.slice(found, 1, most).alias("fields"), F.size(found).alias("n_fields"))


def union_all(*tables: DataFrame) -> DataFrame:
    """What a list of partitions or a wildcard reads: all rows, columns matched by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
