"""Sources where a whole file is one unit: PowerShell transcripts, memory plugin output, JSON arrays, file manifests, and
the walk that finds artifacts on a mounted volume."""

from __future__ import annotations

import codecs
import json
import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewire.functions.timeparse import TIME_FIELDS, parse_time
from sedgewire.sources.catalog import HANDLE_TYPES, MEMORY_TIMES

# The headers of a transcript.
HEADERS = ("Start time", "End time", "Username", "RunAs User", "Machine", "Host Application", "Process ID", "PSVersion")
# Where artifacts lie on a volume, and below a user's folder.
VOLUME_PATHS = {
    "amcache": "Windows/appcompat/Programs/Amcache.hve", "shimcache": "Windows/System32/config/SYSTEM", "registry_system": "Windows/System32/config/SYSTEM",
    "registry_software": "Windows/System32/config/SOFTWARE", "registry_sam": "Windows/System32/config/SAM", "registry_security": "Windows/System32/config/SECURITY", "mft": "$MFT", "usn": "$Extend/$J",
    "recyclebin": "$Recycle.Bin", "prefetch": "Windows/Prefetch", "srum": "Windows/System32/SRU/SRUDB.dat",
}
USER_PATHS = {
    "shellbags": ("",), "jumplists": ("AppData/Roaming/Microsoft/Windows/Recent",), "lnk": ("AppData/Roaming/Microsoft/Windows/Recent", "Desktop"), "timeline": ("AppData/Local/ConnectedDevicesPlatform",),
}
VOLUME_MARK = "Windows/System32/config"


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series) -> pd.Series:
    kinds = {codecs.BOM_UTF8: "utf-8-sig", codecs.BOM_UTF16_LE: "utf-16", codecs.BOM_UTF16_BE: "utf-16"}
    return content.map(lambda x: x.decode(next((name for mark, name in kinds.items() if x.startswith(mark)), "utf-8"), "replace"))


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, modified, text of each file, decoded by its byte order mark (UTF-16 or UTF-8) or as UTF-8; bytes that do
    not fit read as U+FFFD."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), _decoded("content").alias("text"))


def _transcript_time(text: Column, zone: str | None) -> Column:
    """Fourteen digits are local time; ISO text without an offset is too. Local times need a zone."""
    plain = F.trim(text)
    digits = plain.rlike(r"^\d{14}$")
    iso = F.when(digits, F.regexp_replace(plain, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6")).otherwise(plain)
    aware = iso.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & ~digits
    return F.when(aware | F.lit(zone is not None), parse_time(iso, zone or "UTC"))


def transcripts(df: DataFrame, zone: str | None = None) -> DataFrame:
    """Transcripts (path, text): header fields, the commands with their output, the kind of session. The last of equal
    headers counts. A transcript whose start cannot be told in UTC is left out. A command runs from its prompt (PS> or
    >>) to the next one or to a row of stars; header lines inside it are not part of it."""
    clean = F.regexp_replace("text", r"\r\n?", "\n")
    heads = "|".join(HEADERS)
    rows = df.withColumn("t_", clean)
    last = lambda k: F.try_element_at(F.regexp_extract_all("t_", F.lit(rf"(?m)^{k}: (.*)$"), 1), F.lit(-1))
    for k in HEADERS:
        rows = rows.withColumn(f"{k}_", F.trim(last(k)))
    chunks = F.split(F.regexp_replace("t_", rf"(?m)^(?:{heads}): .*(?:\n|\z)", ""), r"(?m)^(?=PS>|>> |\*{4})")
    commands = F.transform(F.filter(chunks, lambda x: x.startswith("PS>") | x.startswith(">> ")), lambda x: F.regexp_replace(x.substr(F.lit(4), F.length(x)), r"\n\z", ""))
    user, machine, app = F.col("`Username_`"), F.col("`Machine_`"), F.col("`Host Application_`")
    program, low = F.regexp_extract(app, r"^\S*", 0), F.lower(app)
    kind = (
        F.when(low.contains("wsmprovhost") | low.contains("serverremotehost"), "remoting").when(low.contains("-encodedcommand"), "encoded").when(low.contains("-noninteractive"), "noninteractive")
        .when(low.contains("powershell"), "interactive").when(low.isNotNull(), "other")
    )
    start, end = _transcript_time(F.col("`Start time_`"), zone), _transcript_time(F.col("`End time_`"), zone)
    split = user.contains("\\")
    out = rows.select(
        *df.columns, start.alias("@timestamp"), end.alias("transcript.end_time"), F.when(split, F.substring_index(user, "\\", 1)).alias("user.domain"),
        F.when(split, F.regexp_extract(user, r"(?s)^[^\\]*\\(.*)$", 1)).otherwise(user).alias("user.name"), F.col("`RunAs User_`").alias("user.runas"),
        F.substring_index(machine, " (", 1).alias("transcript.machine"), F.when(machine.contains(" ("), F.regexp_replace(F.regexp_extract(machine, r"^.*? \((.*)$", 1), r"\)+$", "")).alias("host.os.version"),
        F.regexp_extract(program, r"[^\\/]*$", 0).alias("process.name"), F.nullif(F.regexp_extract(app, r"^\S+\s+(.*)$", 1), F.lit("")).alias("process.args"), kind.alias("transcript.session_type"),
        F.col("`Process ID_`").try_cast("int").alias("process.pid"), F.col("`PSVersion_`").alias("transcript.ps_version"), commands.alias("transcript.commands"), F.size(commands).alias("transcript.command_count"),
        (F.unix_timestamp(end) - F.unix_timestamp(start)).alias("transcript.duration_seconds"),
    )
    return out.where("`@timestamp` is not null")


def _flat(text: str | None, most_depth: int | None = None) -> Iterator[tuple[int, str, str | None]]:
    """Depth, JSON and type of each record of a plugin's output, parents before their children, to any depth or to most_depth."""
    try:
        raw = json.loads(text or "")
    except (ValueError, RecursionError):
        return
    if isinstance(raw, dict):
        names = [c["name"] for c in raw.get("columns", [])]
        raw = [dict(zip(names, row, strict=False)) for row in raw.get("data", [])]
    todo = [(0, r) for r in reversed(raw if isinstance(raw, list) else [])]
    while todo:
        depth, record = todo.pop()
        if not isinstance(record, dict):
            continue
        children = record.pop("__children", None) or []
        if most_depth is None or depth < most_depth:
            todo.extend((depth + 1, c) for c in reversed(children))
        kind = record.get("Type")
        yield depth, json.dumps(record, ensure_ascii=False), kind if isinstance(kind, str) else None


def memory_records(df: DataFrame, most_depth: int | None = None) -> DataFrame:
    """Memory plugin output (plugin, text) as flat records: plugin, artifact, seq, depth, @timestamp, record (a variant).
    Handles of kinds that say little are left out, as is output that is no JSON."""

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for plugin, text in zip(batch["plugin"], batch["text"], strict=True):
                found = [(plugin, k, d, r, t) for k, (d, r, t) in enumerate(_flat(text, most_depth))]
                yield pd.DataFrame(found, columns=["plugin", "seq", "depth", "json", "kind"])

    flat = df.select("plugin", "text").mapInPandas(flatten, "plugin string, seq long, depth int, json string, kind string")
    flat = flat.where((F.col("plugin") != "windows.handles") | F.coalesce(F.col("kind").isin(*HANDLE_TYPES), F.lit(False)))
    time = F.lit(None).cast("string")
    record = F.try_parse_json("json")
    for plugin, name in MEMORY_TIMES.items():
        time = F.when(F.col("plugin") == plugin, F.try_variant_get(record, f"$['{name}']", "string")).otherwise(time)
    artifact = F.concat(F.lit("vol-"), F.substring_index("plugin", ".", -1))
    return flat.select("plugin", artifact.alias("artifact"), "seq", "depth", parse_time(time).alias("@timestamp"), record.alias("record"))


def json_documents(df: DataFrame) -> DataFrame:
    """Whole JSON files (path, text) as one row per document, in order: an array's items; the items of a wrapper whose
    first value is an array; else the object itself. Text that is no JSON is left out."""
    v, items = F.col("v_"), "array<variant>"
    first = F.regexp_extract("text", r'^\s*\{\s*"([^"\\]*)"\s*:', 1)
    inner = F.try_variant_get(F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.col("first_")), "$", items)
    rows = df.withColumn("v_", F.try_parse_json("text")).withColumn("first_", first).where("v_ is not null")
    rows = rows.select(*(c for c in df.columns if c != "text"), F.posexplode(F.coalesce(F.try_variant_get(v, "$", items), inner, F.array(v))).alias("seq", "item"))
    unwrapped = F.try_variant_get("item", "$._source", "variant")
    doc = F.coalesce(F.when(F.schema_of_variant(unwrapped).startswith("OBJECT"), unwrapped), F.col("item"))
    rows = rows.where(F.schema_of_variant("item").startswith("OBJECT")).withColumn("doc", doc).drop("item")
    time = F.coalesce(*(F.try_variant_get("doc", f"$['{k}']", "string") for k in TIME_FIELDS))
    return rows.withColumn("@timestamp", parse_time(time))


def manifest(spark: SparkSession, path: str, audit_id: str | None = None) -> DataFrame:
    """path, length, modified and SHA-256 of every file below path, and the id of the ingest that read it, if given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), *([F.lit(audit_id).alias("audit_id")] if audit_id else []))


def _below(folder: str, path: str) -> str | None:
    """The path below folder, whatever the case of its parts."""
    for part in filter(None, path.split("/")):
        names = os.listdir(folder) if os.path.isdir(folder) else []
        found = part if part in names else next((n for n in sorted(names) if n.lower() == part.lower()), None)
        if found is None:
            return None
        folder = os.path.join(folder, found)
    return folder


def discover(root: str) -> list[tuple[str, str, str]]:
    """(host, artifact, path) of a mounted volume, or of the volumes in the folders of root, whose names are the hosts."""
    found = []
    folders = [root] if _below(root, VOLUME_MARK) else [d for d in sorted(os.path.join(root, n) for n in os.listdir(root)) if os.path.isdir(d)]
    for folder in folders:
        inside = [folder, *(d for d in sorted(os.path.join(folder, n) for n in os.listdir(folder)) if os.path.isdir(d))]
        volume = next((d for d in inside if _below(d, VOLUME_MARK)), None)
        if volume is None:
            continue
        host = os.path.basename(folder.rstrip("/"))
        found += [(host, artifact, at) for artifact, path in VOLUME_PATHS.items() if (at := _below(volume, path))]
        if logs := _below(volume, "Windows/System32/winevt/Logs"):
            found.append((host, "evtx", logs))
        users = _below(volume, "Users")
        for user in sorted(os.listdir(users)) if users and os.path.isdir(users) else []:
            home = os.path.join(users, user)
            found += [(host, artifact, at) for artifact, paths in USER_PATHS.items() for path in paths if os.path.isdir(home) and (at := _below(home, path))]
    return found


def hosts_in_names(stems: list[str]) -> set[str]:
    """Hosts that files are named after: what follows the last hyphen in at least three of ten of the names."""
    ends = Counter(end.lower() for stem in stems for _, dash, end in [stem.rpartition("-")] if dash and len(end) >= 2)
    return {end for end, n in ends.items() if 10 * n >= 3 * len(stems)}
