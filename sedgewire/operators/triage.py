"""What a verdict service is asked about, and how its answers reach the rows: files, services, autostart values.

The service is any DataFrame (kind, value, verdict, reason, confidence, lolbin); nothing here calls out. Values are
distinct and uncapped, and each kind is stamped by one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewire.functions.ids import quoted
from sedgewire.operators.enrich import best_verdicts, spread

# Artifacts and the column that holds a file's path; event ids of a process start and a new service.
FILE_FIELDS = {"shimcache": "Path", "amcache": "FullPath", "evtx": "process.name", "tasks": "task.command", "vol-dlllist": "Path"}
PROCESS_EVENTS, SERVICE_EVENT = (4688, 1), 7045
KINDS = ("file", "service", "run", "stub", "netsh")
MOST_DETECTIONS = 500


def _column(df: DataFrame, name: str) -> Column:
    return quoted(name) if name in df.columns else F.lit(None).cast("string")


def _given(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def _is(df: DataFrame, artifact: str) -> Column:
    """Rows of an artifact or its sub-tables."""
    return (F.col("artifact") == artifact) | F.col("artifact").startswith(artifact + "-")


def keys(df: DataFrame) -> dict[str, tuple[Column, Column]]:
    """kind -> (the value to ask about, the value to stamp by). They differ where an answer reaches more rows than those
    it was asked for: a service is asked for at its ImagePath and stamps its key and all below; an autostart value is
    stamped wherever the registry holds it."""
    path, data = _column(df, "KeyPath"), _column(df, "ValueData")
    file = F.lit(None).cast("string")
    for artifact, name in FILE_FIELDS.items():
        here = _is(df, artifact)
        if artifact == "evtx":
            here = here & _column(df, "event.code").try_cast("int").isin(*PROCESS_EVENTS)
        file = F.when(here, _column(df, name)).otherwise(file)
    file = F.when(file.rlike(r"^(?:[\\/]|.:)"), file)
    registry = _is(df, "registry")
    service = F.when(registry, _given(F.regexp_extract(path, r"\\Services\\([^\\]+)", 1))).when(_is(df, "vol-svcscan"), _given(_column(df, "Name")))
    asked = F.when(registry & (_column(df, "ValueName") == "ImagePath"), service).when(~registry, service)
    if "winlog.event_data" in df.columns and isinstance(df.schema["winlog.event_data"].dataType, T.MapType):
        installed = _given(F.try_element_at(quoted("winlog.event_data"), F.lit("ServiceName")))
        service = F.when(_is(df, "evtx"), installed).otherwise(service)
        asked = F.when(_is(df, "evtx"), F.when(_column(df, "event.code").try_cast("int") == SERVICE_EVENT, installed)).otherwise(asked)
    run = F.when(registry, _given(data))
    stub = F.when(registry & path.contains(r"Active Setup\Installed Components"), _given(_column(df, "StubPath")))
    netsh = F.when(registry & path.contains(r"\NetSh") & F.lower(data).endswith(".dll"), data)
    return {"file": (file, file), "service": (asked, service), "run": (F.when(path.contains("\\Run\\") | path.endswith("\\Run"), run), run), "stub": (stub, stub), "netsh": (netsh, netsh)}


def questions(df: DataFrame) -> DataFrame:
    """(kind, value): what to ask, each once. Rows need `artifact`; columns that are absent hold nothing."""
    asked = F.array(*(F.struct(F.lit(k).alias("kind"), ask.alias("value")) for k, (ask, _) in keys(df).items()))
    return df.select(F.explode(asked).alias("q")).select("q.*").where("value is not null").distinct()


def answered(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows with triage.verdict, .reason, .confidence, .lolbin and .checked, where a verdict fits. Of several kinds the
    last of KINDS counts, of several verdicts for a value the worst; what a row had before stays where none fits."""
    fields = ("verdict", "reason", "confidence", "lolbin")
    one = best_verdicts(verdicts.where("verdict is not null"), ["kind", "value"], ("verdict", "confidence", "reason"))
    before = [c for c in df.columns if c.startswith("triage.")]
    out, by = df, keys(df)
    for kind in KINDS:
        right = one.where(F.col("kind") == kind).select(F.col("value").alias(f"{kind}_on_"), F.struct(*fields).alias(f"{kind}_v_"))
        out = out.withColumn(f"{kind}_k_", spread(by[kind][1], df)).join(right, F.col(f"{kind}_k_") == F.col(f"{kind}_on_"), "left").drop(f"{kind}_k_", f"{kind}_on_")
    answer = F.coalesce(*(F.col(f"{k}_v_") for k in reversed(KINDS)))
    put = {f"triage.{f}": answer[f] for f in fields} | {"triage.checked": F.when(answer.isNotNull(), F.lit(True))}
    put = {k: F.when(answer.isNotNull(), v).otherwise(quoted(k)) if k in before else v for k, v in put.items()}
    return out.select(*(quoted(c) for c in df.columns if c not in put), *(v.alias(k) for k, v in put.items()))


def counters(df: DataFrame) -> DataFrame:
    """What enrichment left: rows per artifact that were checked, and how they came out."""
    flag = lambda c: F.count_if(c).alias
    verdict = _column(df, "triage.verdict")
    return df.groupBy("artifact").agg(F.count("*").alias("docs"), flag(_column(df, "triage.checked").cast("boolean"))("checked"), flag(verdict == "SUSPICIOUS")("suspicious"), flag(verdict == "MALICIOUS")("malicious"))


def detections(df: DataFrame, severity: str = "", limit: int = 50, offset: int = 0, level: str = "Level", ts: str = "@timestamp", ties: tuple[str, ...] = ()) -> DataFrame:
    """Detection rows whose level holds the text, newest first."""
    if severity:
        df = df.where(F.lower(quoted(level)).contains(severity.lower()))
    return df.orderBy(quoted(ts).desc_nulls_last(), *map(quoted, ties)).offset(max(offset, 0)).limit(min(max(limit, 0), MOST_DETECTIONS))
