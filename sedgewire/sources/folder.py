"""A folder of evidence into the evidence table: every file is recognised by its name and first bytes, those of a kind are
read in one scan, parsed, filtered by time, identified and upserted, and what came of each is counted.

Kinds: access, w3c, zeek, bodyfile, ssh, defender, csv, tsv, pipe, detections (a CSV of a rule engine), jsonl, json, task,
wer, transcript. Files that are none of these are told, not read. The driver lists files and reads HEAD bytes of each;
all else is distributed."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.functions.ids import PROVENANCE, content_id, natural_id, quoted, sanitize
from sedgewire.functions.timeparse import within
from sedgewire.operators import runs, store
from sedgewire.operators.enrich import resolve_hosts
from sedgewire.sources import lines, records, whole

HEAD = 1 << 16
#: Kinds whose rows are whole files, and those whose lines depend on nothing before them.
WHOLE = ("task", "wer", "transcript", "json")
ARTIFACTS = {"access": "accesslog", "w3c": "w3c", "zeek": "delim-zeek", "bodyfile": "delim-bodyfile", "ssh": "ssh", "defender": "defender", "csv": "delim", "tsv": "delim", "pipe": "delim", "detections": "hayabusa", "jsonl": "json", "json": "json", "task": "tasks", "wer": "wer", "transcript": "transcripts"}


def listed(spark: SparkSession, root: str, head: int = HEAD) -> Iterator[tuple[str, bytes]]:
    """(path, first bytes) of every file below root, on any file system; hidden ones are passed over."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        if f.getPath().getName().startswith((".", "_")):
            continue
        stream = fs.open(f.getPath())
        try:
            yield f.getPath().toString(), bytes(stream.readNBytes(head))
        finally:
            stream.close()


def kind_of(path: str, head: bytes) -> str | None:
    """The kind of a file by its name and first bytes."""
    name = posixpath.basename(path.replace("\\", "/")).lower()
    code = "utf-16" if head[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig"
    text = head[: len(head) // 2 * 2].decode(code, "replace")
    some = [x for x in text.splitlines() if x.strip()][:20]
    if not some:
        return None
    if name.startswith(("mplog-", "mpdetection-")):
        return "defender"
    if name == "report.wer":
        return "wer"
    if "<Task" in text[:4096] and some[0].lstrip("﻿").startswith("<"):
        return "task"
    if "transcript" in name and any("transcript start" in x.lower() for x in some):
        return "transcript"
    if any(x.startswith("#Fields:") for x in some):
        return "w3c"
    for kind, pattern in (("access", lines.ACCESS), ("ssh", lines.SSH)):
        if any(re.search(pattern, x) for x in some[:3]):
            return kind
    shape = records.sniff_json(text)
    if shape != "unknown":
        return "jsonl" if shape == "jsonl" else "json"
    shape = records.sniff_delimited(some)["format"]
    if shape == "csv" and {"RuleTitle", "Level"} <= set(some[0].replace('"', "").split(",")):
        return "detections"
    return None if shape == "unknown" else shape


def relative_path(path: Column, root: str) -> Column:
    """A file's path below root, so that identities do not hang on where a volume is mounted; else its name."""
    plain, top = F.replace(path, F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/") + "/"
    top = re.sub(r"^file:/*", "/", top)
    plain = F.regexp_replace(plain, "^file:/*", "/")
    return F.when(plain.startswith(top), F.substring(plain, len(top) + 1, 1 << 20)).otherwise(F.regexp_extract(plain, r"[^/]*$", 0))


def parsed(spark: SparkSession, kind: str, paths: list[str], zone: str | None, host: str) -> DataFrame:
    """The rows of files of one kind, with `file`."""
    named = lambda df: df.withColumnRenamed("path", "file")
    if kind in WHOLE:
        texts = whole.whole_files(spark, paths)
        if kind == "task":
            return named(records.scheduled_tasks(texts.select("path", F.col("text").alias("xml")), zone))
        if kind == "wer":
            return named(records.error_reports(texts))
        if kind == "transcript":
            return named(whole.transcripts(texts.drop("modified"), zone)).drop("text")
        return named(whole.json_documents(texts.drop("modified"))).withColumn("doc", F.to_json("doc"))
    if kind in ("csv", "tsv", "pipe", "detections"):
        sep = {"tsv": "\t", "pipe": "|"}.get(kind, ",")
        parts = [records.delimited(spark, p, sep, host=host).withColumn("file", F.lit(p)) for p in paths]  # files differ in their columns
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out
    read = lines.sniffed_lines(whole.whole_files(spark, paths)) if kind == "defender" else lines.numbered_lines(spark, paths)
    if kind == "jsonl":
        return records.json_lines(read.drop("block"), host).withColumn("doc", F.to_json("doc"))
    if kind == "bodyfile":
        return lines.bodyfile(read.drop("block")).withColumn("@timestamp", F.col("mtime"))
    parse = {"access": lines.access_log, "zeek": lines.zeek_log, "ssh": lambda x: lines.ssh(x, zone), "defender": lambda x: lines.defender(x, zone), "w3c": lambda x: lines.w3c(x, zone or "UTC")}[kind]
    return parse(read) if kind in ("w3c", "zeek", "defender") else parse(read.drop("block"))


def identified(df: DataFrame, index: Column) -> DataFrame:
    """Identity by file and line where lines are numbered (equal lines are both evidence), by the file where it is one row,
    and by content elsewhere."""
    file = quoted("prov.source_file")
    if "line_no" in df.columns:
        return df.withColumn("_id", natural_id(index, file, F.col("line_no")))
    if "seq" in df.columns:
        return df.withColumn("_id", natural_id(index, file, F.col("seq")))
    if any(c in df.columns for c in ("task.name", "wer.report_dir", "transcript.command_count")):
        return df.withColumn("_id", natural_id(index, file))
    plain = [f.name for f in df.schema if f.dataType.simpleString().startswith(("string", "int", "bigint", "double", "boolean", "timestamp"))]
    return df.withColumn("_id", content_id(index, plain, (*PROVENANCE, "file", "index_name", "case_id", "artifact", "host_part", "ingest_seq")))


def ingest_folder(spark: SparkSession, root: str, table: str, case: str, host: str, zone: str | None = None, start: str | None = None, end: str | None = None, aliases: DataFrame | None = None, seq: int = 0, notes: str | None = None) -> dict[str, dict[str, int]]:
    """Upserts the evidence below root into the table and returns, for each artifact, what was indexed, skipped and failed;
    files of no known kind are counted under `unknown`. start and end bound the time of rows that have one; aliases is
    the host dictionary; notes, a folder for the states of the run."""
    kinds: dict[str, list[str]] = {}
    for path, head in listed(spark, root):
        kinds.setdefault(kind_of(path, head) or "unknown", []).append(path)
    out: dict[str, dict[str, int]] = {}
    if unknown := kinds.pop("unknown", None):
        out["unknown"] = {"files": len(unknown)}
    run, by = uuid.uuid4().hex, {}
    for kind, paths in kinds.items():
        by.setdefault(ARTIFACTS[kind], []).append((kind, sorted(paths)))
    for artifact, parts in sorted(by.items()):
        if notes:
            runs.note(spark, notes, run, artifact, "running")
        try:
            counts = {"indexed": 0, "skipped": 0, "failed": 0}
            for kind, paths in parts:
                rows = parsed(spark, kind, paths, zone, host)
                rows = rows.withColumn("prov.source_file", relative_path(F.col("file"), root)).drop("file", "block").withColumn("prov.parse_method", F.lit(f"{kind}-parser"))
                named = F.coalesce(F.nullif(quoted("host.name"), F.lit("")), F.lit(host)) if "host.name" in rows.columns else F.lit(host)
                rows = rows.withColumn("host.name", named)
                rows = resolve_hosts(rows, aliases) if aliases is not None else rows.withColumn("host.id", quoted("host.name"))
                for c, v in {"case_id": F.lit(case), "artifact": F.lit(artifact), "host_part": sanitize(quoted("host.id")), "ingest_seq": F.lit(seq)}.items():
                    rows = rows.withColumn(c, v)
                index = F.concat_ws("-", F.lit("case"), sanitize(F.col("case_id")), sanitize(F.col("artifact")), F.col("host_part"))
                rows = identified(rows.withColumn("index_name", index), F.col("index_name"))
                if "@timestamp" in rows.columns:
                    rows = rows.where(within(quoted("@timestamp"), start, end))
                for k, n in store.ingest(spark, table, rows, F.lit(True)).items():
                    counts[k] += n
            out[artifact] = counts
        except Exception:
            if notes:
                runs.note(spark, notes, run, artifact, "failed")
            raise
        if notes:
            runs.note(spark, notes, run, artifact, "complete", **counts)
    return out
