"""Record sources: event records as decoded JSON, JSON lines, delimited files, task XML, error reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.functions.ids import natural_id, quoted
from sedgewire.functions.timeparse import parse_time, time_field
from sedgewire.functions.validators import clean_ip


def event_records(df: DataFrame) -> DataFrame:
    """Decoded event records (event_record_id, data as JSON text) in the common schema. Records that are no JSON are left
    out. Values of the payload are strings; booleans read True and False."""
    v = F.col("v_")
    get = lambda p: F.try_variant_get(v, "$.Event." + p, "string")
    rows = df.withColumn("v_", F.try_parse_json("data")).where("v_ is not null")
    code = F.coalesce(get("System.EventID['#text']"), get("System.EventID")).try_cast("int")
    data = F.try_variant_get(v, "$.Event.EventData", "map<string,variant>")
    user = F.try_variant_get(v, "$.Event.UserData", "map<string,variant>")
    #: The wrapper is the first key of the text; a variant's keys are sorted.
    first = F.get(F.json_object_keys(F.get_json_object("data", "$.Event.UserData")), F.lit(0))
    wrapped = F.try_variant_get(F.try_element_at(user, first), "$", "map<string,variant>")
    payload = F.map_filter(F.when(F.size(data) > 0, data).otherwise(F.coalesce(F.map_filter(wrapped, lambda k, _: k != "#attributes"), user)), lambda k, _: k != "#attributes")
    text = lambda x: F.try_variant_get(x, "$", "string")
    scalar = lambda x: F.when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(text(x))).otherwise(text(x))
    rows = rows.withColumn("winlog.event_data", F.transform_values(payload, lambda _, x: scalar(x)))
    of = lambda k: F.try_element_at(quoted("winlog.event_data"), F.lit(k))
    has = lambda k: F.coalesce(F.map_contains_key(quoted("winlog.event_data"), F.lit(k)), F.lit(False))
    full = lambda *k: F.coalesce(*(F.nullif(of(x), F.lit("")) for x in k))
    first_key = lambda a, b: F.when(has(a), of(a)).otherwise(of(b))
    out: dict[str, Column] = {
        "event.code": code, "winlog.event_id": code, "@timestamp": parse_time(get("System.TimeCreated['#attributes'].SystemTime")), "winlog.channel": get("System.Channel"), "host.name": get("System.Computer"),
        "winlog.provider_name": F.coalesce(get("System.Provider['#attributes'].Name"), F.lit("")), "user.name": full("TargetUserName", "User"), "user.effective.name": of("SubjectUserName"),
        "source.ip": clean_ip(full("IpAddress", "Address")), "process.name": first_key("Image", "NewProcessName"), "process.parent.name": first_key("ParentImage", "ParentProcessName"),
        "process.command_line": of("CommandLine"), "file.path": of("TargetFilename"), "script_block_text": of("ScriptBlockText"), "winlog.logon.type": of("LogonType"),
    }
    return rows.select(*(c for c in df.columns if c != "data"), *(c.alias(k) for k, c in out.items()), "`winlog.event_data`")


def with_event_id(df: DataFrame, index: str, source_file: str) -> DataFrame:
    """Identity by record number: equal events of different numbers are both evidence."""
    return df.withColumn("index_name", F.lit(index)).withColumn("_id", natural_id(F.lit(index), F.lit(source_file), F.col("event_record_id")))


def keep_event_ids(df: DataFrame, ids: list[int], name: str = "event.code") -> DataFrame:
    """Rows of these event ids; a row without one goes."""
    return df.where(F.coalesce(quoted(name).isin(*ids), F.lit(False)))


def json_lines(df: DataFrame, host: str) -> DataFrame:
    """JSON objects in `line`, as a variant with the time found by its usual names; other lines are left out. A wrapper
    named _source is taken off; a scalar named host is kept as source_host."""
    v = F.try_parse_json("line")
    rows = df.withColumn("v_", v).where("v_ is not null and schema_of_variant(v_) like 'OBJECT%'")
    inner = F.try_variant_get("v_", "$._source", "variant")
    rows = rows.withColumn("doc", F.coalesce(F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner), F.col("v_")))
    from sedgewire.functions.timeparse import TIME_FIELDS

    time = F.coalesce(*(F.try_variant_get("doc", f"$['{k}']", "string") for k in TIME_FIELDS))
    return rows.select(*(c for c in df.columns if c != "line"), parse_time(time).alias("@timestamp"), F.lit(host).alias("host.name"), F.try_variant_get("doc", "$.host", "string").alias("source_host"), "doc")


def delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", host: str = "", multi_line: bool = True) -> DataFrame:
    """A delimited file with a header, all strings, empty where Python would read empty; time, host and Computer as the
    other parsers have them. UTF-16 needs multi_line."""
    df = spark.read.options(header=True, escape='"', sep=sep, encoding=encoding, multiLine=multi_line).csv(path).fillna("")
    if "host" in df.columns:
        df = df.withColumnRenamed("host", "source_host")
    when = time_field(df.columns)
    if when:
        df = df.withColumn("@timestamp", parse_time(quoted(when)))
    name = F.coalesce(F.nullif(quoted("Computer"), F.lit("")), F.lit(host)) if "Computer" in df.columns else F.lit(host)
    return df.withColumn("host.name", name).drop("Computer")


def sniff_delimited(head: list[str]) -> dict:
    """The format of a text file, from its first lines: zeek, bodyfile, tsv, csv or unknown (prose)."""
    import csv

    lines = [x for x in (y.rstrip("\r\n") for y in head) if x.strip()][:10]
    if not lines:
        return {"format": "unknown"}
    if any(x.startswith(("#separator", "#fields")) for x in lines):
        return {"format": "zeek", "delimiter": "\t"}
    cells = lines[0].split("|")
    if len(cells) == 11 and len(cells[0]) in (0, 1, 32):
        return {"format": "bodyfile", "delimiter": "|"}
    tabs, commas = lines[0].count("\t"), lines[0].count(",")
    sep = "\t" if tabs and tabs >= commas else "|" if lines[0].count("|") > commas else ","
    widths = [len(next(csv.reader([x], delimiter=sep))) for x in lines]
    if min(widths) < 2 or max(widths) - min(widths) > max(widths) // 2:
        return {"format": "unknown"}
    return {"format": {"\t": "tsv", "|": "pipe"}.get(sep, "csv"), "delimiter": sep}


def sniff_json(head: str) -> str:
    """jsonl, json_array, json_single or unknown, from the first line that is neither blank nor a comment."""
    import json

    line = next((x.strip() for x in head.splitlines() if x.strip() and not x.lstrip().startswith("#")), "")
    if line.startswith("["):
        return "json_array"
    if not line.startswith("{"):
        return "unknown"
    try:
        json.loads(line)
        return "jsonl"
    except ValueError:
        return "json_single"


# The first folder below `tasks` of tasks that belong to the system or to well-known vendors.
SYSTEM_TASKS = ("Microsoft", "MicrosoftEdge", "GoogleUpdate", "Adobe", "OneDrive", "CCleaner")
_TASK = (
    "RegistrationInfo struct<Date:string,Author:string,Description:string>, Actions struct<Exec:array<struct<Command:string,Arguments:string>>>, "
    "Principals struct<Principal:array<struct<UserId:string,RunLevel:string>>>, Settings struct<Enabled:string>, Triggers string, _bad string"
)


def scheduled_tasks(df: DataFrame, zone: str | None = None) -> DataFrame:
    """Task definitions (path, xml), whatever their namespace; one row per file, none for a file that is no XML."""
    text = F.regexp_replace(F.regexp_replace("xml", r"^\uFEFF", ""), r"<\?xml[^>]*\?>", "")
    options = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "_bad", "rowTag": "Task"}
    rows = df.withColumn("x_", text).where("x_ rlike '<'").withColumn("t_", F.from_xml("x_", _TASK, options)).where("t_ is not null and t_._bad is null")
    get = lambda p: F.nullif(F.trim(F.col("t_." + p)), F.lit(""))
    exec_, who = F.get("t_.Actions.Exec", F.lit(0)), F.get("t_.Principals.Principal", F.lit(0))
    of = lambda x, name: F.nullif(F.trim(x[name]), F.lit(""))
    date, enabled = get("RegistrationInfo.Date"), get("Settings.Enabled")
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    after = F.regexp_extract(path, r"(?i)(?:^|/)tasks/([^/]+)", 1)
    time = F.when(date.rlike(r"(?:Z|[+-]\d{2}:\d{2})$") | F.lit(zone is not None), parse_time(date, zone or "UTC"))
    triggers = F.regexp_extract_all(F.regexp_extract("x_", r"(?s)<(?:\w+:)?Triggers>(.*?)</(?:\w+:)?Triggers>", 1), F.lit(r"<(?:\w+:)?(\w+Trigger)\b"), 1)
    return rows.select(
        "path", time.alias("@timestamp"), get("RegistrationInfo.Author").alias("task.author"), get("RegistrationInfo.Description").alias("task.description"), of(exec_, "Command").alias("task.command"),
        of(exec_, "Arguments").alias("task.arguments"), of(who, "UserId").alias("task.user_id"), of(who, "RunLevel").alias("task.run_level"), triggers.alias("task.trigger_types"),
        F.when(enabled.isNotNull(), F.lower(enabled) == "true").alias("task.enabled"), F.regexp_extract(path, r"[^/]*$", 0).alias("task.name"), after.isin(*SYSTEM_TASKS).alias("task.is_system"), F.col("xml").alias("task.xml"),
    )


def error_reports(df: DataFrame) -> DataFrame:
    """Error reports (path, modified, text): key=value lines, of a key given twice the last; the time is the file's."""
    pairs = F.transform(F.filter(F.split(F.regexp_replace("text", "^\uFEFF", ""), r"\r?\n"), lambda x: x.contains("=")), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v")))
    rows = df.withColumn("kv_", pairs)
    of = lambda k: F.try_element_at(F.filter("kv_", lambda x: x["k"] == k), F.lit(-1))["v"]
    parts = F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/")
    return rows.select(
        "path", F.col("modified").alias("@timestamp"), of("EventType").alias("wer.event_type"), of("Sig[0].Value").alias("process.name"), of("Sig[1].Value").alias("wer.app_version"),
        of("Sig[6].Value").alias("wer.exception_code"), of("DynamicSig[1].Value").alias("wer.os_version"), F.try_element_at(parts, F.lit(-2)).alias("wer.report_dir"), F.col("text").alias("wer.full_text"),
    )
