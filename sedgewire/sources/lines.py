"""Line sources: access logs, Zeek, bodyfiles, SSH, Defender, W3C extended logs.

Each takes a DataFrame with `line` (and, where order matters, `file` and `line_no`) and returns parsed columns. Lines
that do not fit are left out; nothing here fails a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewire.functions.ids import quoted
from sedgewire.functions.timeparse import access_log_time, parse_time

# The combined and common log formats, ten groups; SSH messages; Defender lines.
ACCESS = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+)(?: (\S+))?" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?'
SSH = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?) .*?sshd(?:\[\d+\])?: (.*)$"
SSH_ACCEPTED = r"^Accepted (\S+) for (\S+) from (\S+) port (\d+)"
SSH_FAILED = r"^Failed (\S+) for (\S+) from (\S+) port (\d+)"
DEFENDER_TIME = r"^(\d{4}-\d{2}-\d{2}T[\d:.]+(?:Z|[+-]\d{2}:?\d{2})?)\s+(.+)$"
DEFENDER_DETECTION = r"\bDETECTION\s+([A-Za-z]+):([^/\s]+)/([^\s!]+)(?:!(\w+))?(?:\s+(.+))?"
DEFENDER_LEGACY = r"DETECTION[_\s]*(ADD|CLEAN|DELETE).*?Name[:\s]*(.+?)(?:#|$)"
DEFENDER_ADDED = r"(?i)(?:Adding|Added)\s+exclusion[:\s]*(.+)"
DEFENDER_REMOVED = r"(?i)(?:Removing|Removed)\s+exclusion[:\s]*(.+)"
DEFENDER_TYPE = r"ThreatType[:\s]*(.+?)(?:#|\s|$)"
DEFENDER_FILE = r"(?i)(?:file|path)[:\s]*(.+?)(?:#|\s*$)"
DEFENDER_CONTEXT = {"process.executable": r"(?i)^behavior:process:\s*(.+?)(?:,\s*pid:\d+)?,?$", "file.path": r"(?i)^file:\s*(.+)$", "registry.key": r"(?i)^regkey:\s*(.+)$", "defender.task_name": r"(?i)^taskscheduler:\s*(.+)$"}
DEFENDER_PID = r"(?i)^behavior:process:.*,\s*pid:(\d+)$"
# The columns of a bodyfile.
BODYFILE = ("md5", "name", "inode", "mode_as_string", "uid", "gid", "size", "atime", "mtime", "ctime", "crtime")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, line_no, line of UTF-8 files of any size. A block is a split of a file; its lines are numbered in
    their own task, and each block needs only the number of lines before it."""
    #: A scan that a plan reads twice has to be split alike, though executors come and go in between.
    pin = "spark.sql.files.minPartitionNum"
    if spark.conf.get(pin, None) is None:
        spark.conf.set(pin, str(spark.sparkContext.defaultParallelism))
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at_"), F.col("value").alias("line")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("file", "block").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    starts = counts.select("file", "block", (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("first_")).alias("shift_"))
    return rows.join(starts, ["file", "block"]).select("file", "block", (F.col("at_") + F.col("shift_")).alias("line_no"), "line")


def sniffed_lines(files: DataFrame) -> DataFrame:
    """file, line_no, line of whole texts (path, text), such as files in UTF-16, which cannot be split."""
    return files.select(F.col("path").alias("file"), F.posexplode(F.split("text", r"\r?\n", -1)).alias("line_no", "line"))


def _block(df: DataFrame) -> list[str]:
    return ["file", "block"] if "block" in df.columns else ["file"]


def _filled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds the last value that is not null, at or before each line of its file. Blocks are filled in their own tasks,
    and hand over to the next by one row each."""
    by = _block(df)
    rows = df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy("line_no")))
    if len(by) == 1:
        return rows
    ends = df.groupBy(*by).agg(F.max_by(value, F.when(value.isNotNull(), F.col("line_no"))).alias("end_"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(*by, F.last("end_", ignorenulls=True).over(before).alias("handed_"))
    return rows.join(handed, by, "left").withColumn(name, F.coalesce(name, "handed_")).drop("handed_")


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds the number, from 1, of each line in its file."""
    by = _block(df)
    rows = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("line_no")).cast("long"))
    if len(by) == 1:
        return rows
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*by).agg(F.count("*").alias("n_")).select(*by, F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    return rows.join(starts, by).withColumn(name, F.col(name) + F.col("start_")).drop("start_")


def _group(line: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(line, pattern, k)


def _given(x: Column, *none: str) -> Column:
    return F.when(~x.isin("", *none), x)


def access_log(df: DataFrame) -> DataFrame:
    """Combined and common access logs; a dash for user, bytes or referrer is null, one for the agent stays."""
    g = lambda k: _group(F.col("line"), ACCESS, k)
    out = {
        "source.ip": g(1), "user.name": _given(g(2), "-"), "@timestamp": access_log_time(g(3)), "http.request.method": g(4), "url.path": g(5), "http.version": _given(g(6)),
        "http.response.status_code": g(7).try_cast("int"), "http.response.bytes": g(8).try_cast("long"), "http.request.referrer": _given(g(9), "-"), "user_agent.original": _given(g(10)),
    }
    return df.where(F.col("line").rlike(ACCESS)).select(*(c for c in df.columns if c != "line"), *(v.alias(k) for k, v in out.items()))


def zeek(df: DataFrame, fields: list[str]) -> DataFrame:
    """Tab-separated rows of the columns that `#fields` names; rows of another width are left out."""
    cells = F.split("line", "\t", -1)
    rows = df.where(~F.col("line").startswith("#") & (F.size(cells) == len(fields))).withColumn("cells_", cells)
    return rows.select(*(c for c in df.columns if c != "line"), *(_given(F.get("cells_", F.lit(k)), "-", "(empty)").alias(name) for k, name in enumerate(fields)))


def bodyfile(df: DataFrame) -> DataFrame:
    """Eleven cells between pipes; times of 0 or less, or that are no number, are null."""
    cells = F.split("line", r"\|", -1)
    rows = df.where(F.size(cells) == len(BODYFILE)).withColumn("cells_", cells)
    cell = lambda k: F.get("cells_", F.lit(k))
    time = lambda x: F.when(x.try_cast("double") > 0, F.timestamp_seconds(x.try_cast("double")))
    return rows.select(*(c for c in df.columns if c != "line"), *((time(cell(k)) if k >= 7 else cell(k)).alias(n) for k, n in enumerate(BODYFILE)))


def ssh(df: DataFrame, zone: str | None) -> DataFrame:
    """Accepted, failed and other messages, local times of `zone`; without a zone there are no rows. A failure of an
    invalid user is `other`, as its name does not stand before `from`."""
    line = F.col("line")
    if zone is None:
        df = df.where(F.lit(False))
    message = _group(line, SSH, 2)
    accepted, failed = message.rlike(SSH_ACCEPTED), message.rlike(SSH_FAILED)
    pick = lambda k: F.when(accepted, _group(message, SSH_ACCEPTED, k)).when(failed, _group(message, SSH_FAILED, k))
    return df.where(line.rlike(SSH)).select(
        *(c for c in df.columns if c != "line"), parse_time(F.replace(_group(line, SSH, 1), F.lit(" "), F.lit("T")), zone or "UTC").alias("@timestamp"),
        F.when(accepted, F.lit("auth_accepted")).when(failed, F.lit("auth_failed")).otherwise(F.lit("other")).alias("ssh.event_type"),
        pick(1).alias("ssh.auth_method"), pick(2).alias("user.name"), pick(3).alias("source.ip"), pick(4).try_cast("int").alias("source.port"), line.alias("ssh.raw_line"),
    )


def defender(df: DataFrame, zone: str | None = None) -> DataFrame:
    """Detections, present and older form, and exclusions of (file, line_no, line). A line without a time has that of the
    last line with one, or none before the first; times without an offset need `zone`, or their lines are left out."""
    line = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    timed = line.rlike(DEFENDER_TIME)
    rows = _filled(df, "ts_", F.when(timed, _group(line, DEFENDER_TIME, 1))).withColumn("body_", F.when(timed, _group(line, DEFENDER_TIME, 2)).otherwise(line))
    offset = F.col("ts_").rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    rows = rows.where(F.col("ts_").isNull() | offset | F.lit(zone is not None)).withColumn("@timestamp", parse_time(F.col("ts_"), zone or "UTC"))
    b = F.col("body_")
    found = b.rlike(DEFENDER_DETECTION)
    legacy = ~found & b.rlike(DEFENDER_LEGACY)
    added = ~found & ~legacy & b.rlike(DEFENDER_ADDED)
    removed = ~found & ~legacy & ~added & b.rlike(DEFENDER_REMOVED)
    what = F.when(found, F.lit("detection")).when(legacy, F.concat(F.lit("detection_"), F.lower(_group(b, DEFENDER_LEGACY, 1)))).when(added, F.lit("exclusion_added")).when(removed, F.lit("exclusion_removed"))
    threat = lambda k: F.when(found, _given(F.trim(_group(b, DEFENDER_DETECTION, k))))
    context = threat(5)
    of = lambda k: _given(F.trim(_group(context, DEFENDER_CONTEXT[k], 1)))
    old = lambda pattern, k=1: F.when(legacy, _given(F.trim(_group(b, pattern, k))))
    return rows.withColumn("defender.event_type", what).where("`defender.event_type` is not null").select(
        "file", "line_no", "@timestamp", "`defender.event_type`", threat(1).alias("defender.detection_category"), threat(2).alias("defender.platform"),
        F.coalesce(threat(3), old(DEFENDER_LEGACY, 2)).alias("defender.threat_name"), old(DEFENDER_TYPE).alias("defender.threat_type"), threat(4).alias("defender.variant"), context.alias("defender.detection_context"),
        F.coalesce(of("file.path"), old(DEFENDER_FILE)).alias("file.path"), of("registry.key").alias("registry.key"), of("defender.task_name").alias("defender.task_name"),
        of("process.executable").alias("process.executable"), _group(context, DEFENDER_PID, 1).try_cast("int").alias("process.pid"),
        F.when(added, F.trim(_group(b, DEFENDER_ADDED, 1))).when(removed, F.trim(_group(b, DEFENDER_REMOVED, 1))).alias("defender.exclusion_path"), b.alias("defender.raw_line"),
    )


def _named(names: Column, cells: Column) -> Column:
    """A map of names to cells; of a name given twice the last cell counts."""
    once = F.array_distinct(names)
    last = lambda n: F.get(cells, (F.size(names) - F.array_position(F.reverse(names), n)).cast("int"))
    return F.map_from_arrays(once, F.transform(once, last))


def zeek_log(df: DataFrame) -> DataFrame:
    """Zeek logs of (file, line_no, line): a map of the columns that the last `#fields` named, unset and empty ones left
    out, and the time of `ts`. Rows of another width are left out."""
    line = F.col("line")
    rows = _filled(df, "names_", F.when(line.startswith("#fields\t"), F.split(F.substring(line, 9, 1 << 20), "\t", -1))).withColumn("cells_", F.split("line", "\t", -1))
    rows = rows.where(~line.startswith("#") & (F.trim(line) != "") & (F.size("cells_") == F.size("names_")))
    fields = F.map_filter(_named(F.col("names_"), F.col("cells_")), lambda _, v: ~v.isin("-", "(empty)", ""))
    return rows.withColumn("fields", fields).select("file", "line_no", parse_time(F.try_element_at("fields", F.lit("ts"))).alias("@timestamp"), F.try_element_at("fields", F.lit("id.orig_h")).alias("source.ip"), F.try_element_at("fields", F.lit("id.resp_h")).alias("destination.ip"), "fields")


def w3c(df: DataFrame, zone: str | None = "UTC") -> DataFrame:
    """W3C extended logs of (file, line_no, line): a map of the fields that the last `#Fields:` named, dashes left out,
    with times and addresses beside it. data_seq counts all data lines, also those of another width, which are left out.
    Without a zone there are no rows."""
    line, names = F.col("line"), F.split(F.trim(F.substring(F.col("line"), 9, 1 << 20)), r"\s+")
    rows = _filled(df, "names_", F.when(line.startswith("#Fields:"), names))
    rows = _numbered(rows.where(~line.startswith("#") & (F.trim(line) != "")), "data_seq")
    rows = rows.withColumn("cells_", F.split(F.trim(line), r"\s+"))
    rows = rows.where(F.col("names_").isNotNull() & (F.size("cells_") == F.size("names_")) & F.lit(zone is not None))
    rows = rows.withColumn("fields", F.map_filter(_named(F.col("names_"), F.col("cells_")), lambda _, v: v != "-"))
    f = F.col("fields")
    time = parse_time(F.concat_ws("T", F.try_element_at(f, F.lit("date")), F.try_element_at(f, F.lit("time"))), zone or "UTC")
    either = lambda *k: F.coalesce(*(F.try_element_at(f, F.lit(x)) for x in k))
    return rows.select("file", "line_no", "data_seq", time.alias("@timestamp"), either("c-ip", "src-ip").alias("source.ip"), either("s-ip", "dst-ip").alias("destination.ip"), "fields")


def stamped(df: DataFrame, index: str, host: str, source_file: str, method: str) -> DataFrame:
    """Adds the provenance every parser writes."""
    put = {"index_name": index, "host.name": host, "host.id": host, "prov.source_file": source_file, "prov.parse_method": method}
    for k, v in put.items():
        df = df.withColumn(k, F.lit(v))
    return df


def with_access_id(df: DataFrame) -> DataFrame:
    """The identity of an access-log row: two equal requests within a second are one."""
    from sedgewire.functions.ids import natural_id

    parts = ["prov.source_file", "@timestamp", "source.ip", "http.request.method", "url.path", "http.response.status_code", "http.response.bytes", "user_agent.original"]
    return df.withColumn("_id", natural_id(F.col("index_name"), *map(quoted, parts)))
