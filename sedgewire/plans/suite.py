"""The library's operators as queries over the driver's tables, each beside its SQL.

The last group holds Spark's own relational operators; they are features of the engine underneath, not parity."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewire.functions import ids, timeparse, validators
from sedgewire.functions.zones import resolve_zone
from sedgewire.operators import enrich, hosts, ranges, runs, search, store, triage
from sedgewire.plans.querylang import compile_query, fields_of
from sedgewire.sources import catalog, folder, lines, records, whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: list[tuple], names: str) -> tuple[str, str]:
    """The same inline rows as Spark SQL and as DuckDB SQL."""
    lit = lambda x, esc: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + (x.replace("\\", "\\\\") if esc else x).replace("'", "\\'" if esc else "''") + "'"
    text = lambda esc: ", ".join("(" + ", ".join(lit(x, esc) for x in r) + ")" for r in rows)
    return f"select * from values {text(True)} as t({names})", f"(select * from (values {text(False)}) t({names}))"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, below the checkpoint folder or the warehouse; it goes with the application."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.gettempdir() if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/sedgewire-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


# Read tools.


@_query("select count(*) as count from events where event_type = 'error' and value >= 50")
def count_query(spark, d):
    return search.count(table(spark, d, "events"), "event_type:error AND value:>=50")


@_query("select * from events where (event_type = 'error' or event_type = 'signup') and value >= 50 and not user_id = 7 order by ts desc, event_id limit 200")
def search_events(spark, d):
    return search.search(table(spark, d, "events"), "event_type:(error OR signup) AND value:[50 TO *] AND NOT user_id:7", sort="ts:desc", limit=500, ties=["event_id"], ts="ts")


@_query("select * from events where event_type like 'c%k' and ts >= timestamp '2024-01-05 00:00:00' and ts <= timestamp '2024-01-09 12:00:00' order by value desc, event_id limit 20 offset 30")
def search_offset(spark, d):
    return search.search(table(spark, d, "events"), "event_type:c*k", sort="value:desc", limit=20, offset=30, ties=["event_id"], ts="ts", start="2024-01-05 00:00:00", end="2024-01-09 12:00:00")


@_query("select * from events where event_id = 123")
def get_event(spark, d):
    return search.get_event(table(spark, d, "events"), 123, "event_id")


@_query("select doc_id, case when length(text) > 500 then concat(left(text, 500), '...') else text end as text, lang, source, case when length(text) > 500 then 'text' else '' end as truncated from documents")
def search_compact(spark, d):
    out = search.compact(table(spark, d, "documents"), drop=("n_chars",))
    return out.withColumn("truncated", F.array_join("_truncated", ",")).drop("_truncated")


@_query("select doc_id from documents where regexp_matches(lower(text), '(^|[^a-z0-9_äöüßàâçéèêëîïôûùñáíóú])the[^a-z0-9_äöüßàâçéèêëîïôûùñáíóú]+of([^a-z0-9_äöüßàâçéèêëîïôûùñáíóú]|$)') and lang = 'en'")
def search_text(spark, d):
    docs = table(spark, d, "documents")
    return search.matching(docs, 'text:"the of" AND lang.keyword:en', fields=fields_of(docs, {"text"})).select("doc_id")


@_query("select event_type as key, count(*) as count from events group by 1")
def agg_terms(spark, d):
    return search.terms(table(spark, d, "events"), "event_type")


@_query("select user_id as key, count(*) as count from events group by 1 order by 2 desc, 1 limit 50")
def agg_terms_topk_user(spark, d):
    return search.terms(table(spark, d, "events"), "user_id", 50)


@_query("select cast(json_extract_string(props, '$.k') as varchar) as value, count(*) as count, count(*) as doc_count from events group by 1 order by 2 desc, 1 limit 50")
def field_values_json(spark, d):
    return search.field_values(table(spark, d, "events").withColumn("props", F.try_parse_json("props")), "props.k", 50)


def _timeline(name: str, interval: str, seconds: int) -> None:
    def run(spark, d):
        return search.timeline(table(spark, d, "events"), interval, ts="ts")

    QUERIES[name] = run
    SQL[name] = f"select make_timestamp((epoch_us(ts) // {seconds}000000) * {seconds}000000) as bucket, count(*) as count from events group by 1"


for _name, _interval, _seconds in (("timeline_1h", "1h", 3600), ("timeline_5h", "5h", 18000), ("timeline_1d", "1d", 86400)):
    _timeline(_name, _interval, _seconds)


@_query("select event_type as artifact, count(*) as docs, count(distinct user_id % 7) as n_hosts, min(ts) as first_seen, max(ts) as last_seen, count(*) filter (where value > 100) as triage_checked, 0::bigint as malicious from events group by 1")
def case_summary(spark, d):
    df = table(spark, d, "events").withColumn("host.name", (F.col("user_id") % 7).cast("string")).withColumn("triage.checked", F.col("value") > 100)
    return search.summary(df, "event_type", ts="ts").select("artifact", "docs", F.size("hosts").cast("long").alias("n_hosts"), "first_seen", "last_seen", "triage_checked", "malicious")


@_query("select min(ts) as first_seen, max(ts) as last_seen from events")
def time_span(spark, d):
    return search.time_span(table(spark, d, "events"), "ts")


_INVENTORY = ("customer", "documents", "events", "lineitem", "orders", "pages")


@_query(" union all ".join(f"select '{t}' as index_name, count(*) as docs from {t}" for t in _INVENTORY))
def index_inventory(spark, d):
    return search.inventory({t: table(spark, d, t) for t in _INVENTORY})


@_query("select c_custkey as id, c_name as name, c_mktsegment as segment, null as acct from customer union all by name select s_suppkey as id, s_name as name, null as segment, round(s_acctbal, 2) as acct from supplier")
def union_by_name(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("acct"))
    return search.union_all(a, b)


# Identity and store.


@_query("select o_orderkey, substr(sha256(concat_ws(':', 'case-a-orders-h', o_orderkey::varchar, o_custkey::varchar, o_orderpriority)), 1, 20) as _id from orders")
def doc_id(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ids.natural_id(F.lit("case-a-orders-h"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")).alias("_id"))


@_query("select c_custkey, regexp_replace(lower(c_name || ' #' || c_mktsegment), '[^a-z0-9._-]', '-', 'g') as part, 'case-x-' || regexp_replace(lower(c_name), '[^a-z0-9._-]', '-', 'g') || '-h' as index_name from customer")
def sanitize_index(spark, d):
    return table(spark, d, "customer").select("c_custkey", ids.sanitize(F.concat("c_name", F.lit(" #"), "c_mktsegment")).alias("part"), ids.index_name(F.lit("X"), F.col("c_name"), F.lit("H")).alias("index_name"))


@_query("select event_id, user_id, event_type, ts from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def dedup_latest(spark, d):
    return store.latest(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "ts")


# Line sources: lines made from the tables, then parsed.

_CLF = """concat('10.0.', user_id % 200, '.', event_id % 250, ' - ', case when user_id % 3 = 0 then '-' else 'u' || user_id end, ' [', {time}, ' +0000] "GET /p/', event_type, ' HTTP/1.1" ', 200 + event_id % 4 * 100, ' ', case when event_id % 5 = 0 then '-' else cast(event_id * 7 as {text}) end, ' "-" "agent ', event_type, '"')"""


@_query(
    """with l as (select event_id, """ + _CLF.format(time="strftime(ts, '%d/%b/%Y:%H:%M:%S')", text="varchar") + """ as line from events), p as (select event_id, regexp_extract(line, '^(\\S+) \\S+ (\\S+) \\[([^\\]]+)\\] "([A-Z]+) (\\S+) HTTP/([0-9.]+)" (\\d{3}) (\\S+) "([^"]*)" "([^"]*)"', ['ip','u','t','m','path','v','s','b','r','a']) as g from l)
    select event_id, g.ip as source_ip, nullif(g.u, '-') as user_name, strptime(left(g.t, 20), '%d/%b/%Y:%H:%M:%S') as ts, g.m as method, g.path as path, g.s::integer as status, try_cast(g.b as bigint) as bytes, g.a as agent from p"""
)
def parse_accesslog(spark, d):
    raw = table(spark, d, "events").select("event_id", F.expr(_CLF.format(time="date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')", text="string")).alias("line"))
    names = {"source.ip": "source_ip", "user.name": "user_name", "http.request.method": "method", "url.path": "path", "http.response.status_code": "status", "http.response.bytes": "bytes", "user_agent.original": "agent"}
    return lines.access_log(raw).select("event_id", F.col("`@timestamp`").cast("timestamp_ntz").alias("ts"), *(ids.quoted(k).alias(v) for k, v in names.items()))


@_query("with l as (select event_id, ts, user_id, event_type, value from events) select event_id::varchar as uid, case when user_id % 4 = 0 then null else 'u' || user_id end as orig, event_type as service from l where event_id % 9 <> 0")
def parse_zeek(spark, d):
    line = "concat_ws('\t', event_id, case when user_id % 4 = 0 then '-' else 'u' || user_id end, event_type, case when event_id % 9 = 0 then 'extra\tcell' else '(empty)' end)"
    return lines.zeek(table(spark, d, "events").select(F.expr(line).alias("line")), ["uid", "orig", "service", "none"]).drop("none")


@_query("select o_orderkey::varchar as name, o_custkey::varchar as size, o_orderdate as mtime, null::timestamp as atime from orders")
def parse_bodyfile(spark, d):
    line = "concat_ws('|', '0', o_orderkey, '0', 'r/rr', '0', '0', o_custkey, '0', unix_timestamp(cast(o_orderdate as timestamp)), '-1', 'x')"
    out = lines.bodyfile(table(spark, d, "orders").select(F.expr(line).alias("line")))
    return out.select("name", "size", F.col("mtime").cast("timestamp_ntz").alias("mtime"), F.col("atime").cast("timestamp_ntz").alias("atime"))


@_query("select event_id, date_trunc('second', ts) as ts, case event_id % 3 when 0 then 'auth_accepted' when 1 then 'auth_failed' else 'other' end as event_type, case when event_id % 3 < 2 then 'u' || user_id end as user_name, case when event_id % 3 < 2 then (event_id % 60000)::integer end as port from events")
def parse_ssh(spark, d):
    who = "case event_id % 3 when 0 then concat('Accepted password for u', user_id) when 1 then concat('Failed password for u', user_id) else 'Failed password for invalid user admin' end"
    line = f"concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' sshd[12]: ', {who}, ' from 198.51.100.7 port ', event_id % 60000, ' ssh2')"
    out = lines.ssh(table(spark, d, "events").select("event_id", F.expr(line).alias("line")), "UTC")
    return out.select("event_id", F.col("`@timestamp`").cast("timestamp_ntz").alias("ts"), F.col("`ssh.event_type`").alias("event_type"), F.col("`user.name`").alias("user_name"), F.col("`source.port`").alias("port"))


@_query("select event_id, date_trunc('second', last_value(case when event_id % 2 = 0 then ts end ignore nulls) over (partition by user_id order by event_id)) as ts, case when event_id % 3 = 0 then 'detection' else 'exclusion_added' end as event_type, case when event_id % 3 = 0 then 'Name' || user_id end as threat from events qualify event_id % 3 < 2")
def parse_defender(spark, d):
    body = "case event_id % 3 when 0 then concat('DETECTION Trojan:Win32/Name', user_id, '!x file:C:/a') when 1 then 'Added exclusion: C:/tmp' else 'noise' end"
    line = f"concat(case when event_id % 2 = 0 then concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z ') else '' end, {body})"
    raw = table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line_no"), F.expr(line).alias("line"))
    return lines.defender(raw).select(F.col("line_no").alias("event_id"), F.col("`@timestamp`").cast("timestamp_ntz").alias("ts"), F.col("`defender.event_type`").alias("event_type"), F.col("`defender.threat_name`").alias("threat"))


@_query("select event_id, row_number() over (partition by user_id order by event_id) as data_seq, date_trunc('second', ts) as ts, '10.1.1.' || user_id as source_ip, case when event_id % 4 <> 0 then event_type end as stem from events qualify event_id % 5 <> 0")
def parse_w3c(spark, d):
    e = table(spark, d, "events")
    head = e.select(F.col("user_id").cast("string").alias("file")).distinct().select("file", F.lit(-1).cast("long").alias("line_no"), F.lit("#Fields: date time c-ip cs-uri-stem").alias("line"))
    line = "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' 10.1.1.', user_id, ' ', case when event_id % 4 = 0 then '-' else event_type end, case when event_id % 5 = 0 then ' more' else '' end)"
    out = lines.w3c(head.union(e.select(F.col("user_id").cast("string"), "event_id", F.expr(line))), "UTC")
    return out.select(F.col("line_no").alias("event_id"), F.col("data_seq").cast("long").alias("data_seq"), F.col("`@timestamp`").cast("timestamp_ntz").alias("ts"), F.col("`source.ip`").alias("source_ip"), F.try_element_at("fields", F.lit("cs-uri-stem")).alias("stem"))


@_query("select event_id, case when event_id % 2 = 0 then 4624 else 1 end::integer as code, 'u' || user_id as user_name, case when event_id % 3 = 0 then null else '10.9.8.' || user_id end as source_ip, case when event_id % 2 = 0 then 'True' else 'False' end as flag from events")
def event_record_fields(spark, d):
    data = """concat('{"Event":{"System":{"EventID":', case when event_id % 2 = 0 then '{"#text":4624}' else '"1"' end, ',"Computer":"WS1"},"EventData":{"TargetUserName":"","User":"u', user_id, '","IpAddress":"', case when event_id % 3 = 0 then '-' else concat('10.9.8.', user_id) end, '","Flag":', case when event_id % 2 = 0 then 'true' else 'false' end, '}}}')"""
    out = records.event_records(table(spark, d, "events").select(F.col("event_id").alias("event_record_id"), F.expr(data).alias("data")))
    return out.select(F.col("event_record_id").alias("event_id"), F.col("`event.code`").alias("code"), F.col("`user.name`").alias("user_name"), F.col("`source.ip`").alias("source_ip"), F.col("`winlog.event_data`")["Flag"].alias("flag"))


@_query("select event_id from events where event_id % 100 in (1, 22, 46)")
def reduced_ids_filter(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 >= 0, F.col("event_id") % 100).alias("event.code"))
    return records.keep_event_ids(rows, [1, 22, 46]).select("event_id")


@_query("select event_id, make_timestamp(epoch_us(date_trunc('second', ts))) as parsed from events")
def epoch_scale(spark, d):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    scaled = F.when(F.col("event_id") % 3 == 0, seconds).when(F.col("event_id") % 3 == 1, seconds * 1000).otherwise(seconds * 1000000)
    return table(spark, d, "events").select("event_id", timeparse.epoch_scale(scaled).cast("timestamp_ntz").alias("parsed"))


# Indicators, rules, verdicts, hosts.

_IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
_IN = " or ".join(f"n between {(a := validators._number(f))} and {a + (1 << 32 - b) - 1}" for f, b in validators.NOT_GLOBAL)


@_query(
    f"""with v as (select distinct unnest(regexp_extract_all(text, '{_IP}')) as value from documents), n as (select value, regexp_matches(value, '{validators.IPV4}') as ok, list_transform(string_split(value, '.'), lambda x: x::bigint) as p from v),
    m as (select value, ok, p[1] * 16777216 + p[2] * 65536 + p[3] * 256 + p[4] as n from n) select value, ok as valid, ok and (not ({_IN}) or value in ('192.0.0.9', '192.0.0.10')) as external from m"""
)
def ioc_ip_extract(spark, d):
    found = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_IP), 0)).alias("value")).distinct()
    return found.select("value", F.col("value").rlike(validators.IPV4).alias("valid"), validators.is_external_ipv4(F.col("value")).alias("external"))


@_query(f"with v as (select distinct regexp_extract(url, '://([^/?#]*)', 1) || case when page_id % 5 = 0 then '.x-' when page_id % 7 = 0 then '.c0m' else '' end as value from pages) select value, length(value) <= 253 and regexp_matches(value, '{validators.DOMAIN}') as valid from v")
def ioc_domain_validate(spark, d):
    tail = F.when(F.col("page_id") % 5 == 0, F.lit(".x-")).when(F.col("page_id") % 7 == 0, F.lit(".c0m")).otherwise(F.lit(""))
    found = table(spark, d, "pages").select(F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), tail).alias("value")).distinct()
    return found.select("value", validators.is_domain(F.col("value")).alias("valid"))


@_query(f"with v as (select doc_id, case doc_id % 4 when 0 then sha256(text) when 1 then md5(text) when 2 then left(sha256(text), 40) else left(sha256(text), 39) end as value from documents) select doc_id, value, regexp_matches(value, '{validators.HASH}') as valid from v")
def ioc_hash_validate(spark, d):
    sha = F.sha2("text", 256)
    value = F.when(F.col("doc_id") % 4 == 0, sha).when(F.col("doc_id") % 4 == 1, F.md5(F.col("text").cast("binary"))).when(F.col("doc_id") % 4 == 2, F.left(sha, F.lit(40))).otherwise(F.left(sha, F.lit(39)))
    return table(spark, d, "documents").select("doc_id", value.alias("value")).withColumn("valid", validators.is_hash(F.col("value")))


_CONFIDENCE = [("src1", True, 95), ("src2", True, 40), ("src3", False, 0), ("src4", True, 80), ("src4", True, 10)]
_CONF_SPARK, _CONF_SQL = _values(_CONFIDENCE, "value, found, confidence")


@_query(f"select value, confidence, case when found and confidence >= 80 then 'MALICIOUS' when found then 'SUSPICIOUS' end as verdict from {_CONF_SQL}")
def intel_verdict(spark, d):
    return spark.sql(_CONF_SPARK).select("value", "confidence", enrich.intel_verdict(F.col("found"), F.col("confidence")).alias("verdict"))


@_query(f"with v as (select value, confidence, case when found and confidence >= 80 then 'MALICIOUS' when found then 'SUSPICIOUS' end as verdict from {_CONF_SQL}), b as (select * from v qualify row_number() over (partition by value order by case verdict when 'MALICIOUS' then 3 when 'SUSPICIOUS' then 2 else 0 end desc, confidence desc) = 1) select doc_id, verdict, confidence, case when value is not null then true end as checked from documents left join b on source = value")
def ioc_stamp(spark, d):
    verdicts = intel_verdict(spark, d)
    out = enrich.stamp(table(spark, d, "documents"), verdicts, "source", "threat_intel", ("verdict", "confidence"))
    return out.select("doc_id", F.col("`threat_intel.verdict`").alias("verdict"), F.col("`threat_intel.confidence`").alias("confidence"), F.col("`threat_intel.checked`").alias("checked"))


_TRIAGE = [("click", "UNKNOWN", "never seen"), ("error", "SUSPICIOUS", "odd path")]
_TRIAGE_SPARK, _TRIAGE_SQL = _values(_TRIAGE, "value, verdict, reason")


@_query(f"select event_id, verdict, reason from events left join {_TRIAGE_SQL} v on event_type = v.value")
def triage_stamp(spark, d):
    out = enrich.stamp(table(spark, d, "events"), spark.sql(_TRIAGE_SPARK), "event_type")
    return out.select("event_id", F.col("`triage.verdict`").alias("verdict"), F.col("`triage.reason`").alias("reason"))


_REGISTRY = [
    (1, r"HKLM\Software\Image File Execution Options\sethc.exe", "Debugger", "cmd.exe"), (2, r"HKLM\SilentProcessExit\x", "MonitorProcess", "m.exe"), (3, r"HKLM\CurrentVersion\Windows", "AppInit_DLLs", "a.dll"),
    (4, r"HKLM\Winlogon", "mpnotify", ""), (5, r"HKLM\Print\Monitors\p", "Driver", "localspl.dll"), (6, r"HKCU\Command Processor", "AutoRun", None), (7, r"HKCU\CurrentVersion\Windows", "Load", "l.exe"),
    (8, r"HKLM\Terminal Services", "InitialProgram", "i.exe"), (9, r"HKLM\Control\Lsa", "Security Packages", "Kerberos|evil wdigest"), (10, r"HKLM\Control\Lsa", "Security Packages", "kerberos msv1_0"),
    (11, r"HKLM\Winlogon", "Shell", r"C:\Windows\explorer.exe"), (12, r"HKLM\Winlogon", "Shell", "explorer.exe, x.exe"), (13, r"HKLM\Winlogon", "Userinit", r"C:\w\userinit.exe,"), (14, r"HKLM\Winlogon", "Userinit", r"C:\w\userinit.exe,bad.exe"),
    (15, r"HKLM\Session Manager", "BootExecute", "autocheck autochk *"), (16, r"HKLM\Session Manager", "BootExecute", "autocheck x"), (17, r"HKCU\Control Panel\Desktop", "SCRNSAVE.EXE", r"C:\Windows\System32\a.scr"),
    (18, r"HKCU\Control Panel\Desktop", "SCRNSAVE.EXE", r"C:\Temp\a.scr"), (19, r"HKCU\Control Panel\Desktop", "SCRNSAVE.EXE", "a.exe"), (20, r"HKLM\Software\Image File", "Debugger", "near miss"),
]
_REG_SPARK, _REG_SQL = _values(_REGISTRY, "id, KeyPath, ValueName, ValueData")
_LSA_IN = ", ".join(f"'{x}'" for x in enrich.LSA_DEFAULTS)


@_query(
    f"""with r as (select *, lower(trim(ValueData)) as p, list_filter(regexp_split_to_array(lower(trim(ValueData)), '[\\n| ]+'), lambda x: x <> '' and x not in ({_LSA_IN})) as odd from {_REG_SQL}) select id::integer as id, case when ValueData is null then null
    """ + " ".join(f"when contains(KeyPath, '{k}') and ValueName = '{v}' then '{w}' || ValueData" for k, v, w in enrich.REGISTRY_RULES) + r"""
    when contains(KeyPath, 'Control\Lsa') and ValueName in ('Authentication Packages', 'Security Packages', 'Notification Packages') and len(odd) > 0 then 'Non-default ' || ValueName || ': ' || array_to_string(odd, ', ')
    when contains(KeyPath, 'Winlogon') and ValueName = 'Shell' and p <> '' and string_split(p, '\')[-1] <> 'explorer.exe' then 'Winlogon Shell: ' || ValueData
    when contains(KeyPath, 'Winlogon') and ValueName = 'Userinit' and p <> '' and not ends_with(regexp_replace(p, ',$', ''), 'userinit.exe') then 'Winlogon Userinit: ' || ValueData
    when contains(KeyPath, 'Session Manager') and ValueName = 'BootExecute' and trim(ValueData) <> 'autocheck autochk *' then 'BootExecute: ' || trim(ValueData)
    when contains(KeyPath, 'Control Panel\Desktop') and ValueName = 'SCRNSAVE.EXE' and p <> '' and not ends_with(p, '.scr') then 'Screensaver non-.scr: ' || ValueData
    when contains(KeyPath, 'Control Panel\Desktop') and ValueName = 'SCRNSAVE.EXE' and contains(p, '\') and not contains(p, 'system32') and not contains(p, 'winsxs') then 'Screensaver outside System32: ' || ValueData end as reason from r"""
)
def registry_rules(spark, d):
    return enrich.registry_rules(spark.sql(_REG_SPARK)).select("id", F.col("`triage.reason`").alias("reason"))


_ALIAS = [("SRC1.", "host-a"), (" src2", "host-b"), ("src7", "host-a")]
_ALIAS_SPARK, _ALIAS_SQL = _values(_ALIAS, "alias, canonical")


@_query(f"select doc_id, coalesce(canonical, source) as host_id from documents left join {_ALIAS_SQL} a on lower(source) = regexp_replace(lower(trim(alias)), '\\.$', '')")
def host_resolve(spark, d):
    df = table(spark, d, "documents").withColumn("host.name", F.col("source"))
    return enrich.resolve_hosts(df, spark.sql(_ALIAS_SPARK)).select("doc_id", F.col("`host.id`").alias("host_id"))


@_query("with n as (select distinct c_name || case when c_custkey % 3 = 0 then '.Corp.Example.' when c_custkey % 3 = 1 then '-triage' else '' end as name, lower(trim(c_name)) as a from customer), h as (select distinct s_name as canonical, lower(trim(replace(s_name, 'Supplier', 'Customer'))) as b from supplier), s as (select name, canonical, 1 - levenshtein(a, b) / greatest(length(a), length(b), 1) as score from n, h) select name, replace(canonical, 'Supplier', 'Customer') as canonical, round(score, 6) as score from s where score >= 0.85 qualify row_number() over (partition by name order by score desc, canonical) = 1")
def host_propose(spark, d):
    hosts = table(spark, d, "supplier").select(F.regexp_replace("s_name", "Supplier", "Customer").alias("canonical"))
    tail = F.when(F.col("c_custkey") % 3 == 0, F.lit(".Corp.Example.")).when(F.col("c_custkey") % 3 == 1, F.lit("-triage")).otherwise(F.lit(""))
    names = table(spark, d, "customer").select(F.concat("c_name", tail).alias("name"))
    return enrich.propose_hosts(names, hosts, domains=("corp.example",)).withColumn("score", F.round("score", 6))


@_query("select doc_id, case when source = 'src1' then 'fixed' when doc_id % 2 = 0 then source end as host_id from documents")
def host_fix(spark, d):
    df = table(spark, d, "documents").withColumn("host.name", F.col("source")).withColumn("host.id", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    return enrich.fix_host(df, "src1", "fixed").select("doc_id", F.col("`host.id`").alias("host_id"))


@_query("select event_id, 'True' as yes, cast(json_extract_string(props, '$.k') as varchar) as k from events")
def coerce_scalars(spark, d):
    data = F.concat(F.lit('{"Event":{"EventData":{"yes":true,"k":'), F.try_variant_get(F.try_parse_json("props"), "$.k", "string"), F.lit("}}}"))
    out = records.event_records(table(spark, d, "events").select(F.col("event_id").alias("event_record_id"), data.alias("data")))
    return out.select(F.col("event_record_id").alias("event_id"), F.col("`winlog.event_data`")["yes"].alias("yes"), F.col("`winlog.event_data`")["k"].alias("k"))


# Spark's own relational operators.


@_query("select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey where o_orderdate >= timestamp '1995-01-01' group by 1")
def join_orders_customer(spark, d):
    o = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz '1995-01-01'")
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@_query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def semi_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@_query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@_query("select event_type, user_id, n from (select event_type, user_id, count(*) as n from events group by 1, 2) qualify row_number() over (partition by event_type order by n desc, user_id) <= 3")
def window_rank(spark, d):
    counts = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))).where("r <= 3").drop("r")


@_query("with g as (select *, case when ts - lag(ts) over w > interval 6 hours or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g) select user_id, session::bigint as session, count(*) as n, min(ts) as first_seen from s group by 1, 2")
def sessionize(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    rows = table(spark, d, "events").withColumn("new", F.when(gap.isNull() | (gap > F.expr("interval 6 hours")), 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))


@_query("select o_custkey as id from orders where o_totalprice > 100000 intersect select c_custkey from customer where c_acctbal > 0")
def set_intersect(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("id")).intersect(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@_query(
    """select event_id, ts - interval 1 hour as ts, 'u' || user_id as user_name, case when event_id % 2 = 0 then 'encoded' else 'interactive' end as session_type, 2::integer as commands, 'Get-' || event_type || chr(10) || 'out' as first_command, 90::bigint as seconds
    from (select event_id, user_id, event_type, date_trunc('second', ts) as ts from events)"""
)
def parse_transcript(spark, d):
    text = r"""concat('Start time: ', date_format(ts, 'yyyyMMddHHmmss'), '\r\nUsername: DOM\\u', user_id, '\r\nHost Application: C:\\x\\powershell.exe', case when event_id % 2 = 0 then ' -EncodedCommand abc' else '' end,
        '\r\n****\r\nnoise\r\nPS>Get-', event_type, '\r\nout\r\nPS>exit\r\n****\r\nEnd time: ', date_format(ts + interval 90 seconds, 'yyyyMMddHHmmss'), '\r\n')"""
    out = whole.transcripts(table(spark, d, "events").select("event_id", F.expr(text).alias("text")), "Etc/GMT-1")
    return out.select(
        "event_id", F.col("`@timestamp`").cast("timestamp_ntz").alias("ts"), F.col("`user.name`").alias("user_name"), F.col("`transcript.session_type`").alias("session_type"),
        F.col("`transcript.command_count`").alias("commands"), F.col("`transcript.commands`")[0].alias("first_command"), F.col("`transcript.duration_seconds`").alias("seconds"),
    )


@_query("select 0::integer as depth, r_regionkey::varchar as id, r_name as name from region union all select 1::integer, n_nationkey::varchar, n_name from nation")
def memory_flatten(spark, d):
    child = F.struct(F.col("n_nationkey").alias("PID"), F.col("n_name").alias("Name"), F.array().cast("array<string>").alias("__children"))
    nations = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(child).alias("__children"))
    tree = table(spark, d, "region").join(nations, "r_regionkey").select(F.to_json(F.array(F.struct(F.col("r_regionkey").alias("PID"), F.col("r_name").alias("Name"), "__children"))).alias("text"))
    out = whole.memory_records(tree.withColumn("plugin", F.lit("windows.pstree")))
    return out.select("depth", F.try_variant_get("record", "$.PID", "string").alias("id"), F.try_variant_get("record", "$.Name", "string").alias("name"))


@_query("select r_regionkey % 3 as file, n_nationkey::varchar as id, n_name as name from nation join region on n_regionkey = r_regionkey")
def json_array_items(spark, d):
    """Arrays, wrappers around an array, and tshark's wrapper around a document."""
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    items = both.groupBy((F.col("r_regionkey") % 3).alias("file")).agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("items"))
    plain, wrapped = F.to_json("items"), F.to_json(F.transform("items", lambda x: F.struct(x.alias("_source"))))
    text = F.when(F.col("file") == 0, plain).when(F.col("file") == 1, wrapped).otherwise(F.concat(F.lit('{"zz": '), plain, F.lit(', "aa": 1}')))
    out = whole.json_documents(items.select("file", text.alias("text")))
    return out.select("file", F.try_variant_get("doc", "$.n_nationkey", "string").alias("id"), F.try_variant_get("doc", "$.n_name", "string").alias("name"))


_ARTIFACTS = """select event_id, case event_id % 4 when 0 then 'evtx' when 1 then 'amcache' else 'registry' end as artifact, case when event_id % 8 = 0 then 4688 else 7000 end as `event.code`,
    case when event_id % 16 = 0 then 'nopath' else concat('C:/p', user_id) end as `process.name`, concat('C:/p', user_id) as FullPath,
    case event_id % 4 when 2 then concat('HKLM/Services/s', user_id, case when event_id % 3 = 0 then '/sub' else '' end) else case when event_id % 3 = 0 then 'HKLM/X/Run' else 'HKLM/Y' end end as k_,
    case when event_id % 4 = 2 then 'ImagePath' else 'v' end as ValueName, concat('d', user_id) as ValueData from {events}"""


def _artifacts(spark, d):
    table(spark, d, "events").createOrReplaceTempView("sedgewire_events")
    return spark.sql(_ARTIFACTS.format(events="sedgewire_events")).withColumn("KeyPath", F.replace("k_", F.lit("/"), F.lit("\\"))).drop("k_")


@_query(
    """select distinct 'file' as kind, 'C:/p' || user_id as value from events where event_id % 4 = 1 or (event_id % 8 = 0 and event_id % 16 <> 0)
    union select 'service', 's' || user_id from events where event_id % 4 = 2 union select 'run', 'd' || user_id from events where event_id % 4 = 3 and event_id % 3 = 0"""
)
def triage_questions(spark, d):
    return triage.questions(_artifacts(spark, d))


@_query(
    """with e as (select *, case when event_id % 4 = 1 or (event_id % 8 = 0 and event_id % 16 <> 0) then 'file' when event_id % 4 >= 2 and user_id % 5 = 0 then 'run' when event_id % 4 = 2 and user_id % 3 = 0 then 'service' end as kind from events)
    select event_id, case kind when 'file' then case when user_id % 2 = 0 then 'MALICIOUS' end when 'run' then 'SUSPICIOUS' when 'service' then 'EXPECTED' end as verdict, case when kind = 'file' and user_id % 2 <> 0 then null else kind end as reason from e"""
)
def triage_answers(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    v = users.select(F.explode(F.array(
        F.struct(F.lit("file").alias("kind"), F.concat(F.lit("C:/p"), "user_id").alias("value"), F.when(F.col("user_id") % 2 == 0, "MALICIOUS").alias("verdict")),
        F.struct(F.lit("file").alias("kind"), F.concat(F.lit("C:/p"), "user_id").alias("value"), F.when(F.col("user_id") % 2 == 0, "SUSPICIOUS").alias("verdict")),
        F.struct(F.lit("service").alias("kind"), F.concat(F.lit("s"), "user_id").alias("value"), F.when(F.col("user_id") % 3 == 0, "EXPECTED").alias("verdict")),
        F.struct(F.lit("run").alias("kind"), F.concat(F.lit("d"), "user_id").alias("value"), F.when(F.col("user_id") % 5 == 0, "SUSPICIOUS").alias("verdict")),
    )).alias("v")).select("v.*").withColumn("reason", F.col("kind")).withColumn("confidence", F.lit(90)).withColumn("lolbin", F.lit(False))
    out = triage.answered(_artifacts(spark, d), v)
    return out.select("event_id", F.col("`triage.verdict`").alias("verdict"), F.col("`triage.reason`").alias("reason"))


@_query("select event_id, event_type as level, ts from events where event_type like '%er%' order by ts desc, event_id limit 40")
def detections(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("level"), "ts")
    return triage.detections(rows, "ER", 40, level="level", ts="ts", ties=("event_id",))


@_query("select o_orderkey, o_orderdate as ts, substr(sha256('case-a-mft-h:' || o_orderkey::varchar || ':1:' || o_orderpriority || ':' || o_custkey::varchar), 1, 20) as _id from orders")
def tool_rows(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("EntryNumber"), F.lit("1").alias("SequenceNumber"), F.col("o_orderpriority").alias("FileName"), F.col("o_custkey").cast("string").alias("ParentEntryNumber"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Created0x10"), "o_orderkey",
    )
    out = catalog.tool_rows(rows, "mft", F.lit("case-a-mft-h"))
    return out.select("o_orderkey", F.col("`@timestamp`").cast("timestamp_ntz").alias("ts"), "_id")


# Files of each kind, written from the tables and read back.


@_query("select event_id::varchar as event_id, 'WS' || user_id as host_name, 'h' || user_id as source_host, date_trunc('second', ts) as ts, case when event_id % 3 = 0 then '' else 'a, \"b\"' end as note from events")
def parse_delimited(spark, d):
    path = scratch(spark, "csv")
    note = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.lit('a, "b"'))
    rows = table(spark, d, "events").select(F.col("event_id").cast("string"), F.concat(F.lit("WS"), "user_id").alias("Computer"), F.concat(F.lit("h"), "user_id").alias("host"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp_"), note.alias("note"))
    rows.withColumnRenamed("Timestamp_", "timestamp").write.options(header=True, escape='"').csv(path)
    out = records.delimited(spark, path)
    return out.select("event_id", F.col("`host.name`").alias("host_name"), "source_host", F.col("`@timestamp`").cast("timestamp_ntz").alias("ts"), "note")


@_query("select event_id, user_id::varchar as source_host, event_type, ts from (select event_id, user_id, event_type, date_trunc('second', ts) as ts from events) where event_id % 10 <> 0")
def parse_json_lines(spark, d):
    path = scratch(spark, "jsonl")
    inner = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "event_id", F.col("user_id").cast("string").alias("host"), "event_type")
    line = F.when(F.col("event_id") % 10 == 0, F.lit("no json")).when(F.col("event_id") % 3 == 0, F.to_json(F.struct(inner.alias("_source")))).otherwise(F.to_json(inner))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    out = records.json_lines(lines.numbered_lines(spark, path), "h")
    get = lambda k, t="string": F.try_variant_get("doc", f"$.{k}", t)
    return out.select(get("event_id", "bigint").alias("event_id"), "source_host", get("event_type").alias("event_type"), F.col("`@timestamp`").cast("timestamp_ntz").alias("ts"))


@_query("select (event_id - 1)::bigint as line_no, event_id::varchar as uid, case when user_id % 4 = 0 then null else 'u' || user_id end as orig, date_trunc('second', ts) as ts from (select row_number() over (order by event_id) as event_id, user_id, ts from events)")
def parse_zeek_log(spark, d):
    """The header's own field names, line by line of a file that is read in splits."""
    rows = table(spark, d, "events").withColumn("k", F.row_number().over(Window.orderBy("event_id")))
    head = spark.range(1).select(F.lit("f").alias("file"), F.lit(-1).cast("long").alias("line_no"), F.lit("#fields\tts\tuid\tid.orig_h").alias("line"))
    line = F.concat_ws("\t", F.unix_timestamp(F.col("ts").cast("timestamp")), "k", F.when(F.col("user_id") % 4 == 0, F.lit("-")).otherwise(F.concat(F.lit("u"), "user_id")))
    out = lines.zeek_log(head.union(rows.select(F.lit("f"), (F.col("k") - 1).cast("long"), line)))
    return out.select("line_no", F.try_element_at("fields", F.lit("uid")).alias("uid"), F.col("`source.ip`").alias("orig"), F.col("`@timestamp`").cast("timestamp_ntz").alias("ts"))


@_query("select o_orderkey, 'CORP/' || o_custkey as author, 'c' || o_orderkey || '.exe' as command, case when o_orderkey % 2 = 0 then 'HighestAvailable' end as run_level, 'CalendarTrigger,LogonTrigger' as triggers, case when o_orderkey % 3 = 0 then false end as enabled, o_orderkey % 5 = 0 as is_system, 't' || o_orderkey as name from orders where o_orderkey % 7 <> 0")
def parse_tasks(spark, d):
    xml = F.concat(
        F.lit('<?xml version="1.0"?><Task xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task"><RegistrationInfo><Author>CORP/'), F.col("o_custkey"), F.lit("</Author></RegistrationInfo><Triggers><CalendarTrigger/><LogonTrigger></LogonTrigger></Triggers>"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("<Principals><Principal><RunLevel>HighestAvailable</RunLevel></Principal></Principals>")).otherwise(F.lit("")),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("<Settings><Enabled>False</Enabled></Settings>")).otherwise(F.lit("")), F.lit("<Actions><Exec><Command>c"), F.col("o_orderkey"), F.lit(".exe</Command></Exec></Actions>"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("<broken>")).otherwise(F.lit("")), F.lit("</Task>"),
    )
    path = F.concat(F.lit("C:\\Windows\\System32\\Tasks\\"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("Microsoft\\")).otherwise(F.lit("Other\\")), F.lit("t"), F.col("o_orderkey"))
    out = records.scheduled_tasks(table(spark, d, "orders").select("o_orderkey", path.alias("path"), xml.alias("xml")))
    of = lambda k: F.col(f"`task.{k}`").alias(k)
    return out.select(F.substring(F.col("`task.name`"), 2, 20).cast("long").alias("o_orderkey"), of("author"), of("command"), of("run_level"), F.array_join(F.col("`task.trigger_types`"), ",").alias("triggers"), of("enabled"), of("is_system"), of("name"))


@_query("select 'r' || s_suppkey as report_dir, 'p' || s_suppkey || '.exe' as process, '1.' || s_nationkey as version, case when s_suppkey % 2 = 0 then 'SECOND' else 'APPCRASH' end as event_type from supplier")
def parse_wer(spark, d):
    text = F.concat(F.lit("Version=1\r\nEventType=APPCRASH\r\nSig[0].Value=p"), F.col("s_suppkey"), F.lit(".exe\r\nSig[1].Value = 1."), F.col("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("\r\nEventType=SECOND")).otherwise(F.lit("\r\nnothing")))
    out = records.error_reports(table(spark, d, "supplier").select(F.concat(F.lit("/v/r"), "s_suppkey", F.lit("/Report.wer")).alias("path"), F.lit(None).cast("timestamp").alias("modified"), text.alias("text")))
    return out.select(F.col("`wer.report_dir`").alias("report_dir"), F.col("`process.name`").alias("process"), F.col("`wer.app_version`").alias("version"), F.col("`wer.event_type`").alias("event_type"))


@_query("select user_id, event_type, max(event_id) as event_id, 'case-c-' || event_type || '-h' || user_id % 3 as index_name from events where event_type <> 'click' group by 1, 2")
def upsert_latest(spark, d):
    """Two upserts of the same identities, then the partitions of a pattern."""
    path = scratch(spark, "table")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.lit("c").alias("case_id"), F.col("event_type").alias("artifact"), F.concat(F.lit("h"), F.col("user_id") % 3).alias("host_part"), F.col("event_id").alias("ingest_seq"))
    index = ids.index_name(F.col("case_id"), F.col("artifact"), F.col("host_part"))
    rows = rows.withColumn("index_name", index).withColumn("_id", ids.natural_id(index, F.col("user_id")))
    store.upsert(spark, path, rows.where("event_id % 2 = 0"))
    store.upsert(spark, path, rows.where("event_id % 2 = 1 or event_id % 10 = 0"))
    out = store.read_case(spark, path, "case-c-*")
    return out.where("artifact <> 'click'").select("user_id", "event_type", "event_id", "index_name")


@_query("select event_id from events where event_id % 5 = 0 or (ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-09')")
def ingest_time_filter(spark, d):
    ts = F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp"))
    return table(spark, d, "events").where(timeparse.within(ts, "2024-01-05 00:00:00", "2024-01-09 00:00:00")).select("event_id")


@_query("select event_id, date_trunc('second', ts) - interval 3 hours as utc from events")
def zone_shift(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").select("event_id", timeparse.parse_time(text, resolve_zone("arab standard time")).cast("timestamp_ntz").alias("utc"))


@_query("select event_id from events where event_id % 3 <> 0 and event_type <> 'click'")
def field_exists(spark, d):
    rows = table(spark, d, "events").withColumn("threat.verdict", F.when(F.col("event_id") % 3 != 0, F.lit("x")))
    return search.matching(rows, "threat.verdict:* AND NOT event_type:click").select("event_id")


@_query("select event_id, case event_id % 4 when 0 then 'a' || user_id when 1 then 'b' when 2 then 'n' || user_id else null end as host from events")
def host_fields(spark, d):
    k = F.col("event_id") % 4
    record = F.when(k == 0, F.to_json(F.struct(F.lit("b").alias("Computer"), F.concat(F.lit(" a"), "user_id").alias("Host")))).when(k == 1, F.lit('{"Host":" ","Computer":"b"}'))
    record = record.when(k == 2, F.to_json(F.struct(F.struct(F.concat(F.lit("n"), "user_id").alias("Hostname")).alias("ClientInfo"), F.lit(5).alias("Host")))).otherwise(F.lit('{"host.name":"flat"}'))
    return table(spark, d, "events").withColumn("r", F.parse_json(record)).select("event_id", hosts.host_of(table(spark, d, "events"), "r").alias("host"))


@_query("select p_partkey, case when p_partkey % 2 = 0 then 'Windows/x' || p_partkey else 'y' || p_partkey end as path from part")
def evidence_paths(spark, d):
    full = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("file:/mnt/c/Windows/x"), "p_partkey")).otherwise(F.concat(F.lit("/elsewhere/y"), "p_partkey"))
    return table(spark, d, "part").select("p_partkey", folder.relative_path(full, "/mnt/c/").alias("path"))


@_query("select event_type as artifact, case when event_type = 'click' then 'c,event_id,ts' else 'event_id,ts,value' end as fields, 3::integer as n_fields from events group by 1")
def field_catalogue(spark, d):
    click = F.col("event_type") == "click"
    rows = table(spark, d, "events").select(F.col("event_type").alias("artifact"), "event_id", "ts", F.when(~click, F.col("value")).alias("value"), F.when(click, F.lit(1)).alias("c"), F.lit(None).cast("string").alias("never"))
    return search.catalogue(rows).withColumn("fields", F.array_join("fields", ","))


@_query(
    """with v as (select event_id, case when user_id % 7 = 0 then '8.8.8.' || user_id % 50 end as a, case when event_id % 11 = 0 then '8.8.8.' || event_id % 50 end as b from events),
    w as (select event_id, case when a is not null and split_part(a, '.', 4)::int % 2 = 0 then 2 when a is not null then 1 else 0 end as x, case when b is not null and split_part(b, '.', 4)::int % 2 = 0 then 2 when b is not null then 1 else 0 end as y from v)
    select event_id, case greatest(x, y) when 2 then 'MALICIOUS' when 1 then 'SUSPICIOUS' end as verdict, case when greatest(x, y) > 0 then true end as checked from w"""
)
def ioc_stamp_any(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("8.8.8."), F.col("user_id") % 50)).alias("source.ip"), F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("8.8.8."), F.col("event_id") % 50)).alias("destination.ip"))
    verdicts = spark.range(50).select(F.lit("ip").alias("type"), F.concat(F.lit("8.8.8."), "id").alias("value"), F.when(F.col("id") % 2 == 0, "MALICIOUS").otherwise("SUSPICIOUS").alias("verdict"), F.lit(90).alias("confidence"))
    return enrich.stamp_any(rows, verdicts).select("event_id", F.col("`threat_intel.verdict`").alias("verdict"), F.col("`threat_intel.checked`").alias("checked"))


@_query("select 'ip' as type, '10.1.' || user_id || '.1' as value, false as valid from events group by 2 union all select 'hash', md5(event_type), true from events group by 2")
def ioc_questions(spark, d):
    """What is not checked yet, each value once."""
    rows = table(spark, d, "events").select(F.concat(F.lit("10.1."), "user_id", F.lit(".1")).alias("source.ip"), F.md5(F.col("event_type").cast("binary")).alias("MD5"), F.when(F.col("user_id") < 0, F.lit(True)).alias("threat_intel.checked"))
    return enrich.indicators(rows).select("type", "value", "valid")


@_query("select distinct 'host' as kind, 'u' || user_id as value, case when user_id % 2 = 0 then 'first' else 'second' end as verdict from events")
def lookup_resumed(spark, d):
    path = scratch(spark, "verdicts")
    asked = table(spark, d, "events").select(F.lit("host").alias("kind"), F.concat(F.lit("u"), "user_id").alias("value"), "user_id")
    say = lambda what: lambda q: q.withColumn("verdict", F.lit(what))
    runs.lookup(spark, path, asked.where("user_id % 2 = 0"), say("first"))
    return runs.lookup(spark, path, asked, say("second"))


@_query("select lower(event_type) as name, case when event_type = 'click' then 'CLICK' else min(event_type) end as canonical, case when event_type = 'click' then 'mapped' else 'new' end as how from events group by event_type")
def host_classify(spark, d):
    names = table(spark, d, "events").select(F.col("event_type").alias("name"))
    return hosts.classify(names, spark.createDataFrame([("Click.", "CLICK")], "alias string, canonical string")).select("name", "canonical", "how")


@_query("select event_id, case event_id % 3 when 0 then 'stub' when 1 then 'netsh' else 'service' end as kind, case event_id % 3 when 0 then 's' || user_id when 1 then 'h' || user_id || '.DLL' else 'v' || user_id end as value from events where event_id % 3 < 2 or event_id % 2 = 0")
def triage_autostarts(spark, d):
    """Set-up stubs, network helpers and installed services, by the kind that each row asks about."""
    k = F.col("event_id") % 3
    rows = table(spark, d, "events").select(
        "event_id", F.when(k == 2, F.lit("evtx")).otherwise(F.lit("registry")).alias("artifact"), F.when(k == 0, F.lit("HKLM\\Active Setup\\Installed Components\\x")).when(k == 1, F.lit("HKLM\\NetSh")).alias("KeyPath"),
        F.when(k == 0, F.concat(F.lit("s"), "user_id")).alias("StubPath"), F.when(k == 1, F.concat(F.lit("h"), "user_id", F.lit(".DLL"))).alias("ValueData"), F.lit("v").alias("ValueName"),
        F.when(F.col("event_id") % 2 == 0, 7045).otherwise(1).alias("event.code"), F.when(k == 2, F.create_map(F.lit("ServiceName"), F.concat(F.lit("v"), "user_id"))).alias("winlog.event_data"),
    )
    asked = triage.keys(rows)
    each = F.array(*(F.struct(F.lit(x).alias("kind"), asked[x][0].alias("value")) for x in ("stub", "netsh", "service")))
    return rows.select("event_id", F.explode(each).alias("q")).select("event_id", "q.*").where("value is not null")


@_query("select event_type as artifact, count(*) as docs, count(*) filter (where value > 50) as checked, count(*) filter (where value > 90) as suspicious, 0::bigint as malicious from events group by 1")
def triage_counters(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("artifact"), (F.col("value") > 50).alias("triage.checked"), F.when(F.col("value") > 90, F.lit("SUSPICIOUS")).alias("triage.verdict"))
    return triage.counters(rows)


@_query("select n_nationkey, substr(sha256('case-a-vol-pslist-h:' || n_nationkey || ':2024-01-01'), 1, 20) as _id from nation")
def memory_ids(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.lit("windows.pslist").alias("plugin"), F.parse_json(F.to_json(F.struct(F.col("n_nationkey").alias("PID"), F.lit("2024-01-01").alias("CreateTime")))).alias("record"))
    return catalog.with_memory_id(rows, F.lit("case-a-vol-pslist-h")).select("n_nationkey", "_id")


@_query("select 'case-x-Security.evtx' || n_nationkey as path, 69632::bigint + n_nationkey as length from nation where n_nationkey % 2 = 0 and n_nationkey < 0 union all select '/l/Security.evtx', 69632::bigint + n_nationkey from nation where n_nationkey >= 10")
def reduced_logs(spark, d):
    rows = table(spark, d, "nation").select(F.lit("/l/Security.evtx").alias("path"), F.when(F.col("n_nationkey") >= 10, F.col("n_nationkey") + 69632).otherwise(F.col("n_nationkey")).cast("long").alias("length"))
    return catalog.reduced_logs(rows.union(rows.withColumn("path", F.lit("/l/Nothing%4Else.evtx"))))


@_query(
    "with r as (select n_nationkey * 1000 as lo, n_nationkey * 1000 + 399 + n_nationkey * 40 as hi, n_name from nation), e as (select event_id, user_id * 7 as ip from events) "
    "select event_id, (select arg_min(n_name, hi - lo) from r where ip between lo and hi) as place from e"
)
def address_ranges(spark, d):
    """Addresses in ranges of every width, some of which overlap: the narrowest that holds one names its place."""
    ip = lambda x: F.concat_ws(".", F.lit("10"), F.floor(x / 65536).cast("string"), (F.floor(x / 256) % 256).cast("string"), (x % 256).cast("string"))
    n = F.col("n_nationkey").cast("long")
    known = table(spark, d, "nation").select(ip(n * 1000).alias("first"), ip(n * 1000 + 399 + n * 40).alias("last"), F.col("n_name").alias("label"))
    rows = table(spark, d, "events").select("event_id", ip(F.col("user_id").cast("long") * 7).alias("source.ip"))
    return ranges.stamp_ranges(rows, known, "source.ip", "place").select("event_id", "place")


@_query("select event_id, event_type from events where event_type = 'error' or event_type = 'signup'")
def programs_deleted(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("event_type").alias("ExecutableName"))
    files = rows.select(F.initcap("event_type").alias("FileName"), (~F.col("event_type").isin("error", "signup")).cast("string").alias("InUse"))
    return ranges.run_then_deleted(rows, files).select("event_id", "event_type")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiled query, its terms and its timeline in one table."""
    e = table(spark, sf_dir, "events")
    hits = e.where(compile_query("event_type:(error OR signup) AND value:>=10", fields_of(e)))
    by_type = search.terms(hits, "event_type").select(F.lit("terms").alias("kind"), F.col("key"), "count")
    by_time = search.timeline(hits, "1d", ts="ts").select(F.lit("timeline").alias("kind"), F.col("bucket").cast("string").alias("key"), "count")
    return by_type.unionByName(by_time)
