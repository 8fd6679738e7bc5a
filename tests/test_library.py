"""The query language, sources, enrichment and the store on small fixtures."""

import pytest
from pyspark.sql import functions as F

from sedgewire.functions import ids, timeparse, validators
from sedgewire.operators import enrich, search, store
from sedgewire.plans.querylang import QueryError, compile_query, fields_of
from sedgewire.sources import lines, records

EVENTS = [
    (1, "198.51.100.23", "svchost.exe", 200, "The quick Fox", '{"a":{"b":"x"}}', ["t1", "t2"], "2024-01-01 00:00:00", True),
    (2, "::1", "C:\\Windows\\cmd.exe", 404, "lazy dog", '{"a":"y"}', [], "2024-01-02 00:00:00", False),
    (3, None, "a*b", None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def events(spark):
    df = spark.createDataFrame(EVENTS, "id int, `source.ip` string, proc string, code int, msg string, raw string, tags array<string>, ts string, flag boolean")
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("doc", F.try_parse_json("raw")).withColumn("kv", F.create_map(F.lit("k"), F.col("proc")))


@pytest.mark.parametrize(
    "query, want",
    [
        ("*", [1, 2, 3]), ("", [1, 2, 3]), ("source.ip:198.51.100.23", [1]), ('source.ip:"::1"', [2]), ("source.ip.keyword:198.51.100.23", [1]), ("NOT source.ip:198.51.100.23", [2, 3]),
        ("code:200 AND flag:true", [1]), ("code:200 OR code:404", [1, 2]), ("code:200 code:404", [1, 2]), ("code:(200 OR 404) AND NOT flag:true", [2]), ("code:[200 TO 300]", [1]), ("code:{200 TO *]", [2]),
        ("code:>=404", [2]), ("code:<404", [1]), ("code:abc", []), ("proc:svchost", []), ("proc:svchost*", [1]), ("proc:*cmd.exe", [2]), ("proc:*.ex?", [1, 2]), (r"proc:a\*b", [3]), (r"proc:C\:\\Windows\\cmd.exe", [2]),
        ("msg:fox", [1]), ('msg:"quick fox"', [1]), ("msg:fo", []), ("msg:fo*", [1]), ("source.ip:*", [1, 2]), ("tags:t1", [1]), ("doc.a.b:x", [1]), ("doc.a:y", [2]), ("kv.k:svchost.exe", [1]), ("nofield:1", []),
        ("ts:[2024-01-01 TO 2024-01-01T12:00:00]", [1]), ("+code:200 flag:false", [1]), ("-code:200", [2, 3]), ("svchost.exe", [1]), ("proc:/sv.*exe/", [1]), ("(code:200 OR code:404) AND (flag:false)", [2]), ('"source.ip":"::1"', [2]), ("flag:true AND code:200 OR id:3", [1, 3]),
    ],
)
def test_query_language(events, query, want):
    fields = fields_of(events, {"msg"})
    assert sorted(r.id for r in events.where(compile_query(query, fields)).collect()) == want


@pytest.mark.parametrize("query", ["a:b~2", "a:b^3", "(a:b", "a:[1 TO", 'a:"x', "a:b)", "AND", '"x y"~3'])
def test_refused_queries(events, query):
    with pytest.raises(QueryError):
        compile_query(query, fields_of(events))


def test_wildcards_push_down(spark, tmp_path, events):
    events.select("id", "proc", "code").write.parquet(f"{tmp_path}/e")
    df = spark.read.parquet(f"{tmp_path}/e")
    plan = df.where(compile_query("proc:sv* AND code:200", fields_of(df)))._jdf.queryExecution().toString()
    assert "StringStartsWith(proc,sv)" in plan


def test_search_pages(events):
    assert [r.id for r in search.search(events, sort="code:asc", ties=["id"], ts="ts").collect()] == [1, 2, 3]
    assert [r.id for r in search.search(events, sort="code:sideways", ties=["id"], ts="ts").collect()] == [2, 1, 3]
    assert [r.id for r in search.search(events, limit=-5, ts="ts").collect()] == []
    assert search.search_page(events, "code:*", limit=1, ts="ts").total == 2
    assert [tuple(r) for r in search.terms(events, "tags").collect()] == [("t1", 1), ("t2", 1)]
    with pytest.raises(ValueError, match="interval"):
        search.timeline(events, "0h", ts="ts")


def test_access_log(spark):
    text = [
        '198.51.100.23 - - [25/Jan/2023:14:30:01 +0000] "GET /a HTTP/1.1" 200 10 "-" "agent"', '198.51.100.23 - bob [25/Jan/2023:14:30:02 +0200] "POST /b HTTP/1.1" 201 - "http://r" "-"',
        '::1 - - [25/Jan/2023:14:30:03 +0000] "GET /c HTTP/1.0" 403 5', "noise",
    ]
    df = lines.stamped(lines.access_log(spark.createDataFrame([(x,) for x in text], "line string")), "case-a-accesslog-h", "h", "access.log", "accesslog")
    got = lines.with_access_id(df).orderBy("`@timestamp`").collect()
    assert [(r["source.ip"], r["user.name"], r["http.response.status_code"], r["http.response.bytes"], r["user_agent.original"]) for r in got] == [("198.51.100.23", "bob", 201, None, "-"), ("198.51.100.23", None, 200, 10, "agent"), ("::1", None, 403, 5, None)]
    assert len({r._id for r in got}) == 3 and all(len(r._id) == 20 for r in got)
    terms = search.terms(lines.with_access_id(df), "http.response.status_code", query="source.ip:198.51.100.23")
    assert {tuple(r) for r in terms.collect()} == {(200, 1), (201, 1)}


def test_ssh_without_zone_has_no_rows(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00 sshd: Accepted publickey for a from 203.0.113.4 port 22 ssh2",)], "line string")
    assert lines.ssh(df, None).count() == 0
    row = lines.ssh(df, "America/New_York").first()
    assert row["ssh.auth_method"] == "publickey" and str(row["@timestamp"]) == "2024-01-01 15:00:00"


def test_w3c_needs_a_header(spark, tmp_path):
    (tmp_path / "x.log").write_text("#Fields: date time c-ip s-ip cs-uri-query\n2024-01-01 00:00:01 1.2.3.4 5.6.7.8 -\nbad line\n#Fields: date time src-ip\n2024-01-01 00:00:02 9.9.9.9\n")
    got = lines.w3c(lines.numbered_lines(spark, str(tmp_path)), "UTC").orderBy("line_no").collect()
    assert [(r.data_seq, r["source.ip"], r["destination.ip"]) for r in got] == [(1, "1.2.3.4", "5.6.7.8"), (3, "9.9.9.9", None)] and "cs-uri-query" not in got[0].fields


def test_event_records(spark):
    data = [
        '{"Event":{"System":{"EventID":{"#text":4624,"#attributes":{}},"Computer":"WS1","TimeCreated":{"#attributes":{"SystemTime":"2024-01-15T10:00:00Z"}}},"EventData":{"IpAddress":"-","Address":"1.2.3.4","Image":null,"NewProcessName":"n.exe"}}}',
        '{"Event":{"System":{"EventID":"21"},"EventData":null,"UserData":{"w":{"#attributes":{},"User":"u","Address":"8.8.8.8"}}}}', "not json",
    ]
    got = records.event_records(spark.createDataFrame(list(enumerate(data)), "event_record_id long, data string")).orderBy("event_record_id").collect()
    assert len(got) == 2
    assert (got[0]["event.code"], got[0]["source.ip"], got[0]["process.name"], str(got[0]["@timestamp"]), got[0]["winlog.provider_name"]) == (4624, None, None, "2024-01-15 10:00:00", "")
    assert (got[1]["event.code"], got[1]["user.name"], got[1]["source.ip"]) == (21, "u", "8.8.8.8")


def test_sniffers():
    assert records.sniff_delimited(["a\tb\tc", "1\t2\t3"]) == {"format": "tsv", "delimiter": "\t"}
    assert records.sniff_delimited(["#separator \\x09", "#fields\ta"])["format"] == "zeek"
    assert records.sniff_delimited(["0|/x|1|r|0|0|5|1|2|3|4"])["format"] == "bodyfile"
    assert records.sniff_delimited(["Permission is granted, free of charge, to any person", "obtaining a copy"])["format"] == "unknown"
    assert [records.sniff_json(x) for x in ('{"a":1}\n{"a":2}', "[1]", '{"a":1}', '{\n"a":1}', "x", "")] == ["jsonl", "json_array", "jsonl", "json_single", "unknown", "unknown"]


def test_json_lines_with_unstable_types(spark):
    df = spark.createDataFrame([(x,) for x in ('{"@timestamp":"2024-01-01T00:00:00Z","Labels":"x"}', '{"ts":1674654601.5,"Labels":["a"],"host":"h9"}', '{"Labels":{"t":1}}', "broken", '{"_source":{"Labels":null}}')], "line string")
    got = records.json_lines(df, "h").collect()
    assert len(got) == 4 and [str(r["@timestamp"]) for r in got][:2] == ["2024-01-01 00:00:00", "2023-01-25 13:50:01.500000"] and got[1].source_host == "h9"


def test_utf16_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('timestamp,host,KeyPath,Computer\n2024-01-01 00:00:00,x,"ROOT\\Run\\",\n'.encode("utf-16"))
    row = records.delimited(spark, str(tmp_path / "a.csv"), encoding="UTF-16", host="me").first()
    assert (row.KeyPath, row.source_host, row["host.name"], str(row["@timestamp"])) == ("ROOT\\Run\\", "x", "me", "2024-01-01 00:00:00")


def test_tasks_and_reports(spark):
    xml = '<?xml version="1.0" encoding="UTF-16"?><Task xmlns="http://x/y"><RegistrationInfo><Date>2024-01-01T00:00:00</Date><Author>me</Author></RegistrationInfo><Triggers><CalendarTrigger/><LogonTrigger>a</LogonTrigger></Triggers><Actions><Exec><Command>c.exe</Command></Exec></Actions></Task>'
    df = spark.createDataFrame([("System32/Tasks/Microsoft/x", xml), ("Tasks/evil", xml)], "path string, xml string")
    got = records.scheduled_tasks(df).collect()
    assert [(r["task.command"], r["task.trigger_types"], r["task.is_system"], r["@timestamp"]) for r in got] == [("c.exe", ["CalendarTrigger", "LogonTrigger"], True, None), ("c.exe", ["CalendarTrigger", "LogonTrigger"], False, None)]
    wer = records.error_reports(spark.createDataFrame([("p", None, "EventType=APPCRASH\r\nSig[0].Value=updater.exe\r\nx\r\nSig[6].Value=c0000005")], "path string, modified timestamp, text string")).first()
    assert (wer["wer.event_type"], wer["process.name"], wer["wer.exception_code"]) == ("APPCRASH", "updater.exe", "c0000005")


def test_indicators(spark):
    df = spark.createDataFrame([("8.8.8.8", "a" * 32, "ok.example.com"), ("10.0.0.1", "zz", "-bad.com"), ("2606:4700::1", None, "1.2.3.4"), ("fe80::1", None, "x_y.io")], "`source.ip` string, MD5 string, query string")
    got = {(r.type, r.value): r.valid for r in enrich.indicators(df).collect()}
    assert got == {("ip", "8.8.8.8"): True, ("ip", "10.0.0.1"): False, ("ip", "2606:4700::1"): True, ("ip", "fe80::1"): False, ("hash", "a" * 32): True, ("hash", "zz"): False, ("domain", "ok.example.com"): True, ("domain", "-bad.com"): False, ("domain", "1.2.3.4"): False, ("domain", "x_y.io"): True}


def test_external_ipv4_edges(spark):
    import ipaddress

    edges = [f"{n >> 24}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}" for a, b in validators.NOT_GLOBAL for n in (validators._number(a) - 1, validators._number(a), validators._number(a) + (1 << 32 - b) - 1, validators._number(a) + (1 << 32 - b)) if 0 <= n < 1 << 32]
    got = spark.createDataFrame([(x,) for x in [*edges, "192.0.0.9", "1.2.3", "256.1.1.1"]], "x string").select("x", validators.is_external_ipv4(F.col("x")).alias("v")).collect()
    for r in got:
        assert r.v == (r.x.count(".") == 3 and not r.x.startswith("256") and ipaddress.ip_address(r.x).is_global), r.x


def test_host_proposals(spark):
    names, hosts = spark.createDataFrame([("WKSN01",), ("wkstn01.",), ("zzz",)], "name string"), spark.createDataFrame([("wkstn01",), ("wkstn02",)], "canonical string")
    assert {(r.name, r.canonical) for r in enrich.propose_hosts(names, hosts).collect()} == {("WKSN01", "wkstn01"), ("wkstn01.", "wkstn01")}


def test_identity(spark):
    df = spark.createDataFrame([("a", None, "h1"), ("a", None, "h2"), ("a", "b", "h1")], "x string, y string, `host.name` string")
    got = [r.i for r in df.select(ids.content_id(F.lit("case-a"), df.columns).alias("i")).collect()]
    assert got[0] == got[1] != got[2]
    both = df.select(ids.natural_or_content_id(F.lit("i"), ["x", "y"], df.columns).alias("i")).collect()
    assert both[0].i != both[2].i and both[2].i == df.limit(1).select(ids.natural_id(F.lit("i"), F.lit("a"), F.lit("b")).alias("i")).first().i


def test_epochs(spark):
    got = spark.createDataFrame([("1674654601.0",), ("1674654601000",), ("1674654601000000",), ("nonsense",), ("2023-01-25T13:50:01Z",)], "x string").select(timeparse.parse_time(F.col("x")).alias("t")).collect()
    assert [str(r.t) for r in got] == ["2023-01-25 13:50:01"] * 3 + ["None", "2023-01-25 13:50:01"]


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda *r: spark.createDataFrame(list(r), "case_id string, artifact string, host_part string, index_name string, _id string, v int, ingest_seq int")
    store.upsert(spark, path, row(("A", "evtx", "h", "i", "1", 1, 1), ("A", "evtx", "h", "i", "2", 1, 1), ("B", "evtx", "h", "j", "1", 1, 1)))
    store.upsert(spark, path, row(("A", "evtx", "h", "i", "1", 9, 2), ("A", "evtx", "h", "i", "1", 8, 1)))
    got = {(r.case_id, r._id): r.v for r in store.read_case(spark, path).collect()}
    assert got == {("a", "1"): 9, ("a", "2"): 1, ("b", "1"): 1}
    assert store.read_case(spark, path, "case-a-*").count() == 2
    with pytest.raises(ValueError, match="case-"):
        store.read_case(spark, path, "secret")


def test_landing_stream(spark, tmp_path):
    from sedgewire.streaming.landing import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny\nx\n")

    def parse(df):
        return df.select(F.lit("c").alias("case_id"), F.lit("lines").alias("artifact"), F.lit("h").alias("host_part"), F.lit("i").alias("index_name"), ids.short_hash(F.col("line")).alias("_id"), "line")

    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "t"), parse, str(tmp_path / "cp")).awaitTermination()
    assert store.read_case(spark, str(tmp_path / "t")).count() == 2
