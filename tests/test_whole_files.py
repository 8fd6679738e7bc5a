"""Whole-file sources, the catalogue, triage and the store's counters on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sedgewire.functions.zones import resolve_zone
from sedgewire.operators import store, triage
from sedgewire.sources import catalog, lines, records, whole

TRANSCRIPT = "\r\n".join([
    "****", "Start time: 20240701120000", "Username: DOM\\alice", "RunAs User: DOM\\bob", "Machine: WS1 (Microsoft Windows NT 10.0)", "Host Application: C:\\W\\powershell.exe -NonInteractive x y",
    "Process ID: 42", "PSVersion: 5.1", "****", "before", "PS>Get-Process", "row 1", "", ">> more", "****", "after", "PS>", "End time: 20240701120130", "****",
])


def test_transcripts(spark):
    df = spark.createDataFrame([("a", TRANSCRIPT), ("b", "Start time: 2024-07-01T12:00:00+02:00\nPS>x"), ("c", ""), ("d", None), ("e", "Start time: junk\nPS>x")], "path string, text string")
    rows = {r.path: r for r in whole.transcripts(df, resolve_zone("W. Europe Standard Time")).collect()}
    assert set(rows) == {"a", "b"}
    a = rows["a"].asDict()
    assert str(a["@timestamp"]) == "2024-07-01 10:00:00" and a["transcript.duration_seconds"] == 90
    assert a["transcript.commands"] == ["Get-Process\nrow 1\n", "more", ""] and a["transcript.command_count"] == 3
    assert (a["user.domain"], a["user.name"], a["user.runas"]) == ("DOM", "alice", "DOM\\bob")
    assert (a["transcript.machine"], a["host.os.version"], a["process.name"], a["process.args"]) == ("WS1", "Microsoft Windows NT 10.0", "powershell.exe", "-NonInteractive x y")
    assert (a["transcript.session_type"], a["process.pid"], a["transcript.ps_version"]) == ("noninteractive", 42, "5.1")
    assert str(rows["b"]["@timestamp"]) == "2024-07-01 10:00:00"
    assert [r.path for r in whole.transcripts(df).collect()] == ["b"]


def test_very_long_transcript(spark):
    text = "Start time: 20240701120000\n" + "PS>x\n" + "out\n" * 200_000
    (r,) = whole.transcripts(spark.createDataFrame([("a", text)], "path string, text string"), "UTC").collect()
    assert r["transcript.command_count"] == 1 and len(r["transcript.commands"][0]) == 1 + 4 * 200_000


@pytest.mark.parametrize("name, want", [("Eastern Standard Time", "America/New_York"), ("eastern standard time", "America/New_York"), ("Europe/Paris", "Europe/Paris"), ("nowhere", None), ("", None), (None, None)])
def test_zones(name, want):
    assert resolve_zone(name) == want


def test_memory(spark):
    deep = {"PID": 0, "__children": []}
    at = deep
    for k in range(1, 60):
        at["__children"] = [{"PID": k, "__children": []}]
        at = at["__children"][0]
    rows = [
        ("windows.pslist", json.dumps([{"PID": 1, "CreateTime": "2024-01-01T00:00:00", "__children": [{"PID": 2}]}, {"PID": 3}])), ("windows.handles", json.dumps([{"Type": "File"}, {"Type": "Token"}, {}])),
        ("timeliner", json.dumps({"columns": [{"name": "a"}, {"name": "b"}], "data": [[1, 2]]})), ("windows.info", "no json"), ("windows.ssdt", None), ("windows.pstree", json.dumps([deep])),
    ]
    found = whole.memory_records(spark.createDataFrame(rows, "plugin string, text string")).withColumn("record", F.to_json("record")).collect()
    by = {}
    for r in sorted(found, key=lambda r: r.seq):
        by.setdefault(r.artifact, []).append(json.loads(r.record))
    assert [x["PID"] for x in by["vol-pslist"]] == [1, 2, 3] and by["vol-handles"] == [{"Type": "File"}] and by["vol-timeliner"] == [{"a": 1, "b": 2}]
    assert set(by) == {"vol-pslist", "vol-handles", "vol-timeliner", "vol-pstree"} and len(by["vol-pstree"]) == 60
    assert str(next(r for r in found if r.artifact == "vol-pslist" and r.seq == 0)["@timestamp"]) == "2024-01-01 00:00:00"


def test_json_documents(spark):
    rows = [("array", '[{"a":1},{"a":2},3]'), ("wrapped", '{"zz":[{"a":3}],"aa":[{"a":9}]}'), ("single", '{"a":4}'), ("tshark", '[{"_source":{"a":5}}]'), ("junk", "{"), ("empty", ""), ("null", None)]
    out = whole.json_documents(spark.createDataFrame(rows, "path string, text string"))
    assert sorted((r.path, r.a) for r in out.select("path", F.try_variant_get("doc", "$.a", "int").alias("a")).collect()) == [("array", 1), ("array", 2), ("single", 4), ("tshark", 5), ("wrapped", 3)]


def test_manifest_and_discovery(spark, tmp_path):
    for p in ("WS1/C/windows/system32/CONFIG/SYSTEM", "WS1/C/$MFT", "WS1/C/Windows.old/x", "WS1/C/Users/ann/Desktop/a.lnk", "other/file"):
        at = tmp_path / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(p.encode())
    found = whole.discover(str(tmp_path))
    assert {(h, a) for h, a, _ in found} == {("WS1", "shimcache"), ("WS1", "registry_system"), ("WS1", "mft"), ("WS1", "shellbags"), ("WS1", "lnk")}
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in whole.manifest(spark, str(tmp_path)).collect()}
    assert sums["file"] == hashlib.sha256(b"other/file").hexdigest() and len(sums) == 5
    assert whole.hosts_in_names(["Tool-WS1", "b-x-ws1", "c-WS1", "d", "e-z"]) == {"ws1"}


def test_catalogue(spark):
    assert len(catalog.memory_plugins(1)) == 8 and len(catalog.memory_plugins(2)) == 17 and len(catalog.memory_plugins(3)) == 24
    assert catalog.sub_table("20260329224802_Amcache_Files") == "Amcache_Files" and catalog.sub_table("Amcache_Files") == "Amcache_Files"
    files = spark.createDataFrame([("C:\\l\\security.evtx", 70_000), ("/l/Security.evtx", 10), ("/l/Other.evtx", 70_000)], "path string, length long")
    assert [r.path for r in catalog.reduced_logs(files).collect()] == ["C:\\l\\security.evtx"]


def test_triage_of_absent_columns(spark):
    df = spark.createDataFrame([("registry", "HKLM\\NetSh", "X.DLL"), ("registry", "HKLM\\NetShell", None), ("amcache", None, None), (None, "a", "b")], "artifact string, KeyPath string, ValueData string")
    assert [(r.kind, r.value) for r in triage.questions(df).collect()] == [("netsh", "X.DLL")]
    v = spark.createDataFrame([("netsh", "X.DLL", "SUSPICIOUS", "r", 50, True)], "kind string, value string, verdict string, reason string, confidence int, lolbin boolean")
    done = triage.answered(df, v)
    assert sorted(str(r["triage.verdict"]) for r in done.collect()) == ["None", "None", "None", "SUSPICIOUS"]
    again = triage.answered(done, v.where("false"))  # earlier answers stay
    assert again.where("`triage.checked`").count() == 1 and again.columns.count("triage.verdict") == 1
    assert {r.artifact: r.suspicious for r in triage.counters(done).collect()} == {"registry": 1, "amcache": 0, None: 0}


def test_ingest_counts(spark, tmp_path):
    rows = [("c", "a", "h", "i", str(k % 5) if k % 4 else None, 1, k) for k in range(20)]
    df = spark.createDataFrame(rows, "case_id string, artifact string, host_part string, index_name string, _id string, ingest_seq int, n int")
    assert store.ingest(spark, str(tmp_path / "t"), df, F.col("n") < 10) == {"indexed": 7, "skipped": 5, "failed": 8}
    assert sorted(r._id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["0", "1", "2", "3", "4"]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_one_hot_identity(spark):
    df = spark.range(10_000).select(F.lit("k").alias("a"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("x"))
    assert [tuple(r) for r in store.latest(df, ["a"], ["seq"]).collect()] == [("k", 9999, None)]


def test_lines_of_split_files(spark, tmp_path):
    """Many small splits of a file: lines keep their numbers, headers and times carry over, as in one piece."""
    log = "".join(f"#Fields: date time c-ip f{k}\n" if k % 70 == 0 else f"2024-01-01 00:00:{k % 60:02d} 10.0.0.{k % 9} v{k}\n" if k % 13 else "bad\n" for k in range(1000))
    (tmp_path / "a.log").write_text(log)
    (tmp_path / "b.log").write_text("2024-01-01 00:00:00 10.0.0.1 early\n" + log[:500])
    (tmp_path / "c.log").write_text("".join(f"2024-01-01T00:00:{k % 60:02d}Z note\n" if k % 50 == 0 else f"Added exclusion: x{k}\n" for k in range(400)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        split = lines.numbered_lines(spark, str(tmp_path))
        assert split.select("file", "block").distinct().count() > 30
        got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in split.collect())
        web = [sorted(map(str, lines.w3c(x).collect())) for x in (split, split.drop("block"))]
        av = [sorted(map(str, lines.defender(x).collect())) for x in (split, split.drop("block"))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    want = sorted((p.name, k, line) for p in tmp_path.iterdir() for k, line in enumerate(p.read_text().splitlines()))
    assert got == want
    assert web[0] == web[1] and len(web[0]) > 900 and av[0] == av[1] and len(av[0]) == 392


def test_utf16_files(spark, tmp_path):
    (tmp_path / "MPLog-1.log").write_bytes("2024-01-01T00:00:00Z Added exclusion: C:/\u00fc\r\nRemoving exclusion: y".encode("utf-16"))
    (tmp_path / "plain").write_bytes(b"\xef\xbb\xbfab\xff")
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in whole.whole_files(spark, str(tmp_path)).collect()}
    assert texts["plain"] == "ab\ufffd"
    found = lines.defender(lines.sniffed_lines(whole.whole_files(spark, str(tmp_path)))).orderBy("line_no").collect()
    assert [r["defender.exclusion_path"] for r in found] == ["C:/\u00fc", "y"] and str(found[1]["@timestamp"]) == "2024-01-01 00:00:00"
    (tmp_path / "job").write_bytes('<?xml version="1.0" encoding="UTF-16"?><Task xmlns="u:x"><RegistrationInfo><Author>me</Author></RegistrationInfo></Task>'.encode("utf-16"))
    tasks = records.scheduled_tasks(whole.whole_files(spark, str(tmp_path / "job")).select("path", "text").withColumnRenamed("text", "xml"))
    assert tasks.first()["task.author"] == "me"


# Fixture lines, as the parsers meet them in the field.
ACCESS = """198.51.100.23 - - [25/Jan/2023:14:30:01 +0000] "POST /a.aspx HTTP/1.1" 200 1024 "-" "python-requests/2.28.1"
198.51.100.23 - jdoe-admin [25/Jan/2023:14:30:05 +0000] "GET /a.aspx HTTP/1.1" 200 512 "-" "Mozilla/5.0"
::1 - - [25/Jan/2023:14:30:10 +0000] "GET /health HTTP/1.1" 200 64 "-" "curl/7.88.1"
198.51.100.23 - - [25/Jan/2023:14:31:00 +0000] "POST /upload/x HTTP/1.1" 201 256 "-" "curl/7.88.1"
203.0.113.22 - - [25/Jan/2023:14:32:00 +0000] "GET /index.html HTTP/1.1" 200 4096 "-" "Mozilla/5.0"
198.51.100.23 - - [25/Jan/2023:14:33:00 +0000] "GET /admin/config HTTP/1.1" 403 - "https://bad-actor.example/ref" "python-requests/2.28.1"
10.0.0.1 - admin [25/Jan/2023:10:00:00 +0000] "GET /status HTTP/1.1" 200 512
10.0.0.2 - - [25/Jan/2023:10:01:00 +0000] "get /favicon.ico SPDY/3" 404 0 "-" "x" "and more"
no log line at all"""
MPLOG = """DETECTION_ADD Name: Early#
2023-01-17T14:30:00.000Z DETECTION_ADD Name: Trojan:Win32/Agent.X#ThreatType: Trojan#file: C:\\Windows\\System32\\updater.exe
2023-01-17T14:30:02.000Z process: C:\\Windows\\System32\\svchost.exe severity: Severe
2023-01-17T14:30:05.000Z Adding exclusion: C:\\Users\\x\\Temp
2023-01-17T14:30:08.000Z Removing exclusion: C:\\Users\\Public
2023-01-17T14:30:10.000Z DETECTION_CLEAN Name: Trojan:Win32/Agent.X#file: C:\\Windows\\System32\\updater.exe
2023-01-17T14:30:11.000Z DETECTION Behavior:Win32/Strike.E!sms behavior:process: C:\\a\\b.exe, pid:1234
2023-01-17T14:30:12.000Z DETECTION Trojan:Win32/Y regkey:HKLM\\Run"""


def test_fixture_lines(spark):
    numbered = lambda text: spark.createDataFrame([("f", k, x) for k, x in enumerate(text.splitlines())], "file string, line_no long, line string")
    web = lines.access_log(numbered(ACCESS)).orderBy("line_no").collect()
    assert len(web) == 8 and [r["http.response.status_code"] for r in web if r["source.ip"] == "198.51.100.23"] == [200, 200, 201, 403]
    assert web[0]["http.version"] == "HTTP/1.1" and web[7]["http.version"] == "SPDY/3" and web[7]["http.request.method"] == "get" and web[5]["http.response.bytes"] is None and web[6]["user_agent.original"] is None
    av = lines.defender(numbered(MPLOG)).orderBy("line_no").collect()
    assert [r["defender.event_type"] for r in av] == ["detection_add", "detection_add", "exclusion_added", "exclusion_removed", "detection_clean", "detection", "detection"]
    assert av[0]["@timestamp"] is None and av[1]["defender.threat_name"] == "Trojan:Win32/Agent.X" and av[1]["defender.threat_type"] == "Trojan" and av[4]["file.path"].endswith("updater.exe")
    assert (av[5]["defender.threat_name"], av[5]["defender.variant"], av[5]["process.executable"], av[5]["process.pid"]) == ("Strike.E", "sms", "C:\\a\\b.exe", 1234) and av[6]["registry.key"] == "HKLM\\Run"
    w3c = lines.w3c(numbered("#Fields: date time c-ip c-ip x\n2023-01-25 14:30:00 1.1.1.1 2.2.2.2 -\n2023-01-25 14:30\n")).collect()
    assert len(w3c) == 1 and w3c[0]["source.ip"] == "2.2.2.2" and "x" not in w3c[0].fields
    zeek = lines.zeek_log(numbered("#separator \\x09\n#fields\tts\tuid\tid.orig_h\n1674654601.000000\tC1\t10.0.0.1\n1674654603.5\t-\t10.0.0.2\nshort\n")).orderBy("line_no").collect()
    assert [(str(r["@timestamp"]), r["source.ip"], r.fields.get("uid")) for r in zeek] == [("2023-01-25 13:50:01", "10.0.0.1", "C1"), ("2023-01-25 13:50:03.500000", "10.0.0.2", None)]


def test_fixture_files(spark):
    task = """<?xml version="1.0" encoding="UTF-8"?><Task version="1.2" xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task"><RegistrationInfo><Author>CORP\\svc</Author><Description>sync</Description></RegistrationInfo>
      <Triggers><CalendarTrigger><StartBoundary>2023-01-25T06:00:00</StartBoundary></CalendarTrigger></Triggers><Principals><Principal><UserId>CORP\\svc</UserId><RunLevel>HighestAvailable</RunLevel></Principal></Principals>
      <Actions><Exec><Command>C:\\x.exe</Command><Arguments>-s -hidden</Arguments></Exec><Exec><Command>two</Command></Exec></Actions></Task>"""
    rows = [("C:\\Windows\\System32\\Tasks\\Sync", task), ("/v/tasks/Microsoft/Windows/U", task), ("/v/tasks/microsoft/x", task), ("/v/Tasks/Adobe/y", task), ("/v/tasks/bad", "<Task><a>"), ("/v/tasks/none", None), ("/v/tasks/text", "no xml")]
    got = {r.path: r for r in records.scheduled_tasks(spark.createDataFrame(rows, "path string, xml string")).collect()}
    assert {k.rsplit("\\", 1)[-1].rsplit("/", 1)[-1]: r["task.is_system"] for k, r in got.items()} == {"Sync": False, "U": True, "x": False, "y": True}
    one = got[rows[0][0]]
    assert (one["task.name"], one["task.trigger_types"], one["task.run_level"], one["task.command"], one["task.arguments"], one["task.enabled"], one["@timestamp"]) == ("Sync", ["CalendarTrigger"], "HighestAvailable", "C:\\x.exe", "-s -hidden", None, None)
    report = "Version=1\r\nEventType=APPCRASH\r\nSig[0].Value=updater.exe\r\nSig[1].Value=1.0.0.0\r\nSig[6].Value=c0000005\r\nDynamicSig[1].Value=10.0.19041.2\r\nEventType=LAST\r\nno pair"
    (wer,) = records.error_reports(spark.createDataFrame([("/v/wer/AppCrash_x/Report.wer", None, report)], "path string, modified timestamp, text string")).collect()
    assert (wer["wer.event_type"], wer["process.name"], wer["wer.app_version"], wer["wer.exception_code"], wer["wer.os_version"], wer["wer.report_dir"], wer["wer.full_text"]) == ("LAST", "updater.exe", "1.0.0.0", "c0000005", "10.0.19041.2", "AppCrash_x", report)
    data = [(1, '{"Event":{"System":{"EventID":1},"UserData":{"Zed":{"User":"z","#attributes":{}},"Abc":"x"}}}'), (2, '{"Event":{"System":{"EventID":1},"UserData":{"Zed":"s","Abc":{"User":"x"}}}}'), (3, "{}"), (4, "junk")]
    events = {r.event_record_id: r for r in records.event_records(spark.createDataFrame(data, "event_record_id long, data string")).collect()}
    assert events[1]["winlog.event_data"] == {"User": "z"} and events[1]["user.name"] == "z" and events[2]["winlog.event_data"]["Zed"] == "s" and set(events) == {1, 2, 3}


def test_words_of_all_alphabets(spark):
    from sedgewire.plans.querylang import compile_query, fields_of

    df = spark.createDataFrame([("über alles",), ("ber alles",), ("ÜBER",), ("x-ber",)], "text string")
    hits = lambda q: [r.text for r in df.where(compile_query(q, fields_of(df, {"text"}))).collect()]
    assert hits("text:ber") == ["ber alles", "x-ber"] and hits("text:über") == ["über alles", "ÜBER"]
