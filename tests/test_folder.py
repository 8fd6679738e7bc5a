"""A folder of evidence end to end, and the tables beside it."""

import json

from pyspark.sql import functions as F

from sedgewire.operators import enrich, hosts, runs, search, store
from sedgewire.sources import folder
from tests.test_whole_files import ACCESS, MPLOG

TASK = '<Task xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task"><RegistrationInfo><Date>2023-01-01T00:00:00Z</Date></RegistrationInfo><Actions><Exec><Command>c</Command></Exec></Actions></Task>'


def evidence(root):
    files = {
        "web/access.log": ACCESS, "av/MPLog-1.log": MPLOG.encode("utf-16"), "iis/u_ex.log": "#Fields: date time c-ip\n2023-01-25 14:30:00 1.1.1.1\n2023-01-25 14:30:01 -\n", "zeek/conn.log": "#separator \\x09\n#fields\tts\tuid\n1674654601.0\tC1\n",
        "d/auth.tsv": "timestamp\tuser\thost\n2023-01-25T14:00:00Z\ta\tx\n2020-01-01T00:00:00Z\tb\ty\n", "d/rules.csv": "Timestamp,Computer,Level,RuleTitle\n2023-01-25 14:00:00,WS05,high,r\n", "d/body.txt": "0|/x|1|r|0|0|5|1674654600|1674654600|0|0\n", "d/p.psv": "a|b\n1|2\n",
        "j/eve.json": '{"timestamp":"2023-01-25T14:00:00Z","host":"h"}\n', "j/arr.json": "[\n{\"ts\": 1674654600}, {\"x\": 1}]", "ssh/sshd.log": "2023-01-25 14:30:00 sshd: Accepted publickey for u from 10.0.0.1 port 1 ssh2\n",
        "Tasks/Sync": TASK, "Tasks/bad": "<Task><a>", "wer/AppCrash/Report.wer": "EventType=APPCRASH\nSig[0].Value=x.exe\n", "notes.txt": "Permission is granted to all\nwho read, this.\n", "empty": "",
    }
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_a_folder_becomes_evidence(spark, tmp_path):
    evidence(tmp_path / "in")
    aliases = spark.createDataFrame([("ws05", "WS05.corp")], "alias string, canonical string")
    go = lambda k: folder.ingest_folder(spark, str(tmp_path / "in"), str(tmp_path / "table"), "c1", "H1", zone="UTC", start="2021-01-01", aliases=aliases, seq=k, notes=str(tmp_path / "notes"))
    made = go(0)
    indexed = {k: v.get("indexed") for k, v in made.items()}
    assert indexed == {"accesslog": 8, "defender": 7, "w3c": 2, "delim-zeek": 1, "delim": 2, "hayabusa": 1, "delim-bodyfile": 1, "json": 3, "ssh": 1, "tasks": 1, "wer": 1, "unknown": None} and made["unknown"]["files"] == 2
    df = store.read_case(spark, str(tmp_path / "table"), "case-c1-*")
    assert df.count() == 28 and df.where("_id is null or index_name is null").count() == 0
    assert {r["host.id"] for r in df.where("artifact = 'hayabusa'").collect()} == {"WS05.corp"} and {r["prov.source_file"] for r in df.where("artifact = 'tasks'").collect()} == {"Tasks/Sync"}
    assert {(r.artifact, r.state) for r in runs.status(spark, str(tmp_path / "notes")).collect()} == {(k, "complete") for k in indexed if k != "unknown"}
    fields = {r.artifact: r.fields for r in search.catalogue(df).collect()}
    assert "ssh.event_type" in fields["ssh"] and "ssh.event_type" not in fields["wer"]


def test_a_folder_read_again_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sshd.log").write_text("2023-01-25 14:30:00 sshd: Accepted publickey for u from 10.0.0.1 port 1 ssh2\n" * 2)
    for k in range(2):
        assert folder.ingest_folder(spark, str(tmp_path / "in"), str(tmp_path / "table"), "c1", "H1", zone="UTC", seq=k)["ssh"]["indexed"] == 2
    assert {(r.ingest_seq, r.line_no) for r in store.read_case(spark, str(tmp_path / "table"), "case-c1-ssh-h1").collect()} == {(1, 0), (1, 1)}


def test_kinds():
    assert folder.kind_of("x", b"one,two\n1,2\n") == "csv" and folder.kind_of("x", b"") is None and folder.kind_of("x/MPDetection-1.log", "x y".encode("utf-16")) == "defender"


def test_hosts_are_named_by_priority(spark):
    rows = [(json.dumps(x),) for x in ({"Computer": "c", "Host": " "}, {"ClientInfo": {"Hostname": "n"}, "host.name": "flat"}, {"Host": 5, "Hostname": " h "}, {"host": {"name": "s"}}, {"host.name": "flat"})]
    df = spark.createDataFrame(rows, "j string").withColumn("r", F.parse_json("j"))
    assert [r.h for r in df.select(hosts.host_of(df, "r").alias("h")).collect()] == ["c", "n", "h", "s", None]
    flat = spark.createDataFrame([("", "b", 1), ("a", "b", 1), (None, None, 1)], "Host string, Computer string, Hostname int")
    assert [r.h for r in flat.select(hosts.host_of(flat).alias("h")).collect()] == ["b", "a", None]


def test_the_dictionary_learns(spark, tmp_path):
    aliases = spark.createDataFrame([("WKSTN01", "wkstn01"), ("dc", "dc01.corp")], "alias string, canonical string")
    names = spark.createDataFrame([("wkstn01.",), ("wksn01",), ("WKSTN01.corp.example",), ("admin01-triage",), ("ADMIN01-triage",), ("",), (None,), ("a\x00b",), ("  ",)], "name string")
    got = {r.name: (r.canonical, r.how) for r in hosts.classify(names, aliases, domains=("corp.example",)).collect()}
    assert got == {"wkstn01.": ("wkstn01", "mapped"), "wksn01": ("wkstn01", "alias"), "WKSTN01.corp.example": ("wkstn01", "alias"), "admin01-triage": ("ADMIN01-triage", "new"), "ADMIN01-triage": ("ADMIN01-triage", "new")}
    path = str(tmp_path / "dictionary")
    assert hosts.load_dictionary(spark, path).count() == 0
    hosts.save_dictionary(spark, path, aliases)
    hosts.save_dictionary(spark, path, hosts.learnt(hosts.load_dictionary(spark, path), hosts.classify(names, aliases, domains=("corp.example",)), 0.9))
    assert {(r.alias, r.canonical) for r in hosts.load_dictionary(spark, path).collect()} == {("WKSTN01", "wkstn01"), ("dc", "dc01.corp"), ("WKSTN01.corp.example", "wkstn01"), ("ADMIN01-triage", "ADMIN01-triage")}


def test_long_names_meet_on_rare_grams(spark):
    import random

    r = random.Random(1)
    base = ["host-" + "".join(r.choice("abcdef0123") for _ in range(r.randint(3, 40))) for _ in range(60)]
    asked = []
    for k in range(150):
        x = list(r.choice(base))
        for _ in range(r.randint(0, 7)):
            at = r.randrange(len(x) + 1)
            x[at : at + r.randint(0, 1)] = [r.choice("abcdef0123")] * r.randint(0, 1)
        asked.append("".join(x))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for x in set(asked):
        scores = [(-(1 - distance(x, h) / max(len(x), len(h))), h) for h in set(base)]
        if (best := min(scores))[0] <= -0.85 + 1e-12:
            want[x] = (best[1], round(-best[0], 6))
    got = {q.name: (q.canonical, round(q.score, 6)) for q in enrich.propose_hosts(spark.createDataFrame([(x,) for x in asked], "name string"), spark.createDataFrame([(x,) for x in base], "canonical string")).collect()}
    assert got == want and len(want) > 60


def test_lookups_go_on_where_they_were(spark, tmp_path):
    asked = []

    def ask(df):
        asked.append(sorted(r.value for r in df.collect()))
        return df.withColumn("verdict", F.lit("MALICIOUS")).withColumn("confidence", F.lit(90))

    rows = lambda *v: spark.createDataFrame([("ip", x) for x in v], "kind string, value string")
    path = str(tmp_path / "verdicts")
    assert runs.lookup(spark, path, rows("a", "b", "b"), ask).count() == 2 and runs.lookup(spark, path, rows("b", "c"), ask).count() == 2
    assert asked == [["a", "b"], ["c"]] and spark.read.parquet(path).count() == 3


def test_any_field_of_a_type_is_stamped(spark):
    df = spark.createDataFrame([(1, "1.1.1.1", None), (2, None, "1.1.1.1"), (3, "2.2.2.2", "1.1.1.1"), (4, None, None)], "`id` int, `source.ip` string, `destination.ip` string")
    verdicts = spark.createDataFrame([("ip", "1.1.1.1", "SUSPICIOUS", 50), ("ip", "2.2.2.2", "MALICIOUS", 10), ("hash", "1.1.1.1", "MALICIOUS", 99), ("ip", "1.1.1.1", None, 99)], "type string, value string, verdict string, confidence int")
    got = {r.id: (r["threat_intel.verdict"], r["threat_intel.confidence"], r["threat_intel.checked"]) for r in enrich.stamp_any(df, verdicts).collect()}
    assert got == {1: ("SUSPICIOUS", 50, True), 2: ("SUSPICIOUS", 50, True), 3: ("MALICIOUS", 10, True), 4: (None, None, None)}


def test_an_end_stays_the_end(spark, tmp_path):
    for state in ("running", "failed", "running", "complete"):
        runs.note(spark, str(tmp_path / "n"), "r", "evtx", state)
    assert [r.state for r in runs.status(spark, str(tmp_path / "n")).collect()] == ["failed"]
