"""Address ranges against brute force, and questions put to a service one by one."""

import ipaddress
import random

from pyspark.sql import functions as F

from sedgewire.operators import ranges, runs


def test_stamp_ranges_against_brute_force(spark):
    draw = random.Random(5)
    text = lambda n: str(ipaddress.IPv4Address(n))
    known = [("0.0.0.0", "255.255.255.255", "all"), ("9.9.9.9", "9.9.9.9", "one"), ("5.0.0.9", "5.0.0.1", "turned"), (None, "1.1.1.1", "open"), ("x", "y", "junk")]
    for k in range(60):
        first = draw.randrange(2**32)
        known.append((text(first), text(min(2**32 - 1, first + draw.randrange(1 << draw.randrange(1, 31)))), f"r{k}"))
    known += [(*known[-1][:2], "a tie")]
    ends = [x for r in known[5:] for x in r[:2]]
    asked = ends + [text(draw.randrange(2**32)) for _ in range(200)] + ["9.9.9.9", "255.255.255.255", "0.0.0.0", None, "", "1.2.3", "1.2.3.256", "01.2.3.4", "::1", " 9.9.9.9 "]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(asked)], "k int, `source.ip` string")
    got = {r.k: r.place for r in ranges.stamp_ranges(df, spark.createDataFrame(known, "first string, last string, label string"), "source.ip", "place").collect()}
    number = lambda x: int(ipaddress.IPv4Address(x))
    whole = [(number(a), number(b), c) for a, b, c in known if a and c != "junk"]
    assert len(got) == len(asked)
    for k, x in enumerate(asked):
        try:
            n = number(x.strip())
        except (ValueError, AttributeError):
            assert got[k] is None, x
            continue
        assert got[k] == min((b - a, c) for a, b, c in whole if a <= n <= b)[1], x


def test_blocks_cover_a_range_once(spark):
    rows = [(a, b) for a in range(0, 20) for b in range(a, 40)]
    cut = ranges.prefixes(spark.createDataFrame(rows, "first long, last long")).collect()
    covered = {}
    for r in cut:
        covered.setdefault((r.first, r.last), []).extend(range(r.block << r.low_bits, (r.block + 1) << r.low_bits))
    assert all(sorted(covered[a, b]) == list(range(a, b + 1)) for a, b in rows)


def test_stamp_ranges_without_rows(spark):
    none = spark.createDataFrame([], "first string, last string, label string")
    df = spark.createDataFrame([(1, "1.1.1.1"), (2, None)], "k int, ip string")
    assert [r.place for r in ranges.stamp_ranges(df, none, "ip", "place").collect()] == [None, None]
    assert ranges.stamp_ranges(df.limit(0), none, "ip", "place").count() == 0


def test_run_then_deleted(spark):
    mft = spark.createDataFrame([("a.exe", "False"), ("B.EXE", "True"), ("b.exe", "False"), ("c.exe", None), (None, "False")], "FileName string, InUse string")
    ran = spark.createDataFrame([("A.EXE",), ("B.EXE",), ("C.EXE",), ("D.EXE",), (None,)], "ExecutableName string")
    assert sorted(r.ExecutableName for r in ranges.run_then_deleted(ran, mft).collect()) == ["A.EXE", "C.EXE"]


def test_paced_lookup_waits_breaks_and_resumes(spark, tmp_path):
    asked = spark.createDataFrame([("ip", f"v{k}") for k in range(6)], "kind string, value string")
    schema, seen = "kind string, value string, verdict string", {}

    def busy(q):
        seen[q["value"]] = seen.get(q["value"], 0) + 1
        if q["value"] == "v1" and seen["v1"] == 1:
            raise runs.Wait(0)
        return None if q["value"] == "v5" else {"verdict": "fine"}

    def down(q):
        raise OSError("down")

    table = f"{tmp_path}/verdicts"
    assert runs.lookup(spark, table, asked, runs.paced(down, schema, 0.01, broken=2)).count() == 0
    got = runs.lookup(spark, table, asked, runs.paced(busy, schema, 0.01))
    assert sorted(r.value for r in got.where(F.col("verdict") == "fine").collect()) == ["v0", "v1", "v2", "v3", "v4"]
