"""Host names proposed: against brute force, and without rows that grow with the names on the driver."""

import random

import pytest

from sedgewire.operators import enrich


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("least", "letters", "most"), [(0.85, "ab", 19), (0.6, "abé0", 8), (0.3, "ab", 4)])
def test_the_closest_of_all(spark, least, letters, most):
    r = random.Random(most)
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, most)))
    known = {word() for _ in range(40)}
    asked = {word() for _ in range(150)}
    for h in sorted(known):
        k = r.randrange(len(h))
        asked |= {h, h[:k] + r.choice(letters) + h[k:], h[1:] + r.choice(letters), h[:k] + h[k + 2 :], h[: k // 2] + r.choice(letters) + h[k // 2 + 1 : k] + r.choice(letters) + h[k + 1 :]}
    asked.discard("")
    want = {}
    for x in asked:
        score, best = min((-(1 - distance(x, h) / max(len(x), len(h))), h) for h in known)
        if -score >= least - 1e-12:
            want[x] = (best, round(-score, 6))
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in sorted(rows)], f"{c} string")
    got = enrich.propose_hosts(frame(asked, "name"), frame(known, "canonical"), least).collect()
    assert {q.name: (q.canonical, round(q.score, 6)) for q in got} == want and len(got) == len(want) > 30


def broadcast_rows(plan):
    """The most rows that a broadcast of a plan that has run holds."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return broadcast_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return broadcast_rows(plan.plan())
    rows = plan.metrics().apply("numOutputRows").value() if kind == "BroadcastExchangeExec" else 0
    return max([rows, *(broadcast_rows(plan.children().apply(k)) for k in range(plan.children().size()))])


def test_what_is_left_of_names_is_never_broadcast(spark):
    known = spark.range(300).selectExpr("format_string('Customer#%09d', id) as canonical")
    names = spark.range(1000).selectExpr("format_string('Customer#%09d', id) as name")
    found = enrich.propose_hosts(names, known)
    assert len(found.collect()) == 1000
    assert broadcast_rows(found._jdf.queryExecution().executedPlan()) <= 300
