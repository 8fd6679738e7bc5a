"""Vectors, archives, extraction and url filters against brute force and round trips."""

import gzip
import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgewire.llm import embedding_dedup, html_extract, url_filter, warc


def test_vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 16))
    rows = []
    for k in range(150):
        v = (base[k % 12] + r.normal(scale=0.045, size=16) * (k % 3)) * (1 + k % 4)
        rows.append((k, [float(np.float32(x)) for x in v], k % 2))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [1.0, None], 0), (206, rows[0][1], None), (207, [], 1), (208, [1.0, 2.0], 1), (209, [2.0, 4.0], 1), (210, [1e-30, 2e-30], 1)]
    got = {x.vec_id: x for x in embedding_dedup.near_vectors(spark.createDataFrame([(*x, "c", 5) for x in rows], "vec_id long, embedding array<float>, label int, node string, n int"), tile=16).collect()}
    good = {k: np.array(v, np.float32).astype(float) for k, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {k: g for k, _, g in rows}
    links = {k: {j for j in good if j != k and label[j] == label[k] and len(good[j]) == len(good[k]) and good[j] @ good[k] / np.linalg.norm(good[j]) / np.linalg.norm(good[k]) >= 0.98} for k in good}
    assert sum(map(len, links.values())) > 100
    for k, *_ in rows:
        reach, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (len(links.get(k, ())), min(reach), k == min(reach)), k
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_bounds_of_codes_hold():
    r = np.random.default_rng(1)
    unit = embedding_dedup.unit_rows(r.normal(size=(1, 64)) + r.normal(scale=0.16, size=(300, 64)))
    coded = embedding_dedup.quantise(unit)
    sure, open_ = embedding_dedup.bounded_links(coded, coded, 0.98)
    true = unit @ unit.T >= 0.98
    assert (sure <= true).all() and (true <= (sure | open_)).all() and not (sure & open_).any()
    assert sure.any() and open_.any() and (true & open_).any() and not (sure | open_).all()


def test_captures(spark, tmp_path):
    long = "ä\r\n\r\nWARC/1.1\r\n<p>" + "x" * 200
    rows = [(1, "http://a/", long), (2, "http://b/ c\n", long), (3, None, None), (4, "http://d", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "z" * 100), (7, "u", "z" * 100), (None, "u", "q" * 300), (0, "u", "q" * 300)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, rid long, type string").write.parquet(f"{tmp_path}/p")
    got = warc.captures(spark.read.parquet(f"{tmp_path}/p")).collect()
    want = [(1, long, "response", None), (2, long, "revisit", 1), (3, "", "response", None), (4, "", "response", None), (5, "short", "response", None), (6, "short", "response", None), (7, "z" * 100, "response", None), (7, "z" * 100, "revisit", 7), (None, "q" * 300, "revisit", 0), (0, "q" * 300, "response", None)]
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to_page) for r in got), key=key) == sorted(((a, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), t, to) for a, h, t, to in want), key=key)
    assert all(r.request is not None and r.metadata is not None and r.response.uri and " " not in r.response.uri for r in got)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none")
    assert warc.captures(spark.read.parquet(f"{tmp_path}/none")).count() == 0


def test_archives_round_trip(spark, tmp_path):
    spark.createDataFrame([(1, "http://a/", "päge" * 50)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/p")
    warc.write_captures(spark.read.parquet(f"{tmp_path}/p"), f"{tmp_path}/w")
    one = warc.assemble(warc.read_records(spark, f"{tmp_path}/w")).collect()
    assert len(one) == 1 and bytes(one[0].response.payload).decode() == "päge" * 50 and "page_id: 1" in one[0].metadata.fields


def test_pages_that_change_between_readings_are_found_out(spark, tmp_path):
    html = F.udf(lambda: random.choice("abc") * 200).asNondeterministic()
    moving = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html().alias("html"))
    with pytest.raises(Exception, match="numbered otherwise"):
        warc.write_captures(moving, f"{tmp_path}/w")


def test_records_of_other_writers():
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    both = gzip.compress(raw) + gzip.compress(raw)
    assert [b for _, b in warc.parse_records(both)] == [block, block] == [b for _, b in warc.parse_records(raw + raw)]
    with pytest.raises(ValueError, match="within"):
        list(warc.parse_records(raw[:-20]))


PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One  two\n three, four.<p>Next one.<br>after</article><footer>x</footer></body>", "A & B\nOne two three, four.\nNext one.\nafter"),
    ("<body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies, a lot of cookies, on every page you see.</div><main><h1>T</h1><p>Long text, with commas, and more of it. And again.</p><aside>Other</aside><form><p>Mail</p></form><p>End.</p></main><section id=comments><p>First comment, long enough to matter, it says a lot.</p></section>", "T\nLong text, with commas, and more of it. And again.\nEnd."),
    ("<body><div id='menu'><ul><li><a href=1>Uno</a><li><a href=2>Dos</a></ul></div><div class='content'><h2>Head</h2><p>Some text here, that goes on for a while, and ends.</p><p>Short.</p><p>Some more text here, that goes on too, and ends.</p></div><div class='sidebar'><p>Side text here, that goes on for a while, and ends.</p></div></body>", "Head\nSome text here, that goes on for a while, and ends.\nShort.\nSome more text here, that goes on too, and ends."),
    ("<p>Bare <b>bold</b> text<script>var a = '<p>no</p>';</script><style>p{}</style> stays.</p>", "Bare bold text stays."),
    ("", ""), (None, ""), ("<div><", "<"), ("no markup at all", "no markup at all"), ("<nav>only a menu</nav>", ""), ("a<!-- unclosed <p>b", "a"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_extraction(page, text):
    assert html_extract.main_text(page) == text


def test_extraction_query(spark):
    df = spark.createDataFrame([(k, None, p, "t", 3) for k, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extracted(df).collect()}
    assert got == {k: (t, len(t)) for k, (_, t) in enumerate(PAGES)}
    assert html_extract.extracted(df.limit(0)).count() == 0


URLS = [
    ("http://Shop.Example.NET/en/1?x#y", "shop.example.net", "/en/1", "example.net/en/", "allow"), ("https://a.net", "a.net", "", None, "allow"), ("https://a.net/", "a.net", "/", "net/", "block"),
    ("http://example.com/de/x", "example.com", "/de/x", "example.com/de/", "block"), ("http://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"), ("ftp://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"),
    ("http://w.org?q=/fr/", "w.org", "", None, "allow"), (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("x://É.Com/#a", "É.com", "/", None, "allow"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u[0], 1, "h") for k, u in enumerate(URLS)], "page_id long, url string, n int, host string")
    none = spark.createDataFrame([], "url string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filtered(df, none).collect()}
    assert got == {k: tuple(u[1:]) for k, u in enumerate(URLS)}
    assert url_filter.filtered(df.limit(0), none).count() == 0


def test_url_templates(spark):
    rows = [(k, f"http://h.com/spam/{k}") for k in range(50)] + [(100 + k, f"http://h.com/good/{k}.html") for k in range(50)] + [(200 + k, f"http://h.com/tag/{'ab'[k % 2]}{chr(97 + k % 26)}{chr(97 + k // 26)}/z") for k in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = df.where("page_id < 30 or page_id between 100 and 140").withColumn("bad", (F.col("page_id") < 30).cast("int")).select("url", "bad")
    got = {r.page_id: r for r in url_filter.filtered(df, labels).collect()}
    assert {got[k].verdict for k in range(50)} == {"block"} and {got[100 + k].verdict for k in range(50)} == {"allow"}
    assert got[0].template == "spam/{n}" and got[100].template == "good/{n}.html" and got[200].template == "tag/aaa/z"


def sections(n, more=0):
    """Verdicts of the urls of n sections, one all bad, under a host; more sections have no labels."""
    part = lambda k: f"{chr(97 + k // 26)}{chr(97 + k % 26)}"
    rows = [(k * 1000 + i, f"http://h.com/{part(k)}/{i}") for k in range(n) for i in range(100 if k == 7 else 3)]
    labels = [(u, int(p // 1000 == 7)) for p, u in rows]
    return rows + [(k * 1000, f"http://h.com/{part(k)}/0") for k in range(n, n + more)], labels


@pytest.mark.parametrize("n, more", [(33, 0), (40, 30)])
def test_bad_sections_stand_apart_whatever_the_fan_out(spark, n, more):
    rows, labels = sections(n, more)
    got = url_filter.filtered(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "url string, bad int")).collect()
    verdicts = {(r.page_id // 1000 == 7, r.verdict) for r in got if r.page_id < n * 1000}
    assert verdicts == {(True, "block"), (False, "allow")}
    assert {r.template for r in got if r.page_id // 1000 == 7} == {"ah/{n}"}
    assert {r.template for r in got if r.page_id == 0} == {"*/{n}"}


def test_deep_branches_are_told_apart(spark):
    rows = [(k, f"http://h.com/de/a/b/c/{'spam' if k % 2 else 'news'}/x/y/{k}") for k in range(60)] + [(100, "http://h.com/de/a/b/c"), (101, "http://h.com/de/a/b/c/news/x/y/z/1/2/w/v")]
    labels = [(u, k % 2) for k, u in rows[:40]]
    got = {r.page_id: r for r in url_filter.filtered(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "url string, bad int")).collect()}
    assert all(got[k].verdict == ("block" if k % 2 else "allow") for k in range(60)) and got[101].verdict == "allow"
    assert (got[1].template, got[2].template, got[100].template, got[101].template) == ("de/a/b/c/spam/x/y/{n}", "de/a/b/c/news/x/y/*", "de/a/b/c", "de/a/b/c/news/x/y/*/{n}/{n}/w/v")


def fit(b, n):
    return sum(x * math.log(x) for x in (b, n - b) if x) - (n * math.log(n) if n else 0)


def apart(x, y, many):
    return x[1] > 0 and y[1] > 0 and fit(*x) + fit(*y) - fit(x[0] + y[0], x[1] + y[1]) > math.log(many / url_filter.ALPHA)


def judged_by(rows, pool, d=0):
    """{template: (bad, n)} that each template, a tuple of segments, is judged by: the tree by recursion. rows: [(template, shown, bad, n)]."""
    out = {t: pool for t, *_ in rows}
    live = [r for r in rows if len(r[1]) > d]
    if len(rows) < 2 or not sum(r[3] for r in rows) or not live:
        return out
    total = lambda some: (sum(r[-2] for r in some), sum(r[-1] for r in some))
    less = lambda p, q: (p[0] - q[0], p[1] - q[1])
    parts = {}
    for r in live:
        parts.setdefault(r[1][d], []).append(r)
    sums, whole = {k: total(v) for k, v in parts.items()}, total(live)
    many = max(1, sum(v[1] > 0 for v in sums.values()))
    side = {}
    for k, v in sums.items():
        rest = less(whole, v)
        side[k] = 0 if not apart(v, rest, many) else 1 if v[0] * rest[1] > rest[0] * v[1] else -1
    pools = lambda: {g: total([sums[k] for k in sums if side[k] == g]) for g in (1, 0, -1)}
    before = pools()
    side = {k: None if apart(sums[k], less(before[g], sums[k]), many) else g for k, g in side.items()}
    before = pools()
    side = {k: 0 if g in (1, -1) and before[0][1] and not apart(before[g], before[0], many) else g for k, g in side.items()}
    after, split = pools(), any(g != 0 for g in side.values())
    uneven = {}
    for k, v in parts.items():
        kids = {}
        for r in v:
            kids.setdefault(r[1][d + 1] if len(r[1]) > d + 1 else None, []).append(r)
        kids = [t for x in kids.values() if (t := total(x))[1]]
        gain = 2 * (sum(fit(*t) for t in kids) - fit(*sums[k]))
        uneven[k] = len(kids) > 1 and gain > len(kids) - 1 + 3 * math.sqrt(2 * (len(kids) - 1)) + 6
    named = {}
    for k, v in parts.items():
        mates = sum(g == side[k] and not uneven[j] for j, g in side.items())
        name = {1: "?+", 0: "?", -1: "?-"}[side[k]] if side[k] is not None and not uneven[k] and mates > 1 else k
        by = sums[k] if side[k] is None else after[side[k]] if split and after[side[k]][1] else pool
        named.setdefault((name, by), []).extend((r[0], (*r[1][:d], name, *r[1][d + 1 :]), *r[2:]) for r in v)
    for (_, by), v in named.items():
        out |= judged_by(v, by, d + 1)
    return out


def test_the_tree_by_brute_force(spark):
    """A host whose bad and good branches, of all depths and sizes, the tree has to find; it both blocks and rescues."""
    r = random.Random(5)
    leaves, rows, labels, number = {}, [], [], 0
    share = {"spam": 0.95, "deals": 0.9, "news": 0.02, "blog": 0.03, "wiki": 0.0, "mixed": 0.5}
    for host in ("one.com", "two.com"):
        for top in [*share, *(f"t{chr(97 + k)}" for k in range(12))]:
            for mid in ("a", "b", "cc", *(["spam", "ham"] if top == "mixed" else [])):
                for end in ("x", "yy"):
                    p = 0.9 if mid == "spam" else 0.02 if mid == "ham" else share.get(top, 0.03 if host == "one.com" else 0.8)
                    for _ in range(40 if mid in ("spam", "ham") else r.choice([1, 4, 25])):
                        number += 1
                        url = f"http://{host}/{top}/{mid}/{end}/{number}"
                        rows.append((number, url))
                        t = leaves.setdefault(host, {}).setdefault((top, mid, end, "{n}"), [0, 0])
                        if r.random() < 0.7:
                            bad = int(r.random() < p)
                            labels.append((url, bad))
                            t[0], t[1] = t[0] + bad, t[1] + 1
    got = url_filter.filtered(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "url string, bad int")).collect()
    prior = (sum(b for _, b in labels) + 1) / (len(labels) + 2)
    want = {}
    for host, known in leaves.items():
        flat = [(t, t, *v) for t, v in known.items()]
        for t, (b, n) in judged_by(flat, (sum(x[2] for x in flat), sum(x[3] for x in flat))).items():
            want[host, t] = round((b + url_filter.PRIOR * prior) / (n + url_filter.PRIOR), 6)
    url = dict(rows)
    seen, verdicts = {(x.host, (*url[x.page_id].split("/")[3:6], "{n}")): x for x in got}, {}
    assert set(seen) == set(want) and all(abs(x.purity - want[k]) < 2e-6 and (x.verdict == "block") == (x.purity > url_filter.BAD) for k, x in seen.items())
    for (host, t), x in seen.items():
        verdicts.setdefault((host, t[0] if t[0] in share else "other"), set()).add(x.verdict)
    for host, other in (("one.com", "allow"), ("two.com", "block")):
        assert verdicts[host, "spam"] == verdicts[host, "deals"] == {"block"} and verdicts[host, "news"] == verdicts[host, "wiki"] == {"allow"} and verdicts[host, "other"] == {other}
    assert verdicts["one.com", "mixed"] == verdicts["two.com", "mixed"] == {"allow", "block"}
    assert any("*" in x.template for x in got)


LONG = "A sentence of the body, that goes on for a while, and ends. " * 12
BODY = LONG.strip()
WHOLE_PAGES = [
    (f"<div class=post><h1>Title</h1><p>Lead.</p><div class=entry><p>{LONG}</p><p>{LONG}</p></div></div>", f"Title\nLead.\n{BODY}\n{BODY}"),
    (f"<div class=logo>Site</div><div class=top><h1>Title</h1><div class=by>By A. B.</div></div><div class=entry><h2>Part</h2><p>{LONG}</p><p>{LONG}</p></div>", f"Title\nBy A. B.\nPart\n{BODY}\n{BODY}"),
    (f"<main><h1>Title</h1><p>Intro, not long.</p><article><p>{LONG}</p></article></main>", f"Title\nIntro, not long.\n{BODY}"),
    (f"<div><article><h2>One</h2><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG}</p></article></div>", f"One\n{BODY}\nTwo\n{BODY}"),
    (f"<h1>Title</h1><article><p>{LONG}</p></article><div><a href=/x>Other things to read elsewhere</a></div>", f"Title\n{BODY}"),
]


@pytest.mark.parametrize("page, text", WHOLE_PAGES)
def test_headlines_leads_and_all_parts_are_kept(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("shell", ["article", "div"])
def test_topics_are_not_furniture(shell):
    parts = ['<section id="legal-status"><h3>Law</h3>', '<section id="discussion"><h2 id="related-work">Work</h2>', '<div class="search-and-rescue">']
    ends = ["</section>", "</section>", "</div>"]
    page = f"<{shell}><h1 id='comments'>T</h1><p>{LONG}</p>" + "".join(f"{a}<p>{k} {LONG}</p>{e}" for k, (a, e) in enumerate(zip(parts, ends, strict=True)))
    page += f"<div class='related-posts'><a href=/x>Another story of ours</a></div><div class='cookie-notice'><p>{LONG}</p></div><div class=share>Share this</div></{shell}>"
    assert html_extract.main_text(page) == f"T\n{BODY}\nLaw\n0 {BODY}\nWork\n1 {BODY}\n2 {BODY}"


@pytest.mark.parametrize("open_", ["<button>Share", "<svg><path d='x'>", "<select><option>One", "<object>", "<math><mi>x", "<video src=x>", "<canvas>"])
def test_what_is_not_closed_loses_nothing(open_):
    for page in (f"<article><h1>T</h1><div>{open_}</div><p>{LONG}</p></article>", f"<div>{open_}</div><article><h1>T</h1><p>{LONG}</p></article>", f"{open_}<article><h1>T</h1><p>{LONG}</p></article>"):
        assert html_extract.main_text(page) == f"T\n{BODY}", page
    assert html_extract.main_text(f"<article><p>One {open_}</p><p>{LONG}</p></article>") == f"One\n{BODY}"


def test_what_is_embedded_is_left_out():
    inner = "<button class=x><div>Label</div> more</button><svg><title>t</title><g><text>x</text></g></svg><select><option>One<option>Two</select><video><p>No video</p></video>"
    for one in (inner, "<button>a<br>b</button>", "<a href=x><svg><b>x</b></svg></a>", "<span><svg><path></span>", "<button><span>a</span><i>b</i></button>"):
        assert html_extract.main_text(f"<article><p>One {one} two.</p><p>{LONG}</p>{inner}</article>") in (f"One two.\n{BODY}", f"One x two.\n{BODY}"), one


def plain_page(r):
    """A page of div elements whose classes say nothing, and its main text."""
    words = lambda k: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(k))
    sentence = lambda: words(r.randint(6, 18)).capitalize() + r.choice([", " + words(4), ""]) + "."
    link = lambda k: f"<a href=/{words(1)}>{words(k)}</a>"
    menu = "<div class=m1>" + "".join(f"<div class=it>{link(r.randint(1, 2))}</div>" for _ in range(r.randint(3, 9))) + "</div>"
    side = "<div class=r>" + "".join(f"<div class=t>{link(r.randint(3, 6))}</div>" for _ in range(r.randint(2, 6))) + "</div>"
    low = "<div class=b>" + "".join(f"<span>{words(2)}</span> | {link(1)} " for _ in range(3)) + f"</div><div class=c>{words(3)}</div>"
    body = [("h1", words(5))]
    for k in range(r.randint(3, 9)):
        body += [("h2", words(3))] * (k > 1 and r.random() < 0.25) + [("p", " ".join(sentence() for _ in range(r.randint(2, 7))))]
    inner = "<div class=x1>" + "".join(f"<{t}>{x}</{t}>" for t, x in body) + "</div>"
    middle = inner + side if r.random() < 0.5 else side + inner
    return f"<html><body><div class=top><div class=l>{words(2)}</div>{menu}</div><div class=w>{middle}</div>{low}</body></html>", "\n".join(x for _, x in body)


def test_ratios_find_the_text_where_tags_say_nothing(monkeypatch):
    r = random.Random(2)
    pages = [plain_page(r) for _ in range(200)]
    right = lambda: sum(html_extract.main_text(page) == text for page, text in pages)
    assert right() >= 196
    monkeypatch.setattr(html_extract, "ratio", lambda *_: 1.0)
    assert right() == 0


def test_deep_and_long_pages_take_linear_time():
    for page in ("<div>" * 50_000 + f"<p>{LONG}</p>", "<div>some text, here. " * 20_000, "<div><p>text, here.</x></p></a></ul>" * 10_000, f"<article><p>{LONG * 2000}</p></article>"):
        began = time.perf_counter()
        assert html_extract.main_text(page)
        assert time.perf_counter() - began < 20


def test_repeated_pages_are_extracted_each(spark):
    rows = [(1, None, None), (1, "u", ""), (1, "u", f"<p>{LONG}</p>"), (1, "u", f"<p>{LONG}</p>"), (None, "u", "x")]
    got = html_extract.extracted(spark.createDataFrame([(*x, "t", 3) for x in rows], "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == [(0, "u", "x", 1), (1, "", "", 0), (1, "u", "", 0), (1, "u", BODY, len(BODY)), (1, "u", BODY, len(BODY))]
