"""The document operators against brute force, on texts with nulls, ties, copies and awkward columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sedgewire.llm import common, line_dedup, minhash_dedup, mixing, packing, quality, tokens, training_order

VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))
#: Names that the operators use inside stand in the input, too.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, n_words string, kept int, removed string, key int, gone int, of int, n int"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def corpus(seed=3, n=120):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    common_lines = [line(12) for _ in range(4)]
    texts = []
    for _ in range(n):
        texts.append("\n".join([line(r.randint(1, 40)) for _ in range(r.randint(1, 5))] + [r.choice(common_lines)] * r.randint(0, 2)))
    for _ in range(n // 2):  # near copies: a few words changed, dropped or put in
        w = r.choice(texts[:20]).split(" ")
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 1)
        texts.append(" ".join(w))
    texts += [None, "", "  \n\t", "one", "One", "tiny text", "x" * 5000, "y " * 3000, "<|endoftext|> in a text", "文字 は 多い", texts[0], texts[0].upper(), "A! B! C! " * 30, "# $ % " * 40]
    rows = [(k if k % 50 else None if k == 50 else k, t, r.choice(["en", "de", None]), r.choice(["s1", "s1", "s2", "s3", None]), len(t or ""), 7, "w", 1, "r", 2, 3, 4, 5) for k, t in enumerate(texts)]
    return rows + [rows[5], rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(t, width=5):
    w = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    w = words(w)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows, percent):
    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min(least[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("percent", [85, 60])
def test_minhash(spark, docs, percent):
    got = minhash_dedup.near_documents(docs, percent).collect()
    want = brute_components(corpus(), percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_tiles_for_large_buckets(spark, monkeypatch):
    """With every bucket sent to the tiles, and tiles of a few documents, the links are the same."""
    monkeypatch.setattr(minhash_dedup, "FEW", 0)
    monkeypatch.setattr(minhash_dedup, "TILE_SHINGLES", 300)
    rows = corpus(5, 60)
    got = minhash_dedup.near_documents(spark.createDataFrame(rows, SCHEMA), 60).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, 60))


def test_pruning_keeps_true_links():
    least = minhash_dedup.least_matches(0.85)
    r = np.random.default_rng(0)
    left = r.integers(0, 1 << 32, (4000, minhash_dedup.HASHES), dtype=np.uint32)
    right = np.where(r.random(left.shape) < 0.85, left, left + 1)
    assert len(minhash_dedup.survivors(left, right, least)) == 4000
    assert len(minhash_dedup.survivors(left, np.where(r.random(left.shape) < 0.3, left, left + 1), least)) < 40


def test_keep_one(spark, docs):
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    want = {r[0] for r in brute_components(corpus(), 85) if r[0] is None or r[0] == r[2]}
    assert {r.doc_id for r in kept.collect()} == want


def test_keep_one_keeps_one_row_of_each_component(spark):
    text = [" ".join(f"{t}{k}" for k in range(60)) for t in "abcde"]
    near = text[0].replace("a59", "z")
    rows = [(None, text[0], "en"), (None, text[0], "en"), (None, near, "en"), (None, text[1], "en"), (7, text[1], "en"), (7, text[2], "en"), (9, text[2], "en"), (9, text[3], None), (8, text[4], "de"), (8, text[4], "de"), (8, text[4].upper(), "en"), (None, "", "en"), (None, "", "en"), (6, None, "en")]
    for order in (rows, rows[::-1]):
        got = [(r.doc_id, (r.text or "").lower()) for r in minhash_dedup.keep_one(spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)).collect()]
        first = [x for x in got if x[0] is None and x[1]]
        assert len(first) == 1 and first[0][1] in (text[0], near)
        assert Counter(x for x in got if x not in first) == Counter([(7, text[1]), (7, text[2]), (9, text[3]), (8, text[4]), (None, ""), (None, ""), (6, "")])


def test_shingles_of_long_texts_are_whole(monkeypatch):
    raw = " ".join(str(k) for k in range(3000)).encode()
    whole = common.shingles(raw)
    monkeypatch.setattr(common, "_PIECE", 100)
    assert len(whole) == 2996 and (common.shingles(raw) == whole).all()


def brute_lines(rows):
    lines, first = [], {}
    order = sorted({(r[0] if r[0] is not None else 1 << 62, r[1]) for r in rows if r[1]}, key=lambda x: x[0])
    for at, text in order:
        for k, line in enumerate(text.split("\n")):
            if w := tuple(words(line)):
                lines.append(((at, text), k, w))
                first.setdefault(w, len(lines))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        q = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
        return p + q >= max(len(a), len(b)) - 1

    long = [w for w in first if len(w) >= line_dedup.NEAR_WORDS]
    late = {a for a in long for b in long if a != b and first[b] < first[a] and near(a, b)}
    gone = defaultdict(list)
    for number, (doc, k, w) in enumerate(lines, 1):
        if w in late or first[w] != number:
            gone[doc].append(k)
    return gone


def test_lines(spark, docs):
    rows = [r for r in corpus() if r[0] is not None]
    gone = brute_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(map(len, gone.values())) > 50
    for r in got:
        assert r.removed == gone.get((r.doc_id, r.text), []), r.doc_id
        if r.text is not None:
            assert r.kept_text == "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in set(r.removed))


def test_nothing_hangs_on_broadcasts(spark, docs, monkeypatch):
    lines = lambda: Counter((r.doc_id, tuple(r.removed)) for r in line_dedup.dedup_lines(docs).collect())
    before = lines()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert lines() == before


def test_keep_lines_shape(spark, docs, empty):
    out = line_dedup.keep_lines(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert all(r.n_chars == len(r.text or "") or r.text is None for r in rows)
    assert {None, ""} <= {r.text for r in rows}  # nothing was removed from these
    assert line_dedup.keep_lines(empty).count() == 0


def test_quality_counts(spark, docs):
    got = quality.quality(docs).collect()
    assert len(got) == len(corpus())
    by_text = {}
    for t in {r[1] for r in corpus()}:
        w = words(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        full = [x for x in (t or "").split("\n") if words(x)]
        by_text[t] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), len(cover))
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter(by_text[r[1]] for r in corpus())
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_quality_verdicts(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(40)), "en", "s") for k in range(300)] + [(1000, " ".join(f"{j}%%%" for j in range(40)), "en", "s"), (1001, " ".join(f"AB{chr(65 + j)}C!!" for j in range(25)), "en", "s")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(300)) and not got[1000] and not got[1001]


def test_keep_quality_leaves_columns(spark, docs, empty):
    out = quality.keep_quality(docs)
    assert out.dtypes == docs.dtypes and {r.n_words for r in out.collect()} == {"w"}
    assert quality.keep_quality(empty).count() == 0 and quality.quality(empty).count() == 0


def filled(sizes, weights, share=1.5, most=2.0):
    """The targets by bisection on the level that all sources fill to."""
    order = sorted((x for x in sizes if x is not None)) + [x for x in sizes if x is None]
    weight = {x: weights[k % len(weights)] for k, x in enumerate(order)}
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * n, mid * weight[x]) for x, n in sizes.items()) < share * sum(sizes.values()) else (lo, mid)
    return {x: min(most * n, hi * weight[x]) for x, n in sizes.items()}


def test_mixing(spark, docs, empty):
    rows = corpus()
    got = mixing.mixed_words(docs, block_words=16, shard_blocks=40).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    goal = filled(dict(sizes), (3, 1, 2))
    source = {(r[0], len(words(r[1]))): r[3] for r in rows}
    taken = Counter()
    for r in got:
        taken[source[r.doc_id, r.size]] += r.taken
        assert r.source_size == sizes[source[r.doc_id, r.size]] and abs(r.target - goal[source[r.doc_id, r.size]]) < 1e-4
        assert (r.n_shards > 0) == (r.taken > 0) == (r.first_shard is not None)
    assert all(abs(taken[k] - goal[k]) <= 1 for k in sizes)
    again = mixing.mixed_words(docs, block_words=16, shard_blocks=40).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mixed_words(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_water_filling(spark):
    rows = [("b", 10, 1), ("a", 1000, 1), (None, 7, 1), ("Z", 0, 1), ("ä", 5, 1)]
    ranked = mixing.ranked_sources(spark.createDataFrame(rows, "source string, size long, n_blocks long")).collect()
    assert [r.source for r in sorted(ranked, key=lambda r: r.sid)] == ["Z", "a", "b", "ä", None]
    for sizes, weights in (([10, 1000], [3.0, 1.0]), ([5, 0, 9, 100], [1.0, 2.0, 0.0, 3.0]), ([4, 4], [1.0, 1.0]), ([0, 0], [1.0, 1.0]), ([1, 10, 100, 1000, 10_000], [5.0, 4.0, 3.0, 2.0, 1.0])):
        frame = spark.createDataFrame([(str(k), n, w) for k, (n, w) in enumerate(zip(sizes, weights, strict=True))], "source string, size long, weight double")
        got = [r.target for r in mixing.with_targets(frame).orderBy("source").collect()]
        level = 0.0
        for _ in range(400):  # upwards to the level where all is shared, or all are full
            now = [min(2.0 * n, level * w) for n, w in zip(sizes, weights, strict=True)]
            level += max(0.0, 1.5 * sum(sizes) - sum(now)) / sum(weights)
        assert got == pytest.approx(now, rel=1e-6, abs=1e-6), sizes


def test_weights_of_a_table(spark, docs):
    weights = spark.createDataFrame([("s1", 1.0), (None, 2.0)], "source string, weight double")
    got = mixing.mixed_words(docs, weights=weights, share=0.5, block_words=16).collect()
    source = {(r[0], len(words(r[1]))): r[3] for r in corpus()}
    assert {source[r.doc_id, r.size] for r in got if r.taken} == {"s1", None}


def test_splitting_tree(spark):
    counts = np.array([500, 0, 70, 1234])
    whole = list(mixing.shard_quotas(np.array([counts.sum()]), 0, counts, 11, 0, 11, 5))
    assert (sum(n for _, _, n in whole) == counts).all() and [k for k, _, _ in whole] == list(range(11))
    assert {int(n.sum()) for _, _, n in whole} <= {164, 163, 165}
    alone = next(mixing.shard_quotas(np.array([counts.sum()]), 0, counts, 11, 7, 8, 5))
    assert (alone[1] == whole[7][1]).all() and (alone[2] == whole[7][2]).all()
    assert (whole[7][1] == sum(n for _, _, n in whole[:7])).all()
    many = [(k, (k * 7919) % 23) for k in range(1300)]  # three groups of sources, two chunks of shards
    rows = mixing.split_quotas(spark.createDataFrame(many, "sid long, n long"), 300, 3).collect()
    of_source, of_shard = defaultdict(list), Counter()
    for r in rows:
        of_source[r.sid].append((r.shard, r.start, r.n))
        of_shard[r.shard] += r.n
    total = sum(n for _, n in many)
    assert all(of_shard[k] == total * (k + 1) // 300 - total * k // 300 for k in range(300))
    for sid, n in many:
        at = 0
        for _, start, part in sorted(of_source[sid]):
            assert start == at
            at += part
        assert at == n


def test_draws_follow_the_distribution():
    """Beyond a population of 10^9 against the exact probabilities, of whole numbers."""
    from fractions import Fraction
    from math import comb

    good, bad, draws, n = 6, 3 * 10**9, 10**9, 4000
    chance, p = [], Fraction(1)
    for k in range(good):  # none of the good is drawn
        p *= Fraction(good + bad - draws - k, good + bad - k)
    for k in range(good + 1):
        chance.append(float(p))
        p = p * (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1)) if k < good else p
    assert abs(sum(chance) - 1) < 1e-12 and comb(6, 3) == 20
    got = Counter(mixing.hypergeometric(np.random.default_rng(seed), good, bad, draws) for seed in range(n))
    assert sum((got[k] - n * c) ** 2 / (n * c) for k, c in enumerate(chance)) < 25
    big = [mixing.hypergeometric(np.random.default_rng(k), 10**12, 3 * 10**12, 10**6) for k in range(200)]
    assert abs(np.mean(big) - 250_000) < 150 and 0.75 < np.std(big) / (10**6 * 0.25 * 0.75) ** 0.5 < 1.25
    small = [mixing.hypergeometric(np.random.default_rng(k), 40, 60, 30) for k in range(2000)]
    own = mixing._LARGE
    try:
        mixing._LARGE = 1
        same = [mixing.hypergeometric(np.random.default_rng(k), 40, 60, 30) for k in range(2000)]
    finally:
        mixing._LARGE = own
    assert abs(np.mean(small) - np.mean(same)) < 0.3 and abs(np.std(small) - np.std(same)) < 0.2


def test_the_tree_decides_the_shards(spark, docs, monkeypatch):
    made = mixing.mix(docs.select("doc_id", "text", "source"), block_words=8, shard_blocks=40)
    rows = made.blocks.collect()
    assert len({(r.rid, r["pass"], r.block) for r in rows}) == len(rows) and len({r.shard for r in rows}) > 5
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    before = {r.rid: (r.taken, r.n) for r in made.blocks.groupBy("rid").agg(F.sum("words").alias("taken"), F.sum(F.col("shard") * F.col("words")).alias("n")).collect()}
    monkeypatch.setattr(mixing, "split_quotas", lambda sources, shards, seed: plain_split(spark, sources, shards))
    after = {r.rid: (r.taken, r.n) for r in mixing.mix(docs.select("doc_id", "text", "source"), block_words=8, shard_blocks=40).blocks.groupBy("rid").agg(F.sum("words").alias("taken"), F.sum(F.col("shard") * F.col("words")).alias("n")).collect()}
    assert {k: v[0] for k, v in before.items()} == {k: v[0] for k, v in after.items()} and before != after


def plain_split(spark, sources, shards):
    """Source after source, without any draw."""
    total, at, out = sum(r.n for r in sources.collect()), 0, []
    for r in sorted(sources.collect(), key=lambda r: r.sid):
        for k in range(shards):
            lo, hi = max(at, total * k // shards), min(at + r.n, total * (k + 1) // shards)
            if lo < hi:
                out.append((r.sid, k, lo - at, hi - lo))
        at += r.n
    return spark.createDataFrame(out, "sid long, shard long, start long, n long")


def test_mixed_documents_go_by_row(spark, docs, tmp_path):
    rows = corpus()
    rows = [(r[0] % 40 if r[0] is not None else None, *r[1:]) for r in rows]  # ids repeat, texts differ
    twice = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed_documents(twice, shard_blocks=30)
    assert out.columns == twice.columns
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    got = out.collect()
    for r in got:
        taken[r.source] += len(words(r.text))
    goal = filled(dict(sizes), (3, 1, 2))
    longest = max(len(words(r[1])) for r in rows)
    assert all(abs(taken[k] - goal[k]) <= longest for k in sizes)
    had, has = Counter(tuple(r) for r in rows), Counter(tuple(r) for r in got)
    assert all(n <= 2 * had[r] for r, n in has.items()) and set(has) <= set(had)
    assert Counter(tuple(r) for r in mixing.mixed_documents(twice, shard_blocks=30).collect()) == has
    mixing.write_mix(twice, f"{tmp_path}/mix", shard_blocks=30)
    written = spark.read.parquet(f"{tmp_path}/mix")
    assert Counter(tuple(r) for r in written.select(*twice.columns).collect()) == has and written.select("shard").distinct().count() == -(-len(got) // 30)


def test_a_task_takes_a_range_of_whole_shards(spark, docs, monkeypatch):
    """However many rows there are, and however few partitions a shuffle has."""
    monkeypatch.setattr(mixing, "TASK_SHARDS", 2)
    dealt, _ = mixing._dealt(docs, shard_blocks=5)
    rows = dealt.withColumn("task", F.spark_partition_id()).select("task", "shard_", "place_").collect()
    by = {}
    for r in rows:
        by.setdefault(r.task, []).append((r.shard_, r.place_))
    assert len(by) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = [({s for s, _ in by[t]}) for t in sorted(by)]
    assert all(len(x) <= 2 for x in ranges) and all(max(a) < min(b) for a, b in zip(ranges, ranges[1:]))
    assert all(x == sorted(x) for x in by.values())


ENCODER = Tokenizer.from_file(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z1é9.,'\n\t \x85\xa0\x1c\x1fœ!-sld文"), max_size=30) | st.text(max_size=20))
def test_token_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.token_ids(text, VOCABULARY).tolist() == ENCODER.encode(text, add_special_tokens=False).ids


def test_packing(spark, docs, empty):
    room = 64
    got = packing.packed(docs, VOCABULARY, room).collect()
    ids = Counter()
    for r in corpus():
        e = [*ENCODER.encode(r[1] or "", add_special_tokens=False).ids, 0]
        first = len(e) % room or room
        edges = [0, *range(first, len(e) + 1, room)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            ids[r[0], k, a, b - a, zlib.crc32(np.array(e[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ids
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    assert len(held) <= 1.03 * sum(r.length for r in got) / room + 1
    assert packing.packed(empty, VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_is_whole(counts):
    runs = packing.plan_runs(counts, 30)
    seen, fill = Counter(), Counter()
    for length, a, b, each, sequence, offset in runs.tolist():
        for k in range(a, b):
            seen[length, k] += 1
            fill[sequence + (k - a) // each] += length
            assert offset + (k - a) % each * length + length <= 30
    assert seen == Counter({(x, k): 1 for x, n in counts.items() for k in range(n)})
    assert not fill or max(fill.values()) <= 30


def test_dominance_fixes_exact_pairs():
    runs = packing.plan_runs({20: 3, 10: 3, 17: 2, 13: 2}, 30)
    assert (runs[:, 4] + runs[:, 2] - runs[:, 1]).max() == 5


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(training_order.feistel(np.arange(n), n, 9).tolist()) == list(range(n))


def test_training_order(spark, docs, empty):
    got = training_order.ordered(docs.repartition(3, "doc_id"), VOCABULARY, length=16, shard=50).collect()
    want = Counter()
    for r in corpus():
        e = [*ENCODER.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(e), 16):
            want[r[0], k // 16, len(e[k : k + 16]), zlib.crc32(np.array(e[k : k + 16], "<u2").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.n_tokens, r.ids_crc32) for r in got) == want
    assert sorted(r.slot for r in got) == list(range(len(got))) and all(r.shard == r.slot // 50 for r in got)
    assert training_order.ordered(empty, VOCABULARY).count() == 0


def test_training_resumes_at_any_slot(spark, docs, empty, tmp_path):
    """The order itself by brute force: the permutation over the sequences in the order of the input's splits."""
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    n = training_order.write_order(rows, VOCABULARY, f"{tmp_path}/out", length=16, shard=50, key=7)
    flat = []
    for r in rows.collect():
        e = [*ENCODER.encode(r.text or "", add_special_tokens=False).ids, 0]
        flat += [(r.doc_id, k // 16, e[k : k + 16]) for k in range(0, len(e), 16)]
    assert n == len(flat)
    want = dict(zip(training_order.feistel(np.arange(n), n, 7).tolist(), flat, strict=True))
    got = list(training_order.read_from(f"{tmp_path}/out"))
    assert [x[0] for x in got] == list(range(n)) and all((d, p, i.tolist()) == want[k] for k, d, p, i in got)
    for at in (1, 49, 50, 51, n - 1, n):
        assert [(k, d, p, i.tolist()) for k, d, p, i in training_order.read_from(f"file://{tmp_path}/out", at)] == [(k, d, p, i.tolist()) for k, d, p, i in got[at:]]
    assert training_order.write_order(empty, VOCABULARY, f"{tmp_path}/none") == 0 and list(training_order.read_from(f"{tmp_path}/none")) == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {r.node: r.root for r in got}
    assert len({root[k] for k in range(1, 61)}) == 1 and len({root[k] for k in range(100, 160)}) == 1 and root[200] == root[300]
    assert len(set(root.values())) == 3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    folder = tmp_path / "sf"
    rows = [(r[0] or 0, r[1], r[2], r[3], r[4]) for r in corpus(9, 80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(step(spark, docs, str(folder)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.count())
    assert len(rows) > seen[0] >= seen[1] >= seen[2] > 0
    out = corpus_pipeline.run(spark, str(folder)).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()}


def test_rewriting_a_text_of_many_lines_takes_linear_time(spark):
    from sedgewire.llm.line_dedup import dedup_lines

    text = "\n".join(["said twice"] * 2 + [f"line {k} stands alone" for k in range(40_000)])
    (row,) = dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.removed == [1] and row.kept_text == text.removeprefix("said twice\n")
