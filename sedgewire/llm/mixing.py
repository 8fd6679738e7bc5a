"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Texts are cut into blocks of words. Per source and pass a seeded hash permutes the blocks; passes below the target
take every block, the last one as many as meet the target (its last block is cut there; whole documents: as near as
they come). These exact block quotas are split among output shards by a binary tree: each node draws, from
generators keyed by seed and node, how many of its blocks of each source go left (multivariate hypergeometric). A
shard then owns a range of each source's permutation: its blocks are disjoint from all others', and a second hash
orders them within the shard. mixed_words tells the shards of each document, mixed_documents and write_mix give the
documents shard by shard in that order.

Sources are dealt to groups of GROUP. A node first splits the totals of the groups, then the sources within one; given
the groups' shares these are independent draws of the same kind, so the result is one draw over all sources, and a
task needs the totals of all groups and the counts of one. Any task can walk to any shards alone. Sources are ranked,
weighed and given targets as a table, whatever their number; one number for each GROUP of them reaches the driver.

Ranks in the permutation come from counts of hash ranges plus a rank within a range of about RANGE blocks, so a
source with a third of all rows is dealt over many tasks. Defined results: null or empty texts have size 0 and are
never taken; a null source is a source, the last in order; rows that repeat a doc_id are mixed each, rows equal in all
columns are as one another; an empty table mixes to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewire.llm.common import WORD, guarded, if_small, row_marks, running, stage

BLOCK_WORDS = 512
SHARD_BLOCKS = 4096
#: Shards that one task writes.
TASK_SHARDS = 4
RANGE = 2_000
#: Sources that are split together, and shards that one task walks to.
GROUP, CHUNK = 512, 256
_QUOTA = "sid long, shard long, start long, n long"
#: Population from which numpy's sampler is out of range.
_LARGE = 10**9


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with sid, their rank by code point, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = stage(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    starts = running(ranged.groupBy("part").agg(F.count("*").alias("n")), [], "part", "n").select("part", "before_n")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("place", place).join(starts, "part").select(*sources.columns, (F.col("before_n") + F.col("place") - 1).alias("sid"))


def with_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (size, weight, ...) with target: share of all sizes by weight, at most `most` times a source's own size;
    what is over is reshared by weight until none is above. Each round sets the level all others fill to."""
    open_ = (F.col("size") > 0) & (F.col("weight") > 0)
    cap = most * F.col("size")
    total = sources.agg(F.sum("size").alias("s")).first()["s"] or 0
    level, full = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > cap
        r = sources.where(open_).agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("size"))).alias("s"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if not r["w"] or full == r["n"] and level:
            break
        level, full = (share * total - most * (r["s"] or 0)) / r["w"], r["n"]
    over = F.lit(level) * F.col("weight") > cap
    goal = F.when(~open_, F.lit(0.0)).when(over, cap).otherwise(F.lit(level) * F.col("weight"))
    return sources.withColumn("target", goal)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` are good. Beyond the range of numpy's sampler the distribution itself is summed outwards from
    its mode, each probability from the one before by their exact ratio, to where what is left is below any double."""
    if not draws or not good:
        return 0
    if not bad:
        return draws
    if good + bad < _LARGE:
        return int(rng.hypergeometric(good, bad, draws))
    whole = good + bad
    least, greatest = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (whole + 2), least), greatest)
    reach = 64 + int(14 * (draws * (good / whole) * (bad / whole) * ((whole - draws) / (whole - 1))) ** 0.5)
    lo, hi = max(least, mode - reach), min(greatest, mode + reach)
    k = np.arange(lo, hi)
    step = lambda x: x.astype(np.float64)
    ratio = np.log(step(good - k)) + np.log(step(draws - k)) - np.log(step(k + 1)) - np.log(step(bad - draws + k + 1))
    log = np.concatenate([[0.0], np.cumsum(ratio)])
    upto = np.cumsum(np.exp(log - log[mode - lo]))
    return lo + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


def draw(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """One multivariate hypergeometric draw, source by source."""
    out, left = np.zeros(len(counts), np.int64), int(counts.sum())
    for k, n in enumerate(counts.tolist()):
        if not draws:
            break
        left -= n
        out[k] = hypergeometric(rng, n, left, draws)
        draws -= int(out[k])
    return out


def shard_quotas(totals: np.ndarray, group: int, counts: np.ndarray, shards: int, lo: int, hi: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, start, n) for shards lo to hi - 1 of all: the blocks of each source of a group before the shard and in it.
    totals are the blocks of all groups, counts those of the group's sources."""
    whole = int(totals.sum())
    upto = lambda k: whole * k // shards  # noqa: E731  blocks in the first k shards
    tool = lambda node, k: np.random.Generator(np.random.Philox(counter=k << 192, key=[seed, node]))

    def walk(a: int, b: int, node: int, of_groups: np.ndarray, before: np.ndarray, own: np.ndarray):
        if b <= lo or a >= hi:
            return
        if b - a == 1:
            yield a, before, own
            return
        mid = (a + b) // 2
        left_groups = draw(tool(node, 0), of_groups, upto(mid) - upto(a))
        left = draw(tool(node, group + 1), own, int(left_groups[group]))
        yield from walk(a, mid, 2 * node, left_groups, before, left)
        yield from walk(mid, b, 2 * node + 1, of_groups - left_groups, before + left, own - left)

    yield from walk(0, shards, 1, totals, np.zeros_like(counts), counts)


def _quotas(totals: list[int], shards: int, seed: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group, chunk = (x.as_py() for x in key)
        sid, counts = (table.column(c).to_numpy() for c in ("sid", "n"))
        order = np.argsort(sid)
        sid, counts = sid[order], counts[order].astype(np.int64)
        parts = []
        for shard, start, n in shard_quotas(np.array(totals, np.int64), group, counts, shards, chunk * CHUNK, min(shards, (chunk + 1) * CHUNK), seed):
            has = np.flatnonzero(n)
            parts.append((sid[has], np.full(len(has), shard, np.int64), start[has], n[has]))
        return pa.table({name: pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k, name in enumerate(("sid", "shard", "start", "n"))})

    return run


def split_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sid, shard, start, n): the tree over all sources (sid, n), sid dense from 0."""
    grouped = sources.select("sid", "n", F.floor(F.col("sid") / GROUP).alias("grp"))
    totals = [r["n"] for r in grouped.groupBy("grp").agg(F.sum("n").alias("n")).orderBy("grp").collect()]  # one for each GROUP sources
    chunks = F.explode(F.sequence(F.lit(0), F.lit(ceil(shards / CHUNK) - 1)))
    return grouped.withColumn("chunk", chunks).groupBy("grp", "chunk").applyInArrow(_quotas(totals, shards, seed), _QUOTA)


class Mix:
    """sizes: the documents with rid, size, source_size, target. blocks: every drawn block with its shard (rid, doc_id,
    sid, pass, block, words, shard, place, mark1_, mark2_); place orders a shard, the marks tell a row by its columns.
    shards: their number."""

    def __init__(self, sizes: DataFrame, blocks: DataFrame, shards: int):
        self.sizes, self.blocks, self.shards = sizes, blocks, shards


_MARKS = ("mark1_", "mark2_")


def mix(documents: DataFrame, weights: Sequence[float] | DataFrame = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int | None = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 17) -> Mix:
    """Mixes documents (doc_id, text, source, and any other columns). weights: those of the sources in turn by code
    point, null last, or a table (source, weight). block_words None: a document is one block, taken whole."""
    marked = row_marks(documents, *(m for m in _MARKS if m not in documents.columns))
    rows = stage(marked.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text").cast("string")).alias("size"), *_MARKS), "sizes")
    per = F.ceil(F.col("size") / block_words) if block_words else F.least("size", F.lit(1))
    found = ranked_sources(rows.groupBy("source").agg(F.sum("size").alias("size"), F.sum(per).cast("long").alias("n_blocks")))
    if isinstance(weights, DataFrame):
        of = weights.select(F.col("source").alias("of"), F.col("weight").cast("double"))
        found = found.join(of, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").fillna(0.0, ["weight"])
    else:
        found = found.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("sid", F.lit(len(weights))).cast("int")))
    full = F.coalesce(F.floor(F.col("target") / F.nullif("size", F.lit(0))), F.lit(0)).cast("int")
    found = with_targets(stage(found, "sources"), share, most).withColumn("full", full)
    found = found.select(
        F.col("source").alias("of"), "sid", F.col("size").alias("source_size"), "target", "full", (F.col("target") - F.col("full") * F.col("size")).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("n_blocks") / RANGE)).cast("long").alias("ranges"), "n_blocks",
    )
    sources = stage(found, "targets")
    sized = rows.join(if_small(sources), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")

    passes = F.explode(F.sequence(F.lit(0), F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)))
    cut = sized.where("size > 0 and target > 0").withColumn("pass", passes)
    if block_words:
        cut = cut.withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / block_words).cast("int") - 1)))
        cut = cut.withColumn("words", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words))
    else:
        cut = cut.withColumn("block", F.lit(0)).withColumn("words", F.col("size"))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "pass", "doc_id", "block"), 1)
    cut = cut.withColumn("key", key).withColumn("range", F.shiftright(F.shiftright("key", 32) * F.col("ranges"), 31))
    cut = cut.select("rid", "doc_id", "sid", "pass", "block", "words", "key", "range", "full", "rest", "n_blocks", *_MARKS)
    order = Window.partitionBy("sid", "pass", "range").orderBy("key", "doc_id", "block", *_MARKS, "rid")
    ranked = cut.withColumn("rank", F.row_number().over(order)).withColumn("words_to", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = stage(ranked, "ranked")
    ends = running(ranked.groupBy("sid", "pass", "range").agg(F.max("rank").cast("long").alias("n"), F.max("words_to").alias("w")), ["sid", "pass"], "range", "n", "w")
    placed = ranked.join(ends.drop("n", "w"), ["sid", "pass", "range"])
    over = F.col("before_w") + F.col("words_to") - F.col("rest")
    if block_words:  # the last block is cut where the target is met
        cut_to = F.when((F.col("pass") < F.col("full")) | (over <= 0), F.col("words")).otherwise(F.col("words") - F.ceil(over))
        placed = placed.withColumn("words", cut_to.cast("long")).where("words > 0")
    else:
        placed = placed.where((F.col("pass") < F.col("full")) | (over <= F.col("words") / 2))
    pos = F.col("pass") * F.col("n_blocks") + F.col("before_n") + F.col("rank") - 1
    placed = stage(placed.select("rid", "doc_id", "sid", "pass", "block", "words", pos.cast("long").alias("pos"), *_MARKS), "placed")

    counts = sources.select("sid").join(placed.groupBy("sid").agg(F.count("*").alias("n")), "sid", "left").fillna(0, ["n"])
    counts = stage(counts, "quotas")
    shards = max(1, ceil((counts.agg(F.sum("n")).first()[0] or 0) / shard_blocks))
    #: A grid of a source's mean share per shard brings a block to the two or three shards it can be in.
    cell = if_small(stage(counts.select("sid", F.greatest(F.lit(1), F.floor(F.col("n") / shards)).alias("cell")), "cells"))
    split = split_quotas(counts, shards, seed).join(cell, "sid")
    split = split.withColumn("at", F.explode(F.sequence(F.floor(F.col("start") / F.col("cell")), F.floor((F.col("start") + F.col("n") - 1) / F.col("cell"))))).drop("cell")
    blocks = placed.join(cell, "sid").withColumn("at", F.floor(F.col("pos") / F.col("cell"))).join(split, ["sid", "at"])
    blocks = blocks.where("pos >= start and pos < start + n")
    blocks = blocks.select("rid", "doc_id", "sid", "pass", "block", "words", "shard", F.xxhash64(F.lit(seed + 1), "sid", "pos").alias("place"), *_MARKS)
    return Mix(sized.select("rid", "doc_id", "source", "size", "source_size", "target"), blocks, shards)


def mixed_words(documents: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_shards and first_shard (those its words go to) for each row of
    documents."""
    made = mix(documents.select("doc_id", "text", "source"), **options)
    taken = made.blocks.groupBy("rid").agg(F.sum("words").alias("taken"), F.array_size(F.collect_set("shard")).cast("long").alias("n_shards"), F.min("shard").alias("first_shard"))
    out = made.sizes.join(taken, "rid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"), "first_shard")


def _dealt(documents: DataFrame, **options) -> tuple[DataFrame, list[Column]]:
    """documents, whole, a row for each time one is taken, with shard_ and place_; and the columns to select. A partition
    is a range of at most TASK_SHARDS shards, its rows in the order drawn for them. A row's copies are found by its marks,
    so rows that repeat a doc_id have each their own; of equal rows one stands for all."""
    own, back = guarded(documents, "doc_id", "text", "source")
    own = row_marks(own, *_MARKS)
    made = mix(own, block_words=None, **options)
    taken = stage(made.blocks.select(*(F.col(m).alias(f"of_{m}") for m in _MARKS), F.col("shard").alias("shard_"), F.col("place").alias("place_")), "taken")
    same = [F.col(m) == F.col(f"of_{m}") for m in _MARKS]
    several = stage(own.groupBy(*_MARKS).agg(F.count("*").alias("n")).where("n > 1").select(*_MARKS), "repeated")
    if not several.isEmpty():
        own = own.join(if_small(several), list(_MARKS), "left_anti").unionByName(own.join(if_small(several), list(_MARKS), "left_semi").dropDuplicates(list(_MARKS)))
    tasks = min(made.shards, max(own.sparkSession.sparkContext.defaultParallelism, ceil(made.shards / TASK_SHARDS)))
    dealt = own.join(if_small(taken), same).repartitionById(tasks, F.floor(F.col("shard_") * tasks / made.shards).cast("int"))
    return dealt.sortWithinPartitions("shard_", "place_"), back


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """documents as the mix takes them, whole: a row for each time its document is taken. Partitions hold whole shards, in
    their order, and the rows of each in the order drawn for them."""
    dealt, back = _dealt(documents, **options)
    return dealt.select(*back)


def write_mix(documents: DataFrame, path: str, **options) -> None:
    """The same, written as Parquet in one folder for each shard."""
    dealt, back = _dealt(documents, **options)
    dealt.select(F.col("shard_").alias("shard"), *back).write.partitionBy("shard").parquet(path)
