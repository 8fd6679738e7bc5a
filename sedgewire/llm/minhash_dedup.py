"""Near-duplicate documents by MinHash bands, sequential Bayesian pruning and exact verification.

1. Every whole text becomes its set of hashed word shingles; equal sets are one class.
2. MinHash signatures of the classes are cut into bands; a bucket holds the classes that agree on a band. With
   BANDS bands of ROWS values a pair at the threshold of 0.85 is missed with probability 7e-9.
3. Each bucket's members are compared with its least member only (a star: rows in proportion to the bucket).
   Signatures are compared batch by batch, and a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold falls below MISS; the survivors are verified on their full sets.
4. Buckets whose other members are then not all in one component hold pairs not compared yet. Those across
   components of buckets of at most FEW are listed, pruned and verified likewise. The members of larger buckets
   meet in tiles of bounded size, which prune and verify inside and return a spanning forest of their links. So
   no pair within a bucket is left out, and what is listed is in proportion to the members.

Defined results: null texts and texts without words are empty, link with nothing and are kept; repeated rows are
one class; a null doc_id takes part, but its own row is not kept if its component has an id. Extra columns are
ignored; an empty table gives an empty result. near_documents says what is kept by id, keep_one decides by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.common import U, Union, components, guarded, if_small, mix64, row_marks, shingles, small_batches, stage

WIDTH = 5
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Signature values compared at a time, and the probability that a batch drops a true link.
BATCH, MISS = 16, 1e-9
#: Members of a bucket up to which its pairs are listed, each pair once for all buckets; larger ones go by tiles.
FEW = 24
#: Shingles in a side of a tile, on average.
TILE_SHINGLES = 300_000
_SEEDS = mix64(np.arange(1, 2 * HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_MULT, _PLUS = _SEEDS[:HASHES] | U(1), _SEEDS[HASHES:]


def signature(sets: np.ndarray) -> np.ndarray:
    """HASHES minima, 32 bits each."""
    low = np.full(HASHES, np.iinfo(U).max, U)
    for k in range(0, len(sets), 512):
        part = sets[k : k + 512, None] * _MULT + _PLUS
        part ^= part >> U(29)
        np.minimum(low, part.min(axis=0), out=low)
    return (low >> U(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number in it."""
    key = np.arange(1, BANDS + 1, dtype=U)
    for column in values.reshape(BANDS, ROWS).T:
        key = mix64(key * U(0xD6E8FEB86659FD93) + column.astype(U))
    return key.view(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """For each number n of compared values, the fewest matches m at which the posterior of a uniform prior still gives
    P(similarity >= threshold | m of n) >= miss. That posterior is Beta(m + 1, n - m + 1), whose tail is binomial."""
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out[n] = m
    return out


def survivors(left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indexes of the rows whose signatures stay possible through every batch."""
    at = np.arange(len(left))
    got = np.zeros(len(left), np.int64)
    for k in range(0, HASHES, BATCH):
        got = got + (left[at, k : k + BATCH] == right[at, k : k + BATCH]).sum(axis=1)
        good = got >= least[k + BATCH]
        at, got = at[good], got[good]
    return at


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    both = int(np.count_nonzero(b[place] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key, sig = [], [], []
            for text in batch.column(2):
                values = shingles((text.as_py() or "").encode(), width)
                size.append(len(values))
                key.append(set_key(values) if len(values) else None)
                sig.append(signature(values).tobytes() if len(values) else None)
            names = ["rid", "doc_id", "size", "key", "sig", *batch.schema.names[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), *batch.columns[3:]], names)

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = [band_keys(np.frombuffer(x.as_py(), np.uint32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.asarray(batch.column(0)), BANDS))], ["bucket", "node"])


def _possible(least: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in (2, 3))
                yield batch.select([0, 1]).take(pa.array(survivors(left, right, least)))

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingles((x.as_py() or "").encode(), width) for x in batch.column(0)]
            values = [x for x in values if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in values], pa.binary()), pa.array([x.tobytes() for x in values], pa.binary())], ["key", "full"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _tile_links(percent: int, least: np.ndarray):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        node, comp, block = (table.column(c).to_numpy() for c in ("node", "comp", "block"))
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(x, U) for x in table.column("full").to_pylist()]
        same = np.unique(comp, return_inverse=True)[1].tolist()
        forest, out = Union(max(same) + 1), []
        right = np.flatnonzero(block == hi)
        for x in np.flatnonzero(block == lo).tolist():
            to = right[right > x] if lo == hi else right
            to = to[comp[to] != comp[x]]
            for y in to[survivors(np.broadcast_to(sigs[x], (len(to), HASHES)), sigs[to], least)].tolist():
                if forest.find(same[x]) != forest.find(same[y]) and similar(sets[x], sets[y], percent):
                    forest.join(same[x], same[y])
                    out.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs (a, b) with the values of both, from (node, value)."""
    name = values.columns[1]
    to_a, to_b = (values.select(F.col("node").alias(k), F.col(name).alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(to_a, "a").join(to_b, "b").select("a", "b", "x", "y")


def _linked(documents: DataFrame, percent: int, width: int, *marks: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, key, *marks) for each row of documents (doc_id, text, *marks; marks are long), key null for an empty
    one; and (key, root, head) for each class: the node that names its component, and the component's least id."""
    small_batches(documents.sparkSession)
    least = least_matches(percent / 100)
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"), *marks)
    signed = stage(rows.mapInArrow(_sign(width), ", ".join(["rid long, doc_id long, size long, key binary, sig binary", *(f"{m} long" for m in marks)])), "signed")
    classes = stage(signed.where("key is not null").groupBy("key").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first"), F.max("size").alias("size")), "classes")
    copies = stage(signed.select("rid", "key").join(classes.select("key", "node"), "key").where("rid <> node").select("rid"), "copies")
    sigs = signed.where("key is not null").join(if_small(copies), "rid", "left_anti").select(F.col("rid").alias("node"), "sig")

    bands = stage(sigs.mapInArrow(_bands, "bucket long, node long"), "bands")
    shared = stage(bands.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("other"), F.count("*").alias("n")).where("n > 1"), "shared")
    larger = if_small(stage(shared.where("n > 2").select("bucket", "centre", "n"), "larger"))
    members = stage(bands.join(larger, "bucket").where("node <> centre"), "members")
    stars = members.select(F.col("centre").alias("a"), F.col("node").alias("b")).union(shared.where("n = 2").select("centre", "other"))
    stars = stage(stars.distinct(), "stars")

    def possible(pairs: DataFrame) -> DataFrame:
        """The pairs that the signatures leave possible."""
        nodes = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes")
        values = stage(sigs.join(if_small(nodes), "node", "left_semi"), "sigs")
        return stage(_beside(pairs, values).mapInArrow(_possible(least), "a long, b long"), "possible")

    def full_sets(nodes: DataFrame) -> DataFrame:
        """(node, full) of these nodes, from the whole texts."""
        wanted = stage(nodes.distinct().join(classes.select("node", "key"), "node"), "wanted")
        ids = stage(wanted.join(signed.select("rid", "doc_id"), wanted["node"] == signed["rid"]).select("doc_id"), "ids")
        texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
        picked = texts.join(if_small(ids), texts["id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
        full = picked.mapInArrow(_full_sets(width), "key binary, full binary").join(if_small(wanted), "key")
        return stage(full.dropDuplicates(["node"]).select("node", "full"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        sets = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        return stage(_beside(pairs, sets).mapInArrow(_verified(percent), "a long, b long"), "links")

    links = verified(possible(stars))
    roots = components(links)

    #: Buckets of two are done with their star. In larger ones the other members are not compared yet.
    rest = members.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp"))
    open_ = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")).where("lo <> hi")
    open_ = stage(open_.groupBy("n", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "open")
    if not open_.isEmpty():
        inside = stage(rest.join(if_small(open_), "bucket"), "inside")
        few, many = inside.where(F.col("n") <= FEW), inside.where(F.col("n") > FEW)
        pairs = few.select("bucket", F.col("node").alias("a"), "comp").join(few.select("bucket", F.col("node").alias("b"), F.col("comp").alias("to")), "bucket").where("a < b and comp <> to")
        more = verified(possible(stage(pairs.select("a", "b").distinct(), "pairs")))
        if not many.isEmpty():
            many = many.join(classes.select("node", "size"), "node")
            blocks = many.groupBy("bucket").agg(F.ceil(F.sum("size") / TILE_SHINGLES).cast("int").alias("blocks"))
            tiled = many.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            sets = full_sets(many.select("node"))
            tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sigs, "node").join(sets, "node")
            tiled = tiled.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "comp", "block", "sig", "full")
            more = more.union(stage(tiled.groupBy("bucket", "lo", "hi").applyInArrow(_tile_links(percent, least), "a long, b long"), "tiles"))
        if not more.isEmpty():
            roots = components(links.union(more))

    heads = roots.join(classes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("head"))
    headed = roots.join(heads, "root").select("node", "root", "head")
    of_class = classes.join(headed, "node", "left").select("key", F.coalesce("root", "node").alias("root"), F.coalesce("head", "first").alias("head"))
    return signed.select("doc_id", "size", "key", *marks), of_class


def near_documents(documents: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents (doc_id, text)."""
    signed, of_class = _linked(documents, percent, width)
    out = signed.join(of_class.select("key", "head"), "key", "left")
    component = F.coalesce("head", "doc_id")
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_one(documents: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each component of documents, and those without words. The row with the least doc_id stays, a null one
    last; of several with that id the one with the least hash of its columns; of equal rows any one."""
    own, back = guarded(documents, "doc_id", "text")
    marks = ["mark1_", "mark2_"]
    own = row_marks(own, *marks)
    signed, of_class = _linked(own, percent, WIDTH, *marks)
    rows = signed.where("key is not null").join(of_class.select("key", "root"), "key").groupBy("root", "doc_id", *marks).agg(F.count("*").alias("n"))
    rows = stage(rows.select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *marks).alias("row"), "n"), "rows")
    best = stage(rows.groupBy("root").agg(F.min("row").alias("best"), F.sum("n").alias("all")).where(F.col("all") > 1).drop("all"), "best")
    judged = stage(rows.join(if_small(best), "root").select(*(F.col("row")[m].alias(f"of_{m}") for m in marks), (F.col("row") == F.col("best")).alias("best"), "n"), "judged")
    gone = stage(judged.where("not best or n > 1"), "gone")
    same = [F.col(m) == F.col(f"of_{m}") for m in marks]
    stay = own.join(if_small(gone), same, "left_anti")
    repeated = stage(gone.where("best"), "repeated")
    if not repeated.isEmpty():
        stay = stay.unionByName(own.join(if_small(repeated), same, "left_semi").dropDuplicates(marks))
    return stay.select(*back)
