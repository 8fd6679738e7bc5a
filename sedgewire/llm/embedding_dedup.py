"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Every vector becomes a unit vector, int8 codes with one scale, and the exact norm of what the codes lose. Only codes
travel: vectors of equal label and length meet in square tiles, which multiply the codes and, by the losses, know for
each pair the least and the largest cosine it can have. Pairs that reach the threshold either way are links, pairs
that cannot are none. Where the bounds leave pairs open, the tile names their vectors; these alone come a second time,
with their doubles read anew from the input, and their open pairs are computed in double precision. A tile sends back
link counts and a spanning forest of its links, never the links themselves, so a group of thousands of copies costs
counts, not pairs. Equal vectors are one class with a multiplicity throughout.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts link with nothing, nor do
those with a null label or a null id. Vectors of different length never link. Rows that repeat a vec_id are
vectors of their own. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.common import Union, components, if_small, stage

#: Classes in a tile's side, on average.
TILE = 1024
#: What doubles may err by, beside the codes' losses.
_SLACK = 1e-9
_CLEAN = "rid long, vec_id long, label long, dim int, key binary, codes binary, scale double, loss double"
#: n is a count of a's links, or null: then b, if any, is linked to a, and without b the vector a has open pairs in tile lo, hi.
_TILE_OUT = "label long, dim int, lo int, hi int, a long, b long, n long"


def _usable(v: pa.Scalar) -> np.ndarray | None:
    """A vector's doubles, or None where it links with nothing."""
    if not v.is_valid or not len(v) or v.values.null_count:
        return None
    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    return x if np.isfinite(x).all() and x.any() else None


def _key(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _clean(batches):
    """Usable vectors as codes and a digest; others have a null key."""
    for batch in batches:
        rid, vec_id, vector, label = batch.columns
        rows = {k: [] for k in ("dim", "key", "codes", "scale", "loss")}
        for v, i, group in zip(vector, vec_id, label, strict=True):
            x = _usable(v) if i.is_valid and group.is_valid else None
            found = (None,) * 5
            if x is not None:
                codes, scale, loss = quantise(unit_rows(x[None, :]))
                found = (len(x), _key(x), codes.tobytes(), float(scale[0]), float(loss[0]))
            for k, one in zip(rows, found, strict=True):
                rows[k].append(one)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([rid, vec_id, label, *(pa.array(c, t) for c, t in zip(rows.values(), kinds, strict=True))], ["rid", "vec_id", "label", *rows])


def _doubles(batches):
    """Digest and doubles of the usable vectors."""
    for batch in batches:
        found = [x for v in batch.column(0) if (x := _usable(v)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "raw"])


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; scaled first, so that neither tiny nor huge parts are lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale and the norm of the loss of each unit row."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = unit - codes * scale[:, None]
    return codes, scale, np.sqrt(np.einsum("ij,ij->i", lost, lost)) + 1e-12


def bounded_links(left: tuple, right: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the (codes, scale, loss) of the rows left and right: which pairs reach the threshold for certain, and which
    the losses leave open.

    |u.v - u'.v'| <= |u - u'| |v| + |u'| |v - v'| <= e + (1 + e) f, for losses e of u and f of v. Products of codes
    are whole numbers, exact in single precision up to 1040 dimensions; beyond that doubles are used."""
    (p, s, e), (q, t, f) = left, right
    kind = np.float32 if p.shape[1] <= 1040 else np.float64
    near = (p.astype(kind) @ q.astype(kind).T).astype(np.float64) * s[:, None] * t
    off = e[:, None] + (1 + e[:, None]) * f + _SLACK
    sure = near - off >= threshold
    return sure, ~sure & (near + off >= threshold)


class _Tile:
    """The rows of one tile: its two sides, their codes, and what comes of links."""

    def __init__(self, key: tuple[pa.Scalar, ...], table: pa.Table):
        self.key = [k.as_py() for k in key]
        lo, hi = self.key[2:]
        self.node, self.mult, block, scale, loss = (table.column(c).to_numpy() for c in ("node", "mult", "block", "scale", "loss"))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(len(self.node), -1)
        self.left, self.right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        self.sides = [(codes[x], scale[x], loss[x]) for x in (self.left, self.right)]

    def pairs(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a mask over the sides, as indexes of rows; each once."""
        at, to = np.nonzero(np.triu(where, 1) if self.key[2] == self.key[3] else where)
        return self.left[at], self.right[to]

    def out(self, at: np.ndarray, to: np.ndarray, open_: np.ndarray) -> pa.Table:
        """Counts and a forest of the links, and the rows with open pairs."""
        count = np.bincount(at, self.mult[to], len(self.node)) + np.bincount(to, self.mult[at], len(self.node))
        forest = Union(len(self.node))
        edges = [(x, y) for x, y in zip(at.tolist(), to.tolist(), strict=True) if forest.join(x, y)]
        linked = np.flatnonzero(count)
        a = np.concatenate([self.node[linked], self.node[[x for x, _ in edges]], self.node[open_]]).astype(np.int64)
        b = [None] * len(linked) + [int(self.node[y]) for _, y in edges] + [None] * len(open_)
        n = [*count[linked].astype(np.int64).tolist(), *[None] * (len(edges) + len(open_))]
        label, dim, lo, hi = ([k] * len(a) for k in self.key)
        return pa.table({"label": pa.array(label, pa.int64()), "dim": pa.array(dim, pa.int32()), "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32()), "a": a, "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def _coded(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tile = _Tile(key, table)
        sure, open_ = bounded_links(*tile.sides, threshold)
        at, to = tile.pairs(open_)
        return tile.out(*tile.pairs(sure), np.unique(np.concatenate([at, to])))

    return run


def _exact(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tile = _Tile(key, table)
        at, to = tile.pairs(bounded_links(*tile.sides, threshold)[1])
        unit = unit_rows(np.frombuffer(b"".join(table.column("raw").to_pylist()), np.float64).reshape(len(tile.node), -1))
        good = np.empty(len(at), bool)
        for k in range(0, len(at), 65536):
            some = slice(k, k + 65536)
            good[some] = np.einsum("ij,ij->i", unit[at[some]], unit[to[some]]) >= threshold
        return tile.out(at[good], to[good], np.empty(0, np.int64))

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    full = F.col("embedding").cast("array<double>").alias("embedding")
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), full, F.col("label").cast("long"))
    clean = stage(rows.mapInArrow(_clean, _CLEAN), "vectors")
    group = ["label", "dim"]
    classes = clean.where("key is not null").groupBy(*group, "key").agg(F.min("rid").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    classes = stage(classes, "classes")
    sizes = classes.groupBy(*group).agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    blocked = classes.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocked = blocked.join(clean.select(F.col("rid").alias("node"), "codes", "scale", "loss"), "node")
    sides = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    tiles = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*group, *sides, "node", "mult", "block", "codes", "scale", "loss")
    found = stage(tiles.groupBy(*group, "lo", "hi").applyInArrow(_coded(threshold), _TILE_OUT), "tiles")

    open_ = stage(found.where("n is null and b is null").select(*group, "lo", "hi", F.col("a").alias("node")), "open")
    if not open_.isEmpty():
        wanted = stage(open_.select("node").distinct().join(blocked, "node").select("node", "key", "mult", "block", "codes", "scale", "loss"), "wanted")
        keys = if_small(stage(wanted.select("key").distinct(), "keys"))
        raw = vectors.select(full).mapInArrow(_doubles, "key binary, raw binary").join(keys, "key", "left_semi").dropDuplicates(["key"])
        again = open_.join(wanted.join(raw, "key").drop("key"), "node")
        found = found.union(stage(again.groupBy(*group, "lo", "hi").applyInArrow(_exact(threshold), _TILE_OUT), "doubles"))

    links = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b"))
    least = roots.join(classes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("first"))
    first = roots.join(least, "root").select("node", "first")
    of_class = classes.join(links, "node", "left").join(first, "node", "left")
    of_class = of_class.select(*group, "key", (F.col("mult") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("first", "least").alias("first"))
    out = clean.select("vec_id", *group, "key").join(of_class, [*group, "key"], "left")
    component = F.coalesce("first", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
