"""What the corpus operators share: scratch tables, size-checked broadcasts, word hashes, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes, counted rows times the width of their types, up to which a table is broadcast; above it the join shuffles.
BROADCAST_BYTES = 24 << 20
#: Rows of a group that a running sum takes in one task; it then sums their sums.
RUN = 4096
#: Bytes an Arrow batch may hold before the next one starts: texts are kilobytes, some of them hundreds.
ARROW_BYTES = 4 << 20
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

U = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of long texts small in JVM and Python alike. The setting is read when a plan runs, which
    is after we return, so it stays for the session; it bounds memory and changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own on this machine, which
    only a local master may use: elsewhere each executor would write to a disk of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sedgewire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{scratch(spark)}/sedgewire/{label}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    return path


@contextmanager
def pinned_splits(spark: SparkSession):
    """Within it a scan of files is split alike each time, though executors come and go; so row numbers agree."""
    pin = "spark.sql.files.minPartitionNum"
    was = spark.conf.get(pin, None)
    spark.conf.set(pin, was or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(pin) if was is None else spark.conf.set(pin, was)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(kind: T.DataType) -> int:
    """What a value takes in a row of the engine: a word each, and the bytes of fixed-length hashes and the like."""
    if isinstance(kind, T.StructType):
        return 16 + sum(row_bytes(f.dataType) for f in kind)
    return 40 if isinstance(kind, (T.StringType, T.BinaryType, T.MapType, T.ArrayType)) else 8


def if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """Marks a staged table of narrow rows for broadcast, if its counted rows are at most so many bytes."""
    return F.broadcast(df) if df.count() * row_bytes(df.schema) <= (BROADCAST_BYTES if most is None else most) else df


def running(df: DataFrame, by: list[str], order: str, *values: str) -> DataFrame:
    """df with before_<value>: the sum of each value over the rows of its group that come before by `order`, whole
    numbers from 0. Runs of RUN numbers are summed first, so that no task holds more than a run or the sums of runs."""
    rows = df.withColumn("run_", F.floor(F.col(order) / RUN))
    sums = rows.groupBy(*by, "run_").agg(*(F.sum(v).alias(f"run_{v}") for v in values))
    outer = Window.partitionBy(*by).orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*by, "run_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "run_", *(F.coalesce(F.sum(f"run_{v}").over(outer), F.lit(0)).alias(f"run_{v}") for v in values))
    rows = rows.select("*", *(F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"in_{v}") for v in values)).join(sums, [*by, "run_"])
    return rows.select(*df.columns, *((F.col(f"run_{v}") + F.col(f"in_{v}")).alias(f"before_{v}") for v in values))


def row_marks(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns, hashes that tell its rows apart. A hash passes over nulls, so where they are is hashed too."""
    cols = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return df.withColumns({m: F.xxhash64(F.lit(m), *cols, *(c.isNull() for c in cols)) for m in names})


def guarded(df: DataFrame, *keep: str) -> tuple[DataFrame, list]:
    """df with all columns but `keep` under names of our own, so that none clashes with what an operator adds; and the
    columns to select to have its own names and order back."""
    mine = {c: c if c in keep else f"own{k}_" for k, c in enumerate(df.columns)}
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*(col(c).alias(n) for c, n in mine.items())), [col(n).alias(c) for c, n in mine.items()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = U(0x9E3779B97F4A7C15)
_PIECE = 1 << 20
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            step = np.full(size, U(base))
            step[0] = U(1)
            out.append(np.multiply.accumulate(step))
        _powers[0] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def _pieces(raw: bytes):
    """Cuts a long text at white space, so that the arrays for it stay small."""
    at = 0
    while len(raw) - at > _PIECE:
        end = at + _PIECE
        while end < len(raw) and not ASCII_SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw


def word_hashes(raw: bytes, lower: bool = True) -> np.ndarray:
    """A 64-bit hash for each word of a UTF-8 text, in order, the same in every process."""
    parts = []
    for piece in _pieces(raw):
        data = np.frombuffer(piece, np.uint8)
        if not len(data):
            continue
        word = ~ASCII_SPACE[data]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        if not len(edge):
            continue
        start, end = edge[::2], edge[1::2]
        power, inverse = _power_tables(len(data))
        value = (_LOWER[data] if lower else data).astype(U) + U(1)
        total = np.empty(len(data) + 1, U)
        total[0] = 0
        np.cumsum(value * power, out=total[1:])
        parts.append(mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(U)))
    return np.concatenate(parts) if parts else np.empty(0, U)


def shingles(raw: bytes, width: int = 5) -> np.ndarray:
    """The distinct hashed word shingles of a text, sorted; with fewer words the whole sequence is one."""
    words = word_hashes(raw)
    n = len(words)
    if not n:
        return words
    width_here = min(width, n)
    out = np.zeros(n - width_here + 1, U)
    for k in range(width_here):
        out = out * U(0xD6E8FEB86659FD93) + words[k : k + len(out)]
    return np.unique(mix64(out + U(width_here)))


class Union:
    """Union-find over local indexes 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _local_forest(batches):
    import pyarrow as pa

    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Union(len(nodes))
        keep = [i for i, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)) if forest.join(x, y)]
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both long: (node, root) for each node that has an edge.

    Each round every node joins the neighbour, or itself, whose seeded hash is least, and the edges are
    contracted; the number of nodes falls by a constant factor a round, whatever the shape. The root is an
    arbitrary node of the component. Hubs only meet partial aggregates and joins that can be split."""
    spark = edges.sparkSession
    left = stage(edges.select("a", "b").where("a <> b").mapInArrow(_local_forest, "a long, b long"), "edges")
    assign, seed = None, 0
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", F.lit(seed)).alias("h"), "b")).alias("m"))
        own = F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node").alias("b"))
        step = stage(best.select("node", F.least(F.col("m"), own)["b"].alias("up")), "step")
        if assign is None:
            assign = step.select("node", F.col("up").alias("root"))
        else:
            moved = step.select(F.col("node").alias("root"), "up")
            assign = stage(assign.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "assign")
        to_a = step.select(F.col("node").alias("a"), F.col("up").alias("x"))
        to_b = step.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = stage(
            left.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().mapInArrow(_local_forest, "a long, b long"), "edges"
        )
        seed += 1
    return assign if assign is not None else spark.createDataFrame([], "node long, root long")
