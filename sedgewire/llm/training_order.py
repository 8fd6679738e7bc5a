"""Training-order materialisation: a keyed permutation gives each sequence its slot; shards hold fixed strides.

Documents become sequences of at most `length` tokens. A first pass counts them, so that each has a dense index from
0 to N - 1; a balanced Feistel network keyed by the seed, walked until it falls below N, maps indexes one to one onto
slots. A second pass deals the sequences to shards, ranges of slots: a slot's range is known from its number, so a
partition is one shard by its id, without sampling or hashing. Each is sorted by slot and written with Spark's text
writer: cast to a string, bytes are written as they are. Record r of a shard starts at r times the stride, so a reader
resumes at any slot with one seek: read_from does. What a reader has to know is written beside the shards.

A record: doc_id (8 bytes, signed), piece (4, unsigned), number of tokens (4), the tokens (2 each, unsigned, padded with 0), a line
end; all little-endian. Both passes split the input alike, as the least number of splits is pinned for them; each
task of the second checks its count against the first's and fails the job if they differ.
Defined results: a null or empty text is its end token alone; a null doc_id is written as the least long and comes
back null; rows that repeat a doc_id are sequences of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.llm.common import U, mix64, pinned_splits, scratch_path, small_batches, stage
from sedgewire.llm.tokens import token_list

LENGTH = 256
SHARD = 16_384
ROUNDS = 6
_NO_ID = -(1 << 63)
#: A folder of JSON beside the shards, which Spark's readers pass over: sequences, length, shard, key.
ABOUT = "_order"


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 to n - 1, applied to index: a Feistel network over the next even number of bits, walked on
    until each value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=U) + U(key * 0x9E3779B97F4A7C15 % (1 << 64)))
    out = index.astype(U)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> U(half), x & mask
        for k in keys:
            a, b = b, a ^ (mix64(b + k) & mask)
        out[todo] = x = (a << U(half)) | b
        todo = todo[x >= U(n)]
    return out.astype(np.int64)


def _sequences(text: str | None, path: str) -> np.ndarray:
    """The ids of a text and its end token; an id that needs more than 16 bits raises."""
    return np.array([*token_list(text or "", path), 0], "<u2")


def _count(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = 0, None
        for batch in batches:
            for text, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total += len(token_list(text or "", path)) // length + 1  # with the end token, rounded up
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.int64())], ["part", "n"])

    return run


def _write(path: str, length: int, base: dict[int, tuple[int, int]], n: int, key: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = end = None
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, texts, parts = (c.to_pylist() for c in batch.columns)
            if at is None:
                at, end = base[parts[0]]
            values: list[bytes] = []
            first = at
            for doc, text in zip(docs, texts, strict=True):
                ids = _sequences(text, path)
                head = int(_NO_ID if doc is None else doc).to_bytes(8, "little", signed=True)
                for piece, k in enumerate(range(0, len(ids), length)):
                    some = ids[k : k + length].tobytes()
                    values.append(head + piece.to_bytes(4, "little") + (len(some) // 2).to_bytes(4, "little") + some.ljust(2 * length, b"\0"))
            at += len(values)
            slots = feistel(np.arange(first, at), n, key)
            yield pa.RecordBatch.from_arrays([pa.array((slots // shard).astype(np.int64)), pa.array(slots), pa.array(values, pa.binary())], ["shard", "slot", "value"])
        if at != end:
            raise RuntimeError("the input was split otherwise than when it was counted")

    return run


def write_order(documents: DataFrame, path: str, to: str, length: int = LENGTH, shard: int = SHARD, key: int = 20_240_601) -> int:
    """Writes the sequences of documents (doc_id, text) as shards under `to`; returns their number. documents must be a
    scan of files, so that it can be read twice alike; anything else should be written first."""
    spark = documents.sparkSession
    small_batches(spark)
    with pinned_splits(spark):
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))
        counts = sorted((r["part"], r["n"]) for r in rows.mapInArrow(_count(path, length), "part int, n long").collect())  # a row per split
        base, n = {}, 0
        for part, many in counts:
            base[part] = n, n + many
            n += many
        if n:
            dealt = rows.mapInArrow(_write(path, length, base, n, key, shard), "shard long, slot long, value binary")
            dealt = dealt.repartitionById(ceil(n / shard), F.col("shard").cast("int")).sortWithinPartitions("shard", "slot")
            dealt.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").text(to)
    about = spark.createDataFrame([(n, length, shard, key)], "sequences long, length long, shard long, key long")
    about.coalesce(1).write.json(f"{to}/{ABOUT}")
    return n


def read_from(uri: str, slot: int = 0) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(slot, doc_id, piece, ids) from a slot on, in order, for one reader that trains: no session is needed. uri is what
    the shards were written under, on any file system that pyarrow knows. A shard is opened when it is due and sought to
    the slot once; a reader that stopped goes on from the slot after its last."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)

    def only(folder: str, suffix: str) -> str:
        (found,) = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(suffix) and f.size]
        return found

    with store.open_input_stream(only(f"{root}/{ABOUT}", ".json")) as f:
        about = json.loads(f.read())
    stride = 16 + 2 * about["length"] + 1
    while slot < about["sequences"]:
        with store.open_input_file(only(f"{root}/shard={slot // about['shard']}", ".txt")) as f:
            f.seek(slot % about["shard"] * stride)
            while block := f.read(stride * 256):
                for k in range(0, len(block), stride):
                    doc, piece, many = struct.unpack_from("<qII", block, k)
                    if len(block) < k + stride or block[k + stride - 1] != 10:
                        raise ValueError(f"slot {slot} is not a whole record")
                    yield slot, None if doc == _NO_ID else doc, piece, np.frombuffer(block, "<u2", many, k + 16)
                    slot += 1


def _read(length: int, shard: int):
    stride = 16 + 2 * length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number = int(name.rpartition("shard=")[2].partition("/")[0])
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                if (data[:, -1] != 10).any():
                    raise ValueError(f"{name} is not in strides of {stride}")
                doc = np.ascontiguousarray(data[:, :8]).view("<i8")[:, 0]
                piece, many = (np.ascontiguousarray(data[:, k : k + 4]).view("<u4")[:, 0] for k in (8, 12))
                crc = [zlib.crc32(row[16 : 16 + 2 * int(m)].tobytes()) for row, m in zip(data, many, strict=True)]
                slot = number * shard + np.arange(len(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, mask=doc == _NO_ID), pa.array(piece.astype(np.int32)), pa.array(slot), pa.array(np.full(len(data), number)), pa.array(many.astype(np.int32)), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "slot", "shard", "n_tokens", "ids_crc32"],
                )

    return run


def read_order(spark: SparkSession, path: str, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, slot, shard, n_tokens, ids_crc32 (of the 16-bit ids) for each sequence of the shards under path; a
    shard is one file, and its records stand in the order of their slots."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", "content").mapInArrow(_read(length, shard), "doc_id long, piece int, slot long, shard long, n_tokens int, ids_crc32 long")


def ordered(documents: DataFrame, path: str, **options) -> DataFrame:
    """Writes the shards of documents in the shared folder and reads them back."""
    spark = documents.sparkSession
    to = scratch_path(spark, "order")
    if not write_order(documents, path, to, **options):
        return spark.createDataFrame([], "doc_id long, piece int, slot long, shard long, n_tokens int, ids_crc32 long")
    return read_order(spark, to, **{k: v for k, v in options.items() if k in ("length", "shard")})
