"""Packing documents into sequences: dominance reduction, then best fit, both on counts of lengths.

A length is at most `room`, so the whole corpus is a histogram of `room` counts, which the driver packs however
many documents there are. Pieces of a length are interchangeable: they are numbered, and the plan, a list of runs
(pieces a to b of a length, so many to a sequence, from this sequence and offset on), tells each its place.
The reduction follows Martello and Toth: with j the longest piece left, a pair that no other set containing j can
beat is fixed for good (j alone, if nothing fits beside it; j with i, if i fills it exactly, or i is the longest
that fits and no two others fit together). What is left is packed best fit, longest first.

Numbers within a length come from counts of hash buckets, each of about BUCKET pieces, so a hot length is dealt over
many tasks. Defined results: a null or empty text is its end token alone; a document longer than `room` is cut into
whole sequences after a first piece of the rest; rows that repeat a doc_id are packed each; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgewire.llm.common import running, small_batches, stage
from sedgewire.llm.tokens import token_ids

ROOM = 2048
BUCKET = 1_000
_PIECES = "rid long, doc_id long, piece int, start long, length int, ids_crc32 long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _cut(path: str, room: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for rid, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.append(token_ids(text or "", path), np.uint32(0)).astype("<u4")
                first = len(ids) % room or room
                edges = [0, *range(first, len(ids) + 1, room)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    raw = ids[a:b].tobytes()
                    rows.append((rid, doc, k, a, b - a, zlib.crc32(raw), *((raw,) if with_ids else ())))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if with_ids else [])]
            names = ["rid", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def pieces(documents: DataFrame, path: str, room: int = ROOM, with_ids: bool = False) -> DataFrame:
    """The pieces of documents (doc_id, text); with_ids: with their ids, little-endian unsigned 32 bits."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_cut(path, room, with_ids), _PIECES + (", ids binary" if with_ids else ""))


class _Plan:
    """Runs of pieces, as columns: length, first and end number, pieces a sequence, first sequence, offset."""

    def __init__(self, counts: dict[int, int], room: int):
        self.left = {k: n for k, n in counts.items() if n}
        self.used = dict.fromkeys(self.left, 0)
        self.room, self.next, self.runs = room, 0, []

    def put(self, length: int, n: int, each: int, sequence: int, offset: int) -> None:
        a = self.used[length]
        self.runs.append((length, a, a + n, each, sequence, offset))
        self.used[length] = a + n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]


def reduce_dominated(plan: _Plan) -> None:
    """Fixes the dominating sets, each a closed sequence."""
    lengths = sorted(plan.left)
    for j in sorted(plan.left, reverse=True):
        lengths = [x for x in lengths if x in plan.left]
        while j in plan.left:
            gap = plan.room - j
            free = lambda x: plan.left.get(x, 0) - (x == j)  # noqa: E731, B023
            longest = next((x for x in reversed(lengths[: bisect_left(lengths, gap + 1)]) if free(x) > 0), None)
            if longest is None:
                n = plan.left[j]
                plan.put(j, n, 1, plan.next, 0)
                plan.next += n
                break
            least: list[int] = []
            for x in lengths:
                least += [x] * min(2 - len(least), free(x)) if free(x) > 0 else []
                if len(least) == 2:
                    break
            if longest != gap and len(least) == 2 and sum(least) <= gap:
                break
            n = plan.left[j] // 2 if longest == j else min(plan.left[j], plan.left[longest])
            plan.put(j, n, 1, plan.next, 0)
            plan.put(longest, n, 1, plan.next, j)
            plan.next += n


def best_fit(plan: _Plan) -> None:
    """Longest first, each into the open sequences with the least room that holds it, those of equal room together."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(plan.left, reverse=True):
        while length in plan.left:
            n = plan.left[length]
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, first, many = plan.room, plan.next, ceil(n / (plan.room // length))
                plan.next += many
            each = room // length
            whole = min(many, n // each)
            if whole:
                plan.put(length, whole * each, each, first, plan.room - room)
                add(room - each * length, first, whole)
            rest = n - whole * each
            if whole < many and rest and rest < each:
                plan.put(length, rest, rest, first + whole, plan.room - room)
                add(room - rest * length, first + whole, 1)
                whole += 1
            if whole < many:
                add(room, first + whole, many - whole)


def plan_runs(counts: dict[int, int], room: int = ROOM) -> np.ndarray:
    plan = _Plan(counts, room)
    reduce_dominated(plan)
    best_fit(plan)
    return np.array(sorted(plan.runs), np.int64).reshape(-1, 6)


def _place(runs: np.ndarray):
    keys = (runs[:, 0] << 40) | runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, piece, start, length, crc, number = (batch.column(k) for k in range(6))
            size, rank = np.asarray(length), np.asarray(number)
            at = np.searchsorted(keys, (size << 40) | rank, "right") - 1
            inside = rank - runs[at, 1]
            sequence = runs[at, 4] + inside // runs[at, 3]
            offset = runs[at, 5] + inside % runs[at, 3] * size
            yield pa.RecordBatch.from_arrays([doc, piece, start, length, crc, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(documents: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of documents (doc_id, text)."""
    spark = documents.sparkSession
    cut = stage(pieces(documents, path, room), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `room` rows
    if not counts:
        return spark.createDataFrame([], _PLACED)
    runs = plan_runs(counts, room)
    buckets = spark.createDataFrame([(k, max(1, ceil(n / BUCKET))) for k, n in counts.items()], "length int, buckets int")
    dealt = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "rid"), F.col("buckets")).cast("int"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "rid")
    ends = running(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), ["length"], "bucket", "n").select("length", "bucket", F.col("before_n").alias("n0"))
    ranked = dealt.withColumn("rank", F.row_number().over(order)).join(ends, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", (F.col("n0") + F.col("rank") - 1).alias("number"))
    return ranked.mapInArrow(_place(runs), _PLACED)
