"""Quality rules with thresholds learnt from the corpus, per language and source.

Measures of every whole text go into mergeable quantile sketches: counts of logarithmic buckets, whose
quantiles have a bounded relative error and which merge by adding counts, so that the corpus is sketched by
ordinary partial aggregation. A measure is an outlier above q75 + REACH * max(q75 - q25, floor) of its group. A
language's threshold leans on the whole corpus's as if that were LEAN more texts, and that of a (language, source) on its
language's likewise; so the thresholds move smoothly as groups grow, and large groups have their own.

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are
groups like any other; repeated rows each get a verdict; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.common import guarded, mix64, small_batches, stage, word_hashes

#: Relative error of a sketch's quantiles.
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Texts that a group's parent weighs beside the group's own.
LEAN = 200
REACH = 3.0
#: The measures, and the least spread that counts for each.
FLOORS = {"symbols": 0.05, "dup_lines": 0.15, "repeats": 0.15, "upper": 0.1, "marks": 0.05, "word_length": 1.0}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_upper", "n_marks"]
WINDOW = 8

_SYMBOL, _MARK, _INNER, _ASCII_UPPER = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK[ord("!")] = True
_INNER[0x80:0xC0] = True
_ASCII_UPPER[65:91] = True


def repeat_words(raw: bytes, hashes: np.ndarray) -> int:
    """Words that lie in a window of eight words found twice or more; hash matches are confirmed on the words."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window = window * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    window = mix64(window)
    ranked = np.sort(window)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(window, twice))
    words = raw.split()
    seen: dict[tuple, int] = {}
    groups = [seen.setdefault(tuple(words[i : i + WINDOW]), len(seen)) for i in at.tolist()]
    at = at[np.bincount(groups)[groups] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def text_counts(text: str | None) -> list[int]:
    """The counts of COUNTS for a whole text."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    hashes = word_hashes(raw, lower=False)
    spaces = sum(raw.count(c) for c in b" \t\n\r\x0b\x0c")
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    upper = int(np.count_nonzero(_ASCII_UPPER[data]))
    two = data[1:][data[:-1] == 0xC3]
    upper += int(np.count_nonzero((two >= 0x80) & (two <= 0x9E) & (two != 0x97)))
    chars = len(data) - int(np.count_nonzero(_INNER[data])) - spaces
    return [len(hashes), chars, int(np.count_nonzero(_SYMBOL[data])), len(lines) - len(set(lines)), repeat_words(raw, hashes), len(lines), upper, raw.count(b"!")]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([text_counts(x.as_py()) for x in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], [*batch.schema.names, *COUNTS])


def counted(documents: DataFrame) -> DataFrame:
    """documents with the counts of each text beside its columns, which bear other names."""
    small_batches(documents.sparkSession)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + "".join(f", {c} long" for c in COUNTS)
    return documents.mapInArrow(_measured, types)


def measures() -> dict[str, Column]:
    """Ratios that the thresholds are set on."""
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols": over("n_symbols", "n_words"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"),
        "upper": over("n_upper", "word_chars"), "marks": over("n_marks", "n_words"), "word_length": over("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketch(counts: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable sketch per group and measure; bucket null stands for 0."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("x")) for k, v in measures().items()))).alias("m")
    rows = counts.where(~base_failed()).select("lang", "source", pairs)
    bucket = F.when(F.col("m.x") > 0, F.ceil(F.log(F.col("m.x")) / math.log(GAMMA)).cast("int"))
    return rows.groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Per group: its number of texts and a map from each measure to its threshold. A group's buckets are bounded
    by the sketch's accuracy, so the running counts stay small."""
    from pyspark.sql import Window

    merged = sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    run = merged.withColumn("upto", F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("total", F.sum("n").over(group))
    value = F.coalesce(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1), F.lit(0.0))
    quantile = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), value))
    ends = run.groupBy(*by, "measure").agg(F.max("total").alias("total"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    floor = F.create_map(*(F.lit(x) for pair in FLOORS.items() for x in pair))[F.col("measure")]
    fence = F.col("q3") + REACH * F.greatest(F.col("q3") - F.col("q1"), floor)
    return ends.groupBy(*by).agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("measure", fence))).alias("fence"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """(lang, source, limits): the thresholds that hold for each group that has a sketch."""
    own = _fences(sketches, ["lang", "source"])
    lang = _fences(sketches, ["lang"]).select(F.col("lang").alias("of"), F.col("total").alias("of_total"), F.col("fence").alias("of_fence"))
    whole = _fences(sketches.withColumn("all", F.lit(0)), ["all"]).select(F.col("fence").alias("whole"))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("of")), "left").join(F.broadcast(whole), F.lit(True), "left")
    leans = lambda own, n, parent: F.map_zip_with(own, parent, lambda _, x, y: (n * x + LEAN * y) / (n + LEAN))
    limits = leans(F.col("fence"), F.col("total"), leans(F.col("of_fence"), F.col("of_total"), F.col("whole")))
    return both.select(F.col("lang").alias("for_lang"), F.col("source").alias("for_source"), limits.alias("limits"))


def judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """counts with base_failed and kept. A group whose texts all failed the base rules has no thresholds, nor needs any."""
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("for_lang")) & F.col("source").eqNullSafe(F.col("for_source")), "left")
    outlier = F.lit(False)
    for name, value in measures().items():
        outlier = outlier | F.coalesce(value > F.col("limits")[name], F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~outlier).drop("for_lang", "for_source", "limits")


def quality(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, kept for each row of documents (doc_id, text, lang, source)."""
    counts = stage(counted(documents.select("doc_id", "lang", "source", "text")).drop("text"), "counts")
    return judged(counts, stage(thresholds(sketch(counts)), "limits"))


def keep_quality(documents: DataFrame) -> DataFrame:
    """The documents that pass, unchanged. Texts are counted twice, which is cheaper than shuffling them."""
    need = documents.select("lang", "source", "text")
    limits = stage(thresholds(sketch(stage(counted(need).drop("text"), "counts"))), "limits")
    own, back = guarded(documents, "lang", "source", "text")
    return judged(counted(own), limits).where("kept").select(*back)
