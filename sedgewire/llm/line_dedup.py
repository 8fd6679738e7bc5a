"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line is the sequence of its words. The edit bound is one word (put in, left out or changed) for lines of
NEAR_WORDS words or more, and none for shorter ones. A line goes if an earlier line, by (doc_id, line number), is
within the bound; lines without words stay.

1. Equal lines: partial aggregates by a 128-bit hash find each distinct line's first place.
2. Two lines within one edit share their first or their last half, exactly (halves of ceil((n - 1) / 2) words, for the
   line's n and n + 1). Distinct lines that share no half with another have no partner and are left out.
3. The others emit every variant within the bound as a hashed key: the whole line, and the line without each of its
   words. A word hashes with its position, and a key is the xor of the words before the gap with those after it
   moved up by one; so all keys of a line come from two running xors.
4. Equal variants are joined: a line needs only the earliest line whose whole is its variant, or whose variant is
   its whole, or which has the same variant with the same gap; all that share the latter differ in that one word.
   So a star of the earliest replaces all pairs. The edit distance of each such pair is verified on the words.

Defined results: null and empty texts have no lines that could go; rows equal in doc_id and text are one document
and keep the same lines; a null doc_id comes after all others; extra columns are kept by keep_lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewire.llm.common import guarded, if_small, stage

NEAR_WORDS = 8
_LAST = (1 << 63) - 1


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, "\t\x0b\f\r", "    "), " "), "")


def _identified(documents: DataFrame) -> DataFrame:
    """documents with `at` and `text_hash`, which name a document."""
    return documents.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("at_"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash_"))


def _lines(documents: DataFrame) -> DataFrame:
    return documents.select("at_", "hash_", F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line"))


def _half(words: Column, side: str, n: Column) -> Column:
    some = F.slice(words, 1, n) if side == "first" else F.slice(words, F.size(words) - n + 1, n)
    return F.xxhash64(F.lit(side), some)


def distinct_lines(documents: DataFrame, near_words: int) -> tuple[DataFrame, DataFrame]:
    """The places of all lines with words, and the distinct lines with their number, first place and half keys."""
    #: Filtered on the line, as a filter on the words would split each line twice.
    rows = _lines(_identified(documents)).where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).select("at_", "hash_", "line_no", words_of(F.col("line")).alias("w"))
    n = F.size("w")
    #: The two half lengths of an even n are equal.
    lengths = ((F.floor(n / 2).cast("int"), n >= near_words), (F.ceil(n / 2).cast("int"), (n >= near_words) & (n % 2 == 1)))
    halves = [F.when(has, _half(F.col("w"), side, x)).alias(f"half{k}") for k, (side, (x, has)) in enumerate((s, x) for s in ("first", "last") for x in lengths)]
    places = stage(rows.select("at_", "hash_", "line_no", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("other"), "w").alias("h2"), *halves), "lines")
    first = F.min(F.struct("at_", "hash_", "line_no")).alias("first")
    lines = places.groupBy("h1", "h2").agg(first, F.count("*").alias("n"), *(F.max(f"half{k}").alias(f"half{k}") for k in range(4)))
    return places, stage(lines, "distinct")


def near_lines(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within one edit, not equal."""
    line, first = ["h1", "h2"], F.col("first")
    keyed = lines.where("half0 is not null").select(*line, "first", F.explode(F.array_distinct(F.array(*(f"half{k}" for k in range(4))))).alias("half")).where("half is not null")
    shared = keyed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    shared = if_small(stage(shared, "halves"))
    wanted = stage(keyed.join(shared, "half", "left_semi").select(*line, first["at_"].alias("at_"), first["hash_"].alias("hash_"), first["line_no"].alias("line_no")).distinct(), "wanted")

    texts = _lines(_identified(documents).select("text", "at_", "hash_")).join(if_small(wanted), ["at_", "hash_", "line_no"])
    place = F.struct("at_", "hash_", "line_no").alias("place")
    words = stage(texts.dropDuplicates(["at_", "hash_", "line_no"]).select(*line, place, words_of(F.col("line")).alias("w")), "words")

    each = words.select(*line, F.size("w").alias("n"), F.posexplode("w").alias("gap", "word"))
    each = each.select(*line, "n", "gap", F.xxhash64("gap", "word").alias("here"), F.xxhash64(F.col("gap") - 1, "word").alias("moved"))
    order = Window.partitionBy(*line).orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*line)
    xor = lambda name, over: F.expr(f"bit_xor({name})").over(over)
    #: Before the gap as they stand, after it moved up; the whole line is a gap at -1.
    cut = each.select(*line, "n", "gap", xor("here", order).bitwiseXOR(F.col("here")).bitwiseXOR(xor("moved", whole)).bitwiseXOR(xor("moved", order)).alias("cut"), xor("here", whole).alias("all"))
    own = F.struct(F.col("gap"), (F.col("n") - 1).alias("left"), F.col("cut").alias("key"))
    uncut = F.struct(F.lit(-1).alias("gap"), F.col("n").alias("left"), F.col("all").alias("key"))
    variants = stage(cut.select(*line, F.explode(F.when(F.col("gap") == 0, F.array(own, uncut)).otherwise(F.array(own))).alias("v")).select(*line, "v.gap", "v.left", "v.key"), "variants")

    met = stage(variants.groupBy("key", "left").agg(F.count("*").alias("n")).where("n > 1").select("key", "left"), "met")
    variants = stage(variants.join(if_small(met), ["key", "left"]).join(words.select(*line, "place"), line), "equal")
    earliest = F.min(F.struct("place", *line)).alias("to")
    same_gap = variants.groupBy("key", "left", "gap").agg(earliest)
    by_cut = variants.where("gap >= 0").groupBy("key", "left").agg(earliest)
    wholes, cuts = variants.where("gap = -1"), variants.where("gap >= 0")
    pairs = cuts.join(same_gap.where("gap >= 0"), ["key", "left", "gap"]).select(*line, "place", "to")
    pairs = pairs.union(cuts.join(same_gap.where("gap = -1").drop("gap"), ["key", "left"]).select(*line, "place", "to"))
    pairs = pairs.union(wholes.join(by_cut, ["key", "left"]).select(*line, "place", "to"))
    pairs = pairs.where("to.place < place").select(*line, F.col("to.h1").alias("to1"), F.col("to.h2").alias("to2")).distinct()
    pairs = pairs.join(words.select(*line, "w"), line).join(words.select(F.col("h1").alias("to1"), F.col("h2").alias("to2"), F.col("w").alias("v")), ["to1", "to2"])
    return pairs.where(within_one(F.col("w"), F.col("v"))).select(*line).distinct()


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are one edit apart or equal: what they share at the front and at the back leaves one word."""
    shared = lambda x, y: F.array_position(F.concat(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.array(F.lit(False))), False) - 1
    longest, shortest = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    return (longest - shortest <= 1) & (shared(a, b) + shared(F.reverse(a), F.reverse(b)) >= longest - 1)


def removed_lines(documents: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(at_, hash_, removed): the line numbers that go from each document that loses any, in order."""
    places, lines = distinct_lines(documents.select("doc_id", "text"), near_words)
    near = stage(near_lines(documents.select("doc_id", "text"), lines), "near").withColumn("near", F.lit(True))
    verdict = stage(lines.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").where("n > 1 or near").drop("n"), "verdict")
    gone = places.select("at_", "hash_", "line_no", "h1", "h2").join(if_small(verdict), ["h1", "h2"])
    gone = gone.where(F.coalesce("near", F.lit(False)) | (F.struct("at_", "hash_", "line_no") != F.col("first")))
    return gone.groupBy("at_", "hash_").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def _deduped(documents: DataFrame, near_words: int) -> DataFrame:
    """documents (no column of ours among theirs) with removed_ and kept_."""
    gone = stage(removed_lines(documents, near_words), "removed").select(F.col("at_").alias("of_"), F.col("hash_").alias("of_hash_"), "removed")
    out = _identified(documents).join(gone, (F.col("at_") == F.col("of_")) & (F.col("hash_") == F.col("of_hash_")), "left")
    #: A column of its own: within the lambda below the text would be split again for each line.
    out = out.withColumn("lines_", F.when(F.col("removed").isNotNull(), F.split(F.col("text").cast("string"), "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines_") - 1), F.col("removed"))
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.get("lines_", k)), "\n"))
    return out.withColumn("kept_", kept).withColumn("removed_", F.coalesce("removed", F.array().cast("array<int>")))


def dedup_lines(documents: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """documents with `removed`, the numbers of the lines that go, and `kept_text`; columns of these names are replaced."""
    own, back = guarded(documents.drop("removed", "kept_text"), "doc_id", "text")
    return _deduped(own, near_words).select(*back, F.col("removed_").alias("removed"), F.col("kept_").alias("kept_text"))


def keep_lines(documents: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """documents with the lines that stay as their text, and n_chars to match; those that lose all their words go."""
    own, back = guarded(documents, "doc_id", "text")
    out = _deduped(own, near_words)
    emptied = (F.size("removed_") > 0) & ~F.col("kept_").rlike("[^\\x20\\x09-\\x0D]")
    put = {"text": F.col("kept_").alias("text")} | ({"n_chars": F.length("kept_").cast(documents.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in documents.columns else {})
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*(put.get(c, b) for c, b in zip(documents.columns, back, strict=True)))
