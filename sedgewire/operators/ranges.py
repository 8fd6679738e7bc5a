"""Rows meet ranges of addresses: where an address is, whose it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewire.functions.ids import quoted
from sedgewire.operators.enrich import spread

BITS = 32
_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def ipv4(x: Column) -> Column:
    """An IPv4 address as a number, null for anything else."""
    parts = F.split(F.trim(x), r"\.")
    number = sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("long") * (1 << 8 * (3 - k)) for k in range(4)), F.lit(0))
    return F.when(F.trim(x).rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), number)


def prefixes(ranges: DataFrame) -> DataFrame:
    """ranges (first, last as numbers, and others) cut into aligned blocks: a row for each, with `low_bits` and `block`, at
    most two of a size. A block of a size is one of a range's if it begins or ends the range's run of such blocks at an odd
    place: the others are halves of larger ones."""
    size = F.expr("shiftleft(1L, low_bits)")
    cut = ranges.where("first <= last").withColumn("low_bits", F.explode(F.sequence(F.lit(0), F.lit(BITS))))
    cut = cut.withColumn("lo_", F.floor((F.col("first") + size - 1) / size).cast("long")).withColumn("hi_", F.floor((F.col("last") + 1) / size).cast("long")).where("lo_ < hi_")
    ends = F.array(F.when(F.col("lo_") % 2 == 1, F.col("lo_")), F.when(F.col("hi_") % 2 == 1, F.col("hi_") - 1))
    return cut.withColumn("block", F.explode(F.array_distinct(F.array_compact(ends)))).drop("lo_", "hi_")


def stamp_ranges(df: DataFrame, ranges: DataFrame, column: str, to: str, label: str = "label") -> DataFrame:
    """df with `to`: the label of the range (first, last: IPv4 texts, both included) that holds the address in a column,
    null where there is none. Of several the narrowest counts, then the least label. Ranges become aligned blocks and each
    different address asks once for each size of block there is, so all is joined by equality, however wide ranges are."""
    known = ranges.select(ipv4(F.col("first")).alias("first"), ipv4(F.col("last")).alias("last"), F.col(label).alias("label_"))
    blocks = prefixes(known).groupBy("low_bits", "block").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("width"), "label_")).alias("best_"))
    asked = df.select(quoted(column).alias("ip_")).distinct().withColumn("at_", ipv4(F.col("ip_"))).where("at_ is not null")
    sizes = F.broadcast(blocks.select("low_bits").distinct())  # 33 rows at most
    asked = asked.withColumn("low_bits", F.explode(F.sequence(F.lit(0), F.lit(BITS)))).join(sizes, "low_bits", "left_semi")
    asked = asked.withColumn("block", F.expr("shiftright(at_, low_bits)"))
    found = asked.join(blocks, ["low_bits", "block"]).groupBy("ip_").agg(F.min("best_").alias("best_"))
    found = found.select("ip_", F.col("best_.label_").alias("found_"))
    out = df.withColumn("on_", spread(quoted(column), df)).join(found, F.col("on_") == F.col("ip_"), "left")
    return out.select(*(quoted(c) for c in df.columns if c != to), F.col("found_").alias(to))


def run_then_deleted(prefetch: DataFrame, mft: DataFrame) -> DataFrame:
    """Prefetch rows (ExecutableName) of programs that the file table (FileName, InUse) only knows as deleted."""
    state = mft.where("FileName is not null").groupBy(F.upper("FileName").alias("name_")).agg(F.max(F.coalesce(F.col("InUse").cast("string").ilike("true"), F.lit(False))).alias("there_"))
    return prefetch.join(state.where("not there_"), F.upper("ExecutableName") == F.col("name_"), "left_semi")
