"""Which host a record is of: fields that name it, the dictionary of aliases, and what to do with names not in it.

The dictionary is a table (alias, canonical); its file is Parquet, one folder a version, so that a reader never meets
a half-written one. Names that are blank or hold control characters are never stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewire.functions.ids import quoted
from sedgewire.operators.enrich import normal_host, propose_hosts

# Fields that name a record's host, the first that is not blank counts; dotted ones are paths.
HOST_FIELDS = ("Host", "ComputerName", "Computer", "Hostname", "ClientInfo.Hostname", "host.name")


def host_of(df: DataFrame, record: str | None = None) -> Column:
    """The host that a row names, trimmed, or null: by its columns, or by the fields of a variant column."""
    found = []
    for name in HOST_FIELDS:
        if record is not None:
            path = "$" + "".join(f"['{p}']" for p in name.split("."))
            value = F.try_variant_get(record, path, "variant")
            text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(record, path, "string"))
        else:
            head, dot, rest = name.partition(".")
            kind = df.schema[head].dataType if head in df.columns else None
            if dot:
                nested = kind[rest].dataType if isinstance(kind, T.StructType) and rest in kind.fieldNames() else None
                text = quoted(head)[rest] if isinstance(nested, T.StringType) else None
            else:
                text = quoted(head) if isinstance(kind, T.StringType) else None
        if text is not None:
            found.append(F.nullif(F.trim(text), F.lit("")))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def good_name(x: Column) -> Column:
    return F.coalesce((normal_host(x) != "") & ~x.rlike(r"[\x00-\x1F\x7F]"), F.lit(False))


def classify(names: DataFrame, aliases: DataFrame, least: float = 0.85, domains: tuple[str, ...] = ()) -> DataFrame:
    """(name, canonical, how, score) for each distinct good name: `mapped` by the dictionary, `alias` of the canonical it is
    close to, or `new`, a canonical of its own, spelt like the first of its spellings."""
    known = aliases.select(normal_host(F.col("alias")).alias("key"), "canonical").groupBy("key").agg(F.min("canonical").alias("canonical"))
    asked = names.where(good_name(F.col("name"))).select("name", normal_host(F.col("name")).alias("key")).distinct().join(known, "key", "left")
    mapped = asked.where("canonical is not null").select("name", "canonical", F.lit("mapped").alias("how"), F.lit(1.0).alias("score"))
    rest = asked.where("canonical is null").select("name", "key")
    close = propose_hosts(rest.select("name"), aliases.select("canonical").distinct(), least, domains)
    rest = rest.join(close, "name", "left")
    first = rest.where("canonical is null").groupBy("key").agg(F.min("name").alias("first"))
    rest = rest.join(first, "key", "left")
    how = F.when(F.col("canonical").isNotNull(), F.lit("alias")).otherwise(F.lit("new"))
    return mapped.unionByName(rest.select("name", F.coalesce("canonical", "first").alias("canonical"), how.alias("how"), F.coalesce("score", F.lit(1.0)).alias("score")))


def learnt(aliases: DataFrame, found: DataFrame, least: float = 1.0) -> DataFrame:
    """The dictionary with what classify found, close names only from this score on; what it held already wins."""
    old = aliases.select("alias", "canonical", normal_host(F.col("alias")).alias("key"), F.lit(0).alias("age"))
    new = found.where((F.col("how") == "new") | (F.col("how") == "alias") & (F.col("score") >= least))
    new = new.select(F.col("name").alias("alias"), "canonical", normal_host(F.col("name")).alias("key"), F.lit(1).alias("age"))
    best = old.unionByName(new).groupBy("key").agg(F.min(F.struct("age", "alias", "canonical")).alias("best"))
    return best.select("best.alias", "best.canonical")


def save_dictionary(spark: SparkSession, path: str, aliases: DataFrame) -> None:
    """Adds a version of the dictionary; the last one written is the one that is read."""
    kept = aliases.where(good_name(F.col("alias")) & good_name(F.col("canonical"))).select("alias", "canonical").dropDuplicates(["alias"])
    kept.write.parquet(f"{path}/version={_last_version(spark, path) + 1}")


def _last_version(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return 0
    done = spark._jvm.org.apache.hadoop.fs.Path
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return max((int(n.partition("=")[2]) for n in names if n.startswith("version=") and fs.exists(done(f"{path}/{n}/_SUCCESS"))), default=0)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    last = _last_version(spark, path)
    return spark.read.schema("alias string, canonical string").parquet(f"{path}/version={last}") if last else spark.createDataFrame([], "alias string, canonical string")
