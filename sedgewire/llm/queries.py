"""The thin queries over the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_embedding_dedup(spark, sf_dir):
    from sedgewire.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_source_mixing(spark, sf_dir):
    from sedgewire.llm.mixing import mixed_words

    return mixed_words(table(spark, sf_dir, "documents"))


def op3_warc_transactions(spark, sf_dir):
    from sedgewire.llm.warc import captures

    made = captures(table(spark, sf_dir, "pages"))
    return made.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


def op4_line_dedup(spark, sf_dir):
    from sedgewire.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    return out.select("doc_id", lines.alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op5_best_fit_packing(spark, sf_dir):
    from sedgewire.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), vocabulary())


def op6_quality_rules(spark, sf_dir):
    from sedgewire.llm.quality import BASE, quality

    return quality(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept")


def op7_html_extraction(spark, sf_dir):
    from sedgewire.llm.html_extract import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op8_minhash_dedup(spark, sf_dir):
    from sedgewire.llm.minhash_dedup import near_documents

    return near_documents(table(spark, sf_dir, "documents"))


def op9_url_filters(spark, sf_dir):
    from sedgewire.llm.url_filter import filtered

    pages = table(spark, sf_dir, "pages")
    #: A page shows the document whose number ends its path; that document's quality labels the url.
    shown = pages.select("url", F.regexp_extract("url", r"^[^?#]*/(\d+)(?:\.\w+|/)?(?:[?#].*)?$", 1).try_cast("long").alias("doc_id"))
    labels = shown.join(table(spark, sf_dir, "labels"), "doc_id").select("url", (F.col("quality") == 0).cast("int").alias("bad"))
    return filtered(pages, labels)


def op10_training_order(spark, sf_dir):
    from sedgewire.llm.training_order import ordered

    return ordered(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline} | {f.__name__: f for f in (op1_embedding_dedup, op2_source_mixing, op3_warc_transactions, op4_line_dedup, op5_best_fit_packing, op6_quality_rules, op7_html_extraction, op8_minhash_dedup, op9_url_filters, op10_training_order)}


def oracle_sql() -> dict[str, str]:
    from sedgewire.llm.oracles import SQL

    return SQL
