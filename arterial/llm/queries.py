"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, cover_tree, decontaminate, jaccard_join, language_id, line_dedup, mixing, secrets, suffix_dedup, warc_zip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat.digests(chat.windows(rows))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("long").alias("n_items"),
        F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["per_mille"])), F.lit(0)).alias("per_mille"),
    )


def _train(docs: DataFrame) -> DataFrame:
    return docs.where(~language_id.held_out()).select("text", "lang")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.identify(docs.select("doc_id", "text"), language_id.fit(_train(docs)))
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_zip.write_archives(_table(spark, sf_dir, "pages"), warc_zip.archive_folder(spark))
    return warc_zip.read_archives(manifest).drop("url")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.kept_digest(suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def weighted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``w``, the quality weight: 2 for good documents, 1/2 for others, 1 where nothing is known."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    known = known.select(F.col("doc_id").alias("labelled"), F.when(F.col("q") > 0, 2.0).when(F.col("q") == 0, 0.5).alias("w"))
    return docs.join(known, F.col("doc_id") == F.col("labelled"), "left").drop("labelled")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.sized(_table(spark, sf_dir, "documents"))
    out = mixing.mix(weighted(docs, _table(spark, sf_dir, "labels")), F.col("w"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_chat_format,
        op3_decontaminate,
        op4_language_id,
        op5_embedding_dedup,
        op6_jaccard_join,
        op7_warc_zip,
        op8_secret_scan,
        op9_suffix_dedup,
        op10_mix_sources,
        pipeline,
    )
}
