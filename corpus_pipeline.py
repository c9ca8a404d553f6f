"""A training corpus from ``documents``, in stages.

Each stage is a function of (spark, docs, sf_dir) that calls one operator and returns a DataFrame with
the columns of documents (the last one: the mix). ``run`` writes each stage's result to the shared
folder and reads it back, so a lost executor costs one stage at most.

Defined cases: an empty table stays empty; repeated rows and rows with equal or null ids are judged each, and those of
one text alike; columns besides those of documents, also ones named like an operator's own, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arterial.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from arterial.llm.common import stored
from arterial.llm.queries import weighted


def _beside(docs: DataFrame, *taken: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that an operator takes for its own under other names, and the columns that give all back."""
    own = {c: f"__kept_{i}" if c in taken else c for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items())), [F.col(f"`{x}`").alias(c) for c, x in own.items()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go."""
    model = language_id.fit(docs.where(~language_id.held_out()).select("text", "lang"))
    docs, columns = _beside(docs, "lang_pred", "score", "ambiguous")
    out = language_id.identify(docs, model, keep=tuple(docs.columns))
    return out.where("lang_pred <> 'und'").select(*columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; so do documents of which no word is left."""
    docs, columns = _beside(docs, "n_lines", "n_removed", "n_runs", "__doc", "__th", "__gone", "__from", "__to")
    out = line_dedup.line_dedup(docs)
    return out.where((F.col("n_removed") == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).select(*columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of the smallest id stays; null ids and repeated rows too."""
    classes = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    late = classes.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(late, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs, columns = _beside(docs, "leaks", "__k1", "__k2")
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("size(leaks) = 0").select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: ``doc_id, source, size, source_size, target, taken``."""
    return mixing.mix(weighted(mixing.sized(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")), F.col("w"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontaminate", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
]

#: SQL can't express the classifier, the verified seeds or the components; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
