"""Corpus pipeline: documents pass five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and returns the columns of docs; the last adds size,
source_size, target and taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.hostrules import host_rules
from tidemark.llm.mixing import mix_by_weight
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.shared import cut, row_key
from tidemark.llm.substrings import remove_repeated_windows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes.

    A null text fails; a null source is a host of its own; equal rows stay or go together; an
    empty table gives an empty one.
    """
    return host_rules(docs).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id, null ids last; of
    several with that id the one with the smallest row key.

    Rows are told apart by all their columns, so a repeated id is no obstacle. Texts without words
    are no duplicates of each other, but of equal rows one stays. An empty table gives an empty one.
    """
    key = "row_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, row_key(docs.columns))
    found = near_duplicates(keyed.select("doc_id", "text", key), carry=[key])
    group = F.coalesce(F.col("class").cast("string"), F.col(f"row.{key}"))
    first = found.groupBy(group.alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", f"row.{key}")).alias("f"))
    return keyed.dropDuplicates([key]).join(cut(first.select(f"f.{key}"), "firsts"), key, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 35 words that stand more than once; n_chars follows the text.

    All rows stay, those with null or short texts as they are; equal rows are repeats of each other.
    """
    out = remove_repeated_windows(docs, 35)
    text = F.coalesce("kept_text", "row.text")
    changed = {"text": text, "n_chars": F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text")) if "n_chars" in docs.columns else None}
    return out.select(*[(changed[c] if changed.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts hold none; an empty benchmark keeps all."""
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("leaks") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (words).

    Texts without words are not taken. Where docs has a column of such a name, the added one has
    `_mixed` behind its name.
    """
    out = mix_by_weight(docs).filter("taken > 0")
    added = [F.col(c).alias(c if c not in docs.columns else f"{c}_mixed") for c in ("size", "source_size", "target", "taken")]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *added)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Similarity classes can't be told in SQL; the tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return docs
