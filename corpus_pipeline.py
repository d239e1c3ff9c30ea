"""From raw documents to token ids, in five stages; each stage's rows are written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns rows with the columns of documents, the last one token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.llm.bpe import bpe_encode
from weekloom.llm.jaccard_join import jaccard_join
from weekloom.llm.language import keep_identified
from weekloom.llm.mixing import mix_sources
from weekloom.llm.queries import BPE_PATTERN, BPE_RANKS
from weekloom.llm.secrets import redact_secrets
from weekloom.llm.shared import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go."""
    return keep_identified(docs)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a 64-bit hash of each row, and the name of that column: doc_ids may repeat or be null, and each row counts."""
    key = "_" + max(docs.columns, key=len)  # longer than any, so no other column's name
    return docs.withColumn(key, F.xxhash64(*docs.columns, *[F.col(f"`{c}`").isNull() for c in docs.columns])), key


def once(rows: DataFrame, key: str) -> DataFrame:
    """One of the rows that are alike in every column."""
    nth = key + "n"
    return rows.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(nth) == 1).drop(nth)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked at a similarity of 0.8 on five-word shingles, the one with the smallest doc_id stays, null the last.

    Rows are linked by their texts, whatever their doc_id: unlike texts of one id both stay, like ones don't, and of rows alike in every column one
    stays. Texts that are null or hold no word are linked with nothing and stay."""
    rows, key = keyed(docs)
    found = jaccard_join(rows, id_col=key, k=5, num=80, den=100).select(F.col("doc_id").alias(key), "component_id").distinct()
    named = rows.select(key, F.col("doc_id").alias("id")).distinct().join(found, key)
    stays = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", key)).alias("first")).select(F.col(f"first.{key}").alias(key))
    return once(rows, key).join(stays, key, "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out; documents stay, null and empty texts as they are."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is taken as often as the mix asks: not at all, once or twice.

    Rows without words, or without a doc_id, are rows of their source like any other; rows alike in every column are taken as often as all of them together."""
    rows, key = keyed(docs)
    times = key + "n"
    copies = mix_sources(rows, id_col=key).groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").alias(times)).where(F.col(times) > 0)
    taken = once(rows, key).join(copies, key)
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, none for null and empty texts, and the digests that show that they decode to its text."""
    return bpe_encode(docs, BPE_RANKS, BPE_PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

#: Language identification is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
