"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weekloom.llm.ann import nearest_neighbours
from weekloom.llm.bpe import bpe_encode
from weekloom.llm.html_text import extract_main_text
from weekloom.llm.infill import INFILL_SQL, fill_in_middle
from weekloom.llm.jaccard_join import jaccard_join
from weekloom.llm.language import identify_languages
from weekloom.llm.lexical import LEXICAL_SQL, ranked_search
from weekloom.llm.mixing import MIX_SQL, mix_sources
from weekloom.llm.phrases import CONTAMINATION_SQL, contamination
from weekloom.llm.secrets import scan_secrets
from weekloom.llm.substring_dedup import repeated_passages
from weekloom.llm.topk import topk_inner_product
from weekloom.llm.toxicity import score_toxicity

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE_PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_inner_product(_table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents"), BPE_RANKS, BPE_PATTERN, with_ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(_table(spark, sf_dir, "documents"), with_output=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_topk,
        op2_substring_dedup,
        op3_ngram_jaccard_join,
        op4_anisotropic_ann,
        op5_language_id,
        op6_byte_bpe,
        op7_toxicity,
        op8_mix_sources,
        op9_html_text,
        op10_secret_scan,
        op11_ranked_search,
        op12_decontamination,
        op13_fill_in_middle,
    )
}

_VECTORS = """
with v as (
  select vec_id, embedding from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)"""

ORACLES = {
    "op1_exact_topk": _VECTORS
    + """, z as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from v
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from z q join z c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op8_mix_sources": MIX_SQL.format(docs="documents"),
    "op11_ranked_search": LEXICAL_SQL.format(docs="documents", items="benchmark"),
    "op12_decontamination": CONTAMINATION_SQL.format(docs="documents", items="benchmark"),
    "op13_fill_in_middle": INFILL_SQL.format(docs="documents"),
}
