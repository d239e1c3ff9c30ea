"""Queries against all rows, in blocks.

Rows are dealt into blocks of about ``ROWS`` by a hash of their id and queries into blocks of about
``QUERIES``; every block of rows meets every block of queries in a task of its own. Query rows are a stated
set (ids divisible by ``every``). Each block returns its best k of each query, and a window keeps the best k
of all. A first pass over one block gives each query the kth score there, which no block needs to look below."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.shared import materialize

ROWS = 16384
QUERIES = 4096


def finite_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id long, v array<double>, dim int`` of the rows whose id and vector are whole: no null, no non-finite component, not empty."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(vec_col).alias("dim"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.col("dim") > 0) & ~bad)


def best_in_blocks(rows: DataFrame, every: int, k: int, search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple], score_type: str, ascending: bool) -> DataFrame:
    """``search(query_ids, queries, limits, ids, vectors)`` gives arrays (query_id, vec_id, score) for one pair of blocks; scores
    worse than a query's limit, if that isn't NaN, are of no use.

    Vectors are only compared with vectors of their own length. Rows that repeat a vec_id all take part, but never for a query of that id;
    queries that repeat an id have one list of k between them."""
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).collect()  # a row for each vector length
    n, q = max((r.n for r in sizes), default=0), max((r.q for r in sizes), default=0)
    blocks, sets = max(1, math.ceil(n / ROWS)), max(1, math.ceil(q / QUERIES))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    mine = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(sets)).cast("int")
    dealt = rows.select("vec_id", "v", "dim", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"))
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", "dim", mine.alias("set"), F.lit(None).cast(score_type).alias("limit"))
    key = ["dim", "block", "set"]
    order = F.asc("score") if ascending else F.desc("score")
    w = Window.partitionBy("query_id").orderBy(order, "vec_id")

    def one(pdf: pd.DataFrame) -> tuple:
        return pdf["vec_id"].to_numpy(np.int64), np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1), pdf["limit"].to_numpy() if "limit" in pdf else None

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, vectors, _ = one(left)
        query_ids, queries, limits = one(right)
        a, b, s = search(query_ids, queries, limits, ids, vectors)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    def best(rows: DataFrame, queries: DataFrame) -> DataFrame:
        found = rows.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(pair, f"query_id long, vec_id long, score {score_type}")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if blocks > 1:
        first = best(dealt.where("block = 0"), asked.withColumn("block", F.lit(0))).where(F.col("rank") == k)
        limits = materialize(first.select(F.col("query_id").alias("vec_id"), F.col("score").alias("limit")), "search-limits")
        asked = asked.drop("limit").join(limits, "vec_id", "left").select("vec_id", "v", "dim", "set", "limit").toDF("vec_id", "v", "dim", "set", "limit")
    return best(dealt, asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
