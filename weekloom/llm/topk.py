"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from weekloom.llm.vector_blocks import best_in_blocks, finite_vectors

#: Entries read from every list in the first round; each later round doubles the depth.
FIRST_DEPTH = 16
LARGEST = (1 << 63) - 1


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component: doubles, which are whole and exact, or Python integers where scale * x is beyond doubles."""
    with np.errstate(over="ignore"):
        y = np.floor(vectors * scale)
    return y if np.isfinite(y).all() else np.array([[int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in row] for row in vectors], dtype=object)


def exact_pair(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same numbers in a type in which no inner product of the two loses a digit: double, 64-bit integer, or Python integers."""
    most = lambda x: int(max(abs(x.max()), abs(x.min()))) if x.size else 0
    bound = most(queries) * most(vectors) * max(1, vectors.shape[1])
    if bound < 1 << 53:
        return queries.astype(np.float64), vectors.astype(np.float64)
    if bound < 1 << 63:
        return queries.astype(np.int64), vectors.astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return whole(queries), whole(vectors)


def _long(scores: np.ndarray) -> np.ndarray:
    return np.array([max(-LARGEST - 1, min(LARGEST, x)) for x in scores], dtype=object) if scores.dtype == object else scores


def threshold_search(query_ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple:
    """Best k rows of each query in one block of integer vectors, ties to the smaller id; rows that score below a query's limit may be left out.

    Each dimension has a list of rows sorted by component. A query reads the list of a dimension from its high
    end if its own component is positive, from the low end if negative, and not at all if zero; rows met
    for the first time are scored in whole (random access). After each round the bound is the score of a row
    that has, in each dimension, the component last read there. Reading stops when the bound is below the
    kth best score or the limit: no unread row can then reach it, not even as a tie."""
    queries, vectors = exact_pair(queries, vectors)
    n = len(vectors)
    up = np.argsort(vectors, axis=0, kind="stable")
    low_to_high = np.take_along_axis(vectors, up, axis=0)
    out_q, out_id, out_s = [], [], []
    for qid, q, limit in zip(query_ids, queries, limits, strict=True):
        used = np.flatnonzero(q)
        rising = q[used] < 0
        seen = np.zeros(n, dtype=bool)
        met, scores, depth, last = [], [], 0, FIRST_DEPTH
        while depth < n:
            to = min(n, last)
            if len(used):
                read = np.concatenate([up[depth:to, used[rising]].ravel(), up[n - to : n - depth, used[~rising]].ravel()])
                fresh = np.zeros(n, dtype=bool)
                fresh[read] = True
                new = np.flatnonzero(fresh & ~seen)
            else:  # every score is 0
                to, new = n, np.arange(n)
            seen[new] = True
            new = new[ids[new] != qid]
            met.append(new)
            scores.append(_long(vectors[new] @ q))
            depth, last = to, to * 2
            all_scores = np.concatenate(scores)
            bound = np.where(rising, low_to_high[depth - 1, used], low_to_high[n - depth, used]) @ q[used]
            bound = _long(np.array([bound], dtype=vectors.dtype))[0]
            if limit == limit and bound < limit or len(all_scores) >= k and bound < np.partition(all_scores, -k)[-k]:
                break
        found, s = np.concatenate(met), np.concatenate(scores)
        best = np.lexsort((ids[found], -s))[:k]
        out_q.append(np.full(len(best), qid))
        out_id.append(ids[found][best])
        out_s.append(s[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def topk_inner_product(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, every: int = 100, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its k best other rows.

    A component x counts as floor(scale * x); the score is the integer inner product, ties go to the smaller id.
    Vectors (or ids) that are null, empty, or hold null or non-finite components take no part. Components of any size are exact; a score
    beyond a long counts as the nearest long. Vectors of different length are not compared. Rows
    that repeat an id all take part, but not for a query of that id; queries that repeat an id share one list. Other columns are ignored; an empty table gives an empty result."""
    rows = finite_vectors(table, id_col, vec_col)

    def search(query_ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple:
        limits = [None if x is None or x != x or abs(x) >= 2.0**53 else int(x) for x in limits.tolist()]
        a, b, s = threshold_search(query_ids, scaled(queries, scale), [float("nan") if x is None else x for x in limits], ids, scaled(vectors, scale), k)
        return a, b, np.array([int(x) for x in s.tolist()], dtype=np.int64)

    return best_in_blocks(rows, every, k, search, "long", ascending=False)
