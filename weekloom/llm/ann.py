"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

Euclidean search is maximum inner product search in disguise: |q - x|^2 = |q|^2 - 2 q.x + |x|^2, so the nearest
row is the one with the largest q.x - |x|^2 / 2. The norm is kept exactly and q.x is estimated from 4-bit codes.
Codes and codebooks minimise h |parallel residual|^2 + |orthogonal residual|^2, parallel to the vector coded,
because only the parallel part moves the large inner products. Distances don't change when everything is moved, so vectors are coded less the sample's mean.

The best of the scan are scored exactly and give a kth distance. A row is at least |q - code| - |x - code| away, so every other row for which that is not
above the kth distance is scored exactly as well: however well or badly the codes fit, no nearer row of a block is left out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.vector_blocks import best_in_blocks, finite_vectors

#: Codebooks are fitted on at most so many rows (those with the smallest hash of their id); every row is coded.
SAMPLE = 8192
CODES, SUBSPACE = 16, 1
#: Rows of a block that are scored exactly first, for each query; how many follow depends on what they show.
RERANKED = 64
#: Share of the squared lengths by which single-precision sums may err.
SLACK = 1e-5
THRESHOLD = 0.2


def _parts(dim: int) -> list[slice]:
    """Subspaces of SUBSPACE dimensions; the last may have fewer."""
    return [slice(i, min(i + SUBSPACE, dim)) for i in range(0, dim, SUBSPACE)]


def _weight(dim: int) -> float:
    """How much more a parallel residual costs than an orthogonal one, for inner products above THRESHOLD of the norm."""
    return max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def _assign(x: np.ndarray, unit: np.ndarray, books: list[np.ndarray], sweeps: int) -> np.ndarray:
    """Codes by coordinate descent on the anisotropic loss, from the nearest centroids."""
    parts, h = _parts(x.shape[1]), _weight(x.shape[1])
    codes = np.stack([((x[:, p, None] - b.T[None]) ** 2).sum(axis=1).argmin(axis=1) for p, b in zip(parts, books, strict=True)], axis=1)
    along = sum(((x[:, p] - b[codes[:, m]]) * unit[:, p]).sum(axis=1) for m, (p, b) in enumerate(zip(parts, books, strict=True)))
    for _ in range(sweeps):
        for m, (p, b) in enumerate(zip(parts, books, strict=True)):
            rest = along - ((x[:, p] - b[codes[:, m]]) * unit[:, p]).sum(axis=1)
            own = x[:, p, None] - b.T[None]
            part = (own * unit[:, p, None]).sum(axis=1)
            codes[:, m] = ((own**2).sum(axis=1) + (h - 1) * (rest[:, None] + part) ** 2).argmin(axis=1)
            along = rest + np.take_along_axis(part, codes[:, m : m + 1], axis=1)[:, 0]
    return codes


def fit_codebooks(x: np.ndarray, rounds: int = 8) -> list[np.ndarray]:
    """16 centroids for each subspace, by alternating assignment and weighted least squares."""
    parts, h = _parts(x.shape[1]), _weight(x.shape[1])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    order = np.argsort(x.sum(axis=1), kind="stable")
    pick = order[np.linspace(0, len(x) - 1, CODES).astype(int)]
    books = [x[np.ix_(pick, range(x.shape[1])[p])] + 1e-6 * np.arange(CODES)[:, None] for p in parts]
    for r in range(rounds):
        codes = _assign(x, unit, books, sweeps=1 if r else 0)
        along = sum(((x[:, p] - b[codes[:, m]]) * unit[:, p]).sum(axis=1) for m, (p, b) in enumerate(zip(parts, books, strict=True)))
        for m, p in enumerate(parts):
            u, own = unit[:, p], x[:, p]
            rest = along - ((own - books[m][codes[:, m]]) * u).sum(axis=1)
            width = own.shape[1]
            left = np.eye(width)[None] + (h - 1) * u[:, :, None] * u[:, None, :]
            right = (left @ own[:, :, None])[:, :, 0] + (h - 1) * u * rest[:, None]
            for c in range(CODES):
                of = codes[:, m] == c
                if of.any():
                    books[m][c] = np.linalg.solve(left[of].sum(axis=0) + 1e-9 * np.eye(width), right[of].sum(axis=0))
            along = rest + ((own - books[m][codes[:, m]]) * u).sum(axis=1)
    return books


def pack(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], axis=1)
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def scan(queries: np.ndarray, books: list[np.ndarray], packed: np.ndarray) -> np.ndarray:
    """Estimated inner products: one table of 256 sums for each byte, looked up for every row."""
    tables = [queries[:, p] @ b.T for p, b in zip(_parts(queries.shape[1]), books, strict=True)]
    if len(tables) % 2:
        tables.append(np.zeros_like(tables[0]))
    total = np.zeros((len(queries), len(packed)), dtype=np.float32)
    for j in range(packed.shape[1]):
        both = (tables[2 * j + 1][:, :, None] + tables[2 * j][:, None, :]).reshape(len(queries), 256).astype(np.float32)
        total += both[:, packed[:, j]]
    return total


def decoded(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([b[codes[:, m]] for m, b in enumerate(books)], axis=1)


def approximate_search(query_ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, fits: dict[int, tuple]) -> tuple:
    """Code one block, scan it for each query, score the best of the scan exactly, then every row that their distances don't rule out."""
    mean, own = fits[vectors.shape[1]]
    moved, asked = vectors - mean, queries - mean
    norms = np.linalg.norm(moved, axis=1)
    codes = _assign(moved, moved / np.maximum(norms, 1e-300)[:, None], own, sweeps=2)
    packed, near_by = pack(codes), decoded(codes, own)
    left = np.linalg.norm(moved - near_by, axis=1)
    lengths = (near_by**2).sum(axis=1)
    del near_by
    most = min(len(ids), max(RERANKED, k + 1))
    out_q, out_id, out_s = [], [], []
    for at in range(0, len(queries), 64):
        for qid, q, centred, limit, inner in zip(query_ids[at : at + 64], queries[at : at + 64], asked[at : at + 64], limits[at : at + 64], scan(asked[at : at + 64], own, packed), strict=True):
            size = float(centred @ centred)
            closeness = inner - (norms**2 / 2)
            closeness[ids == qid] = -np.inf
            first = np.argpartition(-closeness, most - 1)[:most]
            first = first[ids[first] != qid]
            d = np.sqrt(((vectors[first] - q) ** 2).sum(axis=1))
            worst = np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf
            worst = worst if limit is None or limit != limit else min(worst, limit)
            away = np.sqrt(np.maximum(0.0, size - 2.0 * inner + lengths - SLACK * (size + lengths))) - left
            may = away <= worst * (1 + 1e-9)
            may[first] = False
            may[ids == qid] = False
            rest = np.flatnonzero(may)
            near, d = np.concatenate([first, rest]), np.concatenate([d, np.sqrt(((vectors[rest] - q) ** 2).sum(axis=1))])
            best = np.lexsort((ids[near], d))[:k]
            out_q.append(np.full(len(best), qid))
            out_id.append(ids[near][best])
            out_s.append(d[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def nearest_neighbours(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its k nearest other rows found.

    The score is the Euclidean distance of the original vectors in double precision; nearest first, ties to the smaller id.
    Vectors (or ids) that are null, empty, zero, or hold null or non-finite components take no part; vectors of different length are not
    compared; rows that repeat an id all take part, but not for a query of that id; queries that repeat an id share one list. Other columns are ignored; an empty table gives an empty result."""
    rows = finite_vectors(table, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    fits: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
    for dim in [r.dim for r in rows.select("dim").distinct().collect()]:
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").collect()
        x = np.array([r.v for r in sample], dtype=np.float64)
        fits[dim] = x.mean(axis=0), fit_codebooks(x - x.mean(axis=0))
    shared = rows.sparkSession.sparkContext.broadcast(fits)
    return best_in_blocks(rows, every, k, lambda *blocks: approximate_search(*blocks, k, shared.value), "double", ascending=True)
