"""Boosted stumps for quantiles: steps along the pinball gradient whose leaves are refitted as quantiles of the residuals.

Rows stay where they are, as bin codes written once. A round is one pass over them for all levels: tasks count, for each bin of each feature, the
residuals in fixed cells, and the counts add up as rows (bins x cells x levels at most, whatever the number of rows). A cell edge at 0 makes the gradient
exact; a leaf's quantile is exact to its cell, inside which it is interpolated."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators.stumps import Bins, Model
from weekloom.sources.scratch import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow, but no copy of this module

_SIDE = np.geomspace(0.005, 20.0, 36)
#: Edges of the residual cells: a residual is in the cell of the number of edges below it.
EDGES = np.concatenate([-_SIDE[::-1], [0.0], _SIDE])
CELLS, ZERO = len(EDGES) + 1, len(_SIDE)  # residuals not above 0 are in the cells up to ZERO
#: Relative error of the first guess, the quantile of all targets.
ACCURACY = 10_000


def encoded(rows: DataFrame, bins: Bins, target: str) -> DataFrame:
    """(target, codes): the bins of the features of each row with a target, two bytes each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            codes = bins.codes(columns).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array([c.tobytes() for c in codes], pa.binary())], ["target", "codes"])

    known = rows.where(F.col(target).isNotNull())
    return known.select(F.col(target).cast("double").alias("target"), *[F.col(c).cast("double").alias(c) for c in bins.edges]).mapInArrow(encode, "target double, codes binary")


def residual_counts(rows: DataFrame, models: Sequence[Model], features: int, size: int) -> np.ndarray:
    """counts[level, bin, cell] of the residuals of the encoded ``rows`` from each level's model."""
    shared = rows.sparkSession.sparkContext.broadcast([(m.base, m.adds) for m in models])  # a number for each bin and level

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) * size * CELLS, dtype=np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, features).astype(np.int64)
            for i, (base, adds) in enumerate(shared.value):
                cell = np.searchsorted(EDGES, y - base - adds[codes].sum(axis=1), side="left")
                total += np.bincount(((i * size + codes) * CELLS + cell[:, None]).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["place", "n"])

    found = rows.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # levels x bins x cells at most
    out = np.zeros(len(models) * size * CELLS, dtype=np.int64)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    shared.unpersist()
    return out.reshape(len(models), size, CELLS)


def quantile_of(cells: np.ndarray, level: float) -> float:
    """Quantile of residuals counted in cells; what lies beyond the outermost edges counts as these."""
    total = np.cumsum(cells)
    need = level * total[-1]
    at = int(np.searchsorted(total, need, side="left"))
    before = total[at - 1] if at else 0
    low, high = EDGES[max(at - 1, 0)], EDGES[min(at, len(EDGES) - 1)]
    return float(low + (high - low) * (need - before) / cells[at]) if cells[at] else float(low)


def stepped(model: Model, counts: np.ndarray, level: float, bins: Bins, rate: float, leaf: int) -> bool:
    """One round of ``model``, from the counts of its residuals: the split of greatest gain along the gradient, leaves as quantiles. False if no split fits."""
    firsts, many, above = bins.firsts, counts.sum(axis=1), counts[:, ZERO + 1 :].sum(axis=1)
    pull, best = above - (1.0 - level) * many, None
    for j, (a, b) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
        n, g = many[a:b].sum(), pull[a:b].sum()
        left_n, left_g = np.cumsum(many[a:b])[:-1], np.cumsum(pull[a:b])[:-1]
        fits = (left_n >= leaf) & (n - left_n >= leaf) & (many[a : b - 1] > 0)
        gain = np.where(fits, left_g**2 / np.maximum(left_n, 1) + (g - left_g) ** 2 / np.maximum(n - left_n, 1), -np.inf)
        if len(gain) and np.isfinite(gain.max()) and (best is None or gain.max() > best[0]):
            best = (float(gain.max()), j, int(np.argmax(gain)))
    if best is None:
        return False
    _, j, at = best
    a, b = int(firsts[j]), int(firsts[j + 1])
    cut = a + at + 1
    model.adds[a:cut] += rate * quantile_of(counts[a:cut].sum(axis=0), level)
    model.adds[cut:b] += rate * quantile_of(counts[cut:b].sum(axis=0), level)
    model.chosen.append((j, at))
    return True


def fitted(rows: DataFrame, bins: Bins, target: str, levels: Sequence[float], rounds: int, rate: float, leaf: int) -> list[Model]:
    """A model for each of ``levels`` on all ``rows``; without rows models of no rows. ``rounds`` passes over the coded rows."""
    own = written(encoded(rows, bins, target), "quantile-codes")
    size = int(bins.firsts[-1])
    n, bases = own.select(F.count(F.lit(1)), F.percentile_approx("target", [float(q) for q in levels], ACCURACY)).first()
    models = [Model(float(b), np.zeros(size), n, []) for b in bases] if n else [Model(0.0, np.zeros(size), 0, []) for _ in levels]
    for _ in range(rounds if n else 0):
        counts = residual_counts(own, models, len(bins.edges), size)
        if not any([stepped(m, counts[i], q, bins, rate, leaf) for i, (m, q) in enumerate(zip(models, levels, strict=True))]):
            break
    return models
