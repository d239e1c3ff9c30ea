"""Boosted stumps for many histories at once, fitted on summaries of bounded size.

Features fall into fixed bins, whose edges don't depend on data: a model can't learn of the future through them, and summaries add up. A stump sees a row only
through its bins, so how residuals change is known from how often two bins meet. The summary of a set of rows is therefore, for each pair of bins, the
number of rows in both, and for each bin the sum of the targets: some 100,000 numbers, whatever the number of rows. Rows are summed up once, by the
first cut (a date that ends a history) that has them; a model's summary is the running sum over the cuts up to its own.

On the binned features the result is that of boosting on the rows: every split between two bins is tried in every round."""

from __future__ import annotations

import datetime as dt
import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow, but no copy of this module


@dataclass(frozen=True)
class Bins:
    """Edges of each feature, in order: a value is in the bin of the number of edges below it."""

    edges: dict[str, np.ndarray]

    @property
    def firsts(self) -> np.ndarray:
        """Where each feature's bins begin among all, and the number of all."""
        return np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges.values()])])

    def codes(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """For each row and feature the number of its bin among all."""
        return np.stack([np.searchsorted(e, x, side="left") + f for e, x, f in zip(self.edges.values(), columns, self.firsts, strict=False)], axis=1)


@dataclass
class Model:
    """base plus, for each feature, what its bin adds; rows is how many it was fitted on."""

    base: float
    adds: np.ndarray
    rows: int
    chosen: list[tuple[int, int]]


def boosted(meet: np.ndarray, sums: np.ndarray, firsts: np.ndarray, rounds: int, rate: float, leaf: int) -> Model:
    """Squared-error boosting from a summary: meet[a, b] rows are in the bins a and b, sums[a] is the sum of the targets in a.

    A round takes the split with the greatest gain, the first of equals in the order of features and bins, with ``leaf`` rows or more on each side."""
    counts = np.diag(meet)
    n = int(counts[firsts[0] : firsts[1]].sum())
    if not n:
        return Model(0.0, np.zeros(len(sums)), 0, [])
    base = float(sums[firsts[0] : firsts[1]].sum()) / n
    left_of = np.concatenate([np.cumsum(counts[a:b])[:-1] for a, b in zip(firsts[:-1], firsts[1:], strict=True)])
    ends = np.concatenate([np.arange(a, b - 1) for a, b in zip(firsts[:-1], firsts[1:], strict=True)])  # the last bin on the left of each split
    feature = np.searchsorted(firsts, ends, side="right") - 1
    # equal splits on both sides of empty bins count once, as the first
    fits = (left_of >= leaf) & (n - left_of >= leaf) & (counts[ends] > 0)
    rest, adds, chosen = sums - base * counts, np.zeros(len(sums)), []
    for _ in range(rounds if fits.any() else 0):
        left = np.concatenate([np.cumsum(rest[a:b])[:-1] for a, b in zip(firsts[:-1], firsts[1:], strict=True)])
        total = np.add.reduceat(rest, firsts[:-1])[feature]
        gain = np.where(fits, left**2 / np.maximum(left_of, 1) + (total - left) ** 2 / np.maximum(n - left_of, 1), -np.inf)
        at = int(np.argmax(gain))
        j, end = int(feature[at]), int(ends[at])
        low, high = float(left[at] / left_of[at]), float((total[at] - left[at]) / (n - left_of[at]))
        step = np.zeros(len(sums))
        step[firsts[j] : end + 1], step[end + 1 : firsts[j + 1]] = rate * low, rate * high
        adds += step
        rest = rest - meet @ step
        chosen.append((j, end - int(firsts[j])))
    return Model(base, adds, n, chosen)


def summaries(rows: DataFrame, bins: Bins, slots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slot in order (meet, sums) over the ``rows(slot, target, features...)``; a slot without rows has zeros.

    A task sums up its rows and sends a part for each slot and feature; the parts are added feature by feature."""
    size, firsts = int(bins.firsts[-1]), bins.firsts

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            slot, target, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            codes = bins.codes(columns)
            for s in np.unique(slot).tolist():
                of = codes[slot == s]
                one = np.zeros((len(of), size), dtype=np.float32)
                one[np.arange(len(of))[:, None], of] = 1.0
                meet, sums = own.setdefault(s, [np.zeros((size, size)), np.zeros(size)])
                meet += one.T @ one  # whole numbers below 2^24 a batch
                sums += np.bincount(of.ravel(), np.repeat(target[slot == s], of.shape[1]), minlength=size)
        for s, (meet, sums) in own.items():
            parts = [np.concatenate([meet[a:b].ravel(), sums[a:b]]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["slot", "feature", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(p), np.float64) for p in table.column("part").to_pylist())
        return pa.table({"slot": table.column("slot")[:1], "feature": table.column("feature")[:1], "part": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "slot int, feature int, part binary"
    parts = rows.mapInArrow(sum_up, schema).groupBy("slot", "feature").applyInArrow(add, schema)
    found = {(r.slot, r.feature): np.frombuffer(zlib.decompress(r.part), np.float64) for r in parts.collect()}  # slots x bins x bins numbers at most
    for s in range(slots):
        meet, sums = np.zeros((size, size)), np.zeros(size)
        for j, (a, b) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
            if (s, j) in found:
                whole = found[s, j]
                meet[a:b], sums[a:b] = whole[: (b - a) * size].reshape(b - a, size), whole[(b - a) * size :]
        yield meet, sums


def fitted(rows: DataFrame, bins: Bins, dated: Column, target: str, cuts: Sequence[dt.date], rounds: int, rate: float, leaf: int) -> dict[dt.date, Model]:
    """A model for each of the ``cuts`` (a few dates), on the rows whose date is not after it."""
    cuts = sorted(cuts)
    slot = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda n, c: n + F.when(dated > c, 1).otherwise(0))
    features = [F.col(c).cast("double").alias(c) for c in bins.edges]
    own = rows.select(slot.alias("slot"), F.col(target).cast("double").alias("_target"), *features).where((F.col("slot") < len(cuts)) & F.col("_target").isNotNull())
    out, meet, sums = {}, 0.0, 0.0
    for cut, (more, further) in zip(cuts, summaries(own, bins, len(cuts)), strict=True):
        meet, sums = meet + more, sums + further
        out[cut] = boosted(meet, sums, bins.firsts, rounds, rate, leaf)
    return out


def predictions(rows: DataFrame, bins: Bins, cut: str, models: dict[dt.date, Model], out: str) -> DataFrame:
    """``rows`` with ``out``, the prediction of the model of the date in column ``cut``; null where that model has no rows to learn from."""
    shared = rows.sparkSession.sparkContext.broadcast({c: (m.base, m.adds) for c, m in models.items() if m.rows})  # a number for each bin and cut
    at = [rows.columns.index(c) for c in bins.edges]
    of = rows.columns.index(cut)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = bins.codes([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in at])
            made = np.full(batch.num_rows, np.nan)
            dates = np.array(batch.column(of).to_pylist(), dtype=object)
            for c in set(dates.tolist()) & shared.value.keys():
                base, adds = shared.value[c]
                made[dates == c] = base + adds[codes[dates == c]].sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64(), mask=np.isnan(made))], [*batch.schema.names, out])

    return rows.mapInArrow(score, f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes)}, `{out}` double")

