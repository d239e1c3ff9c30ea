import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import ml, quantiles, stumps
from weekloom.sources.schemas import RunConfig

START = dt.date(2023, 1, 2)
LEVELS = (0.1, 0.5, 0.9)
BINS = stumps.Bins({"a": np.linspace(-1, 1, 9), "b": np.array([0.5]), "c": np.array([1.0, 2.0, 2.5])})


def at(n):
    return START + dt.timedelta(weeks=n)


def drawn(seed, n):
    """The level follows a, the spread is five times as wide where b is 1, c says nothing."""
    rng = np.random.default_rng(seed)
    x = np.stack([rng.uniform(-2, 2, n), rng.integers(0, 2, n), rng.integers(0, 4, n)], axis=1).astype(float)
    return x, 2 + np.sin(x[:, 0]) + (0.1 + 0.4 * x[:, 1]) * rng.normal(size=n)


def frame(spark, x, y):
    return spark.createDataFrame([(float(t), *map(float, r)) for t, r in zip(y, x, strict=True)], "y double, a double, b double, c double").repartition(5)


def plain(codes, y, level, base, sizes, rounds, rate, leaf):
    """Rows, residuals and a loop over every split; leaves are exact quantiles of the rows."""
    pred, chosen = np.full(len(y), base), []
    for _ in range(rounds):
        rest, best = y - pred, None
        pull = np.where(rest > 0, level, level - 1)
        for j, size in enumerate(sizes):
            for b in range(size - 1):
                left = codes[:, j] <= b
                if left.sum() < leaf or (~left).sum() < leaf or not (codes[:, j] == b).any():
                    continue
                gain = pull[left].sum() ** 2 / left.sum() + pull[~left].sum() ** 2 / (~left).sum()
                if best is None or gain > best[0] * (1 + 1e-12):
                    best = (gain, j, b, left)
        _, j, b, left = best
        chosen.append((j, b))
        pred = pred + rate * np.where(left, np.quantile(rest[left], level), np.quantile(rest[~left], level))
    return pred, chosen


def test_the_first_rounds_equal_boosting_on_the_rows(spark):
    x, y = drawn(1, 1500)
    codes = BINS.codes(list(x.T))
    for model, level in zip(quantiles.fitted(frame(spark, x, y), BINS, "y", LEVELS, 3, 0.3, 20), LEVELS, strict=True):
        base = np.quantile(y, level, method="inverted_cdf")
        pred, chosen = plain(codes - BINS.firsts[:-1], y, level, base, [10, 2, 4], 3, 0.3, 20)
        assert model.rows == 1500 and model.base == pytest.approx(base) and model.chosen == chosen
        assert np.abs(model.base + model.adds[codes].sum(axis=1) - pred).max() < 0.06  # a cell's width a round, times the rate


def test_leaf_quantiles_are_exact_to_a_cell():
    rng = np.random.default_rng(3)
    for r in (rng.normal(size=4000), rng.exponential(size=999) - 0.3, np.zeros(7), np.array([1.5]), rng.normal(size=50) * 100):
        cells = np.bincount(np.searchsorted(quantiles.EDGES, r, side="left"), minlength=quantiles.CELLS)
        for level in LEVELS:
            want = np.clip(np.quantile(r, level, method="inverted_cdf"), quantiles.EDGES[0], quantiles.EDGES[-1])
            got = quantiles.quantile_of(cells, level)
            cell = np.searchsorted(quantiles.EDGES, want, side="left")
            assert quantiles.EDGES[max(cell - 1, 0)] - 1e-12 <= got <= quantiles.EDGES[min(cell, len(quantiles.EDGES) - 1)] + 1e-12


def test_held_out_coverage_where_the_spread_is_wide_and_where_it_is_narrow(spark):
    models = quantiles.fitted(frame(spark, *drawn(5, 4000)), BINS, "y", LEVELS, 40, 0.2, 20)
    x, y = drawn(6, 4000)
    codes = BINS.codes(list(x.T))
    under = np.stack([y <= m.base + m.adds[codes].sum(axis=1) for m in models])
    assert np.abs(under.mean(axis=1) - LEVELS).max() < 0.03
    for wide in (0, 1):
        assert np.abs(under[:, x[:, 1] == wide].mean(axis=1) - LEVELS).max() < 0.05


def test_no_rows_null_targets_and_one_bin(spark):
    none = frame(spark, *drawn(1, 3)).where("y is null")
    assert [m.rows for m in quantiles.fitted(none, BINS, "y", LEVELS, 3, 0.3, 20)] == [0, 0, 0]
    few = frame(spark, *drawn(1, 3)).unionByName(spark.createDataFrame([(None, 0.0, 0.0, 0.0)], "y double, a double, b double, c double"))
    assert all(m.rows == 3 and not m.chosen and not m.adds.any() for m in quantiles.fitted(few, BINS, "y", LEVELS, 3, 0.3, 20))


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows, promo = np.random.default_rng(4), [], []
    for k in range(8):
        for n in range(90):
            on = n % 9 in (3, 4)
            rows.append((f"I{k}", "E", at(n), float(40.0 * (k + 1) * (1.6 if on else 1.0) * rng.lognormal(0, 0.25))))
            promo.append((f"I{k}", "E", at(n), 1.0 if on else 0.0))
    series = "item_id string, region string, week date, "
    return spark.createDataFrame(rows, series + "units_unconstrained double").persist(), spark.createDataFrame(promo, series + "promo_flag double").persist()


def test_a_forecast_sees_no_future_covers_what_was_held_out_and_feeds_the_run(spark, panel):
    sold, promo = panel
    made = ml.quantile_forecast(sold, promo, None, at(81), 8)
    rows = sorted(map(str, made.collect()))
    later = sold.withColumn("units_unconstrained", F.when(F.col("week") > at(81), F.col("units_unconstrained") * 99).otherwise(F.col("units_unconstrained")))
    assert len(rows) == 8 * 8 and rows == sorted(map(str, ml.quantile_forecast(later, promo, None, at(81), 8).collect()))
    assert made.where("not (0 <= p10 and p10 <= p50 and p50 <= p90)").isEmpty()
    met = ml.coverage(made, sold).agg(F.sum("weeks").alias("n"), *[F.avg(f"under_{c}").alias(c) for c in ml.LEVELS]).first()
    assert met.n == 64 and abs(met.p10 - 0.1) < 0.1 and abs(met.p50 - 0.5) < 0.15 and abs(met.p90 - 0.9) < 0.1  # 64 weeks: two standard errors and more
    assert ml.quantile_forecast(sold.where(F.col("week") < at(9)), promo, None, at(81), 8).where("p50 is not null").isEmpty()
    override, won = ml.sellout_override(sold, promo, None, RunConfig(as_of=at(89), ml_enabled=True, ml_quantiles=True))
    assert override is not None and not won.isEmpty()
    assert override.columns == ["item_id", "region", "week", "lag", "p10", "p50", "p90"] and override.count() == 8 * won.count()
