import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import backtest, smoothing
from weekloom.operators.forecast import statistical_forecast
from weekloom.plans import pipeline
from weekloom.sources.schemas import RunConfig

START = dt.date(2020, 1, 6)
SCHEMA = "item_id string, region string, week date, units_unconstrained double"


def at(n):
    return START + dt.timedelta(weeks=n)


def drawn(k, n):
    """Flat, rising, damped, seasonal and constant series of many lengths."""
    rng, t = np.random.default_rng(k), np.arange(n)
    base = 50.0 + 10 * k + (0.8 * t if k % 5 == 1 else 30 * (1 - 0.9**t) if k % 5 == 2 else 0.0)
    season = 80.0 * (t % 52 % 7 == 3) if k % 5 == 3 else 0.0
    noise = 0.0 if k % 5 == 4 else rng.normal(size=n) * 4
    return base + season + noise + np.zeros(n)


def best_by_loop(y, horizon):
    """Every candidate week by week."""
    best = None
    for i, c in enumerate(smoothing.CANDIDATES):
        if len(y) < (104 if c.seasonal else 10):
            continue
        slope, at_start = np.polyfit(np.arange(10), y[:10], 1)
        level, trend, s = (y[:10].mean(), 0.0, [0.0] * 52) if c.trend == "none" else (at_start - slope, slope, [0.0] * 52)
        if c.seasonal:
            level, trend = y[:52].mean(), 0.0 if c.trend == "none" else (y[52:104].mean() - y[:52].mean()) / 52
            s = list(y[:52] - level)
        sse = 0.0
        for t, v in enumerate(y):
            e = v - (level + c.phi * trend + s[t % 52])
            level, trend, s[t % 52], sse = level + c.phi * trend + c.alpha * e, c.phi * trend + c.beta * e, s[t % 52] + c.gamma * e, sse + e * e
        n, k = len(y), c.terms
        aicc = n * np.log(max(sse / n, 1e-12)) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        if best is None or aicc < best[0] - 1e-9:
            best = (aicc, i, [max(0.0, level + trend * sum(c.phi**j for j in range(1, h + 1)) + s[(len(y) + h - 1) % 52]) for h in range(1, horizon + 1)])
    return best


@pytest.fixture(scope="module")
def lengths():
    return {k: n for k, n in enumerate([9, 10, 11, 14, 20, 30, 52, 60, 80, 95, 103, 104, 105, 110, 120, 130, 140, 150, 156, 160, 12, 109, 115, 126, 118, 131, 142, 133, 300, 60])}


@pytest.fixture(scope="module")
def panel(spark, lengths):
    rows = [(f"I{k}", "E", at(t), float(v)) for k, n in lengths.items() for t, v in enumerate(drawn(k, n))]
    return spark.createDataFrame([*rows, ("I3", "E", at(500), None)], SCHEMA).persist()


def fits(spark, panel, *origins, horizon=60):
    return smoothing.smoothing_fits(panel, spark.createDataFrame([(o,) for o in origins], "as_of date"), horizon)


def test_fits_equal_a_loop_over_candidates_and_weeks(spark, panel, lengths):
    found = fits(spark, panel, at(600))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {int(r.item_id[1:]): r for r in found.collect()}
    assert set(got) == {k for k, n in lengths.items() if n >= 10}
    for k, r in got.items():
        aicc, i, path = best_by_loop(drawn(k, lengths[k]), 60)
        c = smoothing.CANDIDATES[i]
        assert (r.trend, r.seasonal, r.alpha, r.beta, r.phi, r.gamma) == (c.trend, c.seasonal, c.alpha, c.beta, c.phi, c.gamma), k
        assert r.n_weeks == lengths[k] and np.isclose(r.aicc, aicc) and np.allclose(r.path, path)
    assert any(r.seasonal for r in got.values()) and {r.trend for r in got.values()} == {"none", "additive", "damped"}


def test_an_origin_sees_its_own_weeks_only(spark, panel):
    both = sorted(map(str, fits(spark, panel, at(70), at(119), at(2)).where(F.col("as_of") == at(70)).collect()))
    cut = sorted(map(str, fits(spark, panel.where(F.col("week") <= at(70)), at(70)).collect()))
    changed = panel.withColumn("units_unconstrained", F.when(F.col("week") > at(70), 1e6).otherwise(F.col("units_unconstrained")))
    assert both == cut == sorted(map(str, fits(spark, changed, at(70), at(90)).where(F.col("as_of") == at(70)).collect())) and both


def test_short_histories_keep_the_statistical_path_and_bands_hold_the_points(spark, panel):
    origin = spark.createDataFrame([(at(600),)], "as_of date")
    own = {(r.item_id, r.lag): r for r in statistical_forecast(panel, origin, 8).collect()}
    made = {(r.item_id, r.lag): r for r in smoothing.smoothing_forecast(panel, origin, 8).collect()}
    assert set(own) == set(made) and all(made["I0", h] == own["I0", h] for h in range(1, 9))
    paths = {r.item_id: r.path for r in fits(spark, panel, at(600), horizon=8).collect()}
    assert all(r.p50 == paths[i][h - 1] for (i, h), r in made.items() if i in paths)
    assert all(0 <= r.p10 <= r.p50 <= r.p90 for r in made.values())
    assert smoothing.smoothing_forecast(panel.limit(0), origin, 8).isEmpty() and fits(spark, panel.limit(0), at(9)).isEmpty()


def test_season_and_trend_gain_over_the_damped_level(spark):
    rows = [(f"I{k}", "E", at(t), float(v)) for k in (1, 3, 6, 8) for t, v in enumerate(drawn(k, 150))]
    sold, cfg = spark.createDataFrame(rows, SCHEMA).persist(), RunConfig(as_of=at(149), backtest_weeks=12)
    score = lambda f: backtest.backtest(f, sold, cfg).agg(backtest.wmape()).first()[0]
    assert score(smoothing.smoothing) < score(backtest.statistical)


def test_the_run_takes_it_when_asked(spark, panel):
    cfg = RunConfig(as_of=at(159), smoothing_enabled=True)
    assert RunConfig.from_dict(cfg.to_dict()) == cfg
    ahead = {(r.item_id, r.lag): r.p50 for r in pipeline.blended_forecast(panel, None, cfg).collect()}
    want = {r.item_id: r.path for r in fits(spark, panel, at(159), horizon=8).collect()}
    assert all(ahead[i, h] == p[h - 1] for i, p in want.items() for h in range(1, 9))
    assert not pipeline.tidy_scores(panel, None, None, None, None, cfg).where("method = 'statistical'").isEmpty()
