import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import backtest, ml, stumps
from weekloom.sources.schemas import RunConfig

START = dt.date(2023, 1, 2)


def at(n):
    return START + dt.timedelta(weeks=n)


CFG = RunConfig(as_of=at(89), backtest_weeks=12)


@pytest.fixture(scope="module")
def panel(spark):
    """Six series whose promoted weeks sell 60 % more, and what is promoted when."""
    rng = np.random.default_rng(4)
    rows, promo, stock = [], [], []
    for k in range(6):
        item, base = f"I{k}", 50.0 * (k + 1)
        for n in range(90):
            on = n % 9 in (3, 4)
            rows.append((item, "E", at(n), float(base * (1.6 if on else 1.0) * (1 + 0.05 * rng.normal()))))
            promo.append((item, "E", at(n), 1.0 if on else 0.0))
            stock.append((item, "E", at(n), float(base * (4 + rng.random()))))
    series = "item_id string, region string, week date, "
    return tuple(spark.createDataFrame(r, series + c).persist() for r, c in ((rows, "units_unconstrained double"), (promo, "promo_flag double"), (stock, "on_hand_units double")))


def plain_boosting(codes, y, sizes, rounds, rate, leaf):
    """Rows, residuals and a loop over every split."""
    pred, chosen = np.full(len(y), y.mean()), []
    for _ in range(rounds):
        rest, best = y - pred, None
        for j, size in enumerate(sizes):
            for b in range(size - 1):
                left = codes[:, j] <= b
                if left.sum() < leaf or (~left).sum() < leaf or not (codes[:, j] == b).any():
                    continue
                gain = rest[left].sum() ** 2 / left.sum() + rest[~left].sum() ** 2 / (~left).sum()
                if best is None or gain > best[0] * (1 + 1e-12):
                    best = (gain, j, b, left)
        if best is None:
            break
        _, j, b, left = best
        chosen.append((j, b))
        pred = pred + rate * np.where(left, rest[left].mean(), rest[~left].mean())
    return pred, chosen


def test_models_of_all_cuts_equal_boosting_on_their_rows(spark):
    rng = np.random.default_rng(1)
    bins = stumps.Bins({"a": np.linspace(-1, 1, 9), "b": np.array([0.5]), "c": np.array([1.0, 2.0, 2.5])})
    n = 600
    x = np.stack([rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 4, n)], axis=1).astype(float)
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1] * (x[:, 2] > 1) + 0.1 * rng.normal(size=n)
    day = rng.integers(0, 30, n)
    df = spark.createDataFrame([(at(0) + dt.timedelta(days=int(d)), float(t), *map(float, r)) for d, t, r in zip(day, y, x, strict=True)], "day date, y double, a double, b double, c double").repartition(5)
    cuts = [at(0) - dt.timedelta(days=1), at(0) + dt.timedelta(days=3), at(2), at(9)]
    models = stumps.fitted(df, bins, F.col("day"), "y", cuts, 15, 0.2, 5)
    assert models[cuts[0]].rows == 0
    local = bins.codes(list(x.T)) - bins.firsts[:-1]
    for cut in cuts[1:]:
        of = day <= (cut - at(0)).days
        want, chosen = plain_boosting(local[of], y[of], [10, 2, 4], 15, 0.2, 5)
        m = models[cut]
        assert m.rows == of.sum() and m.chosen == chosen
        assert np.allclose(m.base + m.adds[bins.codes(list(x[of].T))].sum(axis=1), want)
    told = stumps.predictions(df.withColumn("cut", F.lit(cuts[2])), bins, "cut", models, "p").toPandas()
    m = models[cuts[2]]
    assert np.allclose(told.p, m.base + m.adds[bins.codes([told.a, told.b, told.c])].sum(axis=1))
    assert stumps.predictions(df.withColumn("cut", F.lit(cuts[0])), bins, "cut", models, "p").where("p is not null").isEmpty()


def test_an_origin_sees_no_future_and_needs_no_others(spark, panel):
    sold, promo, stock = panel
    axis = backtest.week_axis(sold)
    both = axis.where(F.col("week").isin(at(60), at(80))).select(F.col("week").alias("as_of"), F.col("idx").alias("origin"))
    later = sold.withColumn("units_unconstrained", F.when(F.col("week") > at(60), F.col("units_unconstrained") * 99).otherwise(F.col("units_unconstrained")))
    restocked = stock.withColumn("on_hand_units", F.when(F.col("week") > at(60), 1.0).otherwise(F.col("on_hand_units")))
    for champion in (False, True):
        made = lambda p, s, o: sorted(map(str, ml.ml_forecaster(promo, s, champion)(p, o, 8, "units_unconstrained", axis).where(F.col("as_of") == at(60)).collect()))  # noqa: E731, B023
        whole = made(sold, stock, both)
        assert len(whole) == 6 * 8 and whole == made(later, restocked, both.where(F.col("as_of") == at(60)))


def test_the_model_gains_by_known_promotions_and_the_champion_never_loses_much(spark, panel):
    sold, promo, stock = panel
    scores = lambda f, lags: backtest.backtest(f, sold, CFG, method="m").where(F.col("lag").isin(*lags)).agg(backtest.wmape()).first()[0]
    alone, tier = ml.ml_forecaster(promo, stock, champion=False), ml.ml_forecaster(promo, stock, champion=True)
    own = scores(backtest.statistical, (1, 2))
    assert scores(alone, (1, 2, 4)) < scores(backtest.statistical, (1, 2, 4))
    assert scores(tier, (1, 2)) <= 1.02 * own


def test_too_little_history(spark, panel):
    sold, promo, stock = panel
    few = sold.where(F.col("week") < at(12))
    assert ml.champions(few, promo, stock, 8).isEmpty() and ml.champions(sold.limit(0), promo, stock, 8).isEmpty()
    cfg = RunConfig(as_of=at(11))
    assert ml.sellout_override(few, promo, stock, cfg)[0] is None
    axis = backtest.week_axis(few)
    origins = backtest.origin_weeks(axis, 3)
    assert ml.ml_forecaster(promo, stock, False)(few, origins, 4, "units_unconstrained", axis).isEmpty()  # nothing to learn from
    assert ml.ml_forecaster(None, None, True)(few, origins, 4, "units_unconstrained", axis).count() > 0
