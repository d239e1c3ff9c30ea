import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekloom.functions import scalars, series

START = dt.date(2025, 1, 6)


def weekly(spark, values, name="y", item="A"):
    rows = [(item, "East", START + dt.timedelta(weeks=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"item_id string, region string, week date, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("week").collect()]


@pytest.fixture(scope="module")
def noisy():
    return np.random.default_rng(1).gamma(4, 30, 70)


def test_rolling_medians(spark, noisy):
    df = weekly(spark, noisy)
    got = column(df.withColumn("m", series.rolling_median("y", 8, 0)), "m")
    assert np.allclose(got, pd.Series(noisy).rolling(9, min_periods=1).median())
    got = column(df.withColumn("m", series.centered_median("y", 52, 26)), "m")
    want = pd.Series(noisy).rolling(52, center=True, min_periods=26).median()
    assert np.allclose([np.nan if g is None else g for g in got], want, equal_nan=True)


def test_despike_ewm_interpolate(spark, noisy):
    s = pd.Series(noisy)
    mid = s.rolling(9, min_periods=1).median()
    cap = np.minimum(s, mid + 3 * ((s - mid).abs().rolling(9, min_periods=1).median() * 1.4826 + 1e-9))
    assert np.allclose(column(series.with_despiked(weekly(spark, noisy), "y", "c", 9, 3.0), "c"), cap)
    assert np.allclose(column(series.with_ewm(weekly(spark, noisy), "y", "e", 6), "e"), s.ewm(span=6).mean())
    holes = [None, 1, None, 3, None, None, 6, None]
    assert column(series.with_interpolated(weekly(spark, holes), "y", "f"), "f") == [1, 1, 2, 3, 4, 5, 6, 6]
    assert column(series.with_interpolated(weekly(spark, [None, None]), "y", "f"), "f") == [None, None]


def test_islands(spark):
    df = weekly(spark, [1, 1, 0, 1, 1, 1, 0, 1]).withColumn("f", F.col("y") > 0)
    assert [(r.run_weeks, r.start_week) for r in series.islands(df, "f", 3).collect()] == [(3, START + dt.timedelta(weeks=3))]


def test_scalars(spark):
    rows = [("WM Week 2503", "1,200"), ("wk 2500", " 7 "), ("2025-01-15", "x"), ("01/20/2025", None), ("W250", "1e2"), ("", "-3")]
    df = spark.createDataFrame(rows, "w string, n string").select(scalars.week(F.col("w")).alias("w"), scalars.number(F.col("n")).alias("n"))
    got = df.collect()
    assert [r.w for r in got] == [dt.date(2025, 1, 13), dt.date(2024, 12, 30), dt.date(2025, 1, 13), dt.date(2025, 1, 20), None, None]
    assert [r.n for r in got] == [1200.0, 7.0, None, None, 100.0, -3.0]
    weights = [r.w for r in spark.range(1, 13).select(scalars.sensed_weight(F.col("id"), 8).alias("w")).collect()]
    assert weights[:2] == [0.9, 0.9] and weights == sorted(weights, reverse=True) and abs(weights[7] - 0.2) < 1e-9 and min(weights) == 0.15
    late = scalars.WeekCalendar(fiscal_year_start_month=2)
    assert late.week1_monday(2025) == dt.date(2025, 1, 27) and scalars.WeekCalendar.from_dict(late.to_dict() | {"more": 1}) == late
