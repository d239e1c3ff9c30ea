"""Rolling-origin backtest in one plan: origins and targets are rows of a joined week axis, not a loop of fits.

A forecaster is any function (panel, origins, horizon, value, axis) -> (item_id, region, as_of, week, pred). Three guards keep the future out: a forecaster
gets each origin's history, cut at the origin, and nothing else; forecasts dated on or before their origin raise LeakageError; and plans are taken as
they stood. The package's own forecasters share work between origins, so they take the whole panel and cut it themselves (``reads_panel``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.series import SERIES
from weekloom.operators.forecast import as_of_history, naive_forecast, plan_as_of, statistical_forecast
from weekloom.sources.schemas import RunConfig

# Fixed values.
LAGS = (1, 2, 4, 8)
METHODS = ("naive", "statistical", "translated", "plan")
LABELS = {"naive": "Seasonal naïve", "statistical": "Statistical baseline", "translated": "Translated sell-in", "plan": "Demand plan (lag-adj.)"}
TIDY = ("item_id", "region", "lag", "week", "as_of", "pred", "actual", "method")


class LeakageError(AssertionError):
    """A forecast or vintage saw, or is dated before, what it must not."""


def week_axis(data: DataFrame) -> DataFrame:
    """Every week that any series has, numbered from 0: one row a week."""
    return data.select("week").where("week is not null").distinct().withColumn("idx", F.row_number().over(Window.orderBy("week")) - 1)


def origin_weeks(axis: DataFrame, backtest_weeks: int, lags: Sequence[int] = LAGS, least: int = 8) -> DataFrame:
    """(as_of, origin): the origins of the last ``backtest_weeks`` that have ``least`` weeks behind them and the shortest lag ahead."""
    numbered = axis.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return numbered.where((F.col("idx") >= F.greatest(F.lit(least), F.col("n") - backtest_weeks - min(lags))) & (F.col("idx") < F.col("n") - min(lags))).select(F.col("week").alias("as_of"), F.col("idx").alias("origin"))


def on_axis(by_lag: DataFrame, axis: DataFrame, origins: DataFrame) -> DataFrame:
    """Dates forecasts given by lag: week is the origin's lag-th next week of the axis."""
    targets = origins.join(axis.withColumnRenamed("week", "target"), F.col("idx") > F.col("origin")).select("as_of", (F.col("idx") - F.col("origin")).cast("int").alias("lag"), "target")
    return by_lag.join(F.broadcast(targets), ["as_of", "lag"]).withColumnRenamed("target", "week")  # origins x weeks ahead of them


def reads_panel(forecaster: Callable) -> Callable:
    """Marks a forecaster that takes the whole panel and is known to look at no week after an origin."""
    forecaster.reads_panel = True
    return forecaster


def value_at(panel: DataFrame, asked: DataFrame, value: str = "units_unconstrained") -> DataFrame:
    """``asked(item_id, region, as_of, week)`` with the panel's value at that week, null where there is none; raises LeakageError for a week after its as_of."""
    late = asked.where("week > as_of").limit(1).collect()
    if late:
        raise LeakageError(f"{late[0].week} was asked for as of {late[0].as_of}")
    return asked.join(panel.select(*SERIES, "week", value), [*SERIES, "week"], "left").select(*SERIES, "as_of", "week", value)


@reads_panel
def naive(panel: DataFrame, origins: DataFrame, horizon: int, value: str, axis: DataFrame) -> DataFrame:
    return on_axis(naive_forecast(panel, origins, horizon, value), axis, origins).select(*SERIES, "as_of", "week", "pred")


@reads_panel
def statistical(panel: DataFrame, origins: DataFrame, horizon: int, value: str, axis: DataFrame) -> DataFrame:
    found = statistical_forecast(panel, origins, horizon, value).withColumnRenamed("p50", "pred")
    return on_axis(found, axis, origins).select(*SERIES, "as_of", "week", "pred")


def plan(vintages: DataFrame) -> Callable:
    """Forecaster that gives the plan as it stood at each origin."""

    @reads_panel
    def of(panel: DataFrame, origins: DataFrame, horizon: int, value: str, axis: DataFrame) -> DataFrame:
        return plan_as_of(vintages, origins).select(*SERIES, "as_of", "week", F.col("plan_units").alias("pred")).where("week > as_of")

    return of


def backtest(forecaster: Callable, data: DataFrame, cfg: RunConfig, *, value: str = "units_unconstrained", lags: Sequence[int] = LAGS, method: str = "model", least: int = 8, check: bool = True) -> DataFrame:
    """Tidy scores, columns TIDY: one row for each series, origin and lag with a forecast and an actual.

    A forecaster that isn't marked ``reads_panel`` gets (item_id, region, as_of, week, value) with the weeks up to each as_of.

    ``check`` runs a job that raises LeakageError if any forecast is dated on or before its origin. The package's own forecasters take their
    dates from the axis after each origin and go without it; such rows have no lag to be scored at."""
    panel = data.select(*SERIES, "week", F.col(value).cast("double").alias(value))
    axis = week_axis(panel)
    origins = origin_weeks(axis, cfg.backtest_weeks, lags, least)
    seen = panel if getattr(forecaster, "reads_panel", False) else as_of_history(panel, origins).select(*SERIES, "as_of", "week", value)
    found = forecaster(seen, origins, max(lags), value, axis)
    if check and not found.where("week <= as_of").isEmpty():
        raise LeakageError(f"{method}: a forecast is dated on or before its origin")
    numbered = found.join(F.broadcast(axis), "week").join(F.broadcast(origins), "as_of").withColumn("lag", (F.col("idx") - F.col("origin")).cast("int"))  # axis and origins: one row a week
    actual = panel.where(F.col(value).isNotNull()).select(*SERIES, "week", F.col(value).alias("actual"))
    scored = numbered.where(F.col("lag").isin(*lags) & F.col("pred").isNotNull() & ~F.isnan("pred")).join(actual, [*SERIES, "week"])
    return scored.withColumn("method", F.lit(method)).select(*TIDY)


def wmape() -> Column:
    """Sum of absolute errors over sum of absolute actuals; null where these are 0."""
    return F.try_divide(F.sum(F.abs(F.col("actual") - F.col("pred"))), F.sum(F.abs("actual"))).alias("wmape")


def bias() -> Column:
    """Positive for forecasts too high."""
    return F.try_divide(F.sum(F.col("pred") - F.col("actual")), F.sum(F.abs("actual"))).alias("bias")


def method_order(col: str = "method") -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col(col)), F.lit(99))


def fva_by_lag(tidy: DataFrame) -> DataFrame:
    return tidy.groupBy("lag", "method").agg(wmape(), bias())


def ordered_by_lag(by_lag: DataFrame) -> DataFrame:
    return by_lag.orderBy("lag", method_order())


def fva_waterfall(tidy: DataFrame) -> DataFrame:
    """(step, wmape, bias) pooled over lags 1 and 2, with display labels."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    short = tidy.where(F.col("lag").isin(1, 2) & F.col("method").isin(*METHODS)).groupBy("method").agg(wmape(), bias())
    return short.orderBy(method_order()).select(labels[F.col("method")].alias("step"), "wmape", "bias")


def exit_criteria(by_lag: DataFrame) -> DataFrame:
    """One row for each method but the plan: mean WMAPE over the lag rows 1 and 2 against the plan's, and whether it gains 15 % with bias within 5 %."""
    short = by_lag.where(F.col("lag").isin(1, 2)).groupBy("method").agg(F.avg("wmape").alias("wmape_12"), F.avg("bias").alias("bias_12"))
    base = short.where(F.col("method") == "plan").select(F.col("wmape_12").alias("plan_wmape_12"))
    gain = F.try_divide(F.col("plan_wmape_12") - F.col("wmape_12"), F.col("plan_wmape_12"))
    out = short.where(F.col("method") != "plan").join(F.broadcast(base), how="left", on=F.lit(True))  # one row
    return out.select("method", "wmape_12", "bias_12", "plan_wmape_12", gain.alias("gain"), F.coalesce((gain >= 0.15) & (F.abs("bias_12") <= 0.05), F.lit(False)).alias("met"))
