"""Statistical forecast: damped level with persistence, trend and a guarded seasonal factor, P10/P50/P90, and the plan blend.

Everything here is window and aggregate expressions. A forecast is made for each (item_id, region, as_of): rolling origins are more
as_of values, not more jobs. What looks back only (despiking, the exponential mean, its one-step residuals) is the same for every
origin and computed once a series. So is a row's ratio to its centred median: a season before the weeks forecast that median ends before the
origin, so an origin only picks. Only a horizon beyond half a season meets shorter frames, and takes their medians where it does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions.scalars import sensed_weight
from weekloom.functions.series import SERIES, array_median, by_series, median, with_despiked, with_ewm

# Fixed values.
PHI, LEVEL_SPAN, DESPIKE_WIDTH, DESPIKE_K, TREND_ROWS, TREND_DAMP = 0.75, 6, 9, 3.0, 10, 0.9
SEASON, SEASON_LEAST, SEASON_SHRINK = 52, 91, 0.5
AHEAD = (SEASON - 1) // 2
LOW, HIGH, Z90 = 0.10, 0.90, 1.2816

ORIGIN = (*SERIES, "as_of")


def as_of_history(history: DataFrame, origins: DataFrame) -> DataFrame:
    """Rows of ``history`` once for each origin (``as_of``) not before their week. ``origins`` are a few dates."""
    return history.join(F.broadcast(origins.select("as_of").distinct()), F.col("week") <= F.col("as_of"))  # one row an origin week


def trailing_state(history: DataFrame, value: str) -> DataFrame:
    """Adds to each row what a fit on the rows up to it has: despiked value, level, local trend, one-step residual, position."""
    df = history.where(F.col(value).isNotNull()).withColumn("y", F.col(value).cast("double"))
    df = with_despiked(df, "y", "capped", DESPIKE_WIDTH, DESPIKE_K)
    df = with_ewm(df, "capped", "level", LEVEL_SPAN)
    w = by_series()
    df = df.withColumn("at", F.row_number().over(w) - 1)
    tail = w.rowsBetween(-(TREND_ROWS - 1), 0)
    df = df.withColumn("trend", F.when(F.col("at") >= 3, F.regr_slope("capped", F.col("at").cast("double")).over(tail)).otherwise(0.0))
    return df.withColumn("resid", F.col("y") - F.lag("level").over(w))


def seasons(states: DataFrame) -> DataFrame:
    """(item_id, region, ratios, caps): each week's ratio to its centred median, and the capped values, as arrays by position."""
    usual = median(F.col("capped")).over(by_series().rowsBetween(-(SEASON // 2), AHEAD))
    ratio = F.when(usual > 0, F.col("capped") / F.when(usual > 0, usual)).otherwise(1.0)
    rows = states.select(*SERIES, "at", "capped", ratio.alias("ratio")).groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct("at", "ratio", "capped"))).alias("all"))  # the weeks of a series
    return rows.select(*SERIES, F.transform("all", lambda x: x["ratio"]).alias("ratios"), F.transform("all", lambda x: x["capped"]).alias("caps"))


def seasonal_factor(end: Column, lag: Column, horizon: int) -> Column:
    """The factor of the ``lag``-th week after position ``end``, from ``ratios`` and ``caps``; 1 with under SEASON_LEAST rows.

    It is the median of the ratios a whole number of seasons earlier. A centred frame that a history of that length fills to half or more has no gap to fill."""
    first = (end + lag) % SEASON

    def ratio_at(at: Column) -> Column:
        whole = F.get("ratios", at)
        if horizon <= SEASON - AHEAD - 1:
            return whole
        start = F.greatest(at - SEASON // 2, F.lit(0))
        level = array_median(F.slice("caps", start + 1, end - start + 1))
        return F.when(at + AHEAD <= end, whole).when(level > 0, F.get("caps", at) / F.when(level > 0, level)).otherwise(1.0)

    found = array_median(F.transform(F.sequence(first, F.greatest(first, end), F.lit(SEASON)), ratio_at))
    return F.when(end >= SEASON_LEAST - 1, SEASON_SHRINK * found + (1.0 - SEASON_SHRINK)).otherwise(1.0)


def point_path(horizon: int) -> Column:
    """The point forecasts of lags 1 to ``horizon`` as an array, from the state (y, level, trend, at) at the end of a history and the series' ``seasons``."""
    start = F.greatest(F.lit(0.0), F.col("y"))
    ahead = lambda h: F.greatest(F.lit(0.0), damped(F.col("y"), F.col("level"), F.col("trend"), h) * seasonal_factor(F.col("at"), h, horizon))
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.when(F.col("at") < 1, start).otherwise(ahead(h)))


def statistical_forecast(history: DataFrame, origins: DataFrame, horizon: int, value: str = "units_unconstrained", paths: DataFrame | None = None) -> DataFrame:
    """(item_id, region, as_of, last_week, lag, p10, p50, p90) for each series with history at an origin, lags 1 to ``horizon``.

    One observation is carried on as all three; with under five residuals the band is the normal one of the history's spread. Where
    ``paths(item_id, region, as_of, path)`` has points, they stand in place of the method's own, inside the same band."""
    states = trailing_state(history, value)
    rows = as_of_history(states.select(*SERIES, "week", "y", "level", "trend", "resid", "at"), origins)
    last = F.max(F.struct("week", "y", "level", "trend", "at")).alias("last")
    spread = F.percentile("resid", F.array(F.lit(LOW), F.lit(HIGH))).alias("q")
    state = rows.groupBy(*ORIGIN).agg(last, spread, F.count("resid").alias("residuals"), F.stddev_pop("y").alias("sd")).select(*ORIGIN, "last.*", "q", "residuals", "sd")
    n = F.col("at") + 1
    few = F.col("residuals") < 5
    low = F.least(F.lit(0.0), F.when(few, -Z90 * F.col("sd")).otherwise(F.col("q")[0]))
    high = F.greatest(F.lit(0.0), F.when(few, Z90 * F.col("sd")).otherwise(F.col("q")[1]))
    out = state.withColumn("q_low", F.when(n < 2, 0.0).otherwise(low)).withColumn("q_high", F.when(n < 2, 0.0).otherwise(high))
    out = out.join(seasons(states), [*SERIES]).withColumn("own", point_path(horizon))
    out = out.withColumn("path", F.col("own")) if paths is None else out.join(paths, [*ORIGIN], "left").withColumn("path", F.coalesce("path", "own"))
    out = out.select(*ORIGIN, "week", "q_low", "q_high", F.posexplode("path").alias("i", "p50"))
    lag = F.col("i") + 1
    grow = F.sqrt(lag.cast("double"))
    p10 = F.greatest(F.lit(0.0), F.least(F.col("p50"), F.col("p50") + F.col("q_low") * grow))
    return out.select(*ORIGIN, F.col("week").alias("last_week"), lag.alias("lag"), p10.alias("p10"), "p50", F.greatest(F.col("p50"), F.col("p50") + F.col("q_high") * grow).alias("p90"))


def point_paths(history: DataFrame, ends: DataFrame, horizon: int, value: str = "units_unconstrained") -> DataFrame:
    """(item_id, region, week, path): the point forecasts on the history up to each of ``ends(item_id, region, week)``, without bands.

    An end is one state, the last not after it, so no history is copied."""
    states = trailing_state(history, value)
    until = states.select(*SERIES, F.col("week").alias("_from"), F.lead("week").over(by_series()).alias("_next"), "y", "level", "trend", "at")
    found = ends.select(*SERIES, "week").join(until, [*SERIES]).where((F.col("_from") <= F.col("week")) & (F.col("_next").isNull() | (F.col("week") < F.col("_next"))))
    return found.join(seasons(states), [*SERIES]).select(*SERIES, "week", point_path(horizon).alias("path"))


def damped(last: Column, level: Column, trend: Column, lag: Column) -> Column:
    """phi^h of the last value, the rest of level plus damped trend."""
    hold = F.pow(F.lit(PHI), lag)
    steps = TREND_DAMP * (1.0 - F.pow(F.lit(TREND_DAMP), lag)) / (1.0 - TREND_DAMP)
    return hold * last + (1.0 - hold) * (level + trend * steps)


def naive_forecast(history: DataFrame, origins: DataFrame, horizon: int, value: str = "units_unconstrained") -> DataFrame:
    """(item_id, region, as_of, last_week, lag, pred): the last value of each series, not below 0."""
    rows = as_of_history(history.where(F.col(value).isNotNull()).select(*SERIES, "week", value), origins)
    last = rows.groupBy(*ORIGIN).agg(F.max("week").alias("last_week"), F.max_by(value, "week").alias("v"))
    return last.select(*ORIGIN, "last_week", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("lag"), F.greatest(F.lit(0.0), F.col("v")).alias("pred"))


def plan_as_of(plan: DataFrame, origins: DataFrame) -> DataFrame:
    """(item_id, region, week, as_of, plan_units, plan_version_date): the latest vintage not after each origin, never a later one."""
    known = plan.join(F.broadcast(origins.select("as_of").distinct()), F.col("plan_version_date") <= F.col("as_of"))  # one row an origin week
    return known.groupBy(*SERIES, "week", "as_of").agg(F.max(F.struct("plan_version_date", "plan_units")).alias("v")).select(*SERIES, "week", "as_of", "v.plan_units", "v.plan_version_date")


def blend(forecast: DataFrame, plan: DataFrame | None, horizon: int) -> DataFrame:
    """Adds week, plan_units, blend_weight_sensed and blended; where there is no plan the forecast stands."""
    df = forecast.withColumn("week", F.expr("date_add(last_week, 7 * lag)"))
    if plan is None:
        df = df.withColumn("plan_units", F.lit(None).cast("double"))
    else:
        df = df.join(plan_as_of(plan, forecast.select("as_of")).drop("plan_version_date"), [*SERIES, "as_of", "week"], "left")
    weight = sensed_weight(F.col("lag"), horizon)
    df = df.withColumn("blend_weight_sensed", weight)
    return df.withColumn("blended", F.col("blend_weight_sensed") * F.col("p50") + (1.0 - F.col("blend_weight_sensed")) * F.coalesce("plan_units", "p50"))
