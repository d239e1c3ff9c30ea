"""Exception alerts: (severity, alert_type, item_id, region, week, message), one plan for each type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.scalars import percent, severity, signed_percent
from weekloom.functions.series import SERIES, by_series, median, whole_series
from weekloom.sources.schemas import RunConfig

# Fixed values.
STOCKOUT_COVER, STOCKOUT_BUFFER = 0.15, 1
CLIFF_ORDER, CLIFF_COVER = 0.05, 1.30
PROMO_WEEKS, PROMO_DEVIATION = 6, 0.35
CENSOR_WEEKS = 8
COLUMNS = ("severity", "alert_type", "item_id", "region", "week", "message")


def deviation(forecast: DataFrame, cfg: RunConfig) -> DataFrame:
    """Forecast against plan, summed over the weeks that have a plan."""
    planned = F.col("plan_units").isNotNull()
    sums = forecast.groupBy(*SERIES).agg(F.min("week").alias("week"), F.sum(F.when(planned, F.col("p50"))).alias("sensed"), F.sum("plan_units").alias("plan"))
    dev = (F.col("sensed") - F.col("plan")) / F.greatest(F.lit(1.0), F.col("plan"))
    hit = sums.withColumn("dev", dev).where(F.abs("dev") >= cfg.deviation_threshold)
    text = F.concat(F.lit("Sensed demand is "), signed_percent(F.col("dev")), F.lit(" against plan over the horizon, "), F.when(F.col("dev") > 0, "above").otherwise("below"), F.lit(f" the {cfg.deviation_threshold:.0%} threshold."))
    return hit.select(severity(F.abs("dev") / cfg.deviation_threshold).alias("severity"), F.lit("Sensed-vs-plan deviation").alias("alert_type"), *SERIES, "week", text.alias("message"))


def _numbered(projection: DataFrame) -> DataFrame:
    return projection.withColumn("_h", F.row_number().over(by_series()))


def _first(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*SERIES).orderBy("week"))).where("_k = 1")


def stockout(projection: DataFrame, cfg: RunConfig) -> DataFrame:
    """The first week, from the reaction lag on, with projected cover of 0.15 weeks or less."""
    lead = cfg.reaction_lag_weeks + STOCKOUT_BUFFER
    demand = F.greatest(F.lit(1.0), F.col("target_position") / float(cfg.target_wos or 4.0))
    near = _numbered(projection).where(F.col("_h").between(cfg.reaction_lag_weeks + 1, lead + 1)).withColumn("cover", F.col("projected_on_hand") / demand)
    text = F.concat(F.lit("Projected cover falls to "), F.format_string("%.1f", "cover"), F.lit(f" weeks by the {lead}-week lead time: stockout risk."))
    return _first(near.where(F.col("cover") <= STOCKOUT_COVER)).select(F.lit("high").alias("severity"), F.lit("Projected retailer stockout").alias("alert_type"), *SERIES, "week", text.alias("message"))


def order_cliff(projection: DataFrame) -> DataFrame:
    """Of the next two weeks, the first with orders near zero while stock is well above target."""
    low = F.col("projected_order") <= CLIFF_ORDER * F.col("target_position")
    high = F.col("projected_on_hand") >= CLIFF_COVER * F.col("target_position")
    hit = _first(_numbered(projection).where((F.col("_h") <= 2) & low & high))
    cover = F.when(F.col("target_position") > 0, F.try_divide("projected_on_hand", "target_position")).otherwise(0.0)
    text = F.concat(F.lit("Orders fall to about zero while cover is "), percent(cover), F.lit(" of target: overstocked channel."))
    return hit.select(F.lit("medium").alias("severity"), F.lit("Channel overstock / order-cliff").alias("alert_type"), *SERIES, "week", text.alias("message"))


def promo_variance(repaired: DataFrame) -> DataFrame:
    """The latest promotion's uplift ratio against the median of the ones before it; needs three promotion weeks, the last within six weeks of the end."""
    rows = repaired.withColumn("_end", F.max("week").over(whole_series())).where("promo_uplift > 0")
    rows = rows.withColumn("ratio", F.col("promo_uplift") / F.greatest(F.lit(1.0), F.col("base_units")))
    rows = rows.withColumn("_back", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("week"))))
    at_last = lambda c: F.max(F.when(F.col("_back") == 1, F.col(c))).alias(c)
    sums = rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), at_last("week"), at_last("_end"), at_last("ratio"), median(F.when(F.col("_back") > 1, F.col("ratio"))).alias("typical"))
    hit = sums.where((F.col("n") >= 3) & (F.col("week") >= F.date_sub("_end", 7 * PROMO_WEEKS)) & (F.col("typical") > 1e-6))
    hit = hit.withColumn("dev", (F.col("ratio") - F.col("typical")) / F.col("typical")).where(F.abs("dev") >= PROMO_DEVIATION)
    text = F.concat(F.lit("Promo uplift is "), signed_percent(F.col("dev")), F.lit(" against what is typical here ("), F.when(F.col("dev") > 0, "over").otherwise("under"), F.lit("-performing)."))
    return hit.select(severity(F.abs("dev") / PROMO_DEVIATION).alias("severity"), F.lit("Promo mid-flight variance").alias("alert_type"), *SERIES, "week", text.alias("message"))


def censoring(repaired: DataFrame) -> DataFrame:
    """Weeks de-censored within eight weeks of the series' end; three or more are severe."""
    rows = repaired.withColumn("_end", F.max("week").over(whole_series())).where(F.col("is_censored") & (F.col("week") >= F.date_sub("_end", 7 * CENSOR_WEEKS)))
    sums = rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.max("week").alias("week"))
    text = F.concat(F.col("n").cast("string"), F.lit(" recent week(s) de-censored before forecasting: verify availability."))
    return sums.select(F.when(F.col("n") >= 3, "high").otherwise("medium").alias("severity"), F.lit("Signal repair / censoring").alias("alert_type"), *SERIES, "week", text.alias("message"))


def all_alerts(forecast: DataFrame, projection: DataFrame | None, repaired: DataFrame | None, cfg: RunConfig) -> DataFrame:
    found = [deviation(forecast, cfg)]
    if projection is not None:
        found += [stockout(projection, cfg), order_cliff(projection)]
    if repaired is not None:
        known = repaired.where(F.col("week") <= F.lit(cfg.as_of)).join(forecast.select(*SERIES).limit(1).select(F.lit(1).alias("_any")), how="left_semi", on=F.lit(True))
        found += [promo_variance(known), censoring(known)]
    return reduce(DataFrame.unionByName, found).select(*COLUMNS)


def by_view(alerts: DataFrame, alert_type: str | None = None, severity_is: str | None = None) -> DataFrame:
    """Filtered by type and severity, the severe first."""
    if alert_type:
        alerts = alerts.where(F.col("alert_type") == alert_type)
    if severity_is:
        alerts = alerts.where(F.col("severity") == severity_is)
    return alerts.orderBy(F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("severity")), "alert_type", *SERIES)


def driving_signal(alert_type: str = "alert_type") -> F.Column:
    """Which chart explains an alert."""
    kind = F.lower(alert_type)
    return F.when(kind.contains("stockout") | kind.contains("overstock"), "inventory").when(kind.contains("deviation"), "forecast").otherwise("repaired")
