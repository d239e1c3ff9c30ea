"""Optional global model tier: one boosted-stump model over all series, used where it beats the statistical tier on held-out weeks.

Features and training rows are window columns. Models are boosted stumps on summaries of the pooled rows (``stumps``): the rows stay distributed, and the models
of all origins of a backtest come from one pass over them. Targets are ratios to the series' level, which lets series of any volume share a model."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions.series import SERIES, by_series
from weekloom.operators import quantiles, stumps
from weekloom.operators.backtest import on_axis, reads_panel
from weekloom.operators.forecast import ORIGIN, point_paths
from weekloom.sources.schemas import RunConfig
from weekloom.sources.scratch import written

# Fixed values.
LEAST_HISTORY, LEVEL_ROWS, VALIDATION_WEEKS, CHAMPION_LAGS, MARGIN = 16, 13, 6, 4, 0.02
ROUNDS, RATE, LEAF = 60, 0.12, 8
QUANTILE_ROUNDS, QUANTILE_RATE = 40, 0.2
LOW, HIGH = 0.10, 0.90
LEVELS = {"p10": LOW, "p50": 0.50, "p90": HIGH}
FEATURES = ("r_last", "r_mean2", "r_mean4", "r_mean8", "r_std8", "r_slope4", "r_yoy", "zero_frac8", "woy_sin", "woy_cos", "h", "promo_t", "promo_tgt", "inv_ratio")

_RATIO, _SPREAD, _SLOPE, _WAVE = np.geomspace(0.2, 5.0, 31), np.geomspace(0.01, 2.0, 31), np.linspace(-0.5, 0.5, 31), np.linspace(-1.0, 1.0, 33)[1:-1]
#: What values of a feature count as the same: ratios by a ninth, shares and steps as they come.
BINS = stumps.Bins(dict.fromkeys(FEATURES, _RATIO) | {
    "r_std8": _SPREAD, "r_slope4": _SLOPE, "zero_frac8": (np.arange(8) + 0.5) / 8, "woy_sin": _WAVE, "woy_cos": _WAVE, "h": np.arange(1, 32) + 0.5, "promo_t": np.array([0.5]), "promo_tgt": np.array([0.5]),
})


def origin_features(history: DataFrame, promo: DataFrame | None = None, inventory: DataFrame | None = None, value: str = "units_unconstrained") -> DataFrame:
    """Each row's features as an origin, from the rows up to it: item_id, region, week, y, at (1-based), level and the r_* columns, promo_t, inv_ratio."""
    keys = [*SERIES, "week"]
    w = by_series()
    df = history.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("y"))
    df = df.join(promo.select(*keys, F.col("promo_flag").cast("double").alias("promo_t")), keys, "left") if promo is not None else df.withColumn("promo_t", F.lit(0.0))
    if inventory is not None:
        trail = F.avg("on_hand_units").over(w.rowsBetween(-7, 0))
        ratio = inventory.select(*keys, (F.col("on_hand_units").cast("double") / F.when(trail > 1e-9, trail).otherwise(1.0)).alias("inv_ratio"))
        df = df.join(ratio, keys, "left")
    else:
        df = df.withColumn("inv_ratio", F.lit(1.0))
    df = df.withColumn("promo_t", F.coalesce("promo_t", F.lit(0.0))).withColumn("inv_ratio", F.coalesce("inv_ratio", F.lit(1.0))).withColumn("at", F.row_number().over(w))
    tail = lambda k: w.rowsBetween(-(k - 1), 0)
    mean = F.avg("y").over(tail(LEVEL_ROWS))
    df = df.withColumn("level", F.when(mean > 1e-9, mean).otherwise(1.0))
    slope = F.when(F.col("at") >= 4, F.regr_slope("y", F.col("at").cast("double")).over(tail(4))).otherwise(0.0)
    return df.select(
        *keys, "y", "at", "level", "promo_t", "inv_ratio",
        (F.col("y") / F.col("level")).alias("r_last"),
        *[(F.avg("y").over(tail(k)) / F.col("level")).alias(f"r_mean{k}") for k in (2, 4, 8)],
        F.when(F.col("at") >= 2, F.stddev_pop("y").over(tail(8)) / F.col("level")).otherwise(0.0).alias("r_std8"),
        (slope / F.col("level")).alias("r_slope4"),
        # 51 rows back: the 52nd value from the end, the origin's own counted
        (F.coalesce(F.lag("y", 51).over(w), F.col("level")) / F.col("level")).alias("r_yoy"),
        F.avg((F.col("y") <= 1e-9).cast("double")).over(tail(8)).alias("zero_frac8"),
    )


def _with_target(df: DataFrame, promo: DataFrame | None) -> DataFrame:
    """Adds woy_sin, woy_cos and promo_tgt of the target week ``week_tgt``."""
    angle = 2.0 * math.pi * (F.weekofyear("week_tgt") % 52) / 52.0
    df = df.withColumn("woy_sin", F.sin(angle)).withColumn("woy_cos", F.cos(angle))
    if promo is None:
        return df.withColumn("promo_tgt", F.lit(0.0))
    flags = promo.select(*SERIES, F.col("week").alias("week_tgt"), F.col("promo_flag").cast("double").alias("promo_tgt"))
    return df.join(flags, [*SERIES, "week_tgt"], "left").withColumn("promo_tgt", F.coalesce("promo_tgt", F.lit(0.0)))


def training_rows(features: DataFrame, promo: DataFrame | None, horizon: int) -> DataFrame:
    """One row for each origin with LEAST_HISTORY rows and horizon step with an actual; ``ratio`` is the target."""
    w = by_series()
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), F.lead("week", h).over(w).alias("week_tgt"), F.lead("y", h).over(w).alias("y_tgt")) for h in range(1, horizon + 1)])
    rows = features.withColumn("_a", ahead).where(F.col("at") >= LEAST_HISTORY).select("*", F.explode("_a").alias("_t")).where("_t.y_tgt is not null")
    rows = rows.select("*", F.col("_t.h").cast("double").alias("h"), "_t.week_tgt", (F.col("_t.y_tgt") / F.col("level")).alias("ratio")).drop("_a", "_t")
    return _with_target(rows, promo)


def rows_ahead(features: DataFrame, promo: DataFrame | None, dates: Sequence[dt.date], horizon: int) -> DataFrame:
    """For each of ``dates`` (as_of) and each series the features of its last week not after it, with each of the ``horizon`` weeks that follow."""
    spark = features.sparkSession
    asked = F.broadcast(spark.createDataFrame([(d,) for d in dates], "as_of date"))  # one row an origin week
    ends = features.withColumn("_next", F.lead("week").over(by_series())).join(asked, (F.col("week") <= F.col("as_of")) & (F.col("_next").isNull() | (F.col("as_of") < F.col("_next")))).drop("_next")
    rows = ends.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("week_tgt", F.expr("date_add(week, 7 * h)")).withColumn("h", F.col("h").cast("double"))
    return _with_target(rows, promo)


def models_at(rows: DataFrame, cuts: Sequence[dt.date]) -> dict[dt.date, stumps.Model]:
    """The model of each cut, on the ``training_rows`` whose target week is not after it."""
    return stumps.fitted(rows, BINS, F.col("week_tgt"), "ratio", cuts, ROUNDS, RATE, LEAF)


def quantile_rounds(rows: DataFrame) -> dict[str, stumps.Model]:
    """A model for each of LEVELS on the ``training_rows``; every round is a pass over them."""
    return dict(zip(LEVELS, quantiles.fitted(rows, BINS, "ratio", [*LEVELS.values()], QUANTILE_ROUNDS, QUANTILE_RATE, LEAF), strict=True))


def quantile_points(ahead: DataFrame, models: dict[str, stumps.Model], dates: Sequence[dt.date]) -> DataFrame:
    """(item_id, region, as_of, week, lag, p10, p50, p90) in units for ``rows_ahead``, not below 0 and in order; nulls where there was nothing to learn from."""
    for name, m in models.items():
        ahead = stumps.predictions(ahead, BINS, "as_of", dict.fromkeys(dates, m), name)
    told = F.sort_array(F.array(*[F.greatest(F.lit(0.0), F.col(c) * F.col("level")) for c in LEVELS]))
    points = F.when(F.col("p50").isNotNull(), told)
    return ahead.withColumn("_p", points).select(*ORIGIN, F.col("week_tgt").alias("week"), F.col("h").cast("int").alias("lag"), *[F.col("_p")[i].alias(c) for i, c in enumerate(LEVELS)])


def quantile_forecast(history: DataFrame, promo: DataFrame | None, inventory: DataFrame | None, as_of: dt.date, horizon: int, value: str = "units_unconstrained") -> DataFrame:
    """``quantile_points`` of every series for the weeks after its last one not after ``as_of``, learnt from the weeks up to ``as_of`` alone."""
    known = history.where(F.col("week") <= F.lit(as_of))
    features = written(origin_features(known, promo, inventory, value), "ml-features")
    models = quantile_rounds(training_rows(features, promo, horizon))
    return quantile_points(rows_ahead(features, promo, [as_of], horizon), models, [as_of])


def coverage(forecast: DataFrame, history: DataFrame, value: str = "units_unconstrained") -> DataFrame:
    """One row a lag: how many actuals the forecast met, the shares not above each quantile, and the pinball loss over all levels a unit sold."""
    actual = history.where(F.col(value).isNotNull()).select(*SERIES, "week", F.col(value).cast("double").alias("actual"))
    met = forecast.where("p50 is not null").join(actual, [*SERIES, "week"])
    miss = lambda c, q: F.greatest(q * (F.col("actual") - F.col(c)), (q - 1.0) * (F.col("actual") - F.col(c)))
    under = [F.avg((F.col("actual") <= F.col(c)).cast("double")).alias(f"under_{c}") for c in LEVELS]
    loss = sum(miss(c, q) for c, q in LEVELS.items())
    return met.groupBy("lag").agg(F.count(F.lit(1)).alias("weeks"), *under, F.try_divide(F.sum(loss), F.sum(F.abs("actual"))).alias("pinball"))


class Tier:
    """The model beside the statistical tier at several origins of one panel.

    ``weeks`` is every week of the axis, ``origins`` some of them. An origin's inner cut is VALIDATION_WEEKS weeks of the axis before it; it has one only if
    LEAST_HISTORY weeks and one more stand before that."""

    def __init__(self, panel: DataFrame, promo: DataFrame | None, inventory: DataFrame | None, weeks: Sequence[dt.date], origins: Sequence[dt.date], horizon: int, value: str):
        self.panel, self.promo, self.value, self.horizon, self.weeks = panel, promo, value, horizon, sorted(weeks)
        place = {w: i for i, w in enumerate(self.weeks)}
        self.cuts = {o: self.weeks[place[o] - VALIDATION_WEEKS] for o in origins if place[o] + 1 >= LEAST_HISTORY + VALIDATION_WEEKS + 1}
        self.held = {c: self.weeks[place[c] + 1 :][:CHAMPION_LAGS] for c in self.cuts.values()}
        self.dates = sorted({*origins, *self.held})
        self.features = written(origin_features(panel, promo, inventory, value), "ml-features")
        self.rows = training_rows(self.features, promo, horizon)
        self.models = models_at(self.rows, self.dates)

    def scored(self) -> DataFrame:
        """(item_id, region, as_of, lag, week, level, ratio, ml, stat): both tiers' points for the weeks after every date, ml null where there was nothing to learn from."""
        ahead = stumps.predictions(rows_ahead(self.features, self.promo, self.dates, self.horizon), BINS, "as_of", self.models, "ratio")
        ml = ahead.select(*ORIGIN, F.col("h").cast("int").alias("lag"), F.col("week_tgt").alias("week"), "level", "ratio", F.when(F.col("ratio").isNotNull(), F.greatest(F.lit(0.0), F.col("ratio") * F.col("level"))).alias("ml"))
        ends = ahead.select(*SERIES, F.col("as_of").alias("week")).distinct()
        paths = point_paths(self.panel, ends, self.horizon, self.value).select(*SERIES, F.col("week").alias("as_of"), F.posexplode("path").alias("i", "stat"))
        return ml.join(paths.select(*ORIGIN, (F.col("i") + 1).alias("lag"), "stat"), [*ORIGIN, "lag"])

    def won(self, scored: DataFrame) -> DataFrame:
        """(item_id, region, as_of): the series that the model leads at each origin: fitted up to the inner cut, it beat the statistical tier on the first
        weeks held out by over MARGIN. Series of no held-out actuals, or all zero, stay with the statistical tier."""
        spark = self.panel.sparkSession
        axis = spark.createDataFrame([(c, i + 1, w) for c, held in self.held.items() for i, w in enumerate(held)], "as_of date, lag int, held date")
        actual = self.panel.where(F.col(self.value).isNotNull()).select(*SERIES, F.col("week").alias("held"), F.col(self.value).alias("actual"))
        both = scored.join(F.broadcast(axis), ["as_of", "lag"]).where("ml is not null").join(actual, [*SERIES, "held"])  # four rows a cut
        error = lambda c: F.try_divide(F.sum(F.abs(F.col("actual") - F.col(c))), F.sum(F.abs("actual")))
        wins = both.groupBy(*ORIGIN).agg(error("ml").alias("ml"), error("stat").alias("stat")).where(F.col("ml") < F.col("stat") * (1.0 - MARGIN)).select(*SERIES, F.col("as_of").alias("cut"))
        cuts = spark.createDataFrame([*self.cuts.items()], "as_of date, cut date")
        return wins.join(F.broadcast(cuts), "cut").select(*ORIGIN)  # one row an origin


def _weeks(df: DataFrame) -> list[dt.date]:
    return [r.week for r in df.select("week").where("week is not null").distinct().orderBy("week").collect()]  # one row a week


def champions(history: DataFrame, promo: DataFrame | None, inventory: DataFrame | None, horizon: int, value: str = "units_unconstrained") -> DataFrame:
    """(item_id, region) of the series that the model leads at the last week of ``history``."""
    weeks = _weeks(history)
    tier = Tier(history, promo, inventory, weeks, weeks[-1:], horizon, value) if weeks else None
    if tier is None or not tier.cuts:
        return history.select(*SERIES).limit(0)
    return tier.won(tier.scored()).select(*SERIES)


def sellout_override(history: DataFrame, promo: DataFrame | None, inventory: DataFrame | None, cfg: RunConfig) -> tuple[DataFrame | None, DataFrame]:
    """(p10, p50, p90 by lag of the champion series, or None when there are none; the champion series).

    The band is that of the residuals, from their 10 % and 90 % quantiles, not above and not below 0, and widens with the root of the lag. With
    ``cfg.ml_quantiles`` the three come from quantile models instead, on the same rows."""
    known = history.where(F.col("week") <= F.lit(cfg.as_of))
    weeks = _weeks(known)
    tier = Tier(known, promo, inventory, weeks, weeks[-1:], cfg.horizon_weeks, "units_unconstrained") if weeks else None
    if tier is None or not tier.cuts:
        return None, history.select(*SERIES).limit(0)
    scored = written(tier.scored(), "ml-scored")
    won = written(tier.won(scored).select(*SERIES), "ml-champions")
    if won.isEmpty():
        return None, won
    last = F.lit(weeks[-1])
    if cfg.ml_quantiles:
        ahead = rows_ahead(tier.features, promo, weeks[-1:], cfg.horizon_weeks).join(won, [*SERIES], "left_semi")
        return quantile_points(ahead, quantile_rounds(tier.rows), weeks[-1:]).drop("as_of"), won
    own = stumps.predictions(tier.rows.select(*FEATURES, F.col("ratio").alias("target"), last.alias("as_of")), BINS, "as_of", tier.models, "ratio")
    low, high = own.select(F.percentile(F.col("target") - F.col("ratio"), F.array(F.lit(LOW), F.lit(HIGH)))).first()[0]
    ahead = scored.where(F.col("as_of") == last).join(won, [*SERIES], "left_semi")
    grow = F.sqrt(F.col("lag").cast("double"))
    units = lambda c: F.greatest(F.lit(0.0), c * F.col("level"))
    return ahead.select(*SERIES, "week", "lag", units(F.col("ratio") + min(low, 0.0) * grow).alias("p10"), F.col("ml").alias("p50"), units(F.col("ratio") + max(high, 0.0) * grow).alias("p90")), won


def overridden(forecast: DataFrame, override: DataFrame | None) -> DataFrame:
    """The statistical forecast with the champions' quantiles in place of its own."""
    if override is None:
        return forecast
    new = override.select(*SERIES, "lag", *[F.col(c).alias(f"_{c}") for c in ("p10", "p50", "p90")])
    out = forecast.join(new, [*SERIES, "lag"], "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in ("p10", "p50", "p90") else F.col(c) for c in forecast.columns])


def ml_forecaster(promo: DataFrame | None, inventory: DataFrame | None, champion: bool):
    """Backtest forecaster: the model alone, or with ``champion`` where it wins and the statistical tier elsewhere. The models of all origins, and of
    the inner cuts at which they are judged, come from one pass over the training rows."""

    @reads_panel
    def of(panel: DataFrame, origins: DataFrame, horizon: int, value: str, axis: DataFrame) -> DataFrame:
        dates = [r.as_of for r in origins.select("as_of").orderBy("as_of").collect()]  # one row an origin
        tier = Tier(panel, promo, inventory, _weeks(axis), dates, horizon, value)
        scored = written(tier.scored(), "ml-scored")
        own = scored.join(F.broadcast(origins.select("as_of")), "as_of")
        if champion and tier.cuts:
            own = own.join(tier.won(scored).withColumn("_won", F.lit(True)), [*ORIGIN], "left").withColumn("pred", F.when(F.col("_won"), F.col("ml")).otherwise(F.col("stat")))
        else:
            own = own.withColumn("pred", F.col("stat" if champion else "ml"))
        return on_axis(own.where("pred is not null").select(*ORIGIN, "lag", "pred"), axis, origins).select(*SERIES, "as_of", "week", "pred")

    return of


def champion_share(won: DataFrame, history: DataFrame) -> DataFrame:
    """One row: how many series there are, and how many the model leads."""
    return history.select(*SERIES).distinct().join(won.withColumn("_w", F.lit(1)), [*SERIES], "left").agg(F.count(F.lit(1)).alias("series"), F.count("_w").alias("champions"))
