"""Optional exponential-smoothing tier: additive-error models with a level, maybe a (damped) trend and maybe a yearly season, chosen by AICc.

Smoothing parameters come from a fixed grid. A series is one array, a candidate one fold over it in columns, and a fold's state after n weeks is what a fit on
these n weeks gives: the first values depend on the first LEAST rows only (seasonal ones on the first two seasons). So one fold of a candidate serves every
origin, and each origin takes the candidate that its own weeks prefer. No history is copied and nothing is shuffled but the series themselves."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions.series import SERIES, held
from weekloom.operators.backtest import on_axis, reads_panel
from weekloom.operators.forecast import ORIGIN, SEASON, statistical_forecast

LEAST = 10
LEAST_SEASONAL = 2 * SEASON
#: Keeps the logarithm of a fit without errors finite.
LEAST_VARIANCE = 1e-12
ALPHAS, TREND_SHARES, DAMPINGS, SEASON_SHARES = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8), (0.05, 0.2), (0.9, 0.98), (0.05, 0.2)


@dataclass(frozen=True)
class Candidate:
    """Weights of an error in level, trend and season, and the damping: 0 without a trend, 1 for an undamped one."""

    trend: str
    seasonal: bool
    alpha: float
    beta: float
    phi: float
    gamma: float

    @property
    def terms(self) -> int:
        """What is estimated: variance, level and its weight, trend and its weight, damping, season and its weight."""
        return 3 + {"none": 0, "additive": 2, "damped": 3}[self.trend] + (SEASON if self.seasonal else 0)


def candidates() -> list[Candidate]:
    """Simpler models first. Seasonal ones, which are the long folds, have one trend weight and one damping."""
    out = []
    for seasonal in (False, True):
        shares, dampings = (TREND_SHARES[:1], DAMPINGS[:1]) if seasonal else (TREND_SHARES, DAMPINGS)
        trends = [("none", 0.0, 0.0), *(("additive", b, 1.0) for b in shares), *(("damped", b, phi) for b, phi in product(shares, dampings))]
        for (trend, share, phi), alpha, season in product(trends, ALPHAS, SEASON_SHARES if seasonal else (0.0,)):
            out.append(Candidate(trend, seasonal, alpha, alpha * share, phi, (1.0 - alpha) * season))
    return out


CANDIDATES = candidates()


def _grid() -> Column:
    """The candidates as a literal array, by one parsed text: a call for each of its numbers would take seconds."""
    rows = (f"struct({i} id, '{c.trend}' trend, {str(c.seasonal).lower()} seasonal, {c.alpha!r}D alpha, {c.beta!r}D beta, {c.phi!r}D phi, {c.gamma!r}D gamma, {c.terms} terms)" for i, c in enumerate(CANDIDATES))
    return F.expr(f"array({', '.join(rows)})")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _starts(df: DataFrame) -> DataFrame:
    """Adds what folds start from: mean and slope of the first LEAST values, means of the first two seasons and the first season's offsets."""
    head = F.slice("ys", 1, LEAST)
    centre, spread = (LEAST - 1) / 2, sum((i - (LEAST - 1) / 2) ** 2 for i in range(LEAST))
    slope = F.aggregate(F.transform(head, lambda x, i: x * (i - centre)), F.lit(0.0), lambda a, x: a + x) / spread
    df = df.withColumn("_mean", _mean(head)).withColumn("_slope", slope)
    long = F.size("ys") >= LEAST_SEASONAL
    df = df.withColumn("_first", F.when(long, _mean(F.slice("ys", 1, SEASON)))).withColumn("_second", F.when(long, _mean(F.slice("ys", SEASON + 1, SEASON))))
    return df.withColumn("_offsets", F.when(long, F.transform(F.slice("ys", 1, SEASON), lambda x: x - F.col("_first"))))


def _folded(c: Column) -> Column:
    """Candidate ``c`` over ``ys``: its state and AICc after each number of weeks in ``ends``."""
    none = c["trend"] == "none"
    level = F.when(c["seasonal"], F.col("_first")).when(none, F.col("_mean")).otherwise(F.col("_mean") - F.col("_slope") * ((LEAST + 1) / 2))
    trend = F.when(none, 0.0).when(c["seasonal"], (F.col("_second") - F.col("_first")) / SEASON).otherwise(F.col("_slope"))
    empty = F.array().cast("array<struct<n:int,aicc:double,id:int,l:double,b:double,s:array<double>>>")
    start = F.struct(
        F.lit(0).alias("n"), level.alias("l"), trend.alias("b"), F.when(c["seasonal"], F.col("_offsets")).otherwise(F.array().cast("array<double>")).alias("s"), F.lit(0.0).alias("sse"), empty.alias("kept")
    )

    def moved(acc: Column, y: Column) -> Column:
        ahead = F.struct((acc["l"] + c["phi"] * acc["b"]).alias("base"), F.coalesce(F.get(acc["s"], F.lit(0)), F.lit(0.0)).alias("s"))
        return held(ahead, lambda p: held(y - (p["base"] + p["s"]), lambda e: F.struct(
            (acc["n"] + 1).alias("n"), (p["base"] + c["alpha"] * e).alias("l"), (c["phi"] * acc["b"] + c["beta"] * e).alias("b"),
            F.when(c["seasonal"], F.concat(F.slice(acc["s"], 2, SEASON - 1), F.array(p["s"] + c["gamma"] * e))).otherwise(acc["s"]).alias("s"), (acc["sse"] + e * e).alias("sse"),
        )))

    def step(acc: Column, y: Column) -> Column:
        return held(moved(acc, y), lambda m: F.struct(
            m["n"].alias("n"), m["l"].alias("l"), m["b"].alias("b"), m["s"].alias("s"), m["sse"].alias("sse"),
            F.when(F.array_contains("ends", m["n"]), F.concat(acc["kept"], F.array(F.struct(m["n"].alias("n"), _aicc(m["sse"], m["n"], c["terms"]).alias("aicc"), c["id"].alias("id"), m["l"].alias("l"), m["b"].alias("b"), m["s"].alias("s"))))).otherwise(acc["kept"]).alias("kept"),
        ))

    least = F.when(c["seasonal"], LEAST_SEASONAL).otherwise(LEAST)
    return F.filter(F.aggregate("ys", start, step, lambda acc: acc["kept"]), lambda k: k["n"] >= least)


def _aicc(sse: Column, n: Column, terms: Column) -> Column:
    return n * F.log(F.greatest(sse / n, F.lit(LEAST_VARIANCE))) + 2 * terms + F.try_divide(2.0 * terms * (terms + 1), n - terms - 1)


def smoothing_fits(history: DataFrame, origins: DataFrame, horizon: int, value: str = "units_unconstrained") -> DataFrame:
    """(item_id, region, as_of, n_weeks, trend, seasonal, alpha, beta, phi, gamma, aicc, path): each origin's best model of each series and its points, not below 0.

    Weeks without a value are left out. A series with under LEAST weeks at an origin has no row there; a season is tried from LEAST_SEASONAL weeks on. Of
    models with the same AICc the first of the grid, a simpler one, stands."""
    known = history.where(F.col(value).isNotNull()).select(*SERIES, "week", F.col(value).cast("double").alias("y"))
    # by number: a series is many folds and few bytes, so partitions must not be merged by their bytes
    known = known.repartition(int(history.sparkSession.conf.get("spark.sql.shuffle.partitions")), *SERIES)
    asked = origins.agg(F.sort_array(F.collect_set("as_of")).alias("asked"))  # one row, a date an origin
    whole = known.groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct("week", "y"))).alias("all"))  # the weeks of a series
    df = whole.join(F.broadcast(asked), F.lit(True)).withColumn("ats", F.transform("asked", lambda a: F.struct(a.alias("as_of"), F.size(F.filter("all", lambda r: r["week"] <= a)).alias("n"))))
    df = df.withColumn("ends", F.array_distinct(F.filter(F.transform("ats", lambda a: a["n"]), lambda n: n >= LEAST))).where(F.size("ends") > 0)
    df = _starts(df.withColumn("ys", F.slice(F.transform("all", lambda r: r["y"]), F.lit(1), F.array_max("ends"))).drop("all"))
    tried = F.filter(_grid(), lambda c: ~c["seasonal"] | (F.size("ys") >= LEAST_SEASONAL))
    df = df.withColumn("kept", F.flatten(F.transform(tried, _folded)))
    best = df.select(*SERIES, "kept", F.explode("ats").alias("at")).where(F.col("at.n") >= LEAST).select(*ORIGIN[:2], F.col("at.as_of").alias("as_of"), F.array_min(F.filter("kept", lambda k: k["n"] == F.col("at.n"))).alias("best"))
    best = best.withColumn("c", F.get(_grid(), F.col("best.id")))
    damp = lambda h: F.aggregate(F.sequence(F.lit(1), h), F.lit(0.0), lambda a, i: a + F.pow(F.col("c.phi"), i))
    point = lambda h: F.col("best.l") + F.col("best.b") * damp(h) + F.coalesce(F.get("best.s", (h - 1) % SEASON), F.lit(0.0))
    path = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.greatest(F.lit(0.0), point(h)))
    return best.select(*ORIGIN, F.col("best.n").alias("n_weeks"), *[F.col(f"c.{f}").alias(f) for f in ("trend", "seasonal", "alpha", "beta", "phi", "gamma")], F.col("best.aicc").alias("aicc"), path.alias("path"))


def smoothing_forecast(history: DataFrame, origins: DataFrame, horizon: int, value: str = "units_unconstrained") -> DataFrame:
    """``statistical_forecast`` with the smoothing points in its band, where a series has LEAST weeks."""
    return statistical_forecast(history, origins, horizon, value, smoothing_fits(history, origins, horizon, value).select(*ORIGIN, "path"))


@reads_panel
def smoothing(panel: DataFrame, origins: DataFrame, horizon: int, value: str, axis: DataFrame) -> DataFrame:
    """Backtest forecaster: smoothing points, and the statistical ones of shorter histories."""
    found = smoothing_forecast(panel, origins, horizon, value).withColumnRenamed("p50", "pred")
    return on_axis(found, axis, origins).select(*SERIES, "as_of", "week", "pred")
