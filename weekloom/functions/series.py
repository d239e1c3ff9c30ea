"""Window expressions over one weekly series: (item_id, region) ordered by week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ("item_id", "region")
#: Scales a median absolute deviation to a standard deviation, and keeps it off zero.
MAD_SCALE, MAD_FLOOR = 1.4826, 1e-9


def by_series(keys: Sequence[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("week")


def whole_series(keys: Sequence[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys)


def median(col: Column | str) -> Column:
    """Exact median with linear interpolation; unlike ``median`` it accepts a window frame."""
    return F.percentile(col, F.lit(0.5))


def held(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: what a lambda captures from outside may otherwise be computed again for each element."""
    return F.transform(F.array(value), use)[0]


def array_median(values: Column) -> Column:
    """Median of an array without nulls; null of an empty one."""
    place = lambda s, n: F.get(s, F.floor(n / 2).cast("int"))
    return held(F.sort_array(values), lambda s: (place(s, F.size(s) - 1) + place(s, F.size(s))) / 2)


def rolling_median(col: str, before: int, after: int, least: int = 1, keys: Sequence[str] = SERIES) -> Column:
    """Median of the rows from ``before`` rows back to ``after`` rows ahead; null where fewer than ``least`` have a value."""
    frame = by_series(keys).rowsBetween(-before, after)
    return F.when(F.count(col).over(frame) >= least, median(F.col(col)).over(frame))


def centered_median(col: str, width: int, least: int, keys: Sequence[str] = SERIES) -> Column:
    """Centred frame of ``width`` rows; an even width reaches one row further back than ahead."""
    return rolling_median(col, width // 2, (width - 1) // 2, least, keys)


def with_interpolated(df: DataFrame, col: str, out: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """Adds ``out``: ``col`` with gaps filled linearly by row position, and the ends with the nearest value."""
    w = by_series(keys)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(col).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(col).alias("v")))
    df = df.withColumn("_at", F.row_number().over(w)).withColumn("_p", F.last(known, True).over(back)).withColumn("_n", F.first(known, True).over(ahead))
    gap = F.col("_n.at") - F.col("_p.at")
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("_at") - F.col("_p.at")) / F.when(gap != 0, gap)
    filled = F.when(F.col(col).isNotNull(), F.col(col)).when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull(), F.col("_p.v")).otherwise(line)
    return df.withColumn(out, filled).drop("_at", "_p", "_n")


def with_despiked(df: DataFrame, col: str, out: str, width: int, k: float, keys: Sequence[str] = SERIES) -> DataFrame:
    """Adds ``out``: ``col`` capped at trailing median + k scaled deviations; each deviation is from its own row's median."""
    df = df.withColumn("_m", rolling_median(col, width - 1, 0, keys=keys)).withColumn("_d", F.abs(F.col(col) - F.col("_m")))
    df = df.withColumn("_d", rolling_median("_d", width - 1, 0, keys=keys) * MAD_SCALE + MAD_FLOOR)
    return df.withColumn(out, F.least(F.col(col), F.col("_m") + k * F.col("_d"))).drop("_m", "_d")


def with_ewm(df: DataFrame, col: str, out: str, span: int, keys: Sequence[str] = SERIES, reach: int = 128) -> DataFrame:
    """Adds ``out``: exponentially weighted mean with normalised weights.

    Weights beyond ``reach`` rows are under 1e-18 for a span of 6, so a bounded frame gives the same double."""
    keep = 1.0 - 2.0 / (span + 1.0)
    frame = by_series(keys).rowsBetween(-(reach - 1), 0)
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    step = lambda acc, x: F.struct((acc["n"] * keep + x).alias("n"), (acc["d"] * keep + 1.0).alias("d"))
    return df.withColumn("_l", F.collect_list(col).over(frame)).withColumn(out, F.aggregate("_l", start, step, lambda acc: F.when(acc["d"] > 0, acc["n"] / F.when(acc["d"] > 0, acc["d"])))).drop("_l")


def with_mad(df: DataFrame, col: str, out: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """Adds ``out``: median absolute deviation of ``col`` over the series, unscaled, plus the floor."""
    w = whole_series(keys)
    df = df.withColumn("_c", median(F.col(col)).over(w)).withColumn("_a", F.abs(F.col(col) - F.col("_c")))
    return df.withColumn(out, median(F.col("_a")).over(w) + MAD_FLOOR).drop("_c", "_a")


def islands(df: DataFrame, flag: str, least: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """Runs of ``least`` or more consecutive rows with ``flag``: keys, run_weeks, start_week, end_week."""
    w = by_series(keys)
    runs = df.withColumn("_r", F.row_number().over(w)).where(F.col(flag)).withColumn("_g", F.col("_r") - F.row_number().over(w))
    out = runs.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("run_weeks"), F.min("week").alias("start_week"), F.max("week").alias("end_week"))
    return out.where(F.col("run_weeks") >= least).drop("_g")
