"""Signal repair: stockout weeks de-censored, lone outliers damped, promotions split from base demand. One shuffle, by series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions.series import MAD_SCALE, by_series, centered_median, rolling_median, whole_series, with_interpolated, with_mad

# Fixed values.
LEVEL_WIDTH, IMPUTE_LEAST, LEVEL_LEAST = 11, 2, 3
CENSOR_RATIO, INVENTORY_LOW, INVENTORY_TRAIL, Z_CENSOR = 0.40, 0.50, 8, 3.5
BASE_WIDTH, Z_OUTLIER = 7, 5.0
COLUMNS = ("item_id", "region", "week", "units_sold", "units_unconstrained", "is_censored", "base_units", "promo_uplift")


def with_level(df: DataFrame) -> DataFrame:
    """Adds ``expected``: the centred 11-row median, its gaps interpolated."""
    return with_interpolated(df.withColumn("_lvl", centered_median("units_sold", LEVEL_WIDTH, LEVEL_LEAST)), "_lvl", "expected").drop("_lvl")


def with_censoring(df: DataFrame) -> DataFrame:
    """Adds ``is_censored``. Needs ``expected`` and ``on_hand_units`` (null where unknown).

    A week is censored if it sold under 40 % of the level and either fell short by 3.5 scaled deviations or, for
    series whose stock is known in over half of the weeks, had under half of the median stock of its trailing eight weeks."""
    df = with_mad(df.withColumn("_dev", F.col("units_sold") - F.col("expected")), "_dev", "_mad")
    known = F.avg(F.col("on_hand_units").isNotNull().cast("double")).over(whole_series()) > 0.5
    trail = rolling_median("on_hand_units", INVENTORY_TRAIL - 1, 0)
    df = df.withColumn("_has", known).withColumn("_trail", trail)
    depressed = F.col("units_sold") < CENSOR_RATIO * F.col("expected")
    far = F.col("expected") - F.col("units_sold") > Z_CENSOR * MAD_SCALE * F.col("_mad")
    low = F.coalesce((F.col("_trail") > 0) & (F.col("on_hand_units") < INVENTORY_LOW * F.col("_trail")), F.lit(False))
    return df.withColumn("is_censored", F.coalesce(depressed & (far | (F.col("_has") & low)), F.lit(False))).drop("_dev", "_mad", "_has", "_trail")


def with_imputed(df: DataFrame) -> DataFrame:
    """Adds ``imputed``: sales, but in censored weeks the interpolated median of the others around."""
    df = df.withColumn("_open", F.when(~F.col("is_censored"), F.col("units_sold")))
    df = with_interpolated(df.withColumn("_lvl", centered_median("_open", LEVEL_WIDTH, IMPUTE_LEAST)), "_lvl", "_fill")
    return df.withColumn("imputed", F.when(F.col("is_censored"), F.greatest(F.lit(0.0), F.coalesce("_fill", "units_sold"))).otherwise(F.col("units_sold"))).drop("_open", "_lvl", "_fill")


def with_damped(df: DataFrame) -> DataFrame:
    """Adds ``units_unconstrained``: a lone week 5 scaled deviations off the level is pulled to it; a shift that a neighbour shares stays."""
    df = with_mad(df.withColumn("_dev", F.col("imputed") - F.col("expected")), "_dev", "_mad")
    df = df.withColumn("_far", F.abs("_dev") > Z_OUTLIER * MAD_SCALE * F.col("_mad"))
    w = by_series()
    lone = F.col("_far") & ~F.coalesce(F.lag("_far").over(w), F.lit(False)) & ~F.coalesce(F.lead("_far").over(w), F.lit(False))
    lone = lone & (F.col("promo_flag") <= 0) & ~F.col("is_censored")
    return df.withColumn("units_unconstrained", F.when(lone, F.greatest(F.lit(0.0), F.col("expected"))).otherwise(F.col("imputed"))).drop("_dev", "_mad", "_far")


def with_promo_split(df: DataFrame) -> DataFrame:
    """Adds ``base_units`` and ``promo_uplift``, which add up to the unconstrained units. A series of promo weeks only has no base: both are null."""
    df = df.withColumn("_base", F.when(F.col("promo_flag") <= 0, F.col("units_unconstrained")))
    df = with_interpolated(df.withColumn("_lvl", centered_median("_base", BASE_WIDTH, 1)), "_lvl", "_level")
    up = F.when(F.col("_level").isNotNull(), F.greatest(F.lit(0.0), F.col("units_unconstrained") - F.col("_level")))
    df = df.withColumn("promo_uplift", F.when(F.col("promo_flag") > 0, up).when(F.col("_level").isNotNull(), F.lit(0.0)))
    return df.withColumn("base_units", F.col("units_unconstrained") - F.col("promo_uplift")).drop("_base", "_lvl", "_level")


def joined_inputs(pos: DataFrame, inventory: DataFrame | None = None, promo: DataFrame | None = None) -> DataFrame:
    keys = ["item_id", "region", "week"]
    df = pos.select(*keys, F.col("units_sold").cast("double").alias("units_sold"))
    df = df.join(inventory.select(*keys, F.col("on_hand_units").cast("double").alias("on_hand_units")), keys, "left") if inventory is not None else df.withColumn("on_hand_units", F.lit(None).cast("double"))
    if promo is None:
        return df.withColumn("promo_flag", F.lit(0.0))
    return df.join(promo.select(*keys, F.col("promo_flag").cast("double").alias("promo_flag")), keys, "left").withColumn("promo_flag", F.coalesce("promo_flag", F.lit(0.0)))


def repair(pos: DataFrame, inventory: DataFrame | None = None, promo: DataFrame | None = None) -> DataFrame:
    """The repaired signal, columns COLUMNS, over all weeks of each series."""
    return repaired(joined_inputs(pos, inventory, promo))


def repaired(inputs: DataFrame) -> DataFrame:
    """The same from rows that have sales, stock (null where unknown) and promo flag together."""
    return with_promo_split(with_damped(with_imputed(with_censoring(with_level(inputs))))).select(*COLUMNS)
