"""One as-of run over a workspace: repair, forecast and blend, projection, alerts, backtest, manifest."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions.series import SERIES
from weekloom.operators import alerts, backtest, forecast, ml, repair, smoothing, translate
from weekloom.sources.schemas import RunConfig
from weekloom.sources.workspace import Workspace

FORECAST_COLUMNS = ("item_id", "region", "week", "lag", "p10", "p50", "p90", "plan_units", "blend_weight_sensed", "blended")


@dataclass
class RunResult:
    run_id: str
    as_of: dt.date
    config: RunConfig
    repaired: DataFrame
    forecast: DataFrame
    inventory_projection: DataFrame
    alerts: DataFrame
    fva: DataFrame
    fva_by_lag: DataFrame
    manifest: dict

    def outputs(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in ("repaired", "forecast", "inventory_projection", "alerts", "fva", "fva_by_lag")}


def _given(df: DataFrame) -> DataFrame | None:
    return None if df.isEmpty() else df


def blended_forecast(repaired: DataFrame, plan: DataFrame | None, cfg: RunConfig, override: DataFrame | None = None) -> DataFrame:
    origins = repaired.sparkSession.createDataFrame([(cfg.as_of,)], "as_of date")
    tier = smoothing.smoothing_forecast if cfg.smoothing_enabled else forecast.statistical_forecast
    points = ml.overridden(tier(repaired, origins, cfg.horizon_weeks), override)
    return forecast.blend(points, plan, cfg.horizon_weeks).select(*FORECAST_COLUMNS)


def tidy_scores(repaired: DataFrame, inventory: DataFrame | None, shipments: DataFrame | None, plan: DataFrame | None, promo: DataFrame | None, cfg: RunConfig) -> DataFrame:
    """Scores of every method that has its inputs. Sell-in is scored on shipments, the others on unconstrained sell-out."""
    tier = ml.ml_forecaster(promo, inventory, champion=True) if cfg.ml_enabled else smoothing.smoothing if cfg.smoothing_enabled else backtest.statistical
    parts = [backtest.backtest(backtest.naive, repaired, cfg, method="naive", check=False), backtest.backtest(tier, repaired, cfg, method="statistical", check=False)]
    if shipments is not None:
        panel = translate.shipped_panel(repaired, shipments)
        parts.append(backtest.backtest(translate.translated_forecaster(repaired, inventory, shipments, cfg), panel, cfg, value="units_shipped", method="translated", check=False))
    if plan is not None:
        parts.append(backtest.backtest(backtest.plan(plan), repaired, cfg, method="plan", check=False))
    return reduce(DataFrame.unionByName, parts)


def run_pipeline(workspace: Workspace, as_of: dt.date, config: RunConfig) -> RunResult:
    pos = workspace.read_canonical("pos")
    if pos.isEmpty():
        raise ValueError("the workspace has no sell-out; add a pos snapshot and rebuild first")
    inventory, shipments, plan, promo = (_given(workspace.read_canonical(s)) for s in ("channel_inventory", "shipments", "demand_plan", "promo"))
    repaired = repair.repair(pos, inventory, promo).persist()  # read by the forecast, the alerts and each backtest
    override, won = ml.sellout_override(repaired, promo, inventory, config) if config.ml_enabled else (None, None)
    ahead = blended_forecast(repaired, plan, config, override)
    projection = translate.inventory_projection(ahead, repaired, inventory, config)
    tidy = tidy_scores(repaired, inventory, shipments, plan, promo, config)
    run_id = uuid.uuid4().hex[:12]
    rows = {s: workspace.read_canonical(s).count() for s in ("pos", "channel_inventory", "shipments", "demand_plan", "promo")}
    manifest = {
        "run_id": run_id, "as_of": as_of.isoformat(), "config": config.to_dict(), "inputs": rows, "snapshots": [r.asDict() for r in workspace.list_snapshots().collect()], "ml_enabled": config.ml_enabled,
        "ml_backend": "stumps" if config.ml_enabled else None, "ml_champion_series": ["|".join((r.item_id, r.region)) for r in won.orderBy(*SERIES).collect()] if won is not None else [],
    }
    result = RunResult(
        run_id, as_of, config, repaired, ahead, projection, alerts.all_alerts(ahead, projection, repaired, config), backtest.fva_waterfall(tidy), backtest.ordered_by_lag(backtest.fva_by_lag(tidy)), manifest
    )
    workspace.save_run(run_id, as_of, manifest, result.outputs())
    return result


# ---- views over a run's outputs -------------------------------------------------------------------------


def ranked_series(forecast_rows: DataFrame, alert_rows: DataFrame, by: str = "severity") -> DataFrame:
    """(item_id, region, volume, severity_rank): series by volume, or by their worst alert and then volume; without an alert the rank is -1."""
    volume = forecast_rows.groupBy(*SERIES).agg(F.sum("blended").alias("volume"))
    rank = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    worst = alert_rows.groupBy(*SERIES).agg(F.max(rank).alias("severity_rank"))
    out = volume.join(worst, [*SERIES], "left").withColumn("severity_rank", F.coalesce("severity_rank", F.lit(-1)))
    return out.orderBy(*([F.desc("severity_rank")] if by == "severity" else []), F.desc("volume"), *SERIES)


def orders_against_plan(forecast_rows: DataFrame, projection: DataFrame) -> DataFrame:
    """Long chart rows (item_id, region, week, measure, units) of projected orders, blended forecast and plan."""
    both = forecast_rows.select(*SERIES, "week", "blended", "plan_units").join(projection.select(*SERIES, "week", "projected_order"), [*SERIES, "week"], "left")
    return both.unpivot([*SERIES, "week"], ["blended", "plan_units", "projected_order"], "measure", "units").where("units is not null")


def censored_bands(repaired: DataFrame) -> DataFrame:
    """A band of 3.5 days on either side of each censored week."""
    at = F.col("week").cast("timestamp")
    return repaired.where("is_censored").select(*SERIES, (at - F.expr("interval 84 hours")).alias("band_start"), (at + F.expr("interval 84 hours")).alias("band_end"))


# What charts call their measures.
COMPONENTS = {"base_units": "Base demand", "promo_uplift": "Promo uplift"}
POSITIONS = {"projected_on_hand": "Projected on-hand", "target_position": "Target position"}


def _long(rows: DataFrame, names: dict[str, str], label: str) -> DataFrame:
    """A row for each of the named measures that a week has."""
    shown = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rows.unpivot([*SERIES, "week"], [*names], label, "units").where("units is not null").withColumn(label, shown[F.col(label)])


def decomposition(repaired: DataFrame) -> DataFrame:
    """(item_id, region, week, component, units): base and promotional demand of the series that had any uplift."""
    lifted = repaired.groupBy(*SERIES).agg(F.sum("promo_uplift").alias("_up")).where(F.col("_up") > 0).select(*SERIES)
    return _long(repaired.join(lifted, [*SERIES], "left_semi"), COMPONENTS, "component")


def inventory_against_target(projection: DataFrame) -> DataFrame:
    """(item_id, region, week, series, units): projected stock and what cover asks for."""
    return _long(projection, POSITIONS, "series")
