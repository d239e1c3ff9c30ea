"""Every registered query of the demand pipeline over the star-schema tables, with its DuckDB SQL.

Doubles are rounded to six places on both sides; a query without SQL is named in ROWS_ONLY with the reason."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions import scalars, series
from weekloom.operators import alerts, backtest, forecast, ml, quality, smoothing, translate
from weekloom.operators import repair as rep
from weekloom.plans import oracles as o
from weekloom.plans import pipeline as pipe
from weekloom.sources import driver_tables as feeds
from weekloom.sources import uploads, workspace
from weekloom.sources.schemas import RunConfig
from weekloom.sources.scratch import written

AS_OF = dt.date.fromisoformat(o.AS_OF)
CFG = RunConfig(as_of=AS_OF)
KEYS = ("item_id", "region", "week")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS_ONLY = {"ml_champion": "a boosted model", "backtest_champion": "the same at every origin", "ml_quantiles": "boosted models", "ml_quantile_coverage": "the same"}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class Inputs:
    """What queries read in several places, each made once a query and written: rows by series and week."""

    def __init__(self, spark: SparkSession, d: str, stock: float = 1.0):
        self.spark, self.d, self.stock = spark, d, stock

    @cached_property
    def weekly(self) -> DataFrame:
        return written(feeds.weekly(self.spark, self.d).withColumn("on_hand_units", F.col("on_hand_units") * self.stock), "weekly")

    @cached_property
    def together(self) -> DataFrame:
        return self.weekly.select(*KEYS, "units_sold", "on_hand_units", "promo_flag")

    @cached_property
    def repaired(self) -> DataFrame:
        return written(rep.repaired(self.together), "repaired")

    @cached_property
    def inventory(self) -> DataFrame:
        return self.weekly.select(*KEYS, "on_hand_units", "in_transit_units")

    @cached_property
    def promo(self) -> DataFrame:
        return self.weekly.select(*KEYS, "promo_flag")

    @cached_property
    def plan(self) -> DataFrame:
        return feeds.demand_plan(self.spark, self.d, self.weekly)

    @cached_property
    def shipments(self) -> DataFrame:
        return written(feeds.shipments(self.spark, self.d), "shipments")

    @cached_property
    def blended(self) -> DataFrame:
        return written(pipe.blended_forecast(self.repaired, self.plan, CFG), "blended")

    @cached_property
    def projection(self) -> DataFrame:
        return translate.inventory_projection(self.blended, self.repaired, self.inventory, CFG)


def repaired(spark: SparkSession, d: str) -> DataFrame:
    return Inputs(spark, d).repaired


def steps(spark: SparkSession, d: str) -> DataFrame:
    """The repair with its inner columns."""
    return rep.with_damped(rep.with_imputed(rep.with_censoring(rep.with_level(Inputs(spark, d).together))))


def one_origin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(AS_OF,)], "as_of date")


def blended(spark: SparkSession, d: str) -> DataFrame:
    return Inputs(spark, d).blended


def projection(spark: SparkSession, d: str, stock: float = 1.0) -> DataFrame:
    return Inputs(spark, d, stock).projection


def known_rows(spark: SparkSession, d: str) -> DataFrame:
    own = Inputs(spark, d)
    return translate.joined(own.repaired.where(F.col("week") <= F.lit(AS_OF)), own.inventory, own.shipments)


F_SQL = f"with {feeds.FEEDS_SQL}"
R_SQL = f"{F_SQL}, {o.REPAIR}"


# ---- tables, snapshots, coverage ------------------------------------------------------------------------


@query(f"""{F_SQL},
u as (select item_id, region, week, units_sold, 1 as o from pos union all select item_id, region, week, units_sold + 1, 2 from pos where region < 'B' or item_id < 'M'),
k as (select *, row_number() over (partition by item_id, region, week order by o desc) as n from u)
select item_id, region, week, units_sold from k where n = 1""")
def canonical_dedupe(spark: SparkSession, d: str) -> DataFrame:
    first = feeds.pos(spark, d)
    second = first.where("region < 'B' or item_id < 'M'").withColumn("units_sold", F.col("units_sold") + 1)
    return workspace.latest_rows([first.withColumn("_ord", F.lit(1)), second.withColumn("_ord", F.lit(2))], list(KEYS))


@query(f"""{F_SQL}, l as (select region as stream, count(*) as n, min(week) as a, max(week) as b from pos group by region, year(week))
select stream, count(*) as snapshots, sum(n)::bigint as rows, min(a) as date_min, max(b) as date_max from l group by stream""")
def snapshot_coverage(spark: SparkSession, d: str) -> DataFrame:
    log = feeds.pos(spark, d).groupBy(F.col("region").alias("stream"), F.year("week").alias("y")).agg(F.count(F.lit(1)).alias("row_count"), F.min("week").alias("date_min"), F.max("week").alias("date_max"))
    return workspace.snapshot_coverage(log)


@query(f"""{F_SQL} """ + " union all ".join(f"select '{s}' as stream, count(*) > 0 as loaded, count(*) as rows, min(week) as week_min, max(week) as week_max from {t}" for s, t in (("pos", "pos"), ("channel_inventory", "inv"), ("shipments", "ship"), ("demand_plan", "plan"), ("promo", "promo"))))
def canonical_status(spark: SparkSession, d: str) -> DataFrame:
    return workspace.canonical_status({s: getattr(feeds, s)(spark, d) for s in ("pos", "channel_inventory", "shipments", "demand_plan", "promo")})


@query(f"with {o.BACKTEST_CHAIN}, {o.PLAN_AS_OF} select item_id, region, week, as_of, round(plan_units, 6) as plan_units, plan_version_date from vintages")
def plan_asof_latest(spark: SparkSession, d: str) -> DataFrame:
    axis = backtest.week_axis(feeds.pos(spark, d))
    return rounded(forecast.plan_as_of(feeds.demand_plan(spark, d), backtest.origin_weeks(axis, CFG.backtest_weeks)))


# ---- quality gates --------------------------------------------------------------------------------------


@query(f"""{F_SQL}, g as (select max(week) as latest_week, (date '1998-12-28' - max(week)) / 7.0::double as gap from pos)
select latest_week, round(gap, 6) as gap_weeks, case when gap <= 2 then 'pass' when gap <= 4 then 'warn' else 'fail' end as status from g""")
def qc_freshness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.freshness_frame(feeds.pos(spark, d), "1998-12-28"))


@query(f"""{F_SQL}, r as (select item_id, region, min(week) as a, max(week) as b from pos group by all),
g as (select item_id, region, unnest(generate_series(a, b, interval 7 day))::date as missing_week from r)
select g.* from g anti join pos p on p.item_id = g.item_id and p.region = g.region and p.week = g.missing_week""")
def qc_date_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The weeks that each series lacks."""
    return quality.series_gaps(feeds.pos(spark, d))


@query("select c_custkey, c_acctbal from customer where c_acctbal < 0 or c_custkey < 0")
def qc_negatives(spark: SparkSession, d: str) -> DataFrame:
    return quality.negatives(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal"))


@query(f"""{F_SQL},
p as (select item_id, region, week, plan_units * case when week = date '1995-01-02' then 1000 else 1 end as plan_units, case when item_id < 'F' then week else plan_version_date end as plan_version_date from plan)
select item_id, region, week, round(plan_units, 6) as plan_units, plan_version_date, 'plan_version_date on/after target week (leakage)' as reason from p where plan_version_date >= week
union all select item_id, region, week, round(plan_units, 6), plan_version_date, 'plan_units implausibly large (>100x median)' from p where plan_units > 100 * (select quantile_cont(plan_units, 0.5) from p where plan_units > 0)""")
def qc_range(spark: SparkSession, d: str) -> DataFrame:
    plan = feeds.demand_plan(spark, d).withColumn("plan_units", F.col("plan_units") * F.when(F.col("week") == "1995-01-02", 1000.0).otherwise(1.0))
    plan = plan.withColumn("plan_version_date", F.when(F.col("item_id") < "F", F.col("week")).otherwise(F.col("plan_version_date")))
    return rounded(quality.out_of_range("demand_plan", plan))


@query("""select item_id, region, week, units_sold from (
  select *, count(*) over (partition by item_id, region, week) as n from (select l_orderkey::varchar as item_id, l_linenumber::varchar as region, cast(date_trunc('year', l_shipdate) as date) as week, l_quantity as units_sold from lineitem)
) where n > 1""")
def qc_duplicates(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    day = F.date_trunc("year", F.col("l_shipdate")).cast("date")
    return quality.duplicates("pos", lines.select(F.col("l_orderkey").cast("string").alias("item_id"), F.col("l_linenumber").cast("string").alias("region"), day.alias("week"), F.col("l_quantity").alias("units_sold")))


_MOVES = """
t as (select distinct week, item_id, region from pos),
x as (select week, lag(week) over (order by week) as b, lag(n) over (order by week) as base from (select week, count(*) as n from t group by week)),
moves as (
  select x.week, t.item_id, t.region, 'added' as change, base from x join t on t.week = x.week where b is not null and not exists (select 1 from t u where u.week = x.b and u.item_id = t.item_id and u.region = t.region)
  union all select x.week, t.item_id, t.region, 'dropped', base from x join t on t.week = x.b where not exists (select 1 from t u where u.week = x.week and u.item_id = t.item_id and u.region = t.region)
)"""


@query(f"""{F_SQL}, {_MOVES}, c as (select week, count(*) filter (change = 'added') as n_added, count(*) filter (change = 'dropped') as n_dropped, max(base) as base,
  string_agg(item_id || '|' || region, ', ' order by item_id || '|' || region) filter (change = 'added') as came, string_agg(item_id || '|' || region, ', ' order by item_id || '|' || region) filter (change = 'dropped') as went from moves group by week)
select week, n_added, n_dropped, coalesce(came, '—') as added, coalesce(went, '—') as dropped from c where (n_added + n_dropped) / greatest(1, base)::double >= 0.02""")
def qc_coverage_shift(spark: SparkSession, d: str) -> DataFrame:
    """At a threshold of 2 %, because few series of these tables ever stop."""
    return quality.coverage_shifts(feeds.pos(spark, d), 0.02)


@query(f"{F_SQL}, {_MOVES} select week, item_id, region, change, base from moves")
def qc_coverage_moves(spark: SparkSession, d: str) -> DataFrame:
    """Which series came and went, a row each."""
    return quality.coverage_moves(feeds.pos(spark, d))


@query("select distinct p_type as unmatched_item_id from part where p_type not in (select p_type from part where p_type < 'M')")
def qc_crosswalk_unmatched(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("item_id"))
    return quality.unmatched_items(items, items.where("item_id < 'M'"))


@query(f"""{F_SQL},
b as (select i.item_id, i.region, i.week, i.on_hand_units > 0 and coalesce(p.units_sold, 0) <= 120 as f from inv i left join pos p using (item_id, region, week)),
r as (select *, row_number() over (partition by item_id, region order by week) as n from b),
g as (select *, n - row_number() over (partition by item_id, region order by week) as k from r where f)
select item_id, region, count(*) as run_weeks, min(week) as start_week, max(week) as end_week from g group by item_id, region, k having count(*) >= 3""")
def qc_phantom_runs(spark: SparkSession, d: str) -> DataFrame:
    """Weeks of up to 120 units count as idle."""
    return quality.phantom_runs(feeds.channel_inventory(spark, d), feeds.pos(spark, d), idle=120.0)


# ---- scalars, coercion, reshaping -----------------------------------------------------------------------


@query("select cast(date_trunc('week', ts) as date) as week, event_type, count(*) as n, round(sum(value), 4) as value from events group by all")
def week_snap_agg(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.groupBy(scalars.monday(F.col("ts")).alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


_YEARS = tuple(range(1992, 1999))


@query(f"{F_SQL}, s as (select item_id, region, year(week) as y, sum(units_sold) as v from pos group by all) " + " union all ".join(f"select k.item_id, k.region, 'y{y}' as week, v as units_sold from (select distinct item_id, region from pos) k left join s on s.item_id = k.item_id and s.region = k.region and y = {y}" for y in _YEARS))
def unpivot_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = feeds.pos(spark, d).groupBy("item_id", "region").agg(*[F.sum(F.when(F.year("week") == y, F.col("units_sold"))).alias(f"y{y}") for y in _YEARS])
    return uploads.unpivot_wide(wide, ["item_id", "region"], "units_sold")


@query(f"""{F_SQL}, l as (select distinct 'WM Week ' || lpad(((year(week) % 100))::varchar, 2, '0') || lpad((dayofyear(week) // 7)::varchar, 2, '0') as label from pos),
p as (select label, 2000 + regexp_extract(label, '(\\d\\d)(\\d\\d)', 1)::int as y, regexp_extract(label, '(\\d\\d)(\\d\\d)', 2)::int as w from l)
select label, cast(date_trunc('week', make_date(y, 1, 1)) as date) + 7 * greatest(0, w - 1) as week from p""")
def wm_week_parse(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    label = F.concat(F.lit("WM Week "), two(F.year("week") % 100), two(F.floor(F.dayofyear("week") / 7)))
    labels = feeds.pos(spark, d).select(label.alias("label")).distinct()
    return labels.select("label", scalars.label_week(F.col("label")).alias("week"))


@query("""select o_orderkey, case when o_orderkey % 7 <> 0 then round(o_totalprice, 2) end as amount, case when o_orderkey % 4 < 3 then cast(date_trunc('week', o_orderdate) as date) end as week from orders""")
def coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    """Every order's price and date, written as people write them, and read back."""
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.format_number(F.round("o_totalprice", 2), 2), F.lit(" ")))
    forms = F.create_map(*[x for i, f in enumerate(("yyyy-MM-dd", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss")) for x in (F.lit(i), F.date_format("o_orderdate", f))])
    date = F.coalesce(F.try_element_at(forms, (F.col("o_orderkey") % 4).cast("int")), F.lit("soon"))
    df = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.alias("t"), date.alias("w"))
    return df.select("o_orderkey", F.round(scalars.number(F.col("t")), 2).alias("amount"), scalars.week(F.col("w")).alias("week"))


# ---- series functions -----------------------------------------------------------------------------------


@query(f"{F_SQL} select item_id, region, week, round({o.med('units_sold', 8, 0)}, 6) as med from pos")
def rolling_median_trailing(spark: SparkSession, d: str) -> DataFrame:
    return feeds.pos(spark, d).select(*KEYS, F.round(series.rolling_median("units_sold", 8, 0), 6).alias("med"))


@query(f"{F_SQL} select item_id, region, week, round({o.med('units_sold', 5, 5, 3)}, 6) as med11, round({o.med('units_sold', 26, 25, 26)}, 6) as med52 from pos")
def rolling_median_centered(spark: SparkSession, d: str) -> DataFrame:
    return feeds.pos(spark, d).select(*KEYS, F.round(series.centered_median("units_sold", 11, 3), 6).alias("med11"), F.round(series.centered_median("units_sold", 52, 26), 6).alias("med52"))


S_SQL = f"{R_SQL}, {o.STATE}"


def _state(spark: SparkSession, d: str) -> DataFrame:
    return forecast.trailing_state(repaired(spark, d), "units_unconstrained")


@query(f"{S_SQL} select item_id, region, week, round(capped, 6) as capped from state")
def despike(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_state(spark, d).select(*KEYS, "capped"))


@query(f"{F_SQL}, h as (select item_id, region, week, case when units_sold <= 150 then units_sold end as v from pos), {o.interpolated('h', 'i', 'v', 'filled')} select item_id, region, week, round(filled, 6) as filled from i")
def interpolate_gaps(spark: SparkSession, d: str) -> DataFrame:
    df = feeds.pos(spark, d).withColumn("v", F.when(F.col("units_sold") <= 150, F.col("units_sold")))
    return rounded(series.with_interpolated(df, "v", "filled").select(*KEYS, "filled"))


@query(f"{F_SQL}, {o.mad('pos', 'm', 'units_sold', 'mad')} select distinct item_id, region, round(mad, 6) as mad from m")
def robust_mad(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.with_mad(feeds.pos(spark, d), "units_sold", "mad").select("item_id", "region", "mad").distinct())


@query(f"{S_SQL} select item_id, region, week, round(level, 6) as level from state")
def ewm_level(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_state(spark, d).select(*KEYS, "level"))


@query(f"{S_SQL} select item_id, region, week, round(trend, 6) as trend from state")
def local_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_state(spark, d).select(*KEYS, "trend"))


@query(f"{S_SQL} select item_id, region, round(quantile_cont(resid, 0.1), 6) as q10, round(quantile_cont(resid, 0.9), 6) as q90, count(resid) as residuals from state group by all")
def residual_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("resid", F.array(F.lit(0.1), F.lit(0.9)))
    return _state(spark, d).groupBy("item_id", "region").agg(q.alias("q"), F.count("resid").alias("residuals")).select("item_id", "region", F.round(F.col("q")[0], 6).alias("q10"), F.round(F.col("q")[1], 6).alias("q90"), "residuals")


# ---- repair ---------------------------------------------------------------------------------------------


@query(f"{R_SQL} select item_id, region, week, round(expected, 6) as expected, is_censored from censored")
def repair_censored(spark: SparkSession, d: str) -> DataFrame:
    return rounded(steps(spark, d).select(*KEYS, "expected", "is_censored"))


@query(f"{R_SQL} select item_id, region, week, round(imputed, 6) as imputed from imputed where is_censored")
def repair_unconstrained(spark: SparkSession, d: str) -> DataFrame:
    return rounded(steps(spark, d).where("is_censored").select(*KEYS, "imputed"))


@query(f"{R_SQL} select item_id, region, week, round(units_unconstrained, 6) as units_unconstrained from damped")
def repair_outliers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(steps(spark, d).select(*KEYS, "units_unconstrained"))


@query(f"{R_SQL} select item_id, region, week, units_sold, round(units_unconstrained, 6) as units_unconstrained, is_censored, round(base_units, 6) as base_units, round(promo_uplift, 6) as promo_uplift from repaired")
def repair_promo(spark: SparkSession, d: str) -> DataFrame:
    return rounded(repaired(spark, d))


# ---- forecast and blend ---------------------------------------------------------------------------------


@query(f"{R_SQL}, {o.ONE_ORIGIN}, {o.NAIVE} select item_id, region, as_of, round(v, 6) as pred, lag from naive, (select unnest(range(1, 9))::int as lag)")
def naive_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.naive_forecast(repaired(spark, d), one_origin(spark), 8).select("item_id", "region", "as_of", "lag", "pred"))


@query(f"with {o.FORECAST_CHAIN} select item_id, region, as_of, last_week, lag, round(p10, 6) as p10, round(p50, 6) as p50, round(p90, 6) as p90 from forecast")
def statistical_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.statistical_forecast(repaired(spark, d), one_origin(spark), 8))


@query(f"with {o.FORECAST_CHAIN} select item_id, region, week, lag, round(p10, 6) as p10, round(p50, 6) as p50, round(p90, 6) as p90, round(plan_units, 6) as plan_units, round(w, 6) as blend_weight_sensed, round(w * p50 + (1 - w) * coalesce(plan_units, p50), 6) as blended from blended")
def blend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(blended(spark, d))


@query(f"with recursive {o.FEEDS_SQL}, {o.REPAIR}, {o.ONE_ORIGIN}, {o.smoothed(best_only=True)} select item_id, region, as_of, n_weeks, trend, seasonal, round(alpha, 6) as alpha, round(beta, 6) as beta, round(phi, 6) as phi, round(gamma, 6) as gamma, round(aicc, 6) as aicc from best")
def smoothing_models(spark: SparkSession, d: str) -> DataFrame:
    """The exponential-smoothing model that each series' weeks prefer."""
    return rounded(smoothing.smoothing_fits(repaired(spark, d), one_origin(spark), 8).drop("path"))


@query(f"""with recursive {o.FORECAST_CHAIN}, {o.smoothed()}
select item_id, region, as_of, last_week, lag, round(greatest(0, least(p50, p50 + case when ix < 1 then 0 else lo end * sqrt(lag))), 6) as p10, round(p50, 6) as p50, round(greatest(p50, p50 + case when ix < 1 then 0 else hi end * sqrt(lag)), 6) as p90 from shown""")
def smoothing_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(smoothing.smoothing_forecast(repaired(spark, d), one_origin(spark), 8))


# ---- translation ----------------------------------------------------------------------------------------

J_SQL = f"{R_SQL}, {o.ROWS}"


def _fits(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return rounded(translate.calibrated(known_rows(spark, d), CFG).select("item_id", "region", *names))


@query(f"{J_SQL}, {o.USABLE} select * from usable")
def inventory_usable(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d, "usable")


@query(f"{J_SQL}, {o.WOS} select item_id, region, round(target_wos, 6) as target_wos from wos")
def target_wos_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d, "target_wos")


@query(f"{J_SQL}, {o.RECOVERY} select item_id, region, round(replenish, 6) as replenish from recovery")
def replenishment_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d, "replenish")


@query(f"""{J_SQL}, n as (select *, count(*) over (partition by item_id, region) as n, count(h) over (partition by item_id, region) as kn from joined),
s as (select *, {", ".join(f"lead(h, {k}) over (partition by item_id, region order by week) as s{k}" for k in range(5))} from n),
c as (select item_id, region, any_value(n) as n, any_value(kn) as kn, {", ".join(f"case when stddev_pop(case when s{k} is not null then s end) > 0 and stddev_pop(case when s is not null then s{k} end) > 0 then corr(s, s{k}) end as c{k}" for k in range(5))} from s group by item_id, region),
t as ({" union all ".join(f"select item_id, region, n, kn, {k} as k, c{k} as c from c where c{k} is not null and n - {k} >= 8" for k in range(5))}),
b as (select *, row_number() over (partition by item_id, region order by c desc, k) as r from t)
select c.item_id, c.region, case when c.n >= 12 and c.kn >= 12 and b.c > 0 then b.k else 1 end::int as reaction_lag_weeks from c left join b on b.item_id = c.item_id and b.region = c.region and r = 1""")
def reaction_lag_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d, "reaction_lag_weeks")


@query(f"""{J_SQL},
n as (select *, row_number() over (partition by item_id, region order by week) as ix, quantile_cont(case when h > 0 then h end, 0.5) over (partition by item_id, region) as u, count(h) over (partition by item_id, region) as kn from joined),
g as (select *, ix - lag(ix) over (partition by item_id, region order by week) as gap from n where h > coalesce(0.05::double * u, 0)),
a as (select item_id, region, count(*) as orders, quantile_cont(gap::double, 0.5) as gap, max(kn) as kn from g group by all)
select k.item_id, k.region, case when orders >= 3 and kn >= 12 then greatest(1, least(4, round_even(gap, 0)::int)) else 1 end::int as order_cadence_weeks from (select distinct item_id, region from joined) k left join a using (item_id, region)""")
def order_cadence_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d, "order_cadence_weeks")


@query(f"{J_SQL}, {o.TRANSFER} select item_id, region, fitted, round(t0, 4) as intercept, round(t1, 4) as same_week, round(t2, 4) as week_before, round(t3, 4) as two_before, round(t4, 4) as three_before, round(ratio, 6) as ratio from transfer")
def transfer_function(spark: SparkSession, d: str) -> DataFrame:
    out = translate.calibrated(known_rows(spark, d), CFG)
    names = ("intercept", "same_week", "week_before", "two_before", "three_before")
    return out.select("item_id", "region", F.col("transfer").isNotNull().alias("fitted"), *[F.round(F.col("transfer")[i], 4).alias(n) for i, n in enumerate(names)], F.round("ratio", 6).alias("ratio"))


@query(f"with recursive {o.PROJECTION_CHAIN} select item_id, region, week, round(projected_on_hand, 6) as projected_on_hand, round(target_position, 6) as target_position, round(projected_order, 6) as projected_order from projection")
def project_orders(spark: SparkSession, d: str) -> DataFrame:
    return rounded(projection(spark, d))


@query(f"""with {o.FORECAST_CHAIN}, b as (select *, w * p50 + (1 - w) * coalesce(plan_units, p50) as x, first_value(p50) over (partition by item_id, region order by lag) as first from blended)
select item_id, region, lag, round(greatest(0, 6 * p50 - 5 * first), 6) as pred from b""")
def sell_in_by_cover(spark: SparkSession, d: str) -> DataFrame:
    """Orders where no stock is known."""
    return rounded(translate.cover_only(blended(spark, d), CFG))


# ---- alerts ---------------------------------------------------------------------------------------------


@query(o.DEVIATION)
def alert_deviation(spark: SparkSession, d: str) -> DataFrame:
    return alerts.deviation(blended(spark, d), CFG)


@query(f"select * from ({o.DEVIATION}) where severity = 'high'")
def alerts_by_severity(spark: SparkSession, d: str) -> DataFrame:
    return alerts.by_view(alerts.deviation(blended(spark, d), CFG), severity_is="high")


@query(o.STOCKOUT)
def alert_stockout(spark: SparkSession, d: str) -> DataFrame:
    return alerts.stockout(projection(spark, d), CFG)


@query(o.CLIFF.replace("4.0::double * sum", "40.0::double * sum"))
def alert_order_cliff(spark: SparkSession, d: str) -> DataFrame:
    """With ten times the stock, so that there are cliffs."""
    return alerts.order_cliff(projection(spark, d, 10.0))


@query(o.PROMO)
def alert_promo(spark: SparkSession, d: str) -> DataFrame:
    return alerts.promo_variance(repaired(spark, d).where(F.col("week") <= F.lit(AS_OF)))


@query(o.CENSORING)
def alert_censoring(spark: SparkSession, d: str) -> DataFrame:
    return alerts.censoring(repaired(spark, d).where(F.col("week") <= F.lit(AS_OF)))


# ---- backtest -------------------------------------------------------------------------------------------


@query(f"with {o.BACKTEST_CHAIN}, {o.NAIVE} {o.scored(o.NAIVE_PRED, 'naive')}")
def backtest_naive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.backtest(backtest.naive, repaired(spark, d), CFG, method="naive", check=False))


@query(f"with {o.BACKTEST_CHAIN}, {o.STATE}, {o.FORECAST} {o.scored(o.STAT_PRED, 'statistical')}")
def backtest_statistical(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.backtest(backtest.statistical, repaired(spark, d), CFG, method="statistical", check=False))


@query(f"with recursive {o.BACKTEST_CHAIN}, {o.STATE}, {o.FORECAST}, {o.smoothed()} {o.scored(o.SMOOTHED_PRED, 'statistical')}")
def backtest_smoothing(spark: SparkSession, d: str) -> DataFrame:
    """The statistical method's row with exponential smoothing; one fold of a candidate serves all origins."""
    return rounded(backtest.backtest(smoothing.smoothing, repaired(spark, d), CFG, method="statistical", check=False))


@query(f"with {o.BACKTEST_CHAIN}, {o.PLAN_AS_OF} {o.scored(o.PLAN_PRED, 'plan')}")
def backtest_plan(spark: SparkSession, d: str) -> DataFrame:
    own = Inputs(spark, d)
    return rounded(backtest.backtest(backtest.plan(own.plan), own.repaired, CFG, method="plan", check=False))


@query(f"with recursive {o.SHIPPED_CHAIN}, {o.TRANSLATED} {o.scored(o.TRANSLATED_PRED, 'translated')}")
def backtest_translated(spark: SparkSession, d: str) -> DataFrame:
    own = Inputs(spark, d)
    maker = translate.translated_forecaster(own.repaired, own.inventory, own.shipments, CFG)
    return rounded(backtest.backtest(maker, translate.shipped_panel(own.repaired, own.shipments), CFG, value="units_shipped", method="translated", check=False))


@query(f"with {o.SHIPPED_CHAIN}, {o.STATE}, {o.FORECAST} {o.scored(o.STAT_PRED, 'shipments_only')}")
def backtest_shipments_only(spark: SparkSession, d: str) -> DataFrame:
    own = Inputs(spark, d)
    panel = written(translate.shipped_panel(own.repaired, own.shipments), "panel")
    return rounded(backtest.backtest(backtest.statistical, panel, CFG, value="units_shipped", method="shipments_only", check=False))


def _tidy(spark: SparkSession, d: str) -> DataFrame:
    own = Inputs(spark, d)
    return pipe.tidy_scores(own.repaired, None, None, own.plan, None, CFG)


@query(o.FVA_ALL)
def fva_all_methods(spark: SparkSession, d: str) -> DataFrame:
    """By lag with all four methods; sell-in is scored on shipments."""
    own = Inputs(spark, d)
    tidy = pipe.tidy_scores(own.repaired, own.inventory, own.shipments, own.plan, None, CFG)
    return rounded(backtest.fva_by_lag(tidy))


@query(f"with {o.FVA} select lag, method, round(wmape, 4) as wmape, round(bias, 4) as bias from by_lag")
def fva_by_lag(spark: SparkSession, d: str) -> DataFrame:
    return backtest.fva_by_lag(_tidy(spark, d)).select("lag", "method", F.round("wmape", 4).alias("wmape"), F.round("bias", 4).alias("bias"))


@query(f"""with {o.FVA} select case method when 'naive' then 'Seasonal naïve' when 'statistical' then 'Statistical baseline' else 'Demand plan (lag-adj.)' end as step,
round(sum(abs(actual - pred)) / nullif(sum(abs(actual)), 0), 4) as wmape, round(sum(pred - actual) / nullif(sum(abs(actual)), 0), 4) as bias from tidy where lag <= 2 group by method""")
def fva_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return backtest.fva_waterfall(_tidy(spark, d)).select("step", F.round("wmape", 4).alias("wmape"), F.round("bias", 4).alias("bias"))


@query(f"""with {o.FVA}, s as (select method, avg(wmape) as w, avg(bias) as b from by_lag where lag <= 2 group by method), p as (select w as pw from s where method = 'plan')
select method, round(w, 4) as wmape_12, round(b, 4) as bias_12, round(pw, 4) as plan_wmape_12, round((pw - w) / nullif(pw, 0), 4) as gain, coalesce((pw - w) / nullif(pw, 0) >= 0.15 and abs(b) <= 0.05, false) as met from s, p where method <> 'plan'""")
def exit_criteria(spark: SparkSession, d: str) -> DataFrame:
    out = backtest.exit_criteria(backtest.fva_by_lag(_tidy(spark, d)))
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# ---- global model ---------------------------------------------------------------------------------------


_TAIL = lambda k: f"(partition by item_id, region order by week rows between {k - 1} preceding and current row)"


ML_SQL = f"""{R_SQL},
iv as (select item_id, region, week, on_hand_units / case when avg(on_hand_units) over {_TAIL(8)} > 1e-9 then avg(on_hand_units) over {_TAIL(8)} else 1 end as inv_ratio from inv),
b as (select r.item_id, r.region, r.week, units_unconstrained as y, coalesce(m.promo_flag, 0) as promo_t, coalesce(iv.inv_ratio, 1) as inv_ratio from repaired r left join promo m using (item_id, region, week) left join iv using (item_id, region, week)),
n as (select *, row_number() over (partition by item_id, region order by week) as ix, case when avg(y) over {_TAIL(13)} > 1e-9 then avg(y) over {_TAIL(13)} else 1 end as level from b)"""
_PER_LEVEL = f"""y / level as r_last, {", ".join(f"avg(y) over {_TAIL(k)} / level as r_mean{k}" for k in (2, 4, 8))}, case when ix >= 2 then stddev_pop(y) over {_TAIL(8)} / level else 0 end as r_std8,
  case when ix >= 4 then regr_slope(y, ix::double) over {_TAIL(4)} else 0 end / level as r_slope4, coalesce(lag(y, 51) over (partition by item_id, region order by week), level) / level as r_yoy, avg((y <= 1e-9)::int) over {_TAIL(8)} as zero_frac8"""


@query(f"""{ML_SQL}
select item_id, region, week, ix as n_rows, round(level, 6) as level, promo_t, round(inv_ratio, 6) as inv_ratio, round(y / level, 6) as r_last, {", ".join(f"round(avg(y) over {_TAIL(k)} / level, 6) as r_mean{k}" for k in (2, 4, 8))},
  round(case when ix >= 2 then stddev_pop(y) over {_TAIL(8)} / level else 0 end, 6) as r_std8, round(case when ix >= 4 then regr_slope(y, ix::double) over {_TAIL(4)} else 0 end / level, 6) as r_slope4,
  round(coalesce(lag(y, 51) over (partition by item_id, region order by week), level) / level, 6) as r_yoy, round(avg((y <= 1e-9)::int) over {_TAIL(8)}, 6) as zero_frac8
from n""")
def ml_features(spark: SparkSession, d: str) -> DataFrame:
    own = Inputs(spark, d)
    out = rounded(ml.origin_features(own.repaired, own.promo, own.inventory).drop("y"))
    return out.withColumn("at", F.col("at").cast("long")).withColumnRenamed("at", "n_rows")


@query(f"""{ML_SQL},
f as (select item_id, region, week, ix, level, promo_t, inv_ratio, {_PER_LEVEL}, {", ".join(f"lead(y, {h}) over wk as y{h}, lead(week, {h}) over wk as w{h}" for h in range(1, 9))} from n window wk as (partition by item_id, region order by week)),
t as ({" union all ".join(f"select *, {h} as h, y{h} as y_tgt, w{h} as week_tgt from f where ix >= 16 and y{h} is not null" for h in range(1, 9))})
select t.item_id, t.region, t.week, h::double as h, week_tgt, round(y_tgt / level, 6) as ratio, coalesce(m.promo_flag, 0)::double as promo_tgt, round(sin(2 * pi() * (week(week_tgt) % 52) / 52), 6) as woy_sin, round(cos(2 * pi() * (week(week_tgt) % 52) / 52), 6) as woy_cos,
  promo_t::double as promo_t, round(inv_ratio, 6) as inv_ratio, {", ".join(f"round({c}, 6) as {c}" for c in ("r_last", "r_mean2", "r_mean4", "r_mean8", "r_std8", "r_slope4", "r_yoy", "zero_frac8"))}
from t left join promo m on m.item_id = t.item_id and m.region = t.region and m.week = t.week_tgt""")
def ml_training_rows(spark: SparkSession, d: str) -> DataFrame:
    own = Inputs(spark, d)
    rows = ml.training_rows(ml.origin_features(own.repaired, own.promo, own.inventory), own.promo, 8)
    return rounded(rows.select(*KEYS, "week_tgt", "ratio", *ml.FEATURES))


@query()
def backtest_champion(spark: SparkSession, d: str) -> DataFrame:
    """The statistical method's row with the model where it leads; the models of all origins from one pass."""
    own = Inputs(spark, d)
    return rounded(backtest.backtest(ml.ml_forecaster(own.promo, own.inventory, champion=True), own.repaired, CFG, method="statistical", check=False))


@query()
def ml_champion(spark: SparkSession, d: str) -> DataFrame:
    own = Inputs(spark, d)
    return ml.champions(own.repaired.where(F.col("week") <= F.lit(AS_OF)), own.promo, own.inventory, CFG.horizon_weeks)


@query()
def ml_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """P10, P50 and P90 of every series from boosted quantile models."""
    own = Inputs(spark, d)
    return rounded(ml.quantile_forecast(own.repaired, own.promo, own.inventory, AS_OF, CFG.horizon_weeks))


@query()
def ml_quantile_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What share of the weeks held out after an earlier date came in under each quantile."""
    own = Inputs(spark, d)
    held = ml.quantile_forecast(own.repaired, own.promo, own.inventory, AS_OF - dt.timedelta(weeks=CFG.horizon_weeks), CFG.horizon_weeks)
    return rounded(ml.coverage(held, own.repaired))


# ---- views ----------------------------------------------------------------------------------------------


@query(f"""with {o.FORECAST_CHAIN},
b as (select item_id, region, w * p50 + (1 - w) * coalesce(plan_units, p50) as blended, plan_units, p50 from blended),
v as (select item_id, region, sum(blended) as volume, (sum(case when plan_units is not null then p50 end) - sum(plan_units)) / greatest(1, sum(plan_units)) as dev from b group by all)
select item_id, region, round(volume, 4) as volume, case when abs(dev) >= 0.30::double then 2 when abs(dev) >= 0.15::double then 1 else -1 end as severity_rank from v""")
def ranked_series(spark: SparkSession, d: str) -> DataFrame:
    rows = blended(spark, d)
    return pipe.ranked_series(rows, alerts.deviation(rows, CFG)).withColumn("volume", F.round("volume", 4))


@query("""select c_custkey, case when abs(v) >= 1000000 then printf('%.1fM', v / 1000000) when abs(v) >= 1000 then printf('%.1fK', v / 1000) else printf('%.0f', v) end as short from (select c_custkey, c_custkey * 1003.0::double + 0.3::double as v from customer)""")
def short_numbers(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", scalars.short_number(F.col("c_custkey") * 1003.0 + 0.3).alias("short"))


@query(f"{R_SQL} select item_id, region, week::timestamp - interval 84 hours as band_start, week::timestamp + interval 84 hours as band_end from repaired where is_censored")
def censored_bands(spark: SparkSession, d: str) -> DataFrame:
    return pipe.censored_bands(repaired(spark, d))


@query(f"""with recursive {o.PROJECTION_CHAIN},
u as (select b.item_id, b.region, b.week, w * p50 + (1 - w) * coalesce(plan_units, p50) as blended, plan_units, projected_order from blended b left join projection p using (item_id, region, week))
select item_id, region, week, 'blended' as measure, round(blended, 6) as units from u union all select item_id, region, week, 'plan_units', round(plan_units, 6) from u where plan_units is not null
union all select item_id, region, week, 'projected_order', round(projected_order, 6) from u where projected_order is not null""")
def orders_against_plan(spark: SparkSession, d: str) -> DataFrame:
    own = Inputs(spark, d)
    return rounded(pipe.orders_against_plan(own.blended, own.projection))


@query(f"""{R_SQL}, u as (select item_id, region from repaired group by all having sum(promo_uplift) > 0), l as (select r.* from repaired r semi join u using (item_id, region))
select item_id, region, week, 'Base demand' as component, round(base_units, 6) as units from l where base_units is not null union all select item_id, region, week, 'Promo uplift', round(promo_uplift, 6) from l where promo_uplift is not null""")
def demand_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pipe.decomposition(repaired(spark, d)))


@query(f"""with recursive {o.PROJECTION_CHAIN}
select item_id, region, week, 'Projected on-hand' as series, round(projected_on_hand, 6) as units from projection union all select item_id, region, week, 'Target position', round(target_position, 6) from projection""")
def inventory_against_target(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pipe.inventory_against_target(projection(spark, d)))


# ---- formats of text columns ----------------------------------------------------------------------------

_SAID = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "MMM dd, yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss")
_SAID_SQL = ("%Y-%m-%d", "%m/%d/%Y", "%Y/%m/%d", "%d-%b-%Y", "%b %d, %Y", "%Y%m%d", "%Y-%m-%d %H:%M:%S")
_READ_SQL = dict(zip((*scalars.DATE_FORMATS, *scalars.DAY_FIRST.values()), (*_SAID_SQL, "%d/%m/%Y"), strict=True))
_TEXTS_SQL = f"""t as (select o_orderkey as k, case o_orderkey % 7 {" ".join(f"when {i} then strftime(o_orderdate, '{f}')" for i, f in enumerate(_SAID_SQL))} end as mixed,
  strftime(o_orderdate, '%d/%m/%Y') as day_month, case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%d/%m/%Y') else strftime(o_orderdate, '%m/%d/%Y') end as both_ways from orders)"""
_COLUMNS = ("mixed", "day_month", "both_ways")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    said = lambda f: F.date_format("o_orderdate", f)
    mixed = F.element_at(F.array(*[said(f) for f in _SAID]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return orders.select(F.col("o_orderkey").alias("k"), mixed.alias("mixed"), said("dd/MM/yyyy").alias("day_month"), F.when(F.col("o_orderkey") % 2 == 0, said("dd/MM/yyyy")).otherwise(said("MM/dd/yyyy")).alias("both_ways"))


@query(f"""with {_TEXTS_SQL}, s as (select source, v, regexp_extract(v, '^([0-9]+)/([0-9]+)/[0-9]+$', ['a', 'b']) as p from ({" union all ".join(f"select '{c}' as source, {c} as v from t" for c in _COLUMNS)})),
w as (select source, v, try_cast(p.a as int) as a, try_cast(p.b as int) as b from s), e as (select source, count(case when a > 12 and b <= 12 then 1 end) > 0 and count(case when b > 12 and a <= 12 then 1 end) = 0 as day_first from w group by source)
{" union all ".join(f"select source, '{f}' as format, count(try_strptime(v, '{q}')) as cells, any_value(day_first) as day_first from w join e using (source) group by source" for f, q in _READ_SQL.items())}""")
def date_formats(spark: SparkSession, d: str) -> DataFrame:
    return uploads.date_formats(_texts(spark, d), list(_COLUMNS))


@query(f"""with {_TEXTS_SQL} select k, coalesce({", ".join(f"try_strptime(mixed, '{_READ_SQL[f]}')" for f in scalars.DATE_FORMATS)})::date as mixed, strptime(day_month, '%d/%m/%Y')::date as day_month from t""")
def dates_of_any_format(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("k", scalars.day(F.col("mixed")).alias("mixed"), scalars.day(F.col("day_month"), day_first=True).alias("day_month"))
