"""The five weekly feeds, derived from the star-schema tables: item = part type, region = region of the supplier (or, for
shipments, of the customer), week = Monday of the ship (or order) date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.functions.scalars import monday
from weekloom.functions.series import by_series

PROMO_FROM = 0.065


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "region")


def _shipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("item_id"))
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    at = supplier.join(_places(spark, sf_dir), supplier.s_nationkey == F.col("n_nationkey")).select("s_suppkey", "region")
    return lines.join(part, lines.l_partkey == part.p_partkey).join(at, lines.l_suppkey == at.s_suppkey).withColumn("week", monday(F.col("l_shipdate")))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales, stock and promo flag of each series and week, from one pass over the lines."""
    held = F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0))
    moving = F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0))
    promoted = F.when(F.round(F.avg("l_discount"), 6) >= PROMO_FROM, 1.0).otherwise(0.0)
    return _shipped_lines(spark, sf_dir).groupBy("item_id", "region", "week").agg(
        F.sum("l_quantity").alias("units_sold"), (4.0 * held).alias("on_hand_units"), moving.alias("in_transit_units"), promoted.alias("promo_flag")
    )


def pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).select("item_id", "region", "week", "units_sold")


def channel_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).select("item_id", "region", "week", "on_hand_units", "in_transit_units")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("item_id"))
    places = _places(spark, sf_dir)
    at = customer.join(places, customer.c_nationkey == places.n_nationkey).select("c_custkey", "region")
    sold = orders.join(at, orders.o_custkey == at.c_custkey).select("o_orderkey", "region", monday(F.col("o_orderdate")).alias("week"))
    return lines.join(part, lines.l_partkey == part.p_partkey).join(sold, lines.l_orderkey == sold.o_orderkey).groupBy("item_id", "region", "week").agg(F.sum("l_quantity").alias("units_shipped"))


def demand_plan(spark: SparkSession, sf_dir: str, sold: DataFrame | None = None) -> DataFrame:
    """Two vintages: a six-row mean cut by 4 %, six weeks ahead, and a three-row mean, two weeks ahead."""
    w = by_series()
    of = lambda rows, share, days: F.struct((F.avg("units_sold").over(w.rowsBetween(1 - rows, 0)) * share).alias("plan_units"), F.date_sub("week", days).alias("plan_version_date"))
    sold = (pos(spark, sf_dir) if sold is None else sold).select("item_id", "region", "week", F.array(of(6, 0.96, 42), of(3, 1.0, 14)).alias("both"))
    return sold.select("item_id", "region", "week", F.inline("both"))


def promo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).select("item_id", "region", "week", "promo_flag")


#: The same in DuckDB, as CTEs.
FEEDS_SQL = """
places as (select n_nationkey, r_name as region from nation join region on n_regionkey = r_regionkey),
lines as (
  select p_type as item_id, pl.region, cast(date_trunc('week', l_shipdate) as date) as week, l_quantity, l_discount, l_returnflag, l_linestatus
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join places pl on s_nationkey = n_nationkey
),
pos as (select item_id, region, week, sum(l_quantity) as units_sold from lines group by all),
inv as (
  select item_id, region, week, 4.0::double * sum(case when l_returnflag = 'N' then l_quantity else 0 end) as on_hand_units,
    sum(case when l_linestatus = 'O' then l_quantity else 0 end)::double as in_transit_units
  from lines group by all
),
ship as (
  select p_type as item_id, pl.region, cast(date_trunc('week', o_orderdate) as date) as week, sum(l_quantity) as units_shipped
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join places pl on c_nationkey = n_nationkey
  group by all
),
plan as (
  select item_id, region, week, avg(units_sold) over (partition by item_id, region order by week rows between 5 preceding and current row) * 0.96::double as plan_units, week - 42 as plan_version_date from pos
  union all
  select item_id, region, week, avg(units_sold) over (partition by item_id, region order by week rows between 2 preceding and current row), week - 14 from pos
),
promo as (select item_id, region, week, case when round(avg(l_discount), 6) >= 0.065::double then 1.0::double else 0.0::double end as promo_flag from lines group by all)
"""
