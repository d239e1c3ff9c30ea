"""Quality gates over one weekly feed. Gates flag rows and never change them; each gives a status, a detail and its offenders."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.series import SERIES, by_series, islands, median
from weekloom.sources.schemas import REFERENCES, fields_of, grain

ORDER = ("pass", "warn", "fail")
HUGE = 100


@dataclass
class Check:
    name: str
    status: str
    detail: str
    offenders: DataFrame | None = None


@dataclass
class Report:
    stream: str
    checks: list[Check] = field(default_factory=list)

    @property
    def worst(self) -> str:
        return max((c.status for c in self.checks), key=ORDER.index, default="pass")


# ---- offenders, each a plan of its own -------------------------------------------------------------


def missing_weeks(df: DataFrame) -> DataFrame:
    """Weeks of the seven-day grid from the first week to the last that have no row."""
    present = df.select("week").where("week is not null").distinct()
    grid = present.agg(F.min("week").alias("a"), F.max("week").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 7 day"))).alias("week"))
    return grid.join(present, "week", "left_anti").select(F.col("week").alias("missing_week"))


def series_gaps(df: DataFrame) -> DataFrame:
    """(item_id, region, missing_week): weeks of each series' seven-day grid, between its own first and last, that have no row."""
    steps = df.where("week is not null").select(*SERIES, "week", F.lead("week").over(by_series()).alias("_next")).where(F.col("_next") > F.date_add("week", 7))
    grid = F.sequence(F.date_add("week", 7), F.date_sub("_next", 1), F.expr("interval 7 day"))
    return steps.select(*SERIES, F.explode(grid).alias("missing_week"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]


def negatives(df: DataFrame) -> DataFrame:
    """Rows with a negative number in any column."""
    numbers = numeric_columns(df)
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c) < 0, F.lit(False)) for c in numbers), F.lit(False)))


def measures(stream: str, df: DataFrame) -> list[str]:
    return [c for c, f in fields_of(stream).items() if f.role == "numeric" and c in df.columns and c != "promo_flag"]


def out_of_range(stream: str, df: DataFrame) -> DataFrame:
    """Rows that break a validity rule, once for each rule, with the reason.

    Flags other than 0 and 1 (or null), plan vintages dated on or after their week, and measures over 100 times the median of the positive ones."""
    found = []
    if "promo_flag" in df.columns:
        found.append(df.where(F.col("promo_flag").isNull() | ~F.col("promo_flag").isin(0, 1)).withColumn("reason", F.lit("promo_flag not in {0,1}")))
    if stream == "demand_plan" and "plan_version_date" in df.columns:
        found.append(df.where("plan_version_date >= week").withColumn("reason", F.lit("plan_version_date on/after target week (leakage)")))
    for c in measures(stream, df):
        usual = df.where(F.col(c) > 0).agg(median(F.col(c)).alias("_usual"))
        found.append(df.join(F.broadcast(usual), F.col(c) > HUGE * F.col("_usual")).drop("_usual").withColumn("reason", F.lit(f"{c} implausibly large (>100x median)")))  # usual is one row
    return reduce(DataFrame.unionByName, found) if found else df.limit(0).withColumn("reason", F.lit(""))


def duplicates(stream: str, df: DataFrame) -> DataFrame:
    """Every row that shares its grain with another."""
    keys = grain(stream, df.columns)
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")


def coverage_moves(df: DataFrame) -> DataFrame:
    """(week, item_id, region, change, base): a row for each series that a week has and the feed's week before it hadn't ("added"), or the other way round
    ("dropped"), with that earlier week's number of series.

    A series moves where its neighbouring row isn't of the neighbouring week, so one window by series finds both; only the week axis is joined."""
    there = df.where("week is not null").select(*SERIES, "week").repartition(*SERIES).distinct()
    order = Window.orderBy("week")  # one row a week
    weeks = there.groupBy("week").agg(F.count(F.lit(1)).alias("n")).select("week", F.row_number().over(order).alias("at"), F.lag("n").over(order).alias("base"))
    w = by_series()
    near = there.join(F.broadcast(weeks.select("week", "at")), "week").withColumn("_b", F.lag("at").over(w)).withColumn("_a", F.lead("at").over(w))  # weeks: one row each
    move = lambda when, at, change: F.when(when, F.struct(at.alias("at"), F.lit(change).alias("change")))
    came = move(F.col("_b").isNull() | (F.col("_b") < F.col("at") - 1), F.col("at"), "added")
    went = move(F.col("_a").isNull() | (F.col("_a") > F.col("at") + 1), F.col("at") + 1, "dropped")
    moves = near.select(*SERIES, F.explode(F.array_compact(F.array(came, went))).alias("m")).select(*SERIES, "m.at", "m.change")
    return moves.join(F.broadcast(weeks.where("base is not null")), "at").select("week", *SERIES, "change", "base")  # the first week has none before it, the last none after


def coverage_shifts(df: DataFrame, threshold: float = 0.30) -> DataFrame:
    """(week, n_added, n_dropped, added, dropped) where the series that came and went amount to the threshold's share of the week before.

    Names are for reading, listed for the weeks found only; ``coverage_moves`` has them as rows, for feeds of very many series."""
    moves = coverage_moves(df)
    many = lambda change: F.count_if(F.col("change") == change)
    by_week = moves.groupBy("week").agg(many("added").alias("n_added"), many("dropped").alias("n_dropped"), F.max("base").alias("base"))
    found = by_week.where((F.col("n_added") + F.col("n_dropped")) / F.greatest(F.lit(1), F.col("base")) >= threshold).drop("base")
    series = F.concat_ws("|", F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("region").cast("string"), F.lit("")))
    listed = lambda change: F.array_join(F.array_sort(F.collect_list(F.when(F.col("change") == change, series))), ", ").alias(change)
    names = moves.join(F.broadcast(found.select("week")), "week", "left_semi").groupBy("week").agg(listed("added"), listed("dropped"))  # a row a week
    dash = lambda c: F.when(F.col(c) == "", "—").otherwise(F.col(c)).alias(c)
    return found.join(names, "week").select("week", "n_added", "n_dropped", dash("added"), dash("dropped"))


def unmatched_items(df: DataFrame, crosswalk: DataFrame) -> DataFrame:
    known = crosswalk.select(F.col("item_id").cast("string").alias("unmatched_item_id")).distinct()
    return df.select(F.col("item_id").cast("string").alias("unmatched_item_id")).distinct().join(known, "unmatched_item_id", "left_anti")


def phantom_runs(inventory: DataFrame, pos: DataFrame, least: int = 3, idle: float = 0.0) -> DataFrame:
    """Runs of consecutive rows with stock on hand and no sell-out, or none above ``idle`` units; a missing sell-out row counts as none."""
    sold = pos.select("item_id", "region", "week", "units_sold")
    both = inventory.join(sold, ["item_id", "region", "week"], "left")
    return islands(both.withColumn("_s", (F.col("on_hand_units") > 0) & (F.coalesce("units_sold", F.lit(0.0)) <= idle)), "_s", least)


def reference_problems(name: str, df: DataFrame) -> DataFrame:
    """Source ids given twice, and rows with a blank target: (source, problem)."""
    source, target = list(REFERENCES[name])[:2]
    twice = df.groupBy(source).count().where("count > 1").select(F.col(source).alias("source"), F.lit("duplicate source id").alias("problem"))
    blank = df.where(F.col(target).isNull() | F.trim(target).isin("", "nan", "None")).select(F.col(source).alias("source"), F.lit("blank target").alias("problem"))
    return twice.unionByName(blank)


# ---- gates ------------------------------------------------------------------------------------------


def freshness(df: DataFrame, as_of: dt.date | None, sla_weeks: int = 2) -> Check:
    name = "Freshness / SLA"
    if "week" not in df.columns:
        return Check(name, "pass", "No week column to check.")
    latest = df.agg(F.max("week")).first()[0]
    if latest is None:
        return Check(name, "fail", "No week can be read, so freshness is unknown.")
    if as_of is None:
        return Check(name, "pass", f"Latest week {latest}; no date to compare with.")
    behind = (as_of - latest).days / 7.0
    status = "pass" if behind <= sla_weeks else "warn" if behind <= 2 * sla_weeks else "fail"
    return Check(name, status, f"Latest week {latest} is {behind:.0f} week(s) behind {as_of} (SLA {sla_weeks}).")


def freshness_frame(df: DataFrame, as_of: str, sla_weeks: int = 2) -> DataFrame:
    """The freshness gate as one row: latest_week, gap_weeks, status."""
    gap = F.datediff(F.lit(as_of).cast("date"), F.col("latest_week")) / 7.0
    status = F.when(F.col("latest_week").isNull(), "fail").when(gap <= sla_weeks, "pass").when(gap <= 2 * sla_weeks, "warn").otherwise("fail")
    return df.agg(F.max("week").alias("latest_week")).select("latest_week", gap.alias("gap_weeks"), status.alias("status"))


def _gate(name: str, found: DataFrame | None, warn: str, fine: str) -> Check:
    n = found.count() if found is not None else 0
    return Check(name, "warn", warn.format(n=n), found) if n else Check(name, "pass", fine)


def date_coverage(df: DataFrame) -> Check:
    name = "Date coverage"
    weeks = df.agg(F.countDistinct("week")).first()[0] if "week" in df.columns else 0
    if not weeks:
        return Check(name, "fail", "No week can be read.")
    if weeks == 1:
        return Check(name, "pass", "1 week present.")
    return _gate(name, missing_weeks(df), f"{weeks} weeks present, {{n}} missing between the first and the last.", f"{weeks} weeks without a gap.")


def run_qc(stream: str, df: DataFrame, crosswalk: DataFrame | None = None, pos: DataFrame | None = None, *, as_of: dt.date | None = None, sla_weeks: int = 2, phantom_weeks: int = 3, coverage_shift_threshold: float = 0.30) -> Report:
    """All gates in their fixed order."""
    extras = duplicates(stream, df)
    keyed = {"item_id", "region", "week"} <= set(df.columns)
    checks: Iterable[Check] = [
        freshness(df, as_of, sla_weeks),
        date_coverage(df),
        _gate("Negative values", negatives(df), "{n} row(s) with a negative measure.", "No negative values."),
        _gate("Impossible / range values", out_of_range(stream, df), "{n} row(s) break a validity rule.", "All values are within range."),
        _gate("Duplicate rows", extras, "{n} row(s) share their grain with another.", "No duplicates on the grain."),
        _gate("Coverage shift", coverage_shifts(df, coverage_shift_threshold) if keyed else None, "{n} week(s) with a sudden change of the active series.", "The active series are stable."),
        _gate("Crosswalk match", unmatched_items(df, crosswalk) if crosswalk is not None and "item_id" in df.columns else None, "{n} item(s) without a match.", "All items matched." if crosswalk is not None else "No crosswalk, skipped."),
    ]
    if stream == "channel_inventory":
        checks.append(_gate("Phantom inventory", phantom_runs(df, pos, phantom_weeks) if pos is not None and "on_hand_units" in df.columns else None, "{n} run(s) of stock without sell-out.", "No such run."))
    return Report(stream, list(checks))
