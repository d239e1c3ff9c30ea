import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekloom.operators import alerts, backtest, forecast, ml, quality, repair, translate
from weekloom.plans import pipeline
from weekloom.sources import uploads
from weekloom.sources.schemas import RunConfig, grain
from weekloom.sources.workspace import Workspace, latest_rows

START = dt.date(2024, 1, 1)
KEYS = "item_id string, region string, week date"


def at(i):
    return START + dt.timedelta(weeks=i)


def frame(spark, cols, rows):
    plain = lambda v: float(v) if isinstance(v, np.floating) else v
    return spark.createDataFrame([(r[0], r[1], at(r[2]), *map(plain, r[3:])) for r in rows], f"{KEYS}, {cols}")


@pytest.fixture(scope="module")
def feeds(spark):
    rng = np.random.default_rng(7)
    pos, inv, ship, plan, promo = [], [], [], [], []
    for k, (item, region) in enumerate([("A", "East"), ("A", "West"), ("B", "East")]):
        base = 100 * (k + 1)
        y = base * (1 + 0.1 * np.sin(np.arange(60) / 8)) + rng.normal(0, 3, 60)
        for i in range(60):
            on_promo, out = i in (18, 19, 40, 41, 55), k == 1 and 28 <= i < 33
            sold = y[i] * (1.6 if on_promo else 1) * (0.1 if out else 1)
            pos.append((item, region, i, float(sold)))
            inv.append((item, region, i, float(5 if out else 4 * base + 10 * np.cos(i)), float(base)))
            ship.append((item, region, i, float(sold * 0.9 + rng.normal(0, 2))))
            plan += [(item, region, i, float(base), at(i) - dt.timedelta(weeks=6)), (item, region, i, 999.0, at(i) - dt.timedelta(weeks=1))]
            promo.append((item, region, i, float(on_promo)))
    return {
        "pos": frame(spark, "units_sold double", pos), "channel_inventory": frame(spark, "on_hand_units double, in_transit_units double", inv), "shipments": frame(spark, "units_shipped double", ship),
        "demand_plan": frame(spark, "plan_units double, plan_version_date date", plan), "promo": frame(spark, "promo_flag double", promo),
    }


@pytest.fixture(scope="module")
def repaired(feeds):
    return repair.repair(feeds["pos"], feeds["channel_inventory"], feeds["promo"]).persist()


CFG = RunConfig(as_of=at(59), backtest_weeks=6)


def point_path(y, steps):
    """The statistical point forecast in numpy."""
    n, s = len(y), pd.Series(y)
    mid = s.rolling(9, min_periods=1).median()
    off = (s - mid).abs().rolling(9, min_periods=1).median() * 1.4826 + 1e-9
    capped = np.minimum(y, mid + 3 * off).to_numpy()
    decay = (5 / 7) ** np.arange(n - 1, -1, -1.0)
    level = capped @ decay / decay.sum()
    trend = np.polyfit(np.arange(min(n, 10)), capped[-10:], 1)[0] if n >= 4 else 0.0
    factors = np.ones(52)
    if n >= 91:
        around = pd.Series(capped).rolling(52, center=True, min_periods=26).median().to_numpy()
        factors = np.array([np.median((capped / around)[p::52]) for p in range(52)]) / 2 + 0.5
    h = np.arange(1, steps + 1)
    return np.maximum(0.0, (0.75**h * y[-1] + (1 - 0.75**h) * (level + trend * np.cumsum(0.9**h))) * factors[(n - 1 + h) % 52])


def test_repair_finds_the_stockout_and_splits_promotions(repaired):
    rows = repaired.toPandas()
    hit = rows[rows.is_censored]
    assert set(zip(hit.region, hit.week, strict=True)) == {("West", at(i)) for i in range(28, 33)}
    assert (hit.units_unconstrained > 150).all()
    clean = rows[~rows.is_censored]
    assert np.allclose(rows.base_units + rows.promo_uplift, rows.units_unconstrained)
    assert np.allclose(clean.units_unconstrained, clean.units_sold)
    assert (rows.promo_uplift[rows.week.isin([at(18), at(40)])] > 20).all() and (rows.promo_uplift >= 0).all()


def test_repair_keeps_a_shift_and_damps_a_blip(spark):
    y = [100.0 + (i % 3) for i in range(40)]
    y[10], y[25:] = 900.0, [200.0 + (i % 3) for i in range(15)]
    got = repair.repair(frame(spark, "units_sold double", [("A", "E", i, v) for i, v in enumerate(y)])).orderBy("week").toPandas()
    assert got.units_unconstrained[10] < 110 and (got.units_unconstrained[27:] >= 200).all() and (got.promo_uplift == 0).all()


def test_statistical_forecast_equals_numpy(spark, repaired):
    origins = spark.createDataFrame([(at(30),), (at(59),)], "as_of date")
    got = forecast.statistical_forecast(repaired, origins, 8).toPandas()
    rows = repaired.toPandas().sort_values("week")
    for (item, region, o), g in got.groupby(["item_id", "region", "as_of"]):
        y = rows[(rows.item_id == item) & (rows.region == region) & (rows.week <= o)].units_unconstrained.to_numpy()
        g = g.sort_values("lag")
        assert np.allclose(g.p50, point_path(y, 8))
        assert (g.p10 <= g.p50).all() and (g.p50 <= g.p90).all() and (g.p10 >= 0).all()
    long = frame(spark, "units_unconstrained double", [("A", "E", i, 50 + 20 * np.sin(2 * np.pi * i / 52) + i % 5) for i in range(120)])
    y = [50 + 20 * np.sin(2 * np.pi * i / 52) + i % 5 for i in range(120)]
    got = forecast.statistical_forecast(long, spark.createDataFrame([(at(119),)], "as_of date"), 8).orderBy("lag").toPandas()
    assert np.allclose(got.p50, point_path(np.array(y), 8))


def test_short_series(spark):
    df = frame(spark, "units_unconstrained double", [("A", "E", 0, 5.0), ("B", "E", 0, 1.0), ("B", "E", 1, 3.0), ("C", "E", 0, None)])
    got = forecast.statistical_forecast(df, spark.createDataFrame([(at(5),)], "as_of date"), 2).orderBy("item_id", "lag").collect()
    assert [(r.item_id, r.p50) for r in got][:2] == [("A", 5.0), ("A", 5.0)] and {r.item_id for r in got} == {"A", "B"}


def test_blend_uses_the_vintage_known_at_the_origin(spark, feeds, repaired):
    ahead = frame(spark, "plan_units double, plan_version_date date", [("A", "East", 60 + i, 100.0, at(54 + i)) for i in range(8)] + [("A", "East", 60, 999.0, at(60))])
    got = pipeline.blended_forecast(repaired, ahead, CFG).where("item_id = 'A' and region = 'East'").orderBy("lag").collect()
    assert [r.plan_units for r in got] == [100.0] * 6 + [None] * 2 and [r.week for r in got] == [at(60 + i) for i in range(8)]
    assert all(abs(r.blended - (r.blend_weight_sensed * r.p50 + (1 - r.blend_weight_sensed) * (r.plan_units or r.p50))) < 1e-9 for r in got)


def test_forecast_ignores_the_future(spark, repaired):
    origins = spark.createDataFrame([(at(40),)], "as_of date")
    broken = repaired.withColumn("units_unconstrained", F.when(F.col("week") > at(40), 1e6).otherwise(F.col("units_unconstrained")))
    one, two = (forecast.statistical_forecast(x, origins, 4).orderBy("item_id", "region", "lag").collect() for x in (repaired, broken))
    assert one == two


def test_backtest_scores_and_guards(feeds, repaired):
    tidy = pipeline.tidy_scores(repaired, feeds["channel_inventory"], feeds["shipments"], feeds["demand_plan"], feeds["promo"], CFG).persist()
    assert {r.method for r in tidy.select("method").distinct().collect()} == {"naive", "statistical", "translated", "plan"}
    plan = tidy.where("method = 'plan'").toPandas()
    assert set(plan.lag) == {1, 2, 4} and set(plan[plan.lag == 1].pred) == {999.0} and 999.0 not in set(plan[plan.lag == 2].pred)
    by_lag = backtest.ordered_by_lag(backtest.fva_by_lag(tidy)).toPandas()
    naive = tidy.where("method = 'naive' and lag = 1").toPandas()
    want = (naive.actual - naive.pred).abs().sum() / naive.actual.abs().sum()
    assert abs(by_lag[(by_lag.lag == 1) & (by_lag.method == "naive")].wmape.iloc[0] - want) < 1e-12
    assert [r.step for r in backtest.fva_waterfall(tidy).collect()] == ["Seasonal naïve", "Statistical baseline", "Translated sell-in", "Demand plan (lag-adj.)"]
    assert backtest.exit_criteria(backtest.fva_by_lag(tidy)).count() == 3

    def cheat(panel, origins, horizon, value, axis):
        return panel.where(F.col("week") == F.col("as_of")).select("item_id", "region", "as_of", "week", F.col(value).alias("pred"))

    with pytest.raises(backtest.LeakageError):
        backtest.backtest(cheat, repaired, CFG)
    assert backtest.backtest(cheat, repaired, CFG, check=False).count() == 0


def test_projection_fold_equals_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for k in range(40):
        path, cad, lag = rng.gamma(3, 20, 8), int(rng.integers(1, 5)), int(rng.integers(0, 10))
        oh, it, wos, r = (float(x) for x in rng.uniform(0, 5, 4) * (50, 20, 1, 0.3))
        fit = [float(x) for x in rng.normal(0, 1, 3)] if k % 2 else None
        rows.append((k, [float(p) for p in path], oh, it, wos, cad, lag, r, fit))
        held, orders = oh, []
        for i, x in enumerate(path):
            position = held + it * (i == lag) - x
            need = (np.dot(fit, [1, x, position]) if fit else x + wos * x - position) + x * (cad - 1)
            orders.append(max(0.0, need) if i % cad == 0 else 0.0)
            held = max(0.0, position + r * x)
        want.append(orders)
    df = spark.createDataFrame(rows, "k int, path array<double>, seed_on_hand double, seed_in_transit double, target_wos double, order_cadence_weeks int, reaction_lag_weeks int, replenish double, response array<double>")
    for r in translate.projected_orders(df).collect():
        assert np.allclose([s.projected_order for s in r.steps], want[r.k]) and all(s.projected_on_hand >= 0 for s in r.steps)


def test_calibration(spark, feeds, repaired):
    rows = translate.joined(repaired, feeds["channel_inventory"], feeds["shipments"]).persist()
    fits = {(r.item_id, r.region): r for r in translate.calibrated(rows, CFG).collect()}
    for key, g in rows.toPandas().groupby(["item_id", "region"]):
        g, r = g.sort_values("week"), fits[key]
        sold, oh, shipped = (g[c].to_numpy(float) for c in ("units_unconstrained", "on_hand", "shipped"))
        assert r.n == 60 and list(r.tail) == list(sold[-3:]) and r.seed.on_hand == r.end.on_hand == oh[-1]
        lagged = np.column_stack([np.ones(57), *[sold[3 - k : 60 - k] for k in range(4)]])
        assert np.allclose(r.transfer, np.linalg.lstsq(lagged, shipped[3:], rcond=None)[0], atol=1e-5)
        position = oh[:-1] + g.in_transit.to_numpy(float)[1:] - sold[1:]
        beta = np.linalg.lstsq(np.column_stack([np.ones(59), sold[1:], position]), shipped[1:], rcond=None)[0]
        assert r.response is None if beta[1] <= 0 else np.allclose(r.response, beta, atol=1e-5)
        clean = ~g.is_censored.to_numpy(bool) & (sold > 0)
        assert abs(r.target_wos - np.clip(np.median(oh[clean] / sold.mean()), 1, 12)) < 1e-9
        assert abs(r.replenish - np.clip(np.median((np.diff(oh) + sold[1:]) / sold[1:]), 0, 1.5)) < 1e-9
        best = max((np.corrcoef(sold[: 60 - k], shipped[k:])[0, 1], -k) for k in range(5))
        assert r.reaction_lag_weeks == -best[1] and r.order_cadence_weeks == 1
    flat = rows.withColumn("on_hand", F.lit(1500.0))
    assert not any(r.usable for r in translate.calibrated(flat, CFG).collect())
    gaps = rows.withColumn("shipped", F.when(F.weekofyear("week") % 3 == 0, F.col("shipped")))
    found = translate.calibrated(gaps, CFG).collect()
    assert all(r.transfer is None and r.order_cadence_weeks in (1, 3) and 0.5 < r.ratio < 2 for r in found)
    few = translate.calibrated(rows.where(F.col("week") < at(5)), CFG).collect()
    assert all((r.target_wos, r.replenish, r.reaction_lag_weeks, r.order_cadence_weeks, r.transfer, r.response) == (4.0, 1.0, 1, 1, None, None) for r in few)


def test_fits_of_an_origin_are_those_of_its_history(spark, feeds, repaired):
    rows = translate.joined(repaired, feeds["channel_inventory"], feeds["shipments"]).persist()
    ends = (3, 9, 20, 45)
    gaps = rows.withColumn("shipped", F.when(F.weekofyear("week") % 5 != 0, F.col("shipped"))).withColumn("on_hand", F.when(F.weekofyear("week") % 7 != 0, F.col("on_hand")))
    for given in (rows, gaps):
        asked = given.select("item_id", "region").distinct().crossJoin(spark.createDataFrame([(n + 1,) for n in ends], "at int"))
        many = translate.fitted(given, asked, CFG).drop("at").collect()
        for n in ends:
            one = translate.calibrated(given.where(F.col("week") <= at(n)), CFG).collect()
            assert sorted(str(r) for r in many if r.last_week == at(n)) == sorted(map(str, one)) and len(one) == 3


def test_sell_in_takes_the_method_that_missed_by_less(spark, feeds, repaired):
    rows = translate.joined(repaired, feeds["channel_inventory"], feeds["shipments"]).persist()
    origins = spark.createDataFrame([(at(59),), (at(30),)], "as_of date")
    got = translate.sell_in_orders(rows, origins, 8, CFG).toPandas()
    assert len(got) == 3 * 2 * 8 and (got.pred >= 0).all() and set(got.chosen) <= {"projection", "transfer"}
    future = translate.sell_in_orders(rows.withColumn("shipped", F.when(F.col("week") > at(30), 1e6).otherwise(F.col("shipped"))), origins.where(F.col("as_of") == at(30)), 8, CFG).toPandas()
    order = ["item_id", "region", "lag"]
    assert np.allclose(future.sort_values(order).pred, got[got.as_of == at(30)].sort_values(order).pred)
    flat = rows.withColumn("on_hand", F.lit(1500.0))  # stock that tells nothing: transfer
    found = translate.sell_in_orders(flat, origins.where(F.col("as_of") == at(59)), 4, CFG).toPandas()
    fits = {(r.item_id, r.region): r for r in translate.calibrated(flat, CFG).collect()}
    for key, g in found.groupby(["item_id", "region"]):
        y = list(fits[key].tail) + list(point_path(repaired.where((F.col("item_id") == key[0]) & (F.col("region") == key[1])).orderBy("week").toPandas().units_unconstrained.to_numpy(), 4))
        t = fits[key].transfer
        want = [max(0.0, t[0] + sum(t[k + 1] * y[i + 3 - k] for k in range(4))) for i in range(4)]
        assert set(g.chosen) == {"transfer"} and np.allclose(g.sort_values("lag").pred, want)


def test_forecasters_see_no_future(spark, repaired):
    def peek(panel, origins, horizon, value, axis):
        after = panel.select("item_id", "region", F.col("week"), F.col(value).alias("pred"), "as_of").where("week > as_of")
        assert after.isEmpty()  # nothing to peek at
        last = panel.groupBy("item_id", "region", "as_of").agg(F.max_by(value, "week").alias("pred"))
        return last.select("*", F.date_add("as_of", 7).alias("week"))

    own = backtest.backtest(peek, repaired, CFG, lags=(1,))
    naive = backtest.backtest(backtest.naive, repaired, CFG, lags=(1,))
    assert sorted(map(str, own.drop("method").collect())) == sorted(map(str, naive.drop("method").collect()))
    ask = lambda week: spark.createDataFrame([("A", "East", at(10), week)], "item_id string, region string, as_of date, week date")
    assert backtest.value_at(repaired, ask(at(9))).first().units_unconstrained > 0 and backtest.value_at(repaired, ask(at(-9))).first().units_unconstrained is None
    with pytest.raises(backtest.LeakageError):
        backtest.value_at(repaired, ask(at(11)))


def test_alerts_fire_and_stay_silent(spark):
    rows = [("A", "E", i, i + 1, 140.0, 100.0) for i in range(4)] + [("B", "E", i, i + 1, 105.0, 100.0) for i in range(4)]
    got = alerts.deviation(frame(spark, "lag int, p50 double, plan_units double", rows), CFG).collect()
    assert [(r.item_id, r.severity, r.week) for r in got] == [("A", "high", at(0))] and "+40%" in got[0].message
    cols = "projected_on_hand double, target_position double, projected_order double"
    low = frame(spark, cols, [("A", "E", i, v, 400.0, 50.0) for i, v in enumerate([0.0, 5.0, 0.0, 0.0])] + [("B", "E", i, v, 400.0, 50.0) for i, v in enumerate([0.0, 300.0, 280.0, 260.0])])
    assert [(r.item_id, r.week) for r in alerts.stockout(low, CFG).collect()] == [("A", at(1))]
    cliff = frame(spark, cols, [("A", "E", i, v, 100.0, o) for i, (v, o) in enumerate([(200.0, 0.0), (190.0, 1.0), (180.0, 0.0)])] + [("B", "E", i, v, 100.0, 0.0) for i, v in enumerate([40.0, 30.0, 20.0])])
    assert [(r.item_id, r.message.count("200%")) for r in alerts.order_cliff(cliff).collect()] == [("A", 1)]
    cols = "units_sold double, promo_uplift double, base_units double, is_censored boolean"
    for last, n in ((20.0, 1), (82.0, 0)):
        df = frame(spark, cols, [("A", "E", i, 0.0, {3: 80.0, 6: 80.0, 9: last}.get(i, 0.0), 100.0, i in (5, 7, 8)) for i in range(10)])
        assert alerts.promo_variance(df).count() == n
        assert [(r.severity, r.week) for r in alerts.censoring(df).collect()] == [("high", at(8))]
    assert [r.s for r in spark.createDataFrame([("Projected retailer stockout",), ("Sensed-vs-plan deviation",), ("Signal repair / censoring",)], "alert_type string").select(alerts.driving_signal().alias("s")).collect()] == ["inventory", "forecast", "repaired"]


def test_gates(spark, feeds):
    pos = feeds["pos"]
    assert quality.run_qc("pos", pos, pos.select("item_id").distinct(), as_of=at(60)).worst == "pass"
    bad = pos.where(F.col("week") != at(20)).unionByName(frame(spark, "units_sold double", [("Z", "East", 5, -25.0), ("A", "East", 3, 1.0)]))
    report = {c.name: c for c in quality.run_qc("pos", bad, pos.select("item_id").distinct(), as_of=at(62)).checks}
    assert {n for n, c in report.items() if c.status == "warn"} == {"Freshness / SLA", "Date coverage", "Negative values", "Duplicate rows", "Coverage shift", "Crosswalk match"}
    assert [r.missing_week for r in report["Date coverage"].offenders.collect()] == [at(20)] and report["Duplicate rows"].offenders.count() == 2
    assert quality.freshness(bad, at(70)).status == "fail"
    shifts = report["Coverage shift"].offenders.collect()
    assert [(r.week, r.n_added, r.n_dropped, r.added, r.dropped) for r in sorted(shifts)] == [(at(5), 1, 0, "Z|East", "—"), (at(6), 0, 1, "—", "Z|East")] or len(shifts) == 1
    flags = feeds["promo"].withColumn("promo_flag", F.when(F.col("week") == at(1), 5.0).otherwise(F.col("promo_flag")))
    assert quality.out_of_range("promo", flags).count() == 3
    leak = feeds["demand_plan"].withColumn("plan_version_date", F.when(F.col("week") == at(1), F.col("week")).otherwise(F.col("plan_version_date")))
    assert {r.reason for r in quality.out_of_range("demand_plan", leak).collect()} == {"plan_version_date on/after target week (leakage)"}
    quiet = pos.withColumn("units_sold", F.when((F.col("region") == "West") & F.col("week").between(at(2), at(5)), 0.0).otherwise(F.col("units_sold")))
    assert [(r.region, r.run_weeks) for r in quality.phantom_runs(feeds["channel_inventory"], quiet).collect()] == [("West", 4)]
    refs = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", " ")], "source_item_id string, item_id string")
    assert sorted((r.source, r.problem) for r in quality.reference_problems("item_crosswalk", refs).collect()) == [("a", "duplicate source id"), ("b", "blank target")]


def test_latest_rows_and_grain(spark):
    assert grain("demand_plan", ["item_id", "region", "week", "plan_units", "plan_version_date"]) == ["item_id", "region", "week", "plan_version_date"]
    one = frame(spark, "units_sold double", [("A", "E", 0, 1.0), ("A", "E", 1, 2.0), ("A", "E", 1, 3.0)]).withColumn("_ord", F.lit(1))
    two = frame(spark, "units_sold double, extra string", [("A", "E", 0, 9.0, "x")]).withColumn("_ord", F.lit(2))
    assert sorted((r.week, r.units_sold) for r in latest_rows([one, two], ["item_id", "region", "week"]).collect()) == [(at(0), 9.0), (at(1), 3.0)]


def test_workspace_uploads_and_run(spark, feeds, tmp_path):
    ws = Workspace(spark, f"file://{tmp_path}/ws")
    assert ws.read_canonical("pos").count() == 0 and ws.latest_snapshot("pos") is None and ws.rebuild_canonical() == {}
    with pytest.raises(ValueError):
        pipeline.run_pipeline(ws, at(59), CFG)
    for name, df in feeds.items():
        ws.add_snapshot(name, df, f"{name}.csv")
    ws.add_snapshot("pos", feeds["pos"].where(F.col("week") == at(2)).withColumn("units_sold", F.lit(7.0)), "fix.csv")
    assert ws.rebuild_canonical()["pos"] == 180 and ws.rebuild_canonical()["demand_plan"] == 360
    assert {r.units_sold for r in ws.read_canonical("pos").where(F.col("week") == at(2)).collect()} == {7.0}
    assert ws.list_snapshots("pos").first().source_name == "fix.csv" and ws.snapshot_coverage("pos").first().rows == 183
    assert {r.stream: r.rows for r in ws.canonical_status().collect()}["promo"] == 180
    assert not ws.has_reference("item_crosswalk") and ws.read_reference("item_crosswalk") is None
    for items in (["A"], ["A", "B"]):
        ws.add_reference("item_crosswalk", spark.createDataFrame([(i, i) for i in items], "source_item_id string, item_id string"), "x")
    assert ws.read_reference("item_crosswalk").count() == 2
    ws.save_mapping("pos", "hdr:1", {"item_id": "sku"})
    ws.save_mapping("pos", "hdr:1", {"item_id": "Article"})
    assert ws.get_mapping("pos", "hdr:1") == {"item_id": "Article"} and ws.get_mapping("pos", "hdr:2") is None
    result = pipeline.run_pipeline(ws, at(59), CFG)
    assert ws.latest_run_id() == result.run_id and ws.run_manifest(result.run_id)["inputs"]["pos"] == 180
    saved = ws.read_run_output(result.run_id, "forecast")
    assert saved.count() == 24 and ws.read_run_output(result.run_id, "none").isEmpty() and ws.list_runs().count() == 1
    projection = ws.read_run_output(result.run_id, "inventory_projection")
    assert projection.count() == 24 and projection.where("projected_order < 0 or projected_on_hand < 0").count() == 0
    assert pipeline.ranked_series(saved, ws.read_run_output(result.run_id, "alerts")).count() == 3
    assert spark.read.option("header", True).csv(ws.write_template("promo")).columns == ["item_id", "region", "week", "promo_flag"]
    kinds = alerts.by_view(ws.read_run_output(result.run_id, "alerts"), severity_is="high").collect()
    assert all(r.severity == "high" for r in kinds)
    assert spark.read.option("header", True).csv(ws.export_csv(saved, "forecast")).count() == 24
    assert RunConfig.from_dict(CFG.to_dict()) == CFG


def test_messy_exports(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Article Nbr,Dist Region,Sales Week,POS Qty\n001,East,2025-01-08,"1,200"\n002,West,01/15/2025,640\n003,,01/15/2025,bad\n')
    df = uploads.read_upload(spark, str(tmp_path / "x.csv"))
    mapping = uploads.suggest_mapping(df, "pos")
    assert mapping == {"item_id": "Article Nbr", "region": "Dist Region", "week": "Sales Week", "units_sold": "POS Qty"} and mapping.missing == []
    out, warnings = uploads.apply_mapping(df, "pos", mapping, 12)
    assert [tuple(r) for r in out.orderBy("item_id").collect()] == [("001", "East", dt.date(2025, 1, 6), 14400.0), ("002", "West", dt.date(2025, 1, 13), 7680.0)] and warnings == ["1 rows lack a required field and were left out."]
    headed = lambda *names: spark.createDataFrame([("x",) * len(names)], list(names))
    assert uploads.source_signature(headed("A b", "c")) == uploads.source_signature(headed("C", "a-B")) == "hdr:" + hashlib.sha1(b"a_b|c").hexdigest()[:12] and uploads.clean_headers(["", "a", "a", "Unnamed: 3"]) == ["column_1", "a", "a_2", "column_4"]
    assert uploads.apply_mapping(df, "pos", mapping | {"week": None})[1][0] == "No column is mapped to 'week', which is required."
    blank = "".join("a,,2025-01-06,1\n" for _ in range(130))
    (tmp_path / "y.csv").write_text(f'sku,x,week,qty\n{blank}"b ""c"" ,\nd",2025-02-03,2025-01-06,"1,0"\n')
    odd = uploads.read_upload(spark, str(tmp_path / "y.csv"))
    assert odd.count() == 131 and 'b "c" ,\nd' in {r.sku for r in odd.collect()} and uploads.role(uploads.column_facts(odd)["x"]) == "date"
    wide = ["item_id", "region", "2025-01-06", "2025-01-13", "2025-01-20", "WM Week 2504"]
    assert uploads.is_wide(wide) and uploads.wide_ids(wide) == ["item_id", "region"] and not uploads.is_wide(wide[:4])
    long = uploads.unpivot_wide(spark.createDataFrame([("a", "E", 1, 2, 3, 4)], wide), ["item_id", "region"], "units_sold")
    assert long.count() == 4 and set(long.columns) == {"item_id", "region", "week", "units_sold"}


def test_global_model(spark, feeds, repaired):
    features = ml.origin_features(repaired, feeds["promo"], feeds["channel_inventory"])
    g = repaired.where("item_id = 'B'").orderBy("week").toPandas().units_unconstrained.to_numpy()
    row = features.where((F.col("item_id") == "B") & (F.col("at") == 58)).first()
    level = g[45:58].mean()
    assert np.allclose([row.level, row.r_last, row.r_mean4, row.r_std8, row.r_yoy], [level, g[57] / level, g[54:58].mean() / level, g[50:58].std() / level, g[6] / level])
    rows = ml.training_rows(features, feeds["promo"], 8)
    assert rows.count() == 3 * sum(min(8, 60 - c) for c in range(16, 60))
    override, won = ml.sellout_override(repaired, feeds["promo"], feeds["channel_inventory"], CFG)
    origins = spark.createDataFrame([(CFG.as_of,)], "as_of date")
    base = forecast.statistical_forecast(repaired, origins, 8)
    new = ml.overridden(base, override).toPandas()
    assert len(new) == 24 and (new.p10 <= new.p50).all() and (new.p50 <= new.p90).all()
    assert ml.champion_share(won, repaired).first().series == 3
    assert (override is None) == won.isEmpty() and pd.notna(new.p50).all()


def test_stream_of_files(spark, feeds, tmp_path):
    from weekloom.streaming.snapshots import ingest

    ws = Workspace(spark, f"file://{tmp_path}/ws")
    feeds["promo"].coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest(spark, f"{tmp_path}/in", "promo", ws, f"{tmp_path}/checkpoint").awaitTermination()
    assert ws.list_snapshots("promo").count() == 1 and ws.read_canonical("promo").count() == 180


def test_coverage_moves_and_gaps_equal_sets_of_series_by_week(spark):
    rng = np.random.default_rng(8)
    rows = [(f"I{i}", None if i == 3 else "E", at(n)) for i in range(6) for n in range(40) if n not in (7, 8, 30) and rng.random() < 0.7 for _ in range(1 + (n % 5 == 0))]
    df = spark.createDataFrame([*rows, ("I9", "E", None)], "item_id string, region string, week date")
    by_week = {}
    for i, r, w in rows:
        by_week.setdefault(w, set()).add((i, r))
    weeks = sorted(by_week)
    want = set()
    for before, week in zip(weeks, weeks[1:], strict=False):
        want |= {(week, *s, "added", len(by_week[before])) for s in by_week[week] - by_week[before]} | {(week, *s, "dropped", len(by_week[before])) for s in by_week[before] - by_week[week]}
    got = [tuple(r) for r in quality.coverage_moves(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    shifts = {r.week: r for r in quality.coverage_shifts(df, 0.5).collect()}
    flagged = {w for w in weeks[1:] if (many := [m for m in want if m[0] == w]) and len(many) / max(1, many[0][4]) >= 0.5}
    assert set(shifts) == flagged and flagged
    for w, r in shifts.items():
        assert (r.n_added, r.n_dropped) == tuple(sum(m[0] == w and m[3] == c for m in want) for c in ("added", "dropped"))
        assert r.added == (", ".join(sorted(f"{m[1]}|{m[2] or ''}" for m in want if m[0] == w and m[3] == "added")) or "—")
    gaps = {(r.item_id, r.region, r.missing_week) for r in quality.series_gaps(df.distinct()).collect()}
    own = {}
    for i, r, w in rows:
        own.setdefault((i, r), set()).add(w)
    assert gaps == {(*s, at(n)) for s, has in own.items() for n in range(40) if min(has) < at(n) < max(has) and at(n) not in has}
    assert quality.coverage_moves(df.limit(0)).isEmpty() and quality.series_gaps(df.limit(0)).isEmpty()
