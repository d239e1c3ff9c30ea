import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from weekloom.sources.commits import CommitLog
from weekloom.sources.schemas import grain
from weekloom.sources.workspace import Workspace, latest_rows

START = dt.date(2023, 1, 2)
POS = "item_id string, region string, week date, units_sold double"
PLAN = "item_id string, region string, week date, plan_units double, plan_version_date date"


def week(n):
    return START + dt.timedelta(weeks=n)


def listed(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_two_writers_at_once(spark, tmp_path):
    logs = [CommitLog(spark, f"file://{tmp_path}/log", "who int, at timestamp") for _ in range(4)]
    now = dt.datetime(2024, 5, 6, 7, 8, 9, 123456, tzinfo=dt.timezone.utc)

    def write(k):
        return [logs[k].append({"who": k, "at": now - dt.timedelta(days=i)}) for i in range(12)]

    with ThreadPoolExecutor(4) as pool:
        taken = list(pool.map(write, range(4)))
    assert sorted(n for x in taken for n in x) == list(range(1, 49))
    assert all(x == sorted(x) for x in taken)
    rows = {r.ordinal: r.who for r in logs[0].read().collect()}
    assert rows == {n: k for k, x in enumerate(taken) for n in x}
    assert logs[1].latest()["ordinal"] == 48 and not logs[2].commit_at(48, {"who": 9, "at": now}) and logs[3].latest()["who"] == rows[48]
    assert logs[0].read().where(F.col("at") == F.lit(now)).count() == 4  # to the microsecond, whatever the order of clocks


@pytest.mark.parametrize("stream", ["pos", "demand_plan"])
def test_rebuilds_go_on_and_equal_a_whole_one(spark, tmp_path, stream):
    ws, rng, parts = Workspace(spark, f"file://{tmp_path}/ws"), random.Random(3), []
    schema = POS if stream == "pos" else PLAN
    assert ws.rebuild_canonical([stream]) == {} and ws.read_canonical(stream).isEmpty()
    for i in range(5):
        first = rng.randrange(0, 60)
        rows = [(rng.choice("AB"), rng.choice(["E", None]), rng.choice([week(first + rng.randrange(5)), None] if i == 2 else [week(first + rng.randrange(5))]), rng.choice([None, float(rng.randrange(50))])) for _ in range(25)]
        rows = rows if stream == "pos" else [(*r, week(rng.randrange(3))) for r in rows]
        df = spark.createDataFrame(rows, schema)
        ws.add_snapshot(stream, df, f"upload {i}")
        parts.append(df.withColumn("_ord", F.lit(i)))
        held = {b["bucket"]: b["version"] for b in (ws._canonical(stream).latest() or {"buckets": []})["buckets"]}
        n = ws.rebuild_canonical([stream])
        want = latest_rows(parts, grain(stream, df.columns))
        assert listed(ws.read_canonical(stream)) == listed(want) and n == {stream: want.count()}
        touched = {r.b for r in df.select(F.expr("cast(floor(datediff(week, date'1970-01-05') / 91) as int)").alias("b")).distinct().collect()}
        assert {b["bucket"]: b["version"] for b in ws._canonical(stream).latest()["buckets"] if b["bucket"] in held.keys() - touched - {-(2**31) + 1}}.items() <= held.items()
    assert ws.rebuild_canonical([stream]) == n  # nothing new: nothing written
    assert ws.rebuild_canonical([stream], full=True) == n and listed(ws.read_canonical(stream)) == listed(want)
    assert ws.vacuum_canonical() > 0 and listed(ws.read_canonical(stream)) == listed(want) and ws.vacuum_canonical() == 0


def test_rebuilds_at_once_lose_nothing(spark, tmp_path):
    ws = Workspace(spark, f"file://{tmp_path}/ws")

    def upload(k):
        own = Workspace(spark, f"file://{tmp_path}/ws")
        own.add_snapshot("pos", spark.createDataFrame([("A", "E", week(k), float(k)), ("B", "E", week(0), float(k))], POS), str(k))
        return own.rebuild_canonical(["pos"])["pos"]

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(upload, range(6)))
    rows = ws.read_canonical("pos").collect()
    last = ws.list_snapshots("pos").first()
    assert sorted(r.week for r in rows if r.item_id == "A") == [week(k) for k in range(6)]
    assert [r.units_sold for r in rows if r.item_id == "B"] == [float(last.source_name)]


def test_a_new_column_and_an_empty_upload(spark, tmp_path):
    ws = Workspace(spark, f"file://{tmp_path}/ws")
    ws.add_snapshot("channel_inventory", spark.createDataFrame([("A", "E", week(0), 5.0), ("A", "E", week(30), 6.0)], "item_id string, region string, week date, on_hand_units double"), "a")
    ws.rebuild_canonical()
    wider = "item_id string, region string, week date, on_hand_units double, in_transit_units double"
    ws.add_snapshot("channel_inventory", spark.createDataFrame([("A", "E", week(30), 7.0, 2.0)], wider), "b")
    ws.add_snapshot("channel_inventory", spark.createDataFrame([], wider), "nothing")
    assert ws.rebuild_canonical() == {"channel_inventory": 2}
    found = {r.week: (r.on_hand_units, r.in_transit_units) for r in ws.read_canonical("channel_inventory").collect()}
    assert found == {week(0): (5.0, None), week(30): (7.0, 2.0)}
