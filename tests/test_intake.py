import builtins
import sys
import warnings

import pytest

from weekloom.plans.intake import Refused, accept
from weekloom.sources import uploads
from weekloom.sources.workspace import Workspace


def test_gate(spark, tmp_path):
    ws = Workspace(spark, f"file://{tmp_path}/ws")
    good = spark.createDataFrame([("A", "E", "2025-01-06", "1,200"), ("A", "E", None, "5")], "Item string, Region string, Week string, Qty string")
    mapping = uploads.suggest_mapping(good, "pos")
    assert mapping == {"item_id": "Item", "region": "Region", "week": "Week", "units_sold": "Qty"} and mapping.missing == []
    sid, warned = accept(ws, "pos", good, mapping, "good.csv", unit_multiplier=2.0)
    assert ws.latest_snapshot("pos") == sid and len(warned) == 1 and ws.rebuild_canonical() == {"pos": 1}
    assert ws.read_canonical("pos").first().units_sold == 2400.0
    for upload, given, said in ((good, mapping | {"week": None}, "'week'"), (good.where("Week is null"), mapping, "No row"), (good.limit(0), mapping, "No row")):
        with pytest.raises(Refused, match=said):
            accept(ws, "pos", upload, given, "bad.csv")
    assert ws.list_snapshots("pos").count() == 1  # a refused upload leaves nothing
    assert accept(ws, "location_map", spark.createDataFrame([("1", "E")], "a string, b string"), {"source_location_id": "a", "region": "b"}, "map.csv") == (None, [])
    assert ws.read_reference("location_map").count() == 1


def test_scores_of_a_mapping(spark):
    df = spark.createDataFrame([("007", "12", "2025-01-06")], "units_sold string, sold string, other string")
    scores = {(r.field, r.source): r.score for r in uploads.mapping_scores(df, "pos").collect()}
    assert scores["units_sold", "sold"] == 2.5 and scores["units_sold", "units_sold"] == 4.5 and scores["week", "other"] == 1.0 and scores["item_id", "sold"] == 0.2 and scores["item_id", "other"] == 0.0


def test_other_queries_live_without_what_the_operators_need(monkeypatch):
    import __spark_entry__ as entry

    real = builtins.__import__

    def missing(name, *rest):
        if name == "public_tokenizers":
            raise ModuleNotFoundError(name)
        return real(name, *rest)

    for m in [m for m in sys.modules if m.startswith("weekloom.llm") or m in ("public_tokenizers", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", missing)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        left, sql = entry.queries(), entry.oracle_sql()
    assert "blend" in left and "pipeline" not in left and not any(n.startswith("op") and n[2].isdigit() for n in left) and "blend" in sql
    assert any("weekloom.llm.queries" in str(w.message) for w in said)


def test_days_before_months_by_what_a_column_shows(spark):
    df = spark.createDataFrame([("A", "E", "03/02/2025", "02/03/2025", "1"), ("A", "E", "17/02/2025", "02/17/2025", "2"), ("A", "E", None, " 2025-02-24 ", "3"), ("A", "E", "x", "17 Feb", "4")], "i string, r string, a string, b string, q string")
    found = {r.source: r.day_first for r in uploads.date_formats(df, ["a", "b", "q"]).collect()}
    assert found == {"a": True, "b": False, "q": False}
    cells = {(r.source, r.format): r.cells for r in uploads.date_formats(df, ["a", "b"]).collect()}
    assert cells["a", "d/M/yyyy"] == 2 and cells["a", "M/d/yyyy"] == 1 and cells["b", "M/d/yyyy"] == 2 and cells["b", "yyyy-MM-dd"] == 1
    for source, weeks in (("a", ["2025-02-03", "2025-02-17"]), ("b", ["2025-02-03", "2025-02-17", "2025-02-24"])):
        rows, warned = uploads.apply_mapping(df, "pos", {"item_id": "i", "region": "r", "week": source, "units_sold": "q"})
        assert sorted(str(r.week) for r in rows.collect()) == weeks and len(warned) == 1
    assert uploads.date_formats(df.limit(0), ["a"]).where("cells > 0 or day_first").isEmpty()
