"""Fixed target schemas of the five weekly feeds and the two dimensions, and the run configuration."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass
from typing import NamedTuple

from pyspark.sql import types as T


class Field(NamedTuple):
    role: str  # id, date or numeric
    required: bool = True

    @property
    def type(self) -> T.DataType:
        return {"id": T.StringType(), "date": T.DateType(), "numeric": T.DoubleType()}[self.role]


_KEY = {"item_id": Field("id"), "region": Field("id"), "week": Field("date")}

STREAMS: dict[str, dict[str, Field]] = {
    "pos": _KEY | {"units_sold": Field("numeric")},
    "channel_inventory": _KEY | {"on_hand_units": Field("numeric"), "in_transit_units": Field("numeric", False)},
    "shipments": _KEY | {"units_shipped": Field("numeric")},
    "demand_plan": _KEY | {"plan_units": Field("numeric"), "plan_version_date": Field("date")},
    "promo": _KEY | {"promo_flag": Field("numeric")},
}
REFERENCES: dict[str, dict[str, Field]] = {
    "item_crosswalk": {"source_item_id": Field("id"), "item_id": Field("id"), "units_per_case": Field("numeric", False), "successor_item_id": Field("id", False)},
    "location_map": {"source_location_id": Field("id"), "region": Field("id")},
}
#: The measures that a file's unit multiplier applies to.
SCALED = frozenset({"units_sold", "units_shipped", "on_hand_units", "in_transit_units"})


def fields_of(name: str) -> dict[str, Field]:
    """Of a stream or a reference; KeyError if there is no such name."""
    return (STREAMS | REFERENCES)[name]


def struct_of(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, f.type) for c, f in fields_of(name).items()])


def grain(name: str, columns: list[str]) -> list[str]:
    """The id and date columns of a stream that are there: what a row is about."""
    return [c for c, f in fields_of(name).items() if f.role != "numeric" and c in columns]


@dataclass(frozen=True)
class RunConfig:
    as_of: dt.date
    horizon_weeks: int = 8
    target_wos: float = 4.0
    order_cadence_weeks: int = 1
    reaction_lag_weeks: int = 1
    ml_enabled: bool = False
    ml_quantiles: bool = False
    smoothing_enabled: bool = False
    deviation_threshold: float = 0.15
    backtest_weeks: int = 26

    def to_dict(self) -> dict:
        return asdict(self) | {"as_of": self.as_of.isoformat()}

    @classmethod
    def from_dict(cls, given: dict) -> RunConfig:
        as_of = given["as_of"]
        return cls(**given | {"as_of": dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of})
