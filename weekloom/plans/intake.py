"""From an upload to a snapshot: what a file must have before it is accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weekloom.functions.scalars import WeekCalendar
from weekloom.sources.schemas import REFERENCES
from weekloom.sources.uploads import Mapping, apply_mapping
from weekloom.sources.workspace import Workspace


class Refused(ValueError):
    """An upload that can't be accepted, with its reasons."""

    def __init__(self, name: str, reasons: list[str]):
        super().__init__(f"{name}: {' '.join(reasons)}")
        self.reasons = reasons


def refusals(name: str, canonical: DataFrame, mapping: dict[str, str | None]) -> list[str]:
    """Why the canonical rows of a stream or reference can't be taken: a required field without a column, or no whole row. Empty if they can."""
    reasons = [f"No column is mapped to '{c}', which is required." for c in Mapping(name, mapping).missing]
    if not reasons and canonical.isEmpty():
        reasons = ["No row has all required fields."]
    return reasons


def accept(workspace: Workspace, name: str, upload: DataFrame, mapping: dict[str, str | None], source_name: str, unit_multiplier: float = 1.0, calendar: WeekCalendar = WeekCalendar()) -> tuple[str | None, list[str]]:
    """Maps an upload and writes it as a snapshot of its stream, or as the reference it is; raises Refused, and writes nothing, if the gate is closed.

    Gives the snapshot's id (None for a reference) and the warnings of the mapping. Quality checks warn, they don't refuse."""
    canonical, warnings = apply_mapping(upload, name, mapping, unit_multiplier, calendar)
    if reasons := refusals(name, canonical, mapping):
        raise Refused(name, reasons)
    if name in REFERENCES:
        workspace.add_reference(name, canonical, source_name)
        return None, warnings
    return workspace.add_snapshot(name, canonical, source_name), warnings
