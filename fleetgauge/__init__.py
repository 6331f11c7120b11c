"""Disk capacity reporting over fleet monitoring telemetry, on Spark DataFrames."""

from fleetgauge.params import (
    BANDS,
    CRITICAL,
    SCOPES,
    TBN,
    UNPRIORITIZED,
    Band,
    ScopePolicy,
    TimeWindow,
    resolve_band,
    resolve_window,
)
from fleetgauge.operators.settle import release_dropped
from fleetgauge.plans.report import all_band_rows, all_bands_report, band_rows, disk_report
from fleetgauge.plans.stages import Stages
from fleetgauge.sources.tables import Telemetry, read_telemetry, write_telemetry

__all__ = [
    "BANDS",
    "CRITICAL",
    "SCOPES",
    "TBN",
    "UNPRIORITIZED",
    "Band",
    "ScopePolicy",
    "Stages",
    "Telemetry",
    "TimeWindow",
    "all_band_rows",
    "all_bands_report",
    "band_rows",
    "disk_report",
    "read_telemetry",
    "release_dropped",
    "resolve_band",
    "resolve_window",
    "write_telemetry",
]
