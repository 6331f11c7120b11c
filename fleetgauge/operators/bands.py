"""Filter and label by usage band."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge.params import BANDS, Band


def in_band(value: Column, band: Band | None) -> Column:
    """``lower < value <= upper``; no band holds nothing."""
    if band is None:
        return F.lit(False)
    return (value > band.lower) & (value <= band.upper)


def band_label(value: Column, bands: Iterable[Band] = BANDS) -> Column:
    """Label of the band that holds ``value``, NULL outside all of them.

    The bands do not overlap, so one pass with a CASE replaces a range join.
    """
    return F.coalesce(*[F.when(in_band(value, band), band.label) for band in bands])
