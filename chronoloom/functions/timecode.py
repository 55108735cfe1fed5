"""Frames and ticks in exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_PER_SECOND = 254_016_000_000


def frames(ms: Column, num: Column, den: Column) -> Column:
    """The nearest frame at num/den frames a second (halves up)."""
    return F.floor((ms * num + den * 500).cast("decimal(38,0)") / (den * 1000)).cast("bigint")


def ticks(frame: Column, num: Column, den: Column) -> Column:
    """Ticks of a frame, rounded down; a wide product, so in DECIMAL."""
    wide = frame.cast("decimal(20,0)") * F.lit(TICKS_PER_SECOND).cast("decimal(12,0)") * den.cast("decimal(4,0)")
    return F.floor(wide.cast("decimal(38,0)") / num.cast("decimal(8,0)")).cast("bigint")


def rate_of(fps: Column) -> tuple[Column, Column]:
    """Timebase and whether it's an NTSC rate (1000/1001 of the timebase)."""
    base = F.round(fps).cast("int")
    return base, F.abs(fps - base * 1000 / 1001) < F.abs(fps - base)
