"""Noise schedules: the corruption rate at a timestep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions.hashing import col


def none(t, max_t: int, rate: float) -> Column:
    return F.lit(0.0)


def linear(t, max_t: int, rate: float) -> Column:
    return col(t) / F.lit(float(max_t))


def constant(t, max_t: int, rate: float) -> Column:
    return F.lit(float(rate))


SCHEDULES = {"none": none, "linear": linear, "constant": constant}
