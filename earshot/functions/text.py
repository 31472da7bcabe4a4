"""Labels and clocks (STR-02 .. STR-05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col


def role_label(role) -> Column:
    """STR-02: ``bank_agent`` -> ``Bank Agent``."""
    return F.initcap(F.replace(as_col(role), F.lit("_"), F.lit(" ")))


def clock(seconds) -> Column:
    """STR-03: elapsed seconds as MM:SS."""
    s = F.floor(as_col(seconds)).cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)))


def session_id() -> Column:
    """STR-05: random, so never part of a comparison."""
    return F.expr("uuid()")
