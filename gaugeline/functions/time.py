"""Durations between timestamps, for TIMESTAMP and TIMESTAMP_NTZ alike."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    gap = end - start
    return (
        F.extract(F.lit("DAY"), gap).cast("double") * 86400
        + F.extract(F.lit("HOUR"), gap).cast("double") * 3600
        + F.extract(F.lit("MINUTE"), gap).cast("double") * 60
        + F.extract(F.lit("SECOND"), gap).cast("double")
    )


def longer_than(start: Column, end: Column, seconds: Column) -> Column:
    """True when both timestamps exist and lie more than ``seconds`` apart."""
    limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.coalesce((end - start) > limit, F.lit(False))
