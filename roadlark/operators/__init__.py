"""DataFrame operators. Event time is a numeric column of seconds (``t`` by default); ``seconds`` makes one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, with fractions, of a timestamp."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6
