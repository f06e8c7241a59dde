"""Explicit parameters: operators never read the clock."""

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

AS_OF = datetime.datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def at(moment: datetime.datetime) -> Column:
    """A literal without time zone."""
    return F.expr(f"timestamp_ntz'{moment.isoformat(sep=' ')}'")
