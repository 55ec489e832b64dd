"""Size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 20_000


def broadcast_if_small(table: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """The table as a broadcast side when it has at most ``limit`` rows, else the table itself.

    The check fetches at most ``limit`` + 1 rows; what was fetched becomes the broadcast side, so an aggregated table is
    not computed twice. Beyond the limit the join shuffles, and adaptive execution splits hot keys.
    """
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        return table
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))
