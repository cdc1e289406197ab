"""Join sides whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydromelt import config as C


def checked_broadcast(df: DataFrame, max_rows: int = C.BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is proven to have at most ``max_rows`` rows.

    The proof reads no more than ``max_rows`` + 1 rows. A larger side stays
    unmarked: the join then shuffles, and adaptive execution splits skewed keys.
    """
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df
