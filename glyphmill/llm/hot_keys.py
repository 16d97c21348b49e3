"""Joins on keys of which some are in a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 10_000  # Rows of a key that one task takes in any case.
MOST = 50_000  # Keys broadcast at most.


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], uses: Column, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once; ``uses`` bounds the rows of a key, ``total`` all rows.

    Keys used by many rows are broadcast: at most ``MOST`` keys can be used by more than
    ``total / MOST`` rows. The others are shuffled, none of them being hot.
    """
    often = F.coalesce(uses >= max(HOT, -(-total // MOST)), F.lit(False))
    hot, rare = F.broadcast(table.filter(often)), table.filter(~often)
    near = rows.join(hot, keys)
    far = rows.join(F.broadcast(table.filter(often).select(*keys)), keys, "left_anti").join(rare.hint("merge"), keys)
    return near.unionByName(far.select(*near.columns))
