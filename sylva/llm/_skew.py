"""Joins with a table that says how many rows hold each of its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of a table whose weights sum to N and that hold N / MOST rows or more are at most MOST: these are broadcast.
MOST = 50_000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, most: int | None = None) -> DataFrame:
    """rows joined with table on keys, whatever a key's share of rows.

    ``table`` has a row a key and, in ``weight``, the number of rows that hold the key.  Heavy keys are few by
    arithmetic and are broadcast; the rest, none of which holds more than a MOST-th of the rows, meet in a
    shuffled join.  ``most``: in place of MOST, for tables with wide rows.  Both sides should be written tables, as each is read twice.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    bound = max(2, -(-total // (most or MOST)))
    heavy, light = table.filter(F.col(weight) >= bound), table.filter(F.col(weight) < bound)
    met = rows.join(F.broadcast(heavy), keys)
    return met.unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))
