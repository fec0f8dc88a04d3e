"""Seeded permutations and resampling by hashes: the same on every engine and every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def permuted(items: DataFrame, n: int, seed: int = 0, item: str = "item") -> DataFrame:
    """(perm_id 1..n, item, other): in each permutation items in order of name go to items in order of a hash.

    Permutations are independent partitions of the windows, so they spread over the cluster.
    """
    spread = items.select(F.col(item).cast("string").alias("item")).withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    said = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm_id").cast("string"), F.col("item")).cast("binary"))
    by = lambda c: F.row_number().over(Window.partitionBy("perm_id").orderBy(c, "item"))
    placed = spread.withColumn("said", said).withColumns({"from": by("item"), "to": by("said")})
    a = placed.select("perm_id", F.col("from").alias("k"), "item")
    b = placed.select("perm_id", F.col("to").alias("k"), F.col("item").alias("other"))
    return a.join(b, ["perm_id", "k"]).select("perm_id", "item", "other")


def drawn(replicate: Column, place: Column, n: Column | int, seed: int = 0) -> Column:
    """A column in 0..n-1 for a replicate's place: bootstrap draws with replacement."""
    said = F.md5(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), place.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(said, 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n)).cast("int")
