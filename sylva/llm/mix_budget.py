"""Mixing sources to target weights by fitting each source's budget as a subset sum.

A source's documents are counted by exact length.  Whole rounds take every document; the rest of the
budget takes the same share of every length: counts are rounded by a systematic draw over the sorted
lengths with a seeded start, so that any stretch of lengths gets its share to within one document and
what is left of the budget is at most about the longest document.  Eight documents drawn by the seed are
given back, and a bounded knapsack over the documents not taken, in seeded order, fills what is left.
Which documents of a length are taken is decided by a seeded hash, so reruns agree.

Scale.  Lengths are counted with partial aggregation; each source's histogram (one row a distinct
length) is fitted in a task of its own, by a table of sums as wide as the source's longest document.
Sources are numbered, weighed and given their targets by aggregates of one row, however many there are.
Documents of a length are not ranked against each other: their hashes fall in ``cells`` equal ranges,
whole ranges are counted, and only the range in which the count is reached is ranked, which gives a
threshold; a document is then taken by comparing its own hash with it, so neither texts nor rows are
exchanged when the thresholds (a row a source and length) are few enough to be broadcast (``small``).
A length or a source that holds a third of all rows is nowhere gathered in one task.

Edge cases: null and empty texts have size 0 and are never taken; a null source is a source of its
own, last in order; rows are documents of their own whatever their doc_id: the hash runs over id, source
and text, and rows that share all three are counted, not ranked, so that just as many of them are taken
as the plan says (which of several that differ in other columns: by a hash of these); an empty table gives
an empty result; a source with only empty documents gets target 0; other columns, whatever their names,
stay out of the way.
"""

from __future__ import annotations

from itertools import cycle
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _store

WORDS = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> dict[str | None, float]:
    """Target words by source: percent of all words shared by weight, none above ``most`` times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = dict(zip(order, cycle(weights)))
    open_, left, out = list(order), sum(sizes.values()) * percent / 100, {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, most: int = 2, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """(rounds, extra): every document is taken ``rounds`` times, and extra[i] of length i once more."""
    order = np.argsort(lengths, kind="stable")
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    extra, whole = np.zeros(len(lengths), np.int64), int(lengths @ counts)
    rounds = min(most, int(target // whole)) if whole else 0
    goal = 0 if rounds >= most or not whole else int(round(target - rounds * whole))
    if goal > 0:
        rng = np.random.default_rng([seed, whole, goal])
        there = np.where(lengths > 0, counts, 0)
        upto = np.floor(np.concatenate(([0], np.cumsum(there))) * (goal / whole) + rng.random()).astype(np.int64)
        extra = np.minimum(np.diff(upto), there)
        while (over := int(lengths @ extra) - goal) > 0:  # at most about the longest document: give back one that covers it
            held = np.flatnonzero(extra)
            extra[held[min(np.searchsorted(lengths[held], over), len(held) - 1)]] -= 1
        for i in rng.permutation(np.flatnonzero(extra))[:8]:  # some freedom for the knapsack
            extra[i] -= 1
        extra += _knapsack(lengths, there - extra, goal - int(lengths @ extra), rng.permutation(len(lengths)))
    out = np.zeros(len(order), np.int64)
    out[order] = extra
    return np.int64(rounds), out


def _knapsack(lengths: np.ndarray, there: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """Bounded knapsack: how many of each length sum up to the most that is not above budget; lengths come in the order given."""
    taken = np.zeros(len(lengths), np.int64)
    parts = []  # (length index, how many): counts in binary pieces
    for i in order:
        n, piece = min(int(there[i]), budget // int(lengths[i])) if lengths[i] else 0, 1
        while n > 0:
            parts.append((i, min(piece, n)))
            n -= piece
            piece *= 2
    if not parts:
        return taken
    step = gcd(*(int(lengths[i]) for i, _ in parts))
    best = budget // step  # no sum can come nearer to the budget
    via = np.full(best + 1, -1, np.int32)  # the piece by which a sum was first reached, in units of step
    via[0] = -2
    for k, (i, n) in enumerate(parts):
        by = int(lengths[i]) // step * n
        if by <= best:
            new = (via[: best + 1 - by] != -1) & (via[by:] == -1)
            via[by:][new] = k
            if via[best] != -1:
                break
    at = int(np.flatnonzero(via != -1)[-1])
    while at > 0:
        i, n = parts[via[at]]
        taken[i] += n
        at -= int(lengths[i]) // step * n
    return taken


def _keyed(documents: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> dict:
    """Columns (doc_id, source, size, h) of a row of documents."""
    i, text, source = F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(source_col).cast("string")
    h = F.xxhash64(F.lit(seed), i, source, text)
    return {"doc_id": i, "source": source, "size": F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long"), "h": h}


def _sources(histogram: DataFrame, weights: tuple[int, ...], percent: int, most: int, path: str) -> DataFrame:
    """(source, source_size, target): as targets(), with one row of sums at a time on the driver."""
    spark = histogram.sparkSession
    words = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    words = _store.saved(words.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), f"{path}/words")
    before, offsets = 0, []
    for r in sorted(words.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row a partition
        offsets.append((r.part, before))
        before += r.n
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    kinds = F.array(*[F.lit(w) for w in weights])
    words = words.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part").withColumn("weight", F.element_at(kinds, (place % len(weights) + 1).cast("int")))
    words = _store.saved(words.select("source", "source_size", "weight"), f"{path}/weighed")
    total, whole, capped = words.agg(F.sum("source_size"), F.sum("weight")).first() + (0,)
    left = (total or 0) * percent / 100
    share = lambda: F.lit(float(left)) * F.col("weight") / F.lit(float(whole or 1))
    while True:  # shares only grow, so that a source once above its bound stays there
        over = share() > most * F.col("source_size")
        n, full, rest = words.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped:
            return words.select("source", "source_size", F.when(over, (most * F.col("source_size")).cast("double")).otherwise(share()).alias("target"))
        if rest is None:  # all are at their bound
            return words.select("source", "source_size", (most * F.col("source_size")).cast("double").alias("target"))
        left, whole, capped = (total or 0) * percent / 100 - most * full, rest, n


def _plan(documents: DataFrame, weights: tuple[int, ...], percent: int, most: int, seed: int, cells: int, path: str, **columns: str) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, thresholds): (doc_id, source, size, h) of every row, and for each source and length
    (source_size, target, rounds, t, more, same): rows with h < t are taken once more, and ``more`` of the ``same`` rows with h = t."""
    if cells & (cells - 1) or cells < 2:
        raise ValueError("cells must be a power of two")
    cell = F.shiftright("h", 64 - (cells.bit_length() - 1)).cast("int")
    rows = _store.saved(documents.select(*[c.alias(n) for n, c in _keyed(documents, seed, **columns).items()]), f"{path}/rows")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    celled = rows.withColumn("cell", cell)
    by_cell = _store.saved(celled.groupBy("source", "size", "cell").agg(F.count("*").alias("n")), f"{path}/cells")
    histogram = by_cell.groupBy("source", "size").agg(F.sum("n").alias("n"))
    known = _store.saved(_sources(histogram, weights, percent, most, path).withColumnRenamed("source", "_s"), f"{path}/known")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        rounds, extra = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), float(pdf["target"].iloc[0]), most, seed)
        return pd.DataFrame({"has_source": pdf["source"].notna(), "source": pdf["source"], "size": pdf["size"], "source_size": pdf["source_size"], "target": pdf["target"], "rounds": rounds, "extra": extra})

    plan = histogram.join(known, same("source", "_s")).drop("_s").groupBy("source").applyInPandas(fitted, "has_source boolean, source string, size long, source_size long, target double, rounds long, extra long")
    plan = _store.saved(plan.withColumn("_s", F.when(F.col("has_source"), F.col("source"))).drop("has_source", "source").withColumnRenamed("size", "_n"), f"{path}/plan")

    # the cell in which a count is reached, then the hash in it
    on = same("source", "_s") & (F.col("size") == F.col("_n"))
    some = plan.filter("extra > 0").select("_s", "_n", "extra")
    upto = by_cell.withColumn("before", F.sum("n").over(Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    cut = upto.join(some, on).filter("before < extra and extra <= before + n").select("_s", "_n", F.col("cell").alias("_c"), (F.col("extra") - F.col("before")).alias("of_cell"))
    tied = celled.join(cut, on & (F.col("cell") == F.col("_c"))).groupBy("_s", "_n", "of_cell", "h").agg(F.count("*").alias("same"))
    before = F.sum("same").over(Window.partitionBy("_s", "_n").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("same")
    at = tied.withColumn("before", before).filter("before < of_cell and of_cell <= before + same").select(F.col("_s").alias("_s2"), F.col("_n").alias("_n2"), F.col("h").alias("t"), (F.col("of_cell") - F.col("before")).alias("more"), "same")
    thresholds = plan.join(at, same("_s", "_s2") & (F.col("_n") == F.col("_n2")), "left").select("_s", "_n", "source_size", "target", F.when(F.col("_n") > 0, F.col("rounds")).otherwise(0).alias("rounds"), "t", "more", "same")
    return rows, _store.saved(thresholds, f"{path}/thresholds")


#: Times a row is taken, but for rows at a threshold that only some of them pass.
_COPIES = "CAST(rounds + CASE WHEN h < t OR (h = t AND more = same) THEN 1 ELSE 0 END AS INT)"
_SPLIT = "t IS NOT NULL AND h = t AND more < same"


def _side(thresholds: DataFrame, small: int) -> DataFrame:
    """Thresholds, broadcast if they are few: some 60 bytes a row."""
    return F.broadcast(thresholds) if thresholds.count() <= small else thresholds


def mix(documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 17, cells: int = 4096, small: int = 400_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), a row for each row of documents."""
    return _mix(documents, weights, percent, most, seed, cells, small, id_col=id_col, text_col=text_col, source_col=source_col).drop("source")


def _mix(documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 17, cells: int = 4096, small: int = 400_000, **columns: str) -> DataFrame:
    """mix with the source."""
    path = _store.work_dir(documents.sparkSession, "mix")
    columns = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | columns
    rows, thresholds = _plan(documents, weights, percent, most, seed, cells, path, **columns)
    placed = rows.join(_side(thresholds, small), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")))
    out = ["doc_id", "source", "size", "source_size", "target"]
    sure = placed.filter(f"NOT ({_SPLIT})").select(*out, F.expr(_COPIES).alias("copies"))
    # rows alike in id, source and text of which only some are taken once more: counted, then written out again
    alike = placed.filter(_SPLIT).groupBy(*out, "rounds", "more").agg(F.count("*").alias("n"))
    alike = alike.select(*out, "rounds", "more", F.expr("explode(sequence(1L, n))").alias("k")).select(*out, F.expr("CAST(rounds + CASE WHEN k <= more THEN 1 ELSE 0 END AS INT)").alias("copies"))
    return sure.union(alike).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 17, cells: int = 4096, small: int = 400_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: documents with all their columns, each as often as it is taken."""
    path = _store.work_dir(documents.sparkSession, "mixed")
    columns = {"id_col": id_col, "text_col": text_col, "source_col": source_col}
    _, thresholds = _plan(documents, weights, percent, most, seed, cells, path, **columns)
    names = documents.columns
    key = _keyed(documents, seed, **columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")
    rows = documents.select(whole, key["source"].alias("source"), key["size"].alias("size"), key["h"].alias("h"))
    placed = rows.join(_side(thresholds, small), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")))
    sure = placed.filter(f"NOT ({_SPLIT})").select("doc", F.expr(_COPIES).alias("copies"))
    out = [sure.filter("copies > 0").select("doc", F.expr("explode(sequence(1, copies))")).select("doc")]
    if not thresholds.filter("more < same").isEmpty():
        alike = placed.filter(_SPLIT).groupBy("doc", "rounds", "more", "h").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("h").orderBy(F.xxhash64(F.to_json("doc")), F.to_json("doc")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        times = alike.withColumn("before", before).select("doc", F.expr("n * rounds + greatest(least(more - before, n), 0L)").alias("copies"))
        out.append(times.filter("copies > 0").select("doc", F.expr("explode(sequence(1L, copies))")).select("doc"))
    return (out[0] if len(out) == 1 else out[0].union(out[1])).select(*[F.col(f"doc.`{c}`") for c in names])
