"""Comparing trees: splits, Robinson-Foulds, crossings, displaced and rogue taxa, gene trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .paths import topological_distances


def splits(nodes: DataFrame, trivial: bool = False) -> DataFrame:
    """(tree_id, node_id, split_key, side, size, length, support): the tips on the side of each edge
    without the tree's alphabetically first tip; equal sides of the two root edges both appear."""
    tips = nodes.filter("is_leaf").select("tree_id", "tip_ord", "name")
    all_tips = tips.groupBy("tree_id").agg(F.array_sort(F.collect_list("name")).alias("names"), F.transform(F.array_sort(F.collect_list(F.struct("tip_ord", "name"))), lambda x: x["name"]).alias("ordered"))
    below = F.expr("array_sort(slice(ordered, leaf_lo + 1, leaf_hi - leaf_lo + 1))")
    x = nodes.filter("parent_id is not null").join(all_tips, "tree_id").withColumn("below", below)
    side = F.when(F.array_contains("below", F.col("names")[0]), F.array_except("names", "below")).otherwise(F.col("below"))
    x = x.withColumns({"side": side, "n": F.size("names")}).withColumn("size", F.size("side"))
    if not trivial:
        x = x.filter("size >= 2 AND size <= n - 2")
    return x.select("tree_id", "node_id", F.md5(F.array_join("side", "|").cast("binary")).alias("split_key"), "side", "size", "length", "support", "n")


def robinson_foulds(nodes: DataFrame, normalized: bool = False) -> DataFrame:
    """(a, b, rf) of trees a < b over one set of taxa; normalised by 2 (n - 3), 0 below four taxa."""
    own = splits(nodes).select("tree_id", "split_key").distinct()
    trees = nodes.filter("is_leaf").groupBy("tree_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("name")), "|").cast("binary")).alias("taxa"))
    count = trees.join(own.groupBy("tree_id").agg(F.count("*").alias("c")), "tree_id", "left").na.fill(0, ["c"])
    a, b = (count.select(F.col("tree_id").alias(x), F.col("c").alias(f"c{x}"), "n" if x == "a" else F.col("n").alias("nb"), F.col("taxa").alias(f"t{x}")) for x in "ab")
    pair = a.join(b, F.col("a") < F.col("b"))
    pair = pair.filter(F.assert_true(F.col("ta") == F.col("tb"), F.lit("trees to compare have the same taxa")).isNull())
    common = own.withColumnRenamed("tree_id", "a").join(own.withColumnRenamed("tree_id", "b"), "split_key").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    rf = F.col("ca") + F.col("cb") - 2 * F.coalesce("both", F.lit(0))
    value = F.when(F.col("n") < 4, F.lit(0.0)).otherwise(rf / (2.0 * (F.col("n") - 3))) if normalized else rf.cast("long")
    return pair.join(common, ["a", "b"], "left").select("a", "b", value.alias("rf"))


def split_frequencies(nodes: DataFrame) -> DataFrame:
    """(split_key, side, size, n_trees, frequency) over a sample of trees; a split counts once a tree."""
    n = nodes.select("tree_id").distinct().agg(F.count("*").alias("n"))
    return splits(nodes).groupBy("split_key").agg(F.first("side").alias("side"), F.first("size").alias("size"), F.count_distinct("tree_id").alias("n_trees")).crossJoin(F.broadcast(n)).select("split_key", "side", "size", "n_trees", (F.col("n_trees") / F.col("n")).alias("frequency"))


def conflicting_splits(found: DataFrame) -> DataFrame:
    """(a, b) of split keys a < b that no tree holds together: all four intersections have taxa.

    found: (split_key, side, n) with sides that never hold the first taxon, so the fourth always has."""
    a, b = (found.select(F.col("split_key").alias(x), F.col("side").alias(f"s{x}")) for x in "ab")
    shared = F.size(F.array_intersect("sa", "sb"))
    return a.join(b, F.col("a") < F.col("b")).filter((shared > 0) & (shared < F.size("sa")) & (shared < F.size("sb"))).select("a", "b")


def _orders(nodes: DataFrame, a: str, b: str) -> DataFrame:
    one = lambda t, c: nodes.filter((F.col("tree_id") == t) & F.col("is_leaf")).select("name", F.col("tip_ord").alias(c))
    return one(a, "l").join(one(b, "r"), "name")


def discordant(nodes: DataFrame, a: str, b: str) -> DataFrame:
    """(name, crossings): the links of tips shared by two trees, and how many others each crosses."""
    x = _orders(nodes, a, b)
    y = x.select(F.col("name").alias("other"), F.col("l").alias("l2"), F.col("r").alias("r2"))
    crossed = x.join(y, ((F.col("l") < F.col("l2")) & (F.col("r") > F.col("r2"))) | ((F.col("l") > F.col("l2")) & (F.col("r") < F.col("r2")))).groupBy("name").agg(F.count("*").alias("crossings"))
    return x.select("name").join(crossed, "name", "left").na.fill(0, ["crossings"])


def crossing_number(nodes: DataFrame, a: str, b: str) -> DataFrame:
    """One row (crossings): pairs of shared tips in opposite orders."""
    return discordant(nodes, a, b).agg(F.coalesce((F.sum("crossings") / 2).cast("long"), F.lit(0).cast("long")).alias("crossings"))


def nearest(distances: DataFrame, k: int) -> DataFrame:
    """(tree_id, x, y): the k nearest of each tip, with all that tie for the last place."""
    both = distances.select("tree_id", "x", "y", "d").union(distances.select("tree_id", F.col("y"), F.col("x"), "d"))
    return both.withColumn("k", F.rank().over(Window.partitionBy("tree_id", "x").orderBy("d"))).filter(F.col("k") <= k).select("tree_id", "x", "y")


def _shared_only(nodes: DataFrame, distances: DataFrame) -> DataFrame:
    """Distances among the tips that all the trees have."""
    n = nodes.select("tree_id").distinct().count()
    common = nodes.filter("is_leaf").groupBy("name").agg(F.count_distinct("tree_id").alias("c")).filter(F.col("c") == n).select("name")
    return distances.join(common.withColumnRenamed("name", "x"), "x", "left_semi").join(common.withColumnRenamed("name", "y"), "y", "left_semi")


def taxon_displacement(nodes: DataFrame, k: int = 3, distances: DataFrame | None = None) -> DataFrame:
    """(a, b, taxon, displacement) of trees a < b: 1 - Jaccard of the taxon's k nearest tips in both."""
    near = nearest(_shared_only(nodes, distances if distances is not None else topological_distances(nodes)), k)
    size = near.groupBy("tree_id", "x").agg(F.count("*").alias("c"))
    a, b = (size.select(F.col("tree_id").alias(t), F.col("x").alias("taxon"), F.col("c").alias(f"c{t}")) for t in "ab")
    both = near.select(F.col("tree_id").alias("a"), "x", "y").join(near.select(F.col("tree_id").alias("b"), "x", "y"), ["x", "y"]).filter("a < b").groupBy("a", "b", F.col("x").alias("taxon")).agg(F.count("*").alias("both"))
    pair = a.join(b, "taxon").filter("a < b").join(both, ["a", "b", "taxon"], "left").na.fill(0, ["both"])
    return pair.select("a", "b", "taxon", (1 - F.col("both") / (F.col("ca") + F.col("cb") - F.col("both"))).alias("displacement"))


def rogue_taxon(nodes: DataFrame) -> DataFrame:
    """(a, b, rf, taxon, rf_without, explained): for trees a < b, the taxon whose removal leaves the least
    normalised Robinson-Foulds distance, ties by name; explained: the part of rf that goes with it."""
    own = splits(nodes, trivial=True)
    names = nodes.filter("is_leaf").groupBy("tree_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    trees = names.select("tree_id", "names", F.explode(F.array_union(F.array(F.lit(None).cast("string")), "names")).alias("without"))
    x = own.select("tree_id", "side").join(trees, "tree_id").withColumn("rest", F.expr("filter(names, x -> without IS NULL OR x <> without)"))
    x = x.withColumn("s", F.expr("filter(side, x -> without IS NULL OR x <> without)"))
    x = x.withColumn("s", F.when(F.array_contains("s", F.col("rest")[0]), F.array_except("rest", "s")).otherwise(F.col("s"))).filter("size(s) >= 2 AND size(s) <= size(rest) - 2")
    keyed = x.select("tree_id", "without", F.array_join("s", "|").alias("k")).distinct()
    count = trees.select("tree_id", "without", (F.size("names") - F.when(F.col("without").isNull(), 0).otherwise(1)).alias("n")).join(keyed.groupBy("tree_id", F.col("without").alias("w")).agg(F.count("*").alias("c")).withColumnRenamed("tree_id", "t"), (F.col("tree_id") == F.col("t")) & F.col("without").eqNullSafe(F.col("w")), "left").select("tree_id", F.coalesce("without", F.lit("")).alias("without"), "n", F.coalesce("c", F.lit(0)).alias("c"))
    keyed = keyed.select("tree_id", F.coalesce("without", F.lit("")).alias("without"), "k")
    both = keyed.withColumnRenamed("tree_id", "a").join(keyed.withColumnRenamed("tree_id", "b"), ["without", "k"]).filter("a < b").groupBy("a", "b", "without").agg(F.count("*").alias("both"))
    a, b = count.select(F.col("tree_id").alias("a"), "without", "n", F.col("c").alias("ca")), count.select(F.col("tree_id").alias("b"), "without", F.col("c").alias("cb"))
    rf = a.join(b, "without").filter("a < b").join(both, ["a", "b", "without"], "left").select("a", "b", "without", F.when(F.col("n") < 4, 0.0).otherwise((F.col("ca") + F.col("cb") - 2 * F.coalesce("both", F.lit(0))) / (2.0 * (F.col("n") - 3))).alias("rf"))
    whole = rf.filter("without = ''").select("a", "b", F.col("rf"))
    best = rf.filter("without <> ''").groupBy("a", "b").agg(F.min(F.struct(F.col("rf"), F.col("without"))).alias("m")).select("a", "b", F.col("m.without").alias("taxon"), F.col("m.rf").alias("rf_without"))
    return whole.join(best, ["a", "b"]).select("a", "b", "rf", "taxon", "rf_without", F.when(F.col("rf") > 0, (F.col("rf") - F.col("rf_without")) / F.col("rf")).otherwise(0.0).alias("explained"))


def compare_domain_trees(nodes: DataFrame, k: int = 3) -> DataFrame:
    """A row for each pair of trees: rf, displacement (mean, max) and the rogue taxon."""
    moved = taxon_displacement(nodes, k).groupBy("a", "b").agg(F.avg("displacement").alias("mean_displacement"), F.max("displacement").alias("max_displacement"), F.count("*").alias("n_shared"))
    return rogue_taxon(nodes).join(moved, ["a", "b"])


def gene_tree_conflict(nodes: DataFrame, reference: str, k: int = 3) -> DataFrame:
    """(gene, rf, taxon, explained, mean_displacement, max_displacement, n_shared) of each tree against the reference."""
    x = compare_domain_trees(nodes, k).filter((F.col("a") == reference) | (F.col("b") == reference))
    return x.withColumn("gene", F.when(F.col("a") == reference, F.col("b")).otherwise(F.col("a"))).select("gene", "rf", "taxon", "explained", "mean_displacement", "max_displacement", "n_shared").orderBy(F.desc("explained"), F.desc("rf"), "gene")


def astrid_distances(nodes: DataFrame) -> DataFrame:
    """(x, y, d, n_trees): mean number of edges between two taxa over the trees that hold both."""
    return topological_distances(nodes).groupBy("x", "y").agg(F.avg("d").alias("d"), F.count("*").alias("n_trees"))
