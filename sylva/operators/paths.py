"""Root paths, and everything that is a sum over them.

``tip_paths`` explodes the path that the index stores with each tip, so its size is its output's;
path sums then are equi-joins and partial aggregates by (tree, edge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tip_paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, taxon, edge_id, length): every edge between a tip and the root; missing lengths count 0."""
    tips = nodes.filter("is_leaf").select("tree_id", F.col("name").alias("taxon"), F.arrays_zip("path", "path_len").alias("p"))
    return tips.select("tree_id", "taxon", F.explode("p").alias("e")).select("tree_id", "taxon", F.col("e.path").alias("edge_id"), F.col("e.path_len").alias("length"))


def tips(nodes: DataFrame) -> DataFrame:
    return nodes.filter("is_leaf").select("tree_id", F.col("name").alias("taxon"), "node_id", "tip_ord", "depth_len", "depth_edges", "path", "path_len")


def _shared(a: str, b: str, lengths: bool) -> Column:
    """Length, or number, of the edges that two paths have in common: paths agree up to where they part."""
    n = f"size(filter(zip_with({a}.path, {b}.path, (x, y) -> x = y), t -> t))"
    return F.expr(f"aggregate(slice({a}.path_len, 1, {n}), 0D, (s, x) -> s + x)" if lengths else f"CAST({n} AS DOUBLE)")


def pairs(nodes: DataFrame, edges: bool = False, self_pairs: bool = False) -> DataFrame:
    """(tree_id, x, y, shared, d) of tips x < y (or x <= y): shared path and distance, by lengths or by edges.

    Each pair's paths are compared in place, so that a pair costs one row of the join.
    """
    t = tips(nodes).select("tree_id", F.struct("taxon", "path", "path_len", F.col("depth_edges").cast("double").alias("edges"), "depth_len").alias("t"))
    a, b = t.withColumnRenamed("t", "a"), t.withColumnRenamed("t", "b")
    both = a.join(b, "tree_id").filter("a.taxon <= b.taxon" if self_pairs else "a.taxon < b.taxon").withColumn("shared", _shared("a", "b", not edges))
    depth = "edges" if edges else "depth_len"
    return both.select("tree_id", F.col("a.taxon").alias("x"), F.col("b.taxon").alias("y"), "shared", (F.col(f"a.{depth}") + F.col(f"b.{depth}") - 2 * F.col("shared")).alias("d"))


def patristic_distances(nodes: DataFrame, taxa: list[str] | None = None) -> DataFrame:
    """(tree_id, x, y, d) of tips x < y."""
    out = pairs(nodes).select("tree_id", "x", "y", "d")
    return out.filter(F.col("x").isin(taxa) & F.col("y").isin(taxa)) if taxa else out


def topological_distances(nodes: DataFrame) -> DataFrame:
    return pairs(nodes, edges=True).select("tree_id", "x", "y", "d")


def phylo_vcv(nodes: DataFrame) -> DataFrame:
    """(tree_id, x, y, v) of tips x <= y: shared path length, a tip's depth on the diagonal."""
    return pairs(nodes, self_pairs=True).select("tree_id", "x", "y", F.col("shared").alias("v"))


def total_branch_length(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree_id").agg(F.sum(F.coalesce("length", F.lit(0.0))).alias("total"))


def has_branch_lengths(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent_id is not null").groupBy("tree_id").agg(F.every(F.col("length").isNotNull()).alias("has_lengths"))


def traverse(nodes: DataFrame, order: str = "preorder") -> DataFrame:
    """The nodes with the place each has in the order."""
    keys = {"preorder": ["node_id"], "postorder": ["post"], "levelorder": ["depth_edges", "node_id"]}
    if order not in keys:
        raise ValueError(f"order {order!r} is not one of {sorted(keys)}")
    return nodes.orderBy("tree_id", *keys[order])


def search_nodes(nodes: DataFrame, **wanted) -> DataFrame:
    """Nodes whose attributes, or data entries, equal all the values given."""
    for key, value in wanted.items():
        column = F.col(key) if key in nodes.columns else F.col("data")[key]
        nodes = nodes.filter(column.eqNullSafe(F.lit(value if key in nodes.columns else str(value))))
    return nodes


def get_node(nodes: DataFrame, name: str) -> DataFrame:
    """The first node in preorder of that name, a row a tree."""
    return nodes.filter(F.col("name") == name).groupBy("tree_id").agg(F.min_by(F.struct(*nodes.columns), "node_id").alias("n")).select("n.*")


def get_mrca(nodes: DataFrame, names: list[str], strict: bool = True) -> DataFrame:
    """The deepest node over the tips named, a row a tree; with strict, names that a tree lacks are an error."""
    named = nodes.filter(F.col("is_leaf") & F.col("name").isin(names)).groupBy("tree_id").agg(F.min("tip_ord").alias("lo"), F.max("tip_ord").alias("hi"), F.count("*").alias("found"))
    if strict:
        named = named.filter(F.assert_true(F.col("found") == len(set(names)), F.lit("a name is not a tip of the tree")).isNull())
    over = nodes.join(named, "tree_id").filter("leaf_lo <= lo AND leaf_hi >= hi")
    return over.groupBy("tree_id").agg(F.max_by(F.struct(*nodes.columns), F.struct("depth_edges")).alias("n")).select("n.*")


def join_data(nodes: DataFrame, table: DataFrame, on: str = "name", order_by: str | None = None) -> DataFrame:
    """Put a table's columns into the data of the nodes of that name; keys are compared as text.

    Of rows with one key the last in ``order_by`` counts (without it: in the table's order)."""
    columns = [c for c in table.columns if c not in (on, order_by)]
    place = F.col(order_by) if order_by else F.monotonically_increasing_id()
    last = table.withColumn("_place", place).groupBy(F.col(on).cast("string").alias("_key")).agg(F.max_by(F.struct(*columns), "_place").alias("_row"))
    added = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"_row.`{c}`").cast("string") for c in columns]))
    joined = nodes.join(last, F.col(on if on in nodes.columns else f"data.{on}") == F.col("_key"), "left")
    kept = F.map_filter(F.coalesce("data", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(columns))
    return joined.withColumn("data", F.when(F.col("_key").isNull(), F.col("data")).otherwise(F.map_concat(kept, F.map_filter(added, lambda _, v: v.isNotNull())))).select(*nodes.columns)


def subtree_sums(nodes: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """(tree_id, *by, edge_id, length, total): values (*by, taxon, value) of tips summed over each edge's subtree."""
    return tip_paths(nodes).join(values, "taxon").groupBy("tree_id", *by, "edge_id", "length").agg(F.sum("value").alias("total"))
