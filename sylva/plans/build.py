"""From sequences to trees: align, trim, infer, root, support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import building as B
from ..operators import likelihood as ML
from ..operators.phylo import NODES, edit, frame, tree
from ..operators.rooting import midpoint_root, outgroup_root

ALIGNERS, METHODS, ROOTS = ("builtin", "none"), ("nj", "upgma", "wpgma", "parsimony", "lineage", "ml"), ("none", "midpoint", "outgroup")


def build_tree(records: DataFrame, aligner: str = "builtin", method: str = "nj", dist_model: str = "jc69", trim: dict | None = None, root: str = "none", outgroup: list[str] | None = None, bootstrap: int = 0, ml_model: str = "HKY85", gamma: int = 0, search: bool = True, constraint: dict[str, str | None] | None = None, seed: int = 0) -> DataFrame:
    """Node tables of a tree for each aln_id of (aln_id, row_ord, name, seq); options are checked before anything runs."""
    for value, known, what in ((aligner, ALIGNERS, "aligner"), (method, METHODS, "method"), (root, ROOTS, "root")):
        if value not in known:
            raise ValueError(f"{what} {value!r} is not one of {known}")
    if root == "outgroup" and not outgroup:
        raise ValueError("outgroup rooting needs an outgroup")
    if bootstrap and method not in ("nj", "upgma", "wpgma"):
        raise ValueError("bootstrap is for distance methods")
    if constraint and method != "nj":
        raise ValueError("a constraint is for nj")
    aln = B.align_all(records) if aligner == "builtin" else A.validate(records)
    if trim is not None:
        aln = A.trim(aln, **trim)
    if method in B.BUILDERS and constraint:
        groups = dict(constraint)

        def constrained(pdf):
            names, d = B.square(pdf)
            return frame([(pdf["aln_id"].iloc[0], B.constrained_nj(names, d, groups))])

        nodes = A.distance_matrix(aln, dist_model).groupBy("aln_id").applyInPandas(constrained, NODES)
    elif method in B.BUILDERS:
        nodes = B.trees_from_distances(A.distance_matrix(aln, dist_model), method=method)
    elif method == "parsimony":
        nodes = B.parsimony_trees(aln, search)
    elif method == "lineage":
        nodes = B.lineage_trees(aln, search)
    else:
        nodes = ML.ml_trees(aln, ml_model, search, gamma)
    if bootstrap:
        support = B.bootstrap_support(aln, bootstrap, method, dist_model, seed).groupBy(F.col("aln_id").alias("tree_id")).agg(F.map_from_entries(F.collect_list(F.struct("side", "support_percent"))).alias("s"))

        def supported(left, right):
            own = tree(left)
            if len(right):
                B.clade_support(own, {frozenset(k.split("|")): v for k, v in dict(right["s"].iloc[0]).items()})
            return frame([(left["tree_id"].iloc[0], own)])

        nodes = nodes.groupBy("tree_id").cogroup(support.groupBy("tree_id")).applyInPandas(supported, NODES)
    if root == "midpoint":
        nodes = edit(nodes, midpoint_root)
    elif root == "outgroup":
        nodes = edit(nodes, lambda t: outgroup_root(t, outgroup))
    return nodes


def domain_trees(aln: DataFrame, ranges: DataFrame, reference: str | None = None, min_residues: int = 1, **options) -> tuple[DataFrame, DataFrame]:
    """(node tables of a tree a domain, (domain, name) of the rows left out)."""
    bounds = A.residue_columns(aln, reference, ranges) if reference else ranges
    kept, dropped = A.drop_empty_rows(A.split_domains(aln, bounds), min_residues)
    return build_tree(kept.select(F.col("domain").alias("aln_id"), "row_ord", "name", "seq"), aligner="none", **options), dropped


def species_tree(markers: DataFrame, min_occupancy: float = 0.0, **options) -> DataFrame:
    """A tree of the supermatrix of the taxa that enough markers hold."""
    from pyspark.sql.window import Window

    whole = A.concatenate(markers).filter(F.col("occupancy") >= min_occupancy)
    return build_tree(whole.select(F.lit("species").alias("aln_id"), F.row_number().over(Window.orderBy("name")).alias("row_ord"), "name", "seq"), aligner="none", **options)


def astrid_tree(gene_trees: DataFrame) -> DataFrame:
    """The tree of mean internode distances over gene trees; a pair that no tree holds is an error."""
    from ..operators.compare import astrid_distances

    return B.trees_from_distances(astrid_distances(gene_trees).withColumn("aln_id", F.lit("astrid")))


def expression_dendrogram(expr: DataFrame, genes: list[str] | None = None, metric: str = "correlation", method: str = "upgma") -> DataFrame:
    return B.trees_from_distances(A.expression_distance(expr, metric, genes).withColumn("aln_id", F.lit("expression")), method=method)
