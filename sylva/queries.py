"""Registered queries: each applies one operator to the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import data as D
from .operators import alignment as A
from .operators import building as B
from .operators import comparative as C
from .operators import compare as X
from .operators import diversity as V
from .operators import likelihood as ML
from .operators import networks as N
from .operators import paths as P
from .operators import rooting as R
from .plans import build, figure
from .plans import layout as L
from .plans import netplot
from .sources import builtin
from .sources import newick as NW
from .sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r9(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


# -- trees ------------------------------------------------------------------------------------------


@query
def tree_nodes_index(s, d):
    return D.geo(s, d).select("node_id", "parent_id", "child_ord", "name", "length", "pre_end", "post", "depth_edges", "depth_len", "is_leaf", "tip_ord", "leaf_lo", "leaf_hi", "n_tips")


@query
def tree_newick(s, d):
    return NW.parse(NW.render(D.geo(s, d))).select("node_id", "name", "length")


@query
def tree_tip_paths(s, d):
    return P.tip_paths(D.geo(s, d)).select("taxon", "edge_id", "length")


@query
def tree_join_metadata(s, d):
    return P.join_data(D.geo(s, d), D.traits(s, d).select("name", F.col("value").cast("decimal(20,2)").alias("balance"))).select("name", F.col("data")["balance"].cast("double").alias("balance")).filter("name is not null")


@query
def tree_search_nodes(s, d):
    return P.search_nodes(D.geo(s, d), is_leaf=False).filter("name is not null").select("name", "n_tips")


@query
def tree_mrca(s, d):
    n = D.geo(s, d)
    within, across = P.get_mrca(n, ["NATION_3", "NATION_8"]), P.get_mrca(n, ["NATION_3", "NATION_2"])
    return within.select(F.lit("within").alias("q"), "name", "n_tips").union(across.select(F.lit("across"), F.coalesce("name", F.lit("root")), "n_tips"))


@query
def tree_group_clade(s, d):
    return R.on_every(D.geo(s, d), R.group_clade, {"ASIA": "east", "AMERICA": "west"}, "group", "rest").filter("is_leaf").select("name", F.col("data")["group"].alias("group"))


@query
def tree_scale_clade(s, d):
    return R.on_every(D.geo(s, d), R.scale_clade, "EUROPE", 2.0).select("node_id", "length", "depth_len")


@query
def tree_collapse_clade(s, d):
    n = R.on_every(D.geo(s, d), R.collapse_clade, "AFRICA", "AFRICA")
    return n.filter("name = 'AFRICA'").select("name", F.col("data")["collapsed_n"].cast("int").alias("n"), F.col("data")["collapsed_near"].cast("double").alias("near"), F.col("data")["collapsed_far"].cast("double").alias("far"))


@query
def tree_prune(s, d):
    n = R.on_every(D.geo(s, d), R.prune_to_taxa, ["NATION_3", "NATION_8", "NATION_2"])
    return n.filter("is_leaf").select("name", "length", "depth_len")


@query
def tree_cut_height(s, d):
    return R.cut_tree(D.geo(s, d), height=1.0).select("taxon", "cluster")


@query
def tree_cut_k(s, d):
    return R.cut_tree(D.geo(s, d), k=5).select("taxon", "cluster")


@query
def tree_ladderize(s, d):
    return R.on_every(D.geo(s, d), R.ladderize).filter("is_leaf").select("name", "tip_ord")


@query
def tree_support_collapse(s, d):
    n = R.on_every(NW.parse(s.createDataFrame([("t", "(((a:1,b:1)50:1,c:1)95:1,(d:1,e:1)70:2);")], "tree_id string, newick string")), R.collapse_low_support, 80)
    return n.filter("is_leaf").select("name", "length", "depth_edges")


@query
def total_branch_length(s, d):
    return P.total_branch_length(D.geo(s, d)).select("tree_id", "total")


@query
def patristic(s, d):
    return P.patristic_distances(D.geo(s, d)).select("x", "y", "d")


@query
def topological(s, d):
    return P.topological_distances(D.geo(s, d)).select("x", "y", "d")


@query
def phylo_vcv(s, d):
    return P.phylo_vcv(D.geo(s, d)).select("x", "y", "v")


@query
def tree_levelorder(s, d):
    return P.traverse(D.geo(s, d), "levelorder").select("depth_edges", "node_id", "name")


@query
def tree_get_node(s, d):
    return P.get_node(D.geo(s, d), "EUROPE").select("name", "n_tips", "leaf_lo", "leaf_hi")


@query
def tree_has_lengths(s, d):
    return P.has_branch_lengths(D.geo(s, d)).select("tree_id", "has_lengths")


@query
def tree_rotate(s, d):
    return R.on_every(D.geo(s, d), R.rotate, "AFRICA").filter("is_leaf").select("name", "tip_ord")


@query
def tree_flip(s, d):
    return R.on_every(D.geo(s, d), R.flip, "AFRICA", "EUROPE").filter("is_leaf").select("name", "tip_ord")


@query
def tree_group_otu(s, d):
    return R.on_every(D.geo(s, d), R.group_otu, {"west": ["NATION_1", "NATION_6"]}, "group", "rest").filter("is_leaf").select("name", F.col("data")["group"].alias("group"))


@query
def tree_outgroup_root(s, d):
    n = R.on_every(D.geo(s, d), R.outgroup_root, ["NATION_0"])
    return n.filter("is_leaf").select("name", "depth_len")


@query
def subtree_abundance(s, d):
    c = D.community(s, d).withColumnRenamed("abundance", "value")
    return P.subtree_sums(D.geo(s, d), c, ["sample"]).select("sample", "edge_id", "total")


# -- diversity -----------------------------------------------------------------------------------------


@query
def faiths_pd_table(s, d):
    return V.faiths_pd(D.geo(s, d), D.community(s, d, "month")).select("sample", "pd")


@query
def unifrac_unweighted(s, d):
    return V.unifrac(D.geo(s, d), D.community(s, d, "priority")).select("a", "b", r9("unifrac").alias("unifrac"))


@query
def unifrac_weighted(s, d):
    return V.unifrac(D.geo(s, d), D.community(s, d, "month"), weighted=True).select("a", "b", r9("unifrac").alias("unifrac"))


@query
def unifrac_weighted_raw(s, d):
    return V.unifrac(D.geo(s, d), D.community(s, d), weighted=True, normalized=False).select("a", "b", r9("unifrac").alias("unifrac"))


@query
def mpd(s, d):
    return V.mpd(D.geo(s, d), D.community(s, d, "month")).select("sample", r9("mpd").alias("mpd"))


@query
def mpd_weighted(s, d):
    return V.mpd(D.geo(s, d), D.community(s, d), True).select("sample", r9("mpd").alias("mpd"))


@query
def mntd(s, d):
    return V.mntd(D.geo(s, d), D.community(s, d, "month")).select("sample", r9("mntd").alias("mntd"))


@query
def mntd_weighted(s, d):
    return V.mntd(D.geo(s, d), D.community(s, d), True).select("sample", r9("mntd").alias("mntd"))


@query
def beta_mntd(s, d):
    return V.beta_mntd(D.geo(s, d), D.community(s, d)).select("a", "b", r9("beta_mntd").alias("beta_mntd"))


@query
def ses_mpd_nri(s, d):
    return V.ses_mpd(D.geo(s, d), D.community(s, d), True, 29, 7).select("sample", *(r9(c).alias(c) for c in ("observed", "null_mean", "null_sd", "nri", "p")))


@query
def ses_mntd_nti(s, d):
    return V.ses_mntd(D.geo(s, d), D.community(s, d), True, 29, 7).select("sample", *(r9(c).alias(c) for c in ("observed", "null_mean", "null_sd", "nti", "p")))


@query
def beta_nti(s, d):
    return V.beta_nti(D.geo(s, d), D.community(s, d), True, 9, 7).select("a", "b", *(r9(c).alias(c) for c in ("observed", "null_mean", "null_sd", "beta_nti", "p")))


def _unifrac_distances(s, d):
    return V.unifrac(D.geo(s, d), D.community(s, d), weighted=True).select(F.col("a").alias("x"), F.col("b").alias("y"), r9("unifrac").alias("d"))


@query
def permanova(s, d):
    groups = D.community(s, d).select(F.col("sample").alias("name"), F.split("sample", r"\|")[0].alias("label")).distinct()
    return V.permanova(_unifrac_distances(s, d), groups, 99, 5).select(r9("f").alias("f"), r9("r2").alias("r2"), r9("p").alias("p"), F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"))


def _mantel(s, d, method):
    other = P.patristic_distances(D.geo(s, d, "n_nationkey div 5", "geo2")).select("x", "y", "d")
    return V.mantel(P.patristic_distances(D.geo(s, d)), other, method, 99, 3).select(r9("r").alias("r"), r9("p").alias("p"), "n_pairs")


@query
def mantel_pearson(s, d):
    return _mantel(s, d, "pearson")


@query
def mantel_spearman(s, d):
    return _mantel(s, d, "spearman")


# -- comparing trees ---------------------------------------------------------------------------------------


@query
def tree_splits(s, d):
    return X.splits(D.geo(s, d)).select(F.array_join("side", "|").alias("side"), "size", "length")


@query
def rf_distance(s, d):
    return X.robinson_foulds(D.two_trees(s, d))


@query
def rf_normalized(s, d):
    return X.robinson_foulds(D.two_trees(s, d), True).select("a", "b", r9("rf").alias("rf"))


@query
def split_frequencies(s, d):
    return X.split_frequencies(D.two_trees(s, d)).select(F.array_join("side", "|").alias("side"), "size", "n_trees", "frequency")


@query
def split_conflicts(s, d):
    x = X.splits(D.two_trees(s, d)).dropDuplicates(["split_key"])
    return X.conflicting_splits(x).agg(F.count("*").alias("n"))


@query
def crossing_number(s, d):
    return X.crossing_number(D.two_trees(s, d), "geo", "geo2")


@query
def discordant_links(s, d):
    return X.discordant(D.two_trees(s, d), "geo", "geo2")


@query
def taxon_displacement(s, d):
    return X.taxon_displacement(D.two_trees(s, d)).select("a", "b", "taxon", r9("displacement").alias("displacement"))


@query
def rogue_taxon(s, d):
    return X.rogue_taxon(D.two_trees(s, d)).select("a", "b", r9("rf").alias("rf"), "taxon", r9("rf_without").alias("rf_without"), r9("explained").alias("explained"))


@query
def gene_tree_conflict(s, d):
    return X.gene_tree_conflict(D.two_trees(s, d), "geo").select("gene", r9("rf").alias("rf"), "taxon", r9("mean_displacement").alias("mean_displacement"), "n_shared")


@query
def astrid_distances(s, d):
    return X.astrid_distances(D.two_trees(s, d)).select("x", "y", "d", "n_trees")


# -- alignments ----------------------------------------------------------------------------------------------


@query
def aln_column_statistics(s, d):
    return A.column_statistics(D.alignment(s, d)).select(F.col("col").cast("long").alias("col"), r9("gap_fraction").alias("gap_fraction"), r9("conservation").alias("conservation"))


@query
def aln_trim(s, d):
    return A.trim(D.alignment(s, d), max_gap=0.3, min_conservation=0.3).select("name", "seq")


@query
def aln_trim_terminal(s, d):
    return A.trim_terminal_gaps(D.alignment(s, d), 0.2).select("name", "seq")


@query
def aln_site_patterns(s, d):
    return A.site_patterns(D.alignment(s, d)).select("pattern", "weight", F.col("first_col").cast("long").alias("first_col"))


def _distances(model):
    def run(s, d):
        return A.distance_matrix(D.alignment(s, d), model).select("x", "y", r9("d").alias("d"))

    return run


for _model in ("raw", "jc69", "k2p", "poisson"):
    QUERIES[f"distance_{_model}"] = _distances(_model)


@query
def kmer_distance(s, d):
    return A.kmer_distance(D.alignment(s, d)).select("x", "y", r9("d").alias("d"))


@query
def identity_network(s, d):
    return A.identity_edges(D.alignment(s, d), 0.3).select("x", "y", r9("w").alias("w"))


@query
def parsimony_bounds(s, d):
    return A.parsimony_bounds(D.alignment(s, d)).select("least", "most")


@query
def concatenate_supermatrix(s, d):
    return A.concatenate(D.markers(s, d)).select("name", "seq", "n_markers", r9("occupancy").alias("occupancy"))


@query
def marker_partitions(s, d):
    return A.partitions(D.markers(s, d)).select("marker", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_taxa")


@query
def split_domains(s, d):
    ranges = s.createDataFrame([("early", 1, 6), ("late", 7, 20)], "domain string, lo int, hi int")
    aln = D.alignment(s, d)
    return A.split_domains(aln, A.residue_columns(aln, "NATION_3", ranges)).select("domain", "name", "seq")


@query
def biallelic_recode(s, d):
    return A.biallelic(D.alignment(s, d)).select(F.col("col").cast("long").alias("col"), F.col("pos").cast("long").alias("pos"), F.col("row_ord").cast("long").alias("row_ord"), F.col("allele").cast("long").alias("allele"))


@query
def four_gamete_pairs(s, d):
    return A.four_gamete_pairs(A.biallelic(D.alignment(s, d)), 5).select(F.col("pos_a").cast("long").alias("pos_a"), F.col("pos_b").cast("long").alias("pos_b"), "scored", "incompatible")


@query
def four_gamete_scan(s, d):
    return A.four_gamete_scan(D.alignment(s, d), 5, n_perm=49).select("aln_id", F.col("n_sites").cast("long").alias("n_sites"), "scored", "incompatible", r9("share").alias("share"), r9("p").alias("p"))


@query
def codon_f3x4(s, d):
    return A.codon_frequencies(D.alignment(s, d)).select("codon", r9("pi").alias("pi"))


@query
def character_matrix(s, d):
    return T.character_matrix(D.characters(s, d)).select("name", "character", "state", F.col("code").cast("long").alias("code"), "symbol")


@query
def mutation_matrix(s, d):
    return T.mutation_matrix(D.characters(s, d), wild_type="BUILDING").select("name", "character", "state", F.col("code").cast("long").alias("code"))


@query
def allele_table(s, d):
    return T.allele_table(D.alleles(s, d), site_cols=("r1", "r2")).select("name", "character", "state", F.col("code").cast("long").alias("code"))


def _expression(metric):
    def run(s, d):
        return A.expression_distance(D.expression(s, d), metric).select("x", "y", F.round("d", 5).alias("d"))

    return run


for _metric in ("euclidean", "correlation", "cosine"):
    QUERIES[f"expression_{_metric}"] = _expression(_metric)


@query
def fasta_entries(s, d):
    return T.to_fasta(D.alignment(s, d), 60).select(F.col("row_ord").cast("long").alias("row_ord"), "fasta")


@query
def aln_guess_type(s, d):
    return A.guess_type(D.alignment(s, d))


@query
def aln_select_columns(s, d):
    return A.select_columns(D.alignment(s, d), [3, 0, 3]).select("name", "seq")


@query
def group_mean_distances(s, d):
    g = D.table(s, d, "nation").select("n_name", F.col("n_regionkey").cast("long").alias("g"))
    a, b = g.select(F.col("n_name").alias("x"), F.col("g").alias("gx")), g.select(F.col("n_name").alias("y"), F.col("g").alias("gy"))
    x = P.patristic_distances(D.geo(s, d, "n_nationkey div 5")).join(a, "x").join(b, "y")
    return x.groupBy(F.least("gx", "gy").alias("a"), F.greatest("gx", "gy").alias("b")).agg(r9(F.avg("d")).alias("d"))


# -- networks ---------------------------------------------------------------------------------------------------


@query
def network_edges(s, d):
    return N.edges_from_distances(A.distance_matrix(D.alignment(s, d), "raw"), 0.3).select("x", "y", r9("w").alias("w"))


@query
def connected_components(s, d):
    aln = D.alignment(s, d)
    edges = N.edges_from_distances(A.distance_matrix(aln, "raw"), 0.38)
    return N.connected_components(aln.select("name"), edges).select("name", "component", "size")


@query
def cluster_centroids(s, d):
    placed = L.circular(D.geo(s, d)).filter("is_leaf").select("name", "x", "y")
    groups = D.table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("label"))
    return N.cluster_centroids(placed, groups).select("label", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), "n", F.round("reach", 5).alias("reach"))


@query
def circular_test(s, d):
    order = D.geo(s, d).filter("is_leaf").select("name", F.col("tip_ord").alias("place"))
    found = X.splits(D.geo(s, d, "n_nationkey div 5", "geo2"))
    return N.circular_test(found, order).groupBy("arcs", "circular").agg(F.count("*").alias("n")).select("arcs", "circular", "n")


# -- layouts and figures ---------------------------------------------------------------------------------------------


@query
def layout_rectangular(s, d):
    return L.rectangular(D.geo(s, d)).select("node_id", r9("x").alias("x"), r9("y").alias("y"))


@query
def layout_dendrogram(s, d):
    return L.dendrogram(D.geo(s, d)).select("node_id", r9("x").alias("x"), r9("y").alias("y"))


@query
def layout_circular(s, d):
    return L.circular(D.geo(s, d)).select("node_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query
def layout_equal_angle(s, d):
    return L.equal_angle(D.geo(s, d)).select("node_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query
def highlight_runs(s, d):
    tips = P.join_data(D.geo(s, d), D.characters(s, d)).filter("is_leaf").withColumn("segment", F.col("data")["segment"])
    return figure.runs(tips, "segment").select("value", "lo", "hi", "n")


@query
def ring_stack(s, d):
    wide = D.orders_of_nations(s, d).groupBy(F.col("nation").alias("name")).pivot("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).count()
    scene = figure.ring_stack(L.rectangular(D.geo(s, d)), wide, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    return scene.select("ord", F.col("text").alias("segment"), r9(F.col("style")["share"].cast("double")).alias("share"))


@query
def heatmap_cells(s, d):
    scene = figure.heatmap(L.rectangular(D.geo(s, d)), D.characters(s, d))
    return scene.select("ord", "text", r9(F.col("points")[0]["x"]).alias("x"), F.col("points")[0]["y"].alias("y"))


@query
def bar_track(s, d):
    scene = figure.bar_track(L.rectangular(D.geo(s, d)), D.traits(s, d), "value")
    return scene.select("ord", r9(F.col("points")[1]["x"] - F.col("points")[0]["x"]).alias("width"))


@query
def geo_bands(s, d):
    placed = L.rectangular(R.on_every(D.geo(s, d), lambda root: R.scale_clade(root, [t for t in root.names()], 100.0)))
    return figure.time_axis(placed).filter("kind = 'polygon'").select(F.col("text").alias("period"), r9(F.col("points")[0]["x"]).alias("x0"), r9(F.col("points")[1]["x"]).alias("x1"))


@query
def scale_bar(s, d):
    return figure.scale_bar(L.rectangular(D.geo(s, d))).select("text", r9(F.col("points")[1]["x"]).alias("size"))


@query
def node_markers(s, d):
    return figure.points(L.rectangular(D.geo(s, d)), "nodes").select("ord", F.col("text").alias("name"), F.col("points")[0]["x"].alias("x"))


@query
def elbow_paths(s, d):
    return L.branch_paths(L.rectangular(D.geo(s, d))).select("node_id", "part", *(F.col("points")[i][c].alias(f"{c}{i}") for i in (0, 1) for c in "xy"))


@query
def color_scale_categorical(s, d):
    return figure.color_scale(D.table(s, d, "customer"), "c_mktsegment").select("value", "color", F.col("place").cast("long").alias("place"))


@query
def color_scale_continuous(s, d):
    return figure.color_scale(D.table(s, d, "customer"), "c_acctbal").select(F.col("value").cast("double").alias("value"), "color")


# -- traits ----------------------------------------------------------------------------------------------------------


@query
def ace_continuous(s, d):
    return C.ace_continuous(D.geo(s, d), D.traits(s, d)).select("node_id", F.round("value", 2).alias("value"))


@query
def ilr_balances(s, d):
    return C.ilr_balances(D.geo(s, d), D.community(s, d)).select("edge_id", "sample", r9("balance").alias("balance"))


# -- kernels: no SQL form ----------------------------------------------------------------------------------------------


def _by_tree(s, d, run, schema):
    values = {r["name"]: r.value for r in D.traits(s, d).collect()}  # a row a tip
    return C.by_tree(D.geo(s, d), lambda root: run(root, values), schema)


@query
def nj_tree(s, d):
    return B.trees_from_distances(A.distance_matrix(D.alignment(s, d), "jc69"), root="midpoint").select("node_id", "parent_id", "name", r9("length").alias("length"))


@query
def upgma_tree(s, d):
    return B.trees_from_distances(A.distance_matrix(D.alignment(s, d), "raw"), method="upgma").select("node_id", "parent_id", "name", r9("length").alias("length"))


@query
def expression_dendrogram(s, d):
    return build.expression_dendrogram(D.expression(s, d)).select("node_id", "parent_id", "name", r9("length").alias("length"))


@query
def bootstrap_support(s, d):
    return B.bootstrap_support(D.alignment(s, d), 20, "nj", "raw").select("side", "n_trees", "support_percent")


@query
def parsimony_nni(s, d):
    return B.parsimony_trees(D.alignment(s, d)).filter("parent_id is null").select("tree_id", F.col("data")["score"].cast("double").alias("score"), "n_tips")


@query
def fitch_parsimony(s, d):
    return B.parsimony_scores(D.geo(s, d, tree_id="orders"), D.alignment(s, d))


@query
def camin_sokal(s, d):
    m = T.as_alignment(T.mutation_matrix(D.characters(s, d), wild_type="BUILDING"), "geo")
    return B.parsimony_scores(D.geo(s, d), m, irreversible=True)


@query
def ancestral_mutations(s, d):
    m = T.as_alignment(T.mutation_matrix(D.characters(s, d), wild_type="BUILDING"), "geo")
    return B.ancestral_mutations(D.geo(s, d), m).select("node_id", "site", "state")


@query
def ml_loglik(s, d):
    def run(left, right):
        from .operators.phylo import tree

        right = right.sort_values("row_ord")
        return pd.DataFrame([(left["tree_id"].iloc[0], ML.log_likelihood(tree(left), right["name"].tolist(), right["seq"].tolist(), "HKY85", [2.0]))], columns=["tree_id", "logl"])

    aln = D.alignment(s, d).withColumnRenamed("aln_id", "tree_id")
    return D.geo(s, d, tree_id="orders").groupBy("tree_id").cogroup(aln.groupBy("tree_id")).applyInPandas(run, "tree_id string, logl double")


@query
def model_finder(s, d):
    return ML.model_finder(D.alignment(s, d), ("JC69", "HKY85"), (0,))


@query
def blomberg_k(s, d):
    return _by_tree(s, d, lambda t, v: [C.blomberg_k(t, v, 99)], "k double, p double")


@query
def pagels_lambda(s, d):
    return _by_tree(s, d, lambda t, v: [C.pagels_lambda(t, v)], "lambda double, logL double, lrt double, p double")


@query
def pgls(s, d):
    return _by_tree(s, d, lambda t, v: C.pgls(t, v, {n: float(len(n)) for n in v})["terms"], "term string, estimate double, se double, t double, p double")


@query
def fritz_purvis_d(s, d):
    def run(t, v):
        mid = sorted(v.values())[len(v) // 2]
        return [C.fritz_purvis_d(t, {k: int(x >= mid) for k, x in v.items()}, 99)]

    return _by_tree(s, d, run, "d double, p_random double, p_brownian double")


@query
def fit_continuous(s, d):
    return C.compare_continuous(D.geo(s, d), D.traits(s, d).select("name", F.lit("balance").alias("trait"), "value"))


@query
def phylofactor(s, d):
    covariate = D.community(s, d).groupBy("sample").agg(F.sum("abundance").alias("value"))
    found = C.phylofactor(D.geo(s, d), D.community(s, d), covariate, 2)
    return s.createDataFrame([(f["factor"], f["edge_id"], round(f["f"], 6), round(f["p"], 6), "|".join(f["taxa"])) for f in found], "factor int, edge_id int, f double, p double, taxa string")


@query
def neighbor_net(s, d):
    return N.neighbor_nets(A.distance_matrix(D.alignment(s, d), "raw")).select("side", "size", r9("weight").alias("weight"))


@query
def force_layout(s, d):
    aln = D.alignment(s, d)
    edges = N.edges_from_distances(A.distance_matrix(aln, "raw"), 0.3)
    parts = N.connected_components(aln.select("name"), edges)
    return N.layout_by_component(parts, edges, iterations=50).select("name", "component", r9("x").alias("x"), r9("y").alias("y"))


@query
def ace_ml(s, d):
    state = {r["name"]: r.segment for r in D.characters(s, d).collect()}  # a row a tip
    return C.by_tree(D.geo(s, d), lambda t: ML.ace_ml(t, state)[0], "node int, name string, state string, p double")


@query
def stochastic_map(s, d):
    state = {r["name"]: r.segment for r in D.characters(s, d).collect()}  # a row a tip
    return C.by_tree(D.geo(s, d), lambda t: ML.stochastic_map(t, state, 20), "node int, name string, state string, p double, dwell double")


@query
def figure_scene(s, d):
    n = P.join_data(D.geo(s, d), D.characters(s, d))
    fig = figure.TreeFigure(n).tip_labels().points("tips", color_by="segment").highlight("ASIA").scale_bar().heatmap(D.characters(s, d))
    return fig.scene().select("kind", "zorder", "ord", "text", F.size("points").alias("n_points"))


# -- more trees, elements and keys ----------------------------------------------------------------------------------


def _xy(scene: DataFrame, *columns, n: int = 2, digits: int = 9) -> DataFrame:
    """Rows of a scene with the coordinates of their first points."""
    return scene.select("ord", *columns, *(F.round(F.get("points", F.lit(i))[c], digits).alias(f"{c}{i}") for i in range(n) for c in "xy"))


@query
def tree_swap_children(s, d):
    return R.on_every(D.geo(s, d), R.swap_children, "AFRICA", [2, 0, 1, 4, 3]).filter("is_leaf").select("name", "tip_ord")


@query
def tree_leaf_names(s, d):
    rows = lambda t: [(n.name or "root", "|".join(n.names())) for n in t.preorder() if not n.is_leaf]
    return C.by_tree(D.geo(s, d), rows, "name string, leaves string").select("name", "leaves")


@query
def primates_joined(s, d):
    n = P.join_data(builtin.primates(s), builtin.primates_metadata(s)).filter("is_leaf")
    return n.select("name", r9("depth_len").alias("depth_len"), F.col("data")["habitat"].alias("habitat"), F.col("data")["body_mass_kg"].cast("int").alias("body_mass_kg"))


@query
def taxon_like_labels(s, d):
    from .functions import colors

    said = [D.table(s, d, t).select(F.col(c).alias("label")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"), ("events", "event_type"), ("orders", "o_orderpriority"))]
    labels = said[0].union(said[1]).union(said[2]).union(said[3]).union(said[4]).distinct()
    return labels.select("label", colors.looks_like_a_taxon(F.col("label")).alias("taxon"))


@query
def layout_cladogram(s, d):
    return L.get_layout("cladogram")(D.geo(s, d)).select("node_id", r9("x").alias("x"), r9("y").alias("y"))


@query
def layout_inward(s, d):
    return L.get_layout("inward")(D.geo(s, d)).select("node_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query
def slanted_paths(s, d):
    return _xy(figure.TreeFigure(D.geo(s, d), "slanted").scene())


@query
def circular_paths(s, d):
    paths = L.branch_paths(L.circular(D.geo(s, d)), "circular")
    ends = lambda i: [F.round(F.element_at("points", i)[c], 5).alias(f"{c}{max(i, 0)}") for c in "xy"]
    return paths.select("node_id", "part", *ends(1), *ends(-1))


@query
def tip_label_scene(s, d):
    return _xy(figure.tip_labels(L.rectangular(D.geo(s, d)), italic=True), F.col("text").alias("name"), F.col("style")["italic"].alias("italic"), n=1)


@query
def node_label_scene(s, d):
    return _xy(figure.node_labels(L.rectangular(D.geo(s, d)), ["name"]), F.col("text").alias("name"), n=1)


@query
def highlight_clade(s, d):
    return _xy(figure.highlight(L.rectangular(D.geo(s, d)), "ASIA", color="#ff0000", alpha=0.3), F.col("text").alias("name"), F.col("style")["facecolor"].alias("color"), F.col("style")["alpha"].cast("double").alias("alpha"), n=4)


@query
def clade_label_scene(s, d):
    return _xy(figure.clade_label(L.rectangular(D.geo(s, d)), "ASIA", "Asia"), "kind", "text")


@query
def connection_curves(s, d):
    pairs = D.table(s, d, "region").select(F.concat(F.lit("NATION_"), "r_regionkey").alias("a"), F.col("r_name").alias("b"))
    scene = figure.connections(L.rectangular(D.geo(s, d)), pairs)
    return scene.select("text", *(F.round(F.col("points")[i][c], 9).alias(f"{c}{i}") for i in (0, 10, 20) for c in "xy"))


@query
def domain_blocks(s, d):
    blocks = D.orders_of_nations(s, d).groupBy(F.col("nation").alias("name"), F.col("c_mktsegment").alias("domain")).agg(F.count("*").alias("length")).withColumn("ord", F.col("domain"))
    return _xy(figure.domains(L.rectangular(D.geo(s, d)), blocks), F.col("text").alias("domain"))


@query
def collapsed_triangles(s, d):
    n = R.on_every(D.geo(s, d), R.collapse_clade, "AFRICA", "AFRICA")
    return _xy(figure.collapsed_clades(L.rectangular(n)), F.col("text").alias("n"), n=3)


@query
def alignment_rows(s, d):
    return figure.alignment_track(L.rectangular(D.geo(s, d)), D.alignment(s, d)).select("ord", F.col("text").alias("codes"))


@query
def point_shapes(s, d):
    n = P.join_data(D.geo(s, d), D.characters(s, d))
    return figure.points(L.rectangular(n), "tips", shape_by="segment", color_by="segment").select("ord", F.col("style")["marker"].alias("marker"), F.col("style")["color"].alias("color"))


@query
def point_sizes(s, d):
    n = P.join_data(D.geo(s, d), D.traits(s, d).select("name", F.col("value").cast("decimal(20,2)").alias("balance")))
    return figure.points(L.rectangular(n), "tips", size_by="balance").select("ord", F.round(F.col("style")["size"].cast("double"), 6).alias("size"))


@query
def scene_bounds(s, d):
    return figure.bounds(figure.branches(L.rectangular(D.geo(s, d)), "rectangular"))


@query
def mirrored_paths(s, d):
    return _xy(figure.mirrored(figure.branches(L.rectangular(D.geo(s, d)), "straight"), 5.0, 2.0))


@query
def panel_places(s, d):
    placed = L.rectangular(D.geo(s, d))
    scene = figure.panels([figure.branches(placed, "straight"), figure.tip_labels(placed), figure.support_labels(placed), figure.branches(placed, "rectangular")])
    return scene.groupBy("panel", "panel_row", "panel_col").agg(F.count("*").alias("n"))


@query
def ribbon_spans(s, d):
    groups = D.table(s, d, "nation").join(D.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("label"))
    return figure.ribbons(D.geo(s, d), D.geo(s, d, "n_nationkey div 5", "geo2"), groups)


@query
def legend_entries(s, d):
    return figure.key(D.geo(s, d), D.table(s, d, "customer"), "c_mktsegment", "segment", "patch").select("fig_id", "kind", "ord", "text", F.col("style")["title"].alias("title"), F.col("style")["color"].alias("color"), F.col("style")["swatch"].alias("swatch"))


@query
def colorbar_ends(s, d):
    return figure.key(D.geo(s, d), D.table(s, d, "customer"), "c_acctbal").select("fig_id", "kind", "text", F.col("style")["min"].cast("double").alias("lo"), F.col("style")["max"].cast("double").alias("hi"), F.substring_index(F.col("style")["stops"], ",", 1).alias("first"), F.size(F.split(F.col("style")["stops"], ",")).alias("stops"))


@query
def network_pairs(s, d):
    near = P.patristic_distances(D.geo(s, d)).filter("d < 4.5").select("x", "y", F.expr("if(d < 2, 1 / d, NULL)").alias("w"))
    names, edges = N.edges_from_pairs(near)
    degree = edges.select(F.col("x").alias("name"), "w").union(edges.select("y", "w")).groupBy("name").agg(F.count("*").alias("degree"), r9(F.sum("w")).alias("weight"))
    return names.join(degree, "name").select("name", "degree", "weight")


def _regions(s, d):
    return D.table(s, d, "nation").join(D.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("label"))


@query
def network_colors(s, d):
    at = L.rectangular(D.geo(s, d)).filter("is_leaf").select("name", "x", "y")
    return netplot.color_by(at, _regions(s, d), baseline="AMERICA")[0].select("name", "label", "color")


@query
def network_labels(s, d):
    at = L.rectangular(D.geo(s, d)).filter("is_leaf").select("name", "x", "y")
    return _xy(netplot.label_nodes(at, ["NATION_3", "NATION_11"]), F.col("text").alias("name"), n=1)


@query
def stream_community_pd(s, d):
    import uuid

    from .session import shared_dir
    from .streaming import community as ST

    counts = ST.windowed(ST.file_stream(s, d), "event_type", "1 day")
    run = uuid.uuid4().hex[:8]
    return ST.run_to_table(counts, f"community_{run}", f"{shared_dir(s)}/stream-{run}").select("sample", "taxon", "abundance")
