"""Phylogenetic diversity of communities: (sample, taxon, abundance) rows, zeros absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import permuted
from .paths import patristic_distances, tip_paths


def long_form(wide: DataFrame, sample: str = "sample") -> DataFrame:
    """A samples x taxa table to rows; only abundances above zero are kept."""
    taxa = [c for c in wide.columns if c != sample]
    return wide.unpivot(sample, taxa, "taxon", "abundance").select(F.col(sample).alias("sample"), "taxon", F.col("abundance").cast("double").alias("abundance")).filter("abundance > 0")


def check_taxa(nodes: DataFrame, table: DataFrame, taxon: str = "taxon") -> None:
    """Every taxon of the table is a tip."""
    unknown = table.select(F.col(taxon).alias("name")).distinct().join(nodes.filter("is_leaf").select("name"), "name", "left_anti").orderBy("name").limit(10).collect()
    if unknown:
        raise ValueError(f"not tips of the tree: {[r.name for r in unknown]}")


def _present(table: DataFrame) -> DataFrame:
    return table.filter("abundance > 0").select("sample", "taxon", "abundance")


def faiths_pd(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """(tree_id, sample, pd): length of the distinct edges between a sample's taxa and the root."""
    edges = tip_paths(nodes).join(_present(table).select("sample", "taxon").distinct(), "taxon").groupBy("tree_id", "sample", "edge_id").agg(F.first("length").alias("length"))
    return edges.groupBy("tree_id", "sample").agg(F.sum("length").alias("pd"))


def edge_shares(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """(tree_id, sample, edge_id, length, share): the part of a sample's abundance below each edge."""
    present = _present(table)
    whole = present.groupBy("sample").agg(F.sum("abundance").alias("whole"))
    below = tip_paths(nodes).join(present, "taxon").groupBy("tree_id", "sample", "edge_id").agg(F.first("length").alias("length"), F.sum("abundance").alias("below"))
    return below.join(whole, "sample").select("tree_id", "sample", "edge_id", "length", (F.col("below") / F.col("whole")).alias("share"))


def unifrac(nodes: DataFrame, table: DataFrame, weighted: bool = False, normalized: bool = True) -> DataFrame:
    """(tree_id, a, b, unifrac) of samples a < b.

    Pairs meet on the edges they share; what only one of them has follows from its own sums, so the
    join makes rows for common edges alone.
    """
    e = edge_shares(nodes, table)
    own = e.groupBy("tree_id", "sample").agg(F.sum("length").alias("len"), F.sum(F.col("length") * F.col("share")).alias("mass"))
    pair = own.select("tree_id", F.col("sample").alias("a"), F.col("len").alias("len_a"), F.col("mass").alias("mass_a")).join(own.select("tree_id", F.col("sample").alias("b"), F.col("len").alias("len_b"), F.col("mass").alias("mass_b")), "tree_id").filter("a < b")
    a = e.select("tree_id", "edge_id", "length", F.col("sample").alias("a"), F.col("share").alias("fa"))
    b = e.select("tree_id", "edge_id", F.col("sample").alias("b"), F.col("share").alias("fb"))
    common = a.join(b, ["tree_id", "edge_id"]).filter("a < b").groupBy("tree_id", "a", "b").agg(F.sum("length").alias("both"), F.sum(F.col("length") * F.least("fa", "fb")).alias("least"))
    x = pair.join(common, ["tree_id", "a", "b"], "left").na.fill(0.0, ["both", "least"])
    if not weighted:
        union = F.col("len_a") + F.col("len_b") - F.col("both")
        value = F.try_divide(union - F.col("both"), union)
    else:
        apart = F.col("mass_a") + F.col("mass_b") - 2 * F.col("least")
        value = F.try_divide(apart, F.col("mass_a") + F.col("mass_b")) if normalized else apart
    return x.select("tree_id", "a", "b", value.alias("unifrac"))


def _both_ways(distances: DataFrame) -> DataFrame:
    return distances.select("tree_id", "x", "y", "d").union(distances.select("tree_id", F.col("y").alias("x"), F.col("x").alias("y"), "d"))


def _weights(table: DataFrame) -> DataFrame:
    present = _present(table)
    whole = present.groupBy("sample").agg(F.sum("abundance").alias("whole"))
    return present.join(whole, "sample").select("sample", "taxon", (F.col("abundance") / F.col("whole")).alias("w"))


def mpd(nodes: DataFrame, table: DataFrame, abundance_weighted: bool = False, distances: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(tree_id, sample, mpd): mean distance of a sample's pairs of taxa, by product of abundances if weighted; null below two taxa."""
    d = distances if distances is not None else patristic_distances(nodes)
    w = _weights(table) if not by else table
    a, b = (w.select(*by, "sample", F.col("taxon").alias(x), F.col("w").alias(f"w{x}")) for x in "xy")
    joined = a.join(b, [*by, "sample"]).filter("x < y").join(d, ["x", "y"])
    value = F.try_divide(F.sum(F.col("d") * F.col("wx") * F.col("wy")), F.sum(F.col("wx") * F.col("wy"))) if abundance_weighted else F.avg("d")
    return joined.groupBy("tree_id", *by, "sample").agg(value.alias("mpd"))


def mntd(nodes: DataFrame, table: DataFrame, abundance_weighted: bool = False, distances: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(tree_id, sample, mntd): mean over a sample's taxa of the distance to the nearest other one."""
    d = _both_ways(distances if distances is not None else patristic_distances(nodes))
    w = _weights(table) if not by else table
    a, b = w.select(*by, "sample", F.col("taxon").alias("x"), "w"), w.select(*by, "sample", F.col("taxon").alias("y"))
    near = a.join(b, [*by, "sample"]).filter("x <> y").join(d, ["x", "y"]).groupBy("tree_id", *by, "sample", "x").agg(F.min("d").alias("d"), F.first("w").alias("w"))
    value = F.sum(F.col("d") * F.col("w")) / F.sum("w") if abundance_weighted else F.avg("d")
    return near.groupBy("tree_id", *by, "sample").agg(value.alias("mntd"))


def beta_mntd(nodes: DataFrame, table: DataFrame, abundance_weighted: bool = True, distances: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(tree_id, a, b, beta_mntd) of samples a < b: mean nearest distance from each to the other, averaged.

    Distances to a sample's nearest taxon are reduced first, a row a sample and taxon, so samples meet on taxa
    and rows grow with samples squared times taxa."""
    d = distances if distances is not None else patristic_distances(nodes)
    both = _both_ways(d)
    zero = both.select("tree_id", F.col("x"), F.col("x").alias("y"), F.lit(0.0).alias("d")).distinct()
    both = both.union(zero)
    w = _weights(table) if not by else table
    keys = ["tree_id", *by]
    near = w.select(*by, F.col("sample").alias("t"), F.col("taxon").alias("y")).join(both, "y").groupBy(*keys, "t", "x").agg(F.min("d").alias("d"))
    met = w.select(*by, F.col("sample").alias("s"), F.col("taxon").alias("x"), "w").join(near, [*by, "x"]).filter("s <> t")
    one_way = met.groupBy(*keys, "s", "t").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w") if abundance_weighted else F.avg("d")).alias("m"))
    return one_way.groupBy(*keys, F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.avg("m").alias("beta_mntd"))


# -- null models --------------------------------------------------------------------------------


def _relabelled(nodes: DataFrame, table: DataFrame, n_null: int, seed: int) -> DataFrame:
    """(perm_id, sample, taxon, w) with tips shuffled over the tree; perm_id 0 is as observed."""
    tips = nodes.filter("is_leaf").select(F.col("name").alias("item"))
    shuffled = permuted(tips, n_null, seed).select("perm_id", F.col("item").alias("taxon"), F.col("other").alias("to"))
    same = tips.select(F.lit(0).alias("perm_id"), F.col("item").alias("taxon"), F.col("item").alias("to"))
    return _weights(table).join(same.union(shuffled), "taxon").select("perm_id", "sample", F.col("to").alias("taxon"), "w")


def standardised(values: DataFrame, keys: list[str], value: str, sign: int = 1, name: str = "ses") -> DataFrame:
    """Observed (perm_id 0) against the null: mean, deviation, standardised effect and a two-sided p about the null's mean."""
    null = values.filter("perm_id > 0").groupBy(*keys).agg(F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_sd"), F.count(value).alias("n_null"))
    seen = values.filter("perm_id = 0").select(*keys, F.col(value).alias("observed")).join(null, keys)
    off = values.filter("perm_id > 0").join(seen, keys).groupBy(*keys).agg(F.count_if(F.abs(F.col(value) - F.col("null_mean")) >= F.abs(F.col("observed") - F.col("null_mean")) - 1e-12).alias("extreme"))
    effect = F.when(F.col("null_sd") > 1e-12, (F.col("observed") - F.col("null_mean")) / F.col("null_sd") * sign)
    return seen.join(off, keys, "left").select(*keys, "observed", "null_mean", "null_sd", effect.alias(name), ((F.coalesce("extreme", F.lit(0)) + 1) / (F.col("n_null") + 1)).alias("p"))


def ses_mpd(nodes: DataFrame, table: DataFrame, abundance_weighted: bool = False, n_null: int = 999, seed: int = 0) -> DataFrame:
    """(tree_id, sample, observed, null_mean, null_sd, nri, p); NRI is the negated standardised effect."""
    x = mpd(nodes, _relabelled(nodes, table, n_null, seed), abundance_weighted, by=("perm_id",))
    return standardised(x, ["tree_id", "sample"], "mpd", -1, "nri")


def ses_mntd(nodes: DataFrame, table: DataFrame, abundance_weighted: bool = False, n_null: int = 999, seed: int = 0) -> DataFrame:
    """(tree_id, sample, observed, null_mean, null_sd, nti, p); NTI is the negated standardised effect."""
    x = mntd(nodes, _relabelled(nodes, table, n_null, seed), abundance_weighted, by=("perm_id",))
    return standardised(x, ["tree_id", "sample"], "mntd", -1, "nti")


def beta_nti(nodes: DataFrame, table: DataFrame, abundance_weighted: bool = True, n_null: int = 999, seed: int = 0) -> DataFrame:
    """(tree_id, a, b, observed, null_mean, null_sd, beta_nti, p); one relabelling serves both samples."""
    x = beta_mntd(nodes, _relabelled(nodes, table, n_null, seed), abundance_weighted, by=("perm_id",))
    return standardised(x, ["tree_id", "a", "b"], "beta_mntd", 1, "beta_nti")


# -- tests on distance matrices: (x, y, d) rows of x < y ---------------------------------------------


def permanova(distances: DataFrame, groups: DataFrame, n_perm: int = 999, seed: int = 0) -> DataFrame:
    """One row (f, r2, p, n, k) from distances (x, y, d) and groups (name, label)."""
    g = groups.select(F.col("name").alias("item"), "label")
    shuffled = permuted(g.select("item"), n_perm, seed)
    labels = g.select(F.lit(0).alias("perm_id"), "item", "label").union(shuffled.join(g.withColumnRenamed("item", "other"), "other").select("perm_id", "item", "label"))
    sizes = g.groupBy("label").agg(F.count("*").alias("m"))
    sizes = sizes.filter(F.assert_true(F.col("m") > 1, F.lit("a group has two samples or more")).isNull())
    total = distances.select(F.sum(F.col("d") * F.col("d")).alias("ss")).crossJoin(g.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k"))).select((F.col("ss") / F.col("n")).alias("total"), "n", "k")
    x, y = labels.select("perm_id", F.col("item").alias("x"), F.col("label").alias("lx")), labels.select("perm_id", F.col("item").alias("y"), F.col("label").alias("ly"))
    within = distances.join(x, "x").join(y, ["perm_id", "y"]).filter("lx = ly").groupBy("perm_id", F.col("lx").alias("label")).agg(F.sum(F.col("d") * F.col("d")).alias("ss")).join(sizes, "label").groupBy("perm_id").agg(F.sum(F.col("ss") / F.col("m")).alias("within"))
    f = within.crossJoin(total).select("perm_id", "n", "k", ((F.col("total") - F.col("within")) / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"), (1 - F.col("within") / F.col("total")).alias("r2"))
    seen = f.filter("perm_id = 0").select("n", "k", F.col("f").alias("f0"), "r2")
    more = f.filter("perm_id > 0").crossJoin(seen.select("f0")).agg(F.count_if(F.col("f") >= F.col("f0") - 1e-12).alias("extreme"), F.count("*").alias("m"))
    return seen.crossJoin(more).select(F.col("f0").alias("f"), "r2", ((F.col("extreme") + 1) / (F.col("m") + 1)).alias("p"), "n", "k")


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks in which ties share their mean, from counts of distinct values."""
    from pyspark.sql.window import Window

    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    upto = counts.withColumn(name, F.sum("_c").over(Window.orderBy(value)) - (F.col("_c") - 1) / 2.0).select(value, name)
    return df.join(upto, value)


def mantel(a: DataFrame, b: DataFrame, method: str = "pearson", n_perm: int = 999, seed: int = 0) -> DataFrame:
    """One row (r, p, n_pairs): correlation of two distance tables over their common pairs, permuting a's names."""
    if method not in ("pearson", "spearman"):
        raise ValueError("method is pearson or spearman")
    order = lambda df, v: df.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.col("d").alias(v))
    both = order(a, "da").join(order(b, "db"), ["x", "y"])
    if method == "spearman":
        both = average_ranks(average_ranks(both, "da", "ra"), "db", "rb").select("x", "y", F.col("ra").alias("da"), F.col("rb").alias("db"))
    both = both.persist()  # one row a pair, read by every permutation
    names = both.select(F.col("x").alias("item")).union(both.select("y")).distinct()
    moves = names.select(F.lit(0).alias("perm_id"), "item", F.col("item").alias("other")).union(permuted(names, n_perm, seed).select("perm_id", "item", "other"))
    mx, my = moves.select("perm_id", F.col("item").alias("x"), F.col("other").alias("u")), moves.select("perm_id", F.col("item").alias("y"), F.col("other").alias("v"))
    moved = both.select("x", "y", "da").join(mx, "x").join(my, ["perm_id", "y"]).select("perm_id", F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"), "da")
    r = moved.join(both.select("x", "y", "db"), ["x", "y"]).groupBy("perm_id").agg(F.corr("da", "db").alias("r"), F.count("*").alias("n"))
    seen = r.filter("perm_id = 0").select(F.col("r").alias("r0"), F.col("n").alias("n_pairs"))
    more = r.filter("perm_id > 0").crossJoin(seen).agg(F.count_if(F.abs("r") >= F.abs("r0") - 1e-12).alias("extreme"), F.count("*").alias("m"))
    return seen.crossJoin(more).select(F.col("r0").alias("r"), ((F.col("extreme") + 1) / (F.col("m") + 1)).alias("p"), "n_pairs")


def square(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """The upper triangle as a square table, 0 on the diagonal."""
    both = pairs.select(F.col(a).alias("name"), F.col(b).alias("other"), value).union(pairs.select(F.col(b), F.col(a), value))
    names = both.select("name").distinct()
    return both.union(names.select("name", F.col("name").alias("other"), F.lit(0.0))).groupBy("name").pivot("other").agg(F.first(value)).orderBy("name")
