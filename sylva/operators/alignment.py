"""Alignments as tables: (aln_id, row_ord, name, seq), and sites (aln_id, row_ord, name, col, ch).

Column statistics are two-level aggregates with map-side combine; pairs of rows are compared in
place with array functions, one row a pair, not one a pair and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAPS = "-.N"


def validate(aln: DataFrame) -> DataFrame:
    """The alignment, if its rows are equally long and named uniquely; evaluated where it is read."""
    seen = aln.groupBy("aln_id").agg(F.count_distinct(F.length("seq")).alias("w"), F.count("*").alias("n"), F.count_distinct("name").alias("u"))
    fine = F.assert_true((F.col("w") == 1) & (F.col("n") == F.col("u")), F.lit("rows of an alignment have one length and unique names")).isNull()
    return aln.join(seen.filter(fine).select("aln_id"), "aln_id", "left_semi")


def sites(aln: DataFrame) -> DataFrame:
    return aln.select("aln_id", "row_ord", "name", F.posexplode(F.split("seq", "")).alias("col", "ch")).filter("ch <> ''")


def from_sites(s: DataFrame, order: str = "col") -> DataFrame:
    """Rows again from sites; columns in ascending order."""
    return s.groupBy("aln_id", "row_ord", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), "ch"))), lambda x: x["ch"]), "").alias("seq"))


def column(aln: DataFrame, j: int) -> DataFrame:
    return aln.select("aln_id", "row_ord", "name", F.substring("seq", j + 1, 1).alias("ch"))


def select_columns(aln: DataFrame, columns: list[int]) -> DataFrame:
    """Columns by index, in the order given, repeats allowed."""
    picked = F.array_join(F.transform(F.array(*[F.lit(c) for c in columns]), lambda i: F.col("seq").substr(i + 1, F.lit(1))), "") if columns else F.lit("")
    return aln.withColumn("seq", picked)


def guess_type(aln: DataFrame) -> DataFrame:
    """(aln_id, seqtype): nucleotide if over 90 % of the first 2,000 characters are ACGTUN or gaps."""
    text = aln.groupBy("aln_id").agg(F.upper(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "seq"))), lambda x: x["seq"]), ""), 1, 2000)).alias("t"))
    return text.select("aln_id", F.when(F.length(F.regexp_replace("t", "[^ACGTUN-]", "")) > 0.9 * F.length("t"), "nucleotide").otherwise("protein").alias("seqtype"))


# -- trimming -----------------------------------------------------------------------------------


def column_statistics(aln: DataFrame) -> DataFrame:
    """(aln_id, col, gap_fraction, conservation): share of '-', and of the commonest other character among the others."""
    by_char = sites(aln).groupBy("aln_id", "col", "ch").agg(F.count("*").alias("n"))
    residue = F.when(F.col("ch") != "-", F.col("n"))
    return by_char.groupBy("aln_id", "col").agg((F.sum(F.when(F.col("ch") == "-", F.col("n")).otherwise(0)) / F.sum("n")).alias("gap_fraction"), F.coalesce(F.try_divide(F.max(residue), F.sum(residue)), F.lit(0.0)).alias("conservation"))


def trim_mask(aln: DataFrame, max_gap: float = 0.5, min_occupancy: float | None = None, min_conservation: float | None = None) -> DataFrame:
    keep = F.col("gap_fraction") <= max_gap
    if min_occupancy is not None:
        keep &= 1 - F.col("gap_fraction") >= min_occupancy
    if min_conservation is not None:
        keep &= F.col("conservation") >= min_conservation
    return column_statistics(aln).withColumn("keep", keep)


def _kept(aln: DataFrame, mask: DataFrame, min_length: int) -> DataFrame:
    columns = mask.filter("keep").groupBy("aln_id").agg(F.array_sort(F.collect_list("col")).alias("cols"))
    fine = F.assert_true(F.size(F.coalesce("cols", F.array())) >= min_length, F.lit("too few columns are left")).isNull()
    joined = aln.join(columns, "aln_id", "left").filter(fine)
    return joined.withColumn("seq", F.array_join(F.transform("cols", lambda i: F.col("seq").substr(i + 1, F.lit(1))), "")).select(*aln.columns)


def trim(aln: DataFrame, max_gap: float = 0.5, min_occupancy: float | None = None, min_conservation: float | None = None, min_length: int = 1) -> DataFrame:
    """Columns that meet the thresholds; an alignment with fewer than min_length of them is an error."""
    return _kept(aln, trim_mask(aln, max_gap, min_occupancy, min_conservation), min_length)


def trim_terminal_gaps(aln: DataFrame, max_gap: float = 0.9) -> DataFrame:
    """Without the gap-rich columns at both ends."""
    stats = column_statistics(aln)
    ends = stats.filter(F.col("gap_fraction") <= max_gap).groupBy("aln_id").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    return aln.join(ends, "aln_id").withColumn("seq", F.expr("substr(seq, lo + 1, hi - lo + 1)")).select(*aln.columns)


# -- distances ------------------------------------------------------------------------------------


def row_pairs(aln: DataFrame) -> DataFrame:
    r = aln.select("aln_id", "row_ord", "name", F.split(F.upper("seq"), "").alias("s"))
    a, b = (r.select("aln_id", F.col("row_ord").alias(f"i{x}"), F.col("name").alias(x), F.col("s").alias(f"s{x}")) for x in "xy")
    return a.join(b, "aln_id").filter("ix < iy")


def pair_counts(aln: DataFrame, gaps: str = GAPS) -> DataFrame:
    """(aln_id, x, y, n, same, transitions): sites where neither has a gap, equal ones, and purine or pyrimidine changes."""
    chars = "array(" + ",".join(f"'{c}'" for c in gaps) + ")"
    compared = f"filter(arrays_zip(sx, sy), p -> p.sx <> '' AND NOT array_contains({chars}, p.sx) AND NOT array_contains({chars}, p.sy))"
    x = row_pairs(aln).withColumn("p", F.expr(compared))
    change = "translate(p.sx, 'U', 'T') <> translate(p.sy, 'U', 'T') AND ((p.sx IN ('A','G') AND p.sy IN ('A','G')) OR (p.sx IN ('C','T','U') AND p.sy IN ('C','T','U')))"
    return x.select("aln_id", "x", "y", F.size("p").alias("n"), F.expr("size(filter(p, p -> p.sx = p.sy))").alias("same"), F.expr(f"size(filter(p, p -> {change}))").alias("transitions"))


def distance_matrix(aln: DataFrame, model: str = "jc69", gaps: str = GAPS) -> DataFrame:
    """(aln_id, x, y, d) of rows in order: raw, jc69, k2p or poisson, with the usual caps where they are undefined."""
    n, p = F.col("n"), 1 - F.try_divide(F.col("same"), F.col("n"))
    ts = F.col("transitions") / n
    tv = p - ts
    k2p = (1 - 2 * ts - tv) > 0
    value = {
        "raw": p,
        "jc69": F.when(p >= 0.74, 3.0).otherwise(-0.75 * F.log(1 - 4 * p / 3)),
        "k2p": F.when(k2p & ((1 - 2 * tv) > 0), -0.5 * F.log((1 - 2 * ts - tv) * F.sqrt(1 - 2 * tv))).otherwise(3.0),
        "poisson": F.when(p >= 0.9999, 5.0).otherwise(-F.log(1 - p)),
    }
    if model not in value:
        raise ValueError(f"model {model!r} is not one of {sorted(value)}")
    d = F.when(n == 0, 1.0).when(p == 0, 0.0).otherwise(value[model])
    return pair_counts(aln, gaps).select("aln_id", "x", "y", d.alias("d"))


def p_distance(aln: DataFrame) -> DataFrame:
    return distance_matrix(aln, "raw")


def kmer_distance(aln: DataFrame, k: int = 3) -> DataFrame:
    """(aln_id, x, y, d): 1 - shared k-mers / k-mers of the shorter; 1 where nothing is shared."""
    bare = aln.withColumn("s", F.translate(F.upper("seq"), "-", ""))
    grams = bare.filter(F.length("s") >= k).select("aln_id", "name", F.explode(F.expr(f"transform(sequence(1, length(s) - {k - 1}), i -> substr(s, i, {k}))")).alias("g")).groupBy("aln_id", "name", "g").agg(F.count("*").alias("c"))
    total = grams.groupBy("aln_id", "name").agg(F.sum("c").alias("t"))
    every = aln.select("aln_id", "row_ord", "name").join(total, ["aln_id", "name"], "left").na.fill(0, ["t"])
    pair = every.select("aln_id", F.col("row_ord").alias("i"), F.col("name").alias("x"), F.col("t").alias("tx")).join(every.select("aln_id", F.col("row_ord").alias("j"), F.col("name").alias("y"), F.col("t").alias("ty")), "aln_id").filter("i < j")
    both = grams.select("aln_id", F.col("name").alias("x"), "g", F.col("c").alias("cx")).join(grams.select("aln_id", F.col("name").alias("y"), "g", F.col("c").alias("cy")), ["aln_id", "g"]).filter("x <> y").groupBy("aln_id", "x", "y").agg(F.sum(F.least("cx", "cy")).alias("both"))
    return pair.join(both, ["aln_id", "x", "y"], "left").select("aln_id", "x", "y", F.coalesce(1 - F.try_divide(F.coalesce("both", F.lit(0)), F.least("tx", "ty")), F.lit(1.0)).alias("d"))


def identity_edges(aln: DataFrame, cutoff: float = 0.4) -> DataFrame:
    """(aln_id, x, y, w): pairs whose share of equal sites among comparable ones is above the cutoff."""
    return distance_matrix(aln, "raw").select("aln_id", "x", "y", (1 - F.col("d")).alias("w")).filter(F.col("w") > cutoff)


def site_patterns(aln: DataFrame) -> DataFrame:
    """(aln_id, pattern, weight, first_col): distinct columns with how often each occurs."""
    cols = sites(aln).groupBy("aln_id", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "ch"))), lambda x: x["ch"]), "").alias("pattern"))
    return cols.groupBy("aln_id", "pattern").agg(F.count("*").alias("weight"), F.min("col").alias("first_col"))


def parsimony_bounds(aln: DataFrame, missing: str = "-.?N") -> DataFrame:
    """(aln_id, least, most): bounds of the number of changes on any tree, for consistency and retention."""
    seen = sites(aln).filter(~F.col("ch").isin(*missing)).groupBy("aln_id", "col", "ch").agg(F.count("*").alias("n"))
    per = seen.groupBy("aln_id", "col").agg((F.count("*") - 1).alias("least"), (F.sum("n") - F.max("n")).alias("most"))
    return per.groupBy("aln_id").agg(F.sum("least").alias("least"), F.sum("most").alias("most"))


# -- markers and domains ------------------------------------------------------------------------------


def concatenate(markers: DataFrame, gap: str = "-") -> DataFrame:
    """(name, seq, occupancy): one row a taxon over markers (marker, marker_ord, name, seq), gaps where a marker lacks it."""
    width = markers.groupBy("marker", "marker_ord").agg(F.max(F.length("seq")).alias("w"))
    grid = markers.select("name").distinct().crossJoin(width).join(markers.select("marker", "name", "seq"), ["marker", "name"], "left")
    filled = F.coalesce("seq", F.repeat(F.lit(gap), F.col("w")))
    return grid.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("marker_ord", filled.alias("s")))), lambda x: x["s"]), "").alias("seq"), F.count("seq").alias("n_markers"), F.avg(F.col("seq").isNotNull().cast("int")).alias("occupancy"))


def partitions(markers: DataFrame) -> DataFrame:
    """(marker, start, end, n_taxa): where each marker lies in the supermatrix, half open."""
    width = markers.groupBy("marker", "marker_ord").agg(F.max(F.length("seq")).alias("w"), F.count("*").alias("n_taxa"))
    upto = F.sum("w").over(Window.orderBy("marker_ord"))
    return width.select("marker", (upto - F.col("w")).alias("start"), upto.alias("end"), "n_taxa")


def residue_columns(aln: DataFrame, reference: str, ranges: DataFrame) -> DataFrame:
    """(aln_id, domain, start, end): half-open columns of 1-based inclusive residue ranges (domain, lo, hi) of a row."""
    own = sites(aln.filter(F.col("name") == reference)).withColumn("residue", F.sum(F.when(F.col("ch").isin("-", "."), 0).otherwise(1)).over(Window.partitionBy("aln_id").orderBy("col"))).filter(~F.col("ch").isin("-", "."))
    return own.join(F.broadcast(ranges) if ranges.limit(10_001).count() <= 10_000 else ranges, F.col("residue").between(F.col("lo"), F.col("hi"))).groupBy("aln_id", "domain").agg(F.min("col").alias("start"), (F.max("col") + 1).alias("end"))


def split_domains(aln: DataFrame, bounds: DataFrame, min_columns: int = 1) -> DataFrame:
    """(aln_id, domain, row_ord, name, seq) of the columns start .. end of each domain."""
    fine = F.assert_true((F.col("start") >= 0) & (F.col("end") <= F.length("seq")) & (F.col("end") - F.col("start") >= min_columns), F.lit("a domain lies within the alignment")).isNull()
    on = [c for c in ("aln_id",) if c in bounds.columns]
    joined = aln.join(bounds, on) if on else aln.crossJoin(bounds)
    return joined.filter(fine).select("aln_id", "domain", "row_ord", "name", F.expr("substr(seq, start + 1, end - start)").alias("seq"))


def drop_empty_rows(domains: DataFrame, min_residues: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows with enough residues, (domain, name) of those dropped)."""
    n = F.length(F.regexp_replace("seq", "[-.]", ""))
    return domains.filter(n >= min_residues), domains.filter(n < min_residues).select("domain", "name")


# -- recombination --------------------------------------------------------------------------------------


def biallelic(aln: DataFrame, min_count: int = 2, missing: str = "-.NX?") -> DataFrame:
    """(aln_id, col, pos, row_ord, allele): columns with two states of min_count or more, pos counting
    these from 0; other states are null.  Equal counts rank by first appearance."""
    s = sites(aln).withColumn("ch", F.upper("ch"))
    known = s.filter(~F.col("ch").isin(*missing)).groupBy("aln_id", "col", "ch").agg(F.count("*").alias("n"), F.min("row_ord").alias("first"))
    ranked = known.withColumn("k", F.row_number().over(Window.partitionBy("aln_id", "col").orderBy(F.desc("n"), "first")))
    two = ranked.groupBy("aln_id", "col").agg(F.max(F.when(F.col("k") == 1, F.col("ch"))).alias("c0"), F.max(F.when(F.col("k") == 2, F.col("ch"))).alias("c1"), F.max(F.when(F.col("k") == 2, F.col("n"))).alias("n1"))
    two = two.filter(F.col("n1") >= min_count).withColumn("pos", F.row_number().over(Window.partitionBy("aln_id").orderBy("col")) - 1)
    return s.join(two, ["aln_id", "col"]).select("aln_id", "col", "pos", "row_ord", F.when(F.col("ch") == F.col("c0"), 0).when(F.col("ch") == F.col("c1"), 1).alias("allele"))


def four_gamete_pairs(alleles: DataFrame, window: int) -> DataFrame:
    """(aln_id, pos_a, pos_b, scored, incompatible) of informative sites at most window apart: all four gametes seen."""
    a = alleles.filter("allele is not null").select("aln_id", "row_ord", F.col("pos").alias("pos_a"), F.col("allele").alias("ga"))
    b = a.select("aln_id", "row_ord", F.col("pos_a").alias("pos_b"), F.col("ga").alias("gb"))
    near = a.select("*", F.explode(F.sequence(F.col("pos_a") + 1, F.col("pos_a") + window)).alias("pos_b"))
    both = near.join(b, ["aln_id", "row_ord", "pos_b"])
    return both.groupBy("aln_id", "pos_a", "pos_b").agg(F.bit_or(F.expr("shiftleft(1, 2 * ga + gb)")).alias("g"), F.count("*").alias("n")).select("aln_id", "pos_a", "pos_b", (F.col("n") >= 2).alias("scored"), (F.col("g") == 15).alias("incompatible"))


def four_gamete_scan(aln: DataFrame, window: int, min_count: int = 2, n_perm: int = 99, seed: int = 0) -> DataFrame:
    """(aln_id, n_sites, scored, incompatible, share, p): incompatible pairs within the window, against shuffled site orders."""
    from ..functions.draws import permuted

    alleles = biallelic(aln, min_count)
    n = alleles.groupBy("aln_id").agg((F.max("pos") + 1).alias("n_sites"))
    places = alleles.select("aln_id", "pos").distinct()
    everything = four_gamete_pairs(alleles, int(places.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]) + 1)
    named = places.select(F.concat_ws("|", "aln_id", F.col("pos").cast("string")).alias("item"), "aln_id", "pos")
    ids = [r.aln_id for r in places.select("aln_id").distinct().collect()]
    moves = None
    for i in ids:  # one permutation table an alignment
        own = permuted(named.filter(F.col("aln_id") == i).select("item"), n_perm, seed)
        moves = own if moves is None else moves.union(own)
    seen = everything.filter(F.col("pos_b") - F.col("pos_a") <= window).filter("scored").groupBy("aln_id").agg(F.count("*").alias("scored"), F.count_if("incompatible").alias("incompatible"))
    if moves is None:
        return n.join(seen, "aln_id").select("aln_id", "n_sites", "scored", "incompatible", F.lit(0.0).alias("share"), F.lit(1.0).alias("p"))
    part = lambda c, k: F.split(F.col(c), r"\|")[k]
    moves = moves.select("perm_id", part("item", 0).alias("aln_id"), part("item", 1).cast("int").alias("pos"), part("other", 1).cast("int").alias("to"))
    a, b = moves.select("perm_id", "aln_id", F.col("pos").alias("pos_a"), F.col("to").alias("ta")), moves.select("perm_id", "aln_id", F.col("pos").alias("pos_b"), F.col("to").alias("tb"))
    null = everything.filter("scored").join(a, ["aln_id", "pos_a"]).join(b, ["perm_id", "aln_id", "pos_b"]).filter(F.abs(F.col("ta") - F.col("tb")) <= window).groupBy("aln_id", "perm_id").agg(F.avg(F.col("incompatible").cast("int")).alias("null"))
    share = seen.withColumn("share", F.col("incompatible") / F.col("scored"))
    p = share.join(null, "aln_id").groupBy("aln_id", "scored", "incompatible", "share").agg(((F.count_if(F.col("null") >= F.col("share") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))
    return n.join(p, "aln_id").select("aln_id", "n_sites", "scored", "incompatible", "share", "p")


# -- codons ---------------------------------------------------------------------------------------------

# The standard genetic code, codons in the order TCAG at each position.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
STOPS = [c for c, a in zip(CODONS, CODE) if a == "*"]


def codons(aln: DataFrame) -> DataFrame:
    """(aln_id, name, pos, codon) of complete sense codons."""
    s = aln.select("aln_id", "name", F.translate(F.upper("seq"), "U", "T").alias("s"))
    x = s.filter("length(s) >= 3").select("aln_id", "name", F.posexplode(F.expr("transform(sequence(0, cast(length(s) / 3 as int) - 1), i -> substr(s, 3 * i + 1, 3))")).alias("pos", "codon"))
    return x.filter(F.col("codon").rlike("^[ACGT]{3}$") & ~F.col("codon").isin(*STOPS))


def codon_frequencies(aln: DataFrame) -> DataFrame:
    """(aln_id, codon, pi): F3x4, products of the nucleotides' shares at the three positions over the sense codons."""
    c = codons(aln).select("aln_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.substring("codon", k + 1, 1).alias("b")) for k in range(3)])).alias("x")).groupBy("aln_id", "x.k", "x.b").agg(F.count("*").alias("n"))
    share = c.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("aln_id", "k"))).select("aln_id", "k", "b", "f")
    one = lambda k: share.filter(F.col("k") == k).select("aln_id", F.col("b").alias(f"b{k}"), F.col("f").alias(f"f{k}"))
    x = one(0).join(one(1), "aln_id").join(one(2), "aln_id").select("aln_id", F.concat("b0", "b1", "b2").alias("codon"), (F.col("f0") * F.col("f1") * F.col("f2")).alias("p")).filter(~F.col("codon").isin(*STOPS))
    return x.select("aln_id", "codon", (F.col("p") / F.sum("p").over(Window.partitionBy("aln_id"))).alias("pi"))


# -- expression tables ------------------------------------------------------------------------------------


def expression_distance(expr: DataFrame, metric: str = "correlation", genes: list[str] | None = None) -> DataFrame:
    """(x, y, d) of cells x < y over (cell, gene, value): correlation, euclidean or cosine; correlation
    with a single gene falls back to euclidean."""
    e = expr.filter(F.col("gene").isin(genes)) if genes else expr
    if metric == "correlation" and e.select("gene").distinct().limit(2).count() < 2:
        metric = "euclidean"
    a, b = e.select(F.col("cell").alias("x"), "gene", F.col("value").alias("u")), e.select(F.col("cell").alias("y"), "gene", F.col("value").alias("v"))
    value: dict[str, Column] = {"correlation": 1 - F.corr("u", "v"), "euclidean": F.sqrt(F.sum((F.col("u") - F.col("v")) * (F.col("u") - F.col("v")))), "cosine": 1 - F.sum(F.col("u") * F.col("v")) / F.sqrt(F.sum(F.col("u") * F.col("u")) * F.sum(F.col("v") * F.col("v")))}
    if metric not in value:
        raise ValueError(f"metric {metric!r} is not one of {sorted(value)}")
    return a.join(b, "gene").filter("x < y").groupBy("x", "y").agg(value[metric].alias("d"))
