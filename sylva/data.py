"""The driver's tables seen as trees, communities, alignments, traits and networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sources.newick import parse


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def geo(spark: SparkSession, sf: str, by: str = "n_regionkey", tree_id: str = "geo") -> DataFrame:
    """Nations under regions (or under another grouping of their keys), read from newick made of the tables."""
    tips = table(spark, sf, "nation").select("n_nationkey", F.expr(by).cast("int").alias("g"), F.format_string("'%s':%s", "n_name", (0.5 + F.pmod("n_nationkey", F.lit(8)) / 8.0).cast("string")).alias("t"))
    names = table(spark, sf, "region").select(F.col("r_regionkey").alias("g"), F.col("r_name") if by == "n_regionkey" else F.concat(F.lit("group"), F.col("r_regionkey").cast("string")).alias("r_name"))
    ordered = lambda k, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v]), ",")
    inner = tips.groupBy("g").agg(ordered("n_nationkey", "t").alias("c")).join(names, "g").select("g", F.concat(F.lit("("), "c", F.lit(")'"), F.col(names.columns[1]), F.lit("':"), (1 + F.col("g") / 8.0).cast("string")).alias("t"))
    text = inner.agg(F.concat(F.lit("("), ordered("g", "t"), F.lit(");")).alias("newick")).select(F.lit(tree_id).alias("tree_id"), "newick")
    return parse(text)


def two_trees(spark: SparkSession, sf: str) -> DataFrame:
    """The nations by region, and by blocks of five keys."""
    return geo(spark, sf).unionByName(geo(spark, sf, "n_nationkey div 5", "geo2"))


def orders_of_nations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, "c_nationkey")


def community(spark: SparkSession, sf: str, sample: str = "priority") -> DataFrame:
    """(sample, taxon, abundance): orders of each nation, by segment and priority, or by segment and month."""
    o = orders_of_nations(spark, sf)
    key = F.concat_ws("|", "c_mktsegment", "o_orderpriority") if sample == "priority" else F.concat_ws("|", "c_mktsegment", F.date_format("o_orderdate", "yyyy-MM"))
    return o.groupBy(key.alias("sample"), F.col("nation").alias("taxon")).agg(F.count("*").cast("double").alias("abundance"))


def alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Nations x months: the month's orders modulo four as a base, a gap where there is none."""
    n = orders_of_nations(spark, sf).groupBy("nation", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    grid = n.select("nation").distinct().crossJoin(n.select("month").distinct()).join(n, ["nation", "month"], "left")
    ch = F.when(F.col("n").isNull(), "-").otherwise(F.substring(F.lit("ACGT"), F.pmod("n", F.lit(4)).cast("int") + 1, F.lit(1)))
    seq = grid.groupBy("nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", ch.alias("c")))), lambda x: x["c"]), "").alias("seq"))
    return seq.select(F.lit("orders").alias("aln_id"), (F.row_number().over(Window.orderBy("nation")) - 1).alias("row_ord"), F.col("nation").alias("name"), "seq")


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """A marker a priority: nations x years, only nations with a customer of that priority above the mean order."""
    o = orders_of_nations(spark, sf)
    n = o.groupBy("o_orderpriority", "nation", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    years = n.select("y").distinct()
    grid = n.select("o_orderpriority", "nation").distinct().crossJoin(years).join(n, ["o_orderpriority", "nation", "y"], "left")
    ch = F.when(F.col("n").isNull(), "-").otherwise(F.substring(F.lit("ACGT"), F.pmod("n", F.lit(4)).cast("int") + 1, F.lit(1)))
    seq = grid.groupBy("o_orderpriority", "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", ch.alias("c")))), lambda x: x["c"]), "").alias("seq"))
    return seq.select(F.col("o_orderpriority").alias("marker"), F.substring("o_orderpriority", 1, 1).cast("int").alias("marker_ord"), F.col("nation").alias("name"), "seq")


def traits(spark: SparkSession, sf: str) -> DataFrame:
    """(name, value): exact sum of each nation's account balances."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("name")).agg(F.sum(F.col("c_acctbal").cast("decimal(15,2)")).cast("double").alias("value"))


def expression(spark: SparkSession, sf: str) -> DataFrame:
    """(cell, gene, value): mean embedding of each label by dimension."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy(F.concat(F.lit("label"), F.col("label").cast("string")).alias("cell"), F.concat(F.lit("g"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("gene")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("value"))


def alleles(spark: SparkSession, sf: str) -> DataFrame:
    """(cellBC, intBC, r1, r2): edits named by the least and greatest k of a user's events of a type."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    g = e.groupBy("user_id", "event_type").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    site = lambda c: F.when(F.col(c).isNull(), "NC").when(F.pmod(c, F.lit(4)) == 0, "AA[None]TT").otherwise(F.concat(F.lit("AA["), F.col(c).cast("string"), F.lit("D]TT")))
    return g.select(F.col("user_id").cast("string").alias("cellBC"), F.col("event_type").alias("intBC"), site("a").alias("r1"), site("b").alias("r2"))


def characters(spark: SparkSession, sf: str) -> DataFrame:
    """(name, segment, priority, status): each nation's commonest values, as a character matrix."""
    o = orders_of_nations(spark, sf)
    top = lambda c: o.groupBy("nation", F.col(c).alias("v")).agg(F.count("*").alias("n")).groupBy("nation").agg(F.max_by("v", F.struct("n", "v")).alias(c))
    return top("c_mktsegment").join(top("o_orderpriority"), "nation").select(F.col("nation").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"))
