"""FASTA, character, allele, mutation and expression tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def read_fasta(spark: SparkSession, source: str) -> DataFrame:
    """(aln_id, row_ord, name, seq) from files or from literal FASTA text; a name is its header's first word."""
    if source.lstrip().startswith(">"):
        text = spark.createDataFrame([("aln", source)], "aln_id string, value string")
    else:
        text = spark.read.text(source, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("aln_id"), "value")
    entry = text.select("aln_id", F.posexplode(F.split(F.concat(F.lit("\n"), F.regexp_replace("value", "\r", "")), "\n>")).alias("k", "e")).filter("k > 0")
    return entry.select("aln_id", (F.col("k") - 1).alias("row_ord"), F.split(F.substring_index("e", "\n", 1), r"\s+")[0].alias("name"), F.regexp_replace(F.expr("substr(e, length(substring_index(e, '\n', 1)) + 2)"), r"\s", "").alias("seq"))


def to_fasta(aln: DataFrame, width: int = 60) -> DataFrame:
    """(aln_id, row_ord, fasta): an entry a row, wrapped."""
    return aln.select("aln_id", "row_ord", F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")).alias("fasta"))


def write_fasta(aln: DataFrame, path: str, width: int = 60) -> None:
    to_fasta(aln, width).orderBy("aln_id", "row_ord").select("fasta").write.text(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TSV with a header, all columns as text."""
    return spark.read.csv(path, header=True, sep="\t" if path.endswith((".tsv", ".txt")) else ",")


def character_matrix(table: DataFrame, taxa_col: str | None = None, missing: list[str] | None = None) -> DataFrame:
    """(name, character, ord, state, code, symbol): states of a column coded in order of their text; missing ones are -1 and '?'."""
    taxa_col = taxa_col or table.columns[0]
    columns = [c for c in table.columns if c != taxa_col]
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    long = table.select(F.col(taxa_col).cast("string").alias("name"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot("name", columns, "character", "state")
    gone = F.col("state").isNull() | (F.lower("state") == "nan") | (F.col("state").isin(missing) if missing else F.lit(False))
    long = long.withColumn("state", F.when(~gone, F.col("state"))).withColumn("ord", order[F.col("character")])
    codes = long.filter("state is not null").select("character", "state").distinct().withColumn("code", F.dense_rank().over(Window.partitionBy("character").orderBy("state")) - 1)
    fine = F.assert_true(F.col("code") < len(SYMBOLS), F.lit("a character has more states than symbols")).isNull()
    return _coded(long, codes.filter(fine))


def _coded(long: DataFrame, codes: DataFrame) -> DataFrame:
    out = long.join(codes, ["character", "state"], "left").withColumn("code", F.coalesce("code", F.lit(-1)))
    return out.select("name", "character", "ord", "state", "code", F.when(F.col("code") < 0, "?").otherwise(F.substring(F.lit(SYMBOLS), F.col("code") + 1, F.lit(1))).alias("symbol"))


def as_alignment(coded: DataFrame, aln_id: str = "matrix") -> DataFrame:
    """The symbols of coded characters as an alignment, rows in order of name."""
    seq = coded.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "symbol"))), lambda x: x["symbol"]), "").alias("seq"))
    return seq.select(F.lit(aln_id).alias("aln_id"), (F.row_number().over(Window.orderBy("name")) - 1).alias("row_ord"), "name", "seq")


def _with_ancestor(long: DataFrame) -> DataFrame:
    """Codes with the ancestral state at 0 whether or not it is seen; derived states from 1 in order of their text."""
    derived = long.filter("state is not null and not ancestral").select("character", "state").distinct().withColumn("code", F.dense_rank().over(Window.partitionBy("character").orderBy("state")))
    out = long.join(derived, ["character", "state"], "left").withColumn("code", F.when(F.col("state").isNull(), -1).when(F.col("ancestral"), 0).otherwise(F.col("code")))
    return out.select("name", "character", "ord", "state", "code", F.when(F.col("code") < 0, "?").otherwise(F.substring(F.lit(SYMBOLS), F.col("code") + 1, F.lit(1))).alias("symbol"))


def mutation_matrix(table: DataFrame, taxa_col: str | None = None, wild_type: str = "WT", missing: list[str] | None = None) -> DataFrame:
    """As character_matrix, with the wild type coded 0."""
    x = character_matrix(table, taxa_col, missing).select("name", "character", "ord", "state")
    return _with_ancestor(x.withColumn("ancestral", F.col("state") == wild_type))


def allele_table(table: DataFrame, cell_col: str = "cellBC", intbc_col: str = "intBC", site_cols: tuple[str, ...] = ("r1", "r2", "r3"), missing_markers: tuple[str, ...] = ("NC",)) -> DataFrame:
    """One character for each target and site: the edit in brackets, [None] ancestral (0), missing where a
    cell lacks the target.  Rows that repeat a cell and target must agree: one aggregate looks for those that
    do not before the plan is made, and a ValueError names one."""
    key = [F.col(cell_col).alias("name"), F.col(intbc_col).alias("target")]
    t = table.select(*key, *[F.col(c).cast("string").alias(c) for c in site_cols])
    agree = t.groupBy("name", "target").agg(F.max(F.struct(*site_cols)).alias("a"), F.min(F.struct(*site_cols)).alias("b"))
    if (odd := agree.filter(~F.col("a").eqNullSafe(F.col("b"))).select("name", "target").first()) is not None:
        raise ValueError(f"rows of a cell and target disagree: {odd.name}, {odd.target}")
    long = agree.select("name", "target", "a.*").unpivot(["name", "target"], list(site_cols), "site", "value")
    edit = F.array_join(F.expr(r"regexp_extract_all(value, '\\[([^\\]]*)\\]', 1)"), "|")
    edit = F.when(F.col("value").isNull() | F.col("value").isin(*missing_markers), None).when(edit == "", F.col("value")).otherwise(edit)
    long = long.select("name", F.concat_ws("|", "target", "site").alias("character"), edit.alias("state"))
    characters = long.select("character").distinct().withColumn("ord", F.row_number().over(Window.orderBy("character")) - 1)
    grid = long.select("name").distinct().crossJoin(characters).join(long, ["name", "character"], "left")
    return _with_ancestor(grid.withColumn("ancestral", F.col("state").rlike(r"^None(\|None)*$")))


def expression_rows(table: DataFrame, cell_col: str | None = None) -> DataFrame:
    """A cells x genes table to (cell, gene, value)."""
    cell_col = cell_col or table.columns[0]
    genes = [c for c in table.columns if c != cell_col]
    return table.select(F.col(cell_col).cast("string").alias("cell"), *[F.col(f"`{g}`").cast("double").alias(g) for g in genes]).unpivot("cell", genes, "gene", "value")
