"""Benchmark decontamination by SimHash of item-sized windows.

Words are those of lower-cased (A-Z) text; features are k-word shingles, as often as they occur.
For each size m that benchmark items have (in shingles), every window of m shingles of a document that holds
at least one shingle of an item of that size is fingerprinted, wherever the shingle stands in the one and in
the other; a window without any has similarity 0 with all such items.  A text shorter than an item is one
window.  A fingerprint is the 64-bit SimHash of the window's weighted shingles.  A multi-index of radius + 1
bit blocks, by size, finds every pair of window and item within the Hamming radius, since at least one block
of such a pair is equal; pairs found are then compared exactly by weighted Jaccard similarity (sum of least
over sum of greatest counts).

Radius.  Shingles with similarity 0.8 have a cosine of about 0.89, hence 9.7 differing bits of 64
on average.  By exact vote and binomial tails a window at 0.8 is beyond the default of 24 in
4e-7 to 2.5e-6 of cases for items of 9 to 180 shingles (beyond 20: 8e-5 to 2.9e-4); shorter items
can reach 0.8 only by being equal.

Scale.  Documents without a benchmark shingle leave in the scan, by a Bloom filter of 64 bits a benchmark
shingle that goes with the plan as one array; a pass takes up to ``block_shingles`` benchmark shingles
(16 MB at the default), so the corpus is read once unless the benchmark is larger than that.  Whole texts are
never shuffled; shingles of documents that are left are.  Tables of the benchmark are broadcast when they
hold no more than ``small`` rows, else joined by a shuffle.  A window's fingerprint adds up bit counts packed
several to a 64-bit word, as wide as the largest item needs.

Edge cases: null and empty texts match nothing and are clean; texts and items shorter than k
words have one shingle, the whole; an empty benchmark leaves all clean; repeated rows and null
ids stay as they are; each row is judged by its own text, whatever its doc_id, so a row is named by
its id and a hash of its text; null items are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from . import _store

BITS = 64
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingle_sql(k: int) -> str:
    """Array of shingle hashes, in order, of the column ``text``."""
    hashes = rf"transform(filter(split({_LOWER}, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), w -> xxhash64(w))"
    steps = ", ".join(f"h[i + {j}]" for j in range(k))
    whole = "xxhash64(aggregate(h, 0L, (a, x) -> xxhash64(a, x)))"
    return f"transform(array({hashes}), h -> CASE WHEN size(h) >= {k} THEN transform(sequence(0, size(h) - {k}), i -> xxhash64({steps})) WHEN size(h) > 0 THEN array({whole}) ELSE array() END)[0]"


#: SimHash of the shingle array ``s``: bit b is set if more than half of the occurrences have it.
SIMHASH = f"aggregate(sequence(0, {BITS - 1}), 0L, (acc, b) -> acc | shiftleft(CASE WHEN 2 * aggregate(s, 0L, (c, x) -> c + (shiftright(x, b) & 1L)) > size(s) THEN 1L ELSE 0L END, b))"

#: Weighted Jaccard similarity of the shingle arrays ``s`` and ``item_s``; where none repeats, a count of those shared says it.
SIMILARITY = """CASE WHEN size(array_distinct(s)) = size(s) AND size(array_distinct(item_s)) = size(item_s)
  THEN CAST(size(array_intersect(s, item_s)) AS DOUBLE) / (size(s) + size(item_s) - size(array_intersect(s, item_s)))
  ELSE transform(array(transform(array_distinct(concat(s, item_s)), e -> struct(size(filter(s, x -> x = e)) AS a, size(filter(item_s, x -> x = e)) AS b))),
    c -> CAST(aggregate(c, 0L, (t, x) -> t + least(x.a, x.b)) AS DOUBLE) / aggregate(c, 0L, (t, x) -> t + greatest(x.a, x.b)))[0] END"""

#: First shingles of the windows of r.m shingles, of ``n`` in the text, that hold one of the sorted places r.at: each once.
STARTS = """flatten(transform(r.at, (p, i) -> transform(array(struct(greatest(p - r.m + 1, IF(i > 0, r.at[i - 1] + 1, 0), 0) AS lo, least(p, greatest(n - r.m, 0)) AS hi)),
  x -> IF(x.lo <= x.hi, sequence(x.lo, x.hi), CAST(array() AS array<int>)))[0]))"""


def windows_sql(largest: int) -> str:
    """Array of (m, start, g) from the shingles ``s``, their number ``n`` and ``runs`` of (m, at): g is the window's SimHash.

    Counts of bits stand in lanes of a 64-bit word, wide enough for ``largest``; a window's are summed a word at a time."""
    wide = max(8, int(largest).bit_length())
    lanes = 63 // wide
    words = -(-BITS // lanes)
    packed = " | ".join(f"shiftleft(shiftright(x, q * {lanes} + {i}) & 1L, {i * wide})" for i in range(lanes))
    sums = "transform(e, c -> aggregate(slice(c, st + 1, r.m), 0L, (t, v) -> t + v))"
    count = f"shiftrightunsigned(c[CAST(b DIV {lanes} AS INT)], {wide} * (b % {lanes})) & {(1 << wide) - 1}L"
    folded = f"transform(array({sums}), c -> aggregate(sequence(0, {BITS - 1}), 0L, (acc, b) -> acc | IF(2 * ({count}) > least(r.m, n), shiftleft(1L, b), 0L)))[0]"
    made = f"flatten(transform(runs, r -> transform({STARTS}, st -> struct(r.m AS m, st AS start, {folded} AS g))))"
    return f"transform(array(transform(sequence(0, {words - 1}), q -> transform(s, x -> {packed}))), e -> {made})[0]"


#: Probes of the Bloom filter: bits of a shingle's hash from these shifts up.
_PROBES = (0, 9, 18, 27, 36)


def filter_words(n: int) -> int:
    """64-bit words of a filter of n shingles: a power of two, a word a shingle or more."""
    return 1 << int(max(1, n) - 1).bit_length()


def bloom(spark: SparkSession, shingles: np.ndarray) -> Column:
    """Array literal with the filter's words."""
    n = 64 * filter_words(len(shingles))
    bits = np.zeros(n, bool)
    for shift in _PROBES:
        bits[(shingles.view(np.uint64) >> np.uint64(shift)) & np.uint64(n - 1)] = True
    words = np.packbits(bits, bitorder="little").view("<i8").astype(">i8")
    out = spark.sparkContext._gateway.new_array(spark._jvm.long, len(words))
    spark._jvm.java.nio.ByteBuffer.wrap(bytearray(words.tobytes())).asLongBuffer().get(out)
    return ClassicColumn(spark._jvm.org.apache.spark.sql.functions.lit(out))


def held_sql(n: int) -> str:
    """Whether the filter ``bits`` of n shingles may hold x; none that it was made of is missed."""
    at = [f"(shiftrightunsigned(x, {shift}) & {64 * filter_words(n) - 1}L)" for shift in _PROBES]
    return " AND ".join(f"shiftrightunsigned(bits[CAST(shiftrightunsigned({a}, 6) AS INT)], CAST({a} & 63L AS INT)) & 1L = 1L" for a in at)


def blocks_sql(radius: int, column: str) -> str:
    """The radius + 1 bit blocks of a fingerprint, each with its number."""
    cuts = [round(BITS * i / (radius + 1)) for i in range(radius + 2)]
    return "array(" + ", ".join(f"struct({i} AS block, shiftrightunsigned({column}, {lo}) & {(1 << (hi - lo)) - 1}L AS bits)" for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))) + ")"


def _digest(text_col: str):
    return F.xxhash64(F.col(text_col).cast("string"))


def leaks(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, start, similarity): the windows that hold a benchmark item; start counts words from 0.  Options are those of _leaks."""
    return _leaks(documents, benchmark, **options).drop("digest")


def _leaks(documents: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 24, block_shingles: int = 2_000_000, small: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """leaks with the hash of the row's text (digest); windows of rows that share id and text are one."""
    spark = documents.sparkSession
    path = _store.work_dir(spark, "leaks")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    items = items.filter("text is not null").select("item_id", F.expr(shingle_sql(k)).alias("s")).filter("size(s) > 0").withColumn("item", F.monotonically_increasing_id())
    items = _store.saved(items.select("item", "item_id", "s", F.expr(SIMHASH).alias("f"), F.size("s").alias("m")), f"{path}/items")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").select("doc_id", F.expr(shingle_sql(k)).alias("s"), "text")
    total, largest = items.agg(F.sum("m"), F.max("m")).first()
    n_blocks = -(-(total or 0) // block_shingles)
    found = None
    for block in range(n_blocks):
        mine = F.pmod(F.xxhash64("x"), F.lit(n_blocks)) == block  # every shingle is in one pass: a huge item is dealt over all
        by_size = _store.saved(items.select(F.explode("s").alias("x"), "m").filter(mine).distinct(), f"{path}/sizes{block}")
        wanted = by_size.select("x").distinct().toPandas()["x"].to_numpy(np.int64)  # about block_shingles at most
        if not len(wanted):
            continue
        hits = F.expr(f"filter(transform(s, (x, i) -> IF({held_sql(len(wanted))}, i, -1)), i -> i >= 0)")
        hit = docs.select("doc_id", F.xxhash64("text").alias("digest"), "s", bloom(spark, wanted).alias("bits")).select("doc_id", "digest", "s", hits.alias("hits")).filter("size(hits) > 0")
        hit = _store.saved(hit.withColumn("row", F.monotonically_increasing_id()), f"{path}/hit{block}")
        few = lambda table: F.broadcast(table) if table.count() <= small else table
        places = hit.select("row", F.expr("explode(transform(hits, i -> struct(i AS at, s[i] AS x)))").alias("h")).select("row", "h.at", "h.x").join(few(by_size), "x")
        runs = places.groupBy("row", "m").agg(F.sort_array(F.collect_set("at")).alias("at")).groupBy("row").agg(F.collect_list(F.struct("m", "at")).alias("runs"))
        laid = hit.select("row", "s", F.size("s").alias("n")).join(runs, "row").select("row", F.expr(f"inline({windows_sql(largest)})"))
        index = items.select("m", "item", "f", F.explode(F.expr(blocks_sql(radius, "f"))).alias("b")).select("m", "item", "f", "b.block", "b.bits")
        near = laid.select("row", "start", "m", "g", F.explode(F.expr(blocks_sql(radius, "g"))).alias("b")).select("row", "start", "m", "g", "b.block", "b.bits")
        near = near.join(few(index), ["m", "block", "bits"]).filter(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius)
        near = _store.saved(near.select("row", "item", "m", "start").distinct(), f"{path}/near{block}")
        near = near.join(hit.select("row", "doc_id", "digest", F.col("s").alias("whole")), "row").join(few(items.select("item", "item_id", F.col("s").alias("item_s"))), "item")
        near = near.select("doc_id", "digest", "item", "item_id", "start", F.expr("slice(whole, start + 1, m)").alias("s"), "item_s")
        near = near.select("doc_id", "digest", "item", "item_id", "start", F.expr(SIMILARITY).alias("similarity")).filter(F.col("similarity") >= similarity)
        near = _store.saved(near.dropDuplicates(["doc_id", "digest", "item", "start"]).drop("item"), f"{path}/found{block}")
        _store.remove(spark, f"{path}/hit{block}")
        _store.remove(spark, f"{path}/near{block}")
        found = near if found is None else found.union(near)
    if found is None:
        return spark.createDataFrame([], "doc_id long, digest long, item_id long, start int, similarity double")
    return found.distinct() if n_blocks > 1 else found


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, contaminated, kept, n_items, n_windows, similarity), a row for each row of documents; kept: not contaminated."""
    found = _leaks(documents, benchmark, id_col=id_col, text_col=text_col, **options).groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count_distinct("item_id").alias("n_items"), F.count("*").alias("n_windows"), F.max("similarity").alias("similarity"))
    ids = documents.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col).alias("digest"))
    out = ids.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.col("n_items").isNull().alias("kept"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item."""
    bad = _leaks(documents, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_bad_id"), F.col("digest").alias("_bad_digest")).distinct()
    return documents.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("_bad_id")) & (_digest(text_col) == F.col("_bad_digest")), "left_anti")
