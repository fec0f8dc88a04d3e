"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of falling ids.  A run is a bucketed, sorted table (h1, h2, n_docs, last): a
line's 128-bit hash, in how many documents of its batches it stands, and, in the one run in which the key
was new, the document that keeps the line.  Each new batch is merge-anti-joined with the runs: keys that no
run holds are new, and since later batches have smaller ids only, the batch's largest id is the keeper for
good; keys that a run holds add a count without a keeper.  Both make the batch's own level-0 run.  As soon
as a level holds ``fanout`` runs they are merged into one run of the next level, so a key is rewritten a
logarithmic number of times.  Runs are bucketed alike by the hash, so the anti-join and the merge read
co-located buckets.  Everything is DataFrame operations; no group is collected, and a line that stands in
a third of all documents is one row of a run.

Scale.  Lines move as hashes, once to be counted and once to be judged; lines that stand in many documents
are few by arithmetic and are judged by a broadcast, all others by a shuffled join in which no key holds
more than a small part of the rows.  Texts are exchanged once.  Batches are ranges of ids (quantiles of the
ids, which say how evenly the work is dealt, not what comes out), each read from a folder of its own.
Runs and other tables of the operator are dropped when the verdicts are written.

Edge cases: a null or empty text is one empty line; lines are told apart by their key (blanks at
both ends dropped, A-Z lower-cased); lines whose key is shorter than ``min_chars`` always stay;
the same line twice in one document counts once and goes or stays as a whole; rows that repeat a
doc_id count as one document; rows with a null doc_id are kept whole and not counted; an empty
table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _skew, _store

KEY = ["h1", "h2"]
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_key(lines: DataFrame, line: str = "line", min_chars: int = 20) -> DataFrame:
    """lines with the two halves of their key's hash; those with too short a key go."""
    key = F.translate(F.btrim(F.col(line), F.lit(BLANKS)), UPPER, LOWER)
    return lines.withColumn("_key", key).filter(F.length("_key") >= min_chars).withColumns({"h1": F.xxhash64("_key"), "h2": F.xxhash64(F.lit(7), "_key")}).drop("_key", line)


@dataclass
class LineRuns:
    """The runs of one index: tables in the shared folder, by level."""

    spark: SparkSession
    path: str
    fanout: int = 2
    buckets: int | None = None
    levels: dict[int, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @property
    def tables(self) -> list[str]:
        return [t for level in sorted(self.levels) for t in self.levels[level]]

    def run(self, table: str) -> DataFrame:
        return self.spark.table(table)

    def _write(self, df: DataFrame) -> str:
        name = f"sylva_run_{uuid.uuid4().hex[:12]}"
        df.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        _store.remove(self.spark, f"{self.path}/{table}")

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch (with h1, h2) whose key no run holds as its own."""
        for table in self.tables:
            batch = batch.join(self.run(table).filter("last is not null").select(*KEY), KEY, "left_anti")
        return batch

    def add(self, counted: DataFrame) -> None:
        """Add a batch's (h1, h2, n_docs, last), a row a key, as a run of its own; then compact.

        Only keys that no run holds bring their ``last``; for the others the run that has it stands."""
        staged = self._write(counted.select(*KEY, "n_docs", "last"))
        if self.tables:
            fresh = self.unseen(self.run(staged).select(*KEY, "last"))
            table = self._write(self.run(staged).drop("last").join(fresh, KEY, "left"))
            self._drop(staged)
        else:
            table = staged
        self.levels.setdefault(0, []).append(table)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            self.levels.setdefault(level + 1, []).append(self._merged(self.levels.pop(level)))
            level += 1

    def _merged(self, tables: list[str]) -> str:
        rows = self.run(tables[0])
        for t in tables[1:]:  # keys are unique in a run, so this is a merge of sorted buckets
            other = self.run(t).select(*KEY, *(F.col(c).alias(f"_{c}") for c in ("n_docs", "last")))
            zero = F.lit(0).cast("long")
            rows = rows.join(other, KEY, "full").select(*KEY, (F.coalesce("n_docs", zero) + F.coalesce("_n_docs", zero)).alias("n_docs"), F.coalesce("_last", "last").alias("last"))
        table = self._write(rows)
        for t in tables:
            self._drop(t)
        return table

    def compact(self) -> DataFrame:
        """Merge all runs into one and return it: a row for each key."""
        if len(self.tables) > 1:
            top = max(self.levels)
            table = self._merged(self.tables)
            self.levels = {top + 1: [table]}
        return self.run(self.tables[0])

    def drop(self) -> None:
        """Drop all runs and their files."""
        for t in self.tables:
            self._drop(t)
        self.levels = {}


def dedup_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text), a row for each row of documents.

    A line whose key has min_chars code points or more and stands in min_docs documents or more
    goes from all of them but that with the largest id.
    """
    spark = documents.sparkSession
    path = _store.work_dir(spark, "lines")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = docs.filter("doc_id is not null")
    cuts = named.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = sum(((F.col("doc_id") <= cut).cast("int") for cut in set(cuts)), F.lit(0))  # 0: the largest ids
    split = F.split("text", "\n", -1)
    lines = with_key(named.select("doc_id", batch.alias("batch"), F.posexplode(split).alias("at", "line")), "line", min_chars)
    lines.groupBy("batch", "doc_id", *KEY).agg(F.collect_set("at").alias("at")).write.partitionBy("batch").parquet(f"{path}/lines")
    lines = spark.read.schema("doc_id long, h1 long, h2 long, at array<int>, batch int").parquet(f"{path}/lines")

    runs = LineRuns(spark, path)
    for b in range(len(set(cuts)) + 1):
        runs.add(lines.filter(F.col("batch") == b).groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last")))
    known = runs.compact().filter(F.col("n_docs") >= min_docs)
    gone = _skew.lookup(lines, known, KEY, "n_docs").filter("doc_id <> last").groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("gone"))
    gone = _store.saved(gone, f"{path}/gone")
    runs.drop()
    _store.remove(spark, f"{path}/lines")
    judged = named.join(gone.hint("merge"), "doc_id", "left").unionByName(docs.filter("doc_id is null").withColumn("gone", F.lit(None).cast("array<int>")))  # one plan at every size
    kept = "transform(array(split(text, '\\n', -1)), l -> array_join(transform(array_except(sequence(0, size(l) - 1), gone), i -> l[i]), '\\n'))[0]"
    return judged.select("doc_id", F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.expr(kept)).alias("kept_text"))
