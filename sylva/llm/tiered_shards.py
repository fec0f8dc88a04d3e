"""Sharding by size-tiered compaction.

Arrivals are written as small immutable Parquet shards as they come.  Shards whose sizes lie
within a factor of ``fanout`` form a tier; as soon as a tier holds ``fanout`` of them they are
merged towards files of ``target_bytes``, so a row is rewritten a logarithmic number of times.
What is live is said by a versioned manifest: a new version is written under another name and
renamed to its number, which fails if that number is taken, so readers see the one or the other
and two writers cannot both commit; the one that comes second tries again over the new version.  Old
versions stay readable until ``expire`` lets them go, with the files that no later version lists.

Scale.  The driver holds one entry a shard.  A merge round is one job for all groups: rows are
exchanged by their group, whose bytes are bounded by the target whatever the source, so a source
with a third of all rows does not land in one task.  Shards at the target are never read again.

Edge cases: all columns are kept as they are, under their own names (names used inside are chosen so that
they clash with none, and what is read stands in a struct); null, empty and very long
texts are values as others are (a row larger than the target is a shard of its own size); repeated
rows stay; an empty arrival adds no shard; reading an empty store needs its schema and gives no row.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store


@dataclass(frozen=True)
class Shard:
    path: str
    n_bytes: int


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class TieredShards:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fanout: int = 4):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout

    # the manifest
    def version(self) -> int:
        fs, at = _store.filesystem(self.spark, f"{self.path}/manifest")
        return max((int(x.getPath().getName()[1:-5]) for x in fs.listStatus(at) if x.getPath().getName().startswith("v")), default=0) if fs.exists(at) else 0

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        fs, at = _store.filesystem(self.spark, f"{self.path}/manifest/v{version:010d}.json")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def commit(self, shards: list[Shard], over: int) -> int:
        """Publish version over + 1; Conflict if another writer was first."""
        jvm = self.spark._jvm
        fs, tmp = _store.filesystem(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps({"version": over + 1, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        _, final = _store.filesystem(self.spark, f"{self.path}/manifest/v{over + 1:010d}.json")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, final, options)
        except Exception as e:
            fs.delete(tmp, False)
            raise Conflict(f"version {over + 1} is there already") from e
        return over + 1

    # writing
    def _written(self, folder: str) -> list[Shard]:
        fs, at = _store.filesystem(self.spark, folder)
        found, files = [], fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet") and f.getLen():
                found.append(Shard(f.getPath().toString(), f.getLen()))
        return sorted(found, key=lambda s: s.path)

    def append(self, arrival: DataFrame) -> int:
        """One arrival's rows as small shards of their own; returns the version."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        arrival.write.option("compression", "zstd").parquet(folder)
        own = self._written(folder)
        while True:
            over = self.version()
            try:
                return self.commit(self.shards(over) + own, over)
            except Conflict:
                if self.version() == over:  # not another writer's doing
                    _store.remove(self.spark, folder)
                    raise

    def tier(self, shard: Shard) -> int:
        """Shards of a tier differ by less than the fanout; those near the target are done: -1."""
        if shard.n_bytes * 2 > self.target:
            return -1
        tier, size = 0, 1 << 20
        while shard.n_bytes >= size:
            size, tier = size * self.fanout, tier + 1
        return tier

    def groups(self, shards: list[Shard], final: bool = False) -> list[list[Shard]]:
        """Groups to merge: tiers with fanout shards or more, packed up to the target; finally whatever is below it."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if (t := self.tier(s)) >= 0:
                tiers.setdefault(0 if final else t, []).append(s)
        out = []
        for own in (tiers[t] for t in sorted(tiers)):
            if len(own) < (2 if final else self.fanout):
                continue
            group, size = [], 0
            for s in sorted(own, key=lambda s: (s.n_bytes, s.path)):
                if group and size + s.n_bytes > self.target:
                    out.append(group)
                    group, size = [], 0
                group, size = [*group, s], size + s.n_bytes
            out.append(group)
        return [g for g in out if len(g) > 1]

    def compact(self, final: bool = False) -> int:
        """Merge rounds until no tier is full; with final, also what is left below the target, once."""
        while True:
            over = self.version()
            shards = self.shards(over)
            groups = self.groups(shards)
            last = final and not groups
            if last:
                groups = self.groups(shards, True)
            if not groups:
                return over
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            merged = {s.path for g in groups for s in g}
            rows = self.spark.read.parquet(*sorted(merged))
            file, group = unused("_file", rows.columns), unused("_group", rows.columns)
            where = self.spark.createDataFrame([(_name(s.path), i) for i, g in enumerate(groups) for s in g], f"`{file}` string, `{group}` int")
            rows = rows.withColumn(file, _file_name(rows)).join(F.broadcast(where) if len(merged) <= 100_000 else where, file).drop(file)
            rows.repartitionById(len(groups), F.col(group)).write.partitionBy(group).option("compression", "zstd").parquet(folder)
            own = self._written(folder)
            while True:
                try:
                    version = self.commit([s for s in shards if s.path not in merged] + own, over)
                    break
                except Conflict:
                    over, before = self.version(), over
                    shards = self.shards(over)
                    if over == before:
                        _store.remove(self.spark, folder)
                        raise
                    if not merged <= {s.path for s in shards}:  # another compaction was first
                        _store.remove(self.spark, folder)
                        version = None
                        break
            if last and version:
                return version

    def expire(self, keep: int = 1) -> None:
        """Remove all versions but the newest ``keep``, and files that none of these lists.

        For one caller at a time, when no append is under way: files of a commit to come are listed nowhere yet."""
        versions = range(max(1, self.version() - keep + 1), self.version() + 1)
        live = {s.path for v in versions for s in self.shards(v)}
        fs, at = _store.filesystem(self.spark, f"{self.path}/manifest")
        old = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        for name in old:
            if name.startswith("v") and int(name[1:-5]) < versions[0]:
                _store.remove(self.spark, f"{self.path}/manifest/{name}")
        for s in self._written(f"{self.path}/data") if live else []:
            if s.path not in live:
                _store.remove(self.spark, s.path)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version's shards (the newest by default): (doc, shard, shard_bytes), a struct of all
        columns, the shard's number in the manifest and its size."""
        shards = self.shards(version)
        named = self.spark.createDataFrame([(_name(s.path), i, s.n_bytes) for i, s in enumerate(shards)], "_file string, shard int, shard_bytes long")
        rows = self.spark.read.parquet(*[s.path for s in shards])
        rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("doc"), _file_name(rows).alias("_file"))
        return rows.join(F.broadcast(named) if len(shards) <= 100_000 else named, "_file").drop("_file")


def _name(path: str) -> str:
    return path.split("/data/")[-1]


def _file_name(rows: DataFrame):
    return F.element_at(F.split(rows.metadataColumn("_metadata").getField("file_path"), "/data/"), -1)


def unused(name: str, columns: list[str]) -> str:
    """name, or a longer one that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def shard(documents: DataFrame, path: str | None = None, arrivals: int = 3, target_bytes: int = 64 << 20, fanout: int = 4, id_col: str = "doc_id") -> DataFrame:
    """Write documents as ``arrivals`` arrivals, compact after each, and read the live shards back:
    all columns, under a struct ``doc``, with shard and shard_bytes."""
    spark = documents.sparkSession
    store = TieredShards(spark, path or _store.work_dir(spark, "shards"), target_bytes, fanout)
    for i in range(arrivals):
        store.append(documents.filter(F.pmod(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(arrivals)) == i))
        store.compact(final=i == arrivals - 1)
        store.expire()  # no reader holds an older version of a store that is being made
    if not store.shards():
        return documents.limit(0).select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("shard_bytes"))
    return store.read()
