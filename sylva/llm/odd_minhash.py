"""MinHash near-dedup with odd sketches.

Each distinct shingle set is signed once.  MinHash samples are banded to find candidates and
folded into a parity bitmap (an odd sketch); the XOR population count of two bitmaps estimates
the similarity precisely where it is high.  Candidates that the estimate cannot rule out are
confirmed on their full sets, and links are joined into components.  Bands of five samples are as many as
keep the share of threshold pairs without a common band below 1e-5 (20 at 0.85, 29 at 0.8).

Scale.  Equal sets (by a 128-bit digest and their size) are one class, grouped with partial aggregation, so
thousands of exact copies are one row afterwards.  A bucket never emits its pairs: each is compared with one
centre, the member that shares buckets with most others; components then merge what the centre holds
together, and only buckets that still hold several components go on.  There links through rare shingles are
found by their rarest ones, and a member whose rare shingles leave too little to share with any size in the
bucket is done; this settles the outer members of large families of copies without pairs.  What is left takes
more centres a round, 8, then 64 (centres are done, they have met all others), until no bucket holds members
of two components that have not met, or until such pairs are few against the rows: then sketches of what is
left meet in blocks of a few hundred members, dealt over tasks whatever a bucket holds.  No link is lost to a
cap; there pairs never become rows: members with a partner do, and links that join components, which the full
sets confirm inside the task that holds both blocks.  Buckets are told apart from those of one class by one
sort-merge join, which adaptive execution splits.  Open buckets, classes and components that hold many rows are
few by arithmetic: they are joined by a bounded broadcast, all others by a shuffle.

Edge cases: null and empty texts have an empty set (n_shingles 0) and link with nothing; rows with one
doc_id are one document: if their texts differ, the classes of all of them are linked; ties go to the
smallest doc_id; an empty table gives an empty result.  Columns other than the id and the text are not looked
at.  A null doc_id keeps its row with a null component and kept = true.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _skew, _store, _text

ROWS, BITS = 5, 512
SIGN = "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"


def bands_for(threshold: float, missed: float = 1e-5) -> int:
    """Bands by which no more than ``missed`` of the pairs at the threshold share none."""
    return max(1, math.ceil(math.log(missed) / math.log(1 - min(threshold, 0.999) ** ROWS)))


def estimate_floor(threshold: float, samples: int, bits: int = BITS) -> int:
    """XOR population above which two sketches are ruled out: five standard deviations below the threshold."""
    low = max(0.0, threshold - 5 * math.sqrt(threshold * (1 - threshold) / samples))
    differing = 2 * samples * (1 - low)
    expected = bits * (1 - (1 - 2 / bits) ** differing) / 2
    return math.ceil(expected + 5 * math.sqrt(bits) / 2 * math.sqrt(1 - (1 - 2 / bits) ** (2 * differing)))


def signatures(k: int, bands: int, rows: int = ROWS, bits: int = BITS):
    """mapInArrow function: (doc_id, text) to set size, set digest, band keys and odd sketch."""

    def run(batches):
        rng = np.random.default_rng(851)
        factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salts = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        for whole in batches:
            for batch in _text.pieces(whole, "text"):
                hashes, begin = _text.shingles(*_text.words(*_text.utf8(batch.column("text"))), k)
                n_docs, filled = batch.num_rows, np.flatnonzero(np.diff(begin))
                size, digest = np.zeros(n_docs, np.int64), np.zeros((n_docs, 2), np.uint64)
                signed = np.zeros((len(filled), bands * rows), np.uint64)
                if len(filled):
                    starts = begin[filled]
                    for i in range(bands * rows):
                        signed[:, i] = np.minimum.reduceat(hashes * factors[i] + salts[i], starts)
                    for d in filled:
                        own = np.unique(hashes[begin[d] : begin[d + 1]])
                        size[d], digest[d] = len(own), digest_of(own)
                keys = np.zeros((len(filled), bands), np.uint64)
                for b in range(bands):
                    key = np.full(len(filled), b + 1, np.uint64)
                    for r in range(rows):
                        key = _text.mixed(key * np.uint64(0xD6E8FEB86659FD93) + signed[:, b * rows + r])
                    keys[:, b] = key
                where = (_text.mixed(signed + salts) % np.uint64(bits)).astype(np.int64)
                flips = np.zeros((len(filled), bits), np.int64)
                np.add.at(flips, (np.arange(len(filled))[:, None], where), 1)
                sketch = np.packbits((flips & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)

                def lists(x):
                    count = np.zeros(n_docs, np.int32)
                    count[filled] = x.shape[1]
                    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(x.reshape(-1).view(np.int64)))

                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].copy().view(np.int64)), lists(keys), lists(sketch)], ["doc_id", "n", "d1", "d2", "bands", "sketch"])

    return run


def digest_of(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a set of distinct shingle hashes."""
    return own.sum(dtype=np.uint64), _text.mixed(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)


def shingle_sets(k: int):
    """mapInArrow function: text to its set's digest and size and the sorted distinct shingle hashes."""

    def run(batches):
        for whole in batches:
            for batch in _text.pieces(whole, "text"):
                hashes, begin = _text.shingles(*_text.words(*_text.utf8(batch.column("text"))), k)
                own = [np.unique(hashes[a:b]) for a, b in zip(begin, begin[1:])]
                ends = np.cumsum([0, *map(len, own)])
                digest = np.array([digest_of(x) for x in own], np.uint64).reshape(-1, 2).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(np.diff(ends)), lists], ["d1", "d2", "n", "shingles"])

    return run


def popcount(a: Column, b: Column, bits: int = BITS) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, bits // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def components(links: DataFrame, path: str) -> DataFrame:
    """(a, b) links to (id, label): the smallest id reachable.  Every step is joins and partial
    aggregates over the links; labels also jump to their label's label, so steps are few."""
    spark = links.sparkSession
    both = _store.saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{path}/both")
    labels = _store.saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{path}/labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = labels.join(near, "id", "left").join(jump, "label", "left").select("id", F.least("label", F.coalesce("near", "label"), F.coalesce("far", "label")).alias("label"), F.col("label").alias("old"))
        new = _store.saved(new, f"{path}/labels{step}")
        moved = new.filter("label <> old").limit(1).count()
        _store.remove(spark, f"{path}/labels{step - 1}")
        labels = new.select("id", "label")
        if not moved:
            return labels


def grown(labels: DataFrame | None, links: DataFrame, path: str) -> DataFrame:
    """Components after more links: the links between the components so far are joined first."""
    if labels is None:
        return components(links, path)
    of = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b")
    new = components(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), path).withColumnRenamed("label", "top")
    old = labels.join(new.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("top", "label").alias("label"))
    fresh = new.join(labels, "id", "left_anti").select("id", F.col("top").alias("label"))
    return _store.saved(old.union(fresh), f"{path}/grown")


def undecided(rows: DataFrame, path: str) -> DataFrame:
    """Rows of buckets in which members of several components are left, with the least size among these."""
    several = rows.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("m"), F.min("n").alias("least")).filter("p <> q")
    return _skew.lookup(rows, _store.saved(several.select("key", "m", "least"), path), ["key"], "m").drop("m")


def rare_shingles(rest: DataFrame, candidates: DataFrame, sets: DataFrame, percent: int, rare: int, path: str) -> tuple[DataFrame, DataFrame]:
    """What two open sets can share apart from common shingles.

    A shingle is rare if ``rare`` open sets hold it or fewer.  A link between sets without a common
    rare shingle needs both to have enough common ones: ``most`` is the most words a partner of that
    kind may have.  A link between sets with one shows in the rarest shingles of both (the prefix
    filter), so joining these finds it; a rare shingle makes a bounded number of pairs.
    Returns ((rep, most), pairs (a, b)).
    """
    part = rest.groupBy("rep").agg(F.min("part").alias("part"))
    held = sets.join(part.select("rep"), "rep", "left_semi").select("rep", F.explode("shingles").alias("g"))
    few = held.groupBy("g").agg(F.count("*").alias("df")).filter(F.col("df") <= rare)
    own = held.join(few, "g").groupBy("rep").agg(F.count("*").alias("rare"), F.sort_array(F.collect_list(F.struct("df", "g"))).alias("first"))
    sized = candidates.select("rep", "n").join(part, "rep").join(own, "rep", "left")
    prefix = F.expr(f"slice(first, 1, CAST(n - ceil(n * {percent} / 100) + 1 AS INT))")
    most = F.floor((F.col("n") - F.coalesce("rare", F.lit(0))) * (100 + percent) / percent - F.col("n"))
    bound = _store.saved(sized.select("rep", "part", "n", most.alias("most"), F.filter(prefix, lambda x: x["df"] > 1).alias("first")), f"{path}/bound")
    heads = bound.select("rep", "part", F.explode("first").alias("x")).select("rep", "part", F.col("x.g").alias("g"))
    a, b = (heads.select("g", F.col("rep").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")
    return bound.select("rep", "most"), a.join(b, "g").filter("part_a <> part_b and a < b").select("a", "b").distinct()


def _dealt(rows: DataFrame, block: int, path: str) -> DataFrame:
    """rows of buckets of at least two, each with its block by hash (own) and its bucket's number of blocks, of
    about ``block`` members and a million words of sets."""
    sizes = _store.saved(rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("words")).filter("m > 1"), path)
    dealt = _skew.lookup(rows, sizes, ["key"], "m").withColumn("blocks", F.expr(f"least(m, greatest(ceil(m / {block}), ceil(words / {1 << 20})))"))
    return dealt.withColumn("own", F.expr("pmod(xxhash64(rep), blocks)"))


def _in_blocks(rows: DataFrame, limit: int, block: int, path: str, how: str = "inner") -> DataFrame:
    """(a, b) of rows with one key, of two components, that sizes and sketches let pass: a bucket's members are
    dealt to blocks by hash, and every two blocks meet under a key of their own.  With ``how`` left_semi, (key, rep)
    of the rows that have such a partner."""
    dealt = _dealt(rows, block, path).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    side = lambda x, i, j: dealt.select(F.col("key").alias(f"key_{x}"), F.col("own").alias(f"{i}_{x}"), F.col("other").alias(f"{j}_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "part", "n", "most", "sketch")))
    near = F.expr("key_a = key_b and i_a = i_b and j_a = j_b and part_a <> part_b and n_a <= most_b and n_b <= most_a") & (popcount(F.col("sketch_a"), F.col("sketch_b")) <= limit)
    if how == "left_semi":
        return side("a", "i", "j").join(side("b", "j", "i"), near, how).select(F.col("key_a").alias("key"), F.col("rep_a").alias("rep")).distinct()
    return side("a", "i", "j").join(side("b", "j", "i"), near & F.expr("rep_a < rep_b"), how).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def cell_links(limit: int, percent: int):
    """applyInArrow function: the members of two blocks to links (a, b) that sizes and sketches let pass and the
    full sets confirm, no more than hold the components of the cell together."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rep, part, n, most, own = (table.column(c).to_numpy() for c in ("rep", "part", "n", "most", "own"))
        lists = lambda c: pa.concat_arrays(table.column(c).chunks)
        sketch = lists("sketch").flatten().to_numpy().view(np.uint64).reshape(len(rep), -1)
        shingles = lists("shingles")
        words, at = shingles.flatten().to_numpy(), shingles.offsets.to_numpy() - shingles.offsets[0].as_py()
        top = {p: p for p in part.tolist()}

        def find(p):
            while top[p] != p:
                top[p] = p = top[top[p]]
            return p

        left, right, links = np.flatnonzero(own == i), np.flatnonzero(own == j), []
        for x in left:
            y = right if i != j else right[rep[right] > rep[x]]
            y = y[(part[y] != part[x]) & (n[x] <= most[y]) & (n[y] <= most[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
            differing = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
            for z in y[np.argsort(differing, kind="stable")][: np.count_nonzero(differing <= limit)]:
                p, q = find(int(part[x])), find(int(part[z]))
                if p == q:
                    continue
                both = len(np.intersect1d(words[at[x] : at[x + 1]], words[at[z] : at[z + 1]], assume_unique=True))
                if both * 100 >= (n[x] + n[z] - both) * percent:
                    top[q] = p
                    links.append((min(rep[x], rep[z]), max(rep[x], rep[z])))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def linked_in_blocks(rows: DataFrame, sets: DataFrame, limit: int, percent: int, block: int, path: str) -> DataFrame:
    """(a, b) links that join the components of all links between members of a bucket.

    Members with a partner that sizes and sketches let pass are found first, a row each; their sets then meet a cell
    of two blocks a time.  A cell gives fewer links than it has members, however many pairs in it are alike."""
    paired = _store.saved(_in_blocks(rows, limit, block, f"{path}/sizes", "left_semi"), f"{path}/paired")
    kept = _store.saved(rows.join(paired.hint("merge"), ["key", "rep"], "left_semi").select("key", "rep", "part", "n", "most", "sketch"), f"{path}/paired_rows")
    dealt = _dealt(kept, block, f"{path}/paired_sizes").join(sets.hint("merge"), "rep")
    cells = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    cells = cells.select("key", "i", "j", "own", "rep", "part", "n", "most", "sketch", "shingles")
    return cells.groupBy("key", "i", "j").applyInArrow(cell_links(limit, percent), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rare: int = 64, centres: tuple[int, ...] = (1, 8, 64), spare: int = 64, block: int = 256, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of documents.

    Documents whose shingle sets' similarity is percent / 100 or more are linked; component_id is the
    smallest doc_id reachable.  ``centres``: how many centres a bucket takes by round, the last for all
    further ones.  ``spare``: the sketches of pairs left across components are compared at once when these are
    fewer than this multiple of the bucket rows, in blocks of about ``block`` members.  ``broadcast_ids``: the ids of one document a candidate class are broadcast to fetch its
    set if they are no more than this (some 100 MB), else joined by a shuffle.
    """
    spark = documents.sparkSession
    path = _store.work_dir(spark, "minhash")
    bands = bands_for(percent / 100)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = _store.saved(docs.mapInArrow(signatures(k, bands), SIGN), f"{path}/signed")
    alone = ["d1", "d2", "n"]
    linkable = signed.filter("n > 0 and doc_id is not null").select("doc_id", *alone)
    classes = signed.filter("n > 0 and doc_id is not null").groupBy(*alone).agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("x"), F.count("*").alias("copies"))
    classes = _store.saved(classes.select(F.monotonically_increasing_id().alias("rep"), *alone, "copies", F.col("x.doc_id").alias("first"), "x.bands", "x.sketch"), f"{path}/classes")

    # a document with several texts links their classes
    labels = None
    both = linkable.groupBy("doc_id").agg(F.min(F.struct(*alone)).alias("lo"), F.max(F.struct(*alone)).alias("hi"), F.count("*").alias("c")).filter("lo <> hi")
    both = _store.saved(both.select("doc_id", "c", *[F.col(f"lo.{x}").alias(f"lo_{x}") for x in alone]), f"{path}/texts")
    if not both.isEmpty():
        own = _skew.lookup(linkable, both, ["doc_id"], "c").drop("doc_id", "c").distinct()
        of = lambda x, prefix: classes.select(F.col("rep").alias(x), *[F.col(c).alias(prefix + c) for c in alone])
        links = own.join(of("a", ""), alone).join(of("b", "lo_"), [f"lo_{c}" for c in alone]).filter("a <> b").select("a", "b")
        labels = components(_store.saved(links, f"{path}/links_ids"), f"{path}/parts_ids")

    # buckets with at least two classes
    in_bucket = classes.select("rep", "n", F.explode("bands").alias("key"))
    crowded = _store.saved(in_bucket.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), f"{path}/crowded")
    rows = _store.saved(in_bucket.join(crowded.hint("merge"), "key"), f"{path}/rows")  # most rows are alone in their bucket: one exchange drops them, and a hot key can be split
    n_rows = rows.count()
    score = _store.saved(rows.groupBy("rep").agg(F.sum("m").alias("score")), f"{path}/score")
    n_candidates = score.count()
    if n_candidates:
        candidates = _store.saved(classes.join(score.select("rep"), "rep", "left_semi").select("rep", *alone, "first", "sketch"), f"{path}/candidates")
        few = lambda table: F.broadcast(table) if n_candidates <= broadcast_ids else table
        firsts = candidates.select(F.col("first").alias("doc_id")).distinct()
        found = docs.join(few(firsts), "doc_id", "left_semi").select("text").mapInArrow(shingle_sets(k), "d1 long, d2 long, n long, shingles array<long>")
        sets = _store.saved(found.join(few(candidates.select(*alone, "rep")), alone).select("rep", "shingles").dropDuplicates(["rep"]), f"{path}/sets")
        limit = estimate_floor(percent / 100, bands * ROWS)

        def confirmed(pairs: DataFrame, name: str) -> DataFrame:
            """Distinct (a, b) pairs that the sketches let pass and the full sets confirm."""
            left = candidates.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
            right = candidates.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
            close = pairs.join(left, "a").join(right, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).filter(popcount(F.col("sa"), F.col("sb")) <= limit).select("a", "b", "na", "nb")
            x, y = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xa")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("xb"))
            shared = close.join(y, "b").join(x, "a").select("a", "b", "na", "nb", F.size(F.array_intersect("xa", "xb")).cast("long").alias("both"))
            return _store.saved(shared.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b"), f"{path}/{name}")

        def parted(rows: DataFrame) -> DataFrame:
            """rows with their class's component as it is now."""
            rows = rows.drop("part")
            return rows.withColumn("part", F.col("rep")) if labels is None else rows.join(labels.select(F.col("id").alias("rep"), F.col("label").alias("part")), "rep", "left").withColumn("part", F.coalesce("part", "rep"))

        open_rows, turn = _store.saved(parted(rows.select("key", "rep", "n").join(score, "rep").withColumn("most", F.lit(None).cast("long"))), f"{path}/open0"), 0
        while not open_rows.isEmpty():
            turn += 1
            slots = centres[min(turn, len(centres)) - 1]
            told = ["rep", "n", "part", "most", *(["sketch"] if turn > 1 else [])]
            best = open_rows.groupBy("key", F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(slots)).alias("slot")).agg(F.max_by(F.struct(*told), F.struct("score", -F.col("rep"))).alias("c"), F.count("*").alias("m"))
            best = _store.saved(best.groupBy("key").agg(F.collect_list("c").alias("cs"), F.sum("m").alias("m")), f"{path}/centres{turn}")  # no more than slots of them a key
            faced = _skew.lookup(open_rows, best, ["key"], "m", 5000)
            fits = f"part <> c.part AND n <= coalesce(c.most, n) AND c.n <= coalesce(most, c.n) AND least(n, c.n) * 100 >= greatest(n, c.n) * {percent}"
            if turn > 1:
                fits += " AND " + " + ".join(f"bit_count(sketch[{i}] ^ c.sketch[{i}])" for i in range(BITS // 64)) + f" <= {limit}"
            met = faced.select("rep", F.explode(F.expr(f"transform(filter(cs, c -> {fits}), c -> c.rep)")).alias("c"))
            pairs = met.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
            labels = grown(labels, confirmed(pairs, f"links{turn}"), f"{path}/parts{turn}")
            rest = _store.saved(parted(faced.filter("NOT exists(cs, c -> c.rep = rep)").drop("cs", "m")), f"{path}/rest{turn}")
            open_rows = undecided(rest, f"{path}/several{turn}")
            if turn == 1:
                open_rows = _store.saved(open_rows, f"{path}/first")
                bound, shared = rare_shingles(open_rows, candidates, sets, percent, rare, path)
                labels = grown(labels, confirmed(shared, "links_rare"), f"{path}/parts_rare")
                open_rows = undecided(_store.saved(parted(open_rows.drop("most", "least").join(bound, "rep").join(candidates.select("rep", "sketch"), "rep")), f"{path}/bounded"), f"{path}/several_rare")
            open_rows = _store.saved(open_rows.filter("most >= least").drop("least"), f"{path}/open{turn}")
            cross = open_rows.groupBy("key", "part").agg(F.count("*").alias("c")).groupBy("key").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("cross")).agg(F.sum("cross")).first()[0]
            if not cross:
                break
            if cross // 2 <= spare * n_rows:
                links = _store.saved(linked_in_blocks(open_rows, sets, limit, percent, block, path), f"{path}/links_last")
                labels = grown(labels, links, f"{path}/parts_last")
                break
    found = classes.select("rep", *alone, "copies", "first", F.col("rep").alias("label"))
    if labels is not None:
        found = found.drop("label").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    found = _store.saved(found, f"{path}/labelled")
    least = _store.saved(found.groupBy("label").agg(F.min("first").alias("component"), F.count("*").alias("c")), f"{path}/least")
    found = _store.saved(_skew.lookup(found, least, ["label"], "c").select(*alone, "copies", "component"), f"{path}/found")
    out = _skew.lookup(linkable, found, alone, "copies").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    out = out.unionByName(signed.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(documents: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = 1_000_000) -> DataFrame:
    """The documents with all their columns, one of each group of near-duplicates: that with the smallest id."""
    spark = documents.sparkSession
    gone = near_duplicates(documents, k, percent, id_col, text_col, broadcast_ids=broadcast_ids).filter("not kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    gone = _store.saved(gone, f"{_store.work_dir(spark, 'dedup')}/gone")
    side = F.broadcast(gone) if gone.count() <= broadcast_ids else gone
    return documents.join(side, F.col(id_col).cast("long") == F.col("_gone_id"), "left_anti")
