"""Removal of long repeated strings with run-length suffix indexes.

Every ``length``-byte string is dealt to one anchor: the least hash among the ``gram``-byte grams
inside it.  Equal strings have equal anchors at equal places, so they meet under the anchor's key
whatever documents they stand in.  The strings of an anchor are consecutive; those that start in the
same half of the places before it form one phrase of less than two lengths of bytes, keyed by the
more than half a length of bytes that they all share; documents become sequences of phrases (as in prefix-free parsing
for large Burrows-Wheeler transforms), and a dictionary counts each distinct phrase.

An anchor with one distinct phrase needs nothing more: the phrase's count says whether it repeats.
The phrases of all other anchors are indexed in buckets of bounded size: suffix array, run-length
Burrows-Wheeler transform, suffix samples at the ends of its runs.  Matching statistics are
streamed from them: the common length with the neighbour in suffix order is computed at run ends
only, and falls by one a byte elsewhere.  A string repeats if its statistic reaches ``length`` or
its phrase occurs twice.  Repeated strings of a document are joined into removed byte ranges.

Scale.  Phrases move as hashes with ids and offsets; bytes move once for the phrases to be indexed
and once for the texts to be cut.  Counts use partial aggregation.  A bucket holds about
``bucket_bytes``; an anchor with more distinct bytes than that has its phrases cut into shorter ones
keyed by the bytes that all strings of a piece share, twice if need be, after which a phrase is a
single string; so no key is ever gathered whole.

Edge cases: null and empty texts have 0 bytes and no span; texts shorter than ``length`` keep all;
rows repeating a document are documents of their own, so both lose what they share; null ids are
kept as rows; texts may be of any length below 256 MB; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

_PLACE = np.uint64((1 << 28) - 1)
PHRASE = "key long, phrase long, dk long, lo int, hi int"


def prefix_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running hashes, inverse powers): the hash of buf[a:b] is (run[b] - run[a]) * down[a], to be mixed."""
    up, down = _text.powers(len(buf) + 1)
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_text._LETTERS[buf] * up[: len(buf)], dtype=np.uint64, out=run[1:])
    return run, down


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, in two passes over blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def phrases(buf: np.ndarray, length: int, gram: int, width: int | None = None) -> tuple[np.ndarray, ...]:
    """(key, phrase hash, first string's start, last string's start, anchor) of a document's phrases.

    With a width, strings of an anchor are dealt further by how far before it they start, and the key
    is that of the bytes which all strings of such a run share, not of the anchor's gram alone.
    """
    if len(buf) < length:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    run, down = prefix_hashes(buf)
    n = len(buf) - gram + 1
    grams = _text.mixed((run[gram:] - run[:n]) * down[:n])
    least = sliding_least((grams & ~_PLACE) | np.arange(n, dtype=np.uint64), length - gram + 1)
    anchor = (least & _PLACE).astype(np.int64)
    run_of = np.zeros(len(anchor), np.int64) if width is None else (anchor - np.arange(len(anchor))) // width
    lo = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (run_of[1:] != run_of[:-1]))))
    hi = np.concatenate((lo[1:], [len(anchor)])) - 1
    at = anchor[lo]
    whole = _text.mixed((run[hi + length] - run[lo]) * down[lo])
    key = grams[at]
    if width is not None:
        a = at - run_of[lo] * width
        b = a - width + 1 + length
        key = _text.mixed(_text.mixed((run[b] - run[a]) * down[a]) + run_of[lo].astype(np.uint64) * np.uint64(77))
    return key, _text.mixed(whole * np.uint64(31) + (at - lo).astype(np.uint64)), lo, hi, at


def pieces(buf: np.ndarray, lo: int, hi: int, length: int, gram: int, width: int):
    """A phrase cut at places fixed to its anchor: (key, hash, lo, hi) of runs of at most width strings,
    keyed by the bytes that all strings of a full run share."""
    part = buf[lo : hi + length]
    anchor = int(phrases(part, length, gram)[4][0])
    rel = anchor - np.arange(hi - lo + 1)  # where each string has the anchor
    group = rel // width
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        first, last = anchor - (int(g) * width + width - 1), anchor - int(g) * width  # the full run, within the phrase or not
        core = part[last : first + length].tobytes()
        a, b = int(own[0]), int(own[-1])
        said = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
        yield said(core + bytes([int(g) % 256, width % 256])), said(part[a : b + length].tobytes() + a.to_bytes(4, "little")), lo + a, lo + b


class RunIndex:
    """Run-length Burrows-Wheeler transform of many short texts, with suffix samples at run ends."""

    def __init__(self, texts: list[bytes], deepest: int = 1 << 20):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(lengths + 1)))  # a gap after each text
        n = int(self.begin[-1])
        text = np.zeros(n + 8, np.uint8)
        inside = np.ones(n, bool)
        inside[self.begin[1:] - 1] = False
        text[:n][inside] = np.frombuffer(b"".join(texts), np.uint8)
        owner = np.repeat(np.arange(len(texts)), lengths + 1)
        left = self.begin[1:][owner] - 1 - np.arange(n)  # bytes up to the gap
        # ranks by as many bytes as fit 63 bits, then by three times as many (twice in long texts) until all are covered
        used = np.unique(text[:n][inside])
        bits = max(1, int(len(used)).bit_length())  # 0 is left for the gap
        code = np.zeros(256, np.int64)
        code[used] = np.arange(1, len(used) + 1)
        letters = np.concatenate((np.where(inside, code[text[:n]], 0), np.zeros(64, np.int64)))
        size = 63 // bits
        packed = np.zeros(n, np.int64)
        for i in range(size):
            packed = (packed << bits) | np.where(left > i, letters[i : n + i], 0)
        step = 3 if n < (1 << 21) - 2 else 2
        self.sizes, self.ranks = [size], [self._ranked(packed)]
        while self.sizes[-1] < min(deepest, int(lengths.max(initial=0))) and int(self.ranks[-1].max(initial=0)) + 1 < n:
            last, size = self.ranks[-1].astype(np.int64), self.sizes[-1]
            packed = last
            for i in range(1, step):
                ahead = np.zeros(n, np.int64)
                if i * size < n:
                    ahead[: n - i * size] = np.where(left[: n - i * size] > i * size, last[i * size :] + 1, 0)
                packed = packed * (n + 2) + ahead
            self.ranks.append(self._ranked(packed))
            self.sizes.append(size * step)
        self.n, self.left, self.text = n, left, text
        order = np.argsort(self.ranks[-1].astype(np.int64) * (len(texts) + 1) + owner)  # equal rests by text: as if each gap were a letter of its own
        before = np.where(order > 0, text[order - 1].astype(np.int64), 0)
        gap = (order == 0) | ~inside[order - 1]
        before[gap] = 256 + owner[order[gap]]
        head = np.concatenate(([True], before[1:] != before[:-1]))
        self.letters, self.runs = before[head], np.flatnonzero(head)
        tail = np.concatenate((head[1:], [True]))
        self.heads = order[head], np.where(head, np.concatenate(([-1], order[:-1])), -1)[head]
        self.tails = order[tail], np.where(tail, np.concatenate((order[1:], [-1])), -1)[tail]

    @staticmethod
    def _ranked(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x)
        s = x[order]
        out = np.empty(len(x), np.int32)
        out[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))[: len(x)]
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common; -1 in b: none."""
        there = b >= 0
        a, b = a[there], b[there]
        room = np.minimum(self.left[a], self.left[b])
        done = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            size = self.sizes[level]
            for _ in range(2):
                i, j = np.minimum(a + done, self.n - 1), np.minimum(b + done, self.n - 1)
                done += np.where((done + size <= room) & (self.ranks[level][i] == self.ranks[level][j]), size, 0)
        for _ in range(self.sizes[0]):
            i, j = np.minimum(a + done, self.n - 1), np.minimum(b + done, self.n - 1)
            done += (done < room) & (self.text[i] == self.text[j])
        out = np.zeros(len(there), np.int64)
        out[there] = done
        return out

    def statistics(self) -> np.ndarray:
        """For each position, the longest string from there that also starts elsewhere, from the run ends."""
        most = np.zeros(self.n, np.int64)
        for at, other in (self.heads, self.tails):
            known = np.full(self.n, -1, np.int64)
            known[at] = self.common(at, other)
            last = np.maximum.accumulate(np.where(known >= 0, np.arange(self.n), -1))
            most = np.maximum(most, np.where(last >= 0, known[last] - (np.arange(self.n) - last), 0))
        return most


def _ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def repeated_ranges(documents: DataFrame, length: int = 400, gram: int = 32, bucket_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents as (dk, doc_id, text), ranges (dk, [(first, last start of repeated strings)]))."""
    spark = documents.sparkSession
    path = _store.work_dir(spark, "rindex")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("dk"), "doc_id", "text")

    def parsed(batches):
        for whole in batches:
            for batch in _text.pieces(whole, "text"):
                buf, at = _text.utf8(batch.column("text"))
                ids, out = batch.column("dk").to_numpy(), [[] for _ in range(5)]
                for d in range(batch.num_rows):
                    key, phrase, lo, hi, _ = phrases(buf[at[d] : at[d + 1]], length, gram, (length - gram) // 2 + 1)
                    for column, x in zip(out, (key.view(np.int64), phrase.view(np.int64), np.full(len(key), ids[d]), lo.astype(np.int32), hi.astype(np.int32))):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["key", "phrase", "dk", "lo", "hi"])

    def recut(width):
        def run(batches):
            for batch in batches:
                out = []
                for dk, text, found in zip(batch.column("dk").to_pylist(), batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                    buf = np.frombuffer(text.encode(), np.uint8)
                    out += [(key, phrase, dk, lo, hi) for f in found for key, phrase, lo, hi in pieces(buf, f["lo"], f["hi"], length, gram, width)]
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["key", "phrase", "dk", "lo", "hi"])

        return run

    def cut_out(batches):
        for batch in batches:
            for dk, text, found in zip(batch.column("dk").to_pylist(), batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                data = text.encode()
                yield pa.RecordBatch.from_arrays([pa.array([f["key"] for f in found], pa.int64()), pa.array([f["phrase"] for f in found], pa.int64()), pa.array([f["n"] for f in found], pa.int64()), pa.array([data[f["lo"] : f["hi"] + length] for f in found], pa.binary())], ["key", "phrase", "n", "bytes"])

    def indexed(table: pa.Table) -> pa.Table:
        texts, n = table.column("bytes").to_pylist(), table.column("n").to_pylist()
        index = RunIndex(texts)
        long = index.statistics() >= length
        starts, ends = [], []
        for i, (text, count) in enumerate(zip(texts, n)):
            hit = np.ones(len(text) - length + 1, bool) if count > 1 else long[index.begin[i] : index.begin[i] + len(text) - length + 1]
            own = _ranges(hit)
            starts.append([a for a, _ in own])
            ends.append([b for _, b in own])
        return pa.table({"key": table.column("key"), "phrase": table.column("phrase"), "a": pa.array(starts, pa.list_(pa.int32())), "b": pa.array(ends, pa.list_(pa.int32()))})

    def texts_of(rows: DataFrame, *fields: str) -> DataFrame:
        """Texts with the phrases to take from each."""
        return docs.select("dk", "text").dropDuplicates(["dk"]).join(rows.groupBy("dk").agg(F.collect_list(F.struct(*fields)).alias("found")).hint("merge"), "dk")

    rows = _store.saved(docs.select("dk", "text").mapInArrow(parsed, PHRASE), f"{path}/phrases0")
    found = None
    for turn, width in enumerate((24, 1, 0)):
        shared = _store.saved(rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), f"{path}/shared{turn}")  # so that both sides of the join are exchanged and a hot key can be split
        often = _store.saved(rows.join(shared.hint("merge"), "key"), f"{path}/often{turn}")
        _store.remove(spark, f"{path}/phrases{turn}")
        distinct = often.groupBy("key", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("dk", "lo", "hi")).alias("x"))
        distinct = _store.saved(distinct.select("key", "phrase", "n", "x.dk", "x.lo", "x.hi"), f"{path}/distinct{turn}")
        of_key = _store.saved(distinct.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("hi") - F.col("lo") + length).alias("size")), f"{path}/keys{turn}")
        hot = of_key.filter((F.col("size") > bucket_bytes) & (F.col("kinds") > 1)) if width else of_key.limit(0)
        several = distinct.join(of_key.filter("kinds > 1").hint("merge"), "key")
        size, n_hot = of_key.filter("kinds > 1").agg(F.sum(F.when(F.col("size") <= bucket_bytes, F.col("size"))), F.count_if(F.col("size") > bucket_bytes)).first()
        answers = distinct.join(of_key.filter("kinds = 1").hint("merge"), "key").filter("n > 1").select("key", "phrase", F.array(F.lit(0)).alias("a"), F.array(F.col("hi") - F.col("lo")).alias("b"))
        if size or (n_hot and not width):
            if width:
                several = several.filter(F.col("size") <= bucket_bytes)
            buckets = max(1, -(-(size or bucket_bytes) // bucket_bytes) * 4)  # a quarter of bucket_bytes each, a hot key more
            taken = texts_of(several.select("dk", "key", "phrase", "n", "lo", "hi"), "key", "phrase", "n", "lo", "hi").mapInArrow(cut_out, "key long, phrase long, n long, bytes binary")
            tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 16)  # some buckets a task: indexing is work for the processor
            taken = taken.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).repartition(tasks, "bucket")
            index = taken.groupBy("bucket").applyInArrow(lambda t: indexed(t), "key long, phrase long, a array<int>, b array<int>")
            answers = answers.union(index.filter("size(a) > 0"))
        answers = _store.saved(answers, f"{path}/answers{turn}")
        here = often.join(answers.hint("merge"), ["key", "phrase"]).select("dk", F.explode(F.expr("transform(a, (x, i) -> struct(lo + x AS a, lo + b[i] AS b))")).alias("r")).select("dk", "r.a", "r.b")
        found = here if found is None else found.union(here)
        if not width or not n_hot:
            break
        again = often.join(hot.select("key"), "key", "left_semi").select("dk", "lo", "hi")
        # rows that repeat a document stay as many occurrences: each carries its own phrases
        often_dk = again.groupBy("dk", "lo", "hi").agg(F.count("*").alias("times"))
        cut = texts_of(often_dk, "lo", "hi").mapInArrow(recut(width), PHRASE)
        times = often_dk.groupBy("dk").agg(F.max("times").alias("times"))
        rows = _store.saved(cut.join(times, "dk").select("key", "phrase", "dk", "lo", "hi", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_")).drop("_"), f"{path}/phrases{turn + 1}")
    ranges = found.groupBy("dk").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    return docs, _store.saved(ranges, f"{path}/ranges")


def remove_repeats(documents: DataFrame, length: int = 400, gram: int = 32, bucket_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans), a row for each row of documents.

    Every byte covered by a length-byte string that also starts anywhere else goes.  kept: the
    bytes left (null without with_bytes); spans: the removed [start, end) ranges in bytes.
    """
    docs, ranges = repeated_ranges(documents, length, gram, bucket_bytes, id_col, text_col)

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for text, found in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                data, spans = text.encode(), []
                for a, b in sorted((r["a"], r["b"] + length) for r in found or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                ends = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
                for column, x in zip(out, (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None, spans if with_bytes else None)):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    joined = docs.join(ranges.hint("merge"), "dk", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<int>>")
