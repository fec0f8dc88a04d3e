"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent letter n-grams.  A document's n-grams are
ranked by frequency too, and its distance to a language is the sum of how far each is out of
place, with the greatest distance for n-grams the profile lacks.  The nearest language wins.

N-grams run over words of letters (upper case folded), with a blank at each end, lengths 1 to 3.
A letter is a code point for which str.isalpha holds; everything else parts words.

Scale.  Profiles are learned from a bounded sample (no more than ``max_docs`` documents a language, those
with the least hashes of id and text), counted in the executors and summed with partial aggregation; a
profile has ``size`` entries.  Prediction is one pass without an exchange.

Edge cases: a text that is null or has no letter is ``und`` with score 0; equal counts rank by the
n-gram's code points, equal distances by language name; a null language teaches nothing; without
any profile all is ``und``; repeated rows get equal answers; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text

_WIDE = 0x110000
_fold: list[np.ndarray] = []


def folding() -> np.ndarray:
    """Code point to lower-cased letter, or 0 where it is no letter."""
    if not _fold:
        table = np.zeros(_WIDE, np.int64)
        for i in range(_WIDE):
            if (c := chr(i)).isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _fold.append(table)
    return _fold[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of a text: code points of 21 bits each, 1 standing for the blank at a word's end."""
    letters = folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not letters.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.concatenate(([0], letters, [0]))
    x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]  # one blank between words
    x[x == 0] = 1
    two = (x[:-1] << 21) | x[1:]
    three = ((two[:-1] << 21) | x[2:])[x[1:-1] > 1]
    return np.unique(np.concatenate((x[x > 1], two, three)), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent n-grams, most frequent first."""
    if len(keys) > size:  # only those that can be among them are sorted
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))[:size]]


class Profiles:
    def __init__(self, by_language: dict[str, list[int]], size: int):
        self.names, self.size = sorted(by_language), size
        pairs = [(g, i, r) for i, name in enumerate(self.names) for r, g in enumerate(by_language[name])]
        self.keys = np.unique(np.array([p[0] for p in pairs], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), -1, np.int64)
        for g, i, r in pairs:
            self.ranks[np.searchsorted(self.keys, g), i] = r

    def distances(self, text: str | None) -> np.ndarray | None:
        """Mean distance to each language, as a share of the greatest; None without a letter."""
        keys, counts = grams(text or "")
        if not len(keys) or not self.names:
            return None
        own = ranked(keys, counts, self.size)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = self.ranks[np.where(self.keys[at] == own, at, len(self.keys))]
        return np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).mean(0) / self.size

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the nearest language's share when nearness is weighed against all."""
        d = self.distances(text)
        if d is None:
            return "und", 0.0
        near = np.exp(-20 * (d - d.min()))
        return self.names[int(d.argmin())], float(near.max() / near.sum())


def learn(documents: DataFrame, size: int = 400, max_docs: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the languages in documents."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    # hashes in 65,536 ranges are counted; rows up to the range in which max_docs are reached are few, and are ranked
    hashed = docs.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("cell", F.shiftright("h", 48))
    cells = hashed.groupBy("lang", "cell").agg(F.count("*").alias("n"))
    upto = cells.withColumn("before", F.sum("n").over(Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    last = upto.filter(F.col("before") < max_docs).groupBy("lang").agg(F.max("cell").alias("last"))
    few = hashed.join(F.broadcast(last), "lang").filter("cell <= last")
    some = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= max_docs).select("lang", "text")

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows: dict[str, list] = {}
                for name, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    rows.setdefault(name, []).append(grams(text))
                for name, own in rows.items():
                    keys, back = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([c for _, c in own]), len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    counted = some.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counted.withColumn("place", place).filter(F.col("place") <= size).collect()  # size rows a language
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.place)):
        out.setdefault(r.lang, []).append(r.gram)
    return Profiles(out, size)


def identify(documents: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of documents."""

    def run(batches):
        for whole in batches:
            for batch in _text.pieces(whole, "text"):
                found = [profiles.predict(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
