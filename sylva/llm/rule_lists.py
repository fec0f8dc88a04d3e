"""Quality rules as learned decision lists.

Statistics of whole texts are DataFrame expressions evaluated in the scan, a row at a time, with
no exchange.  A decision list for the class "low quality" is learned on the driver from a bounded
number of labelled rows of statistics (``max_rows`` rows of numbers, never texts): sequential
covering grows a conjunction of thresholds by FOIL gain on two thirds of the rows, prunes it on
the other third and keeps it only if it is precise enough there; covered rows leave and the next
rule follows.  The list comes back as one ordered CASE expression that Spark compiles.

Statistics.  Words are ``[^\\x20\\x09-\\x0D]+``.  n_repeat_words: words inside 8-word windows whose
word sequence occurs twice or more in the text, overlaps and the first included.  Windows are
compared by 64-bit hashes of their words' hashes.

Edge cases: null and empty texts have all statistics 0 and fail the base rule; equal rows stay
equal; texts of any length are taken whole; with no labels of one class the list is empty and
only the base rule decides; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_marks"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
_BLANKS = " \t\n\x0b\x0c\r"

_WINDOWS = (
    "transform(array(transform(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), w -> xxhash64(w))), h -> struct(size(h) AS n, CASE WHEN size(h) >= 8 "
    "THEN transform(sequence(0, size(h) - 8), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4], h[i + 5], h[i + 6], h[i + 7])) ELSE array() END AS g))[0]"
)
_SORTED = "array_sort(transform(w.g, (x, i) -> struct(x AS x, i AS i)))"
_TWICE = f"transform(array({_SORTED}), z -> array_sort(transform(filter(transform(z, (e, j) -> struct(e.i AS i, (j > 0 AND z[greatest(j - 1, 0)].x = e.x) OR (j < size(z) - 1 AND z[least(j + 1, size(z) - 1)].x = e.x) AS twice)), e -> e.twice), e -> e.i)))[0]"
_COVERED = f"transform(array({_TWICE}), p -> aggregate(transform(p, (a, j) -> CASE WHEN j < size(p) - 1 THEN least(8, p[least(j + 1, size(p) - 1)] - a) ELSE 8 END), 0, (s, x) -> s + x))[0]"
_DUP_LINES = f"transform(array(filter(split(text, '\\n', -1), l -> btrim(l, '{_BLANKS}') <> '')), l -> size(l) - size(array_distinct(l)))[0]"


def _without(chars: str) -> Column:
    return F.length(F.translate("text", chars, ""))


def statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the five base statistics, two more: A-Z letters, and marks !?;: )."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = F.length("text")
    docs = docs.select("doc_id", F.expr(_WINDOWS).alias("w"), _without(_BLANKS).alias("word_chars"), (whole - _without("#*$%&|<>")).alias("n_symbols"), F.expr(_DUP_LINES).alias("n_dup_lines"), (whole - _without(UPPER)).alias("n_upper"), (whole - _without("!?;:")).alias("n_marks"))
    repeats = F.when(F.size(F.array_distinct("w.g")) < F.size("w.g"), F.expr(_COVERED)).otherwise(F.lit(0))
    return docs.select("doc_id", F.col("w.n").cast("long").alias("n_words"), *(F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines")), repeats.cast("long").alias("n_repeat_words"), *(F.col(c).cast("long").alias(c) for c in EXTRA))


#: What the rules may compare: shares and means of the statistics.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "n_words": "CAST(n_words AS DOUBLE)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


def _covers(rule: list[Condition], row: dict[str, float]) -> bool:
    return all(c.holds(row) for c in rule)


def _grow(rows: list[tuple[dict, bool]], cuts: dict[str, list[float]], most: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most:
        p, n = sum(y for _, y in rows), sum(not y for _, y in rows)
        if not p or not n:
            break
        before, best = math.log2(p / (p + n)), (1e-9, None)
        for feature, at in cuts.items():
            ordered = sorted((x[feature], y) for x, y in rows)
            run, i, low = [0, 0], 0, {}
            for t in at:
                while i < len(ordered) and ordered[i][0] <= t:
                    run[ordered[i][1]] += 1
                    i += 1
                low[t] = (run[1], run[0])
            for t, (lp, ln) in low.items():
                for above, q, m in ((False, lp, ln), (True, p - lp, n - ln)):
                    if q and (gain := q * (math.log2(q / (q + m)) - before)) > best[0]:
                        best = (gain, Condition(feature, above, t))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if best[1].holds(r[0])]
    return rule


def _prune(rule: list[Condition], rows: list[tuple[dict, bool]]) -> list[Condition]:
    """The prefix with the best (p - n) / (p + n) on the pruning rows, the shortest among equals."""
    best, kept = -2.0, rule
    for k in range(1, len(rule) + 1):
        hit = [y for x, y in rows if _covers(rule[:k], x)]
        if hit and (value := (2 * sum(hit) - len(hit)) / len(hit)) > best:
            best, kept = value, rule[:k]
    return kept


def learn(rows: list[tuple[dict[str, float], bool]], precision: float = 0.97, max_rules: int = 12, max_conditions: int = 4, max_cuts: int = 64, least: int = 3) -> list[list[Condition]]:
    """Ordered rules for the rows marked True.  rows come in a fixed order: every third prunes."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    rules: list[list[Condition]] = []
    while len(rules) < max_rules and any(y for _, y in grow):
        cuts = {}
        for feature in FEATURES:
            values = sorted({x[feature] for x, _ in grow})
            step = max(1, len(values) // max_cuts)
            cuts[feature] = [(a + b) / 2 for a, b in zip(values[::step], values[step::step])] if len(values) > 1 else []
        rule = _grow(grow, cuts, max_conditions)
        if not rule:
            break
        rule = _prune(rule, prune)
        hit = [y for x, y in prune if _covers(rule, x)]
        if len(hit) < least or sum(hit) < precision * len(hit):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not _covers(rule, r[0])] for part in (grow, prune))
    return rules


def as_column(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1, or 0."""
    whens = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {i}" for i, rule in enumerate(rules, 1))
    return F.expr(f"CASE {whens} ELSE 0 END" if whens else "0")


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = 6000, **options) -> list[list[Condition]]:
    """Learn from labels (doc_id, bad boolean); at most max_rows rows, those with the least hashes of their id, are fetched."""
    joined = labels.filter("bad is not null and doc_id is not null").join(stats, "doc_id").select("bad", F.xxhash64("doc_id").alias("h"), "doc_id", *(F.expr(s).cast("double").alias(f) for f, s in FEATURES.items()))
    rows = joined.orderBy("h", "doc_id").limit(max_rows).collect()
    return learn([({f: r[f] for f in FEATURES}, bool(r.bad)) for r in rows], **options)


def base_failed(min_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)


def judge(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """stats with base_failed, the rule that rejects (0: none), and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rule": as_column(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
