"""Rows that share a doc_id, or have none, are judged and mixed each by itself."""

import inspect
from collections import Counter
from math import comb

from sylva.llm import decontaminate, mix_budget, quality_cnn

WORDS = [f"w{i}" for i in range(30)]


def test_leaking_row_does_not_take_others_with_its_id(spark):
    item = " ".join(WORDS)
    near = " ".join([*WORDS[:20], "x", "y", *WORDS[22:]])
    clean = [" ".join(f"c{j}{i}" for i in range(40)) for j in range(3)]
    rows = [(None, item), (None, clean[0]), (None, clean[1]), (None, None), (7, near), (7, item), (7, clean[2]), (7, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = Counter((r.doc_id, r.text) for r in decontaminate.decontaminate(docs, items).collect())
    assert left == Counter(r for r in rows if r[1] != item)
    said = decontaminate.contaminated(docs, items).collect()
    assert len(said) == len(rows) and sum(r.contaminated for r in said) == 3
    assert all(r.n_windows == 1 and r.similarity == 1.0 for r in said if r.contaminated)


def test_bad_row_does_not_take_others_with_its_id(spark):
    class Net:  # here, so that it is pickled whole
        def pooled(self, text):
            return [float(bytes(text)[:4] == b"good")]

        def scores(self, pooled):
            return pooled[:, 0]

    rows = [(None, "good one"), (None, "bad one"), (3, "good two"), (3, "bad two"), (3, "good two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = quality_cnn.keep_good(docs, Net())
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r for r in rows if r[1].startswith("good"))


def test_default_radius_misses_few_pairs_at_the_threshold():
    radius = inspect.signature(decontaminate._leaks).parameters["radius"].default
    for m, shared in ((9, 8), (36, 32), (180, 160)):  # similarity 0.8
        own, other = ([comb(n, i) / 2**n for i in range(n + 1)] for n in (shared, m - shared))
        set_bit = [sum(x for i, x in enumerate(other) if 2 * (c + i) > m) for c in range(shared + 1)]
        p = sum(w * 2 * q * (1 - q) for w, q in zip(own, set_bit))
        assert sum(comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(radius + 1, 65)) < 1e-5


def test_mix_takes_rows_with_one_id_as_planned(spark):
    text = lambda n: " ".join(WORDS[:n])
    rows = [(None, text(3 + i % 5), "abc"[i % 3]) for i in range(40)] + [(5, text(4), "a")] * 9 + [(5, "", "b"), (None, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = Counter()
    for r in mix_budget._mix(docs).collect():
        planned[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mix_budget.mixed(docs).collect())
    assert got == +planned
