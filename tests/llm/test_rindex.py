"""Repeated strings against counting every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sylva.llm import rindex_dedup as R


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, long=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé fg") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(120))
    out = []
    for i in range(40):
        own = " ".join(word() for _ in range(rng.randint(0, 60)))
        p = list(passage)
        for _ in range(i % 4):
            p[rng.randrange(len(p))] = "#"
        a = rng.randrange(len(p) // 2)
        out.append(own + "".join(p[a : a + rng.randint(20, 500)]) + own[::-1])
    return [*out, None, "", "ab" * 90, "x" * 500, out[3], out[3], passage * 3]


@pytest.mark.parametrize("bucket", [1 << 20, 3000, 300])
def test_against_counting(spark, bucket):
    rows = list(enumerate(texts(1)))
    got = {r.doc_id: tuple(r[1:5]) for r in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, 8, bucket).collect()}
    expected = plain([t for _, t in rows], 40)
    assert got == dict(enumerate(expected)) and sum(x[2] for x in expected) > 20


def test_statistics_of_the_index():
    rng = random.Random(3)
    for n in (1, 2, 30):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(n)] + [b"abc" * 20]
        index = R.RunIndex(parts)
        most = index.statistics()
        for t, begin in zip(parts, index.begin):
            for i in range(len(t)):
                best = 0
                for u, other in enumerate(parts):
                    for j in range(len(other)):
                        if index.begin[u] + j != begin + i:
                            k = 0
                            while i + k < len(t) and j + k < len(other) and t[i + k] == other[j + k]:
                                k += 1
                            best = max(best, k)
                assert most[begin + i] == best
        assert len(index.runs) <= index.n and (np.diff(index.runs) > 0).all()


def test_odd_rows(spark, odd, none, odd_rows):
    got = R.remove_repeats(odd).collect()
    assert Counter(tuple(r[1:5]) for r in got) == Counter(plain([r[1] for r in odd_rows], 400))
    assert R.remove_repeats(none).collect() == []
    for r in got:
        assert r.n_spans == len(r.spans) and r.n_removed == sum(b - a for a, b in r.spans) and len(r.kept) == r.n_bytes - r.n_removed
