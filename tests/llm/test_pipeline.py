"""Each stage on all that its predecessor kept, against plain Python."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C

from test_native import brute_leaks, grams, split

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows before and after each stage."""
    path = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{path}/{i}")
        out.append(spark.read.parquet(f"{path}/{i}"))
    return out


def test_columns_and_rows(kept):
    assert all(x.columns == kept[0].columns for x in kept[:-1]) and kept[-1].columns == [*kept[0].columns, "shard"]
    rows = [set(x.collect()) for x in kept[:-1]]
    assert all(b <= a for a, b in zip(rows, rows[1:])) and all(rows)
    assert Counter(r[:-1] for r in map(tuple, kept[-1].collect())) == Counter(map(tuple, kept[-2].collect()))


def test_quality_keeps_good_documents(spark, kept):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in kept[1].collect()}
    good = [i for i, q in label.items() if q == 1]
    assert sum(i in left for i in good) >= 0.9 * len(good) and len(left) < kept[0].count()


def plain_groups(rows):
    """The least id reachable from each id of (id, text) rows by five-word shingles with similarity 0.8 or more."""
    sets = [(i, set(grams(t, 5))) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def test_one_of_each_group(kept):
    groups = plain_groups([(r.doc_id, r.text) for r in kept[1].collect()])
    assert {r.doc_id for r in kept[2].collect()} == set(groups.values())


def test_no_benchmark_item_is_left(spark, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = brute_leaks([(r.doc_id, r.text) for r in kept[2].collect()], items)
    assert {r.doc_id for r in kept[3].collect()} == {r.doc_id for r in kept[2].collect()} - set(bad)


def test_the_mix_meets_its_targets(kept):
    from sylva.llm.mix_budget import targets

    before, after = kept[3].collect(), kept[4].collect()
    sizes, taken, times = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in after)
    for r in before:
        sizes[r.source] += len(split(r.text))
    for r in after:
        taken[r.source] += len(split(r.text))
    assert max(times.values()) <= 2
    for s, t in targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 0.02 * t + 40


def test_run(spark, kept):
    got = C.run(spark, SF)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in kept[-1].collect())


def test_stages_on_odd_rows(spark, odd, none, odd_rows, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, empty tables and names that operators use themselves."""
    labels = spark.createDataFrame([(6, 1), (15, 0), (16, 1), (None, 1), (3, None)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clashing = {"label": "_group", "h1": "shard", "row": "copies", "key": "c0", "n": "_file"}
    named = odd.withColumnsRenamed(clashing)
    for frame, rows in ((named, odd_rows), (none.withColumnsRenamed(clashing), [])):
        for i, (name, stage) in enumerate(C.STAGES):
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == [*frame.columns, *["shard_"] * (i == 4)], name
            got = Counter(tuple(r)[: len(frame.columns)] for r in out.collect())
            left = Counter(map(tuple, rows))
            if name == "mixing":
                assert set(got) <= set(left) and all(n <= 2 * left[r] for r, n in got.items()) and all(split(r[1]) for r in got)
            else:
                assert not got - left, name
            if name == "near-duplicates" and rows:
                groups = plain_groups([r[:2] for r in rows])
                assert got == Counter({r: n for r, n in left.items() if r[0] is None or groups[r[0]] == r[0]})
            if name == "decontamination" and rows:
                assert {r[0] for r in left - got} == {4, 5}
            if name == "sharding":
                assert got == left
