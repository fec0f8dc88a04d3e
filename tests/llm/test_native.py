"""Near-duplicates, lines, decontamination, rules and mixing against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sylva.llm import _skew, decontaminate, line_runs, mix_budget, odd_minhash, queries, rule_lists

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text, lower=True):
    text = (text or "").translate(LOW) if lower else text or ""
    return [w for w in BLANK.split(text) if w]


def grams(text, k):
    w = split(text)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
        expected = c.sql(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).select(*expected.columns).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, expected.values.tolist()))


def test_rows_that_share_an_id_are_one_document(spark):
    """Equal ids with different texts against plain Python: an id's texts are linked, whatever else they are like."""
    rng = random.Random(8)
    texts = [[f"t{j}w{i}" for i in range(80)] for j in range(12)]
    rows = []
    for i in range(90):
        w = list(rng.choice(texts))
        if rng.random() < 0.5:
            w[rng.randrange(80)] = "other"
        rows.append((rng.randrange(1000) if i % 9 else rng.choice([5, 6, 7]), " ".join(w)))
    rows += [(5, ""), (2000, ""), (2001, None), (None, " ".join(texts[0]))]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, set(grams(t, 3))) for i, t in rows if i is not None]
    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    got = odd_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 85).collect()
    assert len(got) == len(rows) and len({find(i) for i in parent}) > 5
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles and r.doc_id is not None} == {(i, find(i)) for i, a in sets if a}
    assert all(r.component_id == r.doc_id and r.kept for r in got if not r.n_shingles or r.doc_id is None)


def test_blocks_meet_once(spark, tmp_path):
    rows = [(k, i, i % 3, 100, 1000, [0] * 8) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)]
    got = odd_minhash._in_blocks(spark.createDataFrame(rows, "key long, rep long, part long, n long, most long, sketch array<long>"), 0, 4, f"file://{tmp_path}/m").collect()
    assert sorted(map(tuple, got)) == [(a, b) for a in range(50) for b in range(a + 1, 50) if a % 3 != b % 3]


def test_pairs_in_blocks_do_not_become_rows(spark, tmp_path):
    """A family of mutual copies gives links that join it, not its pairs; what sketches let pass and sets do not is no link."""
    base = list(range(100))
    sets = {i: [*base, 1000 + i] for i in range(120)} | {i: [10_000 * i + x for x in range(101)] for i in range(120, 130)}
    rows = [(key, i, i, 101, 1000, [-1] * 8) for key in (1, 2) for i in sets]
    table = spark.createDataFrame(rows, "key long, rep long, part long, n long, most long, sketch array<long>")
    got = odd_minhash.linked_in_blocks(table, spark.createDataFrame(list(sets.items()), "rep long, shingles array<long>"), 0, 85, 50, f"file://{tmp_path}/m").collect()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        assert a < b < 120
        parent[find(b)] = find(a)
    assert len({find(i) for i in range(120)}) == 1 and len(got) < 1000 < 120 * 119 / 2


def test_rows_alone_in_their_bucket_leave_at_once(spark, monkeypatch):
    """Only rows of buckets with several classes go through lookups by key, which pass rows of other keys on."""
    rows = [(i, " ".join(f"t{i}w{j}" for j in range(30))) for i in range(80)]
    rows += [(100 + i, " ".join(f"base{j}" for j in range(60)) + f" end{i}") for i in range(3)]
    handed, lookup = [], _skew.lookup

    def counted(rows, table, keys, *rest):
        if keys == ["key"]:
            handed.append(rows.count())
        return lookup(rows, table, keys, *rest)

    monkeypatch.setattr(_skew, "lookup", counted)
    got = odd_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: min(i, 100) for i, _ in rows}
    assert handed and max(handed) <= 3 * odd_minhash.bands_for(0.85) < 80 * odd_minhash.bands_for(0.85)


def test_near_duplicates_of_odd_rows(odd, none, odd_rows):
    got = sorted(odd_minhash.near_duplicates(odd, 3, 85).collect(), key=str)
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].n_shingles for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
    assert all(by[i].component_id == 6 for i in (6, 7, 8, 9, 10)) and by[5].component_id == 4 and by[12].component_id == 11
    assert all(r.kept for r in got if r.doc_id is None)
    assert odd_minhash.near_duplicates(none, 3, 85).collect() == []
    kept = odd_minhash.dedup(odd, 3, 85)
    assert kept.columns == odd.columns and {8, 10, 12}.isdisjoint(r.doc_id for r in kept.collect())


def test_every_copy_of_a_chain_is_found(spark):
    """Copies that are alike only through others, in buckets with one centre."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(8):
            w[(i * 37 + j * 50) % 400] = f"x{i}_{j}"
        rows.append((i + 1, " ".join(w)))
    rows.append((0, " ".join(base)))
    want = {}
    sets = {i: set(grams(t, 3)) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {i: find(i) for i in sets}
    for centres, spare in (((1, 8, 64), 0), ((1, 2), 64)):
        got = odd_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, centres=centres, spare=spare, block=16, broadcast_ids=spare)
        assert {r.doc_id: r.component_id for r in got.collect()} == want


def plain_lines(rows, least=20, docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for i, text, *_ in rows:
        if i is not None:
            for x in (text or "").split("\n"):
                held[key(x)].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < least or len(held[key(x)]) < docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_of_odd_rows(odd, none, odd_rows):
    got = line_runs.dedup_lines(odd).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got], key=str) == plain_lines(odd_rows)
    assert any(r.n_dropped for r in got)
    assert line_runs.dedup_lines(none).collect() == []


def test_runs_level_up(spark, tmp_path):
    runs = line_runs.LineRuns(spark, f"file://{tmp_path}", fanout=2, buckets=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, k, 1, 100 - b) for k in (1, 10 + b)], "h1 long, h2 long, n_docs long, last long"))
        assert all(len(x) < 2 for x in runs.levels.values())
    assert sorted(runs.levels) == [0, 2]
    assert runs.unseen(spark.createDataFrame([(1, 1), (99, 99)], "h1 long, h2 long")).collect() == [(99, 99)]
    whole = {r.h1: (r.n_docs, r.last) for r in runs.compact().collect()}
    assert whole == {1: (5, 100)} | {10 + b: (1, 100 - b) for b in range(5)}
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sylva_run_")] and not any(tmp_path.iterdir())


@pytest.mark.parametrize("broken", [lambda self, batch: batch, lambda self, batch: batch.limit(0)])
def test_lines_rest_on_the_anti_join(spark, monkeypatch, broken):
    rows = [(i, "\n".join(["a line that all documents hold", f"a line of document {i} alone"] + ["a line of the first few documents"] * (i < 6))) for i in range(40)]
    frame, right = spark.createDataFrame(rows, "doc_id long, text string"), plain_lines(rows)
    verdict = lambda: sorted([(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in line_runs.dedup_lines(frame).collect()], key=str)
    assert verdict() == right
    monkeypatch.setattr(line_runs.LineRuns, "unseen", broken)
    assert verdict() != right


def test_heavy_keys_meet_all_their_rows(spark, monkeypatch):
    monkeypatch.setattr(_skew, "MOST", 4)
    rows = [(k, i) for k, n in ((1, 50), (2, 3), (3, 1), (4, 1), (None, 2)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k long, i long")
    table = spark.createDataFrame([(1, 50, "a"), (2, 3, "b"), (3, 1, "c"), (9, 1, "z")], "k long, n long, v string")
    assert sorted(tuple(r) for r in _skew.lookup(frame, table, ["k"], "n").select("k", "i", "v").collect()) == sorted((k, i, {1: "a", 2: "b", 3: "c"}[k]) for k, i in rows if k in (1, 2, 3))


def brute_leaks(rows, items, k=5, least=0.8):
    found = defaultdict(set)
    sized = [(item, Counter(grams(t, k)), len(split(t))) for item, t in items]
    for i, text in rows:
        w, held = split(text), set(grams(text, k))
        for item, g, n in sized:
            if not g or (n >= k and held.isdisjoint(g)):
                continue
            for s in range(max(1, len(w) - n + 1)):
                x = Counter(grams(" ".join(w[s : s + n]), k))
                if x and sum((x & g).values()) >= least * sum((x | g).values()):
                    found[i].add(item)
    return found


def test_leaks_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    long = [w for _, t in items for w in split(t)][:60]
    swapped = list(long)
    swapped[30] = "changed"
    items += [(900, " ".join(long)), (901, "tiny item")]
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    for n in (9, 13, 30, 61):  # items of several sizes, some with repeated shingles; windows that are shuffled in pieces, cut, or changed here and there
        own = [rng.choice(vocabulary) for _ in range(n)] if n < 30 else [f"q{n}_{i}" for i in range(n)]
        own = own[: n // 2] * 2 if n == 13 else own
        items.append((910 + n, " ".join(own)))
        for j in range(24):
            cut, w = rng.randrange(1, len(own)), list(own)
            if j % 3 == 0:
                w = w[cut:] + w[:cut]
            for _ in range(j % 4):
                w[rng.randrange(len(w))] = "other"
            docs.append((2000 + 100 * n + j, " ".join(["pre"] * rng.randrange(5) + w[: len(w) - (j % 5 == 4)] + ["post"] * rng.randrange(5))))
    docs += [(900, "before " + " ".join(swapped) + " after"), (901, "Tiny  ITEM"), (902, " ".join(long[:58])), (903, " ".join(long[:40])), (904, None)]
    shape = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    assert len(brute_leaks(docs[-101:], items[-6:])) > 20
    for size, small in ((20_000, 1_000_000), (3000, 0)):
        got = decontaminate.leaks(shape(docs, "doc_id"), shape(items, "item_id"), block_shingles=size, small=small).collect()
        found = defaultdict(set)
        for r in got:
            found[r.doc_id].add(r.item_id)
        assert dict(found) == dict(brute_leaks(docs, items))
    assert found[900] and found[901] and found[902] and 903 not in {d for d in found if 900 in found[d]}


def test_decontaminate_odd_rows(spark, odd, none, odd_rows):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "zzz")], "item_id long, text string")
    got = decontaminate.contaminated(odd, items).collect()
    assert len(got) == len(odd_rows) and {r.doc_id for r in got if r.contaminated} == {4, 5}
    left = decontaminate.decontaminate(odd, items)
    assert left.columns == odd.columns and left.count() == len(odd_rows) - 2
    assert decontaminate.contaminated(none, items).collect() == []
    assert not any(r.contaminated for r in decontaminate.contaminated(odd, items.limit(0)).collect())


def plain_statistics(text):
    text = text or ""
    w = split(text, lower=False)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    inside = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_statistics(spark, odd, none, odd_rows):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    for frame, own in ((documents(spark), rows), (odd, [r[:2] for r in odd_rows])):
        got = rule_lists.statistics(frame).collect()
        assert sorted(((r.doc_id, *(r[c] for c in rule_lists.BASE)) for r in got), key=str) == sorted(((i, *plain_statistics(t)) for i, t in own), key=str)
    assert rule_lists.statistics(none).collect() == []


def test_rules_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, sf).collect()}
    import zlib

    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    bad = [got[r.doc_id].kept for r in labels if r.quality == 0]
    good = [got[r.doc_id].kept for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    assert sum(bad) <= 0.2 * len(bad) and sum(good) >= 0.97 * len(good)


def test_rule_lists_learn_thresholds(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(600):
        x = {f: float(rng.random()) for f in rule_lists.FEATURES}
        rows.append((x, x["symbol_share"] > 0.8 or (x["repeat_share"] > 0.5 and x["mean_word"] <= 0.4)))
    rules = rule_lists.learn(rows, precision=0.9)
    wrong = sum(any(rule_lists._covers(r, x) for r in rules) != y for x, y in rows)
    assert rules and wrong < 40
    assert rule_lists.learn([(x, False) for x, _ in rows]) == [] and rule_lists.learn([]) == []


def test_targets():
    assert mix_budget.targets({"a": 100, "b": 100, None: 100}) == {"a": 200.0, "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    assert mix_budget.targets({"é": 0, "a": 10}) == {"a": 15.0, "é": 0.0}


def test_targets_in_spark_are_the_plain_ones(spark, tmp_path):
    rng = np.random.default_rng(3)
    for n, weights, percent in ((0, (3, 1, 2), 150), (1, (3, 1, 2), 150), (40, (3, 1, 2), 150), (7, (1, 5), 190), (5, (3, 1, 2), 250)):
        sizes = {f"s{chr(945 + i)}{i % 3}": int(rng.integers(0, 5000)) for i in range(n)} | ({None: 70} if n > 1 else {})
        frame = spark.createDataFrame([(s, w, 1) for s, w in sizes.items()], "source string, size long, n long").repartition(5)
        got = {r.source: r.target for r in mix_budget._sources(frame, weights, percent, 2, f"file://{tmp_path}/{n}").collect()}
        want = mix_budget.targets(sizes, weights, min(percent, 200))
        assert got == {s: pytest.approx(t) for s, t in want.items()}


@pytest.mark.parametrize("seed", range(5))
def test_budget_is_met(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 400, 60))
    counts = rng.integers(1, 9, len(lengths))
    for target in (0.0, 37.0, float(lengths @ counts) * 0.6, float(lengths @ counts) * 1.4, float(lengths @ counts) * 2):
        rounds, extra = mix_budget.fit(lengths, counts, target)
        total = int(rounds * (lengths @ counts) + lengths @ extra)
        assert (extra >= 0).all() and (extra <= counts).all() and total <= round(target) and round(target) - total <= 2


@pytest.mark.parametrize("seed", range(8))
def test_knapsack_against_all_subsets(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 60, 7)) * (3 if seed % 2 else 1)
    there, budget = rng.integers(0, 4, len(lengths)), int(rng.integers(0, 160))
    sums = {0}
    for n, times in zip(lengths.tolist(), there.tolist()):
        sums = {s + n * t for s in sums for t in range(times + 1)}
    taken = mix_budget._knapsack(lengths, there, budget, rng.permutation(len(lengths)))
    assert (taken <= there).all() and int(lengths @ taken) == max(s for s in sums if s <= budget)


def test_the_fit_takes_the_same_share_of_short_and_long():
    for n in (2_000, 20_000, 300_000):  # every length once: far more words than any table of sums
        lengths = np.arange(1, n + 1)
        rounds, extra = mix_budget.fit(lengths, np.ones(n, np.int64), 0.3 * lengths.sum())
        assert rounds == 0 and all(abs(x.mean() - 0.3) < 0.01 for x in np.array_split(extra, 3)) and round(0.3 * int(lengths.sum())) == int(lengths @ extra)


def test_the_mix_takes_the_same_share_of_short_and_long(spark):
    sf = "/root/testdata/sf0.01"
    rows = mix_budget._mix(spark.read.parquet(f"{sf}/documents.parquet")).filter("size > 0").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append((r["size"], r.copies))
    for own in by.values():
        own = np.array(sorted(own))
        if len(own) < 90:
            continue
        share = own[:, 1].mean()
        assert all(abs(x[:, 1].mean() - share) <= 0.1 * share + 0.02 for x in np.array_split(own, 3))


def test_rows_alike_are_taken_as_often_as_planned(spark):
    """Two kinds of rows, each many times: counts in the mix are the plan's, though no hash tells the rows apart."""
    rows = [(7, "a b c d", "s", i % 2) for i in range(300)] + [(None, "a b", None, 0)] * 100 + [(8, "x " * 40, "t", 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kind int").repartition(6)
    planned = Counter()
    for r in mix_budget._mix(docs).collect():
        planned[r.doc_id] += r.copies
    out = mix_budget.mixed(docs).collect()
    assert Counter(r.doc_id for r in out) == planned and sorted(out, key=str) == sorted(mix_budget.mixed(docs.repartition(3)).collect(), key=str)
    goal = mix_budget.targets({"s": 1200, "t": 120, None: 200})
    assert abs(planned[7] * 4 - goal["s"]) <= 4 and abs(planned[None] * 2 - goal[None]) <= 2 and abs(planned[8] * 40 - goal["t"]) <= 40


def test_mix(spark, odd, none, odd_rows):
    frame = documents(spark)
    got = mix_budget.mix(frame, cells=4)
    rows = got.collect()
    assert sorted(rows) == sorted(mix_budget.mix(frame.repartition(7), cells=4).collect())
    sizes = {r.doc_id: len(split(r.text)) for r in frame.collect()}
    source = {r.doc_id: r.source for r in frame.collect()}
    taken = Counter()
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[source[r.doc_id]] += r.taken
    target = {source[r.doc_id]: r.target for r in rows}
    assert len(rows) == frame.count() and all(abs(taken[s] - target[s]) < 0.01 * target[s] + 20 for s in target)
    out = mix_budget.mixed(frame)
    assert out.columns == frame.columns
    assert mix_budget.mix(none).collect() == []
    assert mix_budget.mix(odd).count() == len(odd_rows) and mix_budget.mixed(odd).columns == odd.columns
