"""Kernels against definitions and known values."""

import itertools

import numpy as np
import pytest

from sylva.functions import colors, numerics
from sylva.operators import building as B
from sylva.operators import comparative as C
from sylva.operators import likelihood as ML
from sylva.operators import networks as N
from sylva.plans import build
from sylva.sources.builtin import random_tree
from sylva.sources.newick import parse_newick


def test_likelihood_is_the_sum_over_states():
    root, names, seqs = parse_newick("((a:0.1,b:0.2):0.05,c:0.3,d:0.1);"), list("abcd"), ["ACGTAC", "ACGTTC", "ACTTAC", "GCGTAN"]
    codes, weight, _ = ML.encode(seqs, "ACGT")
    model = ML.make_model("HKY85", codes, weight, [2.5], 4, 0.7)
    total = 0
    for p in range(codes.shape[1]):
        like = 0
        for c, x, y in itertools.product(range(4), range(4), range(4)):
            t = model.pi[x] * model.p(0.05)[c][x, y]
            for tip, above, length in ((0, y, 0.1), (1, y, 0.2), (2, x, 0.3), (3, x, 0.1)):
                k = codes[tip, p]
                t *= model.p(length)[c][above].sum() if k < 0 else model.p(length)[c][above, k]
            like += t / 4
        total += weight[p] * np.log(like)
    assert ML.log_likelihood(root, names, seqs, "HKY85", [2.5], 4, 0.7) == pytest.approx(total, abs=1e-9)


def sequences(n=6, length=200, seed=0):
    rng = np.random.default_rng(seed)
    out = ["".join(rng.choice(list("ACGT"), length))]
    while len(out) < n:
        out.append("".join(c if rng.random() > 0.1 else rng.choice(list("ACGT")) for c in out[rng.integers(len(out))]))
    return [f"t{i}" for i in range(n)], out


def test_ml_improves_on_its_start():
    names, seqs = sequences()
    start = B.neighbor_joining(names, B.string_distances(seqs, "jc69"))
    root, said = ML.ml_tree(names, seqs, "HKY85")
    assert said["logL"] >= ML.log_likelihood(start, names, seqs, "HKY85") - 1e-6
    codes, weight, _ = ML.encode(seqs, "ACGT")
    assert ML.Engine(root, names, codes, weight, ML.make_model("HKY85", codes, weight, said["params"])).total() == pytest.approx(said["logL"])
    rows = ML.ancestral_sequences(root, names, seqs, "HKY85", 0)
    assert all(len(r["seq"]) == 200 for r in rows)


def test_codons_run():
    names, seqs = sequences(4, 60)
    root = B.neighbor_joining(names, B.string_distances(seqs, "jc69"))
    out = ML.fit_codons(root, names, seqs, names[:2], 1)
    assert out["omega"] > 0 and 0 <= out["p"] <= 1 and out["logL_two"] >= out["logL"] - 1
    assert ML.branch_site_test(root, names, seqs, names[:2], 5)["p"] <= 1


def test_special_functions():
    assert numerics.chi2_tail(3.841458820694124) == pytest.approx(0.05) and numerics.t_tail(2.2281388519649385, 10) == pytest.approx(0.05)
    assert numerics.f_tail(4.102821015130407, 2, 10) == pytest.approx(0.05) and numerics.gamma_rates(0.5, 4).mean() == pytest.approx(1)
    assert numerics.minimize_bounded(lambda x: (x - 0.3) ** 2, 0, 1)[0] == pytest.approx(0.3, abs=1e-5)
    assert numerics.nelder_mead(lambda v: ((v - [1, 2]) ** 2).sum(), np.zeros(2), 0.5)[0] == pytest.approx([1, 2], abs=1e-2)
    rng = np.random.default_rng(0)
    a, b = rng.random((30, 8)) - 0.4, rng.random(30)
    x = numerics.nnls(a, b)
    grad = a.T @ (b - a @ x)
    assert (x >= 0).all() and abs(grad[x > 0]).max() < 1e-7 and (grad[x == 0] < 1e-7).all()


def test_traits():
    root = parse_newick("((A:1,B:1):1,(C:1,D:1):1);")
    rows, said = ML.ace_ml(root, dict(zip("ABCD", "xxyy")))
    p = {(r["node"], r["state"]): r["p"] for r in rows}
    assert p[1, "x"] > 0.5 and p[4, "y"] > 0.5 and p[0, "x"] == pytest.approx(0.5)
    mapped = {(r["node"], r["state"]): r["p"] for r in ML.stochastic_map(root, dict(zip("ABCD", "xxyy")), 300, rate=float(said["rates"][0]))}
    assert abs(mapped[1, "x"] - p[1, "x"]) < 0.12
    assert C.ace_parsimony(root, dict(zip("ABCD", "xxyy")))[1] == 1


def test_comparative_models():
    root = random_tree(15, 4)
    names = root.names()
    v = C.vcv(root, names)
    x = np.linalg.cholesky(v) @ np.random.default_rng(2).standard_normal(15)
    trait = dict(zip(names, x))
    fits = {m: C.fit_continuous(root, trait, m) for m in C.CONTINUOUS}
    assert fits["lambda"]["logL"] >= max(fits["BM"]["logL"], fits["white"]["logL"] - 5) - 1e-6 and fits["OU"]["logL"] >= fits["BM"]["logL"] - 1e-2
    y = {n: 2 * t + 1 for n, t in trait.items()}
    out = C.pgls(root, {n: y[n] + 1e-3 * i for i, n in enumerate(names)}, trait, n_boot=3)
    assert out["terms"][1]["estimate"] == pytest.approx(2, abs=0.05) and out["terms"][1]["p"] < 1e-6
    import pandas as pd

    scores, loadings, w = C.phylo_pca(root, pd.DataFrame({"a": x, "b": x[::-1]}, names))
    assert (np.diff(w) <= 0).all() and scores.shape == (15, 2)


def test_paco(spark):
    d = C.vcv(random_tree(8, 1), random_tree(8, 1).names())
    names = random_tree(8, 1).names()
    m = d.diagonal()[:, None] + d.diagonal()[None] - 2 * d
    out = C.paco(spark, (names, m), ([f"s{n}" for n in names], m), [(n, f"s{n}") for n in names], 99)
    assert out["m2"] == pytest.approx(0, abs=1e-9) and out["p"] <= 0.05


def test_splits():
    net = N.SplitNetwork(list("ABCD"), {frozenset("AB"): 1.0, frozenset("BC"): 1.0})
    vertices, edges = net.network()
    assert len(net.conflicts()) == 1 and len(vertices) == 4 and len(edges) == 4
    root = random_tree(9, 5)
    names = root.names()
    v = C.vcv(root, names)
    d = v.diagonal()[:, None] + v.diagonal()[None] - 2 * v
    net = N.SplitNetwork.from_distances(names, d)
    assert N.residual(names, d, net.splits) < 1e-9 and not net.conflicts()


def test_components(spark):
    names = spark.createDataFrame([(f"n{i:02d}",) for i in range(12)], "name string")
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in (0, 1, 2, 3, 5, 6)], "x string, y string, w double")
    got = {r.name: (r.component, r.size, r.place) for r in N.connected_components(names, edges).collect()}
    assert got["n04"] == ("n00", 5, 1) and got["n07"] == ("n05", 3, 2) and got["n11"][1] == 1


def test_alignment_of_equal_parts():
    rows = B.align(["a", "b", "c"], ["ACGTACGTAC", "ACGTCGTAC", "ACGTACGAC"])
    assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == ["ACGTACGTAC", "ACGTCGTAC", "ACGTACGAC"]


def test_constraint():
    names, seqs = sequences(8)
    d = B.string_distances(seqs, "jc69")
    root = B.constrained_nj(names, d, {"t0": "g", "t3": "g", "t5": "g"})
    assert frozenset(["t0", "t3", "t5"]) in B.split_sets(root) or frozenset(set(names) - {"t0", "t3", "t5"}) in B.split_sets(root)


def test_build_tree(spark):
    names, seqs = sequences(5, 60)
    records = spark.createDataFrame([("x", i, n, s) for i, (n, s) in enumerate(zip(names, seqs))], "aln_id string, row_ord int, name string, seq string")
    for options in ({"root": "midpoint", "bootstrap": 3}, {"method": "parsimony"}, {"method": "ml", "ml_model": "JC69", "search": False}, {"method": "upgma", "trim": {"max_gap": 0.9}}):
        assert build.build_tree(records, **options).filter("is_leaf").count() == 5
    with pytest.raises(ValueError):
        build.build_tree(records, method="magic")
    with pytest.raises(ValueError):
        build.build_tree(records, method="ml", bootstrap=5)


def test_colors():
    assert colors.lerp_color("#000000", "#ffffff", 0) == "#000000" and colors.lerp_color("#000000", "#ffffff", 1) == "#ffffff"
    assert colors.readable_on("#ffffff") == "black" and colors.readable_on("#000000") == "white" and len(set(colors.categorical_palette(20))) == 20
    assert len(colors.hue_palette(5)) == 5
