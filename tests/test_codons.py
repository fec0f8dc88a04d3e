"""Codon tests on simulated sequences: lengths are fitted, the stem edge alone is foreground."""

import numpy as np
import pytest

from sylva.operators import likelihood as ML
from sylva.operators.phylo import mrca
from sylva.sources.newick import parse_newick

TREE = "((a:0.2,b:0.3):0.6,(c:0.2,d:0.3):0.2,e:0.4);"


def simulated(n=400, omega=0.2, fore=0.2, kappa=2.0, seed=5, share=1.0):
    """Sequences in which the stem of (a, b) has an omega of its own at a share of the codons."""
    rng, pi = np.random.default_rng(seed), np.full(61, 1 / 61)
    root = parse_newick(TREE)
    slow, fast = ML.Model(ML.codon_exchange(kappa, omega), pi), ML.Model(ML.codon_exchange(kappa, fore), pi)
    top, changed = mrca(root, ["a", "b"]), rng.random(n) < share
    at = {id(root): rng.integers(0, 61, n)}
    for x in root.preorder():
        if x is not root:
            old = slow.p(x.length)[0]
            new = fast.p(x.length)[0] if x is top else old
            at[id(x)] = np.array([rng.choice(61, p=(q := (new if c else old)[s]) / q.sum()) for s, c in zip(at[id(x.parent)], changed)])
    tips = list(root.leaves())
    return root, [x.name for x in tips], ["".join(ML.SENSE[s] for s in at[id(x)]) for x in tips]


def wrong(root):
    root = root.copy()
    for x in root.preorder():
        if x is not root:
            x.length = 1.5
    return root


def test_m0_fits_lengths_and_omega():
    root, names, seqs = simulated()
    good, bad = ML.fit_codons(root, names, seqs), ML.fit_codons(wrong(root), names, seqs)
    assert good["logL"] == pytest.approx(bad["logL"], abs=0.02)
    assert bad["omega"] == pytest.approx(0.2, abs=0.04) and bad["kappa"] == pytest.approx(2, abs=0.4)
    lengths = [x.length for x in bad["tree"].preorder()][1:]
    assert lengths == pytest.approx([x.length for x in root.preorder()][1:], abs=0.12)
    codes, weight, _ = ML.encode(seqs, ML.SENSE)
    model = ML.Model(ML.codon_exchange(bad["kappa"], bad["omega"]), ML.f3x4(seqs))
    assert ML.Engine(bad["tree"], names, codes, weight, model).total() == pytest.approx(bad["logL"], abs=1e-6)


def test_only_the_stem_is_foreground():
    root, names, seqs = simulated(fore=3.0)
    out = ML.fit_codons(wrong(root), names, seqs, ["a", "b"])
    assert out["omega_foreground"] > 1 and out["omega_background"] == pytest.approx(0.2, abs=0.05)
    assert out["lrt"] > 10 and out["p"] < 0.01
    with pytest.raises(ValueError):
        ML.fit_codons(parse_newick("(((a:1,b:1):1,c:1):1,d:1,e:1);"), names, seqs, ["a", "c"])


def test_branch_site_fits_lengths_under_both_models():
    root, names, seqs = simulated(150, 0.05, 30.0, share=0.5)
    out = ML.branch_site_test(wrong(root), names, seqs, ["a", "b"])
    codes, weight, _ = ML.encode(seqs, ML.SENSE)
    low, high = ML.CodonModel(2.0, 0.05, pi := ML.f3x4(seqs)), ML.CodonModel(2.0, 30.0, pi)
    truth = ML.CodonMixture(root, names, codes, weight, [(0.5, low, low), (0.5, low, high)], ML.stem(root, ["a", "b"])).total()
    assert out["logL"] > truth and out["logL"] >= out["logL_null"] - 1e-3
    assert out["lrt"] > 3.84 and out["p"] < 0.05 and out["omega2"] > 1.5 and out["omega0"] < 0.15
    assert max(x.length for x in list(out["tree_null"].preorder())[1:]) < 1.4  # none stays as given
