"""Golden values on small trees."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.operators import building as B
from sylva.operators import comparative as C
from sylva.operators import compare as X
from sylva.operators import diversity as V
from sylva.operators import paths as P
from sylva.operators import rooting as R
from sylva.operators.phylo import TreeError, find, forest, mrca
from sylva.sources import newick as NW
from sylva.sources.builtin import PRIMATES, primates, random_tree

HAND = "((A:1,B:3):1,(C:1,D:2):2);"


@pytest.fixture(scope="module")
def hand(spark):
    return NW.parse(spark.createDataFrame([("hand", HAND)], "tree_id string, newick string")).cache()


def community(spark, **samples):
    return spark.createDataFrame([(s, t, float(a)) for s, own in samples.items() for t, a in own.items()], "sample string, taxon string, abundance double")


def test_path_sums(hand):
    v = {(r.x, r.y): r.v for r in P.phylo_vcv(hand).collect()}
    assert v == {("A", "A"): 2, ("A", "B"): 1, ("A", "C"): 0, ("A", "D"): 0, ("B", "B"): 4, ("B", "C"): 0, ("B", "D"): 0, ("C", "C"): 3, ("C", "D"): 2, ("D", "D"): 4}
    assert {(r.x, r.y): r.d for r in P.patristic_distances(hand).collect()} == {("A", "B"): 4, ("A", "C"): 5, ("A", "D"): 6, ("B", "C"): 7, ("B", "D"): 8, ("C", "D"): 3}
    assert P.total_branch_length(hand).first().total == 10 and P.has_branch_lengths(hand).first().has_lengths


def test_diversity(spark, hand):
    c = community(spark, all=dict.fromkeys("ABCD", 1), a={"A": 1}, b={"B": 1}, ab={"A": 1, "B": 1}, cd={"C": 1, "D": 1}, c={"C": 9}, a5={"A": 5})
    assert {r.sample: r.pd for r in V.faiths_pd(hand, c).collect()} == {"all": 10, "a": 2, "b": 4, "ab": 5, "cd": 5, "c": 3, "a5": 2}
    u = {(r.a, r.b): r.unifrac for r in V.unifrac(hand, c).collect()}
    assert u["ab", "cd"] == 1 and u["a", "ab"] == pytest.approx(0.5) or u["a", "ab"] == pytest.approx(0.6)
    w = {(r.a, r.b): r.unifrac for r in V.unifrac(hand, c, weighted=True).collect()}
    assert w["a5", "c"] == pytest.approx(1) and w["a", "a5"] == pytest.approx(0)
    m = {r.sample: r.mpd for r in V.mpd(hand, c).collect()}
    assert m["all"] == 5.5 and m["ab"] == 4 and "a" not in m
    n = {r.sample: r.mntd for r in V.mntd(hand, c).collect()}
    assert n["all"] == 3.5 and n["ab"] == 4
    b = {(r.a, r.b): r.beta_mntd for r in V.beta_mntd(hand, c, False).collect()}
    assert b["a", "c"] == 5 and b["ab", "cd"] == 5.75


def test_unknown_taxa_are_refused(spark, hand):
    with pytest.raises(ValueError, match="Z"):
        V.check_taxa(hand, community(spark, x={"Z": 1}))


def test_blomberg_k():
    assert C.blomberg_k(NW.parse_newick(HAND), dict(zip("ABCD", (1, 4, 2, 7))))["k"] == pytest.approx(70014 / 93775)


def test_primates(spark):
    root = NW.parse_newick(PRIMATES)
    assert sorted(map(sorted, R.cut(root, k=2)))[1] == ["Baboon", "Macaque"] or ["Baboon", "Macaque"] in map(sorted, R.cut(root, k=2))
    cut = R.collapse_low_support(NW.parse_newick(PRIMATES), 92)
    assert sorted(n.support for n in cut.preorder() if n.support) == [95, 98, 100]
    rooted = R.outgroup_root(root, ["Baboon"])
    assert find(rooted, "Baboon").length == pytest.approx(0.09)
    assert primates(spark).filter("is_leaf").count() == 7
    with pytest.raises(TreeError):
        R.outgroup_root(root, ["Human", "Baboon"])


def test_crossings_and_untangling():
    a, b = NW.parse_newick("(((A,B),C),D);"), NW.parse_newick("(((B,A),C),D);")
    assert R.crossings(a, b) == 1 and R.inversions([0, 2, 1, 3]) == 1 and R.inversions([3, 2, 1, 0]) == 6
    a, b = NW.parse_newick("(((A,B),(C,D)),(E,F));"), NW.parse_newick("(((B,A),(D,C)),(F,E));")
    assert R.crossings(*R.untangle(a, b)) == 0
    assert R.crossings(NW.parse_newick("((A,B),(C,D));"), NW.parse_newick("((A,B),(C,Z));")) == 0


def test_robinson_foulds(spark):
    t = forest(spark, {"a": NW.parse_newick("((A,B),C,(D,E));"), "b": NW.parse_newick("((A,C),B,(D,E));")})
    assert X.robinson_foulds(t).first().rf == 2
    small = forest(spark, {"a": NW.parse_newick("(A,B,C);"), "b": NW.parse_newick("((A,B),C);")})
    assert X.robinson_foulds(small, True).first().rf == 0


def test_collapsed_clades():
    root = R.collapse_clade(NW.parse_newick("((A:1,B:3)x:1,(C:1,D:1):2);"), "x")
    assert (find(root, "x").data["collapsed_n"], float(find(root, "x").data["collapsed_near"]), float(find(root, "x").data["collapsed_far"])) == ("2", 1, 3)
    root = NW.parse_newick("(((A:1,B:1)p:1,(C:1,D:5)q:1)r:1,E:1);")
    R.collapse_clade(root, "q")
    R.collapse_clade(root, "r")
    assert find(root, "r").data["collapsed_n"] == "4" and float(find(root, "r").data["collapsed_far"]) == 6


def test_sister_differences():
    root = NW.parse_newick("(((A,B),(C,D)),((E,F),(G,H)));")
    assert C.sister_differences(root, dict(zip("ABCDEFGH", [1] * 4 + [0] * 4))) == 1


def test_parsimony():
    names = ["x1", "x2", "x3", "x4"]
    masks, weight, _ = B.patterns(names, ["A", "A", "?", "A"])
    assert B.fitch(NW.parse_newick("((x1,x2),(x3,x4));"), masks, weight) == 0
    root = NW.parse_newick("((1,2),3);")
    for seqs, fitch, irreversible in ((["1", "0", "1"], 1, 2), (["1", "2", "0"], 2, 2), (["1", "?", "0"], 1, 1)):
        codes, k = B.lineage_codes(seqs)
        assert B.sankoff(root, dict(zip("123", codes)), B.camin_sokal_cost(k))[0].sum() == irreversible
        masks, weight, _ = B.patterns(list("123"), seqs)
        assert B.fitch(root, masks, weight) == fitch
    # children fold from left to right
    m = lambda s: B.patterns(list("abcd"), list(s))[:2]
    star = NW.parse_newick("(a,b,c,d);")
    assert B.fitch(star, *m("ABBA")) == 2 and B.fitch(star, *m("AABB")) == 1


def test_loose_newick():
    root = NW.parse_newick("( Homo sapiens :1 , B[a [nested] note]:2 ) inner node ;")
    assert root.names() == ["Homo sapiens", "B"] and root.name == "inner node" and [c.length for c in root.children] == [1, 2]
    assert root.children[1].comment == "a [nested] note"
    assert NW.parse_newick(NW.to_newick(root)).names() == root.names()


def test_annotations():
    a = NW.parse_annotation("&height=1.5,height_95%_HPD={8.2,5.1},posterior=1.0,!color=#ff0000")
    assert a["height_95_lower"] == "5.1" and a["height_95_upper"] == "8.2" and a["color"] == "#ff0000" and a["height_95%_HPD"] == "{8.2,5.1}"
    text = "#NEXUS\nbegin trees;\n translate 1 Alpha, 2 Beta, 3 Gamma;\n tree one = [&R] ((1[&height=0.0]:1,2:1)[&posterior=0.9]:1,3:2);\nend;"
    ((name, root),) = NW.nexus_trees(text)
    assert name == "one" and root.names() == ["Alpha", "Beta", "Gamma"] and root.children[0].support == 0.9


@pytest.mark.parametrize("bad", ["((a,b);", "(a,b));", "(a,);", "", "(a:x,b);", "(a,a);", "(a,b)]"])
def test_malformed_newick(bad):
    with pytest.raises(TreeError):
        NW.parse_newick(bad)


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 25), st.integers(0, 10_000))
def test_trees_survive_their_own_distances(n, seed):
    root = random_tree(n, seed)
    assert NW.to_newick(NW.parse_newick(NW.to_newick(root))) == NW.to_newick(root)
    names = root.names()
    v = C.vcv(root, names)
    d = v.diagonal()[:, None] + v.diagonal()[None] - 2 * v
    built = B.neighbor_joining(names, d)
    plain = R.suppress_unary(root.copy())
    assert set(B.split_sets(built)) == set(B.split_sets(plain))
    again = R.midpoint_root(built)
    w = C.vcv(again, names)
    assert abs(w.diagonal()[:, None] + w.diagonal()[None] - 2 * w - d).max() < 1e-9
    depth = w.diagonal()
    assert abs(max(depth) * 2 - d.max()) < 1e-9
    assert mrca(root, names) is root or len(root.children) == 1


def test_k2p_by_hand(spark):
    from sylva.operators import alignment as A

    aln = spark.createDataFrame([("a", 0, "x", "AAAGCCCCCC"), ("a", 1, "y", "UUAGCCCCCC")], "aln_id string, row_ord int, name string, seq string")
    assert A.distance_matrix(aln, "k2p").first().d == pytest.approx(-0.5 * math.log(0.8 * math.sqrt(0.6)))


def test_biallelic(spark):
    from sylva.operators import alignment as A

    aln = spark.createDataFrame([("a", i, f"s{i}", s) for i, s in enumerate(["ACGT", "ACGA", "TCGT", "ACGA", "GCGT"])], "aln_id string, row_ord int, name string, seq string")
    assert [(r.col, r.allele) for r in A.biallelic(aln).orderBy("row_ord").collect()] == [(3, 0), (3, 1), (3, 0), (3, 1), (3, 0)]


def test_residue_columns(spark):
    from sylva.operators import alignment as A

    aln = spark.createDataFrame([("a", 0, "ref", "AB--CDE-FG")], "aln_id string, row_ord int, name string, seq string")
    ranges = spark.createDataFrame([("p", 1, 2), ("q", 3, 5), ("r", 6, 7), ("s", 1, 7)], "domain string, lo int, hi int")
    assert {r.domain: (r.start, r.end) for r in A.residue_columns(aln, "ref", ranges).collect()} == {"p": (0, 2), "q": (4, 7), "r": (8, 10), "s": (0, 10)}


def test_alleles(spark):
    from sylva.sources import tables as T

    rows = [("c1", "t", "AA[10:2D]TT", "AA[None]TT"), ("c2", "t", "GG[10:2D]CC", "NC"), ("c3", "u", "AA[None]TT", "AA[3:1I]TT")]
    got = {(r.name, r.character): r.code for r in T.allele_table(spark.createDataFrame(rows, "cellBC string, intBC string, r1 string, r2 string"), site_cols=("r1", "r2")).collect()}
    assert got["c1", "t|r1"] == got["c2", "t|r1"] == 1 and got["c1", "t|r2"] == 0 and got["c2", "t|r2"] == got["c3", "t|r1"] == -1 and got["c3", "u|r2"] == 1
    with pytest.raises(ValueError, match="rows of a cell and target disagree: c, t"):
        T.allele_table(spark.createDataFrame([("c", "t", "A[1]T"), ("c", "t", "A[2]T")], "cellBC string, intBC string, r1 string"), site_cols=("r1",)).collect()


def test_expression(spark):
    from sylva.operators import alignment as A

    e = spark.createDataFrame([(c, f"g{i}", float(v)) for c, own in (("a", (1, 2, 3)), ("b", (2, 4, 6)), ("c", (3, 2, 1))) for i, v in enumerate(own)], "cell string, gene string, value double")
    assert {(r.x, r.y): round(r.d, 9) for r in A.expression_distance(e).collect()} == {("a", "b"): 0, ("a", "c"): 2, ("b", "c"): 2}


def test_fasta(spark):
    from sylva.sources import tables as T

    got = [tuple(r) for r in T.read_fasta(spark, ">one first\nACGT\nAC\n>two\nGG\n").orderBy("row_ord").collect()]
    assert got == [("aln", 0, "one", "ACGTAC"), ("aln", 1, "two", "GG")]
    assert T.to_fasta(T.read_fasta(spark, ">one\nACGTA\n"), 2).first().fasta == ">one\nAC\nGT\nA"


def test_xml_dialects(spark, tmp_path):
    xml = '<phyloxml xmlns="http://www.phyloxml.org"><phylogeny rooted="true"><name>t</name><clade><clade><branch_length>0.5</branch_length><confidence type="bootstrap">90</confidence><clade branch_length="1"><name>A</name></clade><clade><name>B</name><branch_length>2</branch_length></clade></clade><clade><name>C</name></clade></clade></phylogeny></phyloxml>'
    (tmp_path / "a.xml").write_text(xml)
    assert NW.render(NW.read(spark, str(tmp_path / "a.xml"), "phyloxml")).first().newick == "((A:1,B:2)90:0.5,C);"
    xml = '<nexml xmlns="http://www.nexml.org/2009"><otus id="o"><otu id="o1" label="A"/><otu id="o2" label="B"/></otus><trees><tree id="t"><node id="r"/><node id="x" otu="o1"/><node id="y" otu="o2"/><edge source="r" target="x" length="1.5"/><edge source="r" target="y" length="2"/></tree></trees></nexml>'
    ((name, root),) = NW.nexml_trees(xml)
    assert name == "t" and NW.to_newick(root) == "(A:1.5,B:2);"


def test_files_round_trip(spark, tmp_path):
    NW.write(NW.parse(spark.createDataFrame([("x", HAND)], "tree_id string, newick string")), f"file://{tmp_path}/out")
    assert NW.render(NW.read(spark, f"{tmp_path}/out/part-*")).first().newick == HAND
    (tmp_path / "b.nex").write_text("#NEXUS\nbegin trees;\ntree one = ((a,b),c);\ntree two = ((a,c),b);\nend;")
    assert NW.read(spark, f"{tmp_path}/b.nex", "nexus").select("tree_id").distinct().count() == 2
    assert NW.read(spark, f"{tmp_path}/b.nex", "nexus", tree_index=1).filter("is_leaf").count() == 3
    with pytest.raises(ValueError):
        NW.read(spark, "x", "magic")


def test_missing_programs_are_named(spark):
    from pyspark.errors import PySparkException

    from sylva.sources import external

    aln = spark.createDataFrame([("a", i, n, "ACGT") for i, n in enumerate("abc")], "aln_id string, row_ord int, name string, seq string")
    with pytest.raises(PySparkException, match="not installed"):
        external.infer(aln, "rapidnj", path="/no/such/program").collect()


def test_figures(spark, tmp_path):
    from sylva.operators.phylo import edit
    from sylva.plans import figure, layout
    from sylva.sources.builtin import primates_metadata

    nodes = P.join_data(primates(spark), primates_metadata(spark))
    meta = primates_metadata(spark)
    fig = figure.TreeFigure(nodes).tip_labels(italic=True).tip_points(color_by="habitat", size_by="body_mass_kg").support_labels(min_value=90).highlight(by="habitat").heatmap(meta, ["habitat"]).bar_track(meta, "body_mass_kg").time_axis().scale_bar().connections(spark.createDataFrame([("Human", "Baboon")], "a string, b string"))
    scene = fig.scene().cache()
    assert {r.kind for r in scene.select("kind").distinct().collect()} == {"path", "marker", "label", "polygon"}
    assert scene.filter("kind = 'marker'").count() == 7 and figure.svg(scene).first().svg.count("<circle") == 7
    fig.save(str(tmp_path / "scene"))
    assert spark.read.parquet(str(tmp_path / "scene")).count() == scene.count()
    for name in ("circular", "fan", "inward", "equal_angle", "daylight", "dendrogram", "slanted", "cladogram"):
        assert figure.TreeFigure(nodes, name).scene().filter("kind = 'path'").count() >= 11
    tangled = figure.tangle(nodes, edit(nodes, R.ladderize).withColumn("tree_id", F_lit("b")))
    assert tangled.filter("fig_id = 'links'").count() == 7
    assert figure.densi(nodes.unionByName(nodes.withColumn("tree_id", F_lit("c"))), "primates").count() > 10
    with pytest.raises(ValueError):
        layout.get_layout("magic")
    with pytest.raises(ValueError):
        figure.connections(layout.rectangular(nodes), spark.createDataFrame([("Human", "Nobody")], "a string, b string"))


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)
