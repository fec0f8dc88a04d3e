"""Sinks, keys and bridges: drawings parse, hold all rows, and keep their styles."""

import json
import xml.dom.minidom
from types import SimpleNamespace

from sylva.plans import figure, netplot
from sylva.sources import builtin, newick


def _figure(spark):
    meta = builtin.primates_metadata(spark)
    fig = figure.TreeFigure(builtin.primates(spark)).titled("A & B").tip_labels(italic=True).points("tips", shape_by=None).heatmap(meta, ["habitat"])
    aln = spark.createDataFrame([("Human", "AC-"), ("Chimp", "ACG")], "name string, seq string")
    return fig.alignment(aln).add_scale(meta, "habitat", swatch="patch").add_scale(meta, "body_mass_kg", title="mass <kg>")


def test_svg_is_well_formed_and_keeps_styles(spark):
    text = _figure(spark).show()
    doc = xml.dom.minidom.parseString(text)
    said = [t.firstChild.data for t in doc.getElementsByTagName("text") if t.firstChild]
    assert "A & B" in said and {"Human", "forest", "habitat"} <= set(said) and any(t.startswith("mass <kg>: 8") for t in said)
    assert any(t.getAttribute("font-style") == "italic" for t in doc.getElementsByTagName("text"))
    assert len([r for r in doc.getElementsByTagName("rect")]) == 5 + 3 + 8  # residues without the gap, patches, stops


def test_marker_shapes(spark):
    marks = "".join(chr(c) for c in (111,)) + "s^DvPX*<>"
    rows = [("f", "marker", 1.0, i, [(float(i), 0.0)], m, {"marker": m, "size": "8"}) for i, m in enumerate(marks)]
    text = figure.svg(spark.createDataFrame(rows, figure.SCENE)).first().svg
    doc = xml.dom.minidom.parseString(text)
    assert len(doc.getElementsByTagName("circle")) == 1 and len(doc.getElementsByTagName("polygon")) == 9


def test_page_and_traces(spark, tmp_path):
    fig = _figure(spark)
    fig.save(str(tmp_path / "f.html"))
    fig.save(str(tmp_path / "f.json"))
    assert "<svg" in "".join(p.read_text() for p in (tmp_path / "f.html").glob("part*"))
    drawn = json.loads("".join(p.read_text() for p in (tmp_path / "f.json").glob("part*")))
    kinds = [t["type"] for t in drawn["data"]]
    assert kinds.count("heatmap") == 2 and kinds.count("scatter") == fig.scene().count() - 2
    assert {t["name"] for t in drawn["data"] if t["showlegend"]} == {"forest", "savanna", "urban", "mass <kg>"}


def test_network_scene(spark):
    at = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 0.0, 1.0)], "name string, x double, y double")
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 2.0)], "x string, y string, w double")
    groups = spark.createDataFrame([("a", "one"), ("b", "two")], "name string, label string")
    rows = netplot.scene(at, edges, groups, labels=True).collect()
    by = lambda k: [r for r in rows if r.kind == k]
    assert {r.text: r.style["alpha"] for r in by("path")} == {"a-b": "0.5", "b-c": "1.0"}
    assert {r.text: r.style["color"] for r in by("marker")}["c"] == "#cccccc"
    assert {r.text for r in by("legend")} == {"one", "two"} and len(by("label")) == 3


def test_bridge_there_and_back():
    class Clade(SimpleNamespace):
        pass

    root = newick.parse_newick(builtin.PRIMATES)
    there = newick.to_biopython(root, "t", lambda **k: Clade(**k), lambda root, name: SimpleNamespace(root=root, name=name))
    assert newick.to_newick(newick.from_biopython(there)) == newick.to_newick(root)
