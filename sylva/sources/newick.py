"""Newick and annotated NEXUS: readers to node tables and writers from them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.phylo import NODES, Node, TreeError, frame, tree

_BARE = re.compile(r"[^\s()\[\]{},:;'\"=/\\]+$")
_STOP = "()[]{},:;'"
_BRACKET = re.compile(r"[\[\]]")


class _Text:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def fail(self, what: str):
        raise TreeError(f"newick: {what} at character {self.at}: {self.text[self.at : self.at + 20]!r}")

    def comment(self) -> str | None:
        found = []
        while self.peek() == "[":
            begin = self.at
            depth = 0
            for mark in _BRACKET.finditer(self.text, begin):
                depth += 1 if mark[0] == "[" else -1
                if not depth:
                    break
            if depth:
                self.fail("a comment does not end")
            found.append(self.text[begin + 1 : mark.start()])
            self.at = mark.end()
        return "".join(found) or None

    def label(self) -> tuple[str | None, bool]:
        """(label or None, whether it was quoted); a bare label may hold blanks, those at its ends do not count."""
        if self.peek() in ("'", '"') and self.peek():
            quote, out = self.peek(), []
            self.at += 1
            while True:
                end = self.text.find(quote, self.at)
                if end < 0:
                    self.fail("a quoted label does not end")
                out.append(self.text[self.at : end])
                self.at = end + 1
                if self.text[self.at : self.at + 1] != quote:
                    return "".join(out), True
                out.append(quote)
                self.at += 1
        begin = self.at
        while self.at < len(self.text) and self.text[self.at] not in _STOP:
            self.at += 1
        return self.text[begin : self.at].strip() or None, False

    def number(self) -> float:
        self.peek()
        raw, _ = self.label()
        try:
            return float(raw)
        except (TypeError, ValueError):
            self.fail("a length is a number")


def parse_newick(text: str) -> Node:
    """One tree.  A number that labels an inner node is its support; a comment may follow label and length."""
    s, root = _Text(text), Node()
    node, depth = root, 0
    fresh = True  # node has no content yet
    while True:
        c = s.peek()
        if c == "(" and fresh:
            s.at += 1
            node, depth = node.add(Node()), depth + 1
            continue
        label, quoted = s.label()
        if label is not None:
            number = None
            if node.children and not quoted:
                try:
                    number = float(label)
                except ValueError:
                    pass
            node.name, node.support = (None, number) if number is not None else (label, node.support)
        node.comment = s.comment()
        if s.peek() == ":":
            s.at += 1
            early = s.comment()
            node.length = s.number()
            node.comment = "".join(x for x in (node.comment, early, s.comment()) if x) or None
        if not node.children and node.name is None and node is not root:
            s.fail("a tip has a name")
        c = s.peek()
        if c == "," and depth:
            s.at += 1
            node, fresh = node.parent.add(Node()), True
        elif c == ")" and depth:
            s.at += 1
            node, depth, fresh = node.parent, depth - 1, False
        elif c in ("", ";") and not depth:
            break
        else:
            s.fail("something else was expected")
    if not root.children and root.name is None:
        raise TreeError("newick: empty")
    names = root.names()
    if len(set(names)) < len(names):
        raise TreeError("tip names of a tree are unique")
    return root


def _quoted(name: str) -> str:
    return name if _BARE.match(name) else "'" + name.replace("'", "''") + "'"


def to_newick(root: Node, with_support: bool = True) -> str:
    """Six significant digits; a support is written in place of an inner name."""
    said: dict[int, str] = {}
    for n in root.postorder():
        inner = "(" + ",".join(said.pop(id(c)) for c in n.children) + ")" if n.children else ""
        label = f"{n.support:.6g}" if n.children and with_support and n.support is not None else _quoted(n.name) if n.name else ""
        said[id(n)] = inner + label + (f":{n.length:.6g}" if n.length is not None else "")
    return said[id(root)] + ";"


# -- trees of other libraries ------------------------------------------------------------------


def from_biopython(tree) -> Node:
    """A tree of clades (name, branch_length, confidence, comment, clades) as nodes."""
    root = None
    todo = [(tree.root, None)]
    while todo:
        clade, parent = todo.pop()
        n = Node(clade.name, clade.branch_length)
        n.support, n.comment = getattr(clade, "confidence", None), getattr(clade, "comment", None)
        if parent is None:
            root = n
        else:
            parent.add(n)
        todo += [(c, n) for c in reversed(clade.clades)]
    return root


def to_biopython(root: Node, name: str | None = None, clade: type | None = None, tree: type | None = None):
    """Nodes as that library's tree; its own classes unless others are given."""
    if clade is None or tree is None:
        from Bio.Phylo.BaseTree import Clade as clade
        from Bio.Phylo.BaseTree import Tree as tree
    made = {}
    for n in root.postorder():
        c = clade(branch_length=n.length, name=n.name)
        c.confidence, c.clades = n.support, [made.pop(id(x)) for x in n.children]
        made[id(n)] = c
    return tree(root=made[id(root)], name=name)


# -- annotations ------------------------------------------------------------------------------


def parse_annotation(comment: str | None) -> dict[str, str]:
    """``&key=value,key={lo,hi}`` as a map; two-number lists also give key_lower and key_upper, sorted."""
    if not comment or not comment.startswith("&"):
        return {}
    parts, depth, quoted, last = [], 0, False, 1
    for i, c in enumerate(comment):
        quoted ^= c == '"'
        depth += (c == "{") - (c == "}") if not quoted else 0
        if c == "," and not depth and not quoted:
            parts.append(comment[last:i])
            last = i + 1
    out: dict[str, str] = {}
    for part in [*parts, comment[last:]]:
        key, equals, value = part.partition("=")
        key = key.strip().lstrip("&!")
        if not equals or not key:
            continue
        value = value.strip().strip('"')
        out[key] = value
        if value.startswith("{") and value.endswith("}"):
            inner = [x.strip() for x in value[1:-1].split(",")]
            try:
                lo, hi = sorted(map(float, inner))
            except ValueError:
                continue
            base = re.sub(r"%?_?HPD$", "", key)
            out[f"{base}_lower"], out[f"{base}_upper"] = str(lo), str(hi)
    return out


def annotate(root: Node) -> Node:
    """Move comments into data; posterior, prob or label fill an empty support."""
    for n in root.preorder():
        n.data |= parse_annotation(n.comment)
        if n.support is None:
            for key in ("posterior", "prob", "label"):
                try:
                    n.support = float(n.data[key])
                    break
                except (KeyError, ValueError):
                    continue
    return root


def nexus_trees(text: str, annotated: bool = True) -> list[tuple[str, Node]]:
    """(name, tree) of each TREE statement, with TRANSLATE applied to tips."""
    table: dict[str, str] = {}
    if found := re.search(r"\btranslate\b(.*?);", text, re.I | re.S):
        for entry in found[1].split(","):
            key, _, name = entry.strip().partition(" ")
            if key:
                table[key] = name.strip().strip("'\"")
    out = []
    for name, body in re.findall(r"^\s*u?tree\s+\*?\s*('[^']*'|[^\s=]+)[^=]*?=\s*(.*?;)\s*$", text, re.I | re.M | re.S):
        body = re.sub(r"^\s*(\[&[^\]]*\]\s*)+", "", body)
        root = parse_newick(body)
        for tip in root.leaves():
            tip.name = table.get(tip.name, tip.name)
        out.append((name.strip("'"), annotate(root) if annotated else root))
    if not out:
        raise TreeError("no TREE statement")
    return out


# -- XML dialects ---------------------------------------------------------------------------


def _local(element) -> str:
    return element.tag.rpartition("}")[2]


def phyloxml_trees(text: str) -> list[tuple[str, Node]]:
    """(name, tree) of each phylogeny: clades with name, branch length and the first confidence."""
    from xml.etree import ElementTree

    def read_clade(e) -> Node:
        length = e.get("branch_length")
        node = Node(length=float(length) if length else None)
        for child in e:
            kind, said = _local(child), (child.text or "").strip()
            if kind == "name":
                node.name = said
            elif kind == "branch_length" and said:
                node.length = float(said)
            elif kind == "confidence" and node.support is None and said:
                node.support = float(said)
            elif kind == "clade":
                node.add(read_clade(child))
        return node

    out = []
    for i, p in enumerate(e for e in ElementTree.fromstring(text) if _local(e) == "phylogeny"):
        name = next(((e.text or "").strip() for e in p if _local(e) == "name"), f"tree{i}")
        out += [(name, read_clade(e)) for e in p if _local(e) == "clade"]
    if not out:
        raise TreeError("no phylogeny")
    return out


def nexml_trees(text: str) -> list[tuple[str, Node]]:
    """(id, tree) of each tree: nodes labelled by their taxa, edges with lengths."""
    from xml.etree import ElementTree

    top = ElementTree.fromstring(text)
    taxa = {e.get("id"): e.get("label") or e.get("id") for e in top.iter() if _local(e) == "otu"}
    out = []
    for t in (e for e in top.iter() if _local(e) == "tree"):
        nodes = {e.get("id"): Node(taxa.get(e.get("otu")) or e.get("label")) for e in t if _local(e) == "node"}
        below = set()
        for e in t:
            if _local(e) == "edge":
                child = nodes[e.get("target")]
                child.length = float(e.get("length")) if e.get("length") else None
                nodes[e.get("source")].add(child)
                below.add(e.get("target"))
        roots = [n for i, n in nodes.items() if i not in below]
        if len(roots) != 1:
            raise TreeError("a tree has one root")
        out.append((t.get("id") or f"tree{len(out)}", roots[0]))
    if not out:
        raise TreeError("no tree")
    return out


# -- Spark ------------------------------------------------------------------------------------


def parse(texts: DataFrame, id_col: str = "tree_id", text_col: str = "newick") -> DataFrame:
    """(tree_id, newick) rows to the node table, batch by batch where the rows are."""

    def run(batches):
        for pdf in batches:
            yield frame((str(i), parse_newick(t)) for i, t in zip(pdf[id_col], pdf[text_col]))

    return texts.select(id_col, text_col).mapInPandas(run, NODES)


def render(nodes: DataFrame, with_support: bool = True) -> DataFrame:
    """The node table to (tree_id, newick)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "newick": [to_newick(tree(pdf), with_support)]})

    return nodes.groupBy("tree_id").applyInPandas(run, "tree_id string, newick string")


def read(spark: SparkSession, path: str, fmt: str = "newick", tree_index: int | None = None) -> DataFrame:
    """Files to a node table; tree_id is the file's name, with the tree's name for NEXUS.

    Formats: newick (one tree a file), nexus, beast, mrbayes (annotated NEXUS), phyloxml, nexml.
    """
    readers = {"nexus": nexus_trees, "beast": nexus_trees, "mrbayes": nexus_trees, "phyloxml": phyloxml_trees, "nexml": nexml_trees}
    if fmt != "newick" and fmt not in readers:
        raise ValueError(f"format {fmt!r} is not known")
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("tree_id"), F.col("value").alias("newick"))
    if fmt == "newick":
        return parse(files)

    def run(batches):
        for pdf in batches:
            for file, text in zip(pdf["tree_id"], pdf["newick"]):
                found = readers[fmt](text)
                if tree_index is not None:
                    found = [found[tree_index]]
                yield frame((f"{file}:{name}", root) for name, root in found)

    return files.mapInPandas(run, NODES)


def write(nodes: DataFrame, path: str) -> None:
    """One newick a line."""
    render(nodes).select("newick").write.text(path)
