"""Trees as tables: the in-memory form of one tree, its nested-set index, and edits applied tree by tree.

A forest is a DataFrame with one row a node.  ``index`` gives each node its preorder interval,
its tip interval and its path from the root (edge ids and lengths), so that ancestors, subtree
membership, path sums and common ancestors are equi-joins, explodes and range filters instead of
recursion.  Edits of a tree run as one task a tree, and every edit ends with a fresh index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

NODES = (
    "tree_id string, node_id int, parent_id int, child_ord int, name string, length double, support double, comment string, data map<string,string>, "
    "pre_end int, post int, depth_edges int, depth_len double, is_leaf boolean, tip_ord int, leaf_lo int, leaf_hi int, n_tips int, path array<int>, path_len array<double>"
)


class TreeError(ValueError):
    """A tree or a request about it that makes no sense."""


@dataclass(eq=False)
class Node:
    name: str | None = None
    length: float | None = None
    support: float | None = None
    comment: str | None = None
    data: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None

    def add(self, child: Node, at: int | None = None) -> Node:
        child.parent = self
        self.children.insert(len(self.children) if at is None else at, child)
        return child

    @property
    def is_leaf(self) -> bool:
        return not self.children

    def preorder(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def postorder(self) -> list[Node]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            out.append(node)
            stack.extend(node.children)
        return out[::-1]

    def levelorder(self) -> Iterator[Node]:
        level = [self]
        while level:
            yield from level
            level = [c for n in level for c in n.children]

    def leaves(self) -> list[Node]:
        return [n for n in self.preorder() if n.is_leaf]

    def names(self) -> list[str]:
        return [n.name for n in self.leaves()]

    def up(self) -> Iterator[Node]:
        node = self
        while node is not None:
            yield node
            node = node.parent

    def copy(self) -> Node:
        made = {}
        for n in self.preorder():
            made[id(n)] = own = Node(n.name, n.length, n.support, n.comment, dict(n.data))
            if n is not self:
                made[id(n.parent)].add(own)
        return made[id(self)]


def rows(root: Node, tree_id: str) -> list[dict]:
    """The indexed node table of one tree; node_id is the preorder number."""
    order = list(root.preorder())
    number = {id(n): i for i, n in enumerate(order)}
    post = {id(n): i for i, n in enumerate(root.postorder())}
    out, tips = [], 0
    for i, n in enumerate(order):
        above = out[number[id(n.parent)]] if i else None
        length = n.length or 0.0
        out.append({
            "tree_id": tree_id, "node_id": i, "parent_id": above["node_id"] if i else None, "child_ord": n.parent.children.index(n) if i else 0, "name": n.name, "length": n.length,
            "support": n.support, "comment": n.comment, "data": dict(n.data), "pre_end": i, "post": post[id(n)], "depth_edges": above["depth_edges"] + 1 if i else 0,
            "depth_len": above["depth_len"] + length if i else 0.0, "is_leaf": n.is_leaf, "tip_ord": tips if n.is_leaf else None, "leaf_lo": tips, "leaf_hi": tips, "n_tips": int(n.is_leaf),
            "path": [*above["path"], i] if i else [], "path_len": [*above["path_len"], length] if i else [],
        })
        tips += n.is_leaf
    for row in reversed(out):
        if row["parent_id"] is not None:
            above = out[row["parent_id"]]
            above["pre_end"], above["leaf_hi"] = max(above["pre_end"], row["pre_end"]), max(above["leaf_hi"], row["leaf_hi"])
            above["n_tips"] += row["n_tips"]
    return out


COLUMNS = [c.split()[0] for c in NODES.split(", ")]


def frame(trees: Iterable[tuple[str, Node]]) -> pd.DataFrame:
    table = pd.DataFrame([r for tree_id, root in trees for r in rows(root, tree_id)], columns=COLUMNS)
    for c in ("parent_id", "tip_ord"):
        table[c] = table[c].astype("Int32")
    return table


def forest(spark: SparkSession, trees: dict[str, Node]) -> DataFrame:
    """A small forest given on the driver as a table."""
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for tree_id, root in trees.items() for r in rows(root, tree_id)], NODES)


def _missing(x) -> bool:
    return x is None or x is pd.NA or (isinstance(x, float) and x != x)


def tree(pdf: pd.DataFrame | list) -> Node:
    """One tree of a node table (pandas, or collected rows), with children in their order."""
    records = pdf.to_dict("records") if isinstance(pdf, pd.DataFrame) else [r.asDict() for r in pdf]
    made, root = {}, None
    clean = lambda x: None if _missing(x) else x
    for r in records:
        data = r.get("data")
        data = {} if _missing(data) else dict(data)
        made[int(r["node_id"])] = Node(clean(r["name"]), clean(r["length"]), clean(r["support"]), clean(r.get("comment")), {k: v for k, v in data.items() if v is not None})
    for r in sorted(records, key=lambda r: (r["child_ord"], r["node_id"])):
        if _missing(r["parent_id"]):
            if root is not None:
                raise TreeError("a tree has one root")
            root = made[int(r["node_id"])]
        else:
            made[int(r["parent_id"])].add(made[int(r["node_id"])])
    if root is None:
        raise TreeError("a tree has a root")
    names = [n.name for n in root.leaves()]
    if len(set(names)) < len(names):
        raise TreeError("tip names of a tree are unique")
    return root


def edit(nodes: DataFrame, change: Callable[[Node], Node | None]) -> DataFrame:
    """Apply a change to every tree, each in a task of its own, and index the result."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root = tree(pdf)
        return frame([(pdf["tree_id"].iloc[0], change(root) or root)])

    return nodes.groupBy("tree_id").applyInPandas(run, NODES)


def index(nodes: DataFrame) -> DataFrame:
    """Recompute the index after child_ord, parent or length columns were changed with DataFrame operations."""
    return edit(nodes, lambda root: root)


# -- lookups on the in-memory form, shared by edits and kernels ------------------------------


def find(root: Node, name: str) -> Node:
    for n in root.preorder():
        if n.name == name:
            return n
    raise TreeError(f"no node is named {name!r}")


def mrca(root: Node, names: Iterable[str], strict: bool = True) -> Node | None:
    """The deepest node over all the tips named."""
    wanted = set(names)
    tips = [n for n in root.leaves() if n.name in wanted]
    if strict and len(tips) < len(wanted):
        raise TreeError(f"not tips: {sorted(wanted - {n.name for n in tips})[:10]}")
    if not tips:
        return None
    common = list(tips[0].up())
    for t in tips[1:]:
        above = {id(n) for n in t.up()}
        common = [n for n in common if id(n) in above]
    return common[0]


def at(root: Node, where: str | Iterable[str]) -> Node:
    """A node by its name, or the common ancestor of several tips."""
    return find(root, where) if isinstance(where, str) else mrca(root, where)
