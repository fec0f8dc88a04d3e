"""Layouts: node tables with coordinates, as column expressions over the index.

Rows of inner nodes are the middle of their extreme children, level by level from the tips; all the
rest is projection.  Unrooted layouts other than equal angle, and refinements, run a tree a task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.phylo import Node, tree


def grid(nodes: DataFrame, use_lengths: bool = True) -> DataFrame:
    """nodes with row (tips 0, 1, ...; inner nodes between their outermost children), depth and max_depth."""
    base = nodes.withColumn("depth", F.col("depth_len") if use_lengths else F.col("depth_edges").cast("double"))
    small = base.select("tree_id", "node_id", "parent_id", "depth_edges", "is_leaf", F.col("tip_ord").cast("double").alias("row"))
    done = small.filter("is_leaf")
    deepest = nodes.agg(F.max("depth_edges")).first()[0] or 0
    out = done
    for level in range(deepest - 1, -1, -1):
        made = out.filter(F.col("depth_edges") == level + 1).groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(((F.min("row") + F.max("row")) / 2).alias("row"))
        out = out.union(small.filter((F.col("depth_edges") == level) & ~F.col("is_leaf")).drop("row").join(made, ["tree_id", "node_id"]).select(small.columns))
    span = F.col("depth") + F.coalesce(F.expr("try_cast(data['collapsed_far'] AS DOUBLE)"), F.lit(0.0))
    return base.join(out.select("tree_id", "node_id", "row"), ["tree_id", "node_id"]).withColumn("max_depth", F.max(span).over(Window.partitionBy("tree_id")))


def rectangular(nodes: DataFrame, use_lengths: bool = True) -> DataFrame:
    return grid(nodes, use_lengths).withColumns({"x": F.col("depth"), "y": F.col("row"), "angle": F.lit(None).cast("double")})


def dendrogram(nodes: DataFrame, use_lengths: bool = True) -> DataFrame:
    """The root on top: rows run to the right, depth downwards."""
    return grid(nodes, use_lengths).withColumns({"x": F.col("row"), "y": F.col("max_depth") - F.col("depth"), "angle": F.lit(None).cast("double")})


def circular(nodes: DataFrame, use_lengths: bool = True, extent: float = 360.0, start: float = 0.0, inward: bool = False) -> DataFrame:
    """Radius is depth (or what is left of it); a full circle leaves one row's gap, a fan reaches its ends."""
    g = grid(nodes, use_lengths)
    n = F.count_if("is_leaf").over(Window.partitionBy("tree_id"))
    step = F.try_divide(F.lit(math.radians(extent)), n if extent >= 360 else n - 1)
    r = F.col("max_depth") - F.col("depth") if inward else F.col("depth")
    g = g.withColumns({"angle": F.lit(math.radians(start)) + F.col("row") * F.coalesce(step, F.lit(0.0)), "radius": r})
    return g.withColumns({"x": F.col("radius") * F.cos("angle"), "y": F.col("radius") * F.sin("angle")})


def equal_angle(nodes: DataFrame, use_lengths: bool = True) -> DataFrame:
    """Each node has a wedge in proportion to its tips; its edge points along the wedge's middle.

    A node's wedge starts at its first tip's share of the circle, so no recursion is asked for."""
    n = F.max("n_tips").over(Window.partitionBy("tree_id"))
    base = nodes.withColumn("angle", 2 * math.pi * (F.col("leaf_lo") + F.col("n_tips") / 2) / n)
    length = F.col("length") if use_lengths else F.when(F.col("parent_id").isNotNull(), 1.0)
    step = base.select("tree_id", F.col("node_id").alias("edge"), (F.coalesce(length, F.lit(0.0)) * F.cos("angle")).alias("dx"), (F.coalesce(length, F.lit(0.0)) * F.sin("angle")).alias("dy"))
    path = base.select("tree_id", "node_id", F.explode("path").alias("edge")).join(step, ["tree_id", "edge"]).groupBy("tree_id", "node_id").agg(F.sum("dx").alias("x"), F.sum("dy").alias("y"))
    return base.join(path, ["tree_id", "node_id"], "left").na.fill(0.0, ["x", "y"])


def _daylight(root: Node, rounds: int) -> dict[int, tuple[float, float]]:
    tips = root.names()
    place, at = {n: i for i, n in enumerate(tips)}, {id(root): (0.0, 0.0)}
    for n in root.preorder():
        for c in n.children:
            own = [place[t] for t in c.names()]
            a = 2 * math.pi * (min(own) + len(own) / 2) / len(tips)
            x, y = at[id(n)]
            at[id(c)] = (x + (c.length or 0.0) * math.cos(a), y + (c.length or 0.0) * math.sin(a))
    for _ in range(rounds):
        for n in [x for x in root.preorder() if len(x.children) + (x.parent is not None) > 2]:
            x0, y0 = at[id(n)]
            arcs = []
            for c in n.children:  # the arc of each subtree seen from the node
                base = math.atan2(at[id(c)][1] - y0, at[id(c)][0] - x0)
                off = [(math.atan2(at[id(t)][1] - y0, at[id(t)][0] - x0) - base + math.pi) % (2 * math.pi) - math.pi for t in c.leaves()]
                arcs.append([base + min(off), base + max(off), c])
            up = 0.0
            if n.parent is not None:
                inside = {id(x) for x in n.preorder()}
                base = math.atan2(at[id(n.parent)][1] - y0, at[id(n.parent)][0] - x0)
                off = [(math.atan2(at[id(t)][1] - y0, at[id(t)][0] - x0) - base + math.pi) % (2 * math.pi) - math.pi for t in root.leaves() if id(t) not in inside] or [0.0]
                arcs.append([base + min(off), base + max(off), None])
            free = 2 * math.pi - sum(b - a for a, b, _ in arcs)
            if free <= 0:
                continue
            gap = free / len(arcs)
            first = next((x for x in arcs if x[2] is None), arcs[0])
            up = first[1]
            for a, b, c in sorted((x for x in arcs if x is not first), key=lambda x: (x[0] - up) % (2 * math.pi)):
                turn = up + gap - a
                up += gap + b - a
                cos, sin = math.cos(turn), math.sin(turn)
                for m in c.preorder():
                    x, y = at[id(m)]
                    at[id(m)] = (x0 + (x - x0) * cos - (y - y0) * sin, y0 + (x - x0) * sin + (y - y0) * cos)
    return at


def daylight(nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """Equal angle, then subtrees turned about each node until the gaps between them are equal."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root = tree(pdf)
        at = _daylight(root, rounds)
        return pd.DataFrame([(pdf["tree_id"].iloc[0], i, *at[id(n)]) for i, n in enumerate(root.preorder())], columns=["tree_id", "node_id", "x", "y"])

    return nodes.join(nodes.groupBy("tree_id").applyInPandas(run, "tree_id string, node_id int, x double, y double"), ["tree_id", "node_id"])


def get_layout(name: str):
    """A layout by one of its names."""
    from functools import partial

    known = {
        **dict.fromkeys(("rectangular", "rect", "phylogram"), rectangular), **dict.fromkeys(("cladogram",), partial(rectangular, use_lengths=False)), **dict.fromkeys(("slanted", "diagonal"), rectangular),
        **dict.fromkeys(("dendrogram", "vertical"), dendrogram), **dict.fromkeys(("circular", "radial", "polar"), circular), "fan": partial(circular, extent=270.0), **dict.fromkeys(("circular_slanted", "circular_diagonal"), circular),
        **dict.fromkeys(("inward", "inward_circular"), partial(circular, inward=True)), **dict.fromkeys(("equal_angle", "unrooted"), equal_angle), "daylight": daylight,
    }
    if name not in known:
        raise ValueError(f"layout {name!r} is not one of {sorted(known)}")
    return known[name]


def branch_paths(placed: DataFrame, kind: str = "rectangular", arc_step: float = 2.0) -> DataFrame:
    """(tree_id, node_id, part, points): each node's own stroke ('branch') and the bar or arc over its children ('connector')."""
    own = placed.select("tree_id", "node_id", "parent_id", "x", "y", *[c for c in ("angle", "radius") if c in placed.columns])
    above = own.select("tree_id", F.col("node_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"), *([F.col("radius").alias("pr")] if "radius" in own.columns else []))
    pair = own.join(above, ["tree_id", "parent_id"])
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    to = point(F.col("x"), F.col("y"))
    start = {"rectangular": lambda: point(F.col("px"), F.col("y")), "dendrogram": lambda: point(F.col("x"), F.col("py")), "circular": lambda: point(F.col("pr") * F.cos("angle"), F.col("pr") * F.sin("angle")), "straight": lambda: point(F.col("px"), F.col("py"))}
    branch = pair.select("tree_id", "node_id", F.lit("branch").alias("part"), F.array(start[kind](), to).alias("points"))
    if kind == "straight":
        return branch
    span = own.filter("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id"))
    if kind == "circular":
        ends = span.agg(F.min("angle").alias("a"), F.max("angle").alias("b")).join(own.select("tree_id", "node_id", "radius"), ["tree_id", "node_id"])
        steps = F.greatest(F.lit(1), F.ceil((F.col("b") - F.col("a")) / math.radians(arc_step))).cast("int")
        arc = F.transform(F.sequence(F.lit(0), steps), lambda i: point(F.col("radius") * F.cos(F.col("a") + (F.col("b") - F.col("a")) * i / steps), F.col("radius") * F.sin(F.col("a") + (F.col("b") - F.col("a")) * i / steps)))
        bar = ends.select("tree_id", "node_id", F.lit("connector").alias("part"), arc.alias("points"))
    else:
        c, fixed = ("y", "x") if kind == "rectangular" else ("x", "y")
        ends = span.agg(F.min(c).alias("a"), F.max(c).alias("b")).join(own.select("tree_id", "node_id", F.col(fixed).alias("f")), ["tree_id", "node_id"])
        p = (lambda v: point(F.col("f"), F.col(v))) if kind == "rectangular" else (lambda v: point(F.col(v), F.col("f")))
        bar = ends.select("tree_id", "node_id", F.lit("connector").alias("part"), F.array(p("a"), p("b")).alias("points"))
    return branch.union(bar)
