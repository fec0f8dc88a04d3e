"""Scenes of sequence and split networks: placed nodes (name, x, y), edges (x, y, w) and groups (name, label)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colors as C
from .figure import color_scale, legend, point, primitives

FIGURE = "network"


def _figure(df: DataFrame) -> DataFrame:
    return df.withColumns({"tree_id": F.lit(FIGURE), "node_id": F.lit(0)})


def color_by(positions: DataFrame, groups: DataFrame, title: str = "group", baseline: str | None = None, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(positions with label and color, the scale): nodes without a group are grey and in no legend."""
    scale = color_scale(groups, "label", title, baseline=baseline, order=order, categorical=True)
    own = positions.join(groups.select("name", "label"), "name", "left").join(F.broadcast(scale.select(F.col("value").alias("label"), "color")), "label", "left")
    return own.withColumn("color", F.coalesce("color", F.lit(C.MISSING))), scale


def label_nodes(positions: DataFrame, names: list[str] | None = None, size: float = 8.0) -> DataFrame:
    """A label at each node, or at those named."""
    own = positions if names is None else positions.filter(F.col("name").isin(names))
    return primitives(_figure(own), "label", F.array(point(F.col("x"), F.col("y"))), 4.0, F.col("name"), size=size)


def label_clusters(centroids: DataFrame, size: float = 10.0) -> DataFrame:
    """A group's label just outside its nodes: centroids (label, cx, cy, reach)."""
    return primitives(_figure(centroids), "label", F.array(point(F.col("cx"), F.col("cy") + F.col("reach"))), 4.0, F.col("label"), size=size)


def scene(positions: DataFrame, edges: DataFrame, groups: DataFrame | None = None, labels: bool = False, swatch: str = "point", **options) -> DataFrame:
    """Edges, nodes and, with groups, their colours and the legend."""
    a, b = (positions.select(F.col("name").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for n in ("p", "q"))
    drawn = edges.select(F.col("x").alias("p"), F.col("y").alias("q"), "w").join(a, "p").join(b, "q")
    parts = [primitives(_figure(drawn), "path", F.array(point(F.col("px"), F.col("py")), point(F.col("qx"), F.col("qy"))), 1.0, F.concat_ws("-", "p", "q"), alpha=F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.col("w"))))]
    own = positions.withColumn("color", F.lit("black"))
    if groups is not None:
        own, scale = color_by(positions, groups, **options)
        parts.append(legend(_figure(positions), scale, swatch))
    parts.append(primitives(_figure(own), "marker", F.array(point(F.col("x"), F.col("y"))), 3.0, F.col("name"), color=F.col("color")))
    if labels:
        parts.append(label_nodes(positions))
    return reduce(DataFrame.unionByName, parts)
