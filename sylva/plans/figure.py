"""Figures as tables of drawing primitives: each element joins metadata to placed nodes.

A scene is (fig_id, kind, zorder, ord, points, text, style).  Elements are functions from the placed
tree and their data to such rows; a figure is their union.  SVG, HTML and JSON sinks draw it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import colors as C
from . import layout as L

SCENE = "fig_id string, kind string, zorder double, ord int, points array<struct<x:double,y:double>>, text string, style map<string,string>"


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def style(**values) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))]) if values else F.create_map().cast("map<string,string>")


def primitives(df: DataFrame, kind: str, points: Column, zorder: float, text: Column | None = None, order: str = "node_id", **styles) -> DataFrame:
    """Rows of one kind: path, marker, label, polygon or raster."""
    return df.select(F.col("tree_id").alias("fig_id"), F.lit(kind).alias("kind"), F.lit(float(zorder)).alias("zorder"), F.col(order).cast("int").alias("ord"), points.alias("points"), (text if text is not None else F.lit(None)).cast("string").alias("text"), style(**styles).alias("style"))


def no_points() -> Column:
    return F.array().cast("array<struct<x:double,y:double>>")


def number(value: Column) -> Column:
    """Six significant digits without trailing zeros."""
    text = F.format_string("%.6g", value)
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def box(x0, x1, y0, y1) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


# -- scales -------------------------------------------------------------------------------------------


def is_numeric(df: DataFrame, column: str) -> bool:
    """Numbers other than booleans, or text that all reads as numbers."""
    kind = dict(df.dtypes)[column]
    if kind != "string":
        return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    return not df.filter(F.col(column).isNotNull() & F.expr(f"try_cast(`{column}` AS DOUBLE) IS NULL")).limit(1).count()


def color_scale(df: DataFrame, column: str, title: str | None = None, palette: str = "curated", baseline: str | None = None, order: list[str] | None = None, categorical: bool | None = None) -> DataFrame:
    """(value, color, title, place): categories in order of text or as given, the baseline grey; or the bounds of a ramp.

    The number of categories is that of a legend; their colours come from the palette by rank."""
    title = title or column
    if not (categorical if categorical is not None else not is_numeric(df, column)):
        ends = df.agg(F.min(F.col(column).cast("double")).alias("lo"), F.max(F.col(column).cast("double")).alias("hi"))
        return ends.select(F.explode(F.array(F.struct(F.lit(0).alias("place"), F.col("lo").alias("v")), F.struct(F.lit(1).alias("place"), F.col("hi").alias("v")))).alias("e")).select(F.col("e.v").cast("string").alias("value"), F.when(F.col("e.place") == 0, C.RAMP[0]).otherwise(C.RAMP[1]).alias("color"), F.lit(title).alias("title"), "e.place")
    values = df.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct()
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("value")) if order else F.lit(0)
    rank = F.when(rank == 0, 1_000_000).otherwise(rank) if order else rank
    first = (F.col("value") == baseline) if baseline is not None else F.lit(False)
    placed = values.withColumn("place", F.row_number().over(Window.orderBy(first, rank, "value")) - 1)
    n = placed.count()
    table = F.array(*[F.lit(c) for c in C.categorical_palette(max(n, 1), palette)])
    return placed.select("value", F.when(first, C.MISSING).otherwise(F.element_at(table, F.col("place") + 1)).alias("color"), F.lit(title).alias("title"), "place")


def colored(df: DataFrame, column: str, scale: DataFrame | None = None, name: str = "color") -> DataFrame:
    """df with the colour of a column: by category, or on the ramp between its least and greatest value."""
    if is_numeric(df, column):
        w, v = Window.partitionBy("tree_id"), F.col(column).cast("double")
        return df.withColumn(name, C.continuous(v, F.min(v).over(w), F.max(v).over(w)))
    scale = (scale if scale is not None else color_scale(df, column)).select(F.col("value").alias("_v"), F.col("color").alias(name))
    return df.join(scale, F.col(column).cast("string") == F.col("_v"), "left").drop("_v").withColumn(name, F.coalesce(name, F.lit(C.MISSING)))


def shapes(df: DataFrame, column: str, name: str = "marker") -> DataFrame:
    values = df.select(F.col(column).alias("_v")).filter("_v is not null").distinct().withColumn("_k", F.row_number().over(Window.orderBy("_v")) - 1)
    table = F.array(*[F.lit(m) for m in C.MARKERS])
    return df.join(values, F.col(column) == F.col("_v"), "left").withColumn(name, F.element_at(table, F.coalesce(F.pmod("_k", F.lit(len(C.MARKERS))), F.lit(0)) + 1)).drop("_v", "_k")


def sizes(column: str) -> Column:
    """4 to 16 between a column's least and greatest value."""
    v, w = F.col(column).cast("double"), Window.partitionBy("tree_id")
    return 4 + 12 * F.coalesce(F.try_divide(v - F.min(v).over(w), F.max(v).over(w) - F.min(v).over(w)), F.lit(0.5))


# -- elements -------------------------------------------------------------------------------------------


def data_column(placed: DataFrame, key: str) -> DataFrame:
    return placed if key in placed.columns else placed.withColumn(key, F.col("data")[key])


def branches(placed: DataFrame, kind: str, color: str = "black", width: float = 1.0) -> DataFrame:
    return primitives(L.branch_paths(placed, kind), "path", F.col("points"), 1.0, color=color, width=width)


def tip_labels(placed: DataFrame, only: list[str] | None = None, max_labels: int | None = None, italic: bool = False, size: float = 10.0, align: bool = False) -> DataFrame:
    tips = placed.filter("is_leaf")
    if only is not None:
        tips = tips.filter(F.col("name").isin(only))
    if max_labels:
        n = F.count("*").over(Window.partitionBy("tree_id"))
        tips = tips.filter(F.pmod(F.col("tip_ord"), F.greatest(F.lit(1), F.ceil(n / max_labels)).cast("int")) == 0)
    at = F.col("max_depth") if align and "max_depth" in placed.columns else F.col("x")
    return primitives(tips, "label", F.array(point(at, F.col("y"))), 4.0, F.col("name"), italic=C.looks_like_a_taxon(F.col("name")) if italic else F.lit(False), size=size, align=align)


def node_labels(placed: DataFrame, keys: list[str], join: str = "/", min_value: float | None = None, size: float = 8.0) -> DataFrame:
    inner = placed.filter("NOT is_leaf")
    value = lambda k: (F.col(k) if k in placed.columns else F.col("data")[k]).cast("string")
    text = F.array_join(F.filter(F.array(*[F.regexp_replace(value(k), r"\.0$", "") for k in keys]), lambda x: x.isNotNull()), join)
    inner = inner.withColumn("_text", text).filter("_text <> ''")
    if min_value is not None:
        inner = inner.filter(F.expr("try_cast(_v AS DOUBLE)") >= min_value) if "_v" in inner.columns else inner.withColumn("_v", value(keys[0])).filter(F.expr("try_cast(_v AS DOUBLE)") >= min_value)
    return primitives(inner, "label", F.array(point(F.col("x"), F.col("y"))), 4.0, F.col("_text"), size=size)


def support_labels(placed: DataFrame, min_value: float | None = None) -> DataFrame:
    return node_labels(placed, ["support"], min_value=min_value)


def points(placed: DataFrame, which: str = "all", color_by: str | None = None, size_by: str | None = None, shape_by: str | None = None, color: str = "black", size: float = 6.0) -> DataFrame:
    own = placed.filter({"all": "true", "tips": "is_leaf", "nodes": "NOT is_leaf"}[which])
    for k in (color_by, size_by, shape_by):
        own = data_column(own, k) if k else own
    own = colored(own, color_by, name="_color") if color_by else own.withColumn("_color", F.lit(color))
    own = shapes(own, shape_by, "_marker") if shape_by else own.withColumn("_marker", F.lit("o"))
    own = own.withColumn("_size", sizes(size_by) if size_by else F.lit(size))
    return primitives(own, "marker", F.array(point(F.col("x"), F.col("y"))), 3.0, F.col("name"), color=F.col("_color"), size=F.col("_size"), marker=F.col("_marker"))


def runs(tips: DataFrame, value: str) -> DataFrame:
    """(tree_id, value, lo, hi, n): stretches of adjacent tips with one value."""
    w = Window.partitionBy("tree_id").orderBy("tip_ord")
    fresh = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    x = tips.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w))
    return x.filter(F.col(value).isNotNull()).groupBy("tree_id", F.col(value).alias("value"), "_run").agg(F.min("tip_ord").alias("lo"), F.max("tip_ord").alias("hi"), F.count("*").alias("n")).drop("_run")


def highlight(placed: DataFrame, where: str | None = None, by: str | None = None, color: str = "#dddddd", alpha: float = 0.4) -> DataFrame:
    """A band over a clade, or over each run of tips with one value."""
    if by:
        tips = data_column(placed.filter("is_leaf"), by)
        band = runs(tips, by).crossJoin(placed.agg(F.max("max_depth").alias("right"))).withColumn("left", F.lit(0.0)).withColumn("node_id", F.col("lo"))
        band = colored(band, "value", name="_color")
    else:
        top = placed.filter(F.col("name") == where)
        band = top.select("tree_id", "node_id", F.col("leaf_lo").alias("lo"), F.col("leaf_hi").alias("hi"), F.col("depth").alias("left"), F.col("max_depth").alias("right"), F.col("name").alias("value")).withColumn("_color", F.lit(color))
    return primitives(band, "polygon", box(F.col("left"), F.col("right"), F.col("lo") - 0.5, F.col("hi") + 0.5), 0.5, F.col("value"), facecolor=F.col("_color"), alpha=alpha)


def clade_label(placed: DataFrame, where: str, label: str, offset: float = 0.05) -> DataFrame:
    top = placed.filter(F.col("name") == where).withColumn("_x", F.col("max_depth") * (1 + offset))
    bar = primitives(top, "path", F.array(point(F.col("_x"), F.col("leaf_lo")), point(F.col("_x"), F.col("leaf_hi"))), 3.0, color="black", width=2)
    return bar.union(primitives(top, "label", F.array(point(F.col("_x"), (F.col("leaf_lo") + F.col("leaf_hi")) / 2)), 4.0, F.lit(label)))


def tips_with(placed: DataFrame, data: DataFrame, key: str = "name") -> DataFrame:
    """Tips joined to a table by name; rows of other names take no part."""
    return placed.filter("is_leaf").select("tree_id", "node_id", "tip_ord", F.col("name").alias("_tip"), "x", "y", "max_depth").join(data.withColumnRenamed(key, "_tip"), "_tip")


def heatmap(placed: DataFrame, data: DataFrame, columns: list[str] | None = None, key: str = "name", width: float = 0.05, gap: float = 0.02) -> DataFrame:
    """A cell for each tip and column."""
    columns = columns or [c for c in data.columns if c != key]
    long = data.select(F.col(key).alias("name"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot("name", columns, "column", "value")
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")) - 1
    cells = colored(tips_with(placed, long).withColumn("k", place), "value", name="_color")
    left = F.col("max_depth") * (1 + gap) + F.col("max_depth") * width * F.col("k")
    return primitives(cells, "polygon", box(left, left + F.col("max_depth") * width, F.col("tip_ord") - 0.5, F.col("tip_ord") + 0.5), 2.0, F.concat_ws("=", "column", "value"), facecolor=F.col("_color"))


def bar_track(placed: DataFrame, data: DataFrame, column: str, key: str = "name", width: float = 0.2, gap: float = 0.02, color: str = "#37618e") -> DataFrame:
    v = F.col(column).cast("double")
    bars = tips_with(placed, data.select(F.col(key).alias("name"), v.alias("_value")).filter("_value is not null"))
    most = F.max(F.greatest(F.col("_value"), F.lit(0.0))).over(Window.partitionBy("tree_id"))
    left = F.col("max_depth") * (1 + gap)
    return primitives(bars, "polygon", box(left, left + F.col("max_depth") * width * F.coalesce(F.try_divide(F.greatest(F.col("_value"), F.lit(0.0)), most), F.lit(0.0)), F.col("tip_ord") - 0.4, F.col("tip_ord") + 0.4), 2.0, F.col("_value"), facecolor=color)


def ring_stack(placed: DataFrame, data: DataFrame, columns: list[str], key: str = "name", inner: float = 1.05, width: float = 0.2) -> DataFrame:
    """Composition of each tip as segments from inner outwards; values below zero and empty tips do not show."""
    long = data.select(F.col(key).alias("name"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("name", columns, "column", "value").filter("value > 0")
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    w = Window.partitionBy("tree_id", "_tip")
    x = tips_with(placed, long).withColumn("k", place).withColumn("share", F.col("value") / F.sum("value").over(w))
    x = x.withColumn("upto", F.sum("share").over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = colored(x, "column", name="_color")
    r = F.col("max_depth")
    return primitives(x, "polygon", box(r * (inner + width * (F.col("upto") - F.col("share"))), r * (inner + width * F.col("upto")), F.col("tip_ord") - 0.5, F.col("tip_ord") + 0.5), 2.0, F.col("column"), facecolor=F.col("_color"), share=F.round("share", 9))


def alignment_track(placed: DataFrame, aln: DataFrame, width: float = 0.6, gap: float = 0.02) -> DataFrame:
    """One raster row a tip: its residues' places in the alphabet, '-' is -1."""
    codes = F.transform(F.filter(F.split(F.upper("seq"), ""), lambda c: c != ""), lambda c: F.when(c == "-", -1).otherwise(F.ascii(c) - 65))
    x = tips_with(placed, aln.select("name", codes.alias("codes")))
    left = F.col("max_depth") * (1 + gap)
    return primitives(x, "raster", box(left, left + F.col("max_depth") * width, F.col("tip_ord") - 0.5, F.col("tip_ord") + 0.5), 2.0, F.array_join(F.col("codes").cast("array<string>"), ","))


def painted_branches(placed: DataFrame, dwell: DataFrame) -> DataFrame:
    """Each branch in segments by the share of its time in each state: dwell (tree_id, node_id, state, share)."""
    parent = placed.select("tree_id", F.col("node_id").alias("parent_id"), F.col("x").alias("px"))
    w = Window.partitionBy("tree_id", "node_id").orderBy("state")
    x = placed.join(parent, ["tree_id", "parent_id"]).join(dwell.filter("share > 0"), ["tree_id", "node_id"]).withColumn("upto", F.sum("share").over(w))
    x = colored(x, "state", name="_color")
    at = lambda f: F.col("px") + (F.col("x") - F.col("px")) * f
    return primitives(x, "path", F.array(point(at(F.col("upto") - F.col("share")), F.col("y")), point(at(F.col("upto")), F.col("y"))), 1.5, F.col("state"), color=F.col("_color"))


def node_pies(placed: DataFrame, probs: DataFrame, radius: float = 0.02) -> DataFrame:
    """Wedges of state probabilities (tree_id, node_id, state, p) at inner nodes, from the top clockwise."""
    w = Window.partitionBy("tree_id", "node_id").orderBy("state")
    x = placed.filter("NOT is_leaf").join(probs, ["tree_id", "node_id"]).withColumn("upto", F.sum("p").over(w))
    x = colored(x, "state", name="_color")
    angle = lambda t: F.lit(math.pi / 2) - 2 * math.pi * t
    r, a, b = F.col("max_depth") * radius, F.col("upto") - F.col("p"), F.col("upto")
    arc = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: point(F.col("x") + r * F.cos(angle(a + (b - a) * i / 12)), F.col("y") + r * F.sin(angle(a + (b - a) * i / 12))))
    return primitives(x, "polygon", F.concat(F.array(point(F.col("x"), F.col("y"))), arc), 3.5, F.col("state"), facecolor=F.col("_color"), p=F.round("p", 9))


def collapsed_clades(placed: DataFrame, color: str = "#bbbbbb") -> DataFrame:
    num = lambda k: F.expr(f"try_cast(data['{k}'] AS DOUBLE)")
    x = placed.filter(num("collapsed_far").isNotNull())
    return primitives(x, "polygon", F.array(point(F.col("x"), F.col("y")), point(F.col("x") + num("collapsed_far"), F.col("y") - 0.4), point(F.col("x") + num("collapsed_near"), F.col("y") + 0.4)), 1.2, F.col("data")["collapsed_n"], facecolor=color)


def node_bars(placed: DataFrame, base: str) -> DataFrame:
    """Bars of an interval annotation (base_lower to base_upper, measured from the tips); none at all is an error."""
    lo, hi = (F.expr(f"try_cast(data['{base}_{k}'] AS DOUBLE)") for k in ("lower", "upper"))
    x = placed.withColumns({"_lo": lo, "_hi": hi}).filter("_lo is not null and _hi is not null")
    if not x.limit(1).count():
        raise ValueError(f"no node has {base}_lower and {base}_upper")
    return primitives(x, "path", F.array(point(F.col("max_depth") - F.col("_hi"), F.col("y")), point(F.col("max_depth") - F.col("_lo"), F.col("y"))), 2.0, width=4, color="#4477aa")


def connections(placed: DataFrame, pairs: DataFrame, bend: float = 0.3, steps: int = 20) -> DataFrame:
    """Curves between pairs of named nodes (a, b); a name that is none is an error."""
    named = placed.filter("name is not null").select("tree_id", "name", "x", "y", "max_depth")
    unknown = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct().join(named, "name", "left_anti").limit(10).collect()
    if unknown:
        raise ValueError(f"not nodes: {sorted(r.name for r in unknown)}")
    p, q = named.select("tree_id", F.col("name").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "max_depth"), named.select("tree_id", F.col("name").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    x = pairs.join(p, "a").join(q, ["tree_id", "b"])
    mx, my = (F.col("ax") + F.col("bx")) / 2 + F.col("max_depth") * bend, (F.col("ay") + F.col("by")) / 2
    curve = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: point((1 - i / steps) * (1 - i / steps) * F.col("ax") + 2 * (1 - i / steps) * (i / steps) * mx + (i / steps) * (i / steps) * F.col("bx"), (1 - i / steps) * (1 - i / steps) * F.col("ay") + 2 * (1 - i / steps) * (i / steps) * my + (i / steps) * (i / steps) * F.col("by")))
    return primitives(x.withColumn("node_id", F.lit(0)), "path", curve, 2.5, F.concat_ws("-", "a", "b"))


def domains(placed: DataFrame, data: DataFrame, key: str = "name", width: float = 0.6, gap: float = 0.02) -> DataFrame:
    """Blocks of (name, ord, domain, length) side by side in order; a negative length points left."""
    w = Window.partitionBy("tree_id", "_tip").orderBy("ord")
    x = tips_with(placed, data, key).withColumn("upto", F.sum(F.abs("length")).over(w))
    whole = F.max("upto").over(Window.partitionBy("tree_id"))
    x = colored(x.withColumn("whole", whole), "domain", name="_color")
    at = lambda v: F.col("max_depth") * (1 + gap) + F.col("max_depth") * width * v / F.col("whole")
    return primitives(x, "polygon", box(at(F.col("upto") - F.abs("length")), at(F.col("upto")), F.col("tip_ord") - 0.35, F.col("tip_ord") + 0.35), 2.0, F.col("domain"), facecolor=F.col("_color"), reverse=F.col("length") < 0)


def scale_bar(placed: DataFrame) -> DataFrame:
    x = placed.groupBy("tree_id").agg(F.max("max_depth").alias("m"), F.max("tip_ord").alias("n")).filter("m > 0").withColumns({"size": C.nice_step(F.col("m")), "node_id": F.lit(0)})
    return primitives(x, "path", F.array(point(F.lit(0.0), F.col("n") + 1), point(F.col("size"), F.col("n") + 1)), 3.0, number(F.col("size")), width=1.5)


# Bounds of geological periods in million years before present.
PERIODS = [("Quaternary", 0.0, 2.58), ("Neogene", 2.58, 23.03), ("Paleogene", 23.03, 66.0), ("Cretaceous", 66.0, 145.0), ("Jurassic", 145.0, 201.4), ("Triassic", 201.4, 251.9), ("Permian", 251.9, 298.9), ("Carboniferous", 298.9, 358.9), ("Devonian", 358.9, 419.2), ("Silurian", 419.2, 443.8), ("Ordovician", 443.8, 485.4), ("Cambrian", 485.4, 538.8)]


def time_axis(placed: DataFrame, ticks: int = 6, bands: bool = True) -> DataFrame:
    """Ticks at round ages before the tips, and the periods that overlap the tree's span, cut to it."""
    span = placed.groupBy("tree_id").agg(F.max("max_depth").alias("m"), F.max("tip_ord").alias("n")).filter("m > 0")
    step = C.nice_step(F.col("m"), ticks)
    at = span.withColumn("step", step).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / F.col("step")).cast("int")))).withColumn("age", F.col("k") * F.col("step"))
    out = primitives(at, "label", F.array(point(F.col("m") - F.col("age"), F.col("n") + 1.5)), 4.0, number(F.col("age").cast("double")), order="k")
    if bands:
        table = placed.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(PERIODS)], "k int, period string, young double, old double")
        x = span.join(F.broadcast(table), F.col("young") < F.col("m"))
        out = out.union(primitives(x, "polygon", box(F.col("m") - F.least("old", "m"), F.col("m") - F.col("young"), F.lit(-0.5), F.col("n") + 0.5), 0.1, F.col("period"), order="k"))
    return out


# -- keys ----------------------------------------------------------------------------------------------------


def legend(figures: DataFrame, scale: DataFrame, swatch: str = "point") -> DataFrame:
    """An entry a category of a colour scale, for each figure (tree_id); swatch: point or patch.  No points: keys take no part in bounds."""
    if swatch not in ("point", "patch"):
        raise ValueError("a swatch is point or patch")
    x = figures.select("tree_id").distinct().crossJoin(F.broadcast(scale))  # a scale has a row a category drawn
    return primitives(x, "legend", no_points(), 9.0, F.col("value"), order="place", title=F.col("title"), color=F.col("color"), swatch=swatch)


def colorbar(figures: DataFrame, scale: DataFrame, stops: int = 8) -> DataFrame:
    """One row for each figure: the ramp's title, bounds and colours from low to high."""
    ends = scale.agg(F.min_by(F.col("value"), "place").alias("lo"), F.max_by(F.col("value"), "place").alias("hi"), F.first("title").alias("title"))
    x = figures.select("tree_id").distinct().crossJoin(F.broadcast(ends)).filter("lo is not null").withColumn("place", F.lit(0))
    return primitives(x, "colorbar", no_points(), 9.0, F.col("title"), order="place", min=F.col("lo"), max=F.col("hi"), stops=",".join(C.gradient(stops)))


def key(placed: DataFrame, data: DataFrame, column: str, title: str | None = None, swatch: str = "point", **options) -> DataFrame:
    """The legend or colour bar of a table's column, as its values read."""
    categorical = options.pop("categorical", None)
    categorical = not is_numeric(data, column) if categorical is None else categorical
    scale = color_scale(data, column, title, categorical=categorical, **options)
    return legend(placed, scale, swatch) if categorical else colorbar(placed, scale)


# -- figures -----------------------------------------------------------------------------------------------


@dataclass
class TreeFigure:
    """A tree's layout and the elements drawn on it, in order; ``add`` takes any function of the placed nodes."""

    nodes: DataFrame
    layout: str = "rectangular"
    elements: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    title: str | None = None

    def placed(self) -> DataFrame:
        return L.get_layout(self.layout)(self.nodes)

    @property
    def stroke(self) -> str:
        if self.layout in ("equal_angle", "unrooted", "daylight", "slanted", "diagonal", "circular_slanted", "circular_diagonal"):
            return "straight"
        return "circular" if self.layout in ("circular", "radial", "polar", "fan", "inward", "inward_circular") else "dendrogram" if self.layout in ("dendrogram", "vertical") else "rectangular"

    def add(self, element: Callable[..., DataFrame], *args, **options) -> TreeFigure:
        self.elements.append(lambda placed: element(placed, *args, **options))
        return self

    def titled(self, title: str) -> TreeFigure:
        self.title = title
        return self

    def branches(self, **options) -> TreeFigure:
        return self.add(lambda placed: branches(placed, self.stroke, **options))

    def scene(self) -> DataFrame:
        placed = self.placed().persist()  # every element reads it
        return reduce(DataFrame.unionByName, [branches(placed, self.stroke)] + [e(placed) for e in self.elements])

    def add_scale(self, data: DataFrame, column: str, **options) -> TreeFigure:
        """A legend or colour bar for a column of a table."""
        return self.add(key, data, column, **options)

    def save(self, path: str) -> None:
        """Parquet of the scene, or with .svg, .html or .json (traces for a browser's plotting library) one drawing a figure."""
        if path.endswith((".svg", ".html")):
            drawn = svg(self.scene(), title=self.title)
            drawn.select(page(F.col("svg"), self.title or "").alias("t") if path.endswith(".html") else "svg").coalesce(1).write.text(path)
        elif path.endswith(".json"):
            traces(self.scene()).select("json").coalesce(1).write.text(path)
        else:
            self.scene().write.parquet(path)

    def show(self) -> str:
        """The drawing of the first figure, shown in a notebook where there is one."""
        text = svg(self.scene(), title=self.title).orderBy("fig_id").limit(1).first().svg
        try:
            from IPython.display import SVG, display
        except ImportError:
            return text
        display(SVG(text))
        return text


for _name, _element in {"tip_labels": tip_labels, "node_labels": node_labels, "support_labels": support_labels, "points": points, "highlight": highlight, "clade_label": clade_label, "heatmap": heatmap, "ring": ring_stack, "bar_track": bar_track, "alignment": alignment_track, "painted_branches": painted_branches, "node_pies": node_pies, "collapsed_clades": collapsed_clades, "node_bars": node_bars, "connections": connections, "domains": domains, "scale_bar": scale_bar, "time_axis": time_axis}.items():
    setattr(TreeFigure, _name, lambda self, *a, _e=_element, **k: self.add(_e, *a, **k))
TreeFigure.tip_points = lambda self, **k: self.add(points, "tips", **k)
TreeFigure.node_points = lambda self, **k: self.add(points, "nodes", **k)


def mirrored(scene: DataFrame, x0: float, yscale: float = 1.0) -> DataFrame:
    return scene.withColumn("points", F.transform("points", lambda p: point(F.lit(x0) - p["x"], p["y"] * yscale)))


def tangle(left: DataFrame, right: DataFrame, width: float | None = None) -> DataFrame:
    """Two trees face to face with links between shared tips; links that cross others are marked."""
    from ..operators.compare import discordant

    a, b = L.rectangular(left), L.rectangular(right)
    la, lb = (x.agg(F.max("max_depth"), F.first("tree_id")).first() for x in (a, b))
    gap = width or 0.5 * max(la[0], lb[0], 1e-9)
    x0 = la[0] + gap + lb[0]
    flags = discordant(left.unionByName(right), la[1], lb[1])
    ends = a.filter("is_leaf").select("name", F.col("y").alias("ya")).join(b.filter("is_leaf").select("name", F.col("y").alias("yb")), "name").join(flags, "name")
    links = ends.withColumn("tree_id", F.lit("links")).withColumn("node_id", F.lit(0))
    links = primitives(links, "path", F.array(point(F.lit(float(la[0])), F.col("ya")), point(F.lit(float(la[0] + gap)), F.col("yb"))), 0.8, F.col("name"), discordant=F.col("crossings") > 0)
    return branches(a, "rectangular").union(mirrored(branches(b, "rectangular"), float(x0))).union(links)


def ribbons(left: DataFrame, right: DataFrame, groups: DataFrame) -> DataFrame:
    """(label, lo_a, hi_a, lo_b, hi_b): rows that each group of tips spans in both trees."""
    span = lambda t, s: t.filter("is_leaf").join(groups, "name").groupBy("label").agg(F.min("tip_ord").alias(f"lo_{s}"), F.max("tip_ord").alias(f"hi_{s}"))
    return span(left, "a").join(span(right, "b"), "label")


def densi(nodes: DataFrame, reference: str, alpha: float = 0.1) -> DataFrame:
    """All trees over each other: depths scaled to the reference's, tips at the reference's rows."""
    g = L.rectangular(nodes)
    ref = g.filter(F.col("tree_id") == reference)
    deepest = ref.agg(F.max("max_depth")).first()[0]
    rows = ref.filter("is_leaf").select("name", F.col("row").alias("ref_row"))
    tips = g.filter("is_leaf").join(rows, "name").select("tree_id", "tip_ord", "ref_row")
    under = g.select("tree_id", "node_id", "parent_id", "leaf_lo", "leaf_hi", (F.lit(float(deepest)) * F.try_divide(F.col("depth"), F.col("max_depth"))).alias("x"))
    y = under.join(tips, "tree_id").filter("tip_ord BETWEEN leaf_lo AND leaf_hi").groupBy("tree_id", "node_id").agg(((F.min("ref_row") + F.max("ref_row")) / 2).alias("y"))
    return primitives(L.branch_paths(under.join(y, ["tree_id", "node_id"]), "straight"), "path", F.col("points"), 1.0, alpha=alpha)


def panels(scenes: list[DataFrame], columns: int = 2) -> DataFrame:
    """Scenes side by side: (panel, row, col, ...)."""
    return reduce(DataFrame.unionByName, [s.withColumns({"panel": F.lit(i), "panel_row": F.lit(i // columns), "panel_col": F.lit(i % columns)}) for i, s in enumerate(scenes)])


def bounds(scene: DataFrame) -> DataFrame:
    p = scene.select("fig_id", F.explode("points").alias("p"))
    return p.groupBy("fig_id").agg(*[f(F.col(f"p.{c}")).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


# Corners of markers that are no circle, as parts of the radius.
CORNERS = {
    "s": [(-1, -1), (1, -1), (1, 1), (-1, 1)],
    "^": [(0, -1), (1, 1), (-1, 1)],
    "v": [(0, 1), (1, -1), (-1, -1)],
    "<": [(-1, 0), (1, -1), (1, 1)],
    ">": [(1, 0), (-1, -1), (-1, 1)],
    "D": [(0, -1), (1, 0), (0, 1), (-1, 0)],
    "P": [(-0.4, -1), (0.4, -1), (0.4, -0.4), (1, -0.4), (1, 0.4), (0.4, 0.4), (0.4, 1), (-0.4, 1), (-0.4, 0.4), (-1, 0.4), (-1, -0.4), (-0.4, -0.4)],
    "X": [(0, -0.5), (0.5, -1), (1, -0.5), (0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5), (-0.5, 1), (-1, 0.5), (-0.5, 0), (-1, -0.5), (-0.5, -1)],
    "*": [((1 if k % 2 == 0 else 0.45) * math.sin(math.pi * k / 5), -(1 if k % 2 == 0 else 0.45) * math.cos(math.pi * k / 5)) for k in range(10)],
}


def escaped(text: Column) -> Column:
    for plain, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(said))
    return F.coalesce(text, F.lit(""))


def svg(scene: DataFrame, width: int = 800, height: int = 600, title: str | None = None) -> DataFrame:
    """(fig_id, svg): each figure scaled to a box, its styles kept, keys at the right; what has a text shows it on hovering."""
    two = lambda v: F.format_string("%.2f", v)
    keyed = F.col("kind").isin("legend", "colorbar")
    side = F.when(F.max(keyed.cast("int")).over(Window.partitionBy("fig_id")) > 0, 160).otherwise(0)
    x = scene.withColumn("_side", side).join(bounds(scene), "fig_id", "left")
    px = lambda p: (p["x"] - F.col("min_x")) * (width - 40 - F.col("_side")) / F.greatest(F.col("max_x") - F.col("min_x"), F.lit(1e-9)) + 20
    py = lambda p: (p["y"] - F.col("min_y")) * (height - 60) / F.greatest(F.col("max_y") - F.col("min_y"), F.lit(1e-9)) + 40
    x = x.withColumn("at", F.transform("points", lambda p: F.struct(px(p).alias("x"), py(p).alias("y"))))
    first = Window.partitionBy("fig_id", keyed).orderBy(F.col("style")["title"], "ord", "text")
    x = x.withColumn("_line", F.when(keyed, F.row_number().over(first)))
    said, look = escaped(F.col("text")), lambda k, other: F.coalesce(F.col("style")[k], F.lit(str(other)))
    xy = F.array_join(F.transform("at", lambda p: F.concat(two(p["x"]), F.lit(","), two(p["y"]))), " ")
    cx, cy = F.get("at", F.lit(0))["x"], F.get("at", F.lit(0))["y"]
    hint = F.when(said != "", F.concat(F.lit("<title>"), said, F.lit("</title>"))).otherwise(F.lit(""))
    own = lambda name, **given: F.concat(F.lit(f"<{name}"), *[part for k, v in given.items() for part in (F.lit(f' {k.replace("_", "-")}="'), v if isinstance(v, Column) else F.lit(str(v)), F.lit('"'))], F.lit(">"))
    r = F.coalesce(F.expr("try_cast(style['size'] AS DOUBLE)"), F.lit(6.0)) / 2
    marker = F.concat(own("circle", cx=two(cx), cy=two(cy), r=two(r), fill=look("color", "black")), hint, F.lit("</circle>"))
    for shape, corners in CORNERS.items():
        ring = F.concat_ws(" ", *[F.concat(two(cx + r * a), F.lit(","), two(cy + r * b)) for a, b in corners])
        marker = F.when(look("marker", "o") == shape, F.concat(own("polygon", points=ring, fill=look("color", "black")), hint, F.lit("</polygon>"))).otherwise(marker)
    codes = F.split("text", ",")
    wide, table = (F.get("at", F.lit(1))["x"] - cx) / F.greatest(F.size(codes), F.lit(1)), F.array(*[F.lit(c) for c in C.hue_palette(26)])
    cell = F.transform(codes, lambda c, i: F.when(c.cast("int") >= 0, F.concat(own("rect", x=two(cx + wide * i), y=two(F.least(cy, F.get("at", F.lit(2))["y"])), width=two(wide), height=two(F.abs(F.get("at", F.lit(2))["y"] - cy)), fill=F.get(table, F.pmod(c.cast("int"), F.lit(26)))), F.lit("</rect>"))).otherwise(F.lit("")))
    left, line = width - 150, F.lit(30) + 18 * F.col("_line")
    patch = own("rect", x=left, y=two(line - 9.0), width=10, height=10, fill=look("color", "black"))
    dot = own("circle", cx=left + 5, cy=two(line - 4.0), r=4, fill=look("color", "black"))
    entry = F.concat(F.when(look("swatch", "point") == "patch", F.concat(patch, F.lit("</rect>"))).otherwise(F.concat(dot, F.lit("</circle>"))), own("text", x=left + 16, y=two(line.cast("double")), font_size=10), said, F.lit("</text>"))
    entry = F.concat(F.when(F.col("ord") == 0, F.concat(own("text", x=left, y=two(line - 14.0), font_size=10, font_weight="bold"), escaped(F.col("style")["title"]), F.lit("</text>"))).otherwise(F.lit("")), entry)
    stops = F.split(look("stops", ""), ",")
    bar = F.concat(own("text", x=left, y=two(line.cast("double")), font_size=10), said, F.lit(": "), look("min", ""), F.lit(" - "), look("max", ""), F.lit("</text>"), F.array_join(F.transform(stops, lambda c, i: F.concat(own("rect", x=(F.lit(left) + 12 * i).cast("string"), y=two(line + 4.0), width=12, height=8, fill=c), F.lit("</rect>"))), ""))
    tag = (
        F.when(F.col("kind") == "path", F.concat(own("polyline", fill="none", stroke=look("color", "black"), stroke_width=look("width", 1), stroke_opacity=look("alpha", 1), points=xy), hint, F.lit("</polyline>")))
        .when(F.col("kind") == "marker", marker)
        .when(F.col("kind") == "label", F.concat(own("text", x=two(cx), y=two(cy), font_size=look("size", 10), font_style=F.when(look("italic", "false") == "true", "italic").otherwise("normal"), fill=look("color", "black")), said, F.lit("</text>")))
        .when(F.col("kind") == "raster", F.array_join(cell, ""))
        .when(F.col("kind") == "legend", entry)
        .when(F.col("kind") == "colorbar", bar)
        .otherwise(F.concat(own("polygon", fill=look("facecolor", "black"), fill_opacity=look("alpha", 1), points=xy), hint, F.lit("</polygon>")))
    )
    body = x.groupBy("fig_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("zorder", "ord", tag.alias("t")))), lambda e: e["t"]), "").alias("b"))
    head = F.concat(F.lit('<text x="20" y="20" font-size="14">'), escaped(F.lit(title)), F.lit("</text>")) if title else F.lit("")
    return body.select("fig_id", F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">'), head, "b", F.lit("</svg>")).alias("svg"))


def page(drawing: Column, title: str) -> Column:
    """A drawing in a page of its own."""
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), escaped(F.lit(title)), F.lit("</title></head><body>"), drawing, F.lit("</body></html>"))


def traces(scene: DataFrame) -> DataFrame:
    """(fig_id, json): {"data": [...], "layout": {...}} of scatter and heatmap traces; keys are traces with a name and no points."""
    kind = F.col("kind")
    num = lambda k: F.expr(f"try_cast(style['{k}'] AS DOUBLE)")
    color = F.coalesce(F.col("style")["color"], F.col("style")["facecolor"])
    raster, p = kind == "raster", lambda i: F.get("points", F.lit(i))
    codes = F.split("text", ",").cast("array<int>")
    trace = F.struct(
        F.when(raster, "heatmap").otherwise("scatter").alias("type"),
        F.when(~raster, F.transform("points", lambda q: q["x"])).alias("x"),
        F.when(~raster, F.transform("points", lambda q: q["y"])).alias("y"),
        F.when(raster, F.array(codes)).alias("z"),
        F.when(raster, p(0)["x"]).alias("x0"),
        F.when(raster, (p(1)["x"] - p(0)["x"]) / F.greatest(F.size(codes), F.lit(1))).alias("dx"),
        F.when(raster, (p(0)["y"] + p(2)["y"]) / 2).alias("y0"),
        F.when(~raster, F.when(kind == "label", "text").when(kind.isin("marker", "legend"), "markers").otherwise("lines")).alias("mode"),
        F.when(kind == "polygon", "toself").alias("fill"),
        F.when(kind == "polygon", color).alias("fillcolor"),
        F.when(~raster & F.col("text").isNotNull(), F.array("text")).alias("text"),
        F.when(kind.isin("legend", "colorbar"), F.col("text")).alias("name"),
        kind.isin("legend", "colorbar").alias("showlegend"),
        F.when(kind.isin("path", "polygon"), F.struct(color.alias("color"), num("width").alias("width"))).alias("line"),
        F.when(kind.isin("marker", "legend"), F.struct(color.alias("color"), num("size").alias("size"))).alias("marker"),
        num("alpha").alias("opacity"),
    )
    data = scene.groupBy("fig_id").agg(F.array_sort(F.collect_list(F.struct("zorder", "ord", trace.alias("t")))).alias("d"))
    return data.select("fig_id", F.to_json(F.struct(F.transform("d", lambda e: e["t"]).alias("data"), F.struct(F.struct(F.col("fig_id").alias("text")).alias("title"), F.lit("closest").alias("hovermode")).alias("layout"))).alias("json"))
