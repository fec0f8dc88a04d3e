"""Sequence networks and split networks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numerics import nnls
from ..session import shared_dir

# -- graphs ---------------------------------------------------------------------------------------


def edges_from_distances(distances: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """(x, y, w): pairs whose similarity 1 - d is above the cutoff."""
    return distances.select("x", "y", (1 - F.col("d")).alias("w")).filter(F.col("w") > cutoff)


def edges_from_pairs(pairs: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((name), (x, y, w)): a missing weight is 1; with names given, others are an error."""
    edges = pairs.select("x", "y", F.coalesce(F.col("w"), F.lit(1.0)).alias("w"))
    seen = edges.select(F.col("x").alias("name")).union(edges.select("y")).distinct()
    if names is None:
        return seen, edges
    unknown = seen.join(names, "name", "left_anti").orderBy("name").limit(10).collect()
    if unknown:
        raise ValueError(f"not nodes of the network: {[r.name for r in unknown]}")
    return names, edges


def connected_components(names: DataFrame, edges: DataFrame, most: int = 60, checkpoint: bool = True) -> DataFrame:
    """(name, component, size, place): labels are each component's least name; place counts from 1, largest first.

    Every round takes the least label around and jumps to that label's own label, so rounds grow
    with the logarithm of a component's width; lineage is cut in the checkpoint folder.
    """
    spark = names.sparkSession
    if checkpoint and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    cut = (lambda df: df.checkpoint()) if checkpoint else (lambda df: df)
    both = cut(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    labels = cut(names.select("name", F.col("name").alias("label")))
    for _ in range(most):
        near = both.join(labels.withColumnRenamed("name", "y"), "y").groupBy(F.col("x").alias("name")).agg(F.min("label").alias("near"))
        own = labels.join(near, "name", "left").select("name", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = own.select(F.col("name").alias("label"), F.col("label").alias("far"))
        new = cut(own.join(jump, "label", "left").select("name", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = new.select("name", "label")
        if not new.filter("old <> label").limit(1).count():
            break
    else:
        raise RuntimeError(f"components have not settled in {most} rounds")
    size = labels.groupBy("label").agg(F.count("*").alias("size")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "label")))
    return labels.join(size, "label").select("name", F.col("label").alias("component"), "size", "place")


def cluster_centroids(positions: DataFrame, groups: DataFrame) -> DataFrame:
    """(label, x, y, reach): centre of each group's nodes and the farthest of them."""
    x = positions.join(groups, "name")
    centre = x.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    return x.join(centre, "label").groupBy("label", "cx", "cy", "n").agg(F.max(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).alias("reach"))


def force_layout(names: list[str], edges: list[tuple[str, str, float]], iterations: int = 300, seed: int = 0, k: float | None = None, gravity: float = 0.8) -> np.ndarray:
    """Coordinates by spring forces along edges, repulsion between all nodes and a pull to the middle."""
    n = len(names)
    if n < 2:
        return np.zeros((n, 2))
    rng, at = np.random.default_rng(seed), {v: i for i, v in enumerate(names)}
    p, k = rng.random((n, 2)) - 0.5, k or 1 / math.sqrt(n)
    i, j, w = np.array([at[a] for a, _, _ in edges], int), np.array([at[b] for _, b, _ in edges], int), np.array([e[2] for e in edges], float)
    for step in range(iterations):
        apart = p[:, None] - p[None, :]
        d = np.maximum(np.sqrt((apart**2).sum(2)), 1e-6)
        move = (apart * (k * k / d**2)[:, :, None]).sum(1)
        if len(i):
            e = p[i] - p[j]
            pull = e * (w * np.maximum(np.sqrt((e**2).sum(1)), 1e-6) / k)[:, None]
            np.add.at(move, i, -pull)
            np.add.at(move, j, pull)
        move -= gravity * p * k
        size = np.maximum(np.sqrt((move**2).sum(1, keepdims=True)), 1e-9)
        p = p + move / size * np.minimum(size, 0.1 * (1 - step / iterations) + 1e-3)
    return p


def layout_by_component(components: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """(name, component, x, y): each component is laid out in a task, then discs are set side by side, largest first."""
    tagged = edges.join(components.select(F.col("name").alias("x"), F.col("component").alias("component")), "x")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = sorted(left["name"])
        p = force_layout(names, list(zip(right["x"], right["y"], right["w"])), **options)
        p = p - p.mean(0)
        reach = max(float(np.sqrt((p**2).sum(1)).max(initial=0)), 1e-9)
        p = p / reach * math.sqrt(len(names))
        return pd.DataFrame({"name": names, "component": left["component"].iloc[0], "size": len(names), "px": p[:, 0], "py": p[:, 1]})

    own = components.select("name", "component").groupBy("component").cogroup(tagged.select("component", "x", "y", "w").groupBy("component")).applyInPandas(run, "name string, component string, size int, px double, py double")
    discs = own.select("component", "size").distinct().withColumn("r", F.sqrt("size") + 0.5)
    shift = discs.withColumn("offset", 2 * F.sum("r").over(Window.orderBy(F.desc("size"), "component")) - F.col("r")).select("component", "offset")
    return own.join(shift, "component").select("name", "component", (F.col("px") + F.col("offset")).alias("x"), F.col("py").alias("y"))


# -- splits -----------------------------------------------------------------------------------------


def canonical(side, names: list[str]) -> frozenset:
    """The smaller side of a split; of equal ones the one that sorts first."""
    a = frozenset(side)
    b = frozenset(names) - a
    return min((a, b), key=lambda s: (len(s), sorted(s)))


def conflicting(a: frozenset, b: frozenset, universe: frozenset) -> bool:
    return bool(a & b) and bool(a - b) and bool(b - a) and bool(universe - a - b)


def is_circular(side, order: list[str]) -> bool:
    """Whether a side is one stretch of a circular order."""
    hit = [n in side for n in order]
    return sum(hit[i] and not hit[i - 1] for i in range(len(hit))) <= 1


def circular_test(found: DataFrame, order: DataFrame) -> DataFrame:
    """(split_key, arcs, circular) for splits (split_key, side) and an order (name, place from 0)."""
    n = order.count()
    inside = found.select("split_key", F.explode("side").alias("name")).join(order, "name").select("split_key", "place")
    before = inside.select("split_key", F.pmod(F.col("place") + 1, F.lit(n)).cast("int").alias("place"), F.lit(1).alias("after"))
    starts = inside.join(before, ["split_key", "place"], "left").groupBy("split_key").agg(F.count_if(F.col("after").isNull()).alias("arcs"))
    return starts.select("split_key", "arcs", (F.col("arcs") <= 1).alias("circular"))


def circular_splits(order: list[str]) -> list[frozenset]:
    """All arcs of a circular order that leave out its first name."""
    n = len(order)
    return [frozenset(order[i:j]) for i in range(1, n) for j in range(i + 1, n + 1)]


def neighbornet_ordering(names: list[str], d: np.ndarray) -> list[str]:
    """Circular order by agglomeration: clusters are chains, the two closest by the neighbour-joining criterion
    join at the ends that lie closest."""
    d = np.asarray(d, float)
    chains = [[i] for i in range(len(names))]
    while len(chains) > 1:
        m = len(chains)
        between = np.array([[d[np.ix_(a, b)].mean() if a is not b else 0.0 for b in chains] for a in chains])
        r = between.sum(1)
        q = (max(m - 2, 1)) * between - r[:, None] - r[None, :]
        q[np.diag_indices(m)] = np.inf
        i, j = sorted(np.unravel_index(int(q.argmin()), q.shape))
        a, b = chains[i], chains[j]
        rest = [x for k, c in enumerate(chains) if k not in (i, j) for x in c]
        options = []
        for x in (a, a[::-1]):
            for y in (b, b[::-1]):
                pull = d[x[-1], y[0]] - (d[x[-1], rest].mean() + d[y[0], rest].mean() if rest else 0.0) / 1.0
                options.append((round(float(pull), 12), x + y))
        chains[i] = min(options, key=lambda o: (o[0], o[1]))[1]
        del chains[j]
    order = chains[0]
    at = order.index(0)
    return [names[i] for i in order[at:] + order[:at]]


def split_weights(names: list[str], d: np.ndarray, order: list[str], tol: float = 1e-8) -> dict[frozenset, float]:
    """Non-negative least-squares weights of the arcs of an order."""
    arcs, at = circular_splits(order), {n: i for i, n in enumerate(names)}
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :]]
    design = np.array([[float((a in s) != (b in s)) for s in arcs] for a, b in pairs])
    x = nnls(design, np.array([d[at[a], at[b]] for a, b in pairs]))
    return {s: float(w) for s, w in zip(arcs, x) if w > tol}


def residual(names: list[str], d: np.ndarray, weights: dict[frozenset, float]) -> float:
    """Share of the squared distances that the splits leave out."""
    fit = np.array([[sum(w for s, w in weights.items() if (a in s) != (b in s)) for b in names] for a in names])
    return float(((fit - d) ** 2).sum() / max((np.asarray(d) ** 2).sum(), 1e-300))


def circular_ordering(names: list[str], splits: dict[frozenset, float], sweeps: int = 5) -> list[str]:
    """An order in which as much split weight as possible stands in one stretch: adjacent swaps and reversals uphill."""
    score = lambda o: sum(w for s, w in splits.items() if is_circular(s, o))
    order = list(names)
    for s in sorted(splits, key=lambda s: (-splits[s], sorted(s))):  # gather each side where that loses nothing
        tried = [n for n in order if n not in s] + [n for n in order if n in s]
        if score(tried) > score(order):
            order = tried
    best = score(order)
    for _ in range(sweeps):
        before = best
        for i in range(1, len(order)):
            for j in range(i + 1, len(order) + 1):
                tried = order[:i] + order[i:j][::-1] + order[j:]
                if (now := score(tried)) > best + 1e-12:
                    order, best = tried, now
        if best == before:
            break
    return order


class SplitNetwork:
    """Weighted splits of one set of taxa, with the circular order they are drawn in."""

    def __init__(self, names: list[str], splits: dict, order: list[str] | None = None, min_weight: float = 0.0, max_splits: int = 20):
        merged: dict[frozenset, float] = {}
        for s, w in splits.items():
            c = canonical(s, names)
            if c and len(c) < len(names) and w > min_weight:
                merged[c] = max(w, merged.get(c, 0.0))
        self.names = list(names)
        self.order = order or circular_ordering(self.names, merged)
        self.aside = {s: w for s, w in merged.items() if not is_circular(s, self.order)}
        drawable = {s: w for s, w in merged.items() if s not in self.aside}
        self.splits = self.selected(drawable, max_splits)

    def selected(self, ranked: dict[frozenset, float], most: int) -> dict[frozenset, float]:
        """The strongest for seven tenths of the places, then those that conflict with them, then the rest by weight."""
        inner = sorted((s for s in ranked if len(s) > 1), key=lambda s: (-ranked[s], sorted(s)))
        strong, rest = inner[: math.ceil(0.7 * most)], inner[math.ceil(0.7 * most) :]
        whole = frozenset(self.names)
        clash = [s for s in rest if any(conflicting(s, t, whole) for t in strong)]
        kept = (strong + clash + [s for s in rest if s not in clash])[:most]
        return {s: ranked[s] for s in ranked if len(s) == 1 or s in kept}

    @classmethod
    def from_distances(cls, names: list[str], d: np.ndarray, ordering: str = "neighbornet", **options) -> SplitNetwork:
        order = neighbornet_ordering(names, d) if ordering == "neighbornet" else list(names)
        return cls(names, split_weights(names, d, order), order, max_splits=options.pop("max_splits", len(names) ** 2), **options)

    neighbor_net = from_distances

    @classmethod
    def from_trees(cls, frequencies: list[tuple[list[str], float]], names: list[str], **options) -> SplitNetwork:
        """From collected split frequencies (side, frequency)."""
        return cls(names, {frozenset(s): w for s, w in frequencies}, **options)

    def conflicts(self) -> list[tuple[frozenset, frozenset]]:
        own, whole = list(self.splits), frozenset(self.names)
        return [(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if conflicting(a, b, whole)]

    def network(self) -> tuple[list[tuple[int, ...]], list[tuple[int, int, int]]]:
        """(vertices as 0/1 vectors over the splits, edges (vertex, vertex, split)): taxa, and the cells between
        conflicting splits, joined by single splits."""
        own = list(self.splits)
        cells = {tuple(int(n in s) for s in own) for n in self.order}
        full = set(cells)
        for x, y in zip(self.order, [*self.order[1:], self.order[0]]):
            at, goal = [int(x in s) for s in own], [int(y in s) for s in own]
            differ = sorted((i for i in range(len(own)) if at[i] != goal[i]), key=lambda i: (goal[i], -len(own[i]) if goal[i] else len(own[i])))
            for i in differ:
                at[i] = goal[i]
                full.add(tuple(at))
        grown = True
        while grown:  # a pair of conflicting splits has all four corners
            grown = False
            for i, a in enumerate(own):
                for j in range(i + 1, len(own)):
                    if conflicting(a, own[j], frozenset(self.names)):
                        by: dict[tuple, set] = {}
                        for v in full:
                            by.setdefault(tuple(x for k, x in enumerate(v) if k not in (i, j)), set()).add((v[i], v[j]))
                        for rest, corners in by.items():
                            if len(corners) == 3:
                                for p in {(0, 0), (0, 1), (1, 0), (1, 1)} - corners:
                                    v = list(rest)
                                    v.insert(i, p[0])
                                    v.insert(j, p[1])
                                    full.add(tuple(v))
                                    grown = True
        vertices = sorted(full)
        at = {v: k for k, v in enumerate(vertices)}
        edges = []
        for v in vertices:
            for i in range(len(own)):
                if not v[i]:
                    u = (*v[:i], 1, *v[i + 1 :])
                    if u in at:
                        edges.append((at[v], at[u], i))
        return vertices, edges

    def positions(self) -> dict[str, tuple[float, float]]:
        """Taxa at sums of the directions of the splits that hold them; coincident ones are set apart by a hashed angle."""
        n, place = len(self.order), {x: i for i, x in enumerate(self.order)}
        out = {x: [0.0, 0.0] for x in self.names}
        for s, w in self.splits.items():
            own = [2 * math.pi * place[x] / n for x in s]
            angle = math.atan2(sum(map(math.sin, own)), sum(map(math.cos, own)))
            for x in s:
                out[x][0] += w * math.cos(angle)
                out[x][1] += w * math.sin(angle)
        seen: set[tuple[float, float]] = set()
        for x in self.order:
            key = (round(out[x][0], 9), round(out[x][1], 9))
            if key in seen:
                turn = int(hashlib.md5(x.encode()).hexdigest()[:8], 16) / 2**32 * 2 * math.pi
                out[x][0] += 1e-3 * math.cos(turn)
                out[x][1] += 1e-3 * math.sin(turn)
            seen.add(key)
        return {x: (p[0], p[1]) for x, p in out.items()}


def neighbor_nets(distances: DataFrame, key: str = "aln_id") -> DataFrame:
    """(key, side, size, weight, order) of the circular splits fitted to each matrix of (key, x, y, d)."""
    from .building import square

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = square(pdf)
        net = SplitNetwork.from_distances(names, d)
        return pd.DataFrame([(pdf[key].iloc[0], "|".join(sorted(s)), len(s), w, "|".join(net.order)) for s, w in sorted(net.splits.items(), key=lambda x: (-x[1], sorted(x[0])))], columns=[key, "side", "size", "weight", "order"])

    return distances.select(key, "x", "y", "d").groupBy(key).applyInPandas(run, f"{key} string, side string, size int, weight double, order string")
