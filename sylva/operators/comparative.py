"""Comparative methods: phylogenetic signal, regression, trait models, ordination, factors, cophylogeny.

One tree and one trait are a kernel's input; traits, models, permutations and bootstrap replicates are
rows of grouped maps, so they run side by side.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numerics import chi2_tail, f_tail, minimize_bounded, t_tail
from .phylo import Node, TreeError, tree


def vcv(root: Node, names: list[str]) -> np.ndarray:
    """Shared path lengths of tips."""
    paths = {}
    for t in root.leaves():
        paths[t.name] = {id(n): n.length or 0.0 for n in t.up() if n is not root}
    missing = [n for n in names if n not in paths]
    if missing:
        raise TreeError(f"not tips: {missing[:10]}")
    return np.array([[sum(v for k, v in paths[a].items() if k in paths[b]) for b in names] for a in names])


def _inverse(v: np.ndarray) -> np.ndarray:
    if np.linalg.matrix_rank(v) < len(v):
        raise TreeError("the covariance of the tips is singular: two tips stand at no distance")
    return np.linalg.inv(v)


def _mean(x: np.ndarray, vi: np.ndarray) -> float:
    return float(vi.sum(0) @ x / vi.sum())


def blomberg_k(root: Node, trait: dict[str, float], n_perm: int = 0, seed: int = 0) -> dict:
    """K, and with permutations the share of shuffled traits whose K is as high."""
    names = [n for n in root.names() if n in trait]
    v = vcv(root, names)
    vi, n = _inverse(v), len(names)
    expected = (np.trace(v) - n / vi.sum()) / (n - 1)

    def k(x):
        r = x - _mean(x, vi)
        return float((r @ r) / (r @ vi @ r) / expected)

    x = np.array([trait[i] for i in names], float)
    seen, rng = k(x), np.random.default_rng(seed)
    null = [k(rng.permutation(x)) for _ in range(n_perm)]
    return {"k": seen, "p": float(np.mean([a >= seen - 1e-12 for a in null])) if n_perm else None}


def _scaled(v: np.ndarray, lam: float) -> np.ndarray:
    out = v * lam
    np.fill_diagonal(out, np.diag(v))
    return out


def _profile(x: np.ndarray, design: np.ndarray, v: np.ndarray, reml: bool = False) -> tuple[float, np.ndarray, float, np.ndarray]:
    """(log likelihood, coefficients, variance, inverse of X'V^-1X) with mean and variance profiled out."""
    n, p = design.shape
    sign, det = np.linalg.slogdet(v)
    if sign <= 0:
        return -1e12, np.zeros(p), 1.0, np.eye(p)
    vi = np.linalg.inv(v)
    xtx = design.T @ vi @ design
    b = np.linalg.solve(xtx, design.T @ vi @ x)
    r = x - design @ b
    m = n - p if reml else n
    s2 = max(float(r @ vi @ r) / m, 1e-300)
    log = -0.5 * (m * math.log(2 * math.pi * s2) + det + m)
    if reml:
        log -= 0.5 * np.linalg.slogdet(xtx)[1]
    return log, b, s2, np.linalg.inv(xtx)


def pagels_lambda(root: Node, trait: dict[str, float]) -> dict:
    names = [n for n in root.names() if n in trait]
    x, v = np.array([trait[i] for i in names], float), vcv(root, names)
    one = np.ones((len(x), 1))
    log = lambda lam: _profile(x, one, _scaled(v, lam))[0]
    lam, value = minimize_bounded(lambda t: -log(t), 0.0, 1.0, 1e-6)
    best = max(((-value, lam), (log(0.0), 0.0), (log(1.0), 1.0)))
    lrt = max(0.0, 2 * (best[0] - log(0.0)))
    return {"lambda": float(best[1]), "logL": float(best[0]), "logL_0": float(log(0.0)), "lrt": lrt, "p": chi2_tail(lrt)}


def pgls(root: Node, y: dict[str, float], x: dict[str, dict[str, float]] | dict[str, float], lambda_: float | str = "REML", n_boot: int = 0, seed: int = 0) -> dict:
    """Regression with lambda-scaled covariance: fixed, or estimated by ML or REML; bootstrap p from the model without each term."""
    xs = x if x and isinstance(next(iter(x.values())), dict) else {"x": x}
    names = [n for n in root.names() if n in y and all(n in c for c in xs.values())]
    v, obs = vcv(root, names), np.array([y[n] for n in names], float)
    terms = ["intercept", *xs]
    design = np.column_stack([np.ones(len(names)), *[[c[n] for n in names] for c in xs.values()]])
    if len(names) <= design.shape[1] + 1:
        raise TreeError("too few taxa for this regression")

    def fit(values, columns):
        own = design[:, columns]
        if isinstance(lambda_, str):
            lam, _ = minimize_bounded(lambda t: -_profile(values, own, _scaled(v, t), lambda_ == "REML")[0], 0.0, 1.0, 1e-5)
        else:
            lam = lambda_
        log, b, _, inner = _profile(values, own, _scaled(v, lam), lambda_ == "REML")
        r = values - own @ b
        vi = np.linalg.inv(_scaled(v, lam))
        df = len(values) - len(columns) - isinstance(lambda_, str)
        s2 = float(r @ vi @ r) / df
        return lam, log, b, np.sqrt(np.diag(inner) * s2), df, r, vi

    every = list(range(design.shape[1]))
    lam, log, b, se, df, r, vi = fit(obs, every)
    centred = obs - _mean(obs, vi)
    out = {"lambda": float(lam), "logL": float(log), "df": df, "r2": float(1 - (r @ vi @ r) / (centred @ vi @ centred)), "terms": []}
    rng = np.random.default_rng(seed)
    for i, name in enumerate(terms):
        t = float(b[i] / se[i])
        row = {"term": name, "estimate": float(b[i]), "se": float(se[i]), "t": t, "p": t_tail(t, df)}
        if n_boot and i:
            rest = [k for k in every if k != i]
            l0, _, b0, _, _, r0, v0 = fit(obs, rest)
            root_v = np.linalg.cholesky(_scaled(v, l0) + 1e-12 * np.eye(len(obs))) * math.sqrt(float(r0 @ v0 @ r0) / (len(obs) - len(rest)))
            more = 0
            for _ in range(n_boot):
                _, _, bb, ss, *_ = fit(design[:, rest] @ b0 + root_v @ rng.standard_normal(len(obs)), every)
                more += abs(bb[i] / ss[i]) >= abs(t) - 1e-12
            row["p_boot"] = (more + 1) / (n_boot + 1)
        out["terms"].append(row)
    return out


def sister_differences(root: Node, trait: dict[str, float]) -> float:
    """Sum over inner nodes of the spread of their children's nodal means."""
    value, total = {}, 0.0
    for n in root.postorder():
        if n.is_leaf:
            value[id(n)] = trait[n.name]
            continue
        own = [value[id(c)] for c in n.children]
        w = [1 / max(c.length or 0.0, 1e-9) if (c.length or 0) > 0 else 1.0 for c in n.children]
        value[id(n)] = float(np.average(own, weights=w)) if any((c.length or 0) > 0 for c in n.children) else float(np.mean(own))
        total += max(own) - min(own)
    return total


def fritz_purvis_d(root: Node, trait: dict[str, int], n_sim: int = 999, seed: int = 0) -> dict:
    """D of a binary trait: 0 as under Brownian motion with a threshold, 1 as under shuffling."""
    names = root.names()
    x = np.array([trait[n] for n in names], float)
    if set(x) != {0.0, 1.0}:
        raise TreeError("a binary trait has both states")
    rng, v = np.random.default_rng(seed), vcv(root, names)
    seen = sister_differences(root, dict(zip(names, x)))
    shuffled = np.array([sister_differences(root, dict(zip(names, rng.permutation(x)))) for _ in range(n_sim)])
    chol = np.linalg.cholesky(v + 1e-9 * np.trace(v) / len(v) * np.eye(len(v)))
    ones, brown = int(x.sum()), []
    for _ in range(n_sim):
        z = chol @ rng.standard_normal(len(x))
        y = np.zeros(len(x))
        y[np.argsort(-z, kind="stable")[:ones]] = 1
        brown.append(sister_differences(root, dict(zip(names, y))))
    brown = np.array(brown)
    d = (seen - brown.mean()) / (shuffled.mean() - brown.mean())
    return {"d": float(d), "p_random": float(((shuffled <= seen).sum() + 1) / (n_sim + 1)), "p_brownian": float(((brown >= seen).sum() + 1) / (n_sim + 1))}


CONTINUOUS = ("BM", "OU", "EB", "lambda", "white")


def _shaped(v: np.ndarray, model: str, a: float) -> np.ndarray:
    if model == "BM":
        return v
    if model == "white":
        return np.eye(len(v))
    if model == "lambda":
        return _scaled(v, a)
    depth = np.diag(v)
    if model == "OU":
        apart = depth[:, None] + depth[None, :] - 2 * v
        return np.exp(-a * apart) * (1 - np.exp(-2 * a * v)) / (2 * a)
    return v if abs(a) < 1e-10 else np.expm1(a * v) / a


def fit_continuous(root: Node, trait: dict[str, float], model: str = "BM") -> dict:
    """Maximum likelihood of a continuous trait's model: Brownian, Ornstein-Uhlenbeck, early burst, lambda or white noise."""
    if model not in CONTINUOUS:
        raise TreeError(f"a model is one of {CONTINUOUS}")
    names = [n for n in root.names() if n in trait]
    x, v = np.array([trait[i] for i in names], float), vcv(root, names)
    one, height = np.ones((len(x), 1)), float(np.diag(v).max())
    log = lambda a: _profile(x, one, _shaped(v, model, a))[0]
    bounds = {"OU": (math.log(1e-4 / height), math.log(50 / height)), "EB": (-10 / height, 0.0), "lambda": (0.0, 1.0)}
    a, k = None, 2
    if model in bounds:
        tr = math.exp if model == "OU" else float
        u, _ = minimize_bounded(lambda t: -log(tr(t)), *bounds[model], 1e-6)
        a, k = tr(u), 3
        if model == "lambda":
            a = max((log(t), t) for t in (a, 0.0, 1.0))[1]
    value, b, s2, _ = _profile(x, one, _shaped(v, model, a if a is not None else 0.0))
    n = len(x)
    aic = 2 * k - 2 * value
    return {"model": model, "logL": float(value), "k": k, "AIC": float(aic), "AICc": float(aic + 2 * k * (k + 1) / (n - k - 1)) if n > k + 1 else None, "mean": float(b[0]), "sigma2": float(s2), "parameter": a}


def compare_continuous(nodes: DataFrame, traits: DataFrame, models: tuple[str, ...] = CONTINUOUS, criterion: str = "AICc") -> DataFrame:
    """(tree_id, trait, model, logl, k, score, delta, weight) for traits (name, trait, value): a task a trait and model."""
    grid = traits.sparkSession.createDataFrame([(m,) for m in models], "model string")
    packed = traits.groupBy("trait").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("v")).crossJoin(grid)
    trees = nodes.select(F.col("tree_id").alias("tree_id")).distinct()
    tasks = packed.crossJoin(trees)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        root, out = tree(left), []
        for trait, values, model in zip(right["trait"], right["v"], right["model"]):
            f = fit_continuous(root, dict(values), model)
            out.append((left["tree_id"].iloc[0], trait, model, f["logL"], f["k"], f[criterion]))
        return pd.DataFrame(out, columns=["tree_id", "trait", "model", "logl", "k", "score"])

    fits = nodes.groupBy("tree_id").cogroup(tasks.groupBy("tree_id")).applyInPandas(run, "tree_id string, trait string, model string, logl double, k int, score double")
    w = Window.partitionBy("tree_id", "trait")
    x = fits.withColumn("delta", F.col("score") - F.min("score").over(w))
    return x.withColumn("weight", F.exp(-F.col("delta") / 2) / F.sum(F.exp(-F.col("delta") / 2)).over(w)).orderBy("tree_id", "trait", "score")


def phylo_pca(root: Node, data: pd.DataFrame, mode: str = "cov") -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """(scores, loadings, eigenvalues) of traits by name with the tree's covariance removed."""
    names = [n for n in root.names() if n in data.index]
    x, vi = data.loc[names].to_numpy(float), _inverse(vcv(root, names))
    mean = (vi.sum(0) @ x) / vi.sum()
    r = x - mean
    c = r.T @ vi @ r / (len(names) - 1)
    if mode == "corr":
        s = np.sqrt(np.diag(c))
        r, c = r / s, c / np.outer(s, s)
    w, u = np.linalg.eigh(c)
    order = np.argsort(-w)
    w, u = w[order], u[:, order]
    u *= np.where(u[np.abs(u).argmax(0), range(len(w))] < 0, -1, 1)
    labels = [f"PC{i + 1}" for i in range(len(w))]
    return pd.DataFrame(r @ u, names, labels), pd.DataFrame(u * np.sqrt(np.maximum(w, 0)), data.columns, labels), w


# -- phylofactor ----------------------------------------------------------------------------------------------


def ilr_balances(nodes: DataFrame, table: DataFrame, pseudocount: float = 1e-6, within: DataFrame | None = None) -> DataFrame:
    """(tree_id, edge_id, sample, balance): contrast of mean log abundance below an edge against the rest.

    Sums below an edge come from the path table; those of the rest are the sample's less these.
    within: (taxon, bin) restricts an edge to the taxa of one bin, for later factors.
    """
    from .paths import tip_paths

    taxa = nodes.filter("is_leaf").select(F.col("name").alias("taxon"))
    grid = table.select("sample").distinct().crossJoin(taxa).join(table, ["sample", "taxon"], "left")
    grid = grid.withColumn("l", F.log(F.coalesce("abundance", F.lit(0.0)) + pseudocount))
    bins = within if within is not None else taxa.withColumn("bin", F.lit(0))
    grid = grid.join(bins, "taxon")
    whole = grid.groupBy("bin", "sample").agg(F.sum("l").alias("all_l"), F.count("*").alias("all_n"))
    below = tip_paths(nodes).select("tree_id", "taxon", "edge_id").join(grid.select("taxon", "bin", "sample", "l"), "taxon").groupBy("tree_id", "bin", "edge_id", "sample").agg(F.sum("l").alias("l"), F.count("*").alias("n"))
    x = below.join(whole, ["bin", "sample"]).filter("n < all_n").withColumn("m", F.col("all_n") - F.col("n"))
    return x.select("tree_id", "bin", "edge_id", "sample", (F.sqrt(F.col("n") * F.col("m") / F.col("all_n")) * (F.col("l") / F.col("n") - (F.col("all_l") - F.col("l")) / F.col("m"))).alias("balance"))


def factor_scores(balances: DataFrame, covariate: DataFrame, categorical: bool = False) -> DataFrame:
    """(tree_id, bin, edge_id, f): regression on, or variance between the groups of, covariate (sample, value)."""
    x = balances.join(covariate, "sample")
    keys = ["tree_id", "bin", "edge_id"]
    if not categorical:
        s = x.groupBy(*keys).agg(F.regr_r2("balance", "value").alias("r2"), F.count("*").alias("n"))
        return s.select(*keys, F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")).alias("f"), F.lit(1).alias("d1"), (F.col("n") - 2).alias("d2"))
    g = x.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.avg("balance").alias("m"), F.coalesce(F.var_pop("balance"), F.lit(0.0)).alias("v"))
    s = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("between"))
    return s.select(*keys, F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"), (F.col("k") - 1).alias("d1"), (F.col("n") - F.col("k")).alias("d2"))


def phylofactor(nodes: DataFrame, table: DataFrame, covariate: DataFrame, n_factors: int = 1, categorical: bool = False, pseudocount: float = 1e-6) -> list[dict]:
    """Greedy factors: the edge with the greatest F splits its bin in two, then the search goes on.  P-values are
    of the best of many edges and so not calibrated."""
    taxa = nodes.filter("is_leaf").select(F.col("name").alias("taxon"), "tip_ord")
    bins, out = taxa.select("taxon", F.lit(0).alias("bin")), []
    for i in range(n_factors):
        scored = factor_scores(ilr_balances(nodes, table, pseudocount, bins), covariate, categorical).filter("f is not null")
        best = scored.orderBy(F.desc(F.round("f", 9)), "edge_id", "bin").limit(1).collect()
        if not best:
            break
        b = best[0]
        edge = nodes.filter((F.col("tree_id") == b.tree_id) & (F.col("node_id") == b.edge_id)).select("leaf_lo", "leaf_hi").first()
        inside = taxa.filter(F.col("tip_ord").between(edge.leaf_lo, edge.leaf_hi)).select("taxon", F.lit(True).alias("_in"))
        own = bins.join(inside, "taxon", "left")
        side = [r.taxon for r in own.filter((F.col("bin") == b.bin) & F.col("_in")).select("taxon").orderBy("taxon").collect()]
        out.append({"factor": i + 1, "edge_id": b.edge_id, "bin": b.bin, "f": b.f, "p": f_tail(b.f, b.d1, b.d2), "taxa": side})
        bins = own.select("taxon", F.when((F.col("bin") == b.bin) & F.col("_in"), i + 1).otherwise(F.col("bin")).alias("bin"))
    return out


# -- cophylogeny ------------------------------------------------------------------------------------------------


def pcoa(d: np.ndarray) -> np.ndarray:
    n = len(d)
    j = np.eye(n) - 1 / n
    w, u = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    keep = w > 1e-9 * max(1.0, abs(w).max())
    return (u[:, keep] * np.sqrt(w[keep]))[:, ::-1]


def procrustes(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """(m2, squared residual of each row) of fitting y to x, both centred and of unit size."""
    k = max(x.shape[1], y.shape[1])
    x, y = (np.pad(a - a.mean(0), ((0, 0), (0, k - a.shape[1]))) for a in (x, y))
    x, y = x / (np.linalg.norm(x) or 1), y / (np.linalg.norm(y) or 1)
    u, s, vt = np.linalg.svd(x.T @ y)
    fitted = s.sum() * y @ (u @ vt).T
    return float(1 - s.sum() ** 2), ((x - fitted) ** 2).sum(1)


def paco(spark, host: tuple[list[str], np.ndarray], symbiont: tuple[list[str], np.ndarray], links: list[tuple[str, str]], n_perm: int = 999, seed: int = 0) -> dict:
    """Fit of symbionts to their hosts over the links: m2, lower-tail p over shuffled links, residual of each link."""
    (hn, hd), (sn, sd) = host, symbiont
    unknown = [h for h, _ in links if h not in hn] + [s for _, s in links if s not in sn]
    if unknown:
        raise TreeError(f"not taxa: {sorted(set(unknown))[:10]}")
    hx, sx = pcoa(hd), pcoa(sd)
    hi, si = [hn.index(h) for h, _ in links], [sn.index(s) for _, s in links]
    m2, residuals = procrustes(hx[hi], sx[si])

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                to = rng.permutation(len(sn))
                out.append(procrustes(hx[hi], sx[[to[s] for s in si]])[0])
            yield pd.DataFrame({"m2": out})

    extreme = spark.range(n_perm).mapInPandas(run, "m2 double").filter(F.col("m2") <= m2 + 1e-12).count() if n_perm else 0
    return {"m2": m2, "p": (extreme + 1) / (n_perm + 1), "residuals": [(h, s, float(r)) for (h, s), r in zip(links, residuals)]}


# -- ancestral states without a rate model ---------------------------------------------------------------------------


def check_trait_names(nodes: DataFrame, traits: DataFrame, name: str = "name") -> None:
    unknown = traits.select(F.col(name).alias("name")).distinct().join(nodes.filter("is_leaf").select("name"), "name", "left_anti").orderBy("name").limit(10).collect()
    if unknown:
        raise TreeError(f"not tips of the tree: {[r.name for r in unknown]}")


def ace_parsimony(root: Node, trait: dict[str, str]) -> tuple[list[dict], int]:
    """(node rows with state and the set of the first pass, changes): children fold from left to right; the second
    pass keeps the parent's state where it can, else the alphabetically first."""
    states, sets, changes = sorted({v for v in trait.values() if v is not None}), {}, 0
    for n in root.postorder():
        if n.is_leaf:
            v = trait.get(n.name)
            sets[id(n)] = {v} if v is not None else set(states)
            continue
        own = sets[id(n.children[0])]
        for c in n.children[1:]:
            both = own & sets[id(c)]
            changes += not both
            own = both or own | sets[id(c)]
        sets[id(n)] = own
    out, chosen = [], {}
    for i, n in enumerate(root.preorder()):
        above = chosen.get(id(n.parent)) if n.parent is not None else None
        chosen[id(n)] = above if above in sets[id(n)] else min(sets[id(n)])
        out.append({"node": i, "name": n.name, "state": chosen[id(n)], "options": "|".join(sorted(sets[id(n)]))})
    return out, changes


def ace_continuous(nodes: DataFrame, traits: DataFrame) -> DataFrame:
    """(tree_id, node_id, value): estimates weighted by the inverse of each child's variance, level by level upwards.

    The levels are joins and partial aggregates over the whole forest; a length of 0 counts 1.
    """
    x = nodes.select("tree_id", "node_id", "parent_id", "name", "is_leaf", "depth_edges", F.when(F.coalesce("length", F.lit(0.0)) == 0, 1.0).otherwise(F.col("length")).alias("len"))
    done = x.filter("is_leaf").join(traits.select("name", "value"), "name").select("tree_id", "node_id", "parent_id", "depth_edges", "len", F.col("value").cast("double").alias("value"), F.lit(0.0).alias("var"))
    deepest = x.agg(F.max("depth_edges")).first()[0] or 0
    out = done
    for level in range(deepest - 1, -1, -1):
        own = out.filter(F.col("depth_edges") == level + 1).withColumn("w", 1 / (F.col("var") + F.col("len")))
        made = own.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"), (1 / F.sum("w")).alias("var"))
        here = x.filter((F.col("depth_edges") == level) & ~F.col("is_leaf")).join(made, ["tree_id", "node_id"]).select("tree_id", "node_id", "parent_id", "depth_edges", "len", "value", "var")
        out = out.union(here)
    return out.select("tree_id", "node_id", "value")


def by_tree(nodes: DataFrame, run: Callable[[Node], list[dict]], schema: str) -> DataFrame:
    """Apply a kernel that returns rows to every tree; schema without tree_id."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(run(tree(pdf)), columns=columns)
        out.insert(0, "tree_id", pdf["tree_id"].iloc[0])
        return out

    return nodes.groupBy("tree_id").applyInPandas(go, f"tree_id string, {schema}")
