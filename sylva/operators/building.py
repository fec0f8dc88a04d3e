"""Kernels that build trees: distances to trees, parsimony, progressive alignment, bootstrap.

Each runs on one matrix, alignment or tree in a task of its own; many of them (markers, replicates,
starts) are rows of a grouped map.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import drawn
from . import alignment as A
from .phylo import NODES, Node, TreeError, frame, tree
from .rooting import midpoint_root

# -- from distances ------------------------------------------------------------------------------


def neighbor_joining(names: list[str], d: np.ndarray, nonneg: bool = True) -> Node:
    """Neighbour joining; the last three lineages meet at the root.  Ties go to the first pair."""
    d, open_ = np.array(d, float), [Node(n) for n in names]
    if len(names) != len(set(names)) or d.shape != (len(names),) * 2:
        raise TreeError("names are unique and the matrix is square")
    while len(open_) > 3:
        n, r = len(open_), d.sum(1)
        q = (n - 2) * d - r[:, None] - r[None, :]
        q[np.diag_indices(n)] = np.inf
        i, j = np.unravel_index(int(q.argmin()), q.shape)
        i, j = min(i, j), max(i, j)
        a = d[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2))
        joined = Node()
        for k, length in ((i, a), (j, d[i, j] - a)):
            open_[k].length = float(max(length, 0)) if nonneg else float(length)
            joined.add(open_[k])
        to = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k != j]
        d[i], d[:, i] = to, to
        d[i, i] = 0
        d, open_[i] = d[np.ix_(keep, keep)], joined
        open_ = [open_[k] for k in keep]
    root = Node()
    if len(open_) == 3:
        ends = [(d[0, 1] + d[0, 2] - d[1, 2]) / 2, (d[0, 1] + d[1, 2] - d[0, 2]) / 2, (d[0, 2] + d[1, 2] - d[0, 1]) / 2]
    else:
        ends = [d[0, 1] / 2] * 2 if len(open_) == 2 else [0.0] * len(open_)
    for node, length in zip(open_, ends):
        node.length = float(max(length, 0)) if nonneg else float(length)
        root.add(node)
    return root


def upgma(names: list[str], d: np.ndarray, weighted: bool = True) -> Node:
    """Average linkage: by cluster sizes, or plain means of two clusters (weighted=False)."""
    d, open_ = np.array(d, float), [(Node(n), 0.0, 1) for n in names]
    while len(open_) > 1:
        off = d + np.diag([np.inf] * len(d))
        i, j = sorted(np.unravel_index(int(off.argmin()), d.shape))
        (a, ha, na), (b, hb, nb), h = open_[i], open_[j], d[i, j] / 2
        a.length, b.length, joined = float(max(h - ha, 0)), float(max(h - hb, 0)), Node()
        joined.add(a)
        joined.add(b)
        to = (na * d[i] + nb * d[j]) / (na + nb) if weighted else (d[i] + d[j]) / 2
        d[i], d[:, i] = to, to
        d[i, i] = 0
        keep = [k for k in range(len(d)) if k != j]
        d, open_[i] = d[np.ix_(keep, keep)], (joined, h, na + nb)
        open_ = [open_[k] for k in keep]
    return open_[0][0]


def constrained_nj(names: list[str], d: np.ndarray, groups: dict[str, str | None], nonneg: bool = True) -> Node:
    """Each labelled group of two tips or more forms a clade: joined within, then between by mean distances."""
    by: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        label = groups.get(n)
        by.setdefault(f"g|{label}" if label is not None else f"t|{n}", []).append(i)
    units = list(by.values())
    between = np.array([[d[np.ix_(a, b)].mean() if a is not b else 0.0 for b in units] for a in units])
    labels = [str(i) for i in range(len(units))]
    root = neighbor_joining(labels, between, nonneg) if len(units) > 1 else Node(labels[0])
    for leaf in root.leaves():
        own = units[int(leaf.name)]
        if len(own) == 1:
            leaf.name = names[own[0]]
            continue
        inner = neighbor_joining([names[i] for i in own], d[np.ix_(own, own)], nonneg)
        if len(own) > 2:
            inner = midpoint_root(inner)
        leaf.name, leaf.data["constrained"] = None, "true"
        spread = np.mean([sum(x.length or 0 for x in t.up() if x is not inner) for t in inner.leaves()])
        leaf.length = max((leaf.length or 0.0) - float(spread), 0.0)
        for c in list(inner.children):
            leaf.add(c)
    return root


def square(pairs: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """(names in order, matrix) of (x, y, d) rows; a pair that is absent is an error."""
    names = sorted(set(pairs["x"]) | set(pairs["y"]))
    at = {n: i for i, n in enumerate(names)}
    d = np.full((len(names),) * 2, np.nan)
    np.fill_diagonal(d, 0)
    i, j = pairs["x"].map(at).to_numpy(), pairs["y"].map(at).to_numpy()
    d[i, j] = d[j, i] = pairs["d"].to_numpy(float)
    if np.isnan(d).any():
        a, b = np.argwhere(np.isnan(d))[0]
        raise TreeError(f"no distance between {names[a]} and {names[b]}")
    return names, d


BUILDERS: dict[str, Callable[[list[str], np.ndarray], Node]] = {"nj": neighbor_joining, "upgma": upgma, "wpgma": lambda n, d: upgma(n, d, weighted=False)}


def trees_from_distances(distances: DataFrame, key: str = "aln_id", method: str = "nj", root: str = "none") -> DataFrame:
    """A tree for each key of (key, x, y, d), as a node table."""
    build = BUILDERS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = build(*square(pdf))
        return frame([(str(pdf[key].iloc[0]), midpoint_root(made) if root == "midpoint" and len(made.leaves()) > 1 else made)])

    return distances.select(key, "x", "y", "d").groupBy(key).applyInPandas(run, NODES)


# -- plain distances of strings, for kernels ---------------------------------------------------------


def string_distances(seqs: list[str], model: str = "raw", gaps: str = A.GAPS) -> np.ndarray:
    x = np.array([np.frombuffer(s.upper().encode(), np.uint8) for s in seqs])
    known = ~np.isin(x, np.frombuffer(gaps.encode(), np.uint8))
    purine, pyrimidine = np.isin(x, [65, 71]), np.isin(x, [67, 84, 85])
    n = len(seqs)
    d = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            both = known[i] & known[j]
            m = both.sum()
            if not m:
                d[i, j] = d[j, i] = 1.0
                continue
            differ = both & (x[i] != x[j])
            p = differ.sum() / m
            ts = (differ & ((purine[i] & purine[j]) | (pyrimidine[i] & pyrimidine[j]))).sum() / m
            if p == 0 or model == "raw":
                v = p
            elif model == "jc69":
                v = 3.0 if p >= 0.74 else -0.75 * np.log(1 - 4 * p / 3)
            elif model == "k2p":
                a, b = 1 - 2 * ts - (p - ts), 1 - 2 * (p - ts)
                v = -0.5 * np.log(a * np.sqrt(b)) if a > 0 and b > 0 else 3.0
            else:
                v = 5.0 if p >= 0.9999 else -np.log(1 - p)
            d[i, j] = d[j, i] = v
    return d


# -- splits, supports ----------------------------------------------------------------------------------


def split_sets(root: Node) -> dict[frozenset, Node]:
    """Non-trivial splits of a tree by the side without the first name."""
    names = sorted(root.names())
    out = {}
    below: dict[int, frozenset] = {}
    for n in root.postorder():
        below[id(n)] = frozenset([n.name]) if n.is_leaf else frozenset().union(*(below[id(c)] for c in n.children))
        if n is not root and n.children:
            side = below[id(n)] if names[0] not in below[id(n)] else frozenset(names) - below[id(n)]
            if 2 <= len(side) <= len(names) - 2:
                out[side] = n
    return out


def bootstrap_support(aln: DataFrame, n: int = 100, method: str = "nj", model: str = "jc69", seed: int = 0) -> DataFrame:
    """(aln_id, split_key, side, n_trees, support, support_percent) of the reference tree's splits over n resampled alignments.

    Replicates are rows, so they build their trees side by side; columns are drawn by hashes.
    """
    whole = aln.groupBy("aln_id").agg(F.sort_array(F.collect_list(F.struct("row_ord", "name", "seq"))).alias("rows"), F.max(F.length("seq")).alias("w"))
    reps = whole.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n))))
    cols = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: F.when(F.col("rep") == 0, i).otherwise(drawn(F.col("rep"), i, F.col("w"), seed)))
    reps = reps.withColumn("cols", cols).repartition("aln_id", "rep")
    build = BUILDERS[method]

    def run(batches):
        for pdf in batches:
            out = []
            for aln_id, rep, own, cols in zip(pdf["aln_id"], pdf["rep"], pdf["rows"], pdf["cols"]):
                names, seqs = [r["name"] for r in own], [np.frombuffer(r["seq"].encode(), np.uint8)[cols].tobytes().decode() for r in own]
                out += [(aln_id, rep, "|".join(sorted(s))) for s in split_sets(build(names, string_distances(seqs, model)))]
            yield pd.DataFrame(out, columns=["aln_id", "rep", "side"])

    found = reps.select("aln_id", "rep", "rows", "cols").mapInPandas(run, "aln_id string, rep int, side string")
    counted = found.groupBy("aln_id", "side").agg(F.max((F.col("rep") == 0).cast("int")).alias("own"), F.count_if(F.col("rep") > 0).alias("n_trees")).filter("own = 1")
    return counted.select("aln_id", F.md5(F.col("side").cast("binary")).alias("split_key"), "side", "n_trees", (F.col("n_trees") / n).alias("support"), F.round(100 * F.col("n_trees") / n, 1).alias("support_percent"))


# -- parsimony ------------------------------------------------------------------------------------------


def patterns(names: list[str], seqs: list[str], missing: str = "-.?N", fold: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(name -> bit masks by pattern, weights, pattern of each column); missing states have all bits."""
    texts = [s.upper().replace("U", "T") if fold else s for s in seqs]
    x = np.array([[ord(c) for c in t] for t in texts], np.int64)
    columns, back, weight = np.unique(x, axis=1, return_inverse=True, return_counts=True)
    gone = np.isin(columns, [ord(c) for c in missing])
    masks = np.zeros(columns.shape, np.uint64)
    for j in range(columns.shape[1]):
        states = sorted(set(columns[~gone[:, j], j].tolist()))
        if len(states) > 63:
            raise ValueError("a column has more than 63 states")
        bit = {s: np.uint64(1 << i) for i, s in enumerate(states)}
        full = np.uint64((1 << max(1, len(states))) - 1)
        masks[:, j] = [full if g else bit[s] for s, g in zip(columns[:, j].tolist(), gone[:, j])]
    return dict(zip(names, masks)), weight, np.asarray(back).reshape(-1)


def fitch(root: Node, masks: dict[str, np.ndarray], weight: np.ndarray) -> int:
    """Changes on a tree: children fold from left to right (intersection, else union and one change)."""
    held: dict[int, np.ndarray] = {}
    changes = 0
    for n in root.postorder():
        if n.is_leaf:
            held[id(n)] = masks[n.name]
            continue
        own = held.pop(id(n.children[0]))
        for c in n.children[1:]:
            other = held.pop(id(c))
            both = own & other
            empty = both == 0
            changes += int(weight[empty].sum())
            own = np.where(empty, own | other, both)
        held[id(n)] = own
    return changes


def sankoff(root: Node, states: dict[str, np.ndarray], cost: np.ndarray, root_state: int | None = 0) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(least cost of each pattern, cost table of each node by id): states are codes, -1 missing."""
    k, table = len(cost), {}
    for n in root.postorder():
        if n.is_leaf:
            s = states[n.name]
            own = np.where((s[:, None] < 0) | (s[:, None] == np.arange(k)), 0.0, np.inf)
        else:
            own = sum((cost[None, :, :] + table[id(c)][:, None, :]).min(2) for c in n.children)
        table[id(n)] = own
    top = table[id(root)]
    return (top.min(1) if root_state is None else top[:, root_state]), table


def camin_sokal_cost(k: int) -> np.ndarray:
    """From the ancestral state 0 to any other at cost 1; nothing else changes."""
    cost = np.full((k, k), np.inf)
    np.fill_diagonal(cost, 0)
    cost[0, 1:] = 1
    return cost


def gained(root: Node, states: dict[str, np.ndarray], cost: np.ndarray, root_state: int = 0) -> list[tuple[Node, int, int]]:
    """(node, site, state) where a site changes above a node, ties kept at the parent's state."""
    _, table = sankoff(root, states, cost, root_state)
    n_sites = len(next(iter(states.values())))
    chosen, out = {id(root): np.full(n_sites, root_state)}, []
    for n in root.preorder():
        for c in n.children:
            above = chosen[id(n)]
            options = cost[above] + table[id(c)]
            options[np.arange(n_sites), above] -= 1e-9
            chosen[id(c)] = options.argmin(1)
            out += [(c, int(s), int(chosen[id(c)][s])) for s in np.flatnonzero(chosen[id(c)] != above)]
    return out


def nni(root: Node, score: Callable[[Node], float], sweeps: int = 50) -> tuple[Node, float]:
    """Hill-climb over nearest-neighbour interchanges across inner edges."""
    best = score(root)
    for _ in range(sweeps):
        better = False
        for n in [x for x in root.preorder() if x.parent is not None and x.children and len(x.children) == 2 and len(x.parent.children) >= 2]:
            p = n.parent
            for i in (0, 1):
                others = [c for c in p.children if c is not n]
                a, b = n.children[i], others[0]
                ia, ib = n.children.index(a), p.children.index(b)
                n.children[ia], p.children[ib] = b, a
                a.parent, b.parent = p, n
                now = score(root)
                if now < best - 1e-9:
                    best, better = now, True
                else:
                    n.children[ia], p.children[ib] = a, b
                    a.parent, b.parent = n, p
        if not better:
            break
    return root, best


def parsimony_tree(names: list[str], seqs: list[str], start: Node | None = None, search: bool = True, sweeps: int = 50) -> tuple[Node, dict]:
    masks, weight, _ = patterns(names, seqs)
    root = start.copy() if start is not None else neighbor_joining(names, string_distances(seqs))
    if start is None and len(names) > 2:
        root = midpoint_root(root)
    root, score = nni(root, lambda t: fitch(t, masks, weight), sweeps) if search else (root, fitch(root, masks, weight))
    least = most = 0
    for column in zip(*seqs):
        known = [c for c in (x.upper() for x in column) if c not in "-.?N"]
        if known:
            least += len(set(known)) - 1
            most += len(known) - max(map(known.count, set(known)))
    return root, {"score": score, "ci": least / score if score else 1.0, "ri": (most - score) / (most - least) if most > least else 1.0}


def lineage_codes(seqs: list[str]) -> tuple[list[np.ndarray], int]:
    from ..sources.tables import SYMBOLS

    x = [np.array([SYMBOLS.index(c) if c in SYMBOLS else -1 for c in s]) for s in seqs]
    return x, max(2, 1 + max((int(v.max(initial=-1)) for v in x), default=1))


def lineage_tree(names: list[str], seqs: list[str], start: Node | None = None, search: bool = True, sweeps: int = 20) -> tuple[Node, dict]:
    """Irreversible parsimony from a distance tree; excess: origins beyond one for each derived state."""
    codes, k = lineage_codes(seqs)
    states, cost = dict(zip(names, codes)), camin_sokal_cost(k)
    root = start.copy() if start is not None else midpoint_root(neighbor_joining(names, string_distances(seqs)))
    score = lambda t: float(sankoff(t, states, cost)[0].sum())
    root, best = nni(root, score, sweeps) if search else (root, score(root))
    least = sum(len(set(c.tolist()) - {0, -1}) for c in np.array(codes).T)
    return root, {"score": best, "excess": best - least}


# -- progressive alignment ----------------------------------------------------------------------------------


def align(names: list[str], seqs: list[str], k: int = 3, match: float = 2.0, mismatch: float = -1.0, gap: float = -2.0, similar: tuple[str, ...] = ("AG", "CTU", "ILMV", "FWY", "DE", "KR", "ST", "NQ"), protein: bool = False) -> list[str]:
    """Progressive multiple alignment: k-mer guide tree, then profiles joined by Needleman-Wunsch.

    Substitutions score match, half of it within a group of similar residues of proteins, or mismatch.
    """
    bare = [s.upper().replace("-", "") for s in seqs]
    if len(names) < 2:
        return list(bare)
    grams = [pd.Series([s[i : i + k] for i in range(len(s) - k + 1)], dtype=object).value_counts() for s in bare]
    d = np.zeros((len(names),) * 2)
    for i in range(len(names)):
        for j in range(i):
            both = pd.concat([grams[i], grams[j]], axis=1).fillna(0).min(axis=1).sum() if len(grams[i]) and len(grams[j]) else 0
            d[i, j] = d[j, i] = 1 - both / max(1, min(grams[i].sum(), grams[j].sum()))
    letters = sorted(set("".join(bare)))
    at = {c: i for i, c in enumerate(letters)}
    group = {c: g for g in similar for c in g} if protein else {}
    score = np.array([[match if a == b else match / 2 if group.get(a) and group.get(a) == group.get(b) else mismatch for b in letters] for a in letters])

    def profile(rows: list[str]) -> np.ndarray:
        out = np.zeros((len(rows[0]), len(letters)))
        for r in rows:
            for i, c in enumerate(r):
                if c != "-":
                    out[i, at[c]] += 1 / len(rows)
        return out

    def joined(a: dict, b: dict) -> dict:
        pa, pb = profile(list(a.values())), profile(list(b.values()))
        s, (n, m) = pa @ score @ pb.T, (len(pa), len(pb))
        table = np.zeros((n + 1, m + 1))
        table[:, 0], table[0] = gap * np.arange(n + 1), gap * np.arange(m + 1)
        steps = gap * np.arange(m + 1)
        for i in range(1, n + 1):  # a row at a time: gaps along the row are a running maximum
            here = np.maximum(table[i - 1, 1:] + gap, table[i - 1, :-1] + s[i - 1])
            table[i] = np.maximum.accumulate(np.concatenate(([table[i, 0]], here)) - steps) + steps
        i, j, ca, cb = n, m, [], []
        while i or j:
            if i and j and abs(table[i, j] - table[i - 1, j - 1] - s[i - 1, j - 1]) < 1e-9:
                i, j = i - 1, j - 1
                ca.append(i)
                cb.append(j)
            elif i and abs(table[i, j] - table[i - 1, j] - gap) < 1e-9:
                i -= 1
                ca.append(i)
                cb.append(-1)
            else:
                j -= 1
                ca.append(-1)
                cb.append(j)
        put = lambda r, c: "".join(r[x] if x >= 0 else "-" for x in reversed(c))
        return {x: put(r, ca) for x, r in a.items()} | {x: put(r, cb) for x, r in b.items()}

    done: dict[int, dict] = {}
    rows = {n: s or "-" for n, s in zip(names, bare)}
    for node in upgma(names, d).postorder():
        done[id(node)] = {node.name: rows[node.name]} if node.is_leaf else joined(done.pop(id(node.children[0])), done.pop(id(node.children[1])))
        out = done[id(node)]
    return [out[n] for n in names]


def per_alignment(aln: DataFrame, run: Callable[[str, list[str], list[str]], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a kernel to (aln_id, names, sequences) of every alignment, a task each."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_ord")
        return run(pdf["aln_id"].iloc[0], pdf["name"].tolist(), pdf["seq"].tolist())

    return aln.select("aln_id", "row_ord", "name", "seq").groupBy("aln_id").applyInPandas(go, schema)


def align_all(records: DataFrame, **options) -> DataFrame:
    return per_alignment(records, lambda i, n, s: pd.DataFrame({"aln_id": i, "row_ord": range(len(n)), "name": n, "seq": align(n, s, **options)}), "aln_id string, row_ord int, name string, seq string")


def parsimony_trees(aln: DataFrame, search: bool = True) -> DataFrame:
    """Node tables of parsimony trees; the root's data hold score, ci and ri."""

    def run(i, names, seqs):
        root, said = parsimony_tree(names, seqs, search=search)
        root.data |= {k: str(v) for k, v in said.items()}
        return frame([(i, root)])

    return per_alignment(aln, run, NODES)


def lineage_trees(aln: DataFrame, search: bool = True) -> DataFrame:
    def run(i, names, seqs):
        root, said = lineage_tree(names, seqs, search=search)
        root.data |= {k: str(v) for k, v in said.items()}
        return frame([(i, root)])

    return per_alignment(aln, run, NODES)


def parsimony_scores(nodes: DataFrame, aln: DataFrame, cost: np.ndarray | None = None, irreversible: bool = False, root_state: int | None = 0) -> DataFrame:
    """(tree_id, score) of every tree on the one alignment that bears its id: Fitch, or Sankoff with a cost table."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"tree_id": [], "score": []})
        root, right = tree(left), right.sort_values("row_ord")
        names, seqs = right["name"].tolist(), right["seq"].tolist()
        if cost is None and not irreversible:
            score = float(fitch(root, *patterns(names, seqs)[:2]))
        else:
            codes, k = lineage_codes(seqs)
            score = float(sankoff(root, dict(zip(names, codes)), cost if cost is not None else camin_sokal_cost(k), root_state)[0].sum())
        return pd.DataFrame({"tree_id": [left["tree_id"].iloc[0]], "score": [score]})

    return nodes.groupBy("tree_id").cogroup(aln.withColumnRenamed("aln_id", "tree_id").groupBy("tree_id")).applyInPandas(run, "tree_id string, score double")


def ancestral_mutations(nodes: DataFrame, aln: DataFrame) -> DataFrame:
    """(tree_id, node_id, name, site, state): where irreversible characters arise, for the alignment that bears a tree's id."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["tree_id", "node_id", "name", "site", "state"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        root, right = tree(left), right.sort_values("row_ord")
        codes, k = lineage_codes(right["seq"].tolist())
        number = {id(n): i for i, n in enumerate(root.preorder())}
        found = gained(root, dict(zip(right["name"], codes)), camin_sokal_cost(k))
        return pd.DataFrame([(left["tree_id"].iloc[0], number[id(n)], n.name, site, state) for n, site, state in found], columns=columns)

    return nodes.groupBy("tree_id").cogroup(aln.withColumnRenamed("aln_id", "tree_id").groupBy("tree_id")).applyInPandas(run, "tree_id string, node_id int, name string, site int, state int")


def constraint_tree(groups: dict[str, str | None]) -> Node:
    """A root polytomy with one polytomy for each label of two tips or more; unlabelled tips hang from the root."""
    by: dict[str, list[str]] = {}
    for n in sorted(groups):
        by.setdefault(f"g|{groups[n]}" if groups[n] is not None else f"t|{n}", []).append(n)
    root = Node()
    for own in by.values():
        at = root if len(own) == 1 else root.add(Node())
        for n in own:
            at.add(Node(n))
    return root


def gene_trees(markers: DataFrame, min_taxa: int = 4, method: str = "nj", model: str = "jc69") -> tuple[DataFrame, DataFrame]:
    """(node table of a tree a marker, (marker, reason) of those skipped)."""
    aln = markers.select(F.col("marker").alias("aln_id"), F.row_number().over(_by_marker()).alias("row_ord"), "name", "seq")
    size = aln.groupBy("aln_id").agg(F.count("*").alias("n"), F.count_distinct(F.length("seq")).alias("w"))
    good = size.filter((F.col("n") >= min_taxa) & (F.col("w") == 1)).select("aln_id")
    skipped = size.filter((F.col("n") < min_taxa) | (F.col("w") != 1)).select(F.col("aln_id").alias("marker"), F.when(F.col("n") < min_taxa, F.concat(F.lit("fewer taxa than "), F.lit(str(min_taxa)))).otherwise("rows differ in length").alias("reason"))
    return trees_from_distances(A.distance_matrix(aln.join(good, "aln_id", "left_semi"), model), method=method), skipped


def _by_marker():
    from pyspark.sql.window import Window

    return Window.partitionBy("marker").orderBy("name")


def clade_support(root: Node, supports: dict[frozenset, float]) -> Node:
    for side, node in split_sets(root).items():
        node.support = supports.get(side, 0.0)
    return root
