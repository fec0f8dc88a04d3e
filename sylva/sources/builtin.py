"""Built-in example trees."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..operators.phylo import Node, forest
from .newick import parse_newick

# The example tree and its metadata.
PRIMATES = "(((((Human:0.06,Chimp:0.06)95:0.04,Gorilla:0.10)90:0.04,Orangutan:0.16)98:0.06,Gibbon:0.20)100:0.10,(Macaque:0.20,Baboon:0.18)85:0.12);"


HABITATS = [("Human", "urban", 62), ("Chimp", "forest", 45), ("Gorilla", "forest", 160), ("Orangutan", "forest", 75), ("Gibbon", "forest", 8), ("Macaque", "savanna", 11), ("Baboon", "savanna", 25)]


def primates_metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HABITATS, "name string, habitat string, body_mass_kg int")


def primates(spark: SparkSession) -> DataFrame:
    return forest(spark, {"primates": parse_newick(PRIMATES)})


def random_tree(n: int = 60, seed: int = 0) -> Node:
    """A random binary tree: lineages joined in an order drawn from hashes of the seed."""
    draw = lambda *x: int.from_bytes(hashlib.md5("|".join(map(str, (seed, *x))).encode()).digest()[:6], "big")
    open_ = [Node(f"t{i + 1}", 0.05 + draw("tip", i) % 1000 / 1000) for i in range(n)]
    step = 0
    while len(open_) > 1:
        a = open_.pop(draw("a", step) % len(open_))
        b = open_.pop(draw("b", step) % len(open_))
        join = Node(length=0.05 + draw("edge", step) % 1000 / 1000)
        join.add(a)
        join.add(b)
        open_.append(join)
        step += 1
    open_[0].length = None
    return open_[0]
