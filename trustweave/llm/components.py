"""Connected components of an edge table that never leaves the executors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut


def _forest(parts):
    """Union-find over the edges of one task: each node with its smallest known relative."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    for part in parts:
        for u, v in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            up.setdefault(a, a)
            up.setdefault(b, b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > 1_000_000:
            yield _stars(up, find)
            up.clear()
    yield _stars(up, find)


def _stars(up, find) -> pd.DataFrame:
    found = [(x, find(x)) for x in list(up)]
    return pd.DataFrame([p for p in found if p[0] != p[1]], columns=["u", "v"]).astype("int64")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``edges`` (u, v: long); component is the smallest node reachable.

    Each task first shrinks its own edges to a forest by union-find; then large-star and small-star
    steps repeat until every edge points at its root. State is the edge table alone, rewritten each
    round in the shared folder. An empty table gives an empty result.
    """
    forest = edges.select("u", "v").where("u <> v").distinct().mapInPandas(_forest, "u long, v long")
    at = cut(forest.distinct())
    while True:
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_in = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = small_in.groupBy("u").agg(F.min("v").alias("m"))
        small = small_in.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        new = cut(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        again = new.alias("a").join(new.alias("b"), F.col("a.v") == F.col("b.u"), "left_semi").limit(1).count()
        twice = new.groupBy("u").count().where("count > 1").limit(1).count() if not again else 1
        at = new
        if not again and not twice:
            break
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select(F.col("v"), F.col("v"))).distinct()
