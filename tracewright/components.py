"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, ship, shuffled

#: Rows of a round's table that go to one file and task; links that one task settles by itself.
ROWS_A_FILE = 200_000
LOCAL_LINKS = 200_000


def _cut(df: DataFrame, name: str, rows: int) -> DataFrame:
    """A table of at most `rows` rows in as many files as that needs: rounds shrink, and small ones shouldn't make many files."""
    return cut(df.coalesce(-(-rows // ROWS_A_FILE) or 1), name)


def _jumped(parents: DataFrame, rows: int) -> DataFrame:
    """parents (node, up): every node's root, by pointer doubling."""
    while True:
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parents = _cut(parents.join(shuffled(above), "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "parents", rows)
        if not parents.filter("moved").limit(1).count():
            return parents.select("node", "up")


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ends of links a-b, and the smallest end that each hangs together with."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y):
            np.minimum.at(new, root[end], low)  # roots hook to smaller roots
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    links = pd.concat([*batches, pd.DataFrame({"hi": np.empty(0, np.int64), "lo": np.empty(0, np.int64)})])
    node, up = smallest_reachable(links["hi"].to_numpy(np.int64), links["lo"].to_numpy(np.int64))
    yield pd.DataFrame({"node": node[node != up], "up": up[node != up]})


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of links, whose columns a and b are whole numbers.

    Each round every root hooks to the smallest root that a link leads to, chains of hooks are shortened by doubling, and links
    are moved to roots; links inside a group go. On paths, trees and random links rounds grow with the logarithm of the nodes.
    Once LOCAL_LINKS links or fewer are left, one task settles them, with the same result. Rounds are cut by tables in the shared
    folder. Null ends and self-links are left out.
    """
    ship(links.sparkSession)
    live = cut(links.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")).filter(f"{a} is not null and {b} is not null and hi <> lo").distinct(), "links")
    left = live.count()
    nodes = 2 * left
    ends = live.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    labels = _cut(ends.select("node", F.col("node").alias("component")), "labels", nodes)
    while left:
        settled = left <= LOCAL_LINKS
        if settled:
            roots = cut(live.coalesce(1).mapInPandas(_settled, "node long, up long"), "roots")
        else:
            roots = _jumped(_cut(live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")), "hooks", left), left)
        own = roots.select(F.col("node").alias("component"), F.col("up").alias("root"))
        labels = _cut(labels.join(shuffled(own), "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels", nodes)
        if settled:
            return labels
        hi, lo = roots.select(F.col("node").alias("hi"), F.col("up").alias("hi_up")), roots.select(F.col("node").alias("lo"), F.col("up").alias("lo_up"))
        moved = live.join(shuffled(hi), "hi", "left").join(shuffled(lo), "lo", "left").select(F.coalesce("hi_up", "hi").alias("x"), F.coalesce("lo_up", "lo").alias("y"))
        live = _cut(moved.filter("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "links", left)
        left = live.count()
    return labels
