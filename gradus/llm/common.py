"""Shared pieces of the training-data operators: scratch tables, word splitting, integer
lookup tables for numpy tasks, and connected components as Spark jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.session import scratch_path, ship_package
from gradus.sources.scratch import written
from gradus.sources.tables import table

__all__ = ["IntTable", "components", "mix64", "rename_clashes", "save", "scratch_path", "ship_package", "table"]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    return written(df, name)


def rename_clashes(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the input's columns that carry the name of a result column (the result's meaning wins)."""
    return df.drop(*[c for c in df.columns if c in names])


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (uint64 in, uint64 out)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class IntTable:
    """Open-addressing index from distinct non-negative int64 keys to their positions, for
    whole-array lookups (two cache misses a key instead of a binary search)."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, dtype=np.int64)
        n = len(self.keys)
        self.bits = max(4, int(2 * n + 1).bit_length() + 1)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        todo, at = np.arange(n, dtype=np.int32), self._home(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of every key, -1 where absent."""
        at = self._home(keys)
        out = self.slots[at]
        if not len(self.keys):
            return out
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at[wrong]]
            out[wrong] = got
            wrong = wrong[(got >= 0) & (self.keys[got] != keys[wrong])]
        return out


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an undirected edge table: (node, component = smallest node).

    Every round each node hooks to its smallest neighbour, pointers are followed once, and the
    edges are contracted to the hooked ends; the edge table shrinks until it is empty. A hub only
    ever enters a map-side combined minimum and an equi-join whose many-row side can be split.
    Rounds are checkpointed. Nodes without an edge to another node aren't in the result."""
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a <> b")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    labels = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")).checkpoint()
    while not e.isEmpty():
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p")).checkpoint()
        up = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        hook = hook.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p")).checkpoint()
        ha, hb = hook.select(F.col("x").alias("a"), F.col("p").alias("pa")), hook.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        e = (e.join(ha, "a").join(hb, "b").where("pa <> pb")
             .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct().checkpoint())
        to = hook.select(F.col("x").alias("component"), F.col("p").alias("to"))
        labels = labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")).checkpoint()
    return labels
