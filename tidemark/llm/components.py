"""Distributed connected components by repeated local contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

_ROWS = 512
#: So many edges at most are merged in one task, which ends the rounds.
FEW = 10_000


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Component of every node of ``edges`` (src, dst): columns node, component (its smallest node).

    Each round draws a random order of the nodes, merges every node into the first of itself and
    its neighbours, and keeps the edges between different groups, so a chain or star of any
    length shrinks by a constant factor. Aggregates are combined before the shuffle and the
    joins have a unique side, so a hub is neither collected nor multiplied. ``FEW`` edges that are left
    are merged in one task, since a round costs many stages however small it is. Nodes may be of
    any type that can be ordered; self-loops give a component of one, rows with a null
    end are ignored, and no edges give no rows.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    left = ws.save(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    rounds: list[DataFrame] = []
    while edges_left := left.count():
        if edges_left <= FEW:
            rounds.append(ws.save(merged_at_once(left)))
            break
        order = F.lit(len(rounds))
        both = left.select("src", "dst").union(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        ranked = both.select("src", F.struct(F.xxhash64("dst", order).alias("rank"), F.col("dst").alias("id")).alias("near"))
        merged = ranked.groupBy("src").agg(F.min("near").alias("near"))
        own = F.struct(F.xxhash64("src", order).alias("rank"), F.col("src").alias("id"))
        parents = ws.save(merged.select(F.col("src").alias("node"), F.least("near", own)["id"].alias("parent")))
        rounds.append(parents)
        a, b = parents.select(F.col("node").alias("src"), F.col("parent").alias("a")), parents.select(F.col("node").alias("dst"), F.col("parent").alias("b"))
        moved = left.join(a, "src").join(b, "dst").where("a <> b")
        before, left = left, ws.save(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        ws.drop(before)
    if not rounds:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    found = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        found = found.join(step, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"))
    found = ws.save(found)
    return found.join(found.groupBy("parent").agg(F.min("node").alias("component")), "parent").select("node", "component")


def merged_at_once(edges: DataFrame) -> DataFrame:
    """A node of its component for every node of a few edges (src, dst): node, parent. One task reads them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(node):
            while parent.setdefault(node, node) != node:
                parent[node] = node = parent[parent[node]]
            return node

        types = None
        for batch in batches:
            types = batch.schema.field(0).type
            for src, dst in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent[root(src)] = root(dst)
        if parent:
            yield pa.RecordBatch.from_arrays([pa.array(parent, types), pa.array(map(root, list(parent)), types)], ["node", "parent"])

    kind = edges.schema["src"].dataType.simpleString()
    return edges.select("src", "dst").coalesce(1).mapInArrow(run, f"node {kind}, parent {kind}")


def linked_groups(linked: np.ndarray) -> Iterator[np.ndarray]:
    """Components of two nodes or more of a symmetric link matrix."""
    left = linked.any(axis=1)
    while left.any():
        start = left.argmax()
        seen = np.zeros(len(linked), bool)
        seen[start] = True
        edge = np.array([start])
        while len(edge):
            found = np.zeros(len(linked), bool)
            for k in range(0, len(edge), _ROWS):
                found |= linked[edge[k : k + _ROWS]].any(axis=0)
            found &= ~seen
            seen |= found
            edge = np.flatnonzero(found)
        left &= ~seen
        yield np.flatnonzero(seen)
