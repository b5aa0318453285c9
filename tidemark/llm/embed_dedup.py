"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative a group.

Equal vectors form a class and are compared once. Vectors of different lengths have no cosine, so each length has
cells of its own. Centroids are fitted on a bounded sample (``SAMPLE`` classes of a length in hash order, eight
for each cell at least); every class is then assigned to its nearest cell, its home. A pair that the
border of two cells separates is met as well: with t the similarity, a vector also visits each
later cell that can hold a vector at t or more. Two exact bounds say which cannot: a vector farther than
sqrt(1 - t^2) from the border with its home has no such partner beyond it, and neither has one whose
angle to the other centroid exceeds acos(t) plus the largest angle of that cell's own vectors. Nothing is
lost, whatever the vectors (``tests/llm/test_models.py`` compares with brute force); how many visits remain
depends on them. For directions without structure almost every cell is visited, and the comparisons grow with the
square of the vectors.

Cells are dealt out by pairs of blocks of members, so a cell that a third of all vectors share is many
tasks. A task returns link counts and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, linked_groups
from .workspace import Workspace

SAMPLE, CELL, ROUNDS, ROOM = 20_000, 4096, 12, 1e-6
_LEFT, _RIGHT, _STEP, _DRAWN = 4096, 8192, 512, 8


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow or underflow."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(vectors: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of ``cells`` cells; an empty cell takes the vector that fits worst."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), cells, replace=False)]
    for _ in range(ROUNDS):
        near = vectors @ centroids.T
        home, fit = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, vectors)
        length = np.linalg.norm(sums, axis=1)
        for c in np.flatnonzero(length < 1e-9):
            worst = fit.argmin()
            sums[c], length[c], fit[worst] = vectors[worst], 1.0, 1.0
        centroids = sums / length[:, None]
    return centroids


class Cells(NamedTuple):
    """The cells of vectors of one length: the number of the first, and unit centroids (none if there is one cell)."""

    first: int
    centroids: np.ndarray | None

    def home(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines with the centroids, and the nearest cell."""
        near = unit(vectors) @ self.centroids.T if self.centroids is not None else np.ones((len(vectors), 1))
        return near, near.argmax(axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a finite, non-zero vector."""
    good = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    return good.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0))


def fit_cells(classes: DataFrame, sample: int, cell: int) -> dict[int, Cells]:
    """Cells for each length of vector, with about ``cell`` classes each as far as the sample allows."""
    first, fitted = 0, {}
    for size, n in sorted(map(tuple, classes.groupBy(F.size("embedding").alias("size")).count().collect())):
        cells, centroids = -(-n // cell), None
        if cells > 1:
            drawn = classes.where(F.size("embedding") == size)
            if n > 4 * sample:  # about twice the sample goes on to the sort
                drawn = drawn.where(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 30)) < (2 * sample << 30) // n)
            drawn = drawn.orderBy(F.xxhash64("rep")).limit(sample).select("embedding").toPandas()["embedding"]
            cells = min(cells, max(1, len(drawn) // _DRAWN))
            centroids = spherical_kmeans(unit(np.stack(drawn.to_numpy())), cells) if cells > 1 else None
        fitted[size] = Cells(first, centroids)
        first += cells
    return fitted


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Rows of one vector length at a time: the length, the vectors (column ``embedding``) as a matrix, and the rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            step = batch.slice(at, _STEP)
            sizes = step.column("embedding").value_lengths().to_numpy()
            for size in np.unique(sizes):
                rows = step.take(pa.array(np.flatnonzero(sizes == size)))
                yield int(size), rows.column("embedding").flatten().to_numpy().reshape(rows.num_rows, size), rows


def radii(classes: DataFrame, fitted: dict[int, Cells]) -> dict[int, float]:
    """The largest angle between a cell's centroid and a class that is at home there; empty cells are left out."""
    shared = classes.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, float] = {}
        for size, vectors, _ in by_length(batches):
            cells = shared.value[size]
            if cells.centroids is not None:
                near, home = cells.home(vectors)
                for cell in np.unique(home):
                    number = cells.first + int(cell)
                    least[number] = min(least.get(number, 1.0), float(near[home == cell, cell].min()))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.float64())], ["cell", "least"])

    found = classes.select("embedding").mapInArrow(run, "cell int, least double").groupBy("cell").agg(F.min("least").alias("least")).collect()
    return {r["cell"]: float(np.arccos(np.clip(r["least"], -1, 1))) for r in found}


def assign(classes: DataFrame, fitted: dict[int, Cells], similarity: float) -> DataFrame:
    """Each class (rep, n, embedding) in its home cell and, as a visitor, in later cells where a partner can be."""
    side = np.sqrt(1 - similarity**2) + ROOM
    radius = radii(classes, fitted) if any(c.centroids is not None for c in fitted.values()) else {}
    reaches = {}
    for size, cells in fitted.items():
        if cells.centroids is not None:
            angle = np.array([radius.get(cells.first + k, -np.inf) for k in range(len(cells.centroids))])
            reach = np.cos(np.clip(np.arccos(similarity) + angle + ROOM, 0, np.pi)) - ROOM
            reaches[size] = np.where(np.isfinite(angle), reach, np.inf)  # an empty cell is out of reach
    shared = classes.sparkSession.sparkContext.broadcast((fitted, reaches))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, reaches = shared.value
        for size, vectors, rows in by_length(batches):
            cells = fitted[size]
            near, home = cells.home(vectors)
            every = np.arange(len(home))
            visits = np.zeros(near.shape, bool)
            if cells.centroids is not None:
                gap = near[every, home][:, None] - near
                spread = np.sqrt(np.maximum(2 - 2 * cells.centroids[home] @ cells.centroids.T, 0)) + ROOM  # distance of centroids
                visits = (gap <= side * spread) & (near >= reaches[size]) & (np.arange(near.shape[1]) > home[:, None])
            visits[every, home] = True
            row, cell = np.nonzero(visits)
            taken = rows.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array((cells.first + cell).astype(np.int32)), pa.array(home[row] == cell), *taken.columns], ["cell", "home", "rep", "n", "embedding"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("rep", "n", "embedding").mapInArrow(run, f"cell int, home boolean, rep long, n long, embedding {kind}")


def compare_blocks(placed: DataFrame, similarity: float) -> DataFrame:
    """Links within cells: rows (rep, other, links), a link count without other or a forest edge without links.

    Members that are at home (the left side) are compared with all members (the right side). Each side of a
    cell is dealt into blocks, and a task compares one left block with one right block.
    """
    sizes = placed.groupBy("cell").agg(F.ceil(F.count_if("home") / _LEFT).cast("int").alias("lefts"), F.ceil(F.count("*") / _RIGHT).cast("int").alias("rights"))
    # a row a cell, whose number the driver holds already; a shuffle by cell alone would keep all blocks of a cell together
    dealt = placed.join(F.broadcast(sizes), "cell").withColumns({"one": F.pmod(F.xxhash64("rep"), "lefts").cast("int"), "two": F.pmod(F.xxhash64("rep", F.lit(1)), "rights").cast("int")})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = F.when(F.col("home"), F.transform(every("rights"), lambda k: F.struct(F.lit(True).alias("left"), F.col("one"), k.alias("two"))))
    right = F.transform(every("lefts"), lambda k: F.struct(F.lit(False).alias("left"), k.alias("one"), F.col("two")))
    sides = F.explode(F.concat(F.coalesce(left, F.slice(right, 1, 0)), right))
    dealt = dealt.select("cell", sides.alias("s"), "home", "rep", "n", "embedding").select("cell", "s.*", "home", "rep", "n", "embedding")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["left"]], group[~group["left"]]
        none = pd.DataFrame({"rep": [], "other": pd.array([], "Int64"), "links": []}).astype({"rep": "int64", "links": "int64"})
        if not len(a) or not len(b):
            return none
        x, y = (unit(np.stack(g["embedding"].to_numpy())) for g in (a, b))
        ids, others, n, m = a["rep"].to_numpy(), b["rep"].to_numpy(), a["n"].to_numpy(), b["n"].to_numpy()
        linked = np.zeros((len(a), len(b)), bool)
        for at in range(0, len(a), _STEP):
            linked[at : at + _STEP] = x[at : at + _STEP] @ y.T >= similarity
        place = {r: k for k, r in enumerate(others.tolist())}
        for k, r in enumerate(ids.tolist()):
            if r in place:
                linked[k, place[r]] = False
        rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if not len(rows):
            return none
        linked = linked[np.ix_(rows, columns)]
        ids, others, n, m, visitor = ids[rows], others[columns], n[rows], m[columns], ~b["home"].to_numpy()[columns]
        nodes = np.unique(np.concatenate([ids, others]))
        square = np.zeros((len(nodes), len(nodes)), bool)
        square[np.ix_(np.searchsorted(nodes, ids), np.searchsorted(nodes, others))] = linked
        square |= square.T
        edges = [(nodes[g[0]], r) for g in linked_groups(square) for r in nodes[g[1:]]]
        src, dst = np.array(edges, np.int64).reshape(-1, 2).T
        counted = np.concatenate([ids, others[visitor]])
        links = np.concatenate([[m[row].sum() for row in linked], [n[row].sum() for row in linked.T[visitor]]]).astype(np.int64)
        return pd.DataFrame({
            "rep": np.concatenate([counted, src]),
            "other": pd.array([None] * len(counted) + dst.tolist(), dtype="Int64"),
            "links": np.concatenate([links, np.zeros(len(src), np.int64)]),
        })

    return dealt.groupBy("cell", "one", "two").applyInPandas(compare, "rep long, other long, links long")


def near_vectors(vectors: DataFrame, similarity: float = 0.9, sample: int = SAMPLE, cell: int | None = None) -> DataFrame:
    """Links and groups of ``vectors`` (vec_id, embedding) with a cosine of ``similarity`` or more.

    Returns a row per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id
    reachable), kept (vec_id = component_id). Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different lengths do not link. Rows without a vec_id link with nothing, have no
    component and are kept. Rows that repeat are linked; rows with the same vec_id are one node. An empty table gives no rows.

    sample: classes of a length that the centroids are fitted on; a larger corpus wants a larger one, since there are
    no more cells than an eighth of it. cell: classes to a cell.
    """
    ws = Workspace(vectors.sparkSession, "vectors")
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding")
    classes = ws.save(usable(vectors).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    placed = ws.save(assign(classes, fit_cells(classes, sample, cell or CELL), similarity))
    found = ws.save(compare_blocks(placed, similarity))
    groups = connected_components(found.where("other IS NOT NULL").select(F.col("rep").alias("src"), F.col("other").alias("dst")), ws)
    links = found.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = ws.save(named.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    can_link = "vec_id IS NOT NULL AND embedding IS NOT NULL"
    linked = vectors.where(can_link).join(named, "embedding", "left").select("vec_id", "n_links", "component_id")
    alone = vectors.where(f"NOT ({can_link})").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = linked.union(alone).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
