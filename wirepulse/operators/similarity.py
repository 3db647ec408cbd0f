"""Exact cosine-similarity join of unit vectors, without one row per pair.

Vectors lie in blocks around pivots: each in the block of its nearest pivot, large ones cut by hash. By
the triangle inequality on angles, a vector can be similar to a vector of a block only if its angle to
the block's pivot is at most the block's radius and the angle of the threshold together. Only then it
visits the block, so on clustered data most pairs of blocks are never compared. Each pair of blocks
that is compared is one cell, where the similarities come from a matrix product.

What leaves a cell is linear in its vectors: either per-vector summaries or the links of a spanning
forest. All pairs of a group of near-copies are therefore never written.

The number of blocks follows the number of vectors, so a cell fits an executor and the cells
spread over the cluster: n = 10 million vectors give about 150 blocks and at most 12,000 cells. Vectors
without any structure visit every block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.session import fresh_path

MIN_BLOCK = 4096
MAX_BLOCK = 65_536
TARGET_BLOCKS = 128
MAX_PIVOTS = 1024
# Added to angles for the rounding of the arithmetic; far below what a decision depends on.
SLACK = 1e-6
# Elements of one similarity chunk (16 MB of doubles); a few of them are held at a time.
CHUNK_ELEMENTS = 1 << 21
# Vectors whose angles to all pivots are held at a time.
ANGLE_ROWS = 512
# Most vectors of the hub, and about as many visitors as a cell of the second round of links has.
HUB = 2048
VISITORS = 8192
_FOREST = "src bigint, dst bigint, own boolean, main boolean"
# Similarities are compared after rounding, so sums in another order give the same pairs.
DIGITS = 9


def block_count(n: int, min_block: int = MIN_BLOCK, max_block: int = MAX_BLOCK) -> int:
    """Blocks for ``n`` vectors: about ``TARGET_BLOCKS`` of them within the size limits."""
    size = min(max(math.ceil(n / TARGET_BLOCKS), min_block), max_block)
    return max(1, math.ceil(n / size))


def _check(threshold: float) -> None:
    if not 0.0 < threshold < 1.0:
        raise ValueError("threshold must be in (0, 1)")


@dataclass(frozen=True)
class Blocks:
    """Pivots and what lies around them: the radius of each (an angle, slack included), and the number
    of blocks that its vectors are cut into. Blocks are numbered pivot by pivot. Angles bound products
    of ``unit`` vectors only; of others nothing is skipped."""

    pivots: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    unit: bool = True

    @property
    def count(self) -> int:
        return int(self.parts.sum())

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.parts) - self.parts

    def visits(self, angles: np.ndarray, reach: float | np.ndarray) -> np.ndarray:
        """(vectors, pivots): whether a vector with these angles to the pivots has to look there for
        others within ``reach``."""
        if not self.unit:
            return np.broadcast_to(np.isfinite(self.radius), angles.shape).copy()
        return angles <= self.radius + np.reshape(reach, (-1, 1))


def _directions(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1, norm)


def angles_to(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(vectors, pivots); a zero vector is at a right angle to everything."""
    return np.arccos(np.clip(_directions(matrix) @ _directions(pivots).T, -1.0, 1.0))


def choose_pivots(vectors: DataFrame, blocks: int, key: str = "id", vector: str = "vector") -> np.ndarray:
    """As many of the vectors as there are blocks (at most ``MAX_PIVOTS``), chosen by hash; which ones
    they are has no influence on the result."""
    chosen = (
        vectors.orderBy(F.xxhash64(key)).limit(min(blocks, MAX_PIVOTS)).select(F.col(vector).cast("array<double>").alias("v"))
    )
    return np.unique(np.array([r.v for r in chosen.collect()], float), axis=0)


def lay_out(vectors: DataFrame, blocks: int, key: str = "id", vector: str = "vector") -> tuple[DataFrame, Blocks]:
    """(the vectors with their ``block``, stored; the blocks). The driver gets the pivots and one row for
    each: its number of vectors and its radius. There must be a vector. Zero vectors lie around a pivot
    of their own, at a right angle to everything."""
    spark = vectors.sparkSession
    pivots = choose_pivots(vectors, blocks, key, vector)
    pivots = np.concatenate([pivots[pivots.any(axis=1)], np.zeros((1, pivots.shape[1]))])
    kind = vectors.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            matrix = to_matrix(pa.chunked_array([rows.column(1)]))
            angle = angles_to(matrix, pivots)
            angle[:, -1] = np.where(matrix.any(axis=1), np.inf, 0.0)
            angle[:, :-1][angle[:, -1] == 0] = np.inf
            nearest = angle.argmin(axis=1)
            own = angle[np.arange(len(matrix)), nearest]
            off = np.abs(np.linalg.norm(matrix, axis=1) - 1) * matrix.any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(nearest, pa.int32()), pa.array(own), pa.array(off)],
                [key, vector, "pivot", "angle", "off"],
            )

    dense = vectors.select(key, F.col(vector).cast("array<double>").alias(vector))
    placed = dense.mapInArrow(place, f"`{key}` {kind}, `{vector}` array<double>, pivot int, angle double, off double")
    path = fresh_path(spark, "placed-vectors")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    sums = F.count("*").alias("n"), F.max("angle").alias("r"), F.max("off").alias("off")
    found = placed.groupBy("pivot").agg(*sums).collect()
    sizes, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for row in found:
        sizes[row["pivot"]], radius[row["pivot"]] = row["n"], row["r"]
    most = max(1, math.ceil(sizes.sum() / blocks)) * 2
    unit = max((row["off"] for row in found), default=0.0) < 1e-9
    layout = Blocks(pivots, np.where(sizes > 0, radius + SLACK, -np.inf), np.maximum(-(-sizes // most), 1), unit)
    first, parts = (F.array(*map(F.lit, x.tolist())) for x in (layout.first, layout.parts))
    block = F.get(first, F.col("pivot")) + F.pmod(F.xxhash64(key), F.get(parts, F.col("pivot")))
    return placed.withColumn("block", block.cast("int")).drop("angle", "off"), layout


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, at most ``ANGLE_ROWS`` at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ANGLE_ROWS):
            yield batch.slice(start, ANGLE_ROWS)


def block_lists(spread: np.ndarray) -> pa.ListArray:
    """The numbers of the true columns of each row."""
    ends = np.concatenate([[0], np.cumsum(spread.sum(axis=1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(spread)[1], pa.int32()))


def blocks_to_visit(placed: DataFrame, layout: Blocks, reach: float, behind: bool = False) -> DataFrame:
    """(block, id, vector, _to): each vector with the list of the other blocks that it has to visit, or of
    those behind its own."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = np.repeat(np.arange(len(layout.parts)), layout.parts)
        for rows in slices(batches):
            where = layout.visits(angles_to(to_matrix(pa.chunked_array([rows.column("vector")])), layout.pivots), reach)
            own, others = rows.column("block").to_numpy()[:, None], np.arange(layout.count)
            spread = where[:, owner] & (others > own if behind else others != own)
            yield pa.RecordBatch.from_arrays([*rows.columns, block_lists(spread)], ["block", "id", "vector", "_to"])

    kind = placed.schema["id"].dataType.simpleString()
    return placed.select("block", "id", "vector").mapInArrow(visits, f"block int, id {kind}, vector array<double>, _to array<int>")


def visited_blocks(placed: DataFrame, layout: Blocks, reach: float) -> DataFrame:
    """(block, _to, id, vector): each vector with the blocks behind its own that it has to visit."""
    found = blocks_to_visit(placed, layout, reach, behind=True)
    return found.select("block", F.explode("_to").alias("_to"), "id", "vector")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def to_cells(vectors: DataFrame, threshold: float, blocks: int) -> tuple[DataFrame, int]:
    """((cell, block, id, vector), number of blocks): each vector in the cell of its block, and in one for
    each pair of blocks that may hold similar vectors and involves it. Zero vectors, which are similar to
    nothing, are left out."""
    vectors = vectors.filter(F.exists("vector", lambda x: x != 0))
    if blocks == 1 or vectors.isEmpty():
        one = vectors.select(F.lit(0).cast("bigint").alias("cell"), F.lit(0).alias("block"), "id", "vector")
        return one, 1
    placed, layout = lay_out(vectors, blocks)
    reach = math.acos(threshold - SLACK) + SLACK
    n = layout.count
    path = fresh_path(vectors.sparkSession, "visits")
    visited_blocks(placed, layout, reach).write.parquet(path)
    visitors = vectors.sparkSession.read.parquet(path)
    met = visitors.select("block", "_to").distinct().select(F.col("block").alias("_from"), F.col("_to").alias("block"))
    cell = lambda low, high: (F.col(low).cast("bigint") * n + F.col(high)).alias("cell")
    own = placed.select(cell("block", "block"), "block", "id", "vector")
    visited = placed.join(met, "block").select(cell("_from", "block"), "block", "id", "vector")
    visiting = visitors.select(cell("block", "_to"), "block", "id", "vector")
    return own.unionByName(visited).unionByName(visiting), n


def to_matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Equal-length list column as a dense matrix."""
    flat = vectors.combine_chunks()
    rows = len(flat)
    if not rows:
        return np.zeros((0, 1))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _split_cell(table: pa.Table, blocks: int):
    """Ids and vectors of the two blocks, each sorted by id; one block twice on the diagonal."""
    table = table.sort_by("id")
    cell = table.column("cell")[0].as_py()
    ids = table.column("id").to_numpy()
    matrix = to_matrix(table.column("vector"))
    owner = table.column("block").to_numpy()
    low, high = divmod(cell, blocks)
    if low == high:
        return ids, matrix, ids, matrix, True
    left, right = owner == low, owner == high
    return ids[left], matrix[left], ids[right], matrix[right], False


def similarity_chunks(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, similarities) of consecutive row chunks of ``left @ right.T``."""
    if not len(left) or not len(right):
        return
    step = min(max(CHUNK_ELEMENTS // len(right), 16), 1024)
    for start in range(0, len(left), step):
        yield start, np.round(left[start : start + step] @ right.T, DIGITS)


def _summaries(blocks: int, threshold: float) -> Callable[[pa.Table], pa.Table]:
    def summarize(table: pa.Table) -> pa.Table:
        left_ids, left, right_ids, right, diagonal = _split_cell(table, blocks)
        n_right = len(right_ids)
        col_count = np.zeros(n_right, dtype=np.int64)
        col_best = np.full(n_right, -np.inf)
        col_id = np.zeros(n_right, dtype=np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for start, sims in similarity_chunks(left, right):
            rows = left_ids[start : start + len(sims)]
            if diagonal:
                own = np.arange(len(sims))
                sims[own, start + own] = -np.inf
            hits = sims >= threshold
            # Ids ascend, so the first maximum is the smallest id among equals.
            best = sims.argmax(axis=1)
            value = sims[np.arange(len(sims)), best]
            out.append((rows, hits.sum(axis=1), right_ids[best], value))
            if not diagonal:
                col_count += hits.sum(axis=0)
                top = sims.argmax(axis=0)
                value = sims[top, np.arange(n_right)]
                better = value > col_best
                col_best[better] = value[better]
                col_id[better] = rows[top[better]]
        if not diagonal:
            out.append((right_ids, col_count, col_id, col_best))
        parts = [np.concatenate([o[i] for o in out]) if out else np.array([]) for i in range(4)]
        keep = parts[1] > 0
        names = ["id", "partners", "best_id", "best_similarity"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        arrays = [pa.array(p[keep], type=t) for p, t in zip(parts, types)]
        return pa.table(arrays, names=names)

    return summarize


def similarity_summary(
    vectors: DataFrame, threshold: float = 0.6, blocks: int | None = None
) -> DataFrame:
    """Per vector with at least one other vector at ``threshold`` or above: how many, the nearest
    one (smallest id on ties) and its similarity. ``vectors`` has (id bigint, vector)."""
    _check(threshold)
    cells, blocks = to_cells(vectors, threshold, blocks or block_count(vectors.count()))
    partial = (
        cells.groupBy("cell")
        .applyInArrow(
            _summaries(blocks, threshold),
            "id bigint, partners bigint, best_id bigint, best_similarity double",
        )
    )
    nearest = F.max(F.struct("best_similarity", (-F.col("best_id")).alias("tie")))
    return (
        partial.groupBy("id")
        .agg(F.sum("partners").alias("partners"), nearest.alias("n"))
        .select(
            "id",
            "partners",
            (-F.col("n.tie")).alias("best_id"),
            F.col("n.best_similarity").alias("best_similarity"),
        )
    )


def _joined(label: np.ndarray, start: int, offset: int, hits: np.ndarray) -> np.ndarray:
    """Labels after the groups of all hits are joined; every label is the number of its group's first
    vector. Row i of ``hits`` is vector ``start + i``, column j is vector ``offset + j``."""
    some = np.flatnonzero(hits.any(axis=1))
    hits, rows = hits[some], start + some
    columns = offset + np.arange(hits.shape[1])
    while len(some):
        of_row, of_column = label[rows], label[columns]
        lowest = np.minimum(np.where(hits, of_column, len(label)).min(axis=1), of_row)
        lead = np.arange(len(label))  # where each label goes
        np.minimum.at(lead, of_row, lowest)
        row, column = np.nonzero(hits & (of_column != lowest[:, None]))
        if not len(row) and (of_row == lowest).all():
            break
        np.minimum.at(lead, of_column[column], lowest[row])
        while (lead[lead] != lead).any():
            lead = lead[lead]
        label = lead[label]
    return label


def _least(threshold: float) -> float:
    """The smallest number that is ``threshold`` or above after rounding, so that whole matrices need none."""
    low, high = threshold - 10.0**-DIGITS, threshold + 10.0**-DIGITS
    while low < (middle := (low + high) / 2) < high:
        low, high = (low, middle) if np.round(middle, DIGITS) >= threshold else (middle, high)
    return high


def _linked(left: np.ndarray, right: np.ndarray | None, least: float) -> np.ndarray:
    """Labels of the groups that similar pairs join, of the left vectors and then of the right ones: pairs
    of one of each, or of the left ones if there are no others."""
    label = np.arange(len(left) + (0 if right is None else len(right)))
    others, offset = (left, 0) if right is None else (right, len(left))
    if not len(left) or not len(others):
        return label
    step = min(max(CHUNK_ELEMENTS // len(others), 16), 1024)
    for start in range(0, len(left), step):
        behind = start if right is None else 0
        hits = left[start : start + step] @ others[behind:].T >= least
        label = _joined(label, start, offset + behind, hits)
    return label


def _roots(ids: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest id of each vector's group: a link to it from every other vector is a spanning forest."""
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, ids)
    return smallest[label]


def _largest_group(threshold: float) -> Callable[[pa.Table], pa.Table]:
    least = _least(threshold)

    def largest(table: pa.Table) -> pa.Table:
        label = _linked(to_matrix(table.column("vector")), None, least)
        return table.select(["id"]).slice(int(np.bincount(label).argmax()), 1)

    return largest


def _forest(threshold: float, anchor: int | None) -> Callable[[pa.Table], pa.Table]:
    """Of a block and the hub: (src, dst, own, main), the forest with a link of every vector, of roots to
    themselves; whether the vector is one of the block; whether it is in the group of the anchor."""
    least = _least(threshold)

    def link(table: pa.Table) -> pa.Table:
        ids, own = (table.column(c).to_numpy() for c in ("id", "own"))
        label = _linked(to_matrix(table.column("vector")), None, least)
        main = np.isin(label, label[~own & (ids == anchor)])
        roots = pa.array(_roots(ids, label), pa.int64())
        return pa.table({"src": pa.array(ids, pa.int64()), "dst": roots, "own": pa.array(own), "main": pa.array(main)})

    return link


def _visitor_links(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Of members of a block and visitors: a spanning forest of the pairs of one of each."""
    least = _least(threshold)

    def link(table: pa.Table) -> pa.Table:
        visiting = table.column("visiting")
        left, right = table.filter(visiting), table.filter(pc.invert(visiting))
        ids = np.concatenate([left.column("id").to_numpy(), right.column("id").to_numpy()])
        root = _roots(ids, _linked(to_matrix(left.column("vector")), to_matrix(right.column("vector")), least))
        merged = root != ids
        return pa.table({"src": pa.array(ids[merged], pa.int64()), "dst": pa.array(root[merged], pa.int64())})

    return link


def similarity_links(
    vectors: DataFrame, threshold: float = 0.6, blocks: int | None = None
) -> DataFrame:
    """(src, dst) links whose transitive closure equals that of all pairs at ``threshold`` or above.

    Only links that join different groups matter, so the vectors are compared in two rounds, and each cell
    returns a spanning forest of its own pairs. First each block is compared with itself and with the hub,
    some vectors that go to every block. What is linked there with the anchor, a vector of the hub's largest
    group, is one main group, whose vectors need not be compared with one another. Then the vectors outside
    the main group visit the blocks that may hold similar ones. Rows moved are a few for each vector, and
    one for each block and vector outside the main group: where titles chain into a large group, as they
    do in few dimensions, those are few. Without one, it is each vector to each block it has to visit.
    """
    _check(threshold)
    blocks = blocks or block_count(vectors.count())
    vectors = vectors.filter(F.exists("vector", lambda x: x != 0))
    if blocks == 1 or vectors.isEmpty():
        one = vectors.select(F.lit(0).alias("block"), "id", "vector", F.lit(True).alias("own"))
        return one.groupBy("block").applyInArrow(_forest(threshold, None), _FOREST).filter("src <> dst").select("src", "dst")
    placed, layout = lay_out(vectors, blocks)
    placed = placed.select("block", "id", "vector")

    size = min(-(-placed.count() // blocks), HUB)
    hub = placed.orderBy(F.xxhash64("id")).limit(size).select(F.lit(0).alias("hub"), "id", "vector")
    hub = _written(hub, "hub")
    anchor = hub.groupBy("hub").applyInArrow(_largest_group(threshold), "id bigint").first()["id"]
    everywhere = placed.select("block").distinct().crossJoin(hub.drop("hub")).withColumn("own", F.lit(False))
    met = placed.withColumn("own", F.lit(True)).unionByName(everywhere)
    first = _written(met.groupBy("block").applyInArrow(_forest(threshold, anchor), _FOREST), "first-links")
    links = first.filter("src <> dst").select("src", "dst").distinct()

    outside = first.filter("own and not main").select(F.col("src").alias("id"), F.lit(True).alias("rest")).distinct()
    if outside.isEmpty():
        return links
    reach = math.acos(threshold - SLACK) + SLACK
    rest = _written(blocks_to_visit(placed.join(outside, "id", "left_semi"), layout, reach), "visits")
    # Vectors of the main group are visited in all blocks, others in the blocks behind the visitor's.
    both, main = F.array(F.lit(True), F.lit(False)), F.array(F.lit(False))
    visits = rest.select("id", "vector", "block", F.explode("_to").alias("_to")).select(
        "id", "vector", F.col("_to").alias("block"), F.explode(F.when(F.col("_to") > F.col("block"), both).otherwise(main)).alias("rest")
    )
    members = placed.join(outside, "id", "left").withColumn("rest", F.col("rest").isNotNull())
    target = ["block", "rest"]
    met = visits.groupBy(*target).count().join(members.select(*target).distinct(), target)
    parts = met.select(*target, F.ceil(F.col("count") / VISITORS).cast("int").alias("parts"))
    asked = visits.join(parts, target).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    there = members.join(parts, target).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked, there = (x.select(*target, "part", "id", "vector", F.lit(v).alias("visiting")) for x, v in ((asked, True), (there, False)))
    cells = asked.unionByName(there).groupBy(*target, "part")
    return links.unionByName(cells.applyInArrow(_visitor_links(threshold), "src bigint, dst bigint"))
