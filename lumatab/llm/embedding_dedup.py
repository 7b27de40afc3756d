"""Near-duplicate embeddings by spherical k-means cells (operator 7).

Equal vectors are one class first. Vectors of each length get centroids, about the square root of their number,
fitted on a bounded sample; every class is assigned to the cell of its nearest centroid. Neighbouring cells are
packed into blocks (a cell larger than a block is dealt over several), and a block is compared by matrix products
with its own classes and with those of other blocks that can reach one of its cells: if x lies further than
|x - y| from the plane halfway between two centroids, no y on the other side is as close as |x - y|, so no link
is lost to a cell's border. Of two blocks one visits the other, so every pair is compared once. A task counts
each class's links and emits a spanning forest, never pairs.

Products are taken in single precision first; every pair whose product is within the rounding error bound of the
threshold is decided in double precision, so the links are those of double precision. The number of blocks is a
small constant until a block's memory bound asks for more, and a block is split by its own visitors only: a class is
shuffled once for each block it can reach and for each part of its own. A group of copies or near copies that holds a third
of all rows is spread like any other rows.

Defined cases: null vectors, zero vectors, vectors with null or non-finite entries and empty vectors link
with nothing and are kept; vectors of different length never link; rows with the same id count as rows; null
ids are ignored by the smallest id of a component; an empty table gives no rows; only id and vector are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatab.llm import shared
from lumatab.llm.components import connected_components
from lumatab.operators.sampling import smallest

#: Vectors that the centroids of one length are fitted on, at most.
SAMPLE = 16_384
#: Cells of one length, at most: the centroids are the only thing that all tasks get.
MAX_CELLS = 1024
#: Blocks that the classes of one length are packed into while they fit.
BLOCKS = 6
#: Bytes of a block's classes in a task, about.
BLOCK_BYTES = 96 << 20
#: Products of one task, about.
PRODUCTS = 10**10


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very small and very large entries neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means: centroids of length 1, each the direction of its members' sum. An empty cell takes the worst-placed vector."""
    r = np.random.default_rng(seed)
    centres = sample[r.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        cos = sample @ centres.T
        cell = cos.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        worst = iter(cos.max(axis=1).argsort())
        for j in np.flatnonzero(size < 1e-9):
            sums[j] = sample[next(worst)]
            size[j] = 1.0
        new = sums / size[:, None]
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def margins(x: np.ndarray, cell: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of each row to the plane halfway between its own centroid and every other (rows, cells); 0 for its own."""
    cos = x @ centres.T
    gap = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0.0))
    np.fill_diagonal(gap, 1.0)
    out = (np.take_along_axis(cos, cell[:, None], 1) - cos) / np.maximum(gap[cell], 1e-12)
    out[np.arange(len(x)), cell] = 0.0
    return out


@dataclass
class Plan:
    """Cells and blocks of the vectors of one length. Cells stand in the order in which they are packed."""

    centres: np.ndarray
    sizes: np.ndarray  # of cells
    first: np.ndarray | None = None  # a block's first and last cell
    last: np.ndarray | None = None
    home: np.ndarray | None = None  # a cell's first block, and over how many it is dealt
    deal: np.ndarray | None = None
    rows: np.ndarray | None = None  # about, by block
    groups: np.ndarray | None = None  # parts of a block's visitors
    tile: np.ndarray | None = None  # a block's first tile: one block's members and one part of its visitors

    def pack(self, limit: int) -> None:
        """Blocks of about `limit` classes: runs of cells, or parts of one cell."""
        first, last, rows = [], [], []
        self.home, self.deal = np.zeros(len(self.sizes), np.int64), np.ones(len(self.sizes), np.int64)
        held = None  # rows of the block that is still filled
        for c, n in enumerate(self.sizes.tolist()):
            if n > limit:
                parts = -(-n // limit)
                self.home[c], self.deal[c] = len(first), parts
                first += [c] * parts
                last += [c] * parts
                rows += [-(-n // parts)] * parts
                held = None
                continue
            if held is None or held + n > limit:
                first.append(c)
                last.append(c)
                rows.append(0)
                held = 0
            self.home[c], last[-1] = len(first) - 1, c
            held += n
            rows[-1] = held
        self.first, self.last, self.rows = np.array(first), np.array(last), np.array(rows)

    def visited(self, own: np.ndarray) -> np.ndarray:
        """(rows, blocks): whether a member of a block visits another, if it can reach it. Of two blocks one visits the other, and each visits as many."""
        g = len(self.first)
        ahead = (np.arange(g)[None, :] - own[:, None]) % g
        return (ahead > 0) & ((2 * ahead < g) | ((2 * ahead == g) & (own[:, None] * 2 < g)))

    def places(self, x: np.ndarray, cell: np.ndarray, number: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own block of each row; row and block of each visit)."""
        own = self.home[cell] + number % self.deal[cell]
        near = np.cumsum(margins(x, cell, self.centres) <= reach, axis=1)
        near = np.concatenate([np.zeros((len(x), 1), near.dtype), near], axis=1)
        row, block = np.nonzero((near[:, self.last + 1] > near[:, self.first]) & self.visited(own))
        return own, row, block


def _vectors(column: pa.BinaryArray, kind: str, dim: int) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], kind, dim * len(column), int(at[0])).reshape(-1, dim).astype(np.float64)


def _packed(column: pa.ListArray, kind: str) -> tuple[pa.BinaryArray, pa.BinaryArray, pa.Array]:
    """Digest, bytes and length of each vector; null where it links with nothing."""
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # no negative zero, null as NaN
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = (np.bincount(row, ~np.isfinite(flat), len(sizes)) > 0) | (np.bincount(row, flat != 0, len(sizes)) == 0)
    ends = np.cumsum(sizes) * flat.itemsize
    data = flat.tobytes()
    whole = [None if b else data[i:j] for b, i, j in zip(bad.tolist(), (ends - sizes * flat.itemsize).tolist(), ends.tolist(), strict=True)]
    digests = [None if w is None else hashlib.blake2b(w, digest_size=16).digest() for w in whole]
    return pa.array(digests, pa.binary()), pa.array(whole, pa.binary()), pa.array(sizes, pa.int32())


class _Tile:
    """One block's members, then visitors in batches."""

    def __init__(self, threshold: float, dim: int) -> None:
        self.threshold, self.dim, self.parts = threshold, dim, []
        # single precision is off by at most this much: rounding of both sides, products and their sum
        self.slack = (dim + 8) * 2.0**-23

    def add(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray) -> None:
        self.parts.append((ids, x, copies))

    def close(self) -> None:
        """The members are all there."""
        ids, x, copies = zip(*self.parts, strict=True) if self.parts else ((np.zeros(0, np.int64),), (np.zeros((0, self.dim)),), (np.zeros(0, np.int64),))
        self.ids, self.x, self.copies = np.concatenate(ids), np.concatenate(x), np.concatenate(copies)
        self.rough, self.links, self.parts = self.x.astype(np.float32), np.zeros(len(self.ids), np.int64), []

    def _hits(self, x: np.ndarray, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of x, member before `upto`) of the links, a bounded number of products at a time."""
        step = max(1, (1 << 22) // max(1, upto))
        members = self.rough[:upto].T
        for i in range(0, len(x), step):
            rough = x[i : i + step].astype(np.float32) @ members
            at = np.flatnonzero(rough.ravel() >= np.float32(self.threshold - 2 * self.slack))
            if not len(at):
                continue
            a, b = at // upto, at % upto
            doubt = np.flatnonzero(rough.ravel()[at] <= np.float32(self.threshold + 2 * self.slack))
            if len(doubt):
                sure = np.ones(len(at), bool)
                sure[doubt] = np.einsum("ij,ij->i", x[i + a[doubt]], self.x[b[doubt]]) >= self.threshold
                a, b = a[sure], b[sure]
            yield a + i, b

    def inside(self, count: bool) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a forest of the members' links; with `count` the links are counted."""
        n, parent, rows = len(self.ids), np.arange(len(self.ids)), 2048
        if not count:
            return self.ids[:0], self.ids[:0]
        for i in range(0, n, rows):
            upto = min(n, i + rows)
            for a, b in self._hits(self.x[i:upto], upto):
                a = a + i
                below = b < a
                a, b = a[below], b[below]
                self.links += np.bincount(a, self.copies[b], n).astype(np.int64) + np.bincount(b, self.copies[a], n).astype(np.int64)
                parent = _union(parent, a, b)
        child = np.flatnonzero(parent != np.arange(n))
        return self.ids[child], self.ids[parent[child]]

    def visit(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links of a batch of visitors with the members: (visitors with links, their links, edges from, edges to)."""
        n, m = len(self.ids), len(ids)
        got, parent = np.zeros(m, np.int64), np.arange(n + m)
        for a, b in self._hits(x, n) if n else ():
            got += np.bincount(a, self.copies[b], m).astype(np.int64)
            self.links += np.bincount(b, copies[a], n).astype(np.int64)
            parent = _union(parent, n + a, b)
        child = np.flatnonzero(parent != np.arange(n + m))
        names, linked = np.concatenate([self.ids, ids]), np.flatnonzero(got)
        return ids[linked], got[linked], names[child], names[parent[child]]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent with each a[i] and b[i] under one root, flat."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def _plans(classes: DataFrame, kind: str, sample: int, max_cells: int, blocks: int) -> dict[int, Plan]:
    """A plan for each length of vectors, with centroids; sizes of cells are still to be counted."""
    plans = {}
    for row in classes.groupBy("d").count().collect():  # a row a length
        dim, n = row["d"], row["count"]
        k = max(1, min(max_cells, math.isqrt(n))) if n > blocks else 1
        centres = np.zeros((1, dim))
        if k > 1:
            fitted = smallest(classes.where(F.col("d") == dim), F.lower(F.hex("h")), [], sample, n).select("x").toArrow().column("x").combine_chunks()
            drawn = unit(_vectors(fitted, kind, dim))
            centres = fit(drawn, min(k, len(drawn)))
            around = fit(centres, min(len(centres), blocks))  # neighbouring cells stand together
            centres = centres[np.argsort((centres @ around.T).argmax(axis=1), kind="stable")]
        plans[dim] = Plan(centres, np.zeros(len(centres), np.int64))
    return plans


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, sample: int = SAMPLE, max_cells: int = MAX_CELLS,
    blocks: int = BLOCKS, block_bytes: int = BLOCK_BYTES, products: int = PRODUCTS,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row."""
    spark = vectors.sparkSession
    wide = vectors.schema[vector_col].dataType.simpleString() != "array<float>"
    kind, entry = ("<f8", "double") if wide else ("<f4", "float")
    with shared.steps(spark) as tables:
        source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{entry}>").alias("v"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), *_packed(b.column(1), kind)], ["id", "h", "x", "d"])

        rows = tables.write(source.mapInArrow(pack, f"id {source.schema['id'].dataType.simpleString()}, h binary, x binary, d int"), "vectors")
        grouped = rows.where("h IS NOT NULL").groupBy("h", "x", "d").agg(F.count("*").alias("copies"), F.min("id").alias("own"))
        classes = tables.write(grouped.withColumn("c", F.monotonically_increasing_id()), "vector-classes")
        found = _links(spark, tables, classes, kind, threshold, _plans(classes, kind, sample, max_cells, blocks), blocks, block_bytes, products)
        links = found.where("c IS NOT NULL").groupBy("c").agg(F.sum("links").alias("links"))
        nodes = connected_components(found.where("a IS NOT NULL").select("a", "b"), tables)
        members = tables.write(nodes.join(classes.select("c", "own"), F.col("node") == F.col("c")).select("c", "component", "own"), "vector-members")
        firsts = members.groupBy("component").agg(F.min("own").alias("first"))
        reached = members.select(F.col("c").alias("rid"), "component").join(firsts, "component").select("rid", "first")
        per_class = (
            classes.select("c", "h", "d", "copies", "own")
            .join(links.withColumnRenamed("c", "lid"), F.col("c") == F.col("lid"), "left")
            .join(reached, F.col("c") == F.col("rid"), "left")
            .select(F.col("h").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("rid").isNotNull(), F.col("first")).otherwise(F.col("own")).alias("component_id"))
        )
        done = rows.where("h IS NOT NULL").select("id", "h").join(per_class, F.col("h") == F.col("class")).select("id", "n_links", "component_id")
        done = done.unionByName(rows.where("h IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
        out, _ = shared.written(done.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), "vector-result")
    return out


def _links(spark, tables: shared.Steps, classes: DataFrame, kind: str, threshold: float, plans: dict[int, Plan], blocks: int, block_bytes: int, products: int) -> DataFrame:
    """(c, links) of classes with links, and edges (a, b) of forests of them, as one written table."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def by_length(b: pa.RecordBatch, rows: int = 2048) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        """Parts of a batch whose vectors have one length, with their directions."""
        for i in range(0, b.num_rows, rows):
            s = b.slice(i, rows)
            d = s.column(2).to_numpy()
            for dim in np.unique(d).tolist():
                t = s if (d == dim).all() else s.filter(pa.array(d == dim))
                yield dim, t, unit(_vectors(t.column(1), kind, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, t, x in by_length(b):
                cell = (x @ plans[dim].centres.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cell, pa.int32())], ["c", "x", "d", "copies", "cell"])

    placed = classes.select("c", "x", "d", "copies")
    if any(len(p.centres) > 1 for p in plans.values()):
        placed = tables.write(placed.mapInArrow(assign, "c bigint, x binary, d int, copies bigint, cell int"), "vector-cells")
    else:
        placed = placed.withColumn("cell", F.lit(0))
    for row in placed.groupBy("d", "cell").count().collect():  # a row a cell, at most max_cells a length
        plans[row["d"]].sizes[row["cell"]] = row["count"]
    for dim, p in plans.items():
        n = int(p.sizes.sum())
        p.pack(max(1, min(-(-11 * n // (10 * blocks)) if len(p.centres) > 1 else n, block_bytes // (16 * dim) or 1)))
        p.groups, p.tile = np.ones(len(p.first), np.int64), np.arange(len(p.first))

    def visits(batches: Iterator[pa.RecordBatch], only_count: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, t, x in by_length(b):
                p = plans[dim]
                number = t.column(0).to_numpy()
                number = number ^ number >> 33
                own, row, block = p.places(x, t.column(4).to_numpy(), number, reach)
                if only_count:
                    n = np.bincount(block, minlength=len(p.first))
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), dim), pa.int32()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["d", "block", "n"])
                    continue
                k = p.groups[own]
                members = np.repeat(np.arange(len(own)), k)
                part = np.arange(len(members)) - np.repeat(np.cumsum(k) - k, k)
                tile = np.concatenate([p.tile[own[members]] + part, p.tile[block] + number[row] // p.deal.max() % p.groups[block]])
                role = np.concatenate([np.where(part > 0, 1, 0), np.full(len(row), 2)])  # a member, a member that is counted elsewhere, a visitor
                s = t.take(pa.array(np.concatenate([members, row]), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int64()), pa.array(role, pa.int32()), *s.columns[:4]], ["tile", "role", "c", "x", "d", "copies"])

    # a block with more visitors than a task can take is split by them; only blocks that could have so many are counted
    if any(int(p.sizes.sum()) * int(p.rows.max()) > products for p in plans.values() if len(p.first) > 1):
        counted = placed.mapInArrow(lambda b: visits(b, True), "d int, block bigint, n bigint").groupBy("d", "block").agg(F.sum("n").alias("n"))
        for row in counted.collect():  # a row a block
            p = plans[row["d"]]
            p.groups[row["block"]] = max(1, -(-int(row["n"]) * int(p.rows[row["block"]]) // products))
    tiles = 0
    for p in plans.values():
        p.tile = tiles + np.cumsum(p.groups) - p.groups
        tiles += int(p.groups.sum())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c=(), links=(), a=(), b=()):
            gap = lambda k: pa.nulls(k, pa.int64())
            columns = [pa.concat_arrays([pa.array(first, pa.int64()), gap(len(a))]) for first in (c, links)] + [pa.concat_arrays([gap(len(c)), pa.array(last, pa.int64())]) for last in (a, b)]
            return pa.RecordBatch.from_arrays(columns, ["c", "links", "a", "b"])

        key, held, closed, counts = None, None, False, True

        def close():
            held.close()
            a, b = held.inside(counts)
            return out(a=a, b=b)

        def end():
            own = np.flatnonzero(held.links)
            return out(held.ids[own], held.links[own])

        for b in batches:
            tile, role = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero((np.diff(tile) != 0) | (np.diff(role) != 0)) + 1
            for i, j in zip([0, *cut], [*cut, len(tile)], strict=True):
                if i == j:
                    continue
                if key != tile[i]:
                    if key is not None:
                        if not closed:
                            yield close()
                        yield end()
                    key, held, closed = tile[i], _Tile(threshold, int(b.column(4)[i].as_py())), False
                    counts = role[i] == 0
                if role[i] == 2 and not closed:
                    closed = True
                    yield close()
                part = pa.RecordBatch.from_arrays([b.column(k).slice(i, j - i) for k in (2, 3, 4, 5)], ["c", "x", "d", "copies"])
                for _, t, x in by_length(part):
                    given = t.column(0).to_numpy(), x, t.column(3).to_numpy()
                    if role[i] == 2:
                        yield out(*held.visit(*given))
                    else:
                        held.add(*given)
        if key is not None:
            if not closed:
                yield close()
            yield end()

    sent = placed.mapInArrow(lambda b: visits(b, False), "tile bigint, role int, c bigint, x binary, d int, copies bigint")
    parts = max(1, min(tiles, 1 << 15))
    dealt = sent.repartitionById(parts, (F.col("tile") % parts).cast("int")).sortWithinPartitions("tile", "role")
    return tables.write(dealt.mapInArrow(compare, "c bigint, links bigint, a bigint, b bigint"), "vector-links")


#: The same for the table embeddings in DuckDB SQL: all pairs, and components by a recursive closure.
SQL = """
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT rid, vec_id, v, sqrt(list_sum(list_transform(v, lambda e: e * e))) AS len FROM t
    WHERE v IS NOT NULL AND len(list_filter(v, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(v, lambda e: e <> 0)) > 0),
e AS (SELECT a.rid AS a, b.rid AS b FROM g AS a JOIN g AS b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.len * b.len) >= 0.9),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach AS r JOIN e ON r.b = e.a),
comp AS (SELECT a, min(vec_id) AS first FROM reach JOIN t ON t.rid = reach.b GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(first, vec_id), vec_id) AS component_id, coalesce(least(first, vec_id), vec_id) = vec_id AS kept
FROM t LEFT JOIN comp ON comp.a = rid LEFT JOIN deg ON deg.a = rid
"""
