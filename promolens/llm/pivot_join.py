"""Embedding near-duplicates: an exact range join of a metric space, partitioned by pivots.

Cosine >= c is a Euclidean distance of at most ``eps`` between unit vectors. Vectors belong to
the cell of their nearest pivot. If x lies in cell i and y within ``eps`` of it in cell j, then by the triangle
inequality y is within ``eps`` of the boundary between the pivots p_i and p_j, that is
(d(y,p_i)^2 - d(y,p_j)^2) / (2 d(p_i,p_j)) <= eps, and within radius(i) + eps of p_i; the same holds for x
and cell j. Only vectors that satisfy both are compared across cells. Cells are packed in blocks of a bounded
number of vectors, one row each, with a bit for each cell that holds what a vector of it may be linked with. Two
blocks that reach each other's cells meet once, as rows of a join that reads the stored blocks and shuffles
nothing: what a cell borrows of another is picked where the two blocks meet, never written.

Equal vectors are one node with a count, so a vector with a million copies is compared once.
A task emits the number of links of each vector and a spanning forest of its links, never the
pairs. Candidates come from single-precision matrix products; they are decided by double-precision
products, the ones within rounding of the bound by the double-precision cosine alone.

With vectors that no pivot separates (high-dimensional noise) nearly all vectors of two blocks are
compared: that is the cost of an exact join, quadratic in time but not on disk, and the result stays whole.

Vectors that are null, zero or hold null or non-finite components have no links and are their own
component. Vectors of different lengths never link. Rows that repeat a vec_id count as rows; they
are one member of the graph. A null vec_id is never a name: such rows have no links counted for
them and a null component_id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import drop_stored, one_row_batches, small_batches, store
from .components import connected
from .vectors import matrix, unit, usable

COSINE = 0.95
#: Distinct vectors for each pivot, and the most that one block of a cell holds.
CELL = 4096
BLOCK = 2048
#: Bound on pivots, so on what is sent to every task (pivots x dimensions x 8 bytes).
MOST_PIVOTS = 4096
#: Slack for rounding in bounds and double-precision products; decisions are exact beyond it.
SLACK = 1e-9
#: Bytes of one block in double precision at most, and of the blocks that a task has at hand.
BLOCK_BYTES = 8 << 20
KEPT_BYTES = 64 << 20
#: Rows of links that a task holds before it adds them up.
HELD = 1 << 20


def _cells(pivots: dict[int, np.ndarray], blocks: dict[int, np.ndarray] | None):
    """The home cell of each vector. Without blocks: the vectors of each cell and its radius; with blocks (of each cell, by dimension): the vectors, dealt to them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.schema.get_field_index("v"))
            dims = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = pa.array(np.flatnonzero(dims == dim))
                d = _squares(unit(matrix(v.take(rows)).astype(np.float64)), pivots[int(dim)])
                cell = d.argmin(axis=1)
                if blocks is None:
                    found, at, n = np.unique(cell, return_inverse=True, return_counts=True)
                    r = np.zeros(len(found))
                    np.maximum.at(r, at, np.sqrt(d[np.arange(len(d)), cell]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), dim), pa.int32()), pa.array(found, pa.int32()), pa.array(n, pa.int64()), pa.array(r, pa.float64())],
                                                     names=["dim", "cell", "n", "r"])
                    continue
                own = b.take(rows)
                block = own.column(own.schema.get_field_index("deal")).to_numpy() % blocks[int(dim)][cell]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim), pa.int32()), pa.array(cell.astype(np.int64) << 32 | block, pa.int64()),
                                                  *(own.column(own.schema.get_field_index(c)) for c in ("node", "copies", "v"))], names=["dim", "block", "node", "copies", "v"])
    return run


def _squares(u: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors."""
    return np.maximum(2.0 - 2.0 * (u @ p.T), 0.0)


_BLOCK = "dim int, block long, node binary, copies binary, v binary, reach array<long>"


def _packed(pivots: dict[int, np.ndarray], radii: dict[int, np.ndarray], eps: float):
    """The vectors of a block in one row, in single precision if that changes none of them; ``reach``: 64 cells a number."""
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim, block = (k.as_py() for k in key)
        m = matrix(t["v"]).astype(np.float64)
        p, cell = pivots[dim], block >> 32
        gap, bits = np.sqrt(_squares(p[cell:cell + 1], p)), np.zeros(-(-len(p) // 64) * 64, bool)
        for i in range(0, len(m), 512):
            d = _squares(unit(m[i:i + 512]), p)
            near = d - d[:, cell:cell + 1] <= 2.0 * (eps + SLACK) * gap + SLACK
            bits[:len(p)] |= (near & (np.sqrt(d) <= radii[dim] + eps + SLACK)).any(axis=0)
        bits[cell] = True
        with np.errstate(over="ignore"):
            less = m.astype(np.float32)
        m = less if (less == m).all() else m
        row = dim, block, *(t[c].to_numpy().astype(np.int64).tobytes() for c in ("node", "copies")), m.tobytes(), np.packbits(bits, bitorder="little").view(np.int64)
        types = pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64())
        return pa.table({k: pa.array([x], kind) for k, x, kind in zip(("dim", "block", "node", "copies", "v", "reach"), row, types, strict=True)})
    return run


def _reaches(x: str, y: str):
    """Whether block ``x`` reaches the cell of block ``y``."""
    return F.expr(f"shiftright(get({x}_reach, cast(shiftright({y}.block, 38) as int)), cast(shiftright({y}.block, 32) & 63 as int)) & 1") == 1


class _Block:
    """A packed block: its vectors, as they are and of length 1."""

    def __init__(self, dim: int, block: int, node: bytes, copies: bytes, v: bytes) -> None:
        self.dim, self.id, self.cell = dim, block, block >> 32
        self.node, self.copies = (np.frombuffer(x, np.int64) for x in (node, copies))
        self.m = np.frombuffer(v, np.float32 if len(v) == 4 * dim * len(self.node) else np.float64).reshape(-1, dim).astype(np.float64)
        self.u = unit(self.m)
        self.less = self.u.astype(np.float32)

    def near(self, other: _Block, p: np.ndarray, eps: float) -> np.ndarray:
        """The rows that may have a link to a vector of ``other``."""
        if self.cell == other.cell:
            return np.arange(len(self.node))
        own, its = p[self.cell], p[other.cell]
        d, reach = _squares(self.u, np.stack([own, its])), np.sqrt(_squares(other.u, its[None, :]).max())
        gap = np.sqrt(_squares(own[None, :], its[None, :])[0, 0])
        return np.flatnonzero((d[:, 1] - d[:, 0] <= 2.0 * (eps + SLACK) * gap + SLACK) & (np.sqrt(d[:, 1]) <= reach + eps + SLACK))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision.

    Rows are first divided by a power of two, which changes no digit, so that squares neither vanish nor overflow.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x for x in (a, b))
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _linked(x: _Block, y: _Block, bound: float, p: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``x`` and of ``y`` that are linked, each pair once, for some rows of ``x`` at a time."""
    same = x.id == y.id
    left, right = x.near(y, p, eps), y.near(x, p, eps)
    if not (len(left) and len(right)):
        return
    low = np.float32(bound - SLACK - 1.2e-7 * (x.dim + 8))        # a single-precision product is off by less
    other = y.less[right].T
    for i in range(0, len(left), 512):
        li = left[i:i + 512]
        hit = x.less[li] @ other >= low
        if not hit.any():
            continue
        r, c = np.nonzero(hit)
        a, b = li[r], right[c]
        if same:
            r, c, a, b = (z[b > a] for z in (r, c, a, b))
        if len(a) * x.dim > 1 << 22:
            s = (x.u[li] @ y.u[right].T)[r, c]
        else:
            s = np.einsum("ij,ij->i", x.u[a], y.u[b])
        ok = s >= bound
        unsure = np.flatnonzero(np.abs(s - bound) < SLACK)
        ok[unsure] = cosine(x.m[a[unsure]], y.m[b[unsure]]) >= bound
        yield a[ok], b[ok]


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n: the least of those that pairs connect it with."""
    root = np.arange(n)
    while len(pairs):                              # least label, with pointer jumping
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, root[pairs[:, 0]], low)
        np.minimum.at(root, root[pairs[:, 1]], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _summed(rows: list[np.ndarray]) -> np.ndarray:
    """node, links, to: links added up by node, the edges as a forest."""
    node, links, to = np.concatenate(rows, axis=1) if rows else np.empty((3, 0), np.int64)
    names, at = np.unique(np.concatenate([node, to]), return_inverse=True)
    count = np.zeros(len(names), np.int64)
    np.add.at(count, at[:len(node)], links)
    root = _forest(len(names), np.stack([at[:len(node)], at[len(node):]], 1))
    keep = (count > 0) | (root != np.arange(len(names)))
    return np.stack([names[keep], count[keep], names[root[keep]]])


def _join_blocks(bound: float, pivots: dict[int, np.ndarray]):
    """Pairs of blocks (or a block and itself): link counts and a spanning forest."""
    eps = float(np.sqrt(2.0 - 2.0 * bound))

    def batch(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["node", "links", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], _Block] = {}
        found: list[np.ndarray] = []
        held = 0
        for row in (r for b in batches for r in b.to_pylist()):
            sides = []
            for side in "xy":
                key = row[side]["dim"], row[side]["block"]
                if key not in kept:
                    kept[key] = _Block(**row[side])
                    while len(kept) > 2 and sum(z.m.nbytes for z in kept.values()) > KEPT_BYTES // 3:
                        del kept[next(iter(kept))]
                sides.append(kept[key])
            x, y = sides
            count, linked = [np.zeros(len(z.node), np.int64) for z in sides], [np.empty((0, 2), np.int64)]
            for a, b in _linked(x, y, bound, pivots[x.dim], eps):
                np.add.at(count[0], a, y.copies[b])
                np.add.at(count[1], b, x.copies[a])
                linked.append(np.stack([a, b + (len(x.node) if x.id != y.id else 0)], 1))
            node = x.node if x.id == y.id else np.concatenate([x.node, y.node])
            links = count[0] + count[1] if x.id == y.id else np.concatenate(count)
            root = _forest(len(node), np.concatenate(linked))
            keep = (links > 0) | (root != np.arange(len(node)))
            if keep.any():
                found.append(np.stack([node[keep], links[keep], node[root[keep]]]))
                held += int(keep.sum())
            if held > HELD:
                found = [_summed(found)]
                held = found[0].shape[1]
                if held > HELD // 2:
                    yield batch(found[0])
                    found, held = [], 0
        yield batch(_summed(found))
    return run


def _pivots(spark: SparkSession, nodes: DataFrame, n: int, cell: int) -> dict[int, np.ndarray]:
    """Unit vectors of a bounded sample of nodes, by dimension (the least hashes: reruns agree)."""
    most = int(min(MOST_PIVOTS, n // cell + 1))
    dims = [r[0] for r in nodes.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    return {d: unit(np.array([r[0] for r in nodes.where(F.size("v") == d).orderBy(F.xxhash64("node", F.lit(7)), "node").limit(most).select("v").collect()]))
            for d in dims}


def _key(seed: int):
    return F.xxhash64(F.lit(seed), "v")


def near_duplicates(vectors: DataFrame, bound: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
    spark = vectors.sparkSession
    small_batches(spark)
    # Single-precision vectors stay so where they are stored and shuffled; arithmetic is in double precision.
    kind = "array<float>" if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    rows = usable(vectors).where("vec_id IS NOT NULL").withColumn("v", F.col("v").cast(kind))
    nodes = store(rows.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).select("node", "v", "copies"), "distinct")
    # A number for each distinct vector, so that rows find their node without carrying vectors: the first hash that no two share.
    for seed in itertools.count():
        key = _key(seed)
        n, keys = nodes.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
        if n == keys:
            break
    if n:
        names = store(nodes.select(key.alias("key"), "node", "copies"), "names")
        pivots = _pivots(spark, nodes, n, cell)
        blocks, radii = ({d: np.full(len(p), x) for d, p in pivots.items()} for x in (1, -np.inf))
        cells = nodes.select("v").mapInArrow(_cells(pivots, None), "dim int, cell int, n long, r double").groupBy("dim", "cell")
        for r in cells.agg(F.sum("n").alias("n"), F.max("r").alias("r")).collect():    # at most MOST_PIVOTS rows a dimension
            d = r["dim"]
            blocks[d][r["cell"]], radii[d][r["cell"]] = -(-r["n"] // max(1, min(block, BLOCK_BYTES // (8 * d)))), r["r"]
        dealt = nodes.withColumn("deal", F.xxhash64("node", F.lit(11)).bitwiseAND((1 << 62) - 1)).mapInArrow(_cells(pivots, blocks), f"dim int, block long, node long, copies long, v {kind}")
        packed = store(dealt.groupBy("dim", "block").applyInArrow(_packed(pivots, radii, float(np.sqrt(2.0 - 2.0 * bound))), _BLOCK), "blocks")
        drop_stored(nodes)
        x, y = (packed.select(F.struct(*packed.columns[:-1]).alias(k), F.col("reach").alias(f"{k}_reach")) for k in "xy")
        meet = (F.col("x.dim") == F.col("y.dim")) & (F.col("x.block") <= F.col("y.block")) & _reaches("x", "y") & _reaches("y", "x")
        pairs = x.join(y.hint("shuffle_replicate_nl"), meet).select("x", "y")
        with one_row_batches(spark):
            found = store(pairs.mapInArrow(_join_blocks(bound, pivots), "node long, links long, to long"), "links")
        drop_stored(packed)
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        parts = connected(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
        known = names.join(links, "node", "left").join(parts, "node", "left").select(
            "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
        linked = rows.select("vec_id", key.alias("key")).join(known, "key").select("vec_id", "n_links", "component_id")
    else:
        linked = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rest = _unusable(vectors).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _unusable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0.0), F.lit(False))
    return vectors.where(~F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"))
