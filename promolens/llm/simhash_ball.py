"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

Two fingerprints within ``2h`` bits of each other share a variant within ``h`` bits of both,
so every fingerprint emits its ball of radius ``h`` and equal variants meet in a shuffle. An
odd radius ``2h + 1`` has no middle. There the bits are dealt into ``MASKS`` groups; each
group is masked in turn and the ball is emitted over the other bits: a pair that differs at all
differs within some group, and with that group masked at most ``2h`` bits are left. For radius 3
that takes 132 variants instead of the 2,081 that a ball of radius 2 has, and 42 bits still
tell unrelated fingerprints apart.

Equal fingerprints are one node, however many documents have it. A bucket emits a spanning
forest of its verified links, so a group of near copies costs rows in proportion to its size.

Nulls: a null text has no words (fingerprint zero, linked like any other); rows with a null
doc_id get a fingerprint and their group's component but never name it (null if the group has
no other doc_id). Repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, small_batches, store
from .components import connected

SHINGLE = 3
MAX_BITS = 3
SEED = 42
MASKS = 3
#: Variant rows for which one partition is made.
BUCKET_ROWS = 1_000_000
#: Hashes whose bits are added up in one byte each.
_CHUNK = 255


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: A-Z only, and ASCII white space only
    if not w:
        return 0
    k = min(words, len(w))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b" ".join(x), SEED) for x in zip(*(w[i:] for i in range(k)), strict=False)], np.uint64)
    set_bits = h.view(np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), _CHUNK):
        count += np.add.reduce(np.unpackbits(set_bits[i:i + _CHUNK], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(count * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (null for a null text), fp: the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["doc_id", "text_hash", "fp"])
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
            .mapInArrow(run, "doc_id long, text_hash long, fp long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(max_bits: int, bits: int = 64) -> list[tuple[int, int]]:
    """(bits kept, bits flipped) of each variant that a fingerprint emits."""
    half = max_bits // 2
    groups = [()] if max_bits % 2 == 0 else [tuple(range(i, bits, MASKS)) for i in range(MASKS)]
    out = []
    for masked in groups:
        free = [b for b in range(bits) if b not in masked]
        keep = sum(1 << b for b in free)
        out += [(keep, sum(1 << b for b in flip)) for r in range(half + 1) for flip in combinations(free, r)]
    return out


def _forest(fp: np.ndarray, max_bits: int, block: int = 2048) -> list[tuple[int, int]]:
    """A spanning forest of the links among the (distinct) fingerprints of one bucket."""
    root = np.arange(len(fp))
    out = []
    for i in range(len(fp)):
        for s in range(i + 1, len(fp), block):
            near = np.flatnonzero(np.bitwise_count(fp[s:s + block] ^ fp[i]) <= max_bits) + s
            near = near[root[near] != root[i]]
            for r in np.unique(root[near]).tolist():
                j = near[root[near] == r]
                if len(j):
                    out.append((i, int(j[0])))
                    root[root == r] = root[i]
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, distinct: int | None = None) -> DataFrame:
    """a, b: links between the distinct fingerprints ``fp`` that keep every connection."""
    table = variants(max_bits)
    rows = (distinct if distinct is not None else fps.count()) * len(table)
    ball = F.array(*[F.struct(F.lit(_signed(k)).alias("k"), F.lit(_signed(f)).alias("f")) for k, f in table])
    emitted = fps.select("fp", F.explode(ball).alias("x")).select(
        F.col("fp").bitwiseAND(F.col("x.k")).bitwiseXOR(F.col("x.f")).alias("key"), "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        a: list[int] = []
        c: list[int] = []
        if got:
            key, fp = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(key, kind="stable")
            key, fp = key[order], fp[order].view(np.uint64)
            change = np.ones(len(key), bool)
            change[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(change)
            size = np.diff(np.append(start, len(key)))
            two = start[size == 2]                     # nearly all: one comparison each
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            a, c = fp[two].view(np.int64).tolist(), fp[two + 1].view(np.int64).tolist()
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                bucket = np.unique(fp[s:s + n])
                for i, j in _forest(bucket, max_bits):
                    a.append(int(bucket[i:i + 1].view(np.int64)[0]))
                    c.append(int(bucket[j:j + 1].view(np.int64)[0]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return emitted.repartition(rows // BUCKET_ROWS + 1, "key").mapInArrow(verify, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, text_hash, fp (signed long), component (its least fp), component_id: the least doc_id reachable by links."""
    own = store(fingerprints(docs, words), "fingerprints")
    nodes = store(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = connected(links(nodes.select("fp"), max_bits, nodes.count())).withColumnRenamed("node", "fp")
    named = store(nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component", "component_id")
    return own.join(classes, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def deduplicate(docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component: the one whose doc_id names it.

    Of rows that repeat that doc_id within the component, one stays. A component without any
    doc_id keeps one row, that of the least hash of its text.
    """
    named = near_duplicates(docs, words, max_bits)
    leader = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("l")
    leaders = named.groupBy("component").agg(leader).select(F.col("l.doc_id").alias("_d"), F.col("l.text_hash").alias("_h")).distinct()
    keyed = boxed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("text_hash"))
    kept = keyed.join(leaders, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0)))
    return kept.withColumn("nth", nth).where("nth = 1").select("row.*")
