"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are hashes of its words, of their first letters (4 and 5), of pairs of neighbours
and of pairs around one word, each once for each text, with the value 1. FTRL-proximal gives every coordinate a learning rate of its own, and its L1 term leaves most weights exactly zero;
the rest, at most 2**BITS numbers, are sent to the tasks.

The fit uses a bounded sample: the ``TRAIN_DOCS`` labelled rows with the least hash of their doc_id.
The tasks store the sample's features; the driver reads them a partition at a time into a file of its own,
so it holds a few rows and the weights, however long the texts are. Scoring covers every word of every text.

Nulls: a null text is an empty one; it scores like any text without features, by the bias alone. A row
without a label, or with a null one, teaches nothing; of repeated labels the largest counts. With no
labelled rows at all every score is nearly 0. Of rows that repeat a doc_id the one with the least text
teaches. Long texts are read in parts; each starts with the last two words of the part before, so the set
of features, and with it the score, is that of the whole text, whatever stands beside it.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import RangeHash, mix
from .common import drop_stored, small_batches, store
from .suffix_dedup import _texts

BITS = 20
TRAIN_DOCS = 8000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 1e-4
PREFIXES = (4, 5)
_SLICE = 1 << 20
#: Coordinates whose weights are computed in one go.
_BLOCK = 1 << 16

#: Letters and digits as their lower case, all bytes of other scripts as they are, the rest as separators (0).
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 0 for c in range(256)], np.uint8)


def _words(buf: np.ndarray, ranges: RangeHash) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(start, [hash of the word, of its first 4 letters, of its first 5], end) of the words of a buffer."""
    low = _LOWER[buf]
    inside = np.concatenate([[False], low != 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    # Letters count, not bytes: a prefix ends before the first byte of the next letter.
    letter = np.append((low & 0xC0) != 0x80, True)
    place = np.append(0, np.cumsum(letter[:-1]))
    first = np.flatnonzero(letter)
    ranges.load(low)
    hashes = [ranges.get(start, end)]
    for n in PREFIXES:
        stop = np.minimum(first[np.minimum(place[start] + n, len(first) - 1)], end)
        hashes.append(ranges.get(start, stop))
    return start, hashes, end


def features(buf: np.ndarray, ranges: RangeHash, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(start of the word, feature) for all features of a buffer of one or more texts."""
    start, (w, *prefix), _ = _words(buf, ranges)
    mask = np.uint64((1 << bits) - 1)
    out = [(start, mix(w + np.uint64(1)))]
    out += [(start, mix(p + np.uint64(2 + i))) for i, p in enumerate(prefix)]
    for gap, salt in ((1, 11), (2, 12)):
        if len(w) > gap:
            out.append((start[gap:], mix(w[:-gap] * np.uint64(0x9E3779B97F4A7C15) + w[gap:] + np.uint64(salt))))
    return np.concatenate([x for x, _ in out]), np.concatenate([(h & mask).astype(np.int64) for _, h in out])


def text_features(text: bytes, ranges: RangeHash, bits: int = BITS) -> np.ndarray:
    """The distinct features of one text, part by part."""
    found = [np.unique(features(p, ranges, bits)[1]) for p in _parts(np.frombuffer(text, np.uint8))]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _parts(buf: np.ndarray, size: int | None = None) -> Iterator[np.ndarray]:
    """Parts of about ``size`` bytes, of three words at least, that end where a word does and start with the last two
    words of the one before."""
    size, start, end = _SLICE if size is None else size, 0, 0
    while len(buf) - start > size:
        end = max(end, start + size)
        while end < len(buf):                               # to the next separator
            gap = np.flatnonzero(_LOWER[buf[end:end + 4096]] == 0)
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + 4096, len(buf))
        if end == len(buf):
            break
        inside = np.concatenate([[False], _LOWER[buf[start:end]] != 0])
        begins = np.flatnonzero(inside[1:] & ~inside[:-1])
        if len(begins) < 3:
            end += size
            continue
        yield buf[start:end]
        start += int(begins[-2])
    yield buf[start:]


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) by FTRL-proximal, one row at a time in a fixed shuffled order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i = np.append(rows[k], 1 << bits)               # the last coordinate is the bias
            x = np.full(len(i), 1.0)
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[k]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    if not len(rows):
        return z[:-1], -20.0
    for i in range(0, len(z), _BLOCK):                      # in z's place, a block at a time: no copies of all coordinates
        z[i:i + _BLOCK] = weights(slice(i, i + _BLOCK))
    return z[:-1], float(z[-1])


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: int = TRAIN_DOCS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias from the labelled rows (doc_id, toxic) that are ``usable``."""
    small_batches(docs.sparkSession)
    known = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")             # at most ``most`` rows
              .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = RangeHash(_SLICE)
        for b in batches:
            found = [text_features((x.as_py() or "").encode(), ranges, bits) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.astype(np.int32).tobytes() for f in found], pa.binary()), b.column(2)], names=["doc_id", "f", "toxic"])

    stored = store(sample.mapInArrow(run, "doc_id long, f binary, toxic int"), "features")
    try:
        doc_id, toxic, rows = _spilled(stored)
    finally:
        drop_stored(stored)
    order = np.argsort(doc_id, kind="stable")
    return ftrl([rows[i] for i in order.tolist()], toxic[order], bits)


def _spilled(stored: DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """doc_id, toxic and the features of each row, these in a mapped file that goes with the last of them."""
    doc_id, toxic, ends = [], [], [0]
    with tempfile.TemporaryFile() as f:
        for r in stored.toLocalIterator():
            doc_id.append(r["doc_id"])
            toxic.append(r["toxic"])
            ends.append(ends[-1] + f.write(r["f"]) // 4)
        f.flush()
        flat = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if ends[-1] else b"", np.int32)
    return np.array(doc_id, np.int64), np.array(toxic, float), [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _score_texts(text: pa.Array, dense: np.ndarray, bias: float, ranges: RangeHash, bits: int) -> np.ndarray:
    buf, off = _texts(text)
    total = np.full(len(text), bias)
    first = 0
    while first < len(text):
        last = int(np.searchsorted(off, off[first] + (1 << 18), "right"))
        last = min(max(last, first + 1), len(text))
        if last == first + 1 and off[last] - off[first] > _SLICE:
            found = text_features(buf[off[first]:off[last]].tobytes(), ranges, bits)
            found = found[dense[found] != 0]                    # added up in the order in which _sums does
            total[first] += np.bincount(np.zeros(len(found), np.int64), dense[found].astype(np.float64), minlength=1)[0]
        else:
            total[first:last] += _sums(buf, off, first, last, ranges, dense, bits)
        first = last
    return 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700)))


def _scorer(docs: DataFrame, weights: np.ndarray, bias: float, bits: int):
    small_batches(docs.sparkSession)
    used = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used].astype(np.float32), bias))

    def scorer():
        i, w, b0 = sent.value
        dense = np.zeros(1 << bits, np.float32)
        dense[i] = w
        ranges = RangeHash(1 << 19)
        return lambda text: _score_texts(text, dense, b0, ranges, bits)
    return scorer


def score(docs: DataFrame, weights: np.ndarray, bias: float, bits: int = BITS) -> DataFrame:
    """doc_id, score for every row of ``docs``."""
    scorer = _scorer(docs, weights, bias, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(b.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_below(docs: DataFrame, weights: np.ndarray, bias: float, bound: float, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` whose score is below ``bound``, all columns as they are."""
    scorer = _scorer(docs, weights, bias, bits)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for b in batches:
            yield b.filter(pa.array(of(b.column(at)) < bound))

    return docs.mapInArrow(run, docs.schema)


def _sums(buf, off, first, last, ranges, dense, bits) -> np.ndarray:
    """Sums of the weights of each text's distinct features, for the texts first to last - 1."""
    n = last - first
    # Texts are apart by two separators and two marks of their own, so no pair spans two texts and none is lost.
    sizes = np.diff(off[first:last + 1])
    start = np.cumsum(sizes + 1) - sizes - 1
    joined = np.zeros(int((sizes + 1).sum()), np.uint8)
    joined[np.repeat(start - (off[first:last] - off[first]), sizes) + np.arange(int(sizes.sum()))] = buf[off[first]:off[last]]
    begin, (w, *prefix), _ = _words(joined, ranges)
    doc = np.searchsorted(start, begin, "right") - 1
    mask = np.uint64((1 << bits) - 1)
    ds, fs = [doc], [mix(w + np.uint64(1))]
    for i, p in enumerate(prefix):
        ds.append(doc)
        fs.append(mix(p + np.uint64(2 + i)))
    for gap, salt in ((1, 11), (2, 12)):
        if len(w) > gap:
            same = doc[gap:] == doc[:-gap]
            ds.append(doc[gap:][same])
            fs.append(mix(w[:-gap] * np.uint64(0x9E3779B97F4A7C15) + w[gap:] + np.uint64(salt))[same])
    d, f = np.concatenate(ds), (np.concatenate(fs) & mask).astype(np.int64)
    hit = dense[f] != 0                                     # sparse: few features have a weight
    key = np.unique((d[hit] << bits) | f[hit])
    return np.bincount(key >> bits, dense[key & ((1 << bits) - 1)].astype(np.float64), minlength=n)
