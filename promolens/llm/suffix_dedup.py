"""Removal of repeated substrings by a distributed sparse suffix array.

A byte is removed if a ``window``-byte string that covers it also starts in a document
with a smaller doc_id. Sorting every suffix of the corpus would shuffle the corpus fifty
times over, so only suffixes at content-defined anchors are handled: the anchor of a
window is its smallest (hashed, leftmost) ``K``-byte piece, so equal windows have their
anchor at the same offset, and consecutive windows share one.

1. Every run of windows with one anchor becomes a row (hash of the anchor's piece, hash of
   the run's whole context, document, place); runs that repeat without a gap (a line of dashes, blanks)
   are one row that counts them. Rows travel as packed arrays, one blob for each
   batch and hash range; within a batch all but the smallest document of a context are
   settled on the spot and go to their documents directly. Hash ranges with over ``HEAVY_ROWS`` rows are first dealt
   at random into parts that leave the smallest document of each context only. Then each hash range
   settles the contexts that a smaller document has too. The hash ranges are dealt in ``ROUNDS`` rounds, and
   the rows of a round are deleted after it, so that the stored rows are never on disk a second time as a shuffle.
2. What is left are contexts that share the piece but not the whole run (the ends of
   repeated passages). Their suffixes are read from the text, range-partitioned by their
   leading bytes with sampled splitters (``repartitionByRange``), and each range sorts the
   windows in them by multikey radix passes of eight bytes, comparing only the ties of the
   pass before. Equal leading bytes never straddle a boundary, as splitters lie between keys.
   A piece with very many contexts is split further: its windows travel one by one, keyed by
   all their bytes, the smallest document of each batch only.
3. Spans meet their documents again in groups of a bounded number of bytes.

Nulls: a null text is empty; a row with a null doc_id neither gives nor loses bytes. Rows
that repeat a doc_id are each judged on their own text (neither has the smaller doc_id).
Texts under ``window`` bytes keep everything. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import RangeHash, kmer_hashes, mix, sliding_leftmost_min
from .common import drop_stored, pack, small_batches, store, text_bytes, unpack

K = 20
#: Bytes of text for which one hash range, and one group of documents, is made.
GROUP_BYTES = 8 << 20
#: Bytes of text whose anchors a task holds at a time (or one document's).
UNIT_BYTES = 4 << 20
#: Windows handled at a time when anchors are computed.
BLOCK = 1 << 17
#: A piece with more contexts than this sends its windows one by one (an exact split of hot keys).
HOT_CONTEXTS = 512
#: A hash range with more rows than this is first reduced in parts of about so many rows.
HEAVY_ROWS = 2 << 20
#: Rounds in which the hash ranges are dealt, and the hash ranges that are worth another one.
ROUNDS = 8
ROUND_GROUPS = 16
#: Rows of one range of suffixes.
RANGE_ROWS = 40_000

_SPANS = "g int, kind int, n long, body binary"


def _texts(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one buffer, and the n + 1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


def anchors(buf: np.ndarray, off: np.ndarray, window: int, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """(piece hash, context hash, start, windows, times) of every run of windows within one text.

    A run that repeats ``times`` times, each beginning where the windows of the one before end, is one row.
    """
    lens = np.diff(off)
    inside = np.repeat(np.tile([True, False], len(lens)),
                       np.stack([np.maximum(lens - window + 1, 0), np.minimum(lens, window - 1)], 1).ravel())
    ranges, parts = RangeHash(block + window), []
    for s in range(0, len(buf) - window + 1, block):
        b = buf[s:s + block + window - 1]
        h = kmer_hashes(b, K)
        pos = sliding_leftmost_min(h, window - K + 1)
        ok = inside[s:s + len(pos)]
        change = np.ones(len(pos), bool)
        change[1:] = (pos[1:] != pos[:-1]) | (ok[1:] != ok[:-1])
        start = np.flatnonzero(change)
        n = np.diff(np.append(start, len(pos)))
        start, n = start[ok[start]], n[ok[start]]
        ranges.load(b)
        # Smallest hashes are small: mixed again, they spread evenly over the hash ranges.
        piece, context = mix(h[pos[start]] ^ np.uint64(0xA5A5A5A5A5A5A5A5)), ranges.get(start, start + n - 1 + window)
        # Windows of two texts never adjoin: the last ones of a text have no room for a window.
        new = _starts(piece, context, n)
        new[1:] |= start[1:] != start[:-1] + n[:-1]
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(new)))
        parts.append((piece[first], context[first], start[first] + s, n[first], times))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(doc ^ (doc >> 17) ^ (doc >> 31), groups)


def _group_col(groups: int):
    d = F.col("doc_id")
    return F.pmod(d.bitwiseXOR(F.shiftright(d, 17)).bitwiseXOR(F.shiftright(d, 31)), F.lit(groups)).cast("int")


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Flags of the rows (sorted by cols) that differ from the row before."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _by_group(doc, tag, a, n, times, kind, groups) -> list[tuple[int, int, int, bytes]]:
    if not len(doc):
        return []
    g = _group(doc, groups)
    order = np.lexsort((a, tag, doc, kind, g))
    doc, tag, a, n, times, g, kind = (x[order] for x in (doc, tag, a, n, times, g, kind))
    st = np.flatnonzero(_starts(g, kind))
    return [(int(g[i]), int(kind[i]), int(j - i), pack(doc[i:j], tag[i:j], a[i:j], n[i:j], times[i:j]))
            for i, j in zip(st, np.append(st[1:], len(doc)), strict=True)]


def _repeated(doc, tag, a, n, step, times) -> tuple[np.ndarray, ...]:
    """(doc, tag, start, windows, 1) of runs that repeat ``times`` times, ``step`` bytes apart; adjoining ones as one."""
    solid = n == step
    n, times = np.where(solid, n * times, n), np.where(solid, 1, times)
    i = np.repeat(np.arange(len(doc)), times)
    k = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
    return doc[i], tag[i], a[i] + k * step[i], n[i], np.ones(len(i), np.int64)


def _span_batch(rows: list[tuple[int, int, int, bytes]]) -> dict:
    g, kind, n, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return {"g": pa.array(g, pa.int32()), "kind": pa.array(kind, pa.int32()),
            "n": pa.array(n, pa.int64()), "body": pa.array(body, pa.binary())}


def _units(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``UNIT_BYTES`` of text together."""
    _, off = _texts(batch.column(1))
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(off, off[first] + UNIT_BYTES, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


_ANCHORS = "kind int, part int, n long, h binary, c binary, body binary"


def _known(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags the rows whose context a smaller document has too."""
    order = np.lexsort((doc, c, h))
    out = np.zeros(len(order), bool)
    if len(order):
        new = _starts(h[order], c[order])
        out[order] = doc[order] > doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _anchor_rows(part, low, c, doc, tag, a, n, times, groups: int) -> dict:
    """Rows of ``_ANCHORS``: settled ones (kind 1) by group of documents, the others (kind 0) by hash range."""
    settled = _known(part << 32 | low, c, doc)
    part = np.where(settled, _group(doc, groups), part)
    n, times = np.where(settled, n * times, n), np.where(settled, 1, times)
    order = np.lexsort((part, settled))
    part, settled = part[order], settled[order]
    st = np.flatnonzero(_starts(part, settled))
    rows = []
    for i, j in zip(st, np.append(st[1:], len(order)), strict=True) if len(st) else ():
        o, done = order[i:j], bool(settled[i])
        rows.append((int(done), int(part[i]), len(o), b"" if done else low[o].astype(np.uint32).tobytes(), b"" if done else c[o].tobytes(),
                     pack(doc[o], tag[o], a[o], n[o], times[o])))
    cols = list(zip(*rows, strict=True)) or [()] * 6
    types = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3)
    return {k: pa.array(x, t) for k, x, t in zip(("kind", "part", "n", "h", "c", "body"), cols, types, strict=True)}


def _map_anchors(window: int, groups: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (u for b in batches for u in _units(b)):
            buf, off = _texts(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tags = np.fromiter((zlib.crc32(buf[s:e]) for s, e in zip(off[:-1], off[1:], strict=True)), np.int64, len(ids))
            h, c, at, n, times = anchors(buf, off, window, block)
            which = np.searchsorted(off, at, "right") - 1
            scaled = (h >> np.uint64(32)) * np.uint64(groups)
            part, low = (scaled >> np.uint64(32)).astype(np.int64), scaled.astype(np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_pydict(_anchor_rows(part, low, c, ids[which], tags[which], at - off[which], n, times, groups))
    return run


def _unpacked(t: pa.Table) -> tuple[np.ndarray, ...]:
    """low piece hash, context hash, doc, tag, start, windows and times of the rows that are not settled."""
    body = [unpack(x, 5) for x in t["body"].to_pylist()]
    h, c = (np.concatenate([np.frombuffer(x, k) for x in t[name].to_pylist()]) for name, k in (("h", np.uint32), ("c", np.uint64)))
    return h, c, *(np.concatenate(x) for x in zip(*body, strict=True))


def _reduce(groups: int):
    """A part of a heavy hash range: only the smallest document of each context stays unsettled."""
    def run(t: pa.Table) -> pa.Table:
        h, c, doc, tag, a, n, times = _unpacked(t)
        return pa.table(_anchor_rows(np.full(len(h), t["part"][0].as_py(), np.int64), h.astype(np.int64), c, doc, tag, a, n, times, groups))
    return run


def _settle(groups: int, hot: int):
    """One hash range: settles contexts known from a smaller document, names the rest."""
    def run(t: pa.Table) -> pa.Table:
        h, c, doc, tag, a, n, times = _unpacked(t)
        order = np.lexsort((doc, c, h))
        h, c, doc, tag, a, n, times = (x[order] for x in (h, c, doc, tag, a, n, times))
        new = _starts(h, c)
        st = np.flatnonzero(new)
        context = np.cumsum(new) - 1
        least = doc[st]
        known = doc > least[context]
        piece = np.flatnonzero(_starts(h[st]))
        contexts = np.diff(np.append(piece, len(st)))
        shared = np.maximum.reduceat(least, piece) > np.minimum.reduceat(least, piece)
        of = np.cumsum(_starts(h[st]))[context] - 1
        open_ = shared[of] & ~known
        kind = np.where(known, 0, np.where(contexts[of] > hot, 2, 1))
        n, times = np.where(known, n * times, n), np.where(known, 1, times)
        keep = known | open_
        return pa.table(_span_batch(_by_group(*(x[keep] for x in (doc, tag, a, n, times, kind)), groups)))
    return run


_CONTEXT = "key binary, context binary, doc long, tag long, start long, n int, step int, times long, done int"


def _windows(buf: np.ndarray, at: np.ndarray, size: int) -> list[bytes]:
    return [buf[s:s + size].tobytes() for s in at]


def _contexts(window: int):
    """Reads the open runs of one group of documents from their texts."""
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in ("key", "context", "doc", "tag", "start", "n", "step", "times", "done")}
        if docs.num_rows and spans.num_rows:
            buf, off = _texts(docs["text"])
            place: dict[tuple[int, int], int] = {}
            for i, d in enumerate(docs["doc_id"].to_pylist()):
                if d is not None:
                    place[d, zlib.crc32(buf[off[i]:off[i + 1]])] = int(off[i])
            seen: dict[bytes, tuple] = {}
            doubles: list[tuple] = []
            for kind, body in zip(spans["kind"].to_pylist(), spans["body"].to_pylist(), strict=True):
                for d, t, a, n, times in zip(*(x.tolist() for x in unpack(body, 5)), strict=True):
                    s = place[d, t] + a
                    if kind == 1:
                        text = buf[s:s + n - 1 + window].tobytes()
                        piece = buf[s + n - 1:s + window]     # what all windows of the run share
                        h = kmer_hashes(piece, K)
                        p = int(np.argmin(h)) + n - 1
                        for k, v in zip(rows, (text[p:p + K], text, d, t, a, n, n, times, 0), strict=True):
                            rows[k].append(v)
                    else:
                        for x in range(n):
                            w = buf[s + x:s + x + window].tobytes()
                            old = seen.get(w)
                            if old is None or old[0] > d:
                                if old is not None:
                                    doubles.append((w, *old))
                                seen[w] = (d, t, a + x, n, times)
                            else:
                                doubles.append((w, d, t, a + x, n, times))
            for w, (d, t, a, step, times) in seen.items():
                for k, v in zip(rows, (w, w, d, t, a, 1, step, times, 0), strict=True):
                    rows[k].append(v)
            for w, d, t, a, step, times in doubles:
                same = d == seen[w][0]                        # the same document again: still open
                for k, v in zip(rows, (w, w if same else b"", d, t, a, 1, step, times, int(not same)), strict=True):
                    rows[k].append(v)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)})
    return run


def repeated_windows(buf: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Flags the windows (starting at ``at``) that also belong to a smaller document.

    A multikey sort: eight bytes at a time, each pass sorts only what the passes before left tied.
    """
    rows = np.arange(len(at))
    label = np.zeros(len(at), np.int64)
    for j in range(0, window, 8):
        width = min(8, window - j)
        word = np.zeros(len(rows), np.uint64)
        for k in range(width):
            word = (word << np.uint64(8)) | buf[at[rows] + j + k]
        order = np.lexsort((word, label))
        rows, word, label = rows[order], word[order], label[order]
        new = _starts(label, word)
        label = np.cumsum(new) - 1
        size = np.bincount(label, minlength=1)
        tied = size[label] > 1 if len(label) else np.empty(0, bool)
        rows, label = rows[tied], label[tied]
    flags = np.zeros(len(at), bool)
    if len(rows):
        order = np.lexsort((doc[rows], label))
        rows, label = rows[order], label[order]
        new = _starts(label)
        flags[rows] = doc[rows] > doc[rows][np.flatnonzero(new)][np.cumsum(new) - 1]
    return flags


def _compare(window: int, groups: int):
    """One range of suffixes: sorts all windows in it and settles those of a smaller document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        rows = []
        if got:
            t = pa.Table.from_batches(got)
            doc, tag, start, n, step, times, done = (t[c].to_numpy().astype(np.int64) for c in ("doc", "tag", "start", "n", "step", "times", "done"))
            settled = done == 1
            found = _repeated(*(x[settled] for x in (doc, tag, start, n, step, times)))
            rows += _by_group(*found, np.zeros(len(found[0]), np.int64), groups)
            live = np.flatnonzero(~settled)
            buf, off = _texts(t["context"].take(pa.array(live)))
            doc, tag, start, n, step, times = (v[live] for v in (doc, tag, start, n, step, times))
            row = np.repeat(np.arange(len(n)), n)
            x = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            flag = repeated_windows(buf, off[row] + x, doc[row], window)
            row, x = row[flag], x[flag]
            new = _starts(row, x - np.arange(len(x))) if len(row) else np.empty(0, bool)
            st = np.flatnonzero(new)
            length = np.diff(np.append(st, len(row)))
            i = row[st]
            found = _repeated(doc[i], tag[i], start[i] + x[st], length, step[i], times[i])
            rows += _by_group(*found, np.zeros(len(found[0]), np.int64), groups)
        yield pa.RecordBatch.from_pydict(_span_batch(rows))
    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(window: int, with_text: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        buf, off = _texts(docs["text"])
        ids = docs["doc_id"].to_pylist()
        found = [unpack(x, 5)[:4] for x in spans["body"].to_pylist()]     # settled runs are not repeated: times is 1
        doc, tag, a, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 4
        order = np.lexsort((a, tag, doc))
        doc, tag, a, e = doc[order], tag[order], a[order], (a + n - 1 + window)[order]
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for i, d in enumerate(ids):
            text = buf[off[i]:off[i + 1]]
            lo, hi = (np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")) if d is not None else (0, 0)
            if hi > lo:
                crc = zlib.crc32(text)
                lo, hi = lo + np.searchsorted(tag[lo:hi], crc, "left"), lo + np.searchsorted(tag[lo:hi], crc, "right")
            removed = spans_n = 0
            kept = text.tobytes()
            if hi > lo:
                s, t = a[lo:hi], np.maximum.accumulate(e[lo:hi])
                first = np.ones(len(s), bool)
                first[1:] = s[1:] > t[:-1]
                s, t = s[first], t[np.append(np.flatnonzero(first)[1:] - 1, len(t) - 1)]
                removed, spans_n = int((t - s).sum()), len(s)
                cuts = zip(np.append(0, t).tolist(), np.append(s, len(text)).tolist(), strict=True)
                kept = b"".join(kept[x:y] for x, y in cuts)
            for k, v in zip(out, (d, len(text), removed, spans_n, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                out[k].append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})
    return run


def remove_repeats(docs: DataFrame, window: int = 50, with_text: bool = False, group_bytes: int = GROUP_BYTES,
                   hot: int = HOT_CONTEXTS, range_rows: int = RANGE_ROWS, block: int = BLOCK, heavy: int = HEAVY_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining bytes as ``kept``).

    ``window`` is at least ``K``. The last five set how the work is dealt out, not what results.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = text_bytes(docs) // group_bytes + 1
    usable = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= window))
    rounds = min(ROUNDS, groups // ROUND_GROUPS + 1)
    round_of = F.when(F.col("kind") == 0, F.col("part") % rounds).otherwise(0).alias("round")
    rows = store(usable.mapInArrow(_map_anchors(window, groups, block), _ANCHORS).select("*", round_of), "anchors", ["kind", "round"])
    live, settled, found = rows.where("kind = 0"), [rows.where("kind = 1")], []
    loads = live.groupBy("part").agg(F.sum("n").alias("rows")).where(F.col("rows") > heavy)
    salts = store(loads.select("part", F.ceil(F.col("rows") / heavy).alias("salts")), "heavy")
    reduce = not salts.isEmpty()
    for r in range(rounds):
        own = live.where(F.col("round") == r).drop("round")
        if reduce:
            salted = own.join(F.broadcast(salts), "part").withColumn("salt", F.pmod(F.xxhash64("body"), "salts"))
            less = store(salted.select("part", "salt", "h", "c", "body").groupBy("part", "salt").applyInArrow(_reduce(groups), _ANCHORS), "reduced", ["kind"])
            own = own.join(F.broadcast(salts), "part", "left_anti").unionByName(less.where("kind = 0"))
            settled.append(less.where("kind = 1"))
        found.append(store(own.groupBy("part").applyInArrow(_settle(groups, hot), _SPANS), "spans"))
        drop_stored(rows, where=f"/kind=0/round={r}")
        if reduce:
            drop_stored(less, where="/kind=0")
    found = functools.reduce(DataFrame.unionByName, found)
    named = docs.where(F.col("doc_id").isNotNull())
    grouped = named.withColumn("g", _group_col(groups))
    contexts = store(
        grouped.where(F.octet_length("text") >= window).groupBy("g")
        .cogroup(found.where("kind > 0").groupBy("g")).applyInArrow(_contexts(window), _CONTEXT), "contexts")
    ranges = contexts.count() // range_rows + 1
    ends = store(contexts.repartitionByRange(ranges, "key").mapInArrow(_compare(window, groups), _SPANS), "ends")
    drop_stored(contexts)
    spans = found.where("kind = 0").unionByName(ends)
    for x in settled:
        spans = spans.unionByName(x.select(F.col("part").alias("g"), F.lit(0).alias("kind"), "n", "body"))
    out = grouped.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(_cut(window, with_text), _RESULT)
    # Rows without a doc_id lose nothing, so they meet no spans and need no group.
    whole = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    zero = F.lit(0).cast("long")
    nameless = docs.where(F.col("doc_id").isNull()).select(
        "doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2(whole, 256).alias("kept_sha256"), whole.alias("kept"))
    out = out.unionByName(nameless)
    return out if with_text else out.drop("kept")
