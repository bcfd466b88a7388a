"""Phrase collocation mining by direct-address tiling.

1. Texts are cut into pieces and words and dealt to chunks of a bounded number of words; a chunk codes
   its words by a dictionary of its own. Only the dictionaries (each word once per chunk) are shuffled
   to count words; words with at least ``least`` occurrences get ids in order of frequency.
2. Both axes of the matrix (first part, next word) are cut into blocks: blocks of 1,024 ids for the
   first 16,384, one block for every doubling after that. A tile is a pair of blocks. Each chunk sends the
   pairs it holds, counted, to their tiles. A tile of two small blocks is dense and counted by address
   with ``bincount``; any other is sparse and counted as a sorted list of coordinates.
3. Pairs with at least ``least`` occurrences are ranked by frequency; their ranks go back to the chunks
   that hold them, and the same tiling counts (pair, next word), only where both pairs within are frequent.

Work is bounded per task: a tile whose blocks have many occurrences is split into pieces beforehand (a
sparse one by its cells, a dense one by chunks; the partial sums of the latter are added by a
``groupBy``), so no word, pair or language, however frequent, is one task. Counts are exact integers,
scores exact decimals. Phrases never cross a piece or a document.

Nulls and edges: a null lang is ``und`` (together with a lang of that name); a null or empty text has no
words; doc_id and other columns are not read, so repeated rows count again; an empty table gives an empty
result; a text longer than a chunk is cut between words, and the next chunk starts with the two words
before the cut, so nothing is lost. Ties are settled by the order stated at :func:`phrases`.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import mix
from .common import drop_stored, pack, partitions, small_batches, store, unpack

#: Occurrences that make a candidate, candidates reported per language, and the percentage of a candidate's
#: occurrences within a longer one that drops it.
LEAST, TOP, WITHIN = 10, 2000, 50
UNKNOWN = "und"
#: Words of a chunk; bytes of text split at once.
CHUNK, SLICE = 1 << 21, 1 << 20
#: Blocks of ids: width and number of the even ones. Entries that one piece of a tile is meant to hold at most.
WIDTH_BITS, EVEN = 10, 16
BLOCKS = 64
PIECE = 1 << 22
#: Ids are packed two to a 64-bit key.
ID_BITS = 31
ID_MASK = (1 << ID_BITS) - 1

# Fixed values of the contract: letters lowered, and the characters that end a piece.
_BREAK = b"\xff"                                   # no byte of UTF-8 text
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 0x20 if c == 0x09 else 0xFF if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))


# --- words -----------------------------------------------------------------------------------------

class _Coder:
    """The words of one language in a task, as ids of a chunk's own dictionary (0 ends a piece)."""

    def __init__(self, lang: str, carried: list[bytes] = ()) -> None:
        self.lang, self.ids, self.size, self.skip = lang, [], 0, len(carried)
        self.known = defaultdict(count().__next__)
        self.known[_BREAK]
        if carried:
            self.put(list(carried))

    def put(self, words: list[bytes]) -> None:
        if not words:
            return
        self.ids.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self) -> tuple:
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int32)
        counts = np.bincount(ids[self.skip:], minlength=len(self.known))[1:]
        return self.lang, self.skip, zstandard.compress(ids.tobytes(), 1), list(self.known)[1:], counts

    def tail(self) -> list[bytes]:
        """The last words (two at most) of a piece that is not at its end."""
        ids = np.concatenate(self.ids[-3:])[-2:].tolist() if self.ids else []
        if 0 in ids:
            ids = ids[len(ids) - ids[::-1].index(0):]
        words = list(self.known)
        return [words[i] for i in ids]


def _code(chunk: int, slice_: int):
    def run(batches):
        first, made = TaskContext.get().partitionId() << 32, count()
        coders: dict[str, _Coder] = {}

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([first + next(made) for _ in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()),
                 pa.array([r[3] for r in rows], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                 pa.array([r[4] for r in rows], pa.list_(pa.int64()))], names=["lang", "chunk", "skip", "ids", "words", "counts"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                data = text.as_py()
                if not data:
                    continue
                data = data.translate(_BYTES)
                coder = coders.setdefault(lang, _Coder(lang))
                start = 0
                while start < len(data):
                    end = len(data)
                    if end - start > slice_:       # the cut stands before a space or a break
                        cuts = [p for p in (data.find(b" ", start + slice_), data.find(_BREAK, start + slice_)) if p >= 0]
                        end = min(cuts, default=end)
                    coder.put(data[start:end].replace(_BREAK, b" \xff ").split())
                    start = end
                    if coder.size >= chunk and start < len(data):
                        yield out([coder.row()])
                        coder = coders[lang] = _Coder(lang, coder.tail())
                coder.put([_BREAK])
                if sum(c.size for c in coders.values()) >= chunk:
                    yield out([c.row() for c in coders.values()])
                    coders = {}
        if coders:
            yield out([c.row() for c in coders.values()])
    return run


_CODED = "lang string, chunk long, skip int, ids binary, words array<string>, counts array<long>"


def ranked(df: DataFrame, frequency: str, *ties: str) -> DataFrame:
    """``df`` with id: 0, 1, ... within each lang by falling ``frequency``, then ``ties``.

    Range partitions are numbered each by itself and moved by the rows before them.
    """
    order = [F.col(frequency).desc(), *ties]
    dealt = store(df.repartitionByRange(partitions(df.sparkSession), "lang", *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("part", "lang").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", "lang", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part", "lang").orderBy(*order)) - 1
    out = store(dealt.withColumn("id", place.cast("long")).join(before, ["part", "lang"])
                .withColumn("id", F.col("id") + F.col("before")).drop("part", "before"), "ranks")
    drop_stored(dealt)
    return out


# --- tiles -----------------------------------------------------------------------------------------

def block(ids: np.ndarray) -> np.ndarray:
    """Block of each id: even blocks first, then one for every doubling."""
    doubling = np.frexp(np.maximum(ids, 1).astype(np.float64))[1] - 1
    return np.where(ids < EVEN << WIDTH_BITS, ids >> WIDTH_BITS, doubling - WIDTH_BITS - (EVEN.bit_length() - 1) + EVEN)


def _block_column(i: Column) -> Column:
    doubling = F.length(F.bin(i)) - 1
    return F.when(i < EVEN << WIDTH_BITS, F.shiftright(i, WIDTH_BITS)).otherwise(doubling - WIDTH_BITS - (EVEN.bit_length() - 1) + EVEN).cast("int")


def _masses(ids: DataFrame, frequency: str) -> np.ndarray:
    """Occurrences of each block, the most of any language: at most ``BLOCKS`` numbers to the driver."""
    per = ids.groupBy("lang", _block_column(F.col("id")).alias("b")).agg(F.sum(frequency).alias("m")).groupBy("b").agg(F.max("m").alias("m"))
    out = np.zeros(BLOCKS, np.int64)
    for r in per.collect():
        out[r["b"]] = r["m"]
    return out


def _pieces(left: np.ndarray, right: np.ndarray, piece: int) -> np.ndarray:
    """Pieces of each tile: a tile has no more occurrences than either of its blocks."""
    return np.maximum(1, -(-np.minimum(left[:, None], right[None, :]) // piece)).ravel()


def _is_dense(tile):
    return (tile // BLOCKS < EVEN) & (tile % BLOCKS < EVEN)


def _cells(keys: np.ndarray, pieces: np.ndarray, chunk: int | None) -> tuple[np.ndarray, np.ndarray]:
    """tile, sub of each key; of a dense tile the piece of the chunk."""
    tile = block(keys >> ID_BITS) * BLOCKS + block(keys & ID_MASK)
    by_cell = mix(keys.astype(np.uint64)) % pieces[tile].astype(np.uint64)
    by_chunk = mix(np.array([0 if chunk is None else chunk], np.uint64)) % pieces[tile].astype(np.uint64)
    return tile, np.where(_is_dense(tile), by_chunk, by_cell).astype(np.int64)


def _tile_rows(lang: str, chunk: int, left: np.ndarray, right: np.ndarray, pieces: np.ndarray, before: int = 0) -> list[tuple]:
    """(lang, chunk, tile, sub, data) of the counted pairs of a chunk; the first ``before`` pairs count 0.

    These were counted by the chunk before, but this one has to know whether they are frequent.
    """
    key = left.astype(np.int64) << ID_BITS | right
    keys, counts = np.unique(key, return_counts=True)
    if not len(keys):
        return []
    np.subtract.at(counts, np.searchsorted(keys, key[:before]), 1)
    tile, sub = _cells(keys, pieces, chunk)
    order = np.lexsort((keys, sub, tile))
    keys, counts, tile, sub = keys[order], counts[order], tile[order], sub[order]
    cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(sub) != 0)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
    return [(lang, chunk, int(tile[s]), int(sub[s]), pack(keys[s:e], counts[s:e])) for s, e in zip(starts, ends, strict=True)]


def _table(rows: list[tuple], names: list[str], types: list) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})


_SENT = "lang string, chunk long, tile int, sub int, skip int, data binary, sequence boolean"


def _sent(rows: list[tuple]) -> pa.Table:
    return _table([(*r, r[2] < 0) for r in rows], ["lang", "chunk", "tile", "sub", "skip", "data", "sequence"],
                  [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()])


def _send_words(pieces: np.ndarray):
    """A chunk's words under their global ids (tile -1: the sequence itself) and its pairs by tile."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for lang, chunk, skip, data in zip(*(left[c].to_pylist() for c in ("lang", "chunk", "skip", "ids")), strict=True):
            own = np.frombuffer(zstandard.decompress(data), np.int32)
            to = np.full(int(own.max(initial=0)) + 1, -1, np.int64)
            at = right["own"].to_numpy()
            seen = at < len(to)
            to[at[seen]] = right["id"].to_numpy()[seen]
            ids = to[own]
            out.append((lang, chunk, -1, 0, skip, zstandard.compress(ids.astype(np.int32).tobytes(), 1)))
            p = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            out += [(*r[:4], 0, r[4]) for r in _tile_rows(lang, chunk, ids[p], ids[p + 1], pieces, int((p + 1 < skip).sum()))]
        return _sent(out)
    return run


def _send_pairs(pieces: np.ndarray):
    """A chunk's (pair, next word) by tile, where both pairs within are frequent."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        known = [unpack(d, 2) for d in right["data"].to_pylist()]
        keys, ranks = (np.concatenate([k[i] for k in known]) if known else np.empty(0, np.int64) for i in (0, 1))
        order = np.argsort(keys)
        keys, ranks = keys[order], ranks[order]
        for lang, chunk, skip, data in zip(*(left[c].to_pylist() for c in ("lang", "chunk", "skip", "data")), strict=True):
            ids = np.frombuffer(zstandard.decompress(data), np.int32).astype(np.int64)
            if len(ids) < 3 or not len(keys):
                continue
            pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] << ID_BITS | ids[1:], -1)
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            rank = np.where(keys[at] == pair, ranks[at], -1)
            p = np.flatnonzero((rank[:-1] >= 0) & (rank[1:] >= 0))
            p = p[p + 2 >= skip]
            out += [(*r[:4], 0, r[4]) for r in _tile_rows(lang, chunk, rank[p], ids[p + 2], pieces)]
        return _sent(out)
    return run


def _count_tile(pieces: np.ndarray, least: int):
    """The cells of one piece of a tile: dense by address, else as sorted coordinates."""
    def run(key, t):
        lang, tile = key[0].as_py(), key[1].as_py()
        split = bool(_is_dense(tile)) and pieces[tile] > 1
        parts = [unpack(d, 2) for d in t["data"].to_pylist()]
        keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        del parts
        if _is_dense(tile):
            width = 1 << WIDTH_BITS
            row, col = (tile // BLOCKS) * width, (tile % BLOCKS) * width
            grid = np.bincount(((keys >> ID_BITS) - row) * width + ((keys & ID_MASK) - col), weights=counts, minlength=width * width)
            cell = np.flatnonzero(grid)
            left, right, n = row + cell // width, col + cell % width, grid[cell].astype(np.int64)
        else:
            order = np.argsort(keys, kind="stable")            # runs that are sorted already
            keys, counts = keys[order], counts[order]
            start = np.flatnonzero(np.r_[True, np.diff(keys) != 0])
            n = np.add.reduceat(counts, start)
            left, right = keys[start] >> ID_BITS, keys[start] & ID_MASK
        if not split:
            keep = n >= least
            left, right, n = left[keep], right[keep], n[keep]
        return pa.table({"lang": pa.array([lang] * len(n), pa.string()), "i": pa.array(left, pa.int64()), "j": pa.array(right, pa.int64()),
                         "a": pa.array(n, pa.int64()), "whole": pa.array(np.full(len(n), not split))})
    return run


def _frequent(sent: DataFrame, pieces: np.ndarray, least: int) -> DataFrame:
    """lang, i, j, a of all cells with at least ``least`` occurrences."""
    counted = store(sent.where("NOT sequence").select("lang", "tile", "sub", "data").groupBy("lang", "tile", "sub")
                    .applyInArrow(_count_tile(pieces, least), "lang string, i long, j long, a long, whole boolean"), "cells")
    added = counted.where("NOT whole").groupBy("lang", "i", "j").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return counted.where("whole").select("lang", "i", "j", "a").unionByName(added)


def _placed(pieces: np.ndarray):
    """Frequent pairs at every piece of their tile that may hold them."""
    def run(batches):
        for b in batches:
            keys = b.column(1).to_numpy() << ID_BITS | b.column(2).to_numpy()
            tile, sub = _cells(keys, pieces, None)
            times = np.where(_is_dense(tile), pieces[tile], 1)
            row = np.repeat(np.arange(len(keys)), times)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            sub = np.where(_is_dense(tile)[row], nth, sub[row])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(tile[row], pa.int32()), pa.array(sub, pa.int32()),
                                              pa.array(keys[row], pa.int64()), b.column(3).take(pa.array(row))], names=["lang", "tile", "sub", "key", "id"])
    return run


def _hand_back(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each chunk of a tile: its frequent keys and their ranks."""
    keys, ranks = right["key"].to_numpy(), right["id"].to_numpy()
    order = np.argsort(keys)
    keys, ranks = keys[order], ranks[order]
    out = []
    for lang, chunk, data in zip(*(left[c].to_pylist() for c in ("lang", "chunk", "data")), strict=True):
        if not len(keys):
            break
        own = unpack(data, 2)[0]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = keys[at] == own
        if hit.any():
            out.append((lang, chunk, pack(own[hit], ranks[at[hit]])))
    return _table(out, ["lang", "chunk", "data"], [pa.string(), pa.int64(), pa.binary()])


# --- counts and scores ---------------------------------------------------------------------------------

def _cogroup(left: DataFrame, right: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    right = right.toDF(*right.columns)                  # names of its own where both sides come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)


def counted_phrases(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK, piece: int = PIECE, slice_: int = SLICE) -> tuple[DataFrame, ...]:
    """words (lang, word, f, id), pairs (lang, i, j, a, id), triples (lang, p, k, a), sizes (lang, n).

    i, j, k are ids of words and p ids of pairs, by falling frequency within the language.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    coded = store(texts.mapInArrow(_code(chunk, slice_), _CODED), "coded")
    sizes = coded.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    entries = (coded.select("lang", "chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("own", "e"))
               .select("lang", "chunk", (F.col("own") + 1).alias("own"), F.col("e.words").alias("word"), F.col("e.counts").alias("c")))
    words = ranked(entries.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least), "f", "word")
    if (words.agg(F.max("id")).first()[0] or 0) > ID_MASK:
        raise ValueError("more frequent words in a language than ids have bits")
    word_mass = _masses(words, "f")
    pieces = _pieces(word_mass, word_mass, piece)
    coding = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).select("lang", "chunk", "own", "id")
    sent = store(_cogroup(coded.select("lang", "chunk", "skip", "ids"), coding, ["lang", "chunk"], _send_words(pieces), _SENT), "pairs-sent", ["sequence"])
    pairs = ranked(_frequent(sent, pieces, least), "a", "i", "j")
    if (pairs.agg(F.max("id")).first()[0] or 0) > ID_MASK:
        raise ValueError("more frequent pairs in a language than ids have bits")
    places = pairs.select("lang", "i", "j", "id").mapInArrow(_placed(pieces), "lang string, tile int, sub int, key long, id long")
    back = _cogroup(sent.where("NOT sequence").select("lang", "tile", "sub", "chunk", "data"), places, ["lang", "tile", "sub"], _hand_back,
                    "lang string, chunk long, data binary")
    deeper = _pieces(_masses(pairs, "a"), word_mass, piece)
    sent3 = store(_cogroup(sent.where("sequence").select("lang", "chunk", "skip", "data"), back, ["lang", "chunk"], _send_pairs(deeper), _SENT), "triples-sent")
    triples = store(_frequent(sent3, deeper, least).withColumnsRenamed({"i": "p", "j": "k"}), "triples")
    sizes = store(sizes, "sizes")
    drop_stored(coded, sent, sent3)
    return words, pairs, triples, sizes


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)), exactly: all below 10**14, so that products stay within 38 digits."""
    d = lambda c: F.col(c).cast("decimal(14,0)")
    return F.call_function("div", d(a) * d(a) * F.lit(1_000_000).cast("decimal(7,0)"), d(left) * d(right)).cast("long")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, within: int = WITHIN, **sizing) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two and three words of each language.

    a is the phrase's count and l, r those of its two parts at the lowest-scoring cut (the first of equals);
    a candidate with ``within`` percent of its occurrences inside one longer candidate is left out. Order:
    score, a, both falling, then the phrase by its UTF-8 bytes.
    """
    words, pairs, triples, sizes = counted_phrases(docs, least, **sizing)
    f = words.select("lang", "id", "f")
    part = lambda name, to: f.select("lang", F.col("id").alias(name), F.col("f").alias(to))
    inner = pairs.select("lang", F.col("i").alias("j"), F.col("j").alias("k"), F.col("a").alias("a_jk"), F.col("id").alias("q"))
    three = store(triples.join(pairs.select("lang", F.col("id").alias("p"), "i", "j", F.col("a").alias("a_ij")), ["lang", "p"])
                  .join(inner, ["lang", "j", "k"]).join(part("i", "f_i"), ["lang", "i"]).join(part("k", "f_k"), ["lang", "k"])
                  .withColumn("s1", _score("a", "f_i", "a_jk")).withColumn("s2", _score("a", "a_ij", "f_k")), "threes")
    first = F.col("s1") <= F.col("s2")
    longest = (three.select("lang", F.explode(F.array("p", "q")).alias("id"), F.col("a").alias("m"))
               .groupBy("lang", "id").agg(F.max("m").alias("m")))
    two = (pairs.join(longest, ["lang", "id"], "left").where(F.col("m").isNull() | (F.col("m") * 100 < F.col("a") * within))
           .join(part("i", "l"), ["lang", "i"]).join(part("j", "r"), ["lang", "j"])
           .select("lang", "i", "j", F.lit(None).cast("long").alias("k"), "a", "l", "r", _score("a", "l", "r").alias("score")))
    three = three.select("lang", "i", "j", "k", "a", F.when(first, F.col("f_i")).otherwise(F.col("a_ij")).alias("l"),
                         F.when(first, F.col("a_jk")).otherwise(F.col("f_k")).alias("r"), F.least("s1", "s2").alias("score"))
    by_score = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    best = store(two.unionByName(three).withColumn("rank", F.rank().over(by_score)).where(F.col("rank") <= top).drop("rank"), "best")
    spelt = reduce(lambda df, c: df.join(words.select("lang", F.col("id").alias(c), F.col("word").alias(f"w_{c}")), ["lang", c], "left"),
                   ("i", "j", "k"), best)
    spelt = spelt.withColumn("phrase", F.concat_ws(" ", "w_i", "w_j", "w_k")).join(sizes, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return (spelt.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
