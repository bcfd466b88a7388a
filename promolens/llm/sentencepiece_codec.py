"""SentencePiece encoding and decoding: Viterbi over the matches of an Aho-Corasick automaton.

The automaton over the pieces reads a text once. At every position it follows the output links
from the longest piece that ends there to the shortest, and each relaxes the best score of
the position. The best path is the segmentation with the largest sum of the model's scores; of equal
ones the one whose last piece is longest. A character that is no piece becomes its UTF-8 bytes'
pieces (score: ten below the least), or the unknown id if the model has no byte pieces.

Spaces become the word mark and one mark is put in front, as the model's normaliser does; nothing
else is changed, so decoding gives the text back exactly. A word mark that stands in the text itself is
encoded as bytes. No piece holds a mark after another character or a character such as a line feed beside
others (checked when the pieces are read), so the best path of a text is made of the best paths of its
stretches between those places; a stretch is segmented once and remembered.

Nulls: a null text has no tokens and decodes to an empty text. An empty text has none either.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, small_batches
from .pieces import MODEL, SPACE, load_pieces

UNKNOWN = 0
#: Stands for a word mark of the text itself while its spaces are marks (a lone surrogate, so in no piece and no column).
_OWN_MARK = "\ud800"
_CACHE = 400_000


class Codec:
    """Encodes and decodes with one model's pieces."""

    def __init__(self, plain: list[tuple[int, str, float]], byte: dict[int, int]) -> None:
        self.ids, self.score, self.length = [0], [0.0], [0]
        self.byte = byte
        self.goto: dict[int, int] = {}                  # node << 21 | character
        own: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[]]
        for i, piece, score in plain:
            node = 0
            for ch in piece:
                key = node << 21 | ord(ch)
                nxt = self.goto.get(key)
                if nxt is None:
                    nxt = self.goto[key] = len(children)
                    children[node].append((ord(ch), nxt))
                    children.append([])
                node = nxt
            own[node] = len(self.ids)
            self.ids.append(i)
            self.score.append(score)
            self.length.append(len(piece))
        self.fail = [0] * len(children)
        #: The longest piece that ends in a node (0: none), and for each piece the next shorter one.
        self.first = [0] * len(children)
        self.shorter = [0] * len(self.ids)
        queue = [n for _, n in children[0]]
        for n in queue:
            self.first[n] = own.get(n, 0)
        for node in queue:
            for ch, n in children[node]:
                f = self.fail[node]
                while f and (f << 21 | ch) not in self.goto:
                    f = self.fail[f]
                self.fail[n] = self.goto.get(f << 21 | ch, 0)
                behind = self.first[self.fail[n]]
                mine = own.get(n, 0)
                if mine:
                    self.shorter[mine] = behind
                self.first[n] = mine or behind
                queue.append(n)
        self.unknown = min((s for s in self.score if s > -1e8), default=0.0) - 10.0
        joined = any(SPACE in p.lstrip(SPACE) for _, p, _ in plain)
        feed = any("\n" in p for _, p, _ in plain)
        # Where stretches may be cut; with pieces that cross marks a text is one stretch.
        self.stretch = re.compile(r"(?s:.+)") if joined else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if feed else f"\\n|{SPACE}*[^{SPACE}\\n]+|{SPACE}+")
        self.parts: list[bytes] = []
        top = max([i for i, _, _ in plain] + list(byte.values()) + [UNKNOWN]) + 1
        table = [b""] * top
        for i, piece, _ in plain:
            table[i] = piece.replace(SPACE, " ").encode()
        for b, i in byte.items():
            table[i] = bytes([b])
        self.sizes = np.array([len(b) for b in table])
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = array("i")
        self.ends = array("q", [0])

    def viterbi(self, s: str) -> list[int]:
        """Token ids of the best segmentation of one stretch."""
        goto, fail, first, shorter, score, length = self.goto, self.fail, self.first, self.shorter, self.score, self.length
        best, back, node = [0.0], [0], 0
        for i, ch in enumerate(s, 1):
            code = ord(ch)
            nxt = goto.get(node << 21 | code)
            while nxt is None and node:
                node = fail[node]
                nxt = goto.get(node << 21 | code)
            node = nxt or 0
            top, arg, size = float("-inf"), 0, 0
            piece = first[node]
            while piece:
                size = length[piece]
                value = best[i - size] + score[piece]
                if value > top:
                    top, arg = value, piece
                piece = shorter[piece]
            if size != 1:                                  # no piece for the character alone
                value = best[i - 1] + self.unknown
                if value > top:
                    top, arg = value, 0
            best.append(top)
            back.append(arg)
        out, i = [], len(s)
        while i:
            piece = back[i]
            if piece:
                out.append(self.ids[piece])
                i -= length[piece]
            else:
                i -= 1
                raw = (SPACE if s[i] == _OWN_MARK else s[i]).encode("utf-8", "surrogatepass")
                out += [self.byte[b] for b in reversed(raw)] if self.byte else [UNKNOWN]
        out.reverse()
        return out

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in a row, and the n + 1 offsets of the texts."""
        lists = []
        for t in texts:
            t = SPACE + t.replace(SPACE, _OWN_MARK).replace(" ", SPACE) if t else ""
            lists.append(self.stretch.findall(t))
        flat = [x for one in lists for x in one]
        new = set(flat).difference(self.index)
        if len(self.index) + len(new) > _CACHE and self.index:
            self.forget()
            new = set(flat)
        for x in new:
            self.index[x] = len(self.index)
            self.flat.extend(self.viterbi(x))
            self.ends.append(len(self.flat))
        ends = np.frombuffer(self.ends, np.int64).copy()
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        size = ends[at + 1] - ends[at]
        total = np.append(0, np.cumsum(size))
        ids = np.frombuffer(self.flat, np.int32)[np.repeat(ends[at] - total[:-1], size) + np.arange(total[-1])] if len(at) else np.empty(0, np.int32)
        return ids, total[np.cumsum([0] + [len(x) for x in lists])]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text or ""])[0].tolist()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of token ids; bytes that are no UTF-8 become replacement characters."""
        ids = np.asarray(ids, np.int64)
        size = self.sizes[ids]
        total = np.cumsum(size)
        raw = self.bytes[np.repeat(self.begin[ids] - (total - size), size) + np.arange(total[-1])].tobytes() if len(ids) else b""
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_MADE: dict[str, Codec] = {}


def _codec(plain, byte, key: str) -> Codec:
    if key not in _MADE:
        _MADE[key] = Codec(plain, byte)
    return _MADE[key]


def encode(docs: DataFrame, model: str = MODEL, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), round_trip: whether decoding gave the text back."""
    small_batches(docs.sparkSession)
    plain, byte = load_pieces(model)
    sent = docs.sparkSession.sparkContext.broadcast((plain, byte))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*sent.value, model)
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            for i, j in few(texts):
                ids, ends = codec.encode_all(texts[i:j])
                back = [codec.decode(ids[s:e]) == t for s, e, t in zip(ends[:-1], ends[1:], texts[i:j], strict=True)] if check else [None] * (j - i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(back, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    small_batches(tokens.sparkSession)
    plain, byte = load_pieces(model)
    sent = tokens.sparkSession.sparkContext.broadcast((plain, byte))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*sent.value, model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
