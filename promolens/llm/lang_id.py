"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of
a word is the sum, over all its segmentations into pieces, of the product of their probabilities;
the forward algorithm gets it in one pass over the word's end positions. Piece probabilities
are fitted by expectation maximisation (forward-backward) on the words of a bounded sample of
labelled documents: ``TRAIN_DOCS`` for each language, by least hash of the doc_id. Prediction
covers every word of every text; only the pieces of the fit are sent to the tasks.

Words are runs of letters (Unicode L), lower-cased, after a word mark, however long: words over ``LONG`` letters
take the forward pass one by one on logarithms, so that the range of doubles suffices. They teach nothing, only
the fit on its sample leaves them out.

Nulls: a text that is null or has no letters is ``und`` with score 0; so is every text if nothing
could be learned. A null lang teaches nothing. Ties go to the language that is first by code point.
The score is the language's share of the likelihood under equal priors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, slices, small_batches
from .pieces import MODEL, SPACE, load_pieces

TRAIN_DOCS = 600
ROUNDS = 3
LONG = 32
#: Probability mass that is spread evenly, so that an unseen piece is unlikely, not impossible.
FLOOR = 1e-3
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 500_000


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if not all(map(str.isalpha, found)):                    # digits of other kinds (superscripts, fractions, Roman) are no letters
        found = [p for w in found for p in "".join(c if c.isalpha() else " " for c in w).split()]
    return found


def vocabulary(model: str = MODEL) -> list[str]:
    """The fixed pieces: those of letters and the word mark, lower-cased once."""
    plain, _ = load_pieces(model)
    return sorted({p.lower() for _, p, _ in plain if p.strip(SPACE).isalpha() or p == SPACE})


class Lattice:
    """All places of all pieces in a list of words (each after a word mark)."""

    def __init__(self, pieces: list[str]) -> None:
        import ahocorasick

        self.n = len(pieces)
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            self.automaton.add_word(p, i << 6 | len(p))
        self.single = {p for p in pieces if len(p) == 1}
        self.automaton.make_automaton()

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) sorted by end; a letter that is no piece is piece n."""
        joined = "\n".join([SPACE + w for w in words])
        got = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        begin = np.cumsum([0] + [len(w) + 2 for w in words])
        rare = set(joined).difference(self.single, "\n")
        odd = np.array([m.start() for m in re.finditer("[" + re.escape("".join(sorted(rare))) + "]", joined)] if rare else [], np.int64)
        end = np.concatenate([got[:, 0], odd]) + 1
        piece = np.concatenate([got[:, 1] >> 6, np.full(len(odd), self.n)])
        size = np.concatenate([got[:, 1] & 63, np.ones(len(odd), np.int64)])
        word = np.searchsorted(begin, end - 1, "right") - 1
        end = end - begin[word]
        order = np.argsort(end, kind="stable")
        return word[order], (end - size)[order], end[order], piece[order]


def forward(arcs: tuple[np.ndarray, ...], n_words: int, p: np.ndarray) -> np.ndarray:
    """alpha[position, word]: probability of the word's first ``position`` letters over all segmentations.

    With ``p`` [language, piece]: alpha[position, word, language].
    """
    word, start, end, piece = arcs
    many = np.atleast_2d(p)
    n = len(many)
    alpha = np.zeros((int(end.max(initial=0)) + 1, n_words, n))
    alpha[0] = 1.0
    cut = np.searchsorted(end, np.arange(len(alpha) + 1))
    by_piece = np.ascontiguousarray(many.T)
    flat, before = alpha.reshape(-1, n), start * n_words + word
    lang = np.arange(n)
    for t in range(1, len(alpha)):
        s = slice(cut[t], cut[t + 1])
        terms = flat[before[s]] * by_piece[piece[s]]
        alpha[t] = np.bincount((word[s, None] * n + lang).ravel(), terms.ravel(), minlength=n_words * n).reshape(n_words, n)
    return alpha if p.ndim > 1 else alpha[:, :, 0]


def forward_log(arcs: tuple[np.ndarray, ...], log_p: np.ndarray, length: int) -> np.ndarray:
    """Log-probability [language] of one word of ``length`` places: the forward algorithm on logarithms."""
    _, start, end, piece = arcs
    alpha = np.full((length + 1, len(log_p)), -np.inf)
    alpha[0] = 0.0
    cut = np.searchsorted(end, np.arange(length + 2))
    for t in range(1, length + 1):
        s = slice(cut[t], cut[t + 1])
        terms = alpha[start[s]] + log_p[:, piece[s]].T
        top = terms.max(axis=0, initial=-np.inf)
        top = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            alpha[t] = top + np.log(np.exp(terms - top).sum(axis=0))
    return alpha[length]


def fit(words: list[str], counts: np.ndarray, lattice: Lattice, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its words."""
    size = lattice.n + 1
    arcs = lattice.arcs(words)
    word, start, end, piece = arcs
    last = np.array([len(w) + 1 for w in words])
    p = np.bincount(piece, counts[word].astype(float), minlength=size)
    p = (1 - FLOOR) * p / p.sum() + FLOOR / size
    for _ in range(rounds):
        alpha = forward(arcs, len(words), p)
        total = alpha[last, np.arange(len(words))]
        beta = np.zeros_like(alpha)
        beta[last, np.arange(len(words))] = 1.0
        cut = np.searchsorted(end, np.arange(len(alpha) + 1))
        for t in range(len(alpha) - 1, 0, -1):
            s = slice(cut[t], cut[t + 1])
            np.add.at(beta, (start[s], word[s]), beta[t, word[s]] * p[piece[s]])
        used = alpha[start, word] * p[piece] * beta[end, word] / np.maximum(total[word], 1e-300) * counts[word]
        p = np.bincount(piece, used, minlength=size)
        p = (1 - FLOOR) * p / p.sum() + FLOOR / size
    return p


def train(docs: DataFrame, usable: Column, model: str = MODEL, per_lang: int = TRAIN_DOCS) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, probabilities[language, piece])."""
    labelled = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("doc_id", "lang").withColumn("_i", F.row_number().over(by_hash)).where(F.col("_i") <= per_lang).select("doc_id", "lang").distinct()
    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")     # per_lang rows a language
    texts = sample.select("lang", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    counted = texts.select("lang", F.explode("w").alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.toArrow()
    pieces = vocabulary(model)
    lattice = Lattice(pieces)
    lang = np.array(rows["lang"].to_pylist(), dtype=object)
    langs = sorted(set(lang.tolist()))
    probs = []
    for one in langs:
        mine = rows.filter(pa.array(lang == one))
        count: dict[str, int] = {}
        for w, n in zip(mine["w"].to_pylist(), mine["n"].to_pylist(), strict=True):
            for word in words_of(w):
                if len(word) <= LONG:
                    count[word] = count.get(word, 0) + n
        words = sorted(count)
        probs.append(fit(words, np.array([count[w] for w in words]), lattice) if words else np.full(lattice.n + 1, 1 / (lattice.n + 1)))
    return langs, pieces, np.array(probs)


_MADE: dict[int, Lattice] = {}


class Scorer:
    """Log-likelihoods of words in every language, each word once as long as the cache holds it."""

    def __init__(self, pieces: list[str], probs: np.ndarray) -> None:
        self.lattice = _MADE.setdefault(hash(tuple(pieces)), None) or Lattice(pieces)
        _MADE[hash(tuple(pieces))] = self.lattice
        self.probs = probs
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.empty((0, len(self.probs)))

    def add(self, words: list[str]) -> None:
        words, long = [w for w in words if len(w) <= LONG], [w for w in words if len(w) > LONG]
        for w in words + long:
            self.index[w] = len(self.index)
        if words:
            at = np.array([len(w) + 1 for w in words]), np.arange(len(words))
            new = np.log(np.maximum(forward(self.lattice.arcs(words), len(words), self.probs)[at], 1e-300))
            self.table = np.concatenate([self.table, new])
        if long:
            log_p = np.log(self.probs)
            self.table = np.concatenate([self.table, [forward_log(self.lattice.arcs([w]), log_p, len(w) + 1) for w in long]])

    def score(self, docs: list[list[str]]) -> np.ndarray:
        """Log-likelihood [text, language] of the texts' words."""
        flat = [w for d in docs for w in d]
        new = set(flat).difference(self.index)
        if len(self.index) + len(new) > _CACHE_WORDS and self.index:
            self.clear()
            new = set(flat)
        if new:
            self.add(list(new))
        rows = self.table[np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))]
        # Each text's words are added up by themselves, so the sum does not depend on the texts beside it.
        sizes = np.array([len(d) for d in docs], np.int64)
        out = np.zeros((len(docs), rows.shape[1]))
        if len(rows):
            out[sizes > 0] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[sizes > 0], axis=0)
        return out


def predict(docs: DataFrame, langs: list[str], pieces: list[str], probs: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``."""
    small_batches(docs.sparkSession)
    bound = docs.sparkSession.sparkContext.broadcast((pieces, probs)) if langs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*bound.value) if bound else None
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            for i, j in few(texts) if scorer else ():
                for k in range(i, j):
                    if len(texts[k]) > 1 << 21:                 # a long text: part by part
                        sums = [scorer.score([words_of(s)])[0] for s in slices(texts[k])]
                        part, known = [sum(sums)], [any(words_of(s) for s in slices(texts[k]))]
                    else:
                        continue
                    _decide(part, known, k, langs, pred, score)
                short = [k for k in range(i, j) if len(texts[k]) <= 1 << 21]
                lists = [words_of(texts[k]) for k in short]
                for k, ll, w in zip(short, scorer.score(lists), lists, strict=True):
                    _decide([ll], [bool(w)], k, langs, pred, score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def _decide(lls, known, k: int, langs: list[str], pred: list[str], score: np.ndarray) -> None:
    if known[0]:
        ll = np.asarray(lls[0])
        best = int(ll.argmax())
        pred[k], score[k] = langs[best], float(1.0 / np.exp(np.maximum(ll - ll[best], -700)).sum())
