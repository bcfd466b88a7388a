"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of words, which score positive, and tags, which score negative by their name;
the content is the contiguous stretch with the largest sum, found by one linear scan. The weights
come from labelled pages (those that mark their content with exactly one <article>): a structured
perceptron raises and lowers them until the scan finds the marked stretch, on a bounded sample of
``TRAIN_PAGES`` pages by least hash. The tags <article> themselves are never scored. A tag's class
and role tokens add learned weights to it (none if they were never seen).

The same scan goes on inside the stretch, over the elements in it: a label whose elements hold words of the
content less often than others (in ``SEEN`` labelled pages or more) gives each word under it a negative
weight, from the shares of their words; an element of negative sum is cut out of the stretch. So reader comments or a
share bar in the midst of an article go, if labelled pages show what they are called; a label never seen cuts nothing.

What stands inside the stretch but is no content is left out: scripts, styles, the elements ``SKIP``, and
elements with a whole class token of ``SKIP_CLASSES`` or a role of ``SKIP_ROLES``; if such an
element is never closed, only its own tag is. A heading, and an element that holds the <main> or the
longest <article>, is never left out for its own name or labels; an id is no label. Block elements
separate blocks; other tags do not. Character references are decoded, then each stretch of white space of a block
(Unicode's, no-break spaces among it) becomes one space; blocks are trimmed and joined by \\n.

Nulls: a null or empty html has an empty text, like a page without words. A null page_id is passed on.
Markup that breaks off (an unclosed comment, script or tag) ends the page there.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TRAIN_PAGES = 400
EPOCHS = 6
RATE = 0.5
#: By how much the marked stretch has to win, per tag and word.
MARGIN = 3.0
#: Labelled pages in which a label has to occur before it can cut elements out of the stretch.
SEEN = 3
#: Where weights start: a word, and a tag that was never seen.
WORD, TAG = 1.0, -1.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S | re.I)
#: HTML elements that begin a new block (fixed by HTML).
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary
table tbody td tfoot th thead title tr ul""".split())
#: Elements that are never content, and the class tokens and roles (whole, not parts of a name) that say so.
SKIP = frozenset("head title nav footer aside form button select input label menu dialog".split())
SKIP_CLASSES = frozenset("""ad ads advert adverts advertisement adsbygoogle ad-banner ad-container ad-slot ad-unit ad-wrapper banner-ad
nav navbar navigation breadcrumb breadcrumbs pagination masthead
cookie-notice cookie-banner cookie-bar cookie-consent cookie-popup consent-banner""".split())
SKIP_ROLES = frozenset("banner navigation complementary contentinfo menu menubar toolbar search".split())
#: Elements whose own labels never make them skipped.
KEPT = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_SPACE = re.compile(r"\s+")


def labels(attrs: str) -> tuple[str, ...]:
    """'class x' and 'role x' for each token of these attributes (of a repeated attribute the first)."""
    got: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return tuple(f"{k} {x}" for k in ("class", "role") for x in dict.fromkeys(got.get(k, "").lower().split()))


_SKIP_LABELS = frozenset([f"class {x}" for x in SKIP_CLASSES] + [f"role {x}" for x in SKIP_ROLES])


def tokens(page: str) -> list[tuple[str, str, bool, tuple[str, ...]]]:
    """(kind, value, skip, labels): kind is 'text', 'open', 'close' or 'none'; skip: the tag opens what is never content."""
    out, at = [], 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            out.append(("text", page[at:m.start()], False, ()))
        at = m.end()
        name = m[3] or m[6]
        if name:
            name, closing, attrs = name.lower(), (m[2] or m[5]) == "/", m[4] or m[7] or ""
            if closing:
                out.append(("close", name, False, ()))
            else:
                named = labels(attrs) if "=" in attrs else ()
                out.append(("open", name, name in SKIP or name not in KEPT and not _SKIP_LABELS.isdisjoint(named), named))
        else:
            out.append(("none", (m[1] or "!").lower(), False, ()))
    if at < len(page):
        out.append(("text", page[at:], False, ()))
    return out


def _content_marks(toks, ends: dict[int, int]) -> list[int]:
    """Where each <main> opens, and the longest <article> (within a <main>, if there is one)."""
    words = np.append(0, np.cumsum(_sizes(toks)))
    opens = {n: [i for i, t in enumerate(toks) if t[0] == "open" and t[1] == n] for n in ("main", "article")}
    size = lambda i: words[ends.get(i, len(toks))] - words[i]
    inner = [i for i in opens["article"] if not opens["main"] or any(m < i < ends.get(m, len(toks)) for m in opens["main"])]
    return opens["main"] + ([max(inner, key=size)] if inner else [])


def _elements(toks) -> tuple[dict[int, int], set[int]]:
    """Where each closed element ends, by where it opens; and the <header>s of the page itself."""
    stack: dict[str, list[int]] = {}
    page_header: set[int] = set()
    ends: dict[int, int] = {}
    for i, (kind, name, _, _) in enumerate(toks):
        if kind == "open" and name not in VOID:
            stack.setdefault(name, []).append(i)
            if name == "header" and not stack.get("article") and not stack.get("main"):
                page_header.add(i)
        elif kind == "close" and stack.get(name):
            ends[stack[name].pop()] = i
    return ends, page_header


def skipped(toks: list[tuple[str, str, bool, tuple[str, ...]]], weights: dict[str, float] | None = None) -> np.ndarray:
    """Flags the tokens inside elements that are never content and are closed (a <header>: unless it is an article's own).

    With ``weights`` also those inside elements whose words have a negative weight for one of their labels.
    """
    ends, page_header = _elements(toks)
    marks = _content_marks(toks, ends)
    depth = np.zeros(len(toks) + 1, np.int64)
    for j, i in ends.items():
        cut = weights is not None and toks[j][1] not in KEPT and any(f"words {x}" in weights for x in toks[j][3])
        if (toks[j][2] or j in page_header or cut) and not any(j < m < i for m in marks):
            depth[j] += 1
            depth[i + 1] -= 1
    return np.cumsum(depth)[:-1] > 0


def _sizes(toks) -> np.ndarray:
    return np.array([len(v.split()) if k == "text" else 0 for k, v, _, _ in toks])


def _names(toks) -> list[str | None]:
    """The feature of each token: None for <article> and </article>, which mark the labels."""
    return ["" if k == "text" else None if v == "article" else f"{k} {v}" for k, v, _, _ in toks]


def best_stretch(scores: np.ndarray) -> tuple[int, int]:
    """[first, last) of the contiguous tokens with the largest sum; the earliest, then longest; empty if none is positive."""
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores.tolist()):
        if run <= 0.0:
            run, start = 0.0, i
        run += s
        if run > best or (run == best and span[0] == start and best > 0):
            best, span = run, (start, i + 1)
    return span


def score(toks, out: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """The score of each token; what is never content (``out``) neither adds nor takes."""
    word = weights.get("", WORD)
    sizes = _sizes(toks)
    return np.array([0.0 if f is None or out[i] else sizes[i] * word if f == "" else weights.get(f, TAG) + sum(weights.get(x, 0.0) for x in toks[i][3])
                     for i, f in enumerate(_names(toks))])


def train(pages: list[str], epochs: int = EPOCHS) -> dict[str, float]:
    """Weights of words (''), tags and labels from pages that mark their content."""
    known = []
    for page in pages:
        toks = tokens(page)
        opens = [i for i, (k, v, _, _) in enumerate(toks) if (k, v) == ("open", "article")]
        closes = [i for i, (k, v, _, _) in enumerate(toks) if (k, v) == ("close", "article")]
        if len(opens) == len(closes) == 1 and opens[0] < closes[0]:
            known.append((toks, skipped(toks), opens[0] + 1, closes[0]))
    w: dict[str, float] = {"": WORD}
    for _ in range(epochs):
        wrong = 0
        for (toks, out, a, b), margin in ((k, m) for k in known for m in (MARGIN, 0.0)):
            # With a margin, tags inside cost more and words outside earn more than they will. Without it the
            # stretch is the one extracted: a margin may set it apart from the tags that have to fall.
            inside = np.zeros(len(toks), bool)
            inside[a:b] = True
            names, sizes = _names(toks), _sizes(toks)
            words = np.where(out, 0, sizes)
            s, e = best_stretch(score(toks, out, w) - margin * (inside & (words == 0) & ~out) + margin * np.where(inside, 0, words))
            found = np.zeros(len(toks), bool)
            found[s:e] = True
            # Blank text and tags at the edges make no difference to the words found.
            if not words[inside != found].any():
                continue
            wrong += 1
            change: dict[str, float] = {}
            named = {x for t in toks for x in t[3]}
            for i in np.flatnonzero((inside != found) & ~out).tolist():
                sign = 1 if inside[i] else -1
                if names[i] is not None:
                    for f in (names[i], *toks[i][3]):
                        change[f] = change.get(f, 0.0) + sign * (float(sizes[i]) if f == "" else 1.0)
            for f, c in change.items():
                if f:                                       # tags and labels stay negative, words keep their weight as the unit
                    w[f] = float(min(-0.01, w.get(f, 0.0 if f in named else TAG) + RATE * np.sign(c) * max(1.0, abs(change[""]) / len(change))))
        if not wrong:
            break
    return {**w, **_label_words(known)}


def _label_words(known) -> dict[str, float]:
    """'words <label>': twice the share of content in the words of a label's elements, less one, where that is negative."""
    count: dict[str, list[int]] = {}
    for toks, _, a, b in known:
        words = np.append(0, np.cumsum(_sizes(toks)))
        here: dict[str, list[int]] = {}
        for j, i in _elements(toks)[0].items():
            lo, hi = min(max(j, a), b), min(max(i, a), b)
            for x in toks[j][3]:
                one = here.setdefault(x, [0, 0])
                one[0] += int(words[hi] - words[lo])
                one[1] += int(words[i] - words[j])
        for x, (inside, every) in here.items():
            one = count.setdefault(x, [0, 0, 0])
            one[0] += 1
            one[1] += inside
            one[2] += every
    return {f"words {x}": 2.0 * inside / every - 1.0 for x, (pages, inside, every) in count.items()
            if pages >= SEEN and every and 2 * inside < every}


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    toks = tokens(page or "")
    out = skipped(toks, weights)
    first, last = best_stretch(score(toks, out, weights))
    blocks, now = [], []
    for i in range(first, last):
        kind, value, _, _ = toks[i]
        if kind == "text":
            if not out[i]:
                now.append(value)
        elif value in BLOCKS and now:
            blocks.append("".join(now))
            now = []
        elif value == "br":
            now.append(" ")
    blocks.append("".join(now))
    clean = [_SPACE.sub(" ", entities.unescape(b) if "&" in b else b).strip() for b in blocks]
    return "\n".join(b for b in clean if b)


def learn(pages: DataFrame, most: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from the labelled pages of a bounded sample (the least hashes of page_id)."""
    marked = pages.where(F.lower("html").contains("<article") & F.col("page_id").isNotNull())
    ids = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    rows = marked.join(F.broadcast(ids), "page_id").select("page_id", "html").orderBy("page_id", "html").limit(most).collect()   # at most ``most`` pages
    return train([r["html"] for r in rows])


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text for every row of ``pages``."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([extract(x.as_py(), weights) for x in b.column(2)], pa.string())], names=["page_id", "url", "text"])
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string")
