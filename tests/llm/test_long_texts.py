"""Scores and spans do not depend on neighbours, sizes or cuts; discovery of numbers with blanks."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promolens.llm import lang_id, pii_bootstrap, toxicity
from promolens.llm.bytehash import RangeHash


def made(n, seed=5):
    rnd = random.Random(seed)
    return "".join("".join(rnd.choices("abcdéß", k=rnd.randint(1, 9))) + rnd.choice([" ", ", ", "  ", "\n"]) for _ in range(n // 7))


@pytest.mark.parametrize("size", [64, 500, 4097])
def test_parts_keep_all_features(monkeypatch, size):
    whole = set(toxicity.features(np.frombuffer(made(20_000).encode(), np.uint8), RangeHash(1 << 16), 20)[1].tolist())
    monkeypatch.setattr(toxicity, "_SLICE", size)
    assert set(toxicity.text_features(made(20_000).encode(), RangeHash(1 << 16), 20).tolist()) == whole
    for text in (b"", b"x", b"word " * 3, b"w" * 10_000 + b" x y", b"a b " + b"c" * 9000 + b" d e f"):
        whole = set(toxicity.features(np.frombuffer(text, np.uint8), RangeHash(1 << 16), 20)[1].tolist()) if text else set()
        assert set(toxicity.text_features(text, RangeHash(1 << 16), 20).tolist()) == whole, text[:20]


def test_toxicity_score_is_a_function_of_the_text():
    dense = np.random.default_rng(1).normal(size=1 << 20).astype(np.float32)
    dense[::2] = 0
    texts = [made(10, 1), made(3000, 2), made(300_000, 3), made(1_500_000, 4), made(3_000_000, 6), "", "one"]
    score = lambda xs: toxicity._score_texts(pa.array(xs, pa.string()), dense, -0.5, RangeHash(1 << 19), 20)
    alone = [score([x])[0] for x in texts]
    assert score(texts).tolist() == alone and score(texts[::-1]).tolist() == alone[::-1]
    for i, x in enumerate(texts):
        assert score(["word", x, "word"])[1] == alone[i] and score([x, "word"])[0] == alone[i] and score(["word", x])[1] == alone[i]
        feats = np.unique(toxicity.features(np.frombuffer(x.encode(), np.uint8), RangeHash(1 << 19), 20)[1]) if x else np.empty(0, int)
        assert alone[i] == pytest.approx(1 / (1 + np.exp(-np.clip(-0.5 + dense[feats].sum(dtype=np.float64), -700, 700))), rel=1e-9)


def test_ftrl_by_hand():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 64, 6)) for _ in range(200)]
    labels = np.array([float(3 in r or 5 in r) for r in rows])
    w, bias = toxicity.ftrl(rows, labels, bits=6, epochs=2)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        return 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    order = np.random.default_rng(0)
    for _ in range(2):
        for k in order.permutation(200):
            at = [*rows[k].tolist(), 64]
            now = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(now.values()))) - labels[k]
            for i in at:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - sigma * now[i]
                n[i] += g * g
    assert np.allclose(w, [weight(i) for i in range(64)], atol=1e-9) and bias == pytest.approx(weight(64), abs=1e-9) and (w == 0).any() and (w != 0).any()


def test_language_words_and_long_words():
    assert lang_id.words_of("² ½ Ⅷ ٣") == [] and lang_id.words_of("Aa²Bc d_e") == ["aa", "bc", "d", "e"]
    long = "あいうえお" * 12
    assert lang_id.words_of(long) == [long]
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "bab"]
    probs = np.random.default_rng(2).dirichlet(np.ones(len(pieces) + 1), 3)
    scorer = lang_id.Scorer(pieces, probs)
    word = "".join(random.Random(3).choices("abc", k=5000))
    got = scorer.score([[word], ["ab", word, "ba"]])
    for lang in range(3):
        p = dict(zip(pieces, probs[lang], strict=False))
        marked, odd = "▁" + word, probs[lang][-1]
        alpha, scale = [1.0], 0.0
        for t in range(1, len(marked) + 1):
            total = sum(alpha[-k] * (p.get(marked[t - k:t], odd if k == 1 else 0.0)) for k in (1, 2, 3) if t - k >= 0 and len(alpha) >= k)
            alpha.append(total)
            alpha = alpha[-3:]
            if total < 1e-100:
                alpha, scale = [a * 1e100 for a in alpha], scale - 100 * np.log(10)
        assert got[0][lang] == pytest.approx(np.log(alpha[-1]) + scale, rel=1e-9)
    alone = lang_id.Scorer(pieces, probs).score([["ab", word, "ba"]])
    assert alone[0].tolist() == got[1].tolist()


def test_places_of_many_matches(spark):
    rnd = random.Random(7)
    texts = ["", "1", "x1", "".join(rnd.choice(["7", "12 ", "é", "\U0001f600 ", "a"]) for _ in range(3000))] + ["1 " * n for n in (127, 128, 129, 128 * 128, 128 * 128 + 1, 40_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    for r in df.select("i", F.transform(pii_bootstrap.places(F.col("text"), "[0-9]+"), lambda x: F.struct(x["start"], x["end"])).alias("p")).collect():
        assert [tuple(x) for x in r.p] == [m.span() for m in re.finditer("[0-9]+", texts[r.i])], r.i


def luhn(head):
    def total(s):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s)))
    return next(head + str(d) for d in range(10) if total(head + str(d)) % 10 == 0)


def test_numbers_with_blanks_are_learned_and_masked_whole(spark):
    cards = [luhn(f"4111111111{i:05d}") for i in range(20)]
    rows = [(i, f"please call phone: +1 (988) 555-{1000 + i} now") for i in range(20)]
    rows += [(50 + i, f"my card {c[:4]} {c[4:8]} {c[8:12]} {c[12:]} ok") for i, c in enumerate(cards)]
    rows += [(100, "phone: 9885552485"), (101, "my phone: 988 555 2485."), (102, "count 9885552485"), (103, "card 4111 1111 1111 1112 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in pii_bootstrap.mask(df).collect()}
    assert got[0] == "please call phone: <PHONE> now" and got[50] == "my card <CARD> ok"
    assert got[100] == "phone: <PHONE>" and got[101] == "my phone: <PHONE>." and got[102] == "count 9885552485" and got[103] == "card <CARD> x"


def test_work_grows_with_the_numbers_of_a_text(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, ", ".join(str(10007 * i % 99991) for i in range(n)))], "doc_id long, text string")
        begin = time.monotonic()
        size = df.select(F.size(pii_bootstrap.candidates(F.col("text"))).alias("n"), F.size(pii_bootstrap.base_spans(F.col("text")))).first()["n"]
        return size, time.monotonic() - begin
    seconds(1000)
    small, large = seconds(20_000), seconds(160_000)
    assert (small[0], large[0]) == (20_000, 160_000) and large[1] < 60 and large[1] < 25 * max(small[1], 0.5)


def test_masking_of_many_spans(spark):
    rnd = random.Random(11)
    rows = []
    for n in (1, 127, 128, 129, 300, 128 * 128, 128 * 128 + 1, 40_000):
        text = "".join(rnd.choice("abé😀7 ") for _ in range(4 * n + 5))
        spans, at = [], 0
        for _ in range(n):
            start = max(0, at + rnd.randrange(-2, 4))
            end = min(start + rnd.randrange(1, 4), len(text))
            spans.append((rnd.randrange(4), start, end))
            at = end
        rnd.shuffle(spans)
        rows.append((len(rows), text, [s for s in spans if s[1] < s[2]]))
    rows.append((len(rows), "none", []))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<kind:int,start:int,end:int>>")
    got = {r.i: r.t for r in df.select("i", pii_bootstrap.masked(F.col("text"), F.col("spans")).alias("t")).collect()}
    for i, text, spans in rows:
        out, at = [], 0
        for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
            if start >= at:
                out += [text[at:start], f"<{pii_bootstrap.KINDS[kind].upper()}>"]
            at = max(at, end)
        assert got[i] == "".join(out) + text[at:], i


def test_masking_grows_with_the_spans_of_a_text(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, ", ".join(f"10.{i % 200}.7.{i % 251}" for i in range(n)))], "doc_id long, text string")
        begin = time.monotonic()
        masked = pii_bootstrap.masked(F.col("text"), pii_bootstrap.base_spans(F.col("text")))
        return df.select(F.regexp_count(masked, F.lit("<IP>")).alias("n")).first()["n"], time.monotonic() - begin
    seconds(1000)
    small, large = seconds(20_000), seconds(160_000)
    assert (small[0], large[0]) == (20_000, 160_000) and large[1] < 60 and large[1] < 25 * max(small[1], 0.5)
