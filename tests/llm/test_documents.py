"""The operators on documents against brute force, and their edge cases."""

import hashlib
import pathlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promolens.llm import common, lang_id, mixing, pii_bootstrap, sentencepiece_codec, simhash_ball, suffix_dedup, toxicity
from promolens.llm.common import held_out
from promolens.llm.components import connected
from promolens.llm.pieces import MODEL, load_pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _h string, part int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), "x", 1) for d, t, s in rows], DOCS).repartition(4)


def union_find(ids, pairs):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def repeats(rows, w=50):
    first, out = {}, []
    for d, t, _ in rows:
        b = (t or "").encode()
        for i in range(len(b) - w + 1) if d is not None else ():
            first[b[i:i + w]] = min(first.get(b[i:i + w], d), d)
    for d, t, _ in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - w + 1) if d is not None else ():
            if first[b[i:i + w]] < d:
                covered[i:i + w] = b"\1" * w
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((d, len(b), sum(covered), sum(bool(r) for r in bytes(covered).split(b"\0")), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed=5):
    rnd = random.Random(seed)
    words = ["the", "of", "être", "alpha", "beta", "x", "y1", "zzz", "gamma", "delta"]
    shared = [" ".join(rnd.choice(words) for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [rnd.choice(shared)[rnd.randrange(60):rnd.randrange(60, 150)] + " ".join(rnd.choice(words) for _ in range(rnd.randrange(8))) for _ in range(rnd.randrange(6))]
        rows.append((i, "".join(parts), f"s{i % 3}"))
    return rows + [(None, shared[0], None), (7, shared[1], "s1"), (200, None, "s1"), (201, "", None), (202, "a" * 3000, "s0"),
                   (203, "ab" * 900, "s0"), (204, "a" * 70, "s0"), (3, rows[3][1], "s0"), (206, shared[2], "s9"), (207, shared[2], "s9")]


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup(spark, hot):
    rows = passages()
    got = suffix_dedup.remove_repeats(frame(spark, rows), group_bytes=5000, hot=hot, range_rows=500, block=300).collect()
    assert sorted((tuple(r) for r in got), key=str) == repeats(rows)


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup_of_a_line_in_many_documents(spark, hot):
    line = "-" * 80 + "\n"
    rows = [(d, t + line * (i % 3) + f"{i} " + ("=-" * 45 + f"{i}x") * (i % 2) + line + " " * (i % 70), s) for i, (d, t, s) in enumerate((d, t or "", s) for d, t, s in passages(9))]
    rows += [(500, "abc" * 700 + "x" + "abc" * 30, "s"), (501, "zabc" + "abc" * 400, "s"), (40, " " * 400 + "end", "s")]
    got = suffix_dedup.remove_repeats(frame(spark, rows), group_bytes=5000, hot=hot, range_rows=500, block=300, heavy=20).collect()
    assert sorted((tuple(r) for r in got), key=str) == repeats(rows)


def test_suffix_dedup_deletes_stored_anchors_round_by_round(spark, monkeypatch):
    """Once stored, the anchors of a few hash ranges at a time are shuffled, and none of them stay behind."""
    sizes, stored = [], []

    def live(df):
        folders = {f.rsplit("/kind=", 1)[0] for f in df.inputFiles()}
        return sum(p.stat().st_size for x in folders for p in pathlib.Path(x.removeprefix("file:")).glob("kind=0/**/*.parquet"))

    def store(df, name, *how):
        if name == "spans":
            sizes.append(live(stored[0]))
        out = common.store(df, name, *how)
        stored.extend([out] * (name == "anchors"))
        if name == "contexts":
            sizes.append(live(stored[0]))
        return out

    monkeypatch.setattr(suffix_dedup, "store", store)
    rows = passages()
    group_bytes = sum(len((t or "").encode()) for _, t, _ in rows) // 70
    got = suffix_dedup.remove_repeats(frame(spark, rows), group_bytes=group_bytes, range_rows=500, block=300, heavy=50).collect()
    assert sorted((tuple(r) for r in got), key=str) == repeats(rows)
    assert len(sizes) == 6 and sizes[-1] == 0 and sorted(sizes, reverse=True) == sizes
    assert max(a - b for a, b in zip(sizes, sizes[1:], strict=False)) < sizes[0] / 2


def test_settled_anchors_pass_no_hash_range_and_runs_are_counted():
    blanks = np.frombuffer(b" " * 100_000 + b"-=" * 500, np.uint8)
    h, c, at, n, times = suffix_dedup.anchors(blanks, np.array([0, 100_000, 101_000]), 50)
    assert len(h) < 10 and (n * times).sum() == 99_951 + 951
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": ["-" * 80] * 300})
    (got,) = suffix_dedup._map_anchors(50, 7, 1 << 17)([batch])
    rows = got.to_pylist()
    assert sum(r["n"] for r in rows if r["kind"] == 0) == 1 and sum(r["n"] for r in rows) == 300
    for r in rows:
        doc, _, a, n, times = suffix_dedup.unpack(r["body"], 5)
        assert (a == 0).all() and (n * times == 31).all() and (r["kind"] == 0 or (suffix_dedup._group(doc, 7) == r["part"]).all())
    live = pa.Table.from_pylist([{**r, "salt": 0} for r in rows if r["kind"] == 0] * 3)
    assert pa.table(suffix_dedup._reduce(7)(live))["n"].to_pylist() == [3]          # one document's own


def test_multikey_sort_finds_what_smaller_documents_have():
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 2, 4000).astype(np.uint8)
    at, doc = np.arange(3900), rng.integers(0, 9, 3900)
    least = {}
    for i in at:
        w = buf[i:i + 11].tobytes()
        least[w] = min(least.get(w, 99), doc[i])
    assert suffix_dedup.repeated_windows(buf, at, doc, 11).tolist() == [bool(doc[i] > least[buf[i:i + 11].tobytes()]) for i in at]


def test_simhash(spark):
    rows = passages() + [(300, "One two", "s"), (301, "ONE\ttwo ", "s"), (302, " \n", "s")]
    fp = {}
    for d, t, _ in rows:
        fp.setdefault(d, set()).add(simhash_ball.fingerprint(t))
    nodes = sorted({f for fs in fp.values() for f in fs})
    classes = union_find(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for d, fs in fp.items():
        for f in fs:
            if d is not None:
                least[classes[f]] = min(least.get(classes[f], d), d)
    got = simhash_ball.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        f = r.fp % (1 << 64)
        assert f in fp[r.doc_id] and r.component_id == least.get(classes[f])
    kept = simhash_ball.deduplicate(frame(spark, rows))
    assert kept.columns == frame(spark, rows[:1]).columns
    assert kept.where("doc_id IS NOT NULL").count() == len(set(least))
    assert simhash_ball.fingerprint("  ") == 0 and simhash_ball.fingerprint(None) == 0


def test_simhash_component_without_ids_keeps_one_row(spark):
    texts = ["one two three", "ONE two three", "one\ttwo  three"]
    rows = [(None, t, "s") for t in texts * 2] + [(None, "quite another text here", "s"), (4, "five six seven", "s"), (None, "FIVE six seven", "s")]
    kept = [(r.doc_id, r.text.lower().split()) for r in simhash_ball.deduplicate(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, texts[0].split()), (None, "quite another text here".split()), (4, "five six seven".split())], key=str)


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_ball_links(spark, bits):
    rng = np.random.default_rng(bits)
    fps = set()
    for b in rng.integers(0, 1 << 62, 40).tolist():
        for _ in range(12):
            x = b
            for k in rng.integers(0, 63, rng.integers(0, 6)).tolist():
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    got = {r.node: r.component for r in connected(simhash_ball.links(spark.createDataFrame([(x,) for x in fps], "fp long"), bits)).collect()}
    exp = union_find(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= bits])
    assert {x: got.get(x, x) for x in fps} == exp


def test_mix_follows_targets(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 40)), rnd.choice(["big"] * 6 + ["a", "b", None])) for i in range(3000)] + [(5, "x y", "tiny"), (5, "x y", "tiny"), (None, None, "tiny")]
    first = mixing.mix(frame(spark, rows)).toPandas()
    again = mixing.mix(frame(spark, rows[::-1])).toPandas()
    key = ["doc_id", "source", "size", "copies"]
    assert first[key].astype(str).sort_values(key).values.tolist() == again[key].astype(str).sort_values(key).values.tolist()
    assert len(first) == len(rows) and first.copies.max() <= 3
    assert abs(first.groupby("source", dropna=False).target.first().sum() - first["size"].sum()) < 1e-6
    for _, x in first.groupby("source", dropna=False):
        assert x.target.iloc[0] <= 3 * x.source_size.iloc[0]
        assert abs((x["size"] * x.copies).sum() - x.target.iloc[0]) <= 3 * 40
    out = mixing.mixed(frame(spark, rows))
    assert out.columns == frame(spark, rows[:1]).columns and out.count() == first.copies.sum()


def test_mixed_rows_of_one_group_get_copies_of_their_own(spark):
    rows = [(None, "same words in all", "big")] * 700 + [(i, "a b " * (i % 9), "other") for i in range(300)]
    docs = frame(spark, rows)
    want = mixing.mix(docs).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()
    got = {(r.doc_id, r.source): r["count"] for r in mixing.mixed(docs).groupBy("doc_id", "source").count().collect()}
    assert got == {(r.doc_id, r.source): r.n for r in want if r.n} and got[None, "big"] > 350
    assert "ollect_list" not in mixing.mixed(docs)._jdf.queryExecution().toString()


def test_suffix_dedup_of_rows_without_id(spark):
    text = "a passage of more than fifty bytes that is there many times over"
    rows = [(None, text, "s")] * 400 + [(None, None, "s"), (None, "", "s"), (1, text, "s"), (2, text + "!", "s")]
    out = suffix_dedup.remove_repeats(frame(spark, rows), with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == repeats(rows)
    assert sum(bytes(r.kept) == text.encode() for r in out) == 401


def test_personal_data_base_spans(spark):
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) * (1 + i % 2) - 9 * (i % 2 and int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    rnd = random.Random(3)
    bits = ["a@b.com", "a@b.c_d@e.f", "@", "x.y@z-1.co.uk", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "001.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111-1",
            "+1 (988) 555-2485", "+12..", "+", "123456789012345", " ", "é", "😀", "..", "-", "a@b.com@c.de", "99999999999.1.1.1", "0"]
    rows = [(i, "".join(rnd.choice(bits) + rnd.choice(["", " ", "x"]) for _ in range(rnd.randrange(12))), "s") for i in range(800)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "9" * 20000, "s"), (903, "a" * 50000 + "@b.c", "s"), (None, "1.2.3.4", "s")]
    for r in pii_bootstrap.find(frame(spark, rows)).collect():
        text = next(t for d, t, _ in rows if d == r.doc_id) or ""
        assert [tuple(x) for x in r.base] == [(i, m.start(), m.end()) for i, k in enumerate(pii_bootstrap.KINDS) for m in re.finditer(rx[k], text) if valid(k, m[0])]


def test_personal_data_contexts(spark):
    rnd = random.Random(2)
    rows = [(i, f"the {rnd.choice('abc')} host at: {rnd.randrange(1, 250)}.2.3.{rnd.randrange(1, 250)} ok", "s") for i in range(30)]
    rows += [(100, "a host at: AB-12345-Q end", "s"), (101, "plain 12345 text", "s"), (102, None, "s"), (103, "a host at: AB-12345-Q +1 (988) 555-2485", "s")]
    found = {r.doc_id: [tuple(x) for x in r.found] for r in pii_bootstrap.find(frame(spark, rows)).collect()}
    assert found[100] == [(1, 11, 21)] and found[101] == found[102] == []
    text = {r.doc_id: (r.text, r.n_chars) for r in pii_bootstrap.mask(frame(spark, rows)).collect()}
    assert text[100] == ("a host at: <IP> end", 19) and text[102] == (None, None) and text[103][0] == "a host at: <IP> <PHONE>" and text[101][0] == "plain 12345 text"


@pytest.mark.parametrize("fan", [1, 16])
def test_pattern_scores_with_a_hot_instance(spark, monkeypatch, fan):
    monkeypatch.setattr(pii_bootstrap, "FAN", fan)
    rnd = random.Random(9)
    rows = [("hot@x.y", 0, [f"word{i % 60}", "mail:"]) for i in range(400)]
    rows += [(f"i{rnd.randrange(80)}", None, rnd.sample([f"word{k}" for k in range(80)] + ["mail:", "ip:"], 2)) for _ in range(500)]
    rows += [(f"1.2.3.{k}", 1, ["ip:", "mail:"][:1 + k % 2]) for k in range(40)] + [("lonely", None, [])]
    edges, seed = {}, {}
    for inst, kind, patterns in rows:
        for p in patterns:
            edges[p, inst] = edges.get((p, inst), 0) + 1
        if kind is not None:
            seed[inst] = kind
    r = {x: float(x in seed) for _, x in edges}

    def mean(node, value):
        top, low = {}, {}
        for e, n in edges.items():
            top[e[node]] = top.get(e[node], 0) + n * value[e[1 - node]]
            low[e[node]] = low.get(e[node], 0) + n
        return {k: round(top[k] / low[k], 9) for k in top}
    for _ in range(pii_bootstrap.ROUNDS):
        i = mean(1, mean(0, r))
        r = {x: 1.0 if x in seed else i[x] for x in r}
    score = mean(0, r)
    df = spark.createDataFrame(rows, "instance string, kind int, patterns array<string>")
    got = {x.pattern: (x.kind, x.score) for x in pii_bootstrap.trusted_patterns(df, trust=0.3, support=1).collect()}
    want = {}
    for p, s in score.items():
        kinds = [seed[x] for q, x in edges if q == p and x in seed]
        most = max(set(kinds), key=lambda k: (kinds.count(k), -k), default=None)
        if kinds and s >= 0.3 and kinds.count(most) >= 0.3 * len(kinds):
            want[p] = (most, s)
    assert len(want) > 5 and set(got) == set(want)
    assert all(got[p][0] == want[p][0] and got[p][1] == pytest.approx(want[p][1], abs=1e-8) for p in want)


def brute_viterbi(text, plain, byte):
    score = {p: (s, i) for i, p, s in plain}
    low = min(s for _, _, s in plain if s > -1e8) - 10
    s = "▁" + text.replace("▁", "￿").replace(" ", "▁") if text else ""
    best = [(0.0, [])] + [None] * len(s)
    for i in range(1, len(s) + 1):
        top = None
        for size in range(min(16, i), 0, -1):
            hit = score.get(s[i - size:i])
            if hit and (top is None or best[i - size][0] + hit[0] > top[0]):
                top = (best[i - size][0] + hit[0], best[i - size][1] + [hit[1]])
        if s[i - 1] not in score and (top is None or best[i - 1][0] + low > top[0]):
            raw = ("▁" if s[i - 1] == "￿" else s[i - 1]).encode()
            top = (best[i - 1][0] + low, best[i - 1][1] + [byte[b] for b in raw])
        best[i] = top
    return best[-1][1]


def test_sentencepiece(spark):
    plain, byte = load_pieces(MODEL)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["the", " ", "  ", "\n", "ation", "é", "▁", "😀", "x", "日本", "\t", "Qz", "ing "]) for _ in range(rnd.randrange(25))) for _ in range(300)]
    texts += ["", " ", "a" * 5000, "word " * 3000, "￿"]
    codec = sentencepiece_codec.Codec(plain, byte)
    assert [codec.encode(t) for t in texts[:302]] == [brute_viterbi(t, plain, byte) for t in texts[:302]]
    rows = [(i, t, "s") for i, t in enumerate(texts[:-1])] + [(900, None, "s")]
    tokens = sentencepiece_codec.encode(frame(spark, rows))
    assert tokens.where("round_trip").count() == len(rows)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(tokens).collect()}
    assert all(back[d] == (t or "") for d, t, _ in rows)


def test_sentencepiece_of_noncharacters(spark):
    texts = ["\uffff", "a\uffff\u2581 \uffff b", "\ufffe\u2581", "\ud7ff\ue000\u2581\uffff"]
    tokens = sentencepiece_codec.encode(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert tokens.where("round_trip").count() == len(texts)
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(tokens).collect()} == dict(enumerate(texts))


def test_language(spark):
    rnd = random.Random(6)
    stock = {"de": ["und", "nicht", "schön", "straße", "haus"], "en": ["the", "which", "house", "street", "nice"]}
    rows = [(i, " ".join(rnd.choice(stock[g]) + rnd.choice(["", "er", "en"]) for _ in range(12)), g) for i in range(120) for g in [("de", "en")[i % 2]]]
    docs = spark.createDataFrame(rows + [(500, None, "de"), (501, "12 !", "en"), (502, "which house " * 200_000, None), (503, "x" * 5000, None)], "doc_id long, text string, lang string")
    model = lang_id.train(docs, ~held_out(F.col("doc_id"), 4, 2))
    got = {r.doc_id: r for r in lang_id.predict(docs, *model).collect()}
    assert all(got[d].lang_pred == g for d, _, g in rows) and got[502].lang_pred == "en"
    assert (got[500].lang_pred, got[500].score) == (got[501].lang_pred, got[501].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    none = lang_id.predict(docs, *lang_id.train(docs, F.lit(False))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "▁", "▁a"]
    p = np.array([0.1, 0.2, 0.3, 0.15, 0.05, 0.2])
    lattice = lang_id.Lattice(pieces)
    alpha = lang_id.forward(lattice.arcs(["ab", "c"]), 2, p)
    assert alpha[3, 0] == pytest.approx(0.15 * 0.1 * 0.3 + 0.15 * 0.2 + 0.05 * 0.3) and alpha[2, 1] == pytest.approx(0.15 * 0.2)


def test_toxicity(spark):
    rnd = random.Random(8)
    plain = [f"w{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rnd.choice(plain) for _ in range(20)] + (["vile", rnd.choice(["scum", "scums"])] if bad else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, "s"), (901, "", "s"), (902, "w1 " * 600_000 + "vile scum", "s"), (None, "w2", "s")]
    docs, known = frame(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    weights, bias = toxicity.train(docs, known, ~held_out(F.col("doc_id"), 5, 0))
    assert (weights != 0).mean() < 0.01
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights, bias).collect()}
    assert sum((got[i] >= 0.5) == bool(t) for i, _, t in labels) >= 396 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] < 0.5
    kept = toxicity.keep_below(docs, weights, bias, 0.5)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.5 for s in got.values())


def test_empty_tables(spark):
    none = frame(spark, [(1, "a", "s")]).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert suffix_dedup.remove_repeats(none).count() == simhash_ball.near_duplicates(none).count() == 0
    assert simhash_ball.deduplicate(none).count() == mixing.mix(none).count() == mixing.mixed(none).count() == 0
    assert pii_bootstrap.find(none).count() == pii_bootstrap.mask(none).count() == sentencepiece_codec.encode(none).count() == 0
    assert lang_id.predict(none, *lang_id.train(none, F.lit(True))).count() == 0
    assert toxicity.score(none, *toxicity.train(none, labels, F.lit(True))).count() == 0
