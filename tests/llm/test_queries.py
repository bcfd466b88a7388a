"""Every query of the subpackage on a small folder of awkward tables, against brute force; the pipeline exactly."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from promolens.llm import html_extract, lang_id, mixing, pii_bootstrap, queries, toxicity
from promolens.llm.common import read
from promolens.llm.pieces import MODEL

REGEX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SPACE = "\x20\x09-\x0D"


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) * (1 + i % 2) - 9 * (i % 2 and int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k in REGEX for m in re.finditer(REGEX[k], text) if valid(k, m[0])]


def fingerprint(text):
    """By the contract's words, from the xxhash package alone."""
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(f"[^{SPACE}]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_linked(ids, linked):
    """The smallest id reachable, for every id."""
    up = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(up[a], up[b])
            if up[a] != low or up[b] != low:
                up[a] = up[b] = low
                moved = True
    return up


def clear(n=160, seed=8):
    rnd = random.Random(seed)
    plain = "river stone garden winter letter market window planet silver forest wagon bridge candle meadow harbor".split()
    alien = "jardín piedra río invierno carta mercado ventana planeta plata bosque vagón puente vela pradera puerto".split()
    bad = "vile scum trash stupid rotten".split()
    passage = " ".join(rnd.choice(plain) for _ in range(14))
    docs, labels = [], []
    for i in range(n):
        words, lang = (plain, "en") if i % 3 else (alien, "es")
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(12, 60)))
        toxic = int(i % 6 == 0)
        if toxic:
            text += " " + " ".join(rnd.choice(bad) for _ in range(8))
        if i % 5 == 1:
            text += " " + passage + "."
        if i % 4 == 2:
            text += f" write to: user{i}@mail{i % 7}.org or call +1 (988) 555-{1000 + i} now, host 10.0.{i}.7"
        docs.append((i, text, lang, ["hot", "hot", "b", None][i % 4]))
        labels.append((i, toxic))
    docs += [(n, docs[1][1], "en", "b"), (n + 1, docs[1][1].upper(), "en", "hot"), (n + 2, None, "en", "b"), (n + 3, "", None, "hot"),
             (n + 4, "² ½ Ⅷ 12", "en", "b"), (n + 5, "long " * 5000 + "end", "en", "c"), (n + 6, docs[2][1] + " tail", "en", "hot")]
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = clear()
    rows = [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(6)
    v = rng.normal(size=(220, 10))
    v[120:] = v[rng.integers(0, 30, 100)] + rng.normal(size=(100, 10)) * 0.1
    vec = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (350, [0.0] * 10), (400, v[0].tolist()), (401, [float("nan")] * 10), (402, (v[3] * 1e200).tolist())]
    spark.createDataFrame(vec, "vec_id long, embedding array<double>").repartition(2).write.parquet(f"{path}/embeddings.parquet")
    return path, docs, vec


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder[0])


def test_op1(spark, folder):
    docs = folder[1]
    first = {}
    for d, t, *_ in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i:i + 50], d)                # ids rise
    want = []
    for d, t, *_ in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((d, len(b), sum(gone), sum(bool(r) for r in bytes(gone).split(b"\0")), hashlib.sha256(kept).hexdigest()))
    got = run(spark, folder, "op1_suffix_dedup")
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == want and sum(w[2] for w in want) > 1000


def test_op2(spark, folder):
    got = {r.doc_id: r for r in run(spark, folder, "op2_language").collect()}
    assert set(got) == {d for d, *_ in folder[1]}
    right = 0
    for d, t, lang, _ in folder[1][:160]:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= got[d].score <= 1
        right += got[d].lang_pred == lang
    assert right >= 158
    assert [got[d].lang_pred for d in (162, 163, 164)] == ["und"] * 3


def test_op2_scores_by_brute_force(spark, folder):
    """The score is the winner's share of the likelihoods, each the product over words of the sums over all segmentations."""
    langs, pieces, probs = lang_id.train(read(spark, folder[0], "documents"), F.lit(True))
    index = {p: i for i, p in enumerate(pieces)}

    def sums(word, row):
        alpha = [1.0] + [0.0] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                piece = word[s:e]
                if piece in index:
                    alpha[e] += alpha[s] * row[index[piece]]
                elif e - s == 1:
                    alpha[e] += alpha[s] * row[-1]
        return alpha[-1]
    texts = ["garden", "Invierno piedra", "silver río puente", "xyz ß"]
    got = {r.doc_id: r for r in lang_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), langs, pieces, probs).collect()}
    for i, text in enumerate(texts):
        like = [math.prod(sums("\u2581" + w, row) for w in text.lower().split()) for row in probs]
        assert got[i].score == pytest.approx(max(like) / sum(like), rel=1e-9) and got[i].lang_pred == langs[int(np.argmax(like))]


def test_op3(spark, folder):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in run(spark, folder, "op3_sentencepiece").collect():
        text = next(t for d, t, *_ in folder[1] if d == r.doc_id) or ""
        assert r.round_trip and r.n_tokens == len(r.ids)
        assert all(0 <= i < sp.get_piece_size() for i in r.ids) and (text == "") == (r.n_tokens == 0)


def test_op4(spark, tmp_path):
    shell = "<html><head><title>t</title></head><body><nav><ul><li>Home</li></ul></nav>%s<section class='comments'><p>A reader is of the same mind %d</p></section><footer>x y</footer></body>"
    art = "<article><h1>Head %d</h1><p>Some words of the text, number %d, that go on.</p><p>And more of them.</p></article>"
    rows = [(i, f"https://h{i}.example.com/", shell % (art % (i, i), i)) for i in range(12)] + [(50, None, None), (None, "u", ""), (51, "u", "<p>a&nbsp; b")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.QUERIES["op4_main_text"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[50].text == got[None].text == "" and got[51].text == "a b"
    for i in range(12):
        assert got[i].text == f"Head {i}\nSome words of the text, number {i}, that go on.\nAnd more of them."
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.SEEN <= 12


def test_op5(spark, folder):
    path, docs, _ = folder
    got = {r.doc_id: r for r in run(spark, folder, "op5_toxicity").collect()}
    labels = {r.doc_id: r.toxic for r in read(spark, path, "labels").collect()}
    assert set(got) == {d for d, *_ in docs}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [d for d in labels if got[d].held_out]
    assert len(held) > 15 and sum(got[d].predicted == labels[d] for d in held) / len(held) >= 0.9
    # Scores again as the sigmoid of the bias and the weights of a text's distinct features.
    table = read(spark, path, "documents")
    w, bias = toxicity.train(table, read(spark, path, "labels"), ~(F.crc32(F.col("doc_id").cast("string")) % 5 == 0))
    ranges = toxicity.RangeHash(1 << 20)
    for d, t, *_ in docs:
        f = toxicity.text_features((t or "").encode(), ranges)
        want = 1 / (1 + math.exp(-(bias + float(w[f].astype(np.float32).astype(float).sum()))))
        assert got[d].score == pytest.approx(want, abs=1e-9)


def test_op6(spark, folder):
    for r in run(spark, folder, "op6_personal_data").collect():
        text = next(t for d, t, *_ in folder[1] if d == r.doc_id) or ""
        base = base_spans(text)
        assert [r[f"n_{k}"] for k in REGEX] == [sum(b[0] == k for b in base) for k in REGEX]
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans.startswith(said)
        rest = r.spans[len(said):].strip(",")
        assert all(re.fullmatch(r"found_(email|ip|card|phone):\d+:\d+", x) for x in rest.split(",") if x)


def usable(v):
    return v is not None and bool(np.isfinite(v).all()) and any(v)


def cosine(a, b):
    a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
    return a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))


def test_op7(spark, folder):
    vec = {i: v for i, v in folder[2] if usable(v)}
    got = {}
    for r in run(spark, folder, "op7_graph_neighbours").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [i for i in vec if i % 50 == 0]
    hits = 0
    assert set(got) == set(asked)
    for q in asked:
        best = sorted(((-cosine(vec[q], v), i) for i, v in vec.items() if i != q))[:5]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5] and all(s == pytest.approx(cosine(vec[q], vec[i]), abs=1e-12) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in best})
    assert hits >= 0.9 * 5 * len(asked)


def test_op8(spark, folder):
    vec = folder[2]
    good = [(i, v) for i, v in vec if usable(v)]
    links = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1:] if cosine(x, y) >= 0.95]
    up = least_linked([i for i, _ in vec], links)
    n = {i: sum(i in p for p in links) for i, _ in vec}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, folder, "op8_pivot_join").collect()}
    assert len(links) > 50 and got == {i: (n[i], up[i], up[i] == i) for i, _ in vec}


def test_op9(spark, folder):
    fp = {d: fingerprint(t) for d, t, *_ in folder[1]}
    up = least_linked(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, folder, "op9_simhash_ball").collect()}
    assert got == {d: (f"{fp[d]:016x}", up[d]) for d in fp} and up[160] == up[161] == 1


def test_op10_equals_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder[0]}/documents.parquet/*.parquet')")
    con.execute(queries.ORACLE["op10_systematic_mix"])
    names = [c[0] for c in con.description]
    want = [tuple(r) for r in con.fetchall()]
    got = run(spark, folder, "op10_systematic_mix").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pipeline_exactly(spark, folder):
    path, docs, _ = folder
    table = read(spark, path, "documents")
    w, bias = toxicity.train(table, read(spark, path, "labels"), F.lit(True))
    score = {r.doc_id: r.score for r in toxicity.score(table, w, bias).collect()}
    clean = {d: (t, s) for d, t, _, s in docs if score[d] < 0.5}
    assert all((d in clean) == bool(d % 6) for d in range(160))
    fp = {d: fingerprint(t) for d, (t, _) in clean.items()}
    up = least_linked(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    kept = {d: x for d, x in clean.items() if up[d] == d}
    rows = [(d, t, "", s) for d, (t, s) in kept.items()]
    found = {r.doc_id: r for r in pii_bootstrap.find(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    masked = {}
    for d, (t, s) in kept.items():
        spans = sorted([(b, e, list(REGEX).index(k)) for k, b, e in base_spans(t or "")] + [(x.start, x.end, x.kind) for x in found[d].found])
        out, at = [], 0
        for b, e, k in spans:
            if b >= at:
                out += [(t or "")[at:b], f"<{list(REGEX)[k].upper()}>"]
            at = max(at, e)
        masked[d] = ("".join(out) + (t or "")[at:], s)
    # Mixing: targets by water-filling, copies by integer crossings of the running sum.
    size = {d: len(re.findall(f"[^{SPACE}]+", t)) for d, (t, _) in masked.items()}
    by_source = {}
    for d, (_, s) in masked.items():
        by_source.setdefault(s, []).append(d)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d in by_source[s]) for s in names}
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= 3 * total[s]
            free.remove(s)
    copies = {}
    for s in names:
        rate = target[s] / total[s] if total[s] else 0.0
        head = hashlib.md5((mixing.SEED + ("0" if s is None else "1" + s)).encode()).hexdigest()[:4]
        u = (int(head, 16) + 0.5) / 65536
        for k, d in enumerate(sorted(by_source[s], key=lambda d: (size[d], d)), 1):
            copies[d] = min(3, math.floor(u + rate * k) - math.floor(u + rate * (k - 1)))
    taken = spark.createDataFrame([(d, t) for d, (t, _) in masked.items()], "doc_id long, text string")
    ids = {r.doc_id: list(r.ids) for r in queries.sentencepiece_codec.encode(taken).collect()}
    want = sorted((d, ids[d]) for d, n in copies.items() for _ in range(n))
    out = corpus_pipeline.run(spark, path).collect()
    assert all(r.round_trip for r in out) and sorted((r.doc_id, list(r.ids)) for r in out) == want and len(want) > 50
