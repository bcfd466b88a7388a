"""Phrase tiles, whitening and URL filters against brute force and SQL."""

import os
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck
from promolens.llm import link_trust, phrase_tiles, queries, whitening

SF = "/root/testdata/sf0.001"


def folder(spark, tmp_path, **tables):
    """A folder of tables as the queries read them."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# --- op11 ------------------------------------------------------------------------------------------

def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in words_of(text):
            n[lang] += len(w)
            for m in (1, 2, 3):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in c.items() if len(q) == 3 and b >= least and p in (q[:2], q[1:])):
                continue
            s, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]]))
        for rank, (s, _, p, a, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), a, left, right, n[lang], -s))
    return sorted(out)


def made_texts():
    rnd = random.Random(11)
    words = ["the", "of", "New", "york", "city", "a\x0b", "é", "\U0001f600", "Ä", "x-y", "don't", "z"]
    weights = [20, 15, 6, 6, 6, 3, 2, 2, 2, 2, 2, 1]
    rows = []
    for _ in range(150):
        w = []
        size = rnd.randint(0, 60)
        while len(w) < size:
            w += ["New", "York", "City"] if rnd.random() < 0.2 else rnd.choices(words, weights)
        rows.append((rnd.choice([" ", "  ", "\t", ", ", ". ", "\n"]).join(w), rnd.choice(["en", "de", None, "und"])))
    rows += [(None, "en"), ("", "de"), ("the the the the the", "en"), ("...", "fr"), ("solo", "fr")] + [rows[3]] * 30
    return rows


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("sizing", [{}, {"chunk": 7, "slice_": 16, "piece": 20}, {"chunk": 60, "slice_": 5, "piece": 1}])
def test_phrases(spark, sizing):
    rows = made_texts() + [("the new york city of the " * 300, "en"), ("new york" * 200 + " city " * 40, "de")]
    docs = spark.createDataFrame([(i, t, g, "s", 0, 1, "x", 2) for i, (t, g) in enumerate(rows)], DOCS + ", rank int, phrase string, id int").repartition(4)
    want = brute_phrases(rows, 10, 2000)
    assert len(want) > 40 and any(w[2].count(" ") == 2 for w in want)
    got = sorted(tuple(r) for r in phrase_tiles.phrases(docs, **sizing).collect())
    assert got == want


def test_phrases_few_places_and_ties(spark):
    rows = made_texts()
    docs = spark.createDataFrame([(i, t, g, "s", 0) for i, (t, g) in enumerate(rows)], DOCS)
    assert sorted(tuple(r) for r in phrase_tiles.phrases(docs, least=3, top=4).collect()) == brute_phrases(rows, 3, 4)


def test_blocks_and_pieces():
    ids = np.r_[np.arange(70_000), 2 ** 20 - 1, 2 ** 20, 2 ** 31 - 1]
    b = phrase_tiles.block(ids)
    assert (np.diff(b) >= 0).all() and b[1023] == 0 and b[1024] == 1 and b[16383] == 15 and b[16384] == 16 and b[32768] == 17 and b[-1] < phrase_tiles.BLOCKS


@pytest.mark.parametrize("name", ["op11_phrase_tiles", "op13_link_trust"])
def test_query_equals_sql(spark, name):
    r = compare(E.queries()[name](spark, SF), duck(SF), E.oracle_sql()[name])
    assert r["match"] and r["types_match"], r


@pytest.mark.parametrize("name", ["op11_phrase_tiles", "op13_link_trust"])
def test_query_equals_sql_on_awkward_rows(spark, tmp_path, name):
    import duckdb
    docs = [(i, t, g, "s", 0) for i, (t, g) in enumerate(made_texts())] + [(None, "the of", "en", None, None)]
    sf = folder(spark, tmp_path, documents=(docs, DOCS), pages=(made_pages(), "page_id long, url string, html string"))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    r = compare(queries.QUERIES[name](spark, sf), con, queries.ORACLE[name])
    assert r["match"] and r["spark_rows"] > 10, r


# --- op12 ------------------------------------------------------------------------------------------

def made_vectors(n=400, dim=20, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) + 3.7
    v[:, 5] = v[:, 2]                                       # a repeated dimension: rank one less
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    return rows + [(5000, rows[0][1]), (5000, rows[0][1]), (None, rows[1][1]), (5001, None), (5002, [float("nan")] * dim), (5003, rows[2][1][:-1] + [None]),
                   (5004, [float("inf")] + [0.0] * (dim - 1)), (5005, [1e300] + [0.0] * (dim - 1)), (5006, []), (5007, [1.0, 2.0]), (5008, [1.0, 2.5]),
                   (5009, [1.0, 2.5]), (5010, [7.0] * 3), (5011, [0.0] * dim)]


def brute_whitening(vectors):
    """n, deviations by row, eigenvalues, trace, projector-ready rows for one length."""
    x = [[int(np.floor(64 * np.float64(c))) + 1000000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, dim = len(fit), len(fit[0])
    s = [sum(r[j] for r in fit) for j in range(dim)]
    mean = [Fraction(a, n) for a in s]
    centred = np.array([[float(a - m) for a, m in zip(r, mean, strict=True)] for r in fit])
    e, c = np.linalg.eigh(centred.T @ centred / n)
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    rows = np.array([[float(a - m) for a, m in zip(r, mean, strict=True)] for r in x])
    return n, dev, e[::-1], c[:, ::-1], rows


@pytest.mark.parametrize("most", [16, 3])
def test_whitening(spark, most):
    rows = made_vectors()
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, component int, n int, w string").repartition(4)
    got = defaultdict(list)
    for r in whitening.whiten(df, most).collect():
        got[r.vec_id, r.component].append(r)
    dim = 20
    usable = [(i, v) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1e15]
    n, dev, e, c, x = brute_whitening([v for _, v in usable])
    k = min(most, int((e > 1e-9 * e[0]).sum()))
    ids = Counter(i for i, _ in usable)
    for component in range(1, k + 1):
        want = x @ c[:, component - 1] / np.sqrt(e[component - 1])
        by_id = {}
        for (i, _), w, d in zip(usable, want, dev, strict=True):
            by_id[i] = (w, d)
        sign = np.sign(by_id[3][0] * got[3, component][0].whitened)
        for i, (w, d) in by_id.items():
            assert len(got[i, component]) == ids[i]
            for r in got[i, component]:
                assert r.n == n and r.deviation == d and r.whitened == pytest.approx(sign * w, abs=1e-8)
                assert r.explained == pytest.approx(e[component - 1] / e.sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9
    assert not any(comp > k and i in ids for i, comp in got)
    for i in (5001, 5002, 5003, 5004, 5005, 5006, 5010):     # dropped, or a list of one vector
        assert not any(key[0] == i for key in got)
    assert {key for key in got if key[0] in (5007, 5008, 5009)} == {(5007, 1), (5008, 1), (5009, 1)}


def test_whitening_deviation_beyond_64_bits_and_empty(spark):
    big = [(1, [2.0 ** 50, 1.0]), (2, [0.0, 2.0]), (3, [5.0, 0.5])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()}
    assert got[1, 1].deviation is None and {k[1] for k in got} >= {1}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(none).collect() == []


def test_factor_parts():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 31)) * np.geomspace(1, 1e-5, 31)
    v = a.T @ a
    low = whitening.pivoted_cholesky(v)
    assert np.allclose(low @ low.T, v, rtol=0, atol=1e-12 * np.abs(v).max())
    e, c = whitening.one_sided_jacobi(low)
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], rtol=1e-6) and np.allclose(c.T @ c, np.eye(31), atol=1e-10)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_whitening_query(spark, tmp_path):
    rows = [(i, v, 0) for i, v in made_vectors(90, 6, 2) if v is not None]
    sf = folder(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    out = queries.op12_jacobi_whitening(spark, sf)
    assert [t for _, t in out.dtypes][:1] == ["bigint"] and dict(out.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    full = out.where("vec_id < 90").groupBy("vec_id").count().collect()
    assert len(full) == 90 and {r["count"] for r in full} == {5}


# --- op13 ------------------------------------------------------------------------------------------

def page(*targets):
    return "<p>x</p>" + "".join(f'<A class="q" HREF = "https://{t}">t</a>' if i % 2 else f"<a href=//{t}/x>t</a>" for i, t in enumerate(targets)) + '<a href="/own">o</a><link href="http://css.org">'


def made_pages():
    rows = [("http://shop.com/", page("friend.org", "friend.org", "Far.ORG")), ("http://friend.org/a", page("second.org")), ("http://second.org", page()),
            ("http://bad.net/es/1", page("far.org")), ("http://bad.net/fr/", page()), ("http://bad.net/de/1", page()), ("http://linker.org/1", page("bad.net", "bad.net")),
            ("http://linker.org/2", page("bad.net", "shop.com")), ("http://two.org/", page("linker.org")), ("http://worse.net/es/", page()), ("http://only.org/", page("worse.net")), ("https://EXAMPLE.com/en/x", page()), ("https://www.Example.com/en/", page()),
            ("https://a.www.example.com/en/?q", page()), ("https://notexample.com/en/", page()), ("http://example.com/en", page()), ("http://com", page()), ("http://com/", page()),
            ("http://x.com:80/", page()), ("http://xnet/es/", page()), ("net/es/", page()), (None, page("bad.net")), ("http://half.net/es/", None), ("http://half.net/es", page()),
            ("://x.net/es/#a", ""), ("http://lone.org/p?q#f", page()), ("ftp://q.org#://x.com/", page()), ("http:///es/", page()), ("http://m.org?x=/es/", page())]
    out = [(i, u, h) for i, (u, h) in enumerate(rows)] + [(3, *rows[3]), (None, *rows[6])]
    return out + [(100 + i, f"http://hub{i % 7}.org/{i}", page(*[f"t{j}.org" for j in range(i % 5)], "bad.net" if i % 7 == 3 else "shop.com")) for i in range(60)]


def brute_verdicts(pages, rounds, damping, threshold):
    rules = [("allow", "www.example.com", "/en/"), ("block", "example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("allow", "com", "/")]
    out, links = [], Counter()
    seen = defaultdict(Counter)
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    for i, url, html in pages:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = low(re.match(r"[^/?#]*", rest)[0])
            path = re.match(r"[^?#]*", rest[len(host):])[0]
        rule = next(((v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), (None, None))
        out.append((i, host, path, rule[1], rule[0]))
        if host:
            seen[host]["pages"] += 1
            seen[host][rule[0]] += 1
            for t in re.findall(r"""(?i)<a\s[^<>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)""", html or ""):
                if low(t) != host:
                    links[host, low(t)] += 1
    scores = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        seed = {h: c[verdict] / c["pages"] for h, c in seen.items()}
        edges = links if kind == "trust" else {(b, a): n for (a, b), n in links.items()}
        total = Counter()
        for (a, _), n in edges.items():
            total[a] += n
        now = dict(seed)
        for _ in range(rounds):
            new = defaultdict(float, seed)
            for (a, b), n in edges.items():
                new[b] += damping * now.get(a, 0.0) * n / total[a]
            now = new
        scores[kind] = now
    d = lambda h: scores["distrust"].get(h, 0.0) - scores["trust"].get(h, 0.0)
    return [(i, h, p, r, v or ("block" if h and d(h) >= threshold else "allow")) for i, h, p, r, v in out]


@pytest.mark.parametrize("how", [{}, {"hot": 0.1, "fan": 2}])
def test_link_trust(spark, how):
    pages = made_pages()
    df = spark.createDataFrame([(*p, 1, "x", "y") for p in pages], "page_id long, url string, html string, pages int, host string, verdict string").repartition(4)
    got = sorted((tuple(r) for r in link_trust.judge(df, **how).collect()), key=repr)
    want = sorted(brute_verdicts(pages, link_trust.ROUNDS, link_trust.DAMPING, link_trust.THRESHOLD), key=repr)
    assert got == want
    by_method = {h: v for _, h, _, r, v in want if r is None}
    assert by_method["only.org"] == "block" and by_method["bad.net"] == "block" and by_method["friend.org"] == "allow" and by_method["lone.org"] == "allow"


def test_link_trust_empty_and_native(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert link_trust.judge(none).collect() == []
    source = open(os.path.join(os.path.dirname(link_trust.__file__), "link_trust.py")).read()
    assert "InPandas" not in source and "InArrow" not in source and "udf" not in source.lower() and ".rdd" not in source


def test_rules_longest_wins(spark):
    from pyspark.sql import functions as F
    rules = [("allow", "b.org/"), ("block", "b.org/x/"), ("block", "org/x/y/z/"), ("allow", "a.b.org/x")]
    df = spark.createDataFrame([("a.b.org", "/x/y"), ("b.org", "/x/"), ("c.org", "/x/y/z/"), ("b.org", "/"), ("b.org", ""), ("xb.org", "/")], "h string, p string")
    got = [tuple(r) for r in df.select(*link_trust.rule_of(F.col("h"), F.col("p"), rules)).collect()]
    assert got == [("a.b.org/x", "allow"), ("b.org/x/", "block"), ("org/x/y/z/", "block"), ("b.org/", "allow"), (None, None), (None, None)]
