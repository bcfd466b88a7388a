"""The operators on embeddings and pages, and the pipeline."""

import pathlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from promolens.llm import common, graph_ann, html_extract, pivot_join, sentencepiece_codec, simhash_ball, toxicity
from promolens.llm.common import read

SF = "/root/testdata/sf0.001"


def vectors(n=260, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base[n // 2:] = base[rng.integers(0, 12, n - n // 2)] + rng.normal(size=(n - n // 2, dim)) * 0.12
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    return rows + [(9001, rows[0][1]), (9002, rows[0][1]), (9003, None), (9004, [0.0] * dim), (9005, [float("nan")] * dim), (9006, [1.0, 2.0]),
                   (9007, [2.0, 4.0]), (9008, rows[3][1][:-1] + [None]), (9009, [x * 3 for x in rows[5][1]]), (9050, rows[0][1]), (9100, [float("inf")] + [1.0] * (dim - 1))]


def good(v):
    return v is not None and None not in v and bool(np.isfinite(v).all()) and any(v)


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string").repartition(3)


@pytest.mark.parametrize("cell,block", [(20, 15), (4096, 2048)])
def test_pivot_join(spark, cell, block):
    rows = vectors()
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1:] if good(x) and good(y) and len(x) == len(y) and cosine(x, y) >= 0.95]
    up, count = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(up[a], up[b])
            if up[a] != low or up[b] != low:
                up[a] = up[b] = low
                moved = True
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivot_join.near_duplicates(table(spark, rows), cell=cell, block=block).collect()}
    assert len(links) > 100 and got == {i: (count[i], up[i], up[i] == i) for i, _ in rows}


def test_pivot_join_writes_no_copies_of_vectors(spark, monkeypatch):
    """Vectors that no pivot separates are stored a bounded number of times, however many cells they are near to."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(1200, 48)).astype(np.float32)
    m = np.concatenate([m, m[:60] * np.float32(1.001) + rng.normal(size=(60, 48)).astype(np.float32) * np.float32(0.01), m[:9]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    stored, conf = {}, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def store(df, name, *how):
        out = common.store(df, name, *how)
        stored[name] = sum(pathlib.Path(f.removeprefix("file:")).stat().st_size for f in out.inputFiles()), out.count()
        return out

    monkeypatch.setattr(pivot_join, "store", store)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivot_join.near_duplicates(rows, cell=50, block=40).collect()}
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    assert got == {i: (links[i].sum() - 1, links[i].argmax(), links[i].argmax() == i) for i in range(len(m))} and links.sum() > len(m) + 120
    plain = m.nbytes
    assert sum(size for size, _ in stored.values()) < 3 * plain and all(n <= 1260 for _, n in stored.values())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) in (int(conf), common.BATCH_ROWS)


def test_pivot_join_of_separated_cells(spark, monkeypatch):
    """Blocks meet only where their vectors reach each other's cells; keys that collide are made anew."""
    rng = np.random.default_rng(6)
    centre = np.repeat(np.eye(16) * 20, 30, axis=0)
    rows = [(i, v.tolist()) for i, v in enumerate(centre + rng.normal(size=centre.shape) * 0.05)] + [(900, [1.0, 2.0]), (901, [2.0, 4.0]), (7, [-1.0, 2.0])]
    seeds, key = [], pivot_join._key

    def clash(seed):
        seeds.append(seed)
        return key(seed) if seed else F.lit(1)

    monkeypatch.setattr(pivot_join, "_key", clash)
    got = {(r.vec_id, r.n_links): r.component_id for r in pivot_join.near_duplicates(table(spark, rows), cell=10, block=8).collect()}
    assert seeds == [0, 1]
    assert {k: v for k, v in got.items() if k[0] >= 480} == {(900, 1): 900, (901, 1): 900}
    assert all(got[i, 29] == i // 30 * 30 for i in range(480) if i != 7)
    # Two blocks of cells that lie apart are no pair of the join.
    p = {16: pivot_join.unit(centre[::30])}
    t = pa.table({"node": pa.array([1, 2]), "copies": pa.array([1, 1]), "v": pa.array(centre[:2].tolist(), pa.list_(pa.float64()))})
    out = pivot_join._packed(p, {16: np.full(16, 0.1)}, 0.3)((pa.scalar(16), pa.scalar(0)), t)
    assert out["reach"].to_pylist() == [[1]] and len(out["v"][0].as_py()) == 2 * 16 * 4


def test_graph_recall(spark):
    rows = vectors(1500, 24, 3)
    usable = [(i, v) for i, v in rows if good(v)]
    got = {}
    for r in graph_ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0, shard=400).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, v in usable:
        if q % 50 == 0:
            best = sorted((-cosine(v, w), i) for i, w in usable if i != q and len(w) == len(v))[:5]
            mine = sorted(got[q])
            assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
            assert all(s == pytest.approx(cosine(v, dict(usable)[i]), abs=1e-12) for _, i, s in mine)
            hits += len({i for _, i, _ in mine} & {i for _, i in best})
            total += len(best)
    assert hits / total >= 0.9 and 9100 not in got


def test_graph_recall_of_a_full_shard():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(graph_ann.SHARD, 64))
    u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32)
    graph, start = graph_ann.build_graph(u)
    q = np.arange(0, len(u), 50)
    exact = u[q] @ u.T
    exact[np.arange(len(q)), q] = -2
    scored = []
    product = np.einsum

    class Counted:                                      # beam_search scores by einsum alone
        def __getattr__(self, name):
            return getattr(np, name)

        def einsum(self, how, x, y):
            scored.append(len(x))
            return product(how, x, y)
    plain, graph_ann.np = graph_ann.np, Counted()
    try:
        found, _ = graph_ann.beam_search(u, graph, start, u[q], graph_ann.SEARCH_BEAM)
    finally:
        graph_ann.np = plain
    share = sum(scored) / (len(q) * len(u))
    print(f"share of the shard scored by a query: {share:.3f}")
    assert share < 0.25
    hits = sum(len(set([x for x in f if x != i][:5]) & set(b))
               for i, f, b in zip(q.tolist(), found.tolist(), np.argsort(-exact, axis=1)[:, :5].tolist(), strict=True))
    print(f"recall: {hits / (5 * len(q)):.3f}")
    assert hits / (5 * len(q)) >= 0.9


def test_empty_and_unusable_vectors(spark):
    none = table(spark, [(1, None), (2, [0.0])])
    assert sorted(map(tuple, pivot_join.near_duplicates(none).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert pivot_join.near_duplicates(none.where("false")).count() == 0
    assert graph_ann.nearest(none, F.lit(True)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a>More</a></li></ul></nav><!-- ad --><div class="ad">buy this now</div>
<article><h1>Head &amp;amp; line</h1><p>First   <b>bold</b>\n text &eacute;.<br>next<p>Second para with several words here.</p>
<div class="cookie-notice">We use cookies on this site for all of you</div><form><p>Mail me</p></form><p>Third {i} paragraph, the last one.</p></article>
<aside>See also that other thing over there</aside><section class="comments"><p>Great post by me, the reader, indeed</p></section><footer>&copy; all rights</footer></body>"""


def test_main_text(spark):
    weights = html_extract.train([PAGE.replace("{i}", str(i)) for i in range(20)])
    exp = "Head &amp; line\nFirst bold text é. next\nSecond para with several words here.\nThird 7 paragraph, the last one."
    assert html_extract.extract(PAGE.replace("{i}", "7"), weights) == exp
    rows = [(1, "u", PAGE.replace("{i}", "7")), (2, "u", None), (3, None, ""), (4, "u", "<p>only"), (5, "u", "<!-- open"), (None, "u", "<div"), (6, "u", "<p>" + "word " * 100_000)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), weights).collect()}
    assert got[1] == exp and got[2] == got[3] == got[5] == got[None] == "" and got[4] == "only" and len(got[6]) == 499_999
    assert all(w < 0 for f, w in weights.items() if f)


def test_main_text_keeps_labelled_content(spark):
    weights = html_extract.train([PAGE.replace("{i}", str(i)) for i in range(20)])
    article = ("<article><h2 id='related-work'>Related work of others</h2><p>" + "some words of the text " * 8 + "</p><p class='notice'>Mind the gap here</p>"
               "<section id='how-to-share'><h3 class='share social ad'>How to share</h3><p data-class='ad' title=' class=ad '>Share it with care</p></section>"
               "<div class='alert widget'>An alert to heed</div><aside><article>teaser</article></aside><div class='x cookie-notice'>We use cookies</div></article>")
    exp = "\n".join(["Related work of others", ("some words of the text " * 8).strip(), "Mind the gap here", "How to share", "Share it with care", "An alert to heed"])
    foot = "<aside>See also that other thing</aside><section class='comments'><p>Great post by me, the reader, indeed</p></section><footer>x y</footer>"
    for a, z in [("", ""), ("<div class='content has-sidebar'>", "</div>"), ("<div class='nav ad'>", "</div>"), ("<form role='navigation'>", "</form>"), ("<div class='ads'><main>", "</main></div>")]:
        assert html_extract.extract(f"<html><body><nav>Home</nav><div class='ad'>buy this</div>{a}{article}{z}{foot}</body></html>", weights) == exp
    assert weights["class comments"] < 0 and not any(f.startswith("class ad") for f in weights)


def test_main_text_cuts_comments_out_of_the_article():
    bar = "<div class='share-bar'><div>Tell <b>your friends</b></div></div>"
    page = PAGE.replace("<aside>", bar + "<aside>")
    weights = html_extract.train([page.replace("{i}", str(i)) for i in range(20)])
    assert weights["words class comments"] == weights["words class share-bar"] == -1.0
    inner = "<section class='x comments'><p>A reader says</p><div><p>and another one says so</p></div></section>"
    got = html_extract.extract("<body><nav>Home</nav><article><p>First part of the text.</p>" + inner + bar + "<h2 class='comments'>A heading of it</h2>"
                               "<p class='y'>Second a&nbsp;&nbsp;b \u2003 c part of the text.</p></article><footer>foot</footer></body>", weights)
    assert got == "First part of the text.\nA heading of it\nSecond a b c part of the text."
    wrap = "<body><div class='comments'><article><p>The text stays whole here.</p></article></div></body>"
    assert html_extract.extract(wrap, weights) == "The text stays whole here."
    few = html_extract.train([page.replace("{i}", str(i)) for i in range(html_extract.SEEN - 1)])
    assert not any(f.startswith("words ") for f in few)


def test_cosine_of_large_and_small_components():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(50, 9)), rng.normal(size=(50, 9))
    plain = np.array([cosine(x, y) for x, y in zip(a, b, strict=True)])
    for scale in (2.0 ** 660, 2.0 ** -600, 1.0):
        assert np.allclose(pivot_join.cosine(a * scale, b), plain, rtol=0, atol=1e-15)
    assert np.isfinite(pivot_join.cosine(np.full((1, 3), 1e200), np.full((1, 3), -1e-200))).all()
    assert pivot_join.cosine(a[:0], b[:0]).shape == (0,)


def test_main_text_of_the_pages_equals_their_articles(spark):
    pages = read(spark, SF, "pages")
    got = {r.page_id: r.text for r in html_extract.main_text(pages, html_extract.learn(pages)).collect()}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        words = html_extract.entities.unescape(html_extract.re.sub(r"<[^>]*>", " ", body)).split()
        assert got[r.page_id].split() == words


def test_pipeline(spark):
    docs = read(spark, SF, "documents")
    rows = docs.collect()
    weights, bias = toxicity.train(docs, read(spark, SF, "labels"), F.lit(True))
    score = {r.doc_id: r.score for r in toxicity.score(docs, weights, bias).collect()}
    clean = {r.doc_id: r for r in rows if score[r.doc_id] < 0.5}
    fp = {d: simhash_ball.fingerprint(r.text) for d, r in clean.items()}
    least = {d: d for d in clean}
    for _ in clean:
        before = dict(least)
        for a in clean:
            for b in clean:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    least[a] = min(least[a], least[b])
        if before == least:
            break
    got = corpus_pipeline.run(spark, SF).toPandas()
    kept = {d for d in clean if least[d] == d}
    assert set(got.doc_id) <= kept and got.groupby("doc_id").size().max() <= 3 and got.round_trip.all()
    assert 0.7 < len(got) / len(kept) < 1.3
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "personal_data", "mixing", "sentencepiece"]
    assert sentencepiece_codec.encode(docs).where("NOT round_trip").count() == 0
