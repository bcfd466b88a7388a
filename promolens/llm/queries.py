"""The queries of this subpackage, by name, and their DuckDB statements where SQL can say them.

Each query applies its operator with production parameters to its whole table and derives the
columns of its contract from the operator's results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (graph_ann, html_extract, lang_id, link_trust, mixing, phrase_tiles, pii_bootstrap, pivot_join, sentencepiece_codec,
               simhash_ball, suffix_dedup, toxicity, whitening)
from .common import held_out, read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = lang_id.train(docs, ~held_out(F.col("doc_id"), 4, 2))
    return lang_id.predict(docs, *model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(read(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_extract.main_text(pages, html_extract.learn(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    weights, bias = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return toxicity.score(docs, weights, bias).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.find(read(spark, sf_dir, "documents"))
    base = pii_bootstrap.span_text(F.col("base"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.concat_ws(",", *[F.when(x != "", x) for x in (base, pii_bootstrap.span_text(F.col("found"), "found_"))])
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii_bootstrap.KINDS)],
                        F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op7_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph_ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select(F.col("query_id"), "rank", "vec_id", "score")


def op8_pivot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_join.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_ball.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_phrase_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_tiles.phrases(read(spark, sf_dir, "documents"))


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_language, op3_sentencepiece, op4_main_text, op5_toxicity, op6_personal_data, op7_graph_neighbours, op8_pivot_join,
    op9_simhash_ball, op10_systematic_mix, op11_phrase_tiles, op12_jacobi_whitening, op13_link_trust)}


def _link_rounds(rounds: int, damping: float) -> str:
    """The scores of every round, each from the one before."""
    step = """s{n} AS (SELECT kind, u, sum(score) AS score FROM (
    SELECT s.kind, w.v AS u, s.score * w.w * {d} AS score FROM s{b} s JOIN ways w ON s.kind = w.kind AND s.u = w.u
    UNION ALL SELECT kind, u, score FROM s0) GROUP BY kind, u)"""
    return ",\n".join(step.format(n=i, b=i - 1, d=damping) for i in range(1, rounds + 1))


ORACLE: dict[str, str] = {
    "op10_systematic_mix": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS cap FROM sources),
filled AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS weights,
         coalesce(sum(cap) OVER (ORDER BY source_size * 6 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(w) OVER (ORDER BY source_size * 6 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM weighed),
decided AS (SELECT *, w * (total - cap_before) > cap * (weights - w_before) AS capped FROM filled),
goal AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE
              ELSE (w * (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)))::DOUBLE
                   / (weights - coalesce(sum(w) FILTER (capped) OVER (), 0))::DOUBLE END AS target
  FROM decided),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS k FROM docs),
rated AS (
  SELECT doc_id, size, source_size, target, k,
         (('0x' || substr(md5('mix-1' || CASE WHEN r.source IS NULL THEN '0' ELSE '1' || r.source END), 1, 4))::INTEGER::DOUBLE + 0.5) / 65536.0 AS u,
         CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate
  FROM ranked r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       size * least((floor(u + rate * k::DOUBLE) - floor(u + rate * (k - 1)::DOUBLE))::BIGINT, 3) AS taken
FROM rated""",
    "op11_phrase_tiles": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY lang),
parts AS (
  SELECT lang, m, phrase, a, k, string_split(phrase, ' ') AS w FROM f, (VALUES (1), (2)) cuts(k) WHERE m > k AND a >= 10),
cut AS (
  SELECT p.lang, p.m, p.phrase, p.a, p.k, x.a AS l, y.a AS r, 1000000 * p.a * p.a // (x.a * y.a) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.m = p.k AND x.phrase = array_to_string(p.w[1:p.k], ' ')
  JOIN f y ON y.lang = p.lang AND y.m = p.m - p.k AND y.phrase = array_to_string(p.w[p.k + 1:], ' ')),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (
  SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM parts WHERE m = 3 AND k = 1),
longest AS (SELECT lang, phrase, max(a) AS a FROM inner_of GROUP BY ALL),
kept AS (
  SELECT c.* FROM lowest c LEFT JOIN longest g ON g.lang = c.lang AND g.phrase = c.phrase AND c.m = 2
  WHERE g.a IS NULL OR 100 * g.a < 50 * c.a),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM placed JOIN sizes USING (lang) WHERE rank <= 2000""",
    "op13_link_trust": r"""
WITH parsed AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parsed),
judged AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM ruled),
hosts AS (
  SELECT host, count(*) FILTER (verdict = 'allow') / count(*)::DOUBLE AS good, count(*) FILTER (verdict = 'block') / count(*)::DOUBLE AS bad
  FROM judged WHERE host <> '' GROUP BY host),
found AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)<a\s[^<>]*?\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM judged WHERE host <> ''),
edges AS (SELECT src, dst, count(*) AS n FROM found WHERE src <> dst GROUP BY ALL),
two_way AS (SELECT 'trust' AS kind, src AS u, dst AS v, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
ways AS (SELECT kind, u, v, n / (sum(n) OVER (PARTITION BY kind, u))::DOUBLE AS w FROM two_way),
s0 AS (SELECT 'trust' AS kind, host AS u, good AS score FROM hosts WHERE good > 0 UNION ALL SELECT 'distrust', host, bad FROM hosts WHERE bad > 0),
""" + _link_rounds(link_trust.ROUNDS, link_trust.DAMPING) + f""",
lasting AS (
  SELECT u AS host, coalesce(sum(score) FILTER (kind = 'distrust'), 0) - coalesce(sum(score) FILTER (kind = 'trust'), 0) AS d
  FROM s{link_trust.ROUNDS} GROUP BY u)
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN d >= {link_trust.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN lasting ON lasting.host = j.host AND j.host <> ''""",
}
