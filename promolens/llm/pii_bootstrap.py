"""Personal data by fixed patterns, and by contexts learned from what those find.

Candidate instances are emails, IP and phone numbers, runs of digits joined by single blanks or hyphens, and any other
token (ended by white space, ``=`` or ``:``) that holds a digit or an @; those that the base accepts as a whole are seeds.
The words before a candidate, back to the last one, are lexical patterns (the last word, the last two). On the graph of patterns and
instances scores go to and fro for ``ROUNDS`` rounds: a pattern's score is the weighted mean of its
instances', a new instance's that of its patterns; seeds stay at 1. A pattern is trusted if its score
reaches ``TRUST``, it was seen before ``SUPPORT`` different seeds, and ``TRUST`` of these are of one
kind, which is then the kind of the identifiers it discovers (``found_email`` and so on).

Only DataFrame functions are used. Places come from splitting a text at the matches and summing up the
lengths of what lies between, in proportion to their number; they count code points, the end is exclusive. Patterns are possessive or
anchored where that changes no match, so no text makes them backtrack far or recurse.

Nulls: a null text is empty. Rows with equal (or null) doc_id are told apart by a hash of the text;
repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, store

KINDS = ("email", "ip", "card", "phone")
#: \\G: a match may begin where the last one ended, or where its first run of characters begins.
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: The candidates, leftmost first: email, IP, phone, run of digits, other token; white space as in Java's \s.
_CANDIDATE = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
              r"|(?<![0-9.])[0-9]++(?:\.[0-9]++){3}(?![0-9.]*[0-9])"
              r"|\+[0-9](?:[\x20().-]{0,2}[0-9])++"
              r"|(?<![^\s=:])[0-9]++(?:[\x20-][0-9]++)*+(?![^\s.,;:!?)\]}'\"])"
              r"|(?<![^\s=:])[^\s0-9@=:]*+[0-9@][^\s]*+")
#: Matches whose places are summed up in one go.
RUN = 128
#: Parts into which the edges of each pattern and of each instance are dealt.
FAN = 16
ROUNDS = 3
TRUST = 0.8
SUPPORT = 5
#: An identifier that a pattern discovers has so many digits, or an @.
DIGITS = 4

_PLACE = "array<struct<start:int,end:int,value:string,gap:string>>"


def places(text: Column, pattern: str) -> Column:
    """start, end, value and the text before (since the last match) of all matches."""
    pairs = F.filter(F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
                                lambda v, g: F.struct(v.alias("value"), g.alias("gap"))), lambda x: x["value"].isNotNull())
    # An array that grows by a match is copied each time. So runs of matches are placed each by itself, from the
    # places where runs begin; those are summed up in runs of runs, so the work stays in proportion.
    def place(at, xs):
        none = F.struct(at.alias("at"), F.array().cast(_PLACE).alias("out"))

        def step(acc, x):
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["value"])
            one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["gap"].alias("gap"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))
        return F.aggregate(xs, none, step, lambda acc: acc["out"])

    def all_runs(ps):
        begins = _ends(F.transform(ps, lambda x: F.length(x["gap"]) + F.length(x["value"])), RUN)
        return F.flatten(F.transform(begins, lambda at, i: place(at, F.slice(ps, i * RUN + 1, RUN))))

    return _let(pairs, all_runs)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a name inside a lambda stands for a value, not for its expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(values: Column, size: int) -> Column:
    """Sums of consecutive runs of ``size`` numbers."""
    n = F.ceil(F.size(values) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.aggregate(
        F.slice(values, i * size + 1, size), F.lit(0), lambda a, x: a + x))).otherwise(F.array().cast("array<int>"))


def _before(values: Column) -> Column:
    """For every number the sum of those before it (for a short array)."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, none, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                       lambda acc: acc["out"])


def _ends(lengths: Column, size: int) -> Column:
    """Where each run of ``size`` matches begins: the sum of all lengths before it, in two levels."""
    def lower(sums):
        return F.flatten(F.transform(_before(_runs(sums, size)), lambda at, i: _let(
            at, lambda a: F.transform(_before(F.slice(sums, i * size + 1, size)), lambda b: a + b))))
    return _let(lengths, lambda ls: _let(_runs(ls, size), lower))


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = F.translate(v, " -", "")
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end): by kind as in ``KINDS``, then by start."""
    def one(i: int, kind: str) -> Column:
        need = _NEEDS[kind]
        has = F.contains(text, F.lit(need)) if need else text.rlike("[0-9]")
        found = F.filter(places(text, _PATTERN[kind]), lambda x: _valid(kind, x["value"]))
        slim = F.transform(found, lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return F.when(has, slim).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int>>"))

    return F.concat(*[one(i, kind) for i, kind in enumerate(KINDS)])


def kind_of(v: Column) -> Column:
    """The kind of a candidate that is, as a whole, what the base accepts; else null."""
    whole = {"email": r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++$", "ip": r"^[0-9]++(\.[0-9]++){3}$",
             "card": r"^[0-9](?:[\x20-]?[0-9])++$", "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$"}
    return F.coalesce(*[F.when(v.rlike(whole[kind]) & _valid(kind, v), F.lit(i)) for i, kind in enumerate(KINDS)], F.lit(None).cast("int"))


def candidates(text: Column) -> Column:
    """Array of (start, end, instance, kind (if the base accepts it, else null), patterns)."""
    def describe(x):
        words = F.filter(F.split(F.lower(x["gap"]), r"\s+"), lambda w: w != "")
        last, two = F.get(words, F.size(words) - 1), F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " ")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(x["value"]).alias("instance"), kind_of(x["value"]).alias("kind"),
                        F.array_distinct(F.filter(F.array(last, two), lambda p: p.isNotNull() & p.rlike(r"\p{L}"))).alias("patterns"))

    kind = "array<struct<start:int,end:int,instance:string,kind:int,patterns:array<string>>>"
    return F.when(text.rlike("[0-9@]"), F.transform(places(text, _CANDIDATE), describe)).otherwise(F.array().cast(kind))


def _shared(edges: DataFrame, node: str, other: str, partial: dict[str, Column], whole: dict[str, Column]) -> DataFrame:
    """``edges`` with ``whole``, aggregates per ``node`` of the ``partial`` ones.

    Edges of a node are dealt to ``FAN`` parts by their other end, so a pattern or an instance that holds much of the
    graph is summed up and gets its result back in several tasks.
    """
    dealt = edges.withColumn("_part", F.pmod(F.xxhash64(other), F.lit(FAN)))
    parts = dealt.groupBy(node, "_part").agg(*[c.alias(k) for k, c in partial.items()])
    back = parts.groupBy(node).agg(*[c.alias(k) for k, c in whole.items()], F.collect_set("_part").alias("_parts"))
    return dealt.join(back.select(node, *whole, F.explode("_parts").alias("_part")), [node, "_part"]).drop("_part")


def trusted_patterns(occurrences: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """pattern, kind, score: the trusted ones, from (instance, kind or null, patterns).

    Scores are rounded to nine places, so the order in which they are summed up decides nothing.
    """
    edges = store(occurrences.select("instance", "kind", F.explode("patterns").alias("pattern"))
                  .groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")), "edges")
    seeded = _shared(edges, "instance", "pattern", {"seed": F.max("kind")}, {"seed": F.max("seed")})
    scored = store(seeded.withColumn("r", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0)), "scores")

    def mean(frame, node, other, of, to):
        sums = {"_w": F.sum(F.col("n") * F.col(of)), "_n": F.sum("n")}
        return _shared(frame, node, other, sums, {to: F.round(F.sum("_w") / F.sum("_n"), 9)})

    for _ in range(rounds):
        given = mean(scored, "pattern", "instance", "r", "p")
        back = mean(given.drop("r"), "instance", "pattern", "p", "i")
        scored = store(back.withColumn("r", F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.col("i"))).drop("i", "p"), "scores")
    total = scored.groupBy("pattern").agg(F.round(F.sum(F.col("n") * F.col("r")) / F.sum("n"), 9).alias("score"),
                                          *[F.count(F.when(F.col("seed") == k, 1)).alias(f"k{k}") for k in range(len(KINDS))])
    counts = [F.col(f"k{k}") for k in range(len(KINDS))]
    most = F.greatest(*counts)
    every = sum(counts[1:], counts[0])
    kind = F.coalesce(*[F.when(c == most, F.lit(k)) for k, c in enumerate(counts)])
    return total.where((every >= support) & (F.col("score") >= trust) & (most >= trust * every)).select("pattern", kind.alias("kind"), "score")


def find(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_hash, ``keep``, base and found: arrays of (kind, start, end) for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), *keep, text.alias("text"))
    spans = own.withColumn("base", base_spans(F.col("text")))
    read = store(spans.withColumn("cand", candidates(F.col("text"))).drop("text"), "spans")
    rows = read.select("doc_id", "text_hash", F.explode("cand").alias("c")).select("doc_id", "text_hash", "c.*")
    good = trusted_patterns(rows.select("instance", "kind", "patterns"))
    fresh = rows.where(F.col("kind").isNull() & (F.col("instance").contains("@") | (F.length(F.regexp_replace("instance", "[^0-9]", "")) >= DIGITS)))
    hits = fresh.withColumn("pattern", F.explode("patterns")).drop("kind").join(good, "pattern")
    best = hits.groupBy("doc_id", "text_hash", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    # Base spans stay as they are: what overlaps one is not found anew. Both meet by stretches of text.
    stretch = lambda d: d.withColumn("at", F.explode(F.sequence(F.shiftright("start", 6), F.shiftright("end", 6))))
    known = stretch(read.where(F.size("base") > 0).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.explode("base").alias("b"))
                    .select("_d", "_h", F.col("b.start").alias("start"), F.col("b.end").alias("end"))).toDF("_d", "_h", "_start", "_end", "_at")
    over = (stretch(best).join(known, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")) & (F.col("at") == F.col("_at")))
            .where((F.col("_start") < F.col("end")) & (F.col("_end") > F.col("start"))).select("doc_id", "text_hash", "start", "end").distinct().toDF("_d", "_h", "_start", "_end"))
    best = best.join(over, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")) & (F.col("start") == F.col("_start")) & (F.col("end") == F.col("_end")), "left_anti")
    found = best.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("found"))
    found = found.toDF("_d", "_h", "found")
    out = read.drop("cand").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left").drop("_d", "_h")
    return out.withColumn("found", F.coalesce("found", F.array().cast("array<struct<kind:int,start:int,end:int>>")))


def span_text(spans: Column, prefix: str = "") -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    names = F.array(*[F.lit(prefix + k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _begins(at: Column, spans: Column, size: int) -> Column:
    """How far a text is read before each run of ``size`` spans, and after the last: the greatest end so far."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(spans) / F.lit(size)).cast("int") - 1)
    return F.aggregate(runs, F.array(at), lambda acc, i: F.concat(acc, F.array(F.greatest(
        F.element_at(acc, -1), F.array_max(F.transform(F.slice(spans, i * size + 1, size), lambda s: s["end"]))))))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (of overlapping ones the first) replaced by <KIND>.

    Runs of spans are replaced in the stretch of text they cover, and joined, so the work stays in proportion to the text.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def replaced(body, first, run):
        none = F.struct(first.alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc, s):
            add = F.array(F.substring(body, acc["at"] - first + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                            F.when(s["start"] >= acc["at"], F.concat(acc["out"], add)).otherwise(acc["out"]).alias("out"))
        return F.aggregate(run, none, step, lambda acc: F.array_join(acc["out"], ""))

    def by_runs(body, first, run, sizes):
        if not sizes:
            return replaced(body, first, run)
        size = sizes[0]
        return _let(_begins(first, run, size), lambda at: F.array_join(F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda i: _let(
            F.struct(F.substring(body, F.get(at, i) - first + 1, F.get(at, i + 1) - F.get(at, i)).alias("body"), F.get(at, i).alias("first"),
                     F.slice(run, i * size + 1, size).alias("run")),
            lambda x: by_runs(x["body"], x["first"], x["run"], sizes[1:]))), ""))

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(
        _let(ordered, lambda xs: by_runs(text, F.lit(0), xs, (RUN * RUN, RUN))), F.substring(text, last + 1, F.length(text))))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans masked in ``text``, and ``n_chars`` (if there) counted anew; a null text stays null."""
    spans = find(docs).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.concat("base", "found").alias("spans"))
    some = spans.where(F.size("spans") > 0).dropDuplicates(["_d", "_h"])
    keyed = boxed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("text_hash"))
    out = keyed.join(some, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    text, none = F.col("row.text"), F.col("spans").isNull()
    new = F.when(none, text).otherwise(masked(text, F.col("spans")))
    row = F.col("row").withField("text", new)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(none, F.col("row.n_chars")).otherwise(F.length(new).cast(kind)))
    return out.select(row.alias("row")).select("row.*")
