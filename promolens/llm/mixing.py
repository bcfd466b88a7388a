"""Mixing sources to target weights by systematic sampling.

Each source has an expected number of copies for every document (its target over its size).
Documents are put in one order within the source, the expected copies are summed along it, one
random offset is added, and a document is emitted once for each integer that the sum crosses at
it. Ordering by size makes the sample follow the sizes, so the words taken come near the target.

Prefix sums are taken in two levels: rows are range-partitioned by (source, size, doc_id), each
partition counts its rows by source, the counts of the partitions before are added up, and ranks
are counted within a partition and source. No source, however hot, is ever one task.

Nulls: a null text has size 0; a null source is a source of its own, after all others; a null
doc_id sorts first. A document of size 0 is taken like any other and adds no words; a source
without words has target 0 and nothing of it is taken. Repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, partitions, store

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source's target is at most this many times its size.
MOST = 3
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source.

    Sources are capped in the order in which a common level per weight would reach their caps.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    w = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    d = lambda c: F.col(c).cast("decimal(38,0)")
    base = 1
    for x in weights:
        base *= x
    order = Window.orderBy(d("source_size") * F.lit(base).cast("decimal(10,0)") / d("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    zero = F.lit(0).cast("long")
    p = (w.withColumn("cap", F.col("source_size") * most)
         .withColumn("total", F.sum("source_size").over(all_)).withColumn("weights", F.sum("w").over(all_))
         .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), zero))
         .withColumn("rest_w", F.col("weights") - F.coalesce(F.sum("w").over(before), zero))
         .withColumn("capped", d("w") * d("rest") > d("cap") * d("rest_w")))
    left = (p.withColumn("left", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(zero)).over(all_))
            .withColumn("left_w", F.col("weights") - F.sum(F.when(F.col("capped"), F.col("w")).otherwise(zero)).over(all_)))
    return left.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double"))
                       .otherwise((F.col("w") * F.col("left")).cast("double") / F.col("left_w").cast("double")).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """One number in (0, 1) for each source, with few enough bits to be added exactly."""
    digest = F.md5(F.concat(F.lit(seed), F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))))
    return (F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") + 0.5) / 65536.0


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED,
        keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, ``keys``, size, source_size, target, copies: one row for each row of ``docs``."""
    own = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", *keys,
                            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    ordered = ["size", "doc_id", *keys]
    ranged = store(own.repartitionByRange(partitions(docs.sparkSession), "source", *ordered)
                   .withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    counts = store(counts, "counts")
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    known = counts.select("part", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    known = known.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = known.select(F.col("part").alias("_part"), F.col("source").alias("_source"), "before", "source_size", "target")
    joined = ranged.join(known, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    rank = F.row_number().over(Window.partitionBy("part", "source").orderBy(*ordered)) + F.col("before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    crossed = F.floor(offset(F.col("source"), seed) + rate * F.col("rank")) - F.floor(
        offset(F.col("source"), seed) + rate * (F.col("rank") - 1))
    return (joined.withColumn("rank", rank.cast("double")).withColumn("copies", F.least(crossed, F.lit(most)).cast("long"))
            .select("doc_id", "source", *keys, "size", "source_size", "target", "copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row as often as the mix takes it.

    Rows are numbered in a stored table first, so each is a document of its own in the order of :func:`mix` and gets
    its own copies by its number: no group of equal rows, however large, meets in one task. Which of several rows equal
    in doc_id, source and text (by hash) is taken more often follows their numbers, that is, their place in the input.
    """
    numbered = store(boxed(docs).withColumn("id", F.monotonically_increasing_id()), "numbered")
    keyed = numbered.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.col("row.text").alias("text"),
                            F.xxhash64("row.text").alias("h"), "id")
    taken = mix(keyed, keys=("h", "id"), **how).where("copies > 0").select("id", "copies")
    return (numbered.join(taken, "id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("row.*"))
