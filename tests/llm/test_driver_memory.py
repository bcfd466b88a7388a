"""What the driver holds while it fits a model (round 3: the pipeline took more than 1500 MB of its memory on check_h)."""

import mmap
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from promolens.llm import toxicity
from promolens.llm.bytehash import RangeHash


def test_features_reach_the_fit_by_doc_id_and_without_a_copy_each(spark, monkeypatch):
    texts = {7: "one two three", 3: "", 5: None, 1: "four five"}
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2 if k < 7 else 0, k // 4) for k in texts], "doc_id long, quality int, toxic int")
    got = {}
    monkeypatch.setattr(toxicity, "ftrl", lambda rows, y, bits: got.update(rows=rows, y=y) or (np.zeros(4), 0.0))
    toxicity.train(docs, labels, F.lit(True))
    order = sorted(texts)
    ranges = RangeHash(1 << 20)
    assert got["y"].tolist() == [k // 4 for k in order] and got["y"].dtype == float
    for k, x in zip(order, got["rows"], strict=True):
        assert x.tolist() == toxicity.text_features((texts[k] or "").encode(), ranges).tolist()
        assert not isinstance(x.base, bytes)


def test_no_labels_at_all(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    weights, bias = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert not weights.any() and bias == -20.0


def test_features_wait_in_a_file_of_the_driver(spark, monkeypatch):
    """Neither whole in Arrow's or Python's memory, nor, where the texts have no words, a file that cannot be mapped."""
    words = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 2000), x -> concat('w', id * 2000 + x))) AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    got = {}
    monkeypatch.setattr(toxicity, "ftrl", lambda rows, y, bits: got.update(rows=rows) or (np.zeros(4), 0.0))
    arrow, whole = pa.total_allocated_bytes(), 0
    tracemalloc.start()
    try:
        toxicity.train(words, labels, F.lit(True))
        whole = sum(x.nbytes for x in got["rows"])
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(got["rows"]) == 400 and whole > 8_000_000
    assert pa.total_allocated_bytes() - arrow < whole / 4 and held < whole / 4 and most < whole

    def owner(x):
        while isinstance(x, np.ndarray | memoryview):
            x = x.base if isinstance(x, np.ndarray) else x.obj
        return x
    assert all(isinstance(owner(x), mmap.mmap) for x in got["rows"])
    toxicity.train(words.withColumn("text", F.lit(" . ")), labels, F.lit(True))
    assert [len(x) for x in got["rows"]] == [0] * 400


def test_weights_by_blocks(monkeypatch):
    """The same weights as in one block, without a temporary of all coordinates for each step of their formula."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 1 << 10, 50)) for _ in range(200)]
    labels = rng.integers(0, 2, 200).astype(float)
    whole, bias = toxicity.ftrl(rows, labels, 10)
    monkeypatch.setattr(toxicity, "_BLOCK", 7)
    parts, again = toxicity.ftrl(rows, labels, 10)
    assert whole.any() and whole.tolist() == parts.tolist() and bias == again
    monkeypatch.undo()
    tracemalloc.start()
    try:
        toxicity.ftrl(rows[:2], labels[:2], 20)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 3 * 8 * (1 << 20)
