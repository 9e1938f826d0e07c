"""Memory that the workers of one stage keep while the next one runs."""

import random
import string

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def wordy(spark):
    """Texts of mostly different words, four million characters in each of four partitions."""
    draw = random.Random(5)
    words = ["".join(draw.choices(string.ascii_lowercase, k=draw.randint(3, 9))) for _ in range(50_000)]
    rows = spark.createDataFrame(pa.table({"doc_id": list(range(600)), "text": [" ".join(draw.choices(words, k=4000)) for _ in range(600)]}))
    return rows.repartition(4, F.col("doc_id") % 4)


def held(spark):
    """MB that each worker has without using them: what it gives back when asked to."""

    def measure(batches):
        import ctypes
        import gc
        import re
        import time
        from pathlib import Path

        anonymous = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
        for batch in batches:
            time.sleep(1)  # so that each worker gets a task
            gc.collect()
            before = anonymous()
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
            yield pa.RecordBatch.from_pydict({"mb": pa.array([before - anonymous()], pa.float64())})

    return [r["mb"] for r in spark.range(0, 4, 1, 4).mapInArrow(measure, "mb double").collect()]


def test_workers_hold_little_after_encoding(spark, wordy):
    held(spark)  # what other tests left
    cut = packing.pieces(wordy, BPE, 2, 1024)
    assert cut.agg(F.sum("length")).first()[0] > 600 * 4000
    assert max(held(spark)) < 20


def test_packing_plan_has_no_rows_made_by_python_workers(spark, wordy):
    out = packing.packed(wordy.limit(20), BPE)
    assert "ExistingRDD" not in out._jdf.queryExecution().toString()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
