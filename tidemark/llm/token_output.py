"""Operator 1: token ids as flat binary shards with 64-bit document offsets.

Layout of a written folder, one triple of files per range of document ids, in ascending order:

* ``shard-00000.tok``  ids of all its documents in a row, little-endian unsigned 16 or 32 bit
  (the narrowest that holds the vocabulary);
* ``shard-00000.off``  unsigned 64-bit offsets, one more than documents, in ids from the shard's start;
* ``shard-00000.doc``  signed 64-bit document ids (a null id is stored as the least value);
* ``manifest``         Parquet: shard, dtype, documents, ids.

A document's global start is its shard's base, the prefix sum of the ids of earlier shards,
plus its offset; nothing that grows with the documents passes through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, new_folder, open_fs, spread
from tidemark.llm.encoding import encoder_for

NULL_ID = np.iinfo(np.int64).min
BATCH_CHARS = 4_000_000
ENCODED_CHARS = 8_000_000  # a call of the encoder looks each segment up once


def text_batches(ids: list, texts: list, most: int = BATCH_CHARS) -> Iterator[tuple[list, list]]:
    """Cut one Arrow batch into pieces of bounded text size (a single text is never cut)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield ids[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


def write_token_shards(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, shards: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``out_dir`` in ascending doc_id order.

    Null text: empty (the end id alone). Null doc_id: first. Repeated doc_ids stand next to each
    other, ordered by text. Further columns are not read. An empty table gives an empty manifest.
    A shard's files are written under a name of the attempt and then moved, so a lost executor's
    task can run again.
    """
    fields = "shard int, dtype string, documents long, ids long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        encoder, fs, at, out, lengths, doc_ids = None, None, "", None, [], []
        for batch in batches:
            for ids, texts in text_batches(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ENCODED_CHARS):
                if out is None:
                    encoder = encoder_for(tokenizer_path, end_id)
                    fs, folder = open_fs(out_dir)
                    fs.create_dir(folder, recursive=True)
                    at = f"{folder}/shard-{shard:05d}"
                    out = fs.open_output_stream(f"{at}.tok.{attempt}")
                encoded = encoder.encode(texts)
                out.write(b"".join(encoded))
                lengths.append(np.array([len(x) for x in encoded], np.int64) // encoder.dtype.itemsize)
                doc_ids.append(np.array([NULL_ID if i is None else i for i in ids], "<i8"))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<u8")
        for kind, data in (("off", offsets), ("doc", np.concatenate(doc_ids))):
            with fs.open_output_stream(f"{at}.{kind}.{attempt}") as f:
                f.write(data.tobytes())
        for kind in ("tok", "off", "doc"):
            fs.move(f"{at}.{kind}.{attempt}", f"{at}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "dtype": [encoder.dtype.str], "documents": [len(offsets) - 1], "ids": [int(offsets[-1])]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards or spread(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(frugal(write), fields).write.parquet(f"{out_dir}/manifest")


def shard_bases(spark: SparkSession, out_dir: str) -> DataFrame:
    """The manifest with each shard's base: ids of all documents of earlier shards."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{out_dir}/manifest").withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def _mapped(fs, at: str, kind: str, dtype: str) -> np.ndarray:
    """A shard file: memory-mapped where the folder is local, else read."""
    if fs.get_file_info(f"{at}.{kind}").size == 0:
        return np.empty(0, dtype)
    if fs.type_name == "local":
        return np.memmap(f"{at}.{kind}", dtype, "r")
    with fs.open_input_file(f"{at}.{kind}") as f:
        return np.frombuffer(f.read(), dtype)


def scan_token_shards(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(out_dir)
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{folder}/shard-{row['shard']:05d}"
                ids, offsets, doc_ids = _mapped(fs, at, "tok", row["dtype"]), _mapped(fs, at, "off", "<u8").astype(np.int64), _mapped(fs, at, "doc", "<i8")
                for k in range(0, len(doc_ids), 4096):
                    own = doc_ids[k : k + 4096]
                    cuts = offsets[k : k + 4097]
                    crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cuts[:-1], cuts[1:])]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own, pa.int64(), mask=own == NULL_ID), "start": cuts[:-1] + row["base"], "n_tokens": np.diff(cuts), "ids_crc32": pa.array(crcs, pa.int64())})

    shards = shard_bases(spark, out_dir).repartition(spread(spark), "shard")
    return shards.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, out_dir: str | None = None) -> DataFrame:
    """Write the shards, then return what the files hold per document."""
    out_dir = out_dir or new_folder(docs.sparkSession, "token-shards")
    write_token_shards(docs, out_dir, tokenizer_path, end_id)
    return scan_token_shards(docs.sparkSession, out_dir)
