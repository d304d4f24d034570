"""Op 3: token ids as Parquet list columns, written and read back.

Layout of a folder of token files, one row per document:

    doc_id, part int, first bigint, n_tokens bigint, ids array<int>

Documents ascend by id over the files and inside each.  ``ids`` is dictionary
encoded (a vocabulary has tens of thousands of values); the numbers are delta
encoded (format version 2, dictionary off for them).  Row groups and pages are
kept small and the writer adds page indexes, so a reader that wants one
document or only the metadata skips the other pages and column chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import on_workers, public_vocabulary, text_or_empty
from .text_encoding import OUTPUT_CHARS, encoder, grouped

END_ID = 2
# Bytes of a row group before compression, documents on a page.
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 1000
# Characters looked up together: fewer than elsewhere, since the writer's row
# groups and the sort share the executor's memory.
GROUP_CHARS = 4_000_000


def writer_options(row_group_bytes: int = ROW_GROUP_BYTES,
                   page_rows: int = PAGE_ROWS) -> dict[str, str]:
    """Parquet settings of the token files."""
    delta = {f"parquet.enable.dictionary#{c}": "false"
             for c in ("doc_id", "part", "first", "n_tokens")}
    return {"parquet.writer.version": "PARQUET_2_0", "compression": "snappy",
            "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.row.count.limit": str(page_rows), **delta}


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """The documents of one file, in order; ``first`` runs through the file."""
    enc = encoder(path)
    end = np.array([end_id], dtype="<u4").tobytes()
    total = 0
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in grouped(texts, GROUP_CHARS):
            ids = enc.ids(texts[a:b])
            for c, d in grouped(texts[a:b], OUTPUT_CHARS):
                found = list(islice(ids, d - c))
                n = np.array([len(x) // 4 + 1 for x in found], dtype=np.int64)
                ends = np.cumsum(n)
                flat = b"".join(part for x in found for part in (x, end))
                del found
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()),
                                                 pa.array(np.frombuffer(flat, dtype="<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a + c, d - c), pa.array(total + ends - n), pa.array(n), lists],
                    names=["doc_id", "first", "n_tokens", "ids"])
                total += int(ends[-1])


def write_token_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                      vocabulary: str | None = None, end_id: int = END_ID,
                      row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode every whole text (null: empty) and write the token files to ``path``.

    The texts, not the longer id lists, are dealt into ranges of
    (id, text hash); so even an id shared by a third of all rows is spread.
    Documents of one id are ordered by text.  Null ids come first.
    """
    vocab = vocabulary or public_vocabulary("word_bpe_49k.json")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    key = F.xxhash64("text")
    ranged = (rows.repartitionByRange("doc_id", key)
              .sortWithinPartitions("doc_id", key, "text"))
    out = ranged.mapInArrow(on_workers(_encode, vocab, end_id),
                            f"doc_id {kind}, first bigint, n_tokens bigint, ids array<int>")
    (out.select("doc_id", F.spark_partition_id().alias("part"), "first", "n_tokens", "ids")
     .write.mode("overwrite").options(**writer_options(row_group_bytes, page_rows)).parquet(path))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        ids = np.asarray(lists.values).astype("<u4", copy=False)
        at = np.asarray(lists.offsets).tolist()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3],
             pa.array([e - s for s, e in zip(at, at[1:])], pa.int64()),
             pa.array([zlib.crc32(ids[s:e]) for s, e in zip(at, at[1:])], pa.int64())],
            names=["doc_id", "part", "first", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: the documents of a folder of token files.

    ``start`` counts the ids of all documents before.  Columns that are not
    selected are not read.
    """
    files = spark.read.parquet(path)
    return _with_start(files, files).select("doc_id", "start", "n_tokens", "ids")


def _with_start(rows: DataFrame, files: DataFrame) -> DataFrame:
    # One row per file, from the metadata columns alone.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(base, "part").withColumn("start", F.col("_base") + F.col("first"))


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from its stored ids."""
    files = spark.read.parquet(path)
    kind = dict(files.dtypes)["doc_id"]
    rows = files.select("doc_id", "part", "first", "ids").mapInArrow(
        on_workers(_digest),
        f"doc_id {kind}, part int, first bigint, n_tokens bigint, ids_crc32 bigint")
    return _with_start(rows, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the documents as token files and return what the files hold."""
    spark = docs.sparkSession
    if path is None:
        import uuid
        path = scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    write_token_files(docs, path, **options)
    return token_file_digest(spark, path)
