"""Op 12: importance resampling towards a target corpus, batch concatenation.

Features are runs of one and two words, hashed into buckets.  A batch's texts
are joined with separator bytes between them, and one regular expression pass
over the joined bytes finds all words.  ``searchsorted`` on the texts' offsets
gives each word its document, and pairs across two documents are masked.  The
hash of a pair follows from the hashes of its words (crc32 is linear), so each
word is hashed once; a ``bincount`` sums the buckets.

Counts of both corpora (one number a bucket) give each bucket a gain, the
log ratio of its shares; a document's weight is the mean gain of its features.
Weights with Gumbel noise from a hash of the id are ranked over all documents,
and the highest are drawn: sampling without replacement by importance.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_totals
from .common import materialise, on_workers, text_or_empty, with_row_id

BUCKETS = 10_000
SEED = 7
DRAW_PERCENT = 25
LEAST_WORDS = 20
# A word in UTF-8 after A-Z are lower-cased: digits, letters, and all beyond ASCII.
WORD = re.compile(rb"[\x30-\x39\x61-\x7A\x80-\xFF]+")
BREAK = re.compile(rb"[^\x30-\x39\x61-\x7A\x80-\xFF]")
# The same class by byte: a word starts where it begins to hold.
IN_WORD = np.array([WORD.fullmatch(bytes([b])) is not None for b in range(256)])
BLANK_CRC = np.uint32(zlib.crc32(b" "))
# Stands between texts; not part of any word.
SEPARATOR = b"\x00"
# Bytes joined together, and scanned together.
JOIN_BYTES = 4_000_000


def _byte_table() -> np.ndarray:
    """crc32's table: the effect of one byte, from the reversed polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


def _shift_tables(longest: int) -> np.ndarray:
    """(length, byte position, byte) -> what ``length`` more bytes make of that part of a crc32."""
    table = _byte_table()
    part = (np.arange(256, dtype=np.uint32)[None, :]
            << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [part]
    for _ in range(longest):
        part = (part >> np.uint32(8)) ^ table[part & np.uint32(255)]
        out.append(part)
    return np.stack(out)


LONGEST_STEP = 64
SHIFT = _shift_tables(LONGEST_STEP)


def joined_crc32(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of A + B from crc32(A), crc32(B) and the length of B, element by element."""
    length = length.copy()
    while True:
        step = np.minimum(length, LONGEST_STEP)
        moved = SHIFT[step, 0, first & np.uint32(255)]
        for k in (1, 2, 3):
            moved = moved ^ SHIFT[step, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
        first = moved
        length -= step
        if not length.any():
            return first ^ second


def _windows(data: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end outside words."""
    at = 0
    while at < len(data):
        found = BREAK.search(data, at + size)
        end = found.start() if found else len(data)
        yield at, end
        at = end


def batch_features(texts: Sequence[bytes], buckets: int,
                   window: int = JOIN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``(document, bucket, n)`` arrays of all features of a batch, some at a time.

    The first ``n`` features are the single words.  Memory is bounded by
    ``window`` beside the texts, however long one is.
    """
    data = SEPARATOR.join(texts).lower()  # bytes: A-Z only
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + len(SEPARATOR)
    offsets = np.cumsum(size) - size
    carry = None  # the last word so far: its document and crc32
    for a, b in _windows(data, window):
        words = WORD.findall(data, a, b)
        if not words:
            continue
        inside = IN_WORD[np.frombuffer(data, dtype=np.uint8, count=b - a, offset=a)]
        starts = a + np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        doc = np.searchsorted(offsets, starts, side="right") - 1
        alone = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        del words
        before_doc, before = doc[:-1], alone[:-1]
        if carry is not None:
            before_doc = np.concatenate([[carry[0]], before_doc])
            before = np.concatenate([np.array([carry[1]], dtype=np.uint32), before])
        skip = len(doc) - len(before_doc)
        same = before_doc == doc[skip:]
        spaced = joined_crc32(before[same], BLANK_CRC, np.ones(int(same.sum()), dtype=np.int64))
        pairs = joined_crc32(spaced, alone[skip:][same], length[skip:][same])
        carry = (int(doc[-1]), int(alone[-1]))
        yield (np.concatenate([doc, doc[skip:][same]]),
               (np.concatenate([alone, pairs]) % np.uint32(buckets)).astype(np.int64), len(doc))


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, about ``JOIN_BYTES`` at a time, with the first one's row."""
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= JOIN_BYTES or i + 1 == len(texts):
            yield start, texts[start:i + 1]
            start, size = i + 1, 0


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for _, texts in _groups(batch, 0):
            for _, bucket, _ in batch_features(texts, buckets):
                total += np.bincount(bucket, minlength=buckets)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])],
                                     names=["bucket", "n"])


def _weigh(batches: Iterator[pa.RecordBatch], gains: list[int]) -> Iterator[pa.RecordBatch]:
    gain = np.asarray(gains, dtype=np.float64)
    for batch in batches:
        for start, texts in _groups(batch, 2):
            n = len(texts)
            words, features, sums = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for doc, bucket, singles in batch_features(texts, len(gain)):
                words += np.bincount(doc[:singles], minlength=n)
                features += np.bincount(doc, minlength=n)
                # Whole numbers far below 2^53: exact in doubles.
                sums += np.bincount(doc, weights=gain[bucket], minlength=n).astype(np.int64)
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(words),
                 pa.array(features), pa.array(weight)],
                names=["_row", "doc", "n_words", "n_features", "weight"])


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all texts: each task sums its own, Spark sums the tasks' (bounded) rows."""
    part = texts.select(text_or_empty(text).alias("text")).mapInArrow(
        on_workers(_count, buckets), "bucket int, n bigint")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln of the smoothed target share over the smoothed raw share) per bucket."""
    buckets, raw_all, target_all = len(raw), int(raw.sum()), int(target.sum())
    return [math.floor(1000 * math.log(((int(t) + 1) * (raw_all + buckets))
                                       / ((int(s) + 1) * (target_all + buckets))))
            for s, t in zip(raw, target)]


def gumbel_noise(doc_id: str | Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(``seed:id``)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    u = (h + F.lit(0.5)) / F.lit(float(1 << 32))
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text",
             target_text: str = "text", buckets: int = BUCKETS, percent: int = DRAW_PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document.

    ``rank`` numbers the drawn documents from 1 (highest score first, ties to
    the smaller id, null ids last, then any order) and is null for the others.
    Null and empty texts have no features, weight 0 and are not drawn, like all
    under ``least_words`` words.  Repeated rows take part each; rows of one id
    share their noise, a null id counts as "null".  An empty target leaves
    gains of the raw counts alone; an empty table gives no rows; other columns
    are ignored.  Weights are written once to the shared folder.
    """
    def counts(table: DataFrame, column: str) -> np.ndarray:
        out = np.zeros(buckets, dtype=np.int64)
        for r in bucket_counts(table, column, buckets).collect():  # `buckets` rows at most
            out[r["bucket"]] = r["n"]
        return out

    gains = bucket_gains(counts(docs, text), counts(target, target_text))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = with_row_id(docs.select(F.col(doc_id).alias("doc"), text_or_empty(text).alias("text")))
    weighed = materialise(rows.select("_row", "doc", "text").mapInArrow(
        on_workers(_weigh, gains), f"_row bigint, doc {kind}, n_words bigint, n_features bigint, weight bigint")
        .withColumn("score", F.col("weight") + gumbel_noise("doc", seed)))
    long_enough = F.col("n_words") >= least_words
    drawn = percent * weighed.where(long_enough).count() // 100
    ranked = running_totals(weighed.where(long_enough),
                            [F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("_row")], position="rank")
    columns = ["doc", "n_words", "n_features", "weight", "score"]
    place = F.when(F.col("rank") <= drawn, F.col("rank").cast("bigint"))
    out = ranked.select(*columns, place.alias("rank")).unionByName(
        weighed.where(~long_enough).select(*columns, F.lit(None).cast("bigint").alias("rank")))
    return out.withColumnRenamed("doc", doc_id)
