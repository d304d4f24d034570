"""Op 10: SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints come from word shingles.  For a radius r, every bit position gets
a nonzero vector of r + 1 bits; table v (each nonzero vector of r + 1 bits)
keeps the positions whose vector has an odd inner product with v.  Any r
positions leave some v orthogonal to all of their vectors, so two fingerprints
within distance r agree on all positions kept by that table: every such pair
meets in one of the 2^(r+1) - 1 tables, while unrelated pairs agree on about
half of the bits by chance only.

Only distinct fingerprints enter the tables.  A bucket of two is decided by a
bit count; the members of larger buckets are dealt into chunks, every pair of
chunks is compared in a task of its own, and only a spanning forest of the
links found is passed on, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, on_workers, quoted, text_or_empty, with_row_id
from .components import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BITS = 64
# Distinct fingerprints of one bucket compared in one block.
CHUNK = 2048
# Shingle hashes whose bits are added together at a time.
HASHES_AT_ONCE = 32_768


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the text's word shingles (0 without words)."""
    from xxhash import xxh64_intdigest
    # bytes.lower() and bytes.split() know ASCII letters and white space only.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[:n - 1]]
    stops = ends[min(shingle, len(words)) - 1:]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        hashes = np.array([xxh64_intdigest(joined[s:e - 1], seed) for s, e in
                           zip(starts[at:at + HASHES_AT_ONCE], stops[at:at + HASHES_AT_ONCE])],
                          dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int,
                  seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)],
                          dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values.view(np.int64))],
                                         names=["_row", "doc", "fp"])


def masks(radius: int = MAX_BITS) -> list[int]:
    """The bit masks of the covering tables, as signed 64-bit integers."""
    vectors = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() % 2)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside ``a``, or between ``a`` and ``b``."""
    points = a if b is None else np.concatenate([a, b])
    parent = list(range(len(points)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges, shift = [], 0 if b is None else len(a)
    for i in range(len(a)):
        other = a[i + 1:] if b is None else b
        near = np.flatnonzero(np.bitwise_count(other ^ a[i]) <= radius)
        base = i + 1 if b is None else shift
        for j in (near + base).tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((i, j))
    values = points.view(np.int64)
    return [(int(values[i]), int(values[j])) for i, j in edges]


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the blocks in a sorted stream of (block key..., side, fp) rows."""

    def links(side: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        # Side 0: a chunk with itself; sides 1 and 2: two chunks.
        if side[0] == 0:
            return _forest(fp, None, radius)
        return _forest(fp[side == 1], fp[side == 2], radius)

    held: list[np.ndarray] = []
    key = None

    def flush() -> list[tuple[int, int]]:
        block = np.concatenate(held)
        return links(block[:, 0], block[:, 1].copy().view(np.uint64))

    for batch in batches:
        keys = np.stack([np.asarray(batch.column(i)) for i in range(4)], axis=1).astype(np.int64)
        rows = np.stack([np.asarray(batch.column(4)).astype(np.int64),
                         np.asarray(batch.column(5))], axis=1)
        if not len(rows):
            continue
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        found: list[tuple[int, int]] = []
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)]):
            now = tuple(keys[s].tolist())
            if held and now != key:
                found.extend(flush())
                held.clear()
            key = now
            held.append(rows[s:e])
        yield _edge_batch(found)
    if held:
        yield _edge_batch(flush())


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                       pa.array([y for _, y in found], pa.int64())],
                                      names=["a", "b"])


def links(fps: DataFrame, radius: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join all within ``radius`` bits.

    Not every close pair is an edge: per bucket a spanning forest of its links
    is enough for the same components.
    """
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m))
                                         .alias("key")) for i, m in enumerate(masks(radius))]))
    keyed = fps.select("fp", table.alias("k")).select("k.t", "k.key", "fp")
    buckets = materialise(keyed.groupBy("t", "key")
                          .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"),
                               F.max("fp").alias("b"))
                          .where("n > 1"))
    two = (buckets.where("n = 2")
           .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b"))
    # Larger buckets: members by chunk, one block for every pair of chunks.
    many = buckets.where("n > 2").select(
        "t", "key", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks"))
    members = keyed.join(many, ["t", "key"]).withColumn(
        "c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    blocks = (members.select("t", "key", "fp", "c", other.alias("o"))
              .select("t", "key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"),
                      F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1)
                      .otherwise(2).alias("side"), "fp"))
    found = (blocks.repartition("t", "key", "lo", "hi")
             .sortWithinPartitions("t", "key", "lo", "hi", "side", "fp")
             .mapInArrow(on_workers(_bucket_links, radius), "a bigint, b bigint"))
    return two.unionByName(found).distinct()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``_row, doc, fp`` of every document; stage it before it is used twice."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = with_row_id(docs.select(F.col(doc_id).alias("doc"), text_or_empty(text).alias("text")))
    return rows.select("_row", "doc", "text").mapInArrow(
        on_workers(_fingerprints, shingle, seed), f"_row bigint, doc {kind}, fp bigint")


def components(prints: DataFrame, radius: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """``fp, component_id`` of the distinct fingerprints of a staged ``_row, doc, fp`` table.

    ``component_id`` is the smallest id of any document reachable over links.
    """
    fps = materialise(prints.groupBy("fp").agg(F.min("doc").alias("least")))
    roots = connected_components(links(fps.select("fp"), radius, chunk))
    joined = materialise(fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
                         .withColumn("root", F.coalesce("root", "fp")))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(ids, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       shingle: int = SHINGLE, radius: int = MAX_BITS, seed: int = SEED,
                       chunk: int = CHUNK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    Null and empty texts have fingerprint zero, which links like any other.
    Repeated rows are returned each; null ids take part in links, and a
    component of null ids alone has a null id.  Other columns are ignored.
    """
    prints = materialise(fingerprints(docs, doc_id, text, shingle, seed))
    found = components(prints, radius, chunk)
    return (prints.join(found, "fp")
            .select(F.col("doc").alias(doc_id),
                    F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               shingle: int = SHINGLE, radius: int = MAX_BITS, seed: int = SEED,
               chunk: int = CHUNK) -> DataFrame:
    """One document of each component: the one with the smallest id (null ids last).

    Rows of the same id are told apart by a row id, so repeated rows leave one.
    All columns of ``docs`` are returned.
    """
    row = free_name(docs, "_row")
    staged = materialise(with_row_id(docs, row))
    kind = docs.schema[doc_id].dataType.simpleString()
    prints = materialise(
        staged.select(F.col(row).alias("_row"), F.col(doc_id).alias("doc"),
                      text_or_empty(text).alias("text"))
        .mapInArrow(on_workers(_fingerprints, shingle, seed), f"_row bigint, doc {kind}, fp bigint"))
    fps = materialise(prints.groupBy("fp").agg(
        F.min(F.struct(F.col("doc").isNull().alias("n"), "doc", "_row")).alias("first")))
    roots = connected_components(links(fps.select("fp"), radius, chunk))
    kept = (fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
            .select(F.col("first._row").alias(row)))
    return staged.join(kept, row, "left_semi").select(*quoted(docs.columns))
