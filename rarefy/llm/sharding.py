"""Op 9: balanced shards by Karmarkar-Karp differencing.

Documents of equal text form one indivisible group.  A partial partition is a
tuple of k shard sums; two of them are combined by adding the largest sum of
one to the smallest of the other, and so on.  Repeatedly combining the two
partial partitions of the largest spread leaves one tuple of nearly equal sums.

Groups are dealt by hash into blocks of bounded size, each block is reduced to
one partial partition in a task of its own, and the blocks' partial partitions
are combined the same way, block by block, until one is left.  What each level
keeps is where its slots went, so a group's shard is found by following its
block's permutations.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, number_rows, on_workers, text_or_empty, with_row_id

SHARDS = 24
ROW_BYTES = 8
# Groups differenced together, and partial partitions combined together.
BLOCK = 16_384
FAN_IN = 1024


def differencing(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (one per row of ``parts``) into one.

    Returns the final sums in descending order and, per row, the final slot of
    each of its slots.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = list(np.take_along_axis(parts, order, axis=1))
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]  # least first: largest spread
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        down = np.argsort(-total, kind="stable")
        merges.append((a, b, down))
        sums[a] = total[down]
        sums[b] = None
        heapq.heappush(heap, (int(sums[a][-1] - sums[a][0]), a))
    # slot[x][j]: the final slot of the j-th largest sum of partial partition x.
    slot: list = [None] * n
    last = heap[0][1]
    slot[last] = np.arange(k)
    for a, b, down in reversed(merges):
        at = np.empty(k, dtype=np.int64)
        at[down] = slot[a]
        slot[a], slot[b] = at, at[::-1]
    where = np.empty((n, k), dtype=np.int64)
    np.put_along_axis(where, order, np.stack(slot), axis=1)
    return sums[last], where


def _block_of_groups(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    """One block: every group's slot, and the block's sums on the first row."""
    pdf = pdf.sort_values(["bytes", "g1", "g2"], ascending=[False, True, True], kind="stable")
    pdf = pdf.reset_index(drop=True)
    parts = np.zeros((len(pdf), shards), dtype=np.int64)
    parts[:, 0] = pdf["bytes"].to_numpy()
    sums, where = differencing(parts)
    out = pdf[["block", "g1", "g2"]].copy()
    out["slot"] = where[:, 0].astype(np.int32)
    out["sums"] = [sums.tolist()] + [None] * (len(pdf) - 1)
    return out


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """Some partial partitions: where each one's slots went, and the new sums."""
    pdf = pdf.sort_values("block", kind="stable").reset_index(drop=True)
    sums, where = differencing(np.stack(pdf["sums"].to_numpy()).astype(np.int64))
    out = pdf[["parent", "block"]].copy()
    out["moved"] = where.astype(np.int32).tolist()
    out["sums"] = [sums.tolist()] + [None] * (len(pdf) - 1)
    return out


def group_shards(groups: DataFrame, shards: int = SHARDS, block: int = BLOCK,
                 fan_in: int = FAN_IN) -> DataFrame:
    """``g1, g2, shard`` for a staged table of groups (``g1, g2, bytes``)."""
    blocks = max(1, -(-groups.count() // block))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("g1", "g2"), F.lit(blocks)).cast("bigint"))
    placed = materialise(dealt.select("block", "g1", "g2", "bytes").groupBy("block").applyInPandas(
        on_workers(_block_of_groups, shards),
        "block bigint, g1 bigint, g2 bigint, slot int, sums array<bigint>"))
    level = placed.where("sums is not null").select("block", "sums")
    # shard of each slot of each block, once all levels are combined.
    chain = level.select("block", F.col("block").alias("top"),
                         F.sequence(F.lit(0), F.lit(shards - 1)).alias("slots"))
    n = blocks
    while n > 1:
        n = -(-n // fan_in)
        merged = materialise(level.withColumn("parent", F.pmod("block", F.lit(n)))
                             .groupBy("parent").applyInPandas(
            on_workers(_combine), "parent bigint, block bigint, moved array<int>, sums array<bigint>"))
        moved = merged.select(F.col("block").alias("top"), "parent", "moved")
        chain = materialise(chain.join(moved, "top").select(
            "block", F.col("parent").alias("top"),
            F.transform("slots", lambda s: F.element_at(F.col("moved"), s + 1)).alias("slots")))
        level = merged.where("sums is not null").select(F.col("parent").alias("block"), "sums")
    return (placed.select("block", "g1", "g2", "slot").join(chain.select("block", "slots"), "block")
            .select("g1", "g2", F.element_at("slots", F.col("slot") + 1).alias("shard")))


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shards: int = SHARDS, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8.  Shards have nearly
    equal bytes; equal texts (null counts as empty) share a shard, so one group
    larger than a shard's fair share makes that shard larger.  ``slot`` is
    gapless from 0 inside a shard.  Repeated rows and null ids are placed like
    any other; other columns are ignored; an empty table gives no rows.
    """
    t = text_or_empty(text)
    data = F.encode(t, "UTF-8")
    # 128 bits of two differently seeded hashes stand for the text.
    rows = materialise(with_row_id(docs.select(
        F.col(doc_id).alias("doc"), (F.octet_length(data) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"), F.xxhash64(t).alias("g1"),
        F.xxhash64(F.lit("group"), t).alias("g2"))))
    groups = materialise(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes")))
    placed = rows.join(group_shards(groups, shards, block, fan_in), ["g1", "g2"])
    return number_rows(materialise(placed.select("_row", "doc", "size", "text_crc32", "shard")),
                       ["shard"], "_row", "slot").select(
        F.col("doc").alias(doc_id), "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
