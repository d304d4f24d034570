"""Op 2: best-fit packing with a swap-based local search.

Documents are encoded, closed with an end id and cut into pieces of at most
``capacity`` tokens.  Full pieces are sequences of their own.  The others are
dealt by a hash of their row into groups of some thousand pieces, which are
packed independently: best fit in decreasing order, then a local search that
moves one or two pieces and exchanges one for one or two for one, from the
emptier to the fuller of underfull bins, whenever that increases the sum of
squared fills, until nothing does or no bin can be saved.  A group's size does not depend on the table's, and a group
ends with few bins that are not full, so the loss stays at a fraction of a
bin per thousands of pieces at any scale.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, on_workers, public_vocabulary, text_or_empty, with_row_id
from .text_encoding import encoder, grouped

CAPACITY = 1024
END_ID = 2
# Pieces packed together.
GROUP_PIECES = 8192


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    frees = 0  # bit f is set while a bin with f free places exists
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fits = frees >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = by_free[free].pop()
            if not by_free[free]:
                frees &= ~(1 << free)
            bins[number].append(item)
        else:
            free, number = capacity, len(bins)
            bins.append([item])
        left = free - size
        if left:
            by_free[left].append(number)
            frees |= 1 << left
    return bins


def _targets(lengths: np.ndarray, home: np.ndarray, fill: np.ndarray, capacity: int) -> tuple:
    """What underfull bins can take a piece for: a piece of theirs, or nothing (item -1).

    Pieces of one length in bins of one fill are alike: ``(fill, size)`` of each
    kind, and two (bin, item) of it, in different bins if there are such.
    """
    under = np.flatnonzero((fill > 0) & (fill < capacity))
    items = np.flatnonzero((fill[home] > 0) & (fill[home] < capacity))
    owner = np.concatenate([home[items], under])
    item = np.concatenate([items, np.full(len(under), -1)])
    size = np.where(item < 0, 0, lengths[item])
    kind = fill[owner] * (capacity + 1) + size
    order = np.lexsort((owner, kind))
    starts = np.flatnonzero(np.diff(kind[order], prepend=-1))
    first, last = order[starts], order[np.append(starts[1:], len(order))[:len(starts)] - 1]
    return fill[owner[first]], size[first], owner[first], item[first], owner[last], item[last]


def _best_exchange(own: list[int], k: int, lengths: np.ndarray, fill: np.ndarray, targets: tuple,
                   capacity: int) -> tuple[list[int], list[int], int, int] | None:
    """Bin k's exchange of the largest increase: pieces out, pieces back, the other bin, tokens moved.

    A bin holds few pieces of different lengths (45 of 1024 tokens at most), so
    few single and paired lengths can be given.  Kinds are looked at some
    thousand at a time: memory does not follow the pieces.
    """
    of = {}
    for i in own:
        of.setdefault(int(lengths[i]), []).append(i)
    # Of equal increases the first counts: single pieces before pairs, in the bin's own order.
    kinds = list(of)
    gives: dict[int, list[int]] = {a: [of[a][0]] for a in kinds}
    for x, a in enumerate(kinds):
        for b in kinds[x:]:
            if a != b or len(of[a]) > 1:
                gives.setdefault(a + b, [of[a][0], of[b][0] if a != b else of[a][1]])
    given = np.fromiter(gives, dtype=np.int64, count=len(gives))[:, None]
    best, found = 0, None
    for at in range(0, len(targets[0]), 4096):
        full, size, owner, item, owner2, item2 = (t[at:at + 4096] for t in targets)
        mine = owner == k
        owner, item = np.where(mine, owner2, owner), np.where(mine, item2, item)
        d = given - size
        gain = np.where((d > 0) & (d <= capacity - full) & (owner != k), d * (full - fill[k] + d), 0)
        top = int(np.argmax(gain))
        row, col = divmod(top, len(size))
        if gain[row, col] > best:
            best = int(gain[row, col])
            back = [int(item[col])] if item[col] >= 0 else []
            found = gives[int(given[row, 0])], back, int(owner[col]), int(d[row, col])
    return found


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty bins by exchanges among the underfull ones; every bin stays within capacity.

    The emptiest bin gives one or two pieces to another underfull bin and takes
    none (a move) or one back (one for one, two for one).  Giving d more tokens
    than it takes changes the sum of squared fills by 2 d (fill_b - fill_a + d);
    the exchange of the largest increase is made, until none helps, and the
    next bin's turn comes.  Sweeps go on until one changes nothing or the bins
    are as few as can be.  The sum only grows, so the search ends.
    """
    least = -(-int(lengths.sum()) // capacity)
    fill = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
    home = np.zeros(len(lengths), dtype=np.int64)
    for k, b in enumerate(bins):
        home[b] = k
    bins = [list(b) for b in bins]
    changed, targets = True, None
    while changed and np.count_nonzero(fill) > least:
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        changed = False
        for k in under[np.argsort(fill[under], kind="stable")].tolist():
            while bins[k] and fill[k] < capacity:
                if targets is None:
                    targets = _targets(lengths, home, fill, capacity)
                found = _best_exchange(bins[k], k, lengths, fill, targets, capacity)
                if found is None:
                    break
                out, back, to, step = found
                for i in out:
                    bins[k].remove(i)
                bins[k] += back
                bins[to] = [i for i in bins[to] if i not in back] + out
                home[out] = to
                home[back] = k
                fill[k] -= step
                fill[to] += step
                changed, targets = True, None
    return [b for b in bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item."""
    bins = local_search(lengths, best_fit_decreasing(lengths, capacity), capacity)
    number = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    for k, b in enumerate(bins):
        at = np.cumsum(lengths[b])
        number[b] = k
        offset[b] = at - lengths[b]
    return number, offset


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int,
            end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    end = np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in grouped(texts):
            doc, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(enc.ids(texts[a:b])):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    doc.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s:4 * e]))
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).take(at), batch.column(1).slice(a, b - a).take(at),
                 pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["_row", "doc", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 vocabulary: str | None = None, capacity: int = CAPACITY,
                 end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: ``_row, doc_id, piece, start, length, ids_crc32``.

    Only documents of more than ``capacity`` ids (end id included) are cut;
    their first piece takes the remainder, so all later ones are full.
    """
    path = vocabulary or public_vocabulary("byte_bpe_50k.json")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = with_row_id(docs.select(F.col(doc_id).alias("doc"), text_or_empty(text).alias("text")))
    out = rows.select("_row", "doc", "text").mapInArrow(
        on_workers(_pieces, path, capacity, end_id),
        f"_row bigint, doc {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return out.withColumnRenamed("doc", doc_id)


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["_row", "piece"], kind="stable").reset_index(drop=True)
    number, offset = pack_lengths(pdf["length"].to_numpy(), capacity)
    pdf["sequence_id"] = 2 * ((pdf["_group"].to_numpy() << 32) + number)
    pdf["offset"] = offset
    return pdf


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   vocabulary: str | None = None, capacity: int = CAPACITY,
                   end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Null and empty texts are a single piece holding the end id.  Repeated rows
    are packed each; a null id stays null; other columns are ignored; an empty
    table gives no rows.  The pieces (a few numbers each) are written once to
    the shared folder, so a lost executor never repeats the encoding of others.
    """
    pieces = materialise(token_pieces(docs, doc_id, text, vocabulary, capacity, end_id))
    full = F.col("length") == F.lit(capacity)
    n = pieces.where(~full).count()
    groups = max(1, -(-n // group_pieces))
    alone = (pieces.where(full)
             .withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1)
             .withColumn("offset", F.lit(0).cast("bigint")))
    dealt = (pieces.where(~full)
             .withColumn("_group", F.pmod(F.xxhash64("_row", "piece"), F.lit(groups))
                         .cast("bigint")))
    names = ["_row", doc_id, "piece", "start", "length", "ids_crc32"]
    kinds = dict(dealt.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*names, "_group"])
    packed = dealt.select(*names, "_group").groupBy("_group").applyInPandas(
        on_workers(_pack_group, capacity), schema + ", sequence_id bigint, offset bigint")
    cols = [doc_id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return packed.select(*cols).unionByName(alone.select(*cols))
