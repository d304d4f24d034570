"""The block search of :mod:`.neighbours` on packed rows: what instance selection repeats every round.

Every table is cut into parts along its curve; rows go to their parts in packed
pieces, and a part is ordered in one task.  The order is global, so a part's first
place follows from the parts' sizes, and the blocks inside a part are searched where
it is ordered; only blocks that lie on two parts are put together by another shuffle.
What a row finds in its blocks goes, packed too, to the rows' spans, where the
lists of all tables make the verdicts.

Blocks, distances and ties are those of :func:`.neighbours.nearest_neighbours`;
a row goes by its number ``ord`` in the order of (id, ``_row``), which ties follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard
from ..sources.tables import materialise
from .neighbours import Scale, _curves, _in_workers, _matrix, nearest_in_block, random_curves
from .prefix import positions

# Of a table's parts, each ordered in one task: least rows, bytes, and sampled rows for its cuts.
PART_ROWS, PART_BYTES, SAMPLE = 1 << 13, 1 << 25, 200
# Rows that a task deals to the parts at once.
HELD_ROWS = 1 << 13
# Bytes of a written row group: a reader holds its packed columns at once.
GROUP_BYTES = 1 << 24
# Rows whose lists are merged in one group.
SPAN = 1 << 16
# The class of a row without one.
NO_CLASS = np.iinfo(np.int64).min

PARTS = "part bigint, table int, n int, cells binary"
LISTS = "span bigint, ord binary, d binary, near binary, other binary"
EDGES = "table int, edge bigint, at bigint, n int, cells binary"
FOUND = f"{LISTS}, {EDGES}"


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (``_row, id, y, x``) as ``ord, _row, y, x``, written: ``ord`` counts them by (id, null first, ``_row``)."""
    placed = positions(rows.select("_row", "id", "y", "x"), [F.col("id").asc_nulls_first(), "_row"], position="ord")
    return materialise(placed.select("ord", "_row", "y", "x"))


def _cuts(rows: DataFrame, curves: tuple, n: int, tables: int, parts: int) -> list[list[tuple[int, int]]]:
    """Per table, ``parts - 1`` places (code, ``_row``) that cut it into parts of about equal size.

    From a sample of some rows a part, as a range exchange takes it; the result depends on no cut.
    """
    if parts < 2:
        return [[] for _ in range(tables)]
    wanted = SAMPLE * parts
    some = rows.select("_row", "x") if n <= wanted else rows.select("_row", "x").sample(wanted / n, 1)
    found = (some.mapInArrow(_in_workers(_curves, *curves, ["_row"]), "_row bigint, codes array<bigint>")
             .toArrow().combine_chunks())
    if not found.num_rows:
        return [[] for _ in range(tables)]
    row = np.asarray(found.column("_row"))
    codes = np.array(found.column("codes").to_pylist(), dtype=np.int64)
    at = np.linspace(0, len(row), parts + 1).astype(np.int64)[1:-1]
    out = []
    for code in codes.T:
        order = np.lexsort((row, code))[at]
        out.append([(int(c), int(r)) for c, r in zip(code[order], row[order])])
    return out


def _along_curves(batches: Iterator[pa.RecordBatch], curves: tuple, cuts: list) -> Iterator[pa.RecordBatch]:
    """Each table's rows by part: pieces of cells (code, ``_row``, ``ord``, class, coordinates), eight bytes each."""
    held, count = [], 0
    for batch in _curves(batches, *curves, ["ord", "_row", "y", "x"]):
        held.append(batch)
        count += len(batch)
        if count >= HELD_ROWS:
            yield from _parted(held, cuts)
            held, count = [], 0
    if count:
        yield from _parted(held, cuts)


def _parted(held: list[pa.RecordBatch], cuts: list) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    x = _matrix(rows.column("x").combine_chunks())
    cells = np.empty((len(x), 4 + x.shape[1]), dtype=np.int64)
    cells[:, 1], cells[:, 2] = rows.column("_row"), rows.column("ord")
    cells[:, 3] = pa.compute.fill_null(rows.column("y").cast(pa.int64()), int(NO_CLASS))
    cells[:, 4:] = x.view(np.int64)
    codes = np.asarray(rows.column("codes").combine_chunks().values).reshape(len(x), -1)
    for table, own_cuts in enumerate(cuts):
        order = np.lexsort((cells[:, 1], codes[:, table]))
        own = cells[order]
        code, row = codes[order, table], own[:, 1]
        own[:, 0] = code
        low, high = (np.searchsorted(code, [c for c, _ in own_cuts], side) for side in ("left", "right"))
        ends = [a + int(np.searchsorted(row[a:b], r)) for a, b, (_, r) in zip(low.tolist(), high.tolist(), own_cuts)]
        parts = [[table * (len(own_cuts) + 1) + i, table, b - a, own[a:b].tobytes()]
                 for i, (a, b) in enumerate(zip([0, *ends], [*ends, len(own)])) if b > a]
        yield _record(PARTS, *parts)


KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _columns(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(name, KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))]


def _record(schema: str, *rows: list) -> pa.RecordBatch:
    columns = _columns(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(columns)],
                                      names=[name for name, _ in columns])


def curve_pieces(rows: DataFrame, scale: Scale, n: int, tables: int, seed: int = 1) -> DataFrame:
    """The ``n`` rows (``ord, _row, y, x``) on the curves of all tables, in written pieces of the tables' parts.

    The parts are numbered in the order of their rows: by table, place on its curve and ``_row``.
    """
    size, curves = len(scale.mean), random_curves(scale, tables, seed=seed)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(math.ceil(2 * partitions / tables), n // PART_ROWS), math.ceil(n * 8 * (4 + size) / PART_BYTES))
    cuts = _cuts(rows, curves, n, tables, parts)
    return materialise(rows.select("ord", "_row", "y", "x")
                       .mapInArrow(_in_workers(_along_curves, curves, cuts), PARTS), group_bytes=GROUP_BYTES)


def part_starts(pieces: DataFrame) -> DataFrame:
    """``part, start``: the rows before each part, one row a part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (pieces.groupBy("part").agg(F.sum("n").alias("n"))
            .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))


def _whole(start: int, count: int, table: int, n: int, block: int) -> tuple[int, int]:
    """The places (from, to) of a part's rows in blocks with no row in another part."""
    low, high = table * n, (table + 1) * n
    stop = start + count
    first = start if start == low else -(-start // block) * block
    last = stop if stop == high else stop // block * block
    return (first - start, last - start) if first < last else (0, 0)


def _lists(at: np.ndarray, cells: np.ndarray, k: int, block: int, skip: int | None) -> list[list]:
    """What the rows at the places ``at`` of one table find in their blocks, by span."""
    number = at // block
    order = np.lexsort((cells[:, 0], number))  # ties go by ``ord``
    number, cells = number[order], cells[order]
    own, y, x = cells[:, 0].copy(), cells[:, 1].copy(), np.ascontiguousarray(cells[:, 2:]).view(np.float64)
    asked = y != (NO_CLASS if skip is None else skip)
    if skip is None:
        asked[:] = True
    starts = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
    keys = own[asked]
    d, near = np.full((len(keys), k), np.inf), np.full((len(keys), k), -1, dtype=np.int64)
    other = np.zeros((len(keys), k), dtype=bool)
    done = 0
    for start, stop in zip(starts, [*starts[1:], len(own)]):
        searched = np.flatnonzero(asked[start:stop])
        to, far = nearest_in_block(x[start:stop], k, searched)
        rows = slice(done, done + len(searched))
        d[rows, :to.shape[1]], near[rows, :to.shape[1]] = far, own[start:stop][to]
        other[rows, :to.shape[1]] = y[start:stop][to] != y[start:stop][searched][:, None]
        done += len(searched)
    span = keys // SPAN
    by_span = np.argsort(span, kind="stable")
    span, keys, d, near, other = span[by_span], keys[by_span], d[by_span], near[by_span], other[by_span]
    starts = np.flatnonzero(np.diff(span, prepend=-1)).tolist()
    return [[int(span[a]), *(v[a:b].tobytes() for v in (keys, d, near, other))]
            for a, b in zip(starts, [*starts[1:], len(keys)])]


def _search_part(table: pa.Table, size: int, n: int, k: int, block: int, skip: int | None) -> pa.Table:
    """The lists of a part's rows, and as pieces the rows whose block goes on in another part."""
    cells = np.frombuffer(b"".join(v.as_py() for v in table.column("cells")), dtype=np.int64).reshape(-1, 4 + size)
    start, curve = table.column("start")[0].as_py(), table.column("table")[0].as_py()
    cells = cells[np.lexsort((cells[:, 1], cells[:, 0])), 2:]
    first, last = _whole(start, len(cells), curve, n, block)
    out = [[*r, *[None] * 5] for r in _lists(start + np.arange(first, last), cells[first:last], k, block, skip)]
    for low, high in [(0, first), (last, len(cells))] if last > first else [(0, len(cells))]:
        edges = (start + np.arange(low, high)) // block
        ends = (np.flatnonzero(np.diff(edges, prepend=-1)) + low).tolist()
        out += [[*[None] * 5, curve, int(edges[at - low]), start + at, stop - at, cells[at:stop].tobytes()]
                for at, stop in zip(ends, [*ends[1:], high])]
    return pa.Table.from_batches([_record(FOUND, *out)])


def _search_edge(table: pa.Table, size: int, k: int, block: int, skip: int | None) -> pa.Table:
    """The lists of the rows of a block that pieces of several parts make."""
    cells = np.frombuffer(b"".join(v.as_py() for v in table.column("cells")), dtype=np.int64).reshape(-1, 2 + size)
    at = np.concatenate([np.arange(a, a + c) for a, c in zip(table.column("at").to_pylist(), table.column("n").to_pylist())])
    return pa.Table.from_batches([_record(LISTS, *_lists(at, cells, k, block, skip))])


def _verdicts(table: pa.Table, k: int) -> pa.Table:
    """``ord`` of the rows of a span of whose ``k`` nearest in all tables most are of another class."""
    def column(name, kind):
        return np.frombuffer(b"".join(v.as_py() for v in table.column(name)), dtype=kind)
    own, d = column("ord", np.int64), column("d", np.float64).reshape(-1, k)
    near, other = column("near", np.int64).reshape(-1, k), column("other", np.bool_).reshape(-1, k)
    first = table.column("span")[0].as_py() * SPAN
    own = own - first
    # A row goes for no fewer finds of another class than these, counted in all tables with repeats.
    needed = np.where(np.bincount(own, near[:, -1] >= 0, SPAN) > 0, k // 2 + 1, 1)
    asked = (np.bincount(own, other.sum(axis=1), SPAN) >= needed)[own]
    row = np.repeat(own[asked], k)
    there = near[asked].ravel() >= 0
    row, d, near, other = row[there], d[asked].ravel()[there], near[asked].ravel()[there], other[asked].ravel()[there]
    order = np.lexsort((near, d, row))
    row, near, other = row[order], near[order], other[order]
    # The same pair has the same distance in every table.
    once = np.ones(len(row), dtype=bool)
    once[1:] = (row[1:] != row[:-1]) | (near[1:] != near[:-1])
    row, other = row[once], other[once]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    n_near = np.bincount(row[kept], minlength=SPAN)
    n_other = np.bincount(row[kept], other[kept], SPAN)
    return pa.table({"ord": pa.array(np.flatnonzero(2 * n_other > n_near) + first, pa.int64())})


def outvoted(rows: DataFrame, scale: Scale, n: int, k: int, block: int, tables: int, skip: int | None = None,
             seed: int = 1) -> DataFrame:
    """``ord`` of the rows of whose ``k`` nearest others more than half are of another class, written.

    ``rows``: ``n`` written rows (``ord, _row, y, x``).  Rows of class ``skip`` are neighbours of
    others only.  A tie, and a row without neighbours, is not outvoted.
    """
    size, block = len(scale.mean), max(block, k + 1)
    pieces = curve_pieces(rows, scale, n, tables, seed)
    placed = pieces.join(F.broadcast(part_starts(pieces)), "part")
    # Written, as the blocks on two parts come first.
    found = materialise(placed.groupBy("part").applyInArrow(_in_workers(_search_part, size, n, k, block, skip), FOUND),
                        group_bytes=GROUP_BYTES)
    edges = (found.where("edge is not null").select("table", "edge", "at", "n", "cells").groupBy("table", "edge")
             .applyInArrow(_in_workers(_search_edge, size, k, block, skip), LISTS))
    lists = found.where("span is not null").select("span", "ord", "d", "near", "other").unionByName(edges)
    gone = materialise(lists.groupBy("span").applyInArrow(_in_workers(_verdicts, k), "ord bigint"))
    discard(pieces)
    discard(found)
    return gone
