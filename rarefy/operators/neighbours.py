"""Nearest neighbours inside one table: the join under SMOTE and instance selection.

Rows are projected onto a few random directions; the projections' bits,
interleaved, give each row a place on a space-filling curve.  The rows of a
table are ordered by that place and cut into blocks of equal, bounded size,
however many rows are equal or near: positions are counted by ranges of the
order.  Each block is searched exactly, and several tables of different
directions make up for neighbours that a block's edge parts.  The work is
rows x tables x block size; no pair beyond a row's best k of a block leaves
its task.

The search is approximate across blocks (``tests`` measure recall against
brute force) and exact inside them: distances are sums over the coordinates
in order, ties go to the smaller id (null first), then the smaller row number.
"""

from __future__ import annotations

import importlib
import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ID, LABEL
from ..sources.tables import materialise
from .prefix import positions

# Rows searched together, directions of a curve, bits of each, and curves.
BLOCK = 512
DIRECTIONS = 6
BITS = 8
TABLES = 12
# Half the width of a projection's range, in standard deviations; beyond it the ends hold the rest.
RANGE = 3.0

# Odd factors of the coordinates in the hash of a row's bits.
HASH_START, HASH_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED02)

NEAR = "array<struct<d:double,id:bigint,row:bigint,y:int>>"
ROOT = str(Path(__file__).resolve().parents[2])


@dataclass(frozen=True)
class Scale:
    """Mean and standard deviation of every coordinate."""
    mean: tuple[float, ...]
    std: tuple[float, ...]


def _in_workers(fn: Callable, *args) -> Callable:
    """``fn`` of an importable module as a function for Arrow calls."""
    module, name, root = fn.__module__, fn.__qualname__, ROOT

    def run(rows):
        if root not in sys.path:
            sys.path.append(root)
        return getattr(importlib.import_module(module), name)(rows, *args)
    return run


def points(df: DataFrame, x: Column | None = None, features: str = "indexedFeatures",
           idn: str = ID, label: str = LABEL, keep: Sequence[str] = ()) -> DataFrame:
    """``_row, id, y, x`` and a struct ``kept`` of the ``keep`` columns, written once.

    ``_row`` numbers the rows, so repeated and null ids stay apart.  ``x`` is
    null where the vector is null or holds a coordinate that is no finite
    number: such rows have no neighbours and are nobody's.
    """
    if x is None:
        x = F.when(F.col(features).isNotNull(), vector_to_array(features))
    finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    out = df.select(F.col(idn).cast("bigint").alias("id"), F.col(label).cast("int").alias("y"),
                    x.cast("array<double>").alias("x"), *kept)
    return materialise(out.withColumn("x", F.when(finite, F.col("x")))
                       .withColumn("_row", F.monotonically_increasing_id()))


def coordinate_scale(rows: DataFrame) -> Scale:
    """Mean and population standard deviation per coordinate: one row a coordinate reaches the driver."""
    cells = rows.where("x is not null").select(F.posexplode("x").alias("i", "v"))
    found = {r["i"]: r for r in cells.groupBy("i").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).collect()}
    order = [found[i] for i in range(len(found))]
    return Scale(tuple(r["mean"] for r in order), tuple(r["std"] for r in order))


def standardised(rows: DataFrame, scale: Scale) -> DataFrame:
    """``x`` divided by each coordinate's standard deviation (constant ones: left out of distances)."""
    weight = F.array(*[F.lit(1.0 / s if s > 0 else 0.0) for s in scale.std])
    return rows.withColumn("x", F.zip_with("x", weight, lambda v, w: v * w))


@cache
def _spread(apart: int, bits: int) -> np.ndarray:
    """The numbers of ``bits`` bits with their bits ``apart`` places apart."""
    number = np.arange(1 << bits, dtype=np.int64)
    return sum(((number >> b) & 1) << (b * apart) for b in range(bits))


def _curves(batches: Iterator[pa.RecordBatch], directions: list, low: list, step: list,
            bits: int, keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``keep`` and the places of each row on all curves."""
    for batch in batches:
        x = _matrix(batch.column("x"))
        codes = []
        for r, a, w in zip(directions, low, step):
            cell = np.clip((x @ np.asarray(r) - np.asarray(a)) / np.asarray(w), 0, (1 << bits) - 1).astype(np.int64)
            dims = cell.shape[1]
            code = np.zeros(len(x), dtype=np.int64)
            # The first direction's bit leads those of its place.
            for j in range(dims):
                for b in range(0, bits, 8):
                    code |= _spread(dims, min(8, bits - b))[(cell[:, j] >> b) & 255] << (b * dims + dims - 1 - j)
            codes.append(code)
        flat = np.stack(codes, axis=1).ravel() if codes else np.zeros(0, dtype=np.int64)
        offsets = np.arange(len(x) + 1, dtype=np.int32) * len(codes)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=[*keep, "codes"])


def _matrix(column: pa.Array) -> np.ndarray:
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)[offsets[0]:offsets[-1]]
    return values.astype(np.float64, copy=False).reshape(len(column), -1)


def random_curves(scale: Scale, tables: int = TABLES, directions: int = DIRECTIONS, bits: int = BITS,
                  seed: int = 1) -> tuple[list, list, list, int]:
    """Per table, the curve's directions and its cells' lower ends and widths; bits of each direction."""
    rng = np.random.default_rng(seed)
    size = len(scale.mean)
    bits = max(1, min(bits, 62 // max(1, min(directions, size))))
    turn, low, step = [], [], []
    for _ in range(tables):
        r = np.linalg.qr(rng.normal(size=(size, size)))[0][:, :min(directions, size)]
        middle = np.asarray(scale.mean) @ r
        wide = np.sqrt(np.asarray(scale.std) ** 2 @ r ** 2) + 1e-300
        shift = rng.uniform(-0.5, 0.5, r.shape[1]) * wide  # tables cut space at different places
        turn.append(r.tolist())
        low.append((middle - RANGE * wide + shift).tolist())
        step.append((2 * RANGE * wide / (1 << bits)).tolist())
    return turn, low, step, bits


def projected_blocks(rows: DataFrame, scale: Scale, block: int = BLOCK, tables: int = TABLES,
                     directions: int = DIRECTIONS, bits: int = BITS, seed: int = 1) -> DataFrame:
    """Every row of ``rows`` (``_row, id, y, x``) once per table, with its ``block``.

    Blocks hold ``block`` rows (the first and last of a table may hold fewer).
    """
    curves = random_curves(scale, tables, directions, bits, seed)
    coded = rows.select("_row", "x").mapInArrow(_in_workers(_curves, *curves, ["_row"]),
                                                "_row bigint, codes array<bigint>")
    placed = positions(coded.select("_row", F.posexplode("codes").alias("table", "code")),
                       ["table", "code", "_row"], position="_pos")
    blocks = placed.select("_row", "table", F.floor((F.col("_pos") - 1) / F.lit(block)).alias("block"))
    return rows.join(blocks, "_row")


def _candidates(x: np.ndarray, start: int, stop: int, take: int, searched: np.ndarray | None = None,
                own_too: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, other) that hold the ``take`` nearest others of the rows ``start`` to ``stop``, ties included.

    The pairs come in order.  ``searched``: the rows that ``start`` and ``stop`` count, all by
    default.  ``own_too``: a row counts among its others.  Distances by one matrix product are
    off by rounding only; a bound on that is added to the largest distance that ``take`` others
    certainly do not exceed.
    """
    n, size = x.shape
    at = np.arange(start, stop) if searched is None else searched[start:stop]
    with np.errstate(over="ignore", invalid="ignore"):
        y = x - x.mean(axis=0)
        norm = (y * y).sum(axis=1)
        own = norm[at, None]
        most = own + norm.max() + (x * x).max(initial=0.0)
        # No sum in the product exceeds this.
        finite = np.isfinite(4.0 * most).all()
        slack = 8 * (size + 8) * np.finfo(np.float64).eps * most
    if not finite:
        row, to = np.indices((len(at), n)).reshape(2, -1)
    else:
        one = np.ones((n, 1))
        d = np.hstack([-2.0 * y[at], own, one[at]]) @ np.hstack([y, one, norm[:, None]]).T
        if not own_too:
            d[np.arange(len(at)), at] = np.inf
        # The least of every group of others: the one at place ``take`` of these bounds the distance there.
        groups = max(take, n // 16)
        whole = n // groups * groups
        least = d[:, :whole].reshape(len(at), -1, groups).min(axis=1)
        bound = np.partition(least, take - 1, axis=1)[:, take - 1, None]
        row, to = np.divmod(np.flatnonzero(d <= bound + slack), n)
    row = at[row]
    return (row, to) if own_too else (row[row != to], to[row != to])


def _equal_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in an order that puts equal ones together (by place), each one's group and rank in it.

    A hash of the bits orders the rows; as the rows are compared, a collision at worst leaves
    equal rows in several groups.
    """
    bits = np.ascontiguousarray(x).view(np.uint64)
    mixed = (bits ^ (bits >> np.uint64(32))) * (np.arange(x.shape[1], dtype=np.uint64) * HASH_STEP + HASH_START)
    order = np.argsort(mixed.sum(axis=1, dtype=np.uint64), kind="stable")
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(axis=1)
    group = np.cumsum(new) - 1
    return order, group, np.arange(len(x)) - np.flatnonzero(new)[group]


def nearest_in_block(x: np.ndarray, k: int, searched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``k`` nearest others (all, if fewer) of the rows ``searched``, in order.

    Ties go to the smaller place.  Equal rows share one search: its list, one longer, without the
    row itself is the row's; of equal rows no list holds more than the first ``k + 1``.
    """
    n = len(x)
    take = min(k + 1, n)
    if take < 2 or not len(searched):
        return np.zeros((len(searched), max(take - 1, 0)), dtype=np.int64), np.zeros((len(searched), max(take - 1, 0)))
    order, group, rank = _equal_rows(x)
    held = np.sort(order[rank < take])
    first = order[rank == 0]
    of_row = np.empty(n, dtype=np.int64)
    of_row[order] = first[group]
    asked, own_list = np.unique(of_row[searched], return_inverse=True)
    rows = x[held]
    at = np.searchsorted(held, asked)
    coordinates = np.ascontiguousarray(rows.T)
    best, far = [], []
    at_once = max(1, (1 << 20) // len(held))
    for start in range(0, len(at), at_once):
        row, to = _candidates(rows, start, min(start + at_once, len(at)), take, at, own_too=True)
        d = np.zeros(len(row))
        for own in coordinates:
            gap = own[row] - own[to]
            d += gap * gap
        # Stable, and the pairs come in order: ties go to the smaller place.
        by_distance = np.lexsort((d, row))
        row, to, d = row[by_distance], to[by_distance], d[by_distance]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < take
        best.append(held[to[kept]])
        far.append(d[kept])
    near = np.concatenate(best).reshape(-1, take)[own_list]
    d = np.concatenate(far).reshape(-1, take)[own_list]
    itself = near == searched[:, None]
    left_out = np.where(itself.any(axis=1), itself.argmax(axis=1), take - 1)
    places = np.arange(take - 1)
    places = places + (places >= left_out[:, None])
    return np.take_along_axis(near, places, axis=1), np.take_along_axis(d, places, axis=1)


def _search(table: pa.Table, k: int, skip: int | None = None) -> pa.Table:
    """The k nearest other rows of every row of a block but those of class ``skip``, by distance, id and row."""
    order = [("id", "ascending"), ("_row", "ascending")]
    table = table.combine_chunks()
    table = table.take(pa.compute.sort_indices(table, sort_keys=order, null_placement="at_start"))
    x = _matrix(table.column("x").combine_chunks())
    n, take = len(x), min(k, len(x) - 1)
    searched = np.arange(n)
    if skip is not None:
        skipped = pa.compute.fill_null(pa.compute.equal(table.column("y"), skip), False)
        searched = np.flatnonzero(~np.asarray(skipped, dtype=bool))
    best, far = nearest_in_block(x, k, searched)
    to, d = pa.array(best.ravel()), pa.array(far.ravel())
    near = pa.StructArray.from_arrays(
        [d, *[table.column(c).combine_chunks().take(to) for c in ("id", "_row", "y")]],
        names=["d", "id", "row", "y"])
    offsets = pa.array(np.arange(len(searched) + 1, dtype=np.int32) * max(take, 0))
    return pa.table({"_row": table.column("_row").take(pa.array(searched)),
                     "near": pa.ListArray.from_arrays(offsets, near)})


def block_neighbours(blocked: DataFrame, by: Sequence[str], k: int, skip: int | None = None) -> DataFrame:
    """``_row, near``: each row's k nearest others of its block (``by`` names the block).

    A block is searched in one task: its size is the caller's bound.  Rows of class
    ``skip`` get no row, but are neighbours of others.
    """
    return (blocked.select(*by, "_row", "id", "y", "x").groupBy(*by)
            .applyInArrow(_in_workers(_search, k, skip), f"_row bigint, near {NEAR}"))


def nearest_neighbours(rows: DataFrame, k: int, scale: Scale | None = None, block: int = BLOCK,
                       tables: int = TABLES, seed: int = 1, skip: int | None = None) -> DataFrame:
    """``_row, near``: the k nearest others of each row of ``rows`` (``_row, id, y, x``).

    ``near`` is ordered; a table of few rows gives all others.  Rows without
    a vector and rows of class ``skip`` get no row.  ``rows`` must be a written table.
    """
    usable = rows.where("x is not null")
    scale = scale or coordinate_scale(rows)
    if not scale.mean:
        return usable.select("_row", F.lit(None).cast(NEAR).alias("near"))
    blocked = projected_blocks(usable, scale, max(block, k + 1), tables, seed=seed)
    found = block_neighbours(blocked, ["table", "block"], k, skip)
    # At most tables x k entries a row; the same pair has the same distance in every table.
    every = F.array_distinct(F.flatten(F.collect_list("near")))
    return found.groupBy("_row").agg(F.slice(F.sort_array(every), 1, k).alias("near"))


def rows_a_block(n: int, size: int) -> int:
    """Blocks of about ``size`` rows for ``n`` rows, one at least."""
    return max(1, math.ceil(n / size))
