"""The search of instance selection on packed rows: verdicts as of the plain block search."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rarefy.operators import curve_blocks, neighbours
from rarefy.operators.instance_selection import edit_verdicts
from rarefy.sources.tables import materialise

SCHEMA = "_row bigint, id bigint, y int, x array<double>"


def _rows(spark, n=2500, copies=1, ids="unique"):
    rng = np.random.default_rng(n + copies)
    x = rng.normal(size=(n // copies, 5))
    x[:, 2:] = x[:, 2:] > 0.4
    x = np.repeat(x, copies, axis=0)
    y = np.where(rng.random(len(x)) < 0.2, 1, -1).tolist()
    own = {"unique": lambda i: len(x) - i, "repeated": lambda i: i // 7, "null": lambda i: None if i % 3 else i}[ids]
    return materialise(spark.createDataFrame(
        [(i, own(i), None if i % 41 == 0 else y[i], v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(3))


def _by_hand(rows, k, block, tables, skip):
    near = neighbours.nearest_neighbours(rows, k, block=block, tables=tables, skip=skip)
    return sorted(r["_row"] for r in edit_verdicts(rows, near, skip).where("NOT kept").collect())


@pytest.mark.parametrize("copies,ids", [(1, "unique"), (50, "repeated"), (1, "null")])
@pytest.mark.parametrize("k,skip,parts", [(3, 1, 1), (5, None, 6)])
def test_outvoted_rows_equal_the_verdicts_of_plain_blocks(spark, monkeypatch, copies, ids, k, skip, parts):
    rows = _rows(spark, copies=copies, ids=ids)
    n = rows.count()
    # Parts are cut inside blocks.
    monkeypatch.setattr(curve_blocks, "PART_ROWS", n // parts)
    monkeypatch.setattr(curve_blocks, "PART_BYTES", 8 * 9 * n // parts)
    live = curve_blocks.numbered(rows)
    gone = curve_blocks.outvoted(live, neighbours.coordinate_scale(rows), n, k, 128, 4, skip)
    found = sorted(r["_row"] for r in live.join(gone, "ord").select("_row").collect())
    assert found == _by_hand(rows, k, 128, 4, skip) and found


@pytest.mark.parametrize("n,k,block", [(1, 3, 512), (3, 3, 512), (40, 3, 2), (300, 5, 64)])
def test_few_rows_and_small_blocks(spark, n, k, block):
    rows = _rows(spark, n)
    live = curve_blocks.numbered(rows)
    gone = curve_blocks.outvoted(live, neighbours.coordinate_scale(rows), n, k, block, 3)
    assert sorted(r["_row"] for r in live.join(gone, "ord").select("_row").collect()) == _by_hand(rows, k, block, 3, None)


def test_rows_travel_in_pieces(spark, monkeypatch):
    rows = _rows(spark, 3000)
    monkeypatch.setattr(curve_blocks, "PART_ROWS", 500)
    monkeypatch.setattr(curve_blocks, "PART_BYTES", 8 * 9 * 1000)
    live = curve_blocks.numbered(rows)
    pieces = curve_blocks.curve_pieces(live, neighbours.coordinate_scale(rows), 3000, 4)
    sizes = {r["part"]: r["n"] for r in pieces.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    # Some records for each part, and not a row for each row and table.
    assert sum(sizes.values()) == 4 * 3000 and pieces.count() <= live.rdd.getNumPartitions() * len(sizes)
    assert len(sizes) >= 12 and max(sizes.values()) <= 2 * 1000
    starts = {r["part"]: r["start"] for r in curve_blocks.part_starts(pieces).collect()}
    assert starts == dict(zip(sorted(sizes), np.cumsum([0, *[sizes[p] for p in sorted(sizes)]])[:-1].tolist()))


def test_equal_rows_are_measured_once(monkeypatch):
    seen, own = [], neighbours._candidates
    monkeypatch.setattr(neighbours, "_candidates", lambda x, *a, **b: (seen.append(len(x)), own(x, *a, **b))[1])
    x = np.repeat(np.random.default_rng(1).normal(size=(8, 3)), 64, axis=0)
    to, d = neighbours.nearest_in_block(x, 3, np.arange(512))
    assert seen == [8 * 4] and (d == 0).all()
    for i in range(512):
        assert to[i].tolist() == [j for j in range(i // 64 * 64, i // 64 * 64 + 64) if j != i][:3]


def test_hash_collisions_merge_no_different_rows(monkeypatch):
    monkeypatch.setattr(neighbours, "HASH_START", np.uint64(0))
    monkeypatch.setattr(neighbours, "HASH_STEP", np.uint64(0))  # every row has one hash
    x = np.array([[0.0], [1.0], [0.0], [0.0], [1.0]])
    order, group, rank = neighbours._equal_rows(x)
    assert order.tolist() == [0, 1, 2, 3, 4] and group.tolist() == [0, 1, 2, 2, 3] and rank.tolist() == [0, 0, 0, 1, 0]
    to, d = neighbours.nearest_in_block(x, 2, np.arange(5))
    assert to.tolist() == [[2, 3], [4, 0], [0, 3], [0, 2], [1, 0]] and d[1].tolist() == [0.0, 1.0]


@pytest.mark.parametrize("dims,bits", [(6, 8), (1, 62), (5, 12), (3, 20)])
def test_places_interleave_the_bits_of_cells(dims, bits):
    rng = np.random.default_rng(dims)
    x = rng.uniform(0, 1 << bits, (200, dims))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["_row", "x"])
    eye = np.eye(dims).tolist()
    (out,) = neighbours._curves([batch], [eye], [[0.0] * dims], [[1.0] * dims], bits, ["_row"])
    cell = np.clip(x, 0, (1 << bits) - 1).astype(np.int64)
    code = np.zeros(200, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for j in range(dims):
            code = (code << 1) | ((cell[:, j] >> b) & 1)
    assert [c[0] for c in out.column("codes").to_pylist()] == code.tolist()


def test_lists_of_several_spans(monkeypatch):
    monkeypatch.setattr(curve_blocks, "SPAN", 8)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 2)), rng.integers(0, 2, 30)
    cells = np.hstack([np.arange(30)[:, None], y[:, None], x.view(np.int64)])
    lists = curve_blocks._lists(np.arange(30), cells, 3, 64, None)
    assert [r[0] for r in lists] == [0, 1, 2, 3]
    gone = []
    for r in lists:
        table = pa.Table.from_batches([curve_blocks._record(curve_blocks.LISTS, r, r)])  # twice: pairs count once
        gone += curve_blocks._verdicts(table, 3).column("ord").to_pylist()
    near = [sorted(range(30), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j)) for i in range(30)]
    assert gone == [i for i in range(30) if 2 * sum(y[j] != y[i] for j in [j for j in near[i] if j != i][:3]) > 3]


def test_packed_tables_have_small_row_groups(spark):
    rows = spark.range(2000, numPartitions=1).select(F.encode(F.repeat(F.col("id").cast("string"), 3000), "utf-8").alias("b"))
    out = materialise(rows, group_bytes=1 << 20)
    (file,) = [f.removeprefix("file:") for f in map(str, out.inputFiles())]
    found = pq.ParquetFile("/" + file.lstrip("/")).metadata
    assert found.num_rows == 2000 and found.num_row_groups >= 8
