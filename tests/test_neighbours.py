"""The neighbour join, SMOTE, instance selection, k-means draws by position, strategies."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from rarefy.operators import instance_selection, kmeans_balance, neighbours, smote
from rarefy.operators.ensemble import BalancedTreeEnsemble, TreeParams
from rarefy.operators.features import assemble, fit_indexer

SCHEMA = "idn bigint, label int, x array<double>"


def staged(spark, rows):
    return neighbours.points(spark.createDataFrame(rows, SCHEMA), F.col("x"))


def vectors(spark, rows):
    """(idn, label, vector or None) rows as the library's training input."""
    return spark.createDataFrame([(i, y, None if x is None else Vectors.dense(x)) for i, y, x in rows],
                                 StructType([StructField("idn", LongType()), StructField("label", IntegerType()),
                                             StructField("indexedFeatures", VectorUDT())]))


def brute(x, ids, k):
    """Per row, its k nearest others by distance, id (null first), row."""
    out = []
    for a in range(len(x)):
        order = sorted((float(((x[a] - x[b]) ** 2).sum()), ids[b] is not None, ids[b] or 0, b)
                       for b in range(len(x)) if b != a)
        out.append(order[:k])
    return out


def test_one_block_is_exact_with_ties_and_repeated_ids(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (90, 3)).astype(float)
    ids = [None if i % 17 == 0 else i // 2 for i in range(90)]
    own = staged(spark, [(i, 1, r.tolist()) for i, r in zip(ids, x)])
    near = neighbours.block_neighbours(own.withColumn("b", F.lit(1)), ["b"], 4)
    found = {r._row: r.near for r in near.collect()}
    rows = sorted(own.collect(), key=lambda r: r._row)
    number = {r._row: i for i, r in enumerate(rows)}
    want = brute(np.array([r.x for r in rows]), [r.id for r in rows], 4)
    for i, r in enumerate(rows):
        assert [(n.d, n.id) for n in found[r._row]] == [
            (d, v if there else None) for d, there, v, _ in want[i]]
        assert all(rows[number[n.row]].id == n.id and n.row != r._row for n in found[r._row])


@pytest.mark.parametrize("kind", ["normal", "mixed", "clusters"])
def test_recall_over_many_blocks(spark, kind):
    rng = np.random.default_rng(5)
    n, d, k = 4000, 12, 5
    x = rng.normal(size=(n, d))
    if kind == "mixed":
        x[:, 4:] = x[:, 4:] > 0.7
    elif kind == "clusters":
        x += 4 * rng.normal(size=(30, d))[rng.integers(30, size=n)]
    own = staged(spark, [(i, 1, r.tolist()) for i, r in enumerate(x)])
    near = {r._row: [p.d for p in r.near] for r in
            neighbours.nearest_neighbours(own, k, block=256).collect()}
    rows = {r._row: np.array(r.x) for r in own.collect()}
    assert set(near) == set(rows)
    hits = 0
    sample = sorted(rows)[::40]
    for r in sample:
        far = np.sort(((x - rows[r]) ** 2).sum(axis=1))[1:k + 1]
        assert len(near[r]) == k
        hits += sum(v <= far[-1] + 1e-9 for v in near[r])
    assert hits / (k * len(sample)) >= 0.9


def test_blocks_are_bounded_even_for_equal_rows(spark):
    own = staged(spark, [(None if i < 700 else i, 1, [1.0, 2.0]) for i in range(1000)])
    scale = neighbours.coordinate_scale(own)
    blocked = neighbours.projected_blocks(own, scale, block=64, tables=3)
    sizes = blocked.groupBy("table", "block").count().collect()
    assert max(r["count"] for r in sizes) <= 64 and sum(r["count"] for r in sizes) == 3000
    near = neighbours.nearest_neighbours(own, 3, scale, block=64, tables=3).collect()
    assert len(near) == 1000 and all(len(r.near) == 3 and r.near[0].d == 0 for r in near)


def test_smote_rows_lie_between_minority_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 1 if i < 40 else -1, (rng.normal(size=3) + (5 if i < 40 else 0)).tolist()) for i in range(200)]
    rows += [(0, 1, rows[0][2]), (None, 1, rows[1][2]), (500, 1, None), (501, 1, [float("nan"), 1.0, 1.0])]
    df = vectors(spark, rows)
    out = smote.smote(df, percent=250, k=4).collect()
    new = [r for r in out if r.idn is None][1:]
    assert len(out) == len(rows) + 42 * 250 // 100
    own = np.array([x for i, y, x in rows if y == 1 and x is not None and np.isfinite(x).all()])
    low, high = own.min(axis=0) - 1e-9, own.max(axis=0) + 1e-9
    made = [r.indexedFeatures.toArray() for r in out if r.label == 1 and r.indexedFeatures is not None
            and np.isfinite(r.indexedFeatures.toArray()).all()]
    assert len(made) == 42 + 105 and all((low <= m).all() and (m <= high).all() for m in made)
    assert len(new) == 105
    again = smote.smote(df.repartition(3), percent=250, k=4).collect()
    assert Counter(map(str, again)) == Counter(map(str, out))


def test_smote_without_neighbours_or_minority(spark):
    alone = vectors(spark, [(1, 1, [3.0, 4.0]), (2, -1, [0.0, 0.0])])
    out = smote.smote(alone, percent=300).collect()
    assert [r.indexedFeatures.toArray().tolist() for r in out if r.label == 1] == [[3.0, 4.0]] * 4
    assert smote.smote(alone.where("label <> 1")).count() == 1
    assert smote.smote(alone.limit(0)).count() == 0


def test_smote_keeps_codes_whole(spark):
    rows = [(i, 1, [float(i % 2), float(i)]) for i in range(30)]
    df = spark.createDataFrame([(i, y, *x) for i, y, x in rows], "idn bigint, label int, a double, b double")
    data = assemble(df, ["a", "b"])
    data = fit_indexer(data).transform(data)
    assert smote.nominal_features(data) == [0]
    made = smote.smote(data, percent=200).where("idn is null").collect()
    values = [r.indexedFeatures.toArray() for r in made]
    assert len(values) == 60 and {v[0] for v in values} <= {0.0, 1.0}
    assert any(v[1] != round(v[1]) for v in values)
    kept = smote.smote(data, percent=200).schema["indexedFeatures"].metadata
    assert kept == data.schema["indexedFeatures"].metadata


def edit_by_hand(rows, k, spare):
    live = list(range(len(rows)))
    while True:
        x = np.array([rows[i][2] for i in live])
        near = brute(x, [rows[i][0] for i in live], k)
        keep = [i for p, i in enumerate(live) if rows[i][1] == spare
                or 2 * sum(rows[live[n[3]]][1] != rows[i][1] for n in near[p]) <= len(near[p])]
        if len(keep) == len(live):
            return Counter((rows[i][0], rows[i][1]) for i in live)
        live = keep


@pytest.mark.parametrize("spare", [1, None])
def test_edited_until_stable(spark, spare):
    rng = np.random.default_rng(9)
    rows = [(i, 1 if i % 4 == 0 else -1, (rng.normal(size=2) + (i % 4 == 0)).tolist()) for i in range(160)]
    df = vectors(spark, rows)
    got = instance_selection.edited(df, spare=spare)
    scale = np.array([r[2] for r in rows]).std(axis=0)
    scaled = [(i, y, (np.array(x) / scale).tolist()) for i, y, x in rows]
    assert Counter((r.idn, r.label) for r in got.collect()) == edit_by_hand(scaled, 3, spare)
    once = instance_selection.edited(df, spare=spare, rounds=1).count()
    assert got.count() <= once < len(rows)
    # Nothing more to remove, on its own scale of coordinates or not.
    assert got.columns == df.columns


def test_edited_keeps_ties_unusable_and_lonely_rows(spark):
    rows = [(1, 1, [0.0]), (2, -1, [0.0])]  # each other's only neighbour: all of it disagrees
    assert instance_selection.edited(vectors(spark, rows), spare=None).count() == 0
    tie = [(1, 1, [0.0]), (2, -1, [0.0]), (3, 1, [0.0])]
    kept = instance_selection.edited(vectors(spark, tie), k=2, spare=None).collect()
    assert sorted(r.idn for r in kept) == [1, 3]
    odd = [(7, -1, None), (None, -1, [float("inf")]), (8, 1, [1.0])]
    assert instance_selection.edited(vectors(spark, odd), spare=None).count() == 3
    assert instance_selection.edited(vectors(spark, []), spare=None).count() == 0


@pytest.mark.parametrize("ids", ["unique", "repeated", "null"])
def test_kmeans_sets_balance_with_any_ids(spark, ids):
    rng = np.random.default_rng(4)
    own = {"unique": lambda i: i, "repeated": lambda i: i // 10, "null": lambda i: i if i % 3 else None}[ids]
    rows = [(own(i), 1 if i < 30 else -1, rng.normal(size=2).tolist()) for i in range(330)]
    df = vectors(spark, rows)
    sets = kmeans_balance.kmeans_balanced_sets(df, k=4, n_trees=3).where("label <> 1")
    weights = {r["tree"]: r["w"] for r in sets.groupBy("tree").agg(F.sum("w").alias("w")).collect()}
    assert weights == {0: 30, 1: 30, 2: 30}
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "Inner" in line]
    assert not any("idn" in line for line in joins)


@pytest.mark.parametrize("strategy", ["smote", "enn"])
def test_ensembles_train_on_the_strategy(spark, strategy):
    rng = np.random.default_rng(6)
    rows = [(i, 1 if i % 9 == 0 else -1, (rng.normal(size=2) + 3 * (i % 9 == 0)).tolist()) for i in range(270)]
    df = vectors(spark, rows)
    model = BalancedTreeEnsemble(TreeParams("gini", 3, 16), feature_names=["a", "b"], balancing=strategy).fit(df)
    pred = model.predict(df, "soft").select("label", "predicted_label").collect()
    right = sum(r.label == r.predicted_label for r in pred)
    assert model.num_trees == (5 if strategy == "smote" else model.num_trees) and right > 240
