"""Op 5: exact top-k search by inner product as a Voronoi kNN join.

Vectors x are lifted to x' = (x, sqrt(M - |x|^2)), M the largest squared norm,
and queries to q' = (q, 0): then |q' - x'|^2 = |q|^2 + M - 2 q.x, so the k
largest inner products are the k nearest lifted neighbours.

Lifted rows are grouped by their nearest pivot.  Per group, summaries hold the
count, the radius of its queries, the distance range of its data, and its k + 1
least distances to the pivot.  From them every query group gets a bound on the
distance of its k-th neighbour, and a data row is sent to a query group only
if the triangle inequality allows a distance within the bound, and if the plane
between the two pivots is within it.  Groups that need most of the rows anyway
are solved as one against all rows, so that copies follow the queries' blocks
and not the pivots.  Query groups and their data are dealt into blocks of
bounded size; each block is solved by a matrix product, and the blocks' best k
are merged.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (EXACT_DOUBLE, buckets_for, finite_vector, list_matrix, materialise, on_workers,
                     scaled_components, with_row_id)

K = 20
SCALE = 64
# Pivots: a bounded sample of the data, spread by farthest-first choice.
PIVOTS = 24
PIVOT_SAMPLE = 2000
# Rows of one block on either side.
QUERY_BLOCK = 2048
DATA_BLOCK = 8192
# Relative slack for rounding in distances; the final scores are exact integers.
SLACK = 1e-9


def scaled_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: int,
                   query: str) -> DataFrame:
    """``_row, vec, is_query, x``: components floor(scale * x); unusable vectors left out."""
    rows = vectors.where(F.col(embedding).isNotNull() & finite_vector(embedding)).select(
        F.col(vec_id).alias("vec"), F.coalesce(F.expr(query), F.lit(False)).alias("is_query"),
        scaled_components(embedding, scale).alias("x"))
    return with_row_id(rows).select("_row", "vec", "is_query", "x")


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - _norms(x), 0.0))[:, None]], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = _norms(x)[:, None] + _norms(pivots)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first choice from a bounded sample."""
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(pivots, len(sample)):
        at = int(np.argmax(near))
        if near[at] <= 0:
            break
        chosen.append(at)
        near = np.minimum(near, _distances(sample, sample[at:at + 1])[:, 0])
    return sample[chosen]


def _assign(batches: Iterator[pa.RecordBatch], pivots: list, top: float, width: int) -> Iterator[pa.RecordBatch]:
    """Nearest pivot of each row, as data (lifted) and, for queries, as query with all distances."""
    p = np.asarray(pivots)
    for batch in batches:
        x = list_matrix(batch.column(3), width)
        is_query = np.asarray(batch.column(2).to_numpy(zero_copy_only=False)).astype(bool)
        d = _distances(_lift(x, top), p)
        cell = np.argmin(d, axis=1)
        q = _distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), p)
        q_cell = np.argmin(q, axis=1)
        at = np.arange(len(x))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[at, cell]),
             pa.array(np.where(is_query, q_cell, -1).astype(np.int32)), pa.array(q[at, q_cell]),
             pa.array([v if w else None for v, w in zip(q, is_query)], pa.list_(pa.float64()))],
            names=["_row", "vec", "is_query", "x", "cell", "d", "q_cell", "q_d", "q_all"])


def query_bounds(pivots: np.ndarray, radius: dict[int, float], nearest: dict[int, list[float]],
                 k: int) -> dict[int, float]:
    """Per query group, a distance within which k candidates lie for any of its queries.

    One more neighbour than k is counted: a query may be its own.
    """
    between = _distances(pivots, pivots)
    out = {}
    for g, r in radius.items():
        reach = np.sort(np.concatenate([r + between[g, c] + np.asarray(ds)
                                        for c, ds in nearest.items()]))
        out[g] = float(reach[k]) if len(reach) > k else float("inf")
    return out


def merged_groups(sent: dict[int, int], sizes: dict[int, int], n: int, block: int) -> set[int]:
    """Query groups to solve as one against all ``n`` rows, where that sends fewer copies.

    ``sent``: rows a group needs; ``sizes``: its queries, sent to in blocks of ``block``.
    Groups that need most of the rows go first.
    """
    def blocks(queries: int) -> int:
        return -(-queries // block)

    order = sorted(sent, key=lambda g: (-sent[g], g))
    apart = sum(sent[g] * blocks(sizes[g]) for g in order)
    best, chosen, together = apart, 0, 0
    for i, g in enumerate(order, 1):
        apart -= sent[g] * blocks(sizes[g])
        together += sizes[g]
        if n * blocks(together) + apart < best:
            best, chosen = n * blocks(together) + apart, i
    return set(order[:chosen])


def _solve(pdf: pd.DataFrame, k: int, width: int) -> pd.DataFrame:
    """Best k candidates of every query of one block, by exact integer score."""
    is_q = pdf["side"].to_numpy() == 0
    q, c = pdf[is_q].sort_values("_row"), pdf[~is_q].sort_values(["vec", "_row"])
    empty = pd.DataFrame({"q_row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"),
                          "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    if not len(q) or not len(c):
        return empty

    def dense(rows):
        out = np.zeros((len(rows), width))
        for i, v in enumerate(rows["x"]):
            out[i, :len(v)] = v
        return out

    a, b = dense(q), dense(c)
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1)
    if bound >= EXACT_DOUBLE:  # beyond exact doubles: integers of any size
        a, b = (np.vectorize(int, otypes=[object])(m) for m in (a, b))
    q_rows, c_rows, ids = q["_row"].to_numpy(), c["_row"].to_numpy(), c["vec"].to_numpy()
    parts = []
    for at in range(0, len(a), 256):
        scores = a[at:at + 256] @ b.T
        for i, row in enumerate(scores):
            other = np.flatnonzero(c_rows != q_rows[at + i])
            mine = row[other]
            if len(mine) > k and bound < EXACT_DOUBLE:
                # All candidates at least as good as the k-th best: ties stay together.
                other = other[mine >= np.partition(mine, len(mine) - k)[len(mine) - k]]
                mine = row[other]
            # Candidates come by id, so a stable sort breaks ties to the smaller id.
            best = np.argsort(-mine, kind="stable")[:k]
            limit = (1 << 63) - 1
            parts.append(pd.DataFrame({
                "q_row": q_rows[at + i], "query_id": q["vec"].iloc[at + i], "vec_id": ids[other[best]],
                "score": [max(-limit, min(limit, int(v))) for v in mine[best]]}))
    return pd.concat(parts, ignore_index=True) if parts else empty


def top_k_inner_product(vectors: DataFrame, query: str, vec_id: str = "vec_id",
                        embedding: str = "embedding", k: int = K, scale: int = SCALE,
                        pivots: int = PIVOTS, query_block: int = QUERY_BLOCK,
                        data_block: int = DATA_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's k highest integer inner products.

    ``query`` is a SQL predicate over ``vectors`` that picks the query rows
    (null: no query); candidates are all other rows.  Ties go to the smaller
    id.  Vectors that are null or hold null or non-finite components take no
    part; shorter ones count as padded with zeros; rows with a null id take no
    part.  Repeated rows are candidates and queries each.  Scores beyond 64
    bits stop at the limit.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(scaled_vectors(vectors.where(F.col(vec_id).isNotNull()), vec_id, embedding, scale, query))
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    total = rows.agg(F.max(F.size("x")).alias("width"), F.max(norm).alias("top")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if total["width"] is None:
        return spark.createDataFrame([], schema)
    width, top = int(total["width"]), float(total["top"])

    # A bounded sample by hash picks the pivots; the search is exact for any pivots.
    sample = (rows.orderBy(F.xxhash64("_row")).limit(PIVOT_SAMPLE).select("x")).toArrow()
    base = _lift(list_matrix(sample.column(0).combine_chunks(), width), top)
    chosen = choose_pivots(base, pivots)
    placed = materialise(rows.mapInArrow(
        on_workers(_assign, chosen.tolist(), top, width),
        "_row bigint, vec bigint, is_query boolean, x array<double>, cell int, d double, q_cell int, "
        "q_d double, q_all array<double>"))

    # Summaries: at most `pivots` rows, each with k + 1 distances.
    slices = 16 * buckets_for(spark)
    by_cell = Window.partitionBy("cell", "slice").orderBy("d")
    nearest = (placed.select("cell", "d", F.pmod(F.xxhash64("_row"), F.lit(slices)).alias("slice"))
               .withColumn("r", F.row_number().over(by_cell)).where(F.col("r") <= k + 1)
               .groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("d")), 1, k + 1).alias("ds")))
    near = {r["cell"]: r["ds"] for r in nearest.collect()}
    queries = placed.where("is_query")
    groups = {r["q_cell"]: (r["q_d"], r["n"]) for r in
              queries.groupBy("q_cell").agg(F.max("q_d").alias("q_d"), F.count(F.lit(1)).alias("n")).collect()}
    if not groups:
        return spark.createDataFrame([], schema)
    bounds = query_bounds(chosen, {g: r for g, (r, _) in groups.items()}, near, k)
    between = _distances(chosen, chosen)

    # How far a group's queries are at least from the plane between its pivot and another's.
    beyond = {(r["q_cell"], r["c"]): r["gap"] for r in
              queries.select("q_cell", "q_d", F.posexplode("q_all").alias("c", "to"))
              .groupBy("q_cell", "c").agg(F.min(F.col("to") * F.col("to") - F.col("q_d") * F.col("q_d")).alias("gap"))
              .collect()}

    # A data row may be within the bound of group g only if its distance to its own
    # pivot lies in the ring [low, high] around that pivot, and if the plane between
    # the pivots is within the bound.
    slack = SLACK * (1.0 + float(np.sqrt(top)) + float(between.max(initial=0.0)))

    def parted(g, c):
        return g != c and between[g, c] > 0 and (
            beyond[g, c] / (2 * between[g, c]) - slack * (1.0 + float(between.max())) > bounds[g])
    ring_type = "g int, cell int, low double, high double"
    rings = [(g, c, float(between[g, c] - r - bounds[g] - slack), float(between[g, c] + r + bounds[g] + slack))
             for g, (r, _) in groups.items() for c in near if not parted(g, c)]
    # At most pivots^2 rows here and a row a group below: bounded by the parameter, not by the data.
    ring = F.broadcast(spark.createDataFrame(rings, ring_type))
    within = placed.join(ring, "cell").where("d between low and high")
    sent = {r["g"]: r["n"] for r in within.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes, n = {g: q for g, (_, q) in groups.items()}, placed.count()
    logging.getLogger(__name__).info("pairs within bounds: %d of %d", sum(sent.get(g, 0) * sizes[g] for g in sizes),
                                     n * sum(sizes.values()))
    merged = merged_groups({g: sent.get(g, 0) for g in sizes}, sizes, n, query_block)
    if merged:
        rings = [r for r in rings if r[0] not in merged] + [(-1, c, 0.0, float("inf")) for c in near]
        sent[-1], sizes[-1] = n, sum(sizes[g] for g in merged)
    # Group of the queries of a cell, blocks of queries, blocks of data.
    plan = spark.createDataFrame(
        [(g, to, max(1, -(-sizes[to] // query_block)), max(1, -(-sent.get(to, 0) // data_block)))
         for g in groups for to in (-1 if g in merged else g,)],
        "q_cell int, g int, blocks int, data_blocks int")
    by_group = F.broadcast(plan.drop("q_cell").distinct())
    data = (placed.join(F.broadcast(spark.createDataFrame(rings, ring_type)), "cell").where("d between low and high")
            .join(by_group, "g")
            .select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qb"),
                    F.pmod(F.xxhash64("_row"), F.col("data_blocks")).cast("int").alias("db"),
                    F.lit(1).alias("side"), "_row", "vec", "x"))
    asked = (queries.join(F.broadcast(plan), "q_cell")
             .select("g", F.pmod(F.xxhash64("_row", F.lit(1)), F.col("blocks")).cast("int").alias("qb"),
                     F.explode(F.sequence(F.lit(0), F.col("data_blocks") - 1)).alias("db"),
                     F.lit(0).alias("side"), "_row", "vec", "x"))
    solved = asked.unionByName(data).groupBy("g", "qb", "db").applyInPandas(
        on_workers(_solve, k, width), "q_row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id")
    return (solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
