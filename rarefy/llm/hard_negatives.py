"""Op 11: hard-negative mining by residue-number-system matrix products.

Scores are integer inner products.  In a block of anchors and rows, the
integer components are reduced modulo a few small primes to residues around
zero, one float32 matrix product a prime multiplies them, over slices of the
dimension short enough for every partial sum to stay below 2^24, where float32
is exact.  The residues of a score give back its exact signed value by Chinese
remaindering in balanced mixed radix: with odd primes and digits around zero,
the digits' sum is the signed score itself.  As many primes are used as the
largest possible score of the block needs.

Two passes share that product.  The first gives each anchor its positives, in
blocks of one label.  The second gives each positive's negatives: the best rows
of another label whose score lies in a window below the positive's.  Blocks
bound the memory and keep the best few of each; Spark windows merge them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finite_vector, list_matrix, materialise, on_workers, scaled_components, with_row_id

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
# A negative's score: LOW/100 to HIGH/100 of the positive's.
LOW, HIGH = 50, 95
# Rows of one block on either side, and anchors multiplied at once.
ANCHOR_BLOCK = 8192
ROW_BLOCK = 8192
AT_ONCE = 256
# The largest prime; 260 products of two of its residues stay below 2^24.
FIRST_PRIME = 509
EXACT_FLOAT, EXACT_DOUBLE, LONG = 1 << 24, 1 << 53, (1 << 63) - 1


def _odd_primes(start: int) -> Iterator[int]:
    """From ``start`` down to 101, then up beyond it."""
    def prime(n: int) -> bool:
        return n % 2 == 1 and all(n % k for k in range(3, math.isqrt(n) + 1, 2))
    yield from (n for n in range(start, 100, -1) if prime(n))
    yield from (n for n in range(start + 1, 8192) if prime(n))


def primes_for(bound: int) -> list[int]:
    """Primes whose product tells all integers from -bound to bound apart."""
    chosen, product = [], 1
    for p in _odd_primes(FIRST_PRIME):
        if product > 2 * bound:
            return chosen
        chosen.append(p)
        product *= p
    raise ValueError("scores beyond the residue system's range")


def residues(x: np.ndarray, prime: int) -> np.ndarray:
    """``x`` (whole doubles of any size) modulo ``prime``, around zero, as float32."""
    r = np.fmod(x, prime)  # exact, also beyond 2^53
    return (r - prime * np.rint(r / prime)).astype(np.float32)


def _around_zero(x: np.ndarray, prime: int) -> np.ndarray:
    return x - prime * np.rint(x * (1.0 / prime))


def score_bound(a: np.ndarray, b: np.ndarray) -> int:
    """At least the largest absolute score of any two rows."""
    widest = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if 0 < widest < EXACT_DOUBLE:
        norms = [float(np.sqrt(np.einsum("ij,ij->i", m, m).max(initial=0))) for m in (a, b)]
        return min(widest, math.ceil(norms[0] * norms[1] * (1 + 1e-9)) + 1)
    return widest


def residue_scores(a: np.ndarray, b: np.ndarray, at_once: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray]]:
    """``(first row of a, int64 scores of some rows of a against b)``, exact.

    Scores beyond 64 bits stop at the limit.
    """
    primes = primes_for(score_bound(a, b))
    parts = [(p, residues(a, p), residues(b, p)) for p in primes]
    modulus = math.prod(primes)
    for at in range(0, len(a), at_once):
        digits: list[np.ndarray] = []
        for k, (p, ra, rb) in enumerate(parts):
            wide = max(1, (EXACT_FLOAT - 1) // (p // 2) ** 2)
            found = 0.0
            for s in range(0, a.shape[1], wide):
                product = ra[at:at + at_once, s:s + wide] @ rb[:, s:s + wide].T
                found = _around_zero(found + _around_zero(product.astype(np.float64), p), p)
            # Mixed radix: take the digits so far away, divide by their primes.
            digit = found + np.zeros((len(ra[at:at + at_once]), len(b)))
            for q, d in zip(primes[:k], digits):
                digit = _around_zero(_around_zero(digit - d, p) * pow(q, -1, p), p)
            digits.append(digit)
        whole = np.int64 if modulus < LONG else object
        score = np.zeros((len(a[at:at + at_once]), len(b)), dtype=whole)
        radix = 1
        for p, digit in zip(primes, digits):
            score = score + digit.astype(np.int64).astype(whole) * radix
            radix *= p
        if whole is object:
            score = np.clip(score, -LONG, LONG).astype(np.int64)
        yield at, score


def _best(score: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` best of ``rows`` by score; ``rows`` come in the order of ties."""
    mine = score[rows]
    if len(rows) > n:
        rows = rows[mine >= np.partition(mine, len(mine) - n)[len(mine) - n]]
        mine = score[rows]
    return rows[np.argsort(-mine, kind="stable")[:n]]


def _block(table: pa.Table, width: int) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """Anchors and rows of a block (rows by id and row number) and their matrices."""
    table = table.combine_chunks()
    side = table.column("side").to_numpy()
    anchors = table.take(pa.array(np.flatnonzero(side == 0)))
    rows = table.take(pa.array(np.flatnonzero(side == 1)))
    rows = rows.sort_by([("vec", "ascending"), ("_row", "ascending")])
    return anchors, rows, *(list_matrix(t.column("x").combine_chunks(), width) if len(t)
                            else np.zeros((0, width)) for t in (anchors, rows))


def _positives(table: pa.Table, width: int, n: int) -> pa.Table:
    """The ``n`` best other rows of each anchor of a block of one label."""
    anchors, rows, a, b = _block(table, width)
    own, row, vec = (anchors.column("_row").to_numpy(), rows.column("_row").to_numpy(),
                     rows.column("vec").to_numpy())
    out = []
    if len(a) and len(b):
        for at, scores in residue_scores(a, b):
            for i, score in enumerate(scores, at):
                best = _best(score, np.flatnonzero(row != own[i]), n)
                out.append((np.full(len(best), own[i]), vec[best], row[best], score[best]))
    joined = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 4
    return pa.table(joined, names=["anchor_row", "positive_id", "positive_row", "positive_score"])


def _negatives(table: pa.Table, width: int, n: int, low: int, high: int) -> pa.Table:
    """Per anchor and positive of a block, the ``n`` best rows of another label in the window."""
    anchors, rows, a, b = _block(table, width)
    own, label, positives = (anchors.column(c).to_pylist() for c in ("_row", "label", "positives"))
    row_label, vec, row = (rows.column(c).to_numpy() for c in ("label", "vec", "_row"))
    out = []
    if len(a) and len(b):
        for at, scores in residue_scores(a, b):
            for i, score in enumerate(scores, at):
                other = np.flatnonzero(row_label != label[i])
                mine = score[other]
                for place, p in enumerate(positives[i]):
                    s = p["score"]
                    # low * s <= 100 * score <= high * s, in integers of any size.
                    least, most = -(-low * s // 100), high * s // 100
                    if least > most:
                        continue
                    best = _best(score, other[(mine >= max(least, -LONG)) & (mine <= min(most, LONG))], n)
                    k = len(best)
                    out.append((np.full(k, own[i]), np.full(k, place), vec[best], row[best], score[best]))
    joined = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 5
    return pa.table(joined, names=["anchor_row", "place", "negative_id", "negative_row", "negative_score"])


def _blocks(n: str, size: int):
    return F.greatest(F.ceil(F.col(n) / F.lit(size)), F.lit(1)).cast("int")


def _dealt(frame: DataFrame, side: int, own: str, blocks: str, other_blocks: str) -> DataFrame:
    """A row in one block of its side and in all of the other side's."""
    deal = F.pmod(F.xxhash64("_row", F.lit(side)), F.col(blocks)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1))
    other = "rb" if own == "ab" else "ab"
    return frame.withColumn(own, deal).withColumn(other, copies).withColumn("side", F.lit(side))


def mine_hard_negatives(vectors: DataFrame, anchor: str, vec_id: str = "vec_id",
                        embedding: str = "embedding", label: str = "label", scale: int = SCALE,
                        positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                        high: int = HIGH, anchor_block: int = ANCHOR_BLOCK,
                        row_block: int = ROW_BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` is a SQL predicate that picks the anchors (null: none); ``label``
    a SQL expression.  An anchor's positives are its ``positives`` highest
    scoring other rows of its label; each takes its ``negatives`` highest
    scoring rows of other labels from ``low`` to ``high`` percent of the
    positive's score.  Ties go to the smaller id, then to any order.  Rows with
    a null id, label or vector, or a null or non-finite component take no part;
    shorter vectors count as padded with zeros; repeated rows take part each;
    a positive without negatives gives no row.  Scores beyond 64 bits stop at
    the limit.  An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
              "positive_score bigint, negative_score bigint")
    usable = vectors.where(F.col(vec_id).isNotNull() & F.expr(label).isNotNull()
                           & F.col(embedding).isNotNull() & finite_vector(embedding))
    rows = materialise(with_row_id(usable.select(
        F.col(vec_id).cast("bigint").alias("vec"), F.expr(label).cast("bigint").alias("label"),
        F.coalesce(F.expr(anchor), F.lit(False)).alias("is_anchor"),
        scaled_components(embedding, scale).alias("x"))))
    total = rows.agg(F.max(F.size("x")).alias("width"), F.count(F.lit(1)).alias("n"),
                     F.count_if("is_anchor").alias("anchors")).first()
    if not total["anchors"]:
        return spark.createDataFrame([], schema)
    width = int(total["width"])

    # Pass 1: blocks of one label; a label of any size is dealt over many.
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("a"))
    sizes = sizes.where("a > 0").select("label", _blocks("a", anchor_block).alias("abs"),
                                        _blocks("n", row_block).alias("rbs"))
    sized = rows.join(sizes, "label")
    columns = ["label", "ab", "rb", "side", "_row", "vec", "x"]
    pairs = (_dealt(sized.where("is_anchor"), 0, "ab", "abs", "rbs").select(*columns)
             .unionByName(_dealt(sized, 1, "rb", "rbs", "abs").select(*columns)))
    found = pairs.groupBy("label", "ab", "rb").applyInArrow(
        on_workers(_positives, width, positives),
        "anchor_row bigint, positive_id bigint, positive_row bigint, positive_score bigint")
    order = Window.partitionBy("anchor_row").orderBy(F.col("positive_score").desc(), "positive_id",
                                                     "positive_row")
    best = found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives)
    lists = best.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct(
        "place", F.col("positive_score").alias("score"), F.col("positive_id").alias("id"))))
        .alias("positives"))  # ``positives`` entries at most
    anchors = materialise(rows.where("is_anchor").join(
        lists, F.col("_row") == F.col("anchor_row")).drop("anchor_row", "is_anchor"))

    # Pass 2: anchors with a positive against all rows, in blocks.
    dealt = {"abs": F.lit(max(1, -(-anchors.count() // anchor_block))),
             "rbs": F.lit(max(1, -(-total["n"] // row_block)))}
    columns = ["ab", "rb", "side", "_row", "vec", "label", "x", "positives"]
    nothing = F.lit(None).cast(anchors.schema["positives"].dataType)
    pairs = (_dealt(anchors.withColumns(dealt), 0, "ab", "abs", "rbs").select(*columns)
             .unionByName(_dealt(rows.withColumns(dealt).withColumn("positives", nothing),
                                 1, "rb", "rbs", "abs").select(*columns)))
    found = pairs.groupBy("ab", "rb").applyInArrow(
        on_workers(_negatives, width, negatives, low, high),
        "anchor_row bigint, place bigint, negative_id bigint, negative_row bigint, negative_score bigint")
    order = Window.partitionBy("anchor_row", "place").orderBy(F.col("negative_score").desc(),
                                                              "negative_id", "negative_row")
    chosen = (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives))
    asked = anchors.select(F.col("_row").alias("anchor_row"), F.col("vec").alias("anchor_id"),
                           F.explode("positives").alias("p"))
    asked = asked.select("anchor_row", "anchor_id", F.col("p.place").cast("bigint").alias("place"),
                         F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return chosen.join(asked, ["anchor_row", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
