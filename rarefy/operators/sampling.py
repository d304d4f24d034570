"""Splits, samples, balance plan and per-tree bootstraps (SMP1-SMP5, BAL1, GRD2).

All random choices are md5 uniforms of (tag, seed, row id), so they do not
depend on partitioning or cluster size and can be checked by SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind
from ..functions.hashing import hash_uniform
from ..functions.poisson import draws_for, poisson_cdf_frame, poisson_count
from ..schema import FRAUD, ID, LABEL, is_minority


def split_uniform(seed, idn: str = ID) -> Column:
    return hash_uniform("split:", str(seed), ":", F.col(idn))


def in_train(train: float, seed, idn: str = ID) -> Column:
    """u(seed, id) < train; rows without an id share one draw."""
    return split_uniform(seed, idn) < F.lit(train)


def hash_split(df: DataFrame, train: float = 0.7, seed="0", idn: str = ID) -> DataFrame:
    """SMP3: add ``split`` = 'train' when u(seed, id) < train, else 'test'."""
    return df.withColumn(
        "split", F.when(in_train(train, seed, idn), F.lit("train")).otherwise(F.lit("test")))


def train_test(df: DataFrame, train: float = 0.7, seed="0",
               idn: str = ID) -> tuple[DataFrame, DataFrame]:
    """SMP1 (deterministic form): the two sides of :func:`hash_split`."""
    t = in_train(train, seed, idn)
    return df.where(t), df.where(~t)


def hash_sample(df: DataFrame, rate: float, seed="0", idn: str = ID) -> DataFrame:
    """SMP2 (deterministic form): Bernoulli sample without replacement."""
    return df.where(hash_uniform("sample:", str(seed), ":", F.col(idn)) < F.lit(rate))


def balance_plan(df: DataFrame, label: str = LABEL, minority: int = FRAUD) -> DataFrame:
    """BAL1: one row (n_minor, n_major, fraction, ratio, n_trees).

    fraction = n_minor / n_major; ratio = n_major div n_minor; the number of
    trees is ratio made odd (ratio + 1 when even).  With no minority row the
    ratio is NULL (a fit raises).
    """
    counts = df.agg(F.count_if(is_minority(label, minority)).alias("n_minor"),
                    F.count_if(~is_minority(label, minority)).alias("n_major"))
    ratio = F.when(F.col("n_minor") > 0, F.expr("n_major div n_minor"))
    return counts.select(
        "n_minor", "n_major",
        F.try_divide(F.col("n_minor").cast("double"), F.col("n_major").cast("double"))
         .alias("fraction"),
        ratio.cast("bigint").alias("ratio"),
        (ratio + F.lit(1) - ratio % 2).cast("bigint").alias("n_trees"))


def plan_values(plan: DataFrame) -> tuple[int, float]:
    """(n_trees, fraction) of a balance plan: one tiny row read by the driver.

    Raises when there is no minority row (the ratio is undefined).
    """
    row = plan.select("n_minor", "n_trees", "fraction").first()
    if not row["n_minor"]:
        raise ValueError("no minority row: cannot plan a balanced ensemble")
    return int(row["n_trees"]), float(row["fraction"])


def _tree_copies(df: DataFrame, plan: DataFrame, seed, idn: str) -> tuple[DataFrame, Column]:
    """``df`` plus its uniforms, and the expression of a row's copies: an array of (tree, w) structs.

    Each tree draws the majority with replacement at rate ``fraction``, i.e.
    a row's count in a tree is Poisson(fraction).  Independent Poisson
    counts over T trees are the same as one Poisson(T*fraction) total split
    uniformly among the trees, so every row draws one total by inverse CDF
    and sends each copy to tree floor(T*u_j).  Work is O(rows), not
    O(rows * trees), and nothing is shuffled.  The plan (two numbers) and the
    CDF table (K+1 doubles) are small constants and enter the row expressions
    as literals.  The array is to be exploded as it is: as a column, or under a
    filter on its size, it would be computed once more for the filter.
    """
    n_trees, fraction = plan_values(plan)
    lam = n_trees * fraction
    draws = draws_for(lam)
    cdf = poisson_cdf_frame(df.sparkSession, F.lit(lam / draws)).first()["cdf"]
    # A uniform is below 1: the steps from there on count for nothing.
    steps = F.array(*[F.lit(float(c)) for c in cdf if c < 1.0] or [F.lit(1.0)])
    s = str(seed)
    tags = [[], *[[":", str(j)] for j in range(1, draws)]]
    uniforms = [f"_u{j}" for j in range(draws)]
    staged = df.withColumns({name: hash_uniform("boot:", s, ":", F.col(idn), *tag)
                             for name, tag in zip(uniforms, tags)})
    total = reduce(Column.__add__, [poisson_count(F.col(name), steps) for name in uniforms])

    def tree_of(j: Column) -> Column:
        return F.floor(F.lit(n_trees) * hash_uniform("tree:", s, ":", F.col(idn), ":", j)).cast("int")

    def counted(copies: Column) -> Column:
        return F.transform(F.array_distinct(copies), lambda t: F.struct(
            t.alias("tree"), F.size(F.filter(copies, lambda c: c == t)).alias("w")))

    copies = bind(total, lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), tree_of)))
    return staged, bind(copies, counted)


def bootstrap_weights(majority: DataFrame, plan: DataFrame, seed="0",
                      idn: str = ID) -> DataFrame:
    """SMP4: per-tree bootstrap counts of the majority rows -> (tree, idn, w), w > 0."""
    staged, per_tree = _tree_copies(majority, plan, seed, idn)
    return (staged.select(idn, F.explode(per_tree).alias("tw"))
            .select(F.col("tw.tree").alias("tree"), F.col(idn).alias("idn"), F.col("tw.w").alias("w")))


def balanced_sets(df: DataFrame, plan: DataFrame | None = None, seed="0",
                  label: str = LABEL, minority: int = FRAUD, idn: str = ID,
                  keep: list[str] | None = None) -> DataFrame:
    """SMP5: long table (tree, w, <keep columns>) of every tree's balanced set.

    Tree t gets every minority row with weight 1 plus its bootstrap sample of
    the majority with weight = bootstrap count.  ``keep`` defaults to all
    columns.  Weights are computed in the row (no join, no shuffle).
    """
    plan = plan if plan is not None else balance_plan(df, label, minority)
    keep = keep or df.columns
    n_trees, _ = plan_values(plan)
    minor = (df.where(is_minority(label, minority))
             .select(F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"),
                     F.lit(1).alias("w"), *keep))
    staged, per_tree = _tree_copies(df.where(~is_minority(label, minority)), plan, seed, idn)
    major = (staged.select(F.explode(per_tree).alias("tw"), *keep)
             .select(F.col("tw.tree").alias("tree"), F.col("tw.w").alias("w"), *keep))
    return minor.unionByName(major)
