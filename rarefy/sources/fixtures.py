"""Test tables derived from the driver's ``events`` table (see FIXTURES.md).

``transactions`` is a small look-alike of the wide transaction table: id,
response code, label, amount, one-hot and day-part flags and rolling
per-user counts/averages.  ``tree_votes``/``scored`` stand in for the output
of a trained ensemble with deterministic per-tree probabilities, so the vote
combiners and all evaluators can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..schema import labelled
from .tables import read_table

# Fixed values of the fixture.
HOUR_US = 3600 * 1000 * 1000
WINDOW_6H = 6 * HOUR_US
WINDOW_24H = 24 * HOUR_US
FIXTURE_TREES = 9
FEATURES = ("monto", "is_purchase", "is_click", "is_view", "fds", "madr", "morn",
            "tard", "noch", "cuenta_monto_user_6h", "cuenta_monto_user_24h",
            "pro_monto_user_24h")
BINARY_FEATURES = ("is_purchase", "is_click", "is_view", "fds", "madr", "morn",
                   "tard", "noch")


def _with_rolling_user_stats(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Trailing 6 h / 24 h count and 24 h mean per user, current row included.

    A user may own a large share of all events, so the window is not
    partitioned by user alone: rows are cut into 24 h buckets and every row
    is also copied into the next bucket as context.  A frame of at most 24 h
    then lies inside one (user, bucket) partition, which bounds partition
    size by two days of one user's events.  Context copies are dropped after
    the window; all other columns ride along, so this is the only shuffle.
    """
    copies = (rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
              .withColumn("bucket", F.floor(F.col("t_us") / F.lit(WINDOW_24H)) + F.col("copy")))
    w = Window.partitionBy("user_id", "bucket").orderBy("t_us")
    w6 = w.rangeBetween(-WINDOW_6H, 0)
    w24 = w.rangeBetween(-WINDOW_24H, 0)
    return (copies
            .select(*keep, "copy",
                    F.count(F.lit(1)).over(w6).alias("cuenta_monto_user_6h"),
                    F.count(F.lit(1)).over(w24).alias("cuenta_monto_user_24h"),
                    F.round(F.avg("monto").over(w24), 6).alias("pro_monto_user_24h"))
            .where(F.col("copy") == 0)
            .drop("copy"))


def transactions_from_events(ev: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    hour = F.hour("ts")
    u = hash_uniform("label:", F.col("event_id"))
    purchase = F.col("event_type") == "purchase"
    p_fraud = (F.lit(0.02)
               + F.when(purchase & (F.col("value") >= 50), F.lit(0.35)).otherwise(F.lit(0.0))
               + F.when(hour < 6, F.lit(0.08)).otherwise(F.lit(0.0)))
    rows = ev.select(
        F.col("event_id").alias("idn"),
        F.when(k < 60, 1).when(k < 90, 2).otherwise(3).alias("resp_code"),
        F.when(F.col("event_type") == "signup", 0)
         .when(u < p_fraud, 1).otherwise(-1).alias("label"),
        F.col("value").alias("monto"),
        purchase.cast("int").alias("is_purchase"),
        (F.col("event_type") == "click").cast("int").alias("is_click"),
        (F.col("event_type") == "view").cast("int").alias("is_view"),
        F.dayofweek("ts").isin(1, 7).cast("int").alias("fds"),
        (hour < 6).cast("int").alias("madr"),
        ((hour >= 6) & (hour < 12)).cast("int").alias("morn"),
        ((hour >= 12) & (hour < 18)).cast("int").alias("tard"),
        (hour >= 18).cast("int").alias("noch"),
        "user_id",
        # Microseconds since the epoch of the wall-clock value: no session time zone involved.
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
               "CAST(ts AS TIMESTAMP_NTZ))").alias("t_us"),
    )
    keep = ["idn", "resp_code", "label", "monto", "is_purchase", "is_click", "is_view",
            "fds", "madr", "morn", "tard", "noch"]
    return _with_rolling_user_stats(rows, keep)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(read_table(spark, sf_dir, "events"))


def vote_probabilities(trees: int = FIXTURE_TREES):
    """Per-row array of the fixture's per-tree P(fraud), tree 0..trees-1.

    q = least(10, greatest(0, floor(11*u(tree, idn)) + label)), p1 = q / 10.
    """
    def p1(t):
        u = hash_uniform("vote:", t, ":", F.col("idn"))
        q = F.least(F.lit(10), F.greatest(F.lit(0), F.floor(F.lit(11) * u) + F.col("label")))
        return q / F.lit(10.0)
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), p1)


def vote_arrays_from(labelled_rows: DataFrame, trees: int = FIXTURE_TREES) -> DataFrame:
    """(idn, label, p1s array<double>) for already labelled rows."""
    return labelled_rows.select("idn", "label", vote_probabilities(trees).alias("p1s"))


def tree_vote_arrays(spark: SparkSession, sf_dir: str,
                     trees: int = FIXTURE_TREES) -> DataFrame:
    """(idn, label, p1s array<double>): votes of the labelled rows, wide form."""
    return vote_arrays_from(labelled(transactions(spark, sf_dir)), trees)


def tree_votes(spark: SparkSession, sf_dir: str, trees: int = FIXTURE_TREES) -> DataFrame:
    """Long form (idn, label, tree, p1, vote); vote = 1 iff p1 > 0.5."""
    wide = tree_vote_arrays(spark, sf_dir, trees)
    return (wide.select("idn", "label", F.posexplode("p1s").alias("tree", "p1"))
            .withColumn("vote", (F.col("p1") > 0.5).cast("int")))


def scored_from(labelled_rows: DataFrame) -> DataFrame:
    """Soft vote of the fixture votes: (idn, label, p0, p1, predicted_label)."""
    from ..operators.votes import combine
    votes = vote_arrays_from(labelled_rows)
    return combine(votes, "soft").select("idn", "label", "p0", "p1", "predicted_label")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_from(labelled(transactions(spark, sf_dir)))
