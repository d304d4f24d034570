"""Op 8: mixing sources to target weights by Pareto order sampling.

Every source gets a target in words.  Inside a source every document has an
expected number of copies, proportional to its preference level and at most
``max_copies``; the whole part is certain, and the fraction is the inclusion
probability p of one more copy.  Documents are ranked by
odds(u) / odds(p), u a hash of the document's id, and taken in that order
until the words of the source's target are reached: a sample of fixed size
with unequal probabilities, the same on every run.

No source is sorted as a whole.  The rank's range is cut into bins, words are
summed per (source, bin), the bin in which a source's target is reached is cut
again, and only what lies in that last bin is put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, quoted, word_count

# Fixed values of the query: weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_COPIES = 2
# Documents of fewer words are half as likely to get a further copy.
SHORT_WORDS = 64
LEVELS = (2, 1)
# Bins of a round: a power of two, so that a bin's edge is an exact double.
BINS = 128
# Fixed value: 13 hex digits of md5 give a 52-bit integer.
HEX_DIGITS = 13


def uniform(key: Column, seed: str) -> Column:
    """u in (0, 1): (the first 52 bits of md5(seed || key) + 1/2) / 2^52."""
    text = F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 4 * HEX_DIGITS))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS,
                   share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` from one row per source (``source, source_size``).

    The total share is dealt by weight; targets stop at ``max_copies`` times
    their source's size and the excess is dealt again by weight among the
    others.  Sources ordered by size per weight reach their cap in that order,
    so the final state is one cut in that order: the sources before it are
    capped and the rest share what is left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    n = F.row_number().over(by_name) - 1
    weighted = sizes.select("source", "source_size",
                            F.element_at(cycle, F.pmod(n, F.lit(len(weights))) + 1).alias("w"), n.alias("n"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "n")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)
    run = weighted.select(
        "*",
        F.coalesce(F.sum("source_size").over(upto), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("w").over(upto), F.lit(0.0)).alias("w_before"),
        F.sum("source_size").over(everything).alias("size_all"), F.sum("w").over(everything).alias("w_all"))
    left = (F.col("size_all") * share_percent / F.lit(100.0) - max_copies * F.col("size_before"))
    rate = left / (F.col("w_all") - F.col("w_before"))
    cap = (max_copies * F.col("source_size")).cast("double")
    # A source is capped while its cap does not exceed what the uncapped rest would give it.
    stepped = run.select("*", rate.alias("rate"), (rate * F.col("w") >= cap).alias("capped"))
    final = F.min(F.when(~F.col("capped"), F.struct("n2", "rate"))).over(everything)["rate"]
    numbered = stepped.withColumn("n2", F.row_number().over(order))
    return numbered.select("source", "source_size",
                           F.when(F.col("capped"), cap).otherwise(final * F.col("w")).alias("target"))


def _rates(levels: DataFrame, max_copies: int) -> DataFrame:
    """``source, rate``: copies expected per unit of preference.

    ``levels`` has one row per source and preference level (``source, target,
    level, level_size``).  Levels above the cut get ``max_copies`` copies, the
    others share the rest of the target in proportion.
    """
    by = Window.partitionBy("source").orderBy(F.col("level").desc())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    run = levels.select(
        "source", "level",
        ((F.col("target") - max_copies * F.coalesce(F.sum("level_size").over(before), F.lit(0)))
         / F.nullif(F.sum(F.col("level") * F.col("level_size")).over(after), F.lit(0))).alias("rate"))
    ok = F.col("rate") * F.col("level") <= max_copies
    return (run.groupBy("source")
            .agg(F.max_by("rate", F.when(ok, F.col("level"))).alias("rate"))
            .select("source", F.coalesce("rate", F.lit(float(max_copies))).alias("rate")))


def mixture_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 source: str = "source", seed: str = "mix:", weights: Sequence[int] = WEIGHTS,
                 share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES,
                 short_words: int = SHORT_WORDS, bins: int = BINS, keep: Sequence[str] = ()) -> DataFrame:
    """Per document ``doc_id, size, source, source_size, target, copies`` and ``keep`` columns.

    Null and empty texts have size 0 and are never repeated.  A null source is
    a source of its own.  Rows that repeat an id share its draw; null ids share
    one draw.  An empty table gives no rows.
    """
    level = F.when(F.col("size") < short_words, LEVELS[1]).otherwise(LEVELS[0])
    sized = docs.select(F.col(doc_id).alias("doc"), F.col(source).alias("source"),
                        word_count(text).alias("size")).withColumn("level", level)
    sized = materialise(sized.where("size > 0"))
    # From here on, tables of a row per source: recomputed from the narrow
    # sized table where two plans need them, written only once they are final.
    per_level = sized.groupBy("source", "level").agg(F.sum("size").alias("level_size"))
    present = docs.select(F.col(source).alias("source")).distinct()
    totals = per_level.groupBy("source").agg(F.sum("level_size").alias("source_size"))
    sizes = (present.alias("p").join(totals.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")), "left")
             .select("p.source", F.coalesce("t.source_size", F.lit(0)).cast("bigint").alias("source_size")))
    targets = source_targets(sizes, weights, share_percent, max_copies)
    with_target = per_level.alias("l").join(
        targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select(
        "l.source", "l.level", "l.level_size", "t.target")
    params = (targets.alias("t").join(_rates(with_target, max_copies).alias("r"),
                                      F.col("t.source").eqNullSafe(F.col("r.source")), "left")
              .select("t.source", "t.source_size", "t.target", "r.rate"))
    params = materialise(params)

    ranked = _ranked(sized.alias("d").join(params.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
                     .select("d.doc", "p.source", "d.size", "d.level", "p.target", "p.rate"),
                     seed, max_copies)
    cuts = _cuts(ranked, bins)
    settings = materialise(
        params.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
        .select("p.*", "c.cut_rank", "c.cut_key"))

    # Every row decides by its source's settings alone (a few numbers per source).
    others = [c for c in dict.fromkeys(keep) if c not in (doc_id,)]
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(source).alias("_source"),
                       word_count(text).alias("_size"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(others)])
    joined = rows.join(settings.withColumnsRenamed({c: f"_s_{c}" for c in settings.columns}),
                       F.col("_source").eqNullSafe(F.col("_s_source")))
    joined = joined.select("*", F.when(F.col("_size") < short_words, LEVELS[1]).otherwise(LEVELS[0]).alias("_level"))
    decided = _ranked(joined.select(
        "*", F.col("_doc").alias("doc"), F.col("_size").alias("size"), F.col("_level").alias("level"),
        F.col("_s_rate").alias("rate")), seed, max_copies)
    chosen = F.when(F.col("_s_cut_rank").isNull(), F.lit(0)).when(
        (F.col("rank") < F.col("_s_cut_rank"))
        | ((F.col("rank") == F.col("_s_cut_rank"))
           & (F.coalesce(F.col("doc").cast("string"), F.lit("")) <= F.col("_s_cut_key"))), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + chosen, F.lit(max_copies))).otherwise(0)
    return decided.select(F.col("_doc").alias(doc_id), F.col("_size").alias("size"),
                          F.col("_s_source_size").alias("source_size"), F.col("_s_target").alias("target"),
                          copies.cast("int").alias("copies"),
                          *[F.col(f"_k{i}").alias(f"kept_{c}") for i, c in enumerate(others)])


def _ranked(rows: DataFrame, seed: str, max_copies: int) -> DataFrame:
    """Adds ``whole`` copies and ``rank`` in [0, 1]: q / (1 + q), q = odds(u) / odds(p)."""
    copies = F.least(F.lit(float(max_copies)), F.col("rate") * F.col("level"))
    u = uniform(F.col("doc"), seed)
    staged = (rows.withColumns({"_copies": copies, "_u": u})
              .withColumn("whole", F.floor("_copies").cast("int")))
    p, u = F.col("_copies") - F.col("whole"), F.col("_u")
    # u (1 - p) / (u (1 - p) + (1 - u) p): the same order as the quotient of odds.
    above = u * (F.lit(1.0) - p)
    return (staged.withColumn("rank", above / (above + (F.lit(1.0) - u) * p))
            .drop("_copies", "_u"))


def _reached(binned: DataFrame) -> DataFrame:
    """``source, bin, before``: the bin in which a source's need is reached.

    ``binned``: rows with ``source, bin, size, need, before`` (words taken
    before the first bin).  A source has at most ``bins`` sums.
    """
    sums = binned.groupBy("source", "bin").agg(
        F.sum("size").alias("words"), F.first("need").alias("need"), F.first("before").alias("before"))
    upto = (Window.partitionBy("source").orderBy("bin")
            .rowsBetween(Window.unboundedPreceding, -1))
    run = sums.select("source", "bin", "need",
                      (F.col("before") + F.coalesce(F.sum("words").over(upto), F.lit(0))).alias("before"))
    return (run.where(F.col("before") < F.col("need")).groupBy("source")
            .agg(F.max(F.struct("bin", "before")).alias("s")).select("source", "s.*"))


def _cuts(ranked: DataFrame, bins: int) -> DataFrame:
    """``source, cut_rank, cut_key``: the last document of each source that gets a further copy.

    Two rounds of bins, the second inside the bin found by the first, leave
    about 1 / bins^2 of a source to be put in order.
    """
    certain = ranked.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("size") * F.col("whole"))).alias("need"))
    rows = (ranked.alias("d").join(certain.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
            .select("c.source", "d.doc", "d.size", "d.rank", "c.need", F.lit(0).cast("bigint").alias("before")))

    def bin_of(n: int) -> Column:
        return F.least(F.floor(F.col("rank") * n), F.lit(n - 1)).cast("bigint")

    last = None
    for n in (bins, bins * bins):
        if last is not None:
            found = last.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.col("before").alias("f"))
            rows = (rows.join(found, F.col("source").eqNullSafe(F.col("s")) & (bin_of(bins) == F.col("b")))
                    .select("source", "doc", "size", "rank", "need", F.col("f").alias("before")))
        last = materialise(_reached(rows.withColumn("bin", bin_of(n))))
    inside = (rows.withColumn("bin", bin_of(bins * bins)).alias("d")
              .join(last.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source"))
                    & (F.col("d.bin") == F.col("c.bin")))
              .select("c.source", "d.rank", F.coalesce(F.col("d.doc").cast("string"), F.lit("")).alias("key"),
                      "d.size", "d.need", "c.before"))
    # Rows of one id stand or fall together.
    units = inside.groupBy("source", "rank", "key", "need", "before").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("rank", "key")
    placed = units.withColumn("after", F.col("before") + F.sum("size").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Taken while that brings the source nearer to its target.
    near = placed.where(F.col("after") - F.col("need") <= F.col("need") - (F.col("after") - F.col("size")))
    best = near.groupBy("source").agg(F.max(F.struct("rank", "key")).alias("s"))
    # A source whose cut bin takes nothing still takes all bins before it.
    return last.alias("l").join(best.alias("b"), F.col("l.source").eqNullSafe(F.col("b.source")), "left").select(
        "l.source", F.coalesce("b.s.rank", F.col("l.bin") / F.lit(float(bins * bins))).alias("cut_rank"),
        F.coalesce("b.s.key", F.lit("")).alias("cut_key"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: every document as often as the plan has copies of it, all columns kept."""
    names = docs.columns
    plan = mixture_plan(docs, keep=names, **options)
    doc_id = options.get("doc_id", "doc_id")
    cols = [F.col(doc_id) if c == doc_id else F.col(f"`kept_{c}`").alias(c) for c in names]
    copy = free_name(docs, "_copy")
    repeated = plan.where("copies > 0").select(
        *cols, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copy))
    return repeated.select(*quoted(names))
