"""Evaluation of a labelled set: confusion counts, metrics, latency percentiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphgate.functions import columns, fixed
from glyphgate.operators.integrity import SIGNATURES
from glyphgate.operators.joins import null_safe_join

BINS = 65_536


def join_labels(verdicts: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    return verdicts.join(labels, id_col)


def confusion(df: DataFrame, label: str = "label", verdict: str = "verdict",
              by: Sequence[str] = ()) -> DataFrame:
    """Counts ``tp, fp, tn, fn``; blocked is the positive prediction."""
    hit = F.coalesce(F.col(verdict) == fixed.VERDICTS[0], F.lit(False))
    attack = F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(hit & attack).alias("tp"), F.count_if(hit & ~attack).alias("fp"),
        F.count_if(~hit & ~attack).alias("tn"), F.count_if(~hit & attack).alias("fn"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy (4 decimals; 0 where undefined) beside the counts."""
    c = F.col
    staged = (counts
              .withColumn("__p", _ratio(c("tp"), c("tp") + c("fp")))
              .withColumn("__r", _ratio(c("tp"), c("tp") + c("fn"))))
    samples = c("tp") + c("fp") + c("tn") + c("fn")
    values = {
        "samples": samples, "positives": c("tp") + c("fn"), "negatives": c("fp") + c("tn"),
        "precision": F.round("__p", 4), "recall": F.round("__r", 4),
        "f1": F.round(_ratio(2 * c("__p") * c("__r"), c("__p") + c("__r")), 4),
        "accuracy": F.round(_ratio(c("tp") + c("tn"), samples), 4),
    }
    return staged.withColumns(values).drop("__p", "__r")


def with_header(measured: DataFrame, source: str, engine_version: str, signature_count: int = len(SIGNATURES),
                generated_at: Column | None = None) -> DataFrame:
    """Metrics behind what a published result states: when, by which engine, on what; only real data sets are fit for publication."""
    at = columns.iso_millis(generated_at if generated_at is not None else F.current_timestamp())
    return measured.select(
        at.alias("generated_at"), F.lit(engine_version).alias("engine_version"), F.lit(signature_count).alias("signature_count"),
        F.lit(source).alias("source"), F.lit(source != "synthetic").alias("marketing_grade"), "*")


def mean_latency(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg(col), 3).alias("mean"))


def percentiles(df: DataFrame, col: str, ps: Sequence[int] = (50, 95, 99), by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles by the rule: element ``min(n - 1, floor(p * n / 100))`` of the sorted values.

    Values are counted first (combined before the shuffle), binned by their place between
    minimum and maximum on a logarithmic scale and ranked by bin totals; only the bin that holds a
    percentile is sorted, by one task.  Values that crowd into one bin, for example times of one week with an
    outlier at 0, are all sorted there; :func:`sketches` has no such case.  One row per group, columns ``p50, p95, ...``.
    """
    keys = list(by)
    groups = keys or ["__all"]
    source = df if keys else df.withColumn("__all", F.lit(0))
    values = (source.where(F.col(col).isNotNull()).groupBy(*groups, F.col(col).cast("double").alias("__v"))
              .agg(F.count("*").alias("__k")))
    bounds = values.groupBy(*groups).agg(
        F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__k").alias("__n"))
    def scaled(c):
        return F.signum(c) * F.log1p(F.abs(c))

    share = (scaled("__v") - scaled("__lo")) / (scaled("__hi") - scaled("__lo"))
    bin_ = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(0)
    binned = null_safe_join(values, bounds, groups).withColumn("__bin", bin_.cast("int"))
    totals = binned.groupBy(*groups, "__bin").agg(F.sum("__k").alias("__b"), F.first("__n").alias("__n"))
    upto = Window.partitionBy(*groups).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("__before", F.coalesce(F.sum("__b").over(upto), F.lit(0)))
    target = F.array(*[F.struct(F.lit(p).alias("p"), F.least(
        F.col("__n") - 1, F.floor(F.lit(p) * F.col("__n") / 100)).alias("at")) for p in ps])
    wanted = (placed.select(*groups, "__bin", "__b", "__before", F.inline(target))
              .where("at >= __before AND at < __before + __b"))
    inside = Window.partitionBy(*groups, "__bin", "p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (null_safe_join(binned.select(*groups, "__bin", "__v", "__k"), wanted, [*groups, "__bin"])
            .withColumn("__upto", F.col("__before") + F.sum("__k").over(inside))
            .where("at < __upto AND at >= __upto - __k"))
    out = hits.groupBy(*groups).agg(
        *[F.round(F.max(F.when(F.col("p") == p, F.col("__v"))), 3).alias(f"p{p}") for p in ps])
    return out if keys else out.drop("__all")


def approx_percentiles(df: DataFrame, col: str, ps: Sequence[int] = (50, 95, 99), by: Sequence[str] = (),
                       accuracy: int = 10_000) -> DataFrame:
    """One-pass approximate percentiles."""
    return df.groupBy(*by).agg(
        *[F.percentile_approx(F.col(col), p / 100, accuracy).alias(f"p{p}") for p in ps])


SKETCH_SIZE = 2048     # one rank error in a hundred sketches exceeds about 2.3 / SKETCH_SIZE ** 0.9, 0.25 %


def sketches(df: DataFrame, col: str, by: Sequence[str], k: int = SKETCH_SIZE) -> DataFrame:
    """One mergeable quantile sketch (``sketch``, ``n``) per group, to be stored, say per day, and merged by any later query."""
    value = F.col(col).cast("double")
    return df.where(value.isNotNull() & ~F.isnan(value)).groupBy(*by).agg(
        F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"), F.count("*").alias("n"))


def sketch_percentiles(stored: DataFrame, ps: Sequence[int] = (50, 95, 99), by: Sequence[str] = (), k: int = SKETCH_SIZE) -> DataFrame:
    """Percentiles ``p50, p95, ...`` and ``n`` of merged sketches, in any order of merging.

    A value's share of smaller rows is off by at most about 0.25 % (for the default size, in 99 of 100 sketches).
    """
    merged = stored.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias(f"p{p}") for p in ps])


def long_metrics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One-row result as ``(metric, value)`` rows."""
    pairs = ", ".join(f"'{n}', cast({n} AS double)" for n in names)
    return df.selectExpr(f"stack({len(names)}, {pairs}) AS (metric, value)")


def labelled_templates(ids: DataFrame, id_col: str, label_col: str,
                       known: Sequence[str] = fixed.KNOWN_ATTACKS,
                       keyword_free: Sequence[str] = fixed.KEYWORD_FREE_ATTACKS,
                       benign: Sequence[str] = fixed.BENIGN_PROMPTS) -> DataFrame:
    """Labelled texts made from template pools by row number.

    Row ``i`` takes template ``i % size`` of its pool; of the positives every fifth comes
    from the keyword-free pool.  The number is appended, so all texts differ.
    """
    i = F.col(id_col)

    def pick(pool: Sequence[str]) -> Column:
        return F.element_at(F.array(*[F.lit(t) for t in pool]), (i % len(pool) + 1).cast("int"))

    def noted(text: Column, note: str) -> Column:
        return F.concat(text, F.lit(f" ({note} "), i.cast("string"), F.lit(")"))

    attack = F.when(i % 5 == 0, pick(keyword_free)).otherwise(pick(known))
    text = F.when(F.col(label_col) == 1, noted(attack, "case")).otherwise(noted(pick(benign), "note"))
    return ids.withColumn("text", text)


def synthetic_set(spark, positives: int = 500, negatives: int = 500) -> DataFrame:
    """The offline evaluation set: positives and negatives, each numbered from 0."""
    ids = reduce(DataFrame.unionByName, [
        spark.range(n).select("id", F.lit(label).alias("label")) for label, n in ((1, positives), (0, negatives))])
    return labelled_templates(ids, "id", "label")


def verdict_summary(audit: DataFrame, by: Sequence[str] = ("dt", "tier")) -> DataFrame:
    """Reports per group and verdict, with mean latency."""
    return audit.groupBy(*by, "verdict").agg(
        F.count("*").alias("reports"), F.round(F.avg("latency_ms"), 3).alias("mean_latency_ms"))
