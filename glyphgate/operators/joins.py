"""Lookup joins from a large fact table to a dimension keyed uniquely."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1024
SALTS = 32


def estimated_bytes(df: DataFrame) -> int:
    """Size of a frame as the optimizer estimates it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup_join(facts: DataFrame, dim: DataFrame, on: str, how: str = "left",
                max_broadcast: int = BROADCAST_BYTES, hot_keys: int = HOT_KEYS, salts: int = SALTS) -> DataFrame:
    """Join facts to a dimension on one key, whatever the size of the dimension and the skew of the key.

    A dimension whose estimated size is at most ``max_broadcast`` is broadcast.  Beyond
    that both sides shuffle, and the ``hot_keys`` most frequent keys (a list of fixed
    length) are spread over ``salts`` partitions: their facts get a salt from the row's
    hash, their dimension row is repeated once per salt.  Null keys are spread as well.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if estimated_bytes(dim) <= max_broadcast:
        return facts.join(F.broadcast(dim), on, how)
    if facts.isStreaming:
        return facts.join(dim, on, how)
    hot = (facts.where(F.col(on).isNotNull()).groupBy(on).count()
           .orderBy(F.desc("count"), on).limit(hot_keys).select(on, F.lit(True).alias("__hot")))
    # maps and variants can't be hashed; the other columns tell rows apart well enough
    hashable = [F.col(f"`{c}`") for c, kind in facts.dtypes if "map<" not in kind and "variant" not in kind]
    row_salt = F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")
    spread = (facts.join(F.broadcast(hot), on, "left")
              .withColumn("__salt", F.when(F.col("__hot") | F.col(on).isNull(), row_salt).otherwise(0)).drop("__hot"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    repeated = (dim.join(F.broadcast(hot), on, "left")
                .withColumn("__salt", F.explode(F.when(F.col("__hot"), every).otherwise(F.array(F.lit(0)))))
                .drop("__hot"))
    return spread.join(repeated, [on, "__salt"], how).drop("__salt")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys meet each other; the key columns come from the left side."""
    renamed = right.withColumnsRenamed({c: f"__right_{c}" for c in on})
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`__right_{c}`")) for c in on]
    return left.join(renamed, same, how).drop(*[f"__right_{c}" for c in on])


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Return ``df``; raise when a key occurs more than once (runs one aggregation)."""
    if not duplicate_keys(df, *keys).isEmpty():
        raise ValueError(f"more than one row for a value of {', '.join(keys)}")
    return df


def repair(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One row per key, and a report of the keys that had more (``rows``, ``dropped``).

    The survivor is the first row in the order of ``order``, then of all other columns, so that it is the same
    however the rows are dealt.  Rows with a null in a key stay, as in a unique index.  Rows are combined before
    the shuffle, so a key with very many rows is no bottleneck.  Columns must be orderable.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    place = F.struct(*[F.col(f"`{c}`") for c in [*order, *[c for c in df.columns if c not in order]]])
    known = F.lit(True)
    for key in keys:
        known = known & F.col(f"`{key}`").isNotNull()
    grouped = df.where(known).groupBy(*keys).agg(F.min_by(whole, place).alias("__row"), F.count("*").alias("rows"))
    kept = grouped.select("__row.*").unionByName(df.where(~known))
    return kept, grouped.where("rows > 1").select(*keys, "rows", (F.col("rows") - 1).alias("dropped"))
