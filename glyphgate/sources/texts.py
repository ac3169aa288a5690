"""Text and table sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphgate.operators.billing import EVENT_SCHEMA
from glyphgate.operators.joins import estimated_bytes

FORMATS = ("parquet", "json", "csv", "orc", "text")


def read_texts(spark: SparkSession, path: str, id_col: str | None, text_col: str, format: str = "parquet",
               keep: Sequence[str] = (), stream: bool = False, schema: str | None = None, by_place: bool = False, **options) -> DataFrame:
    """Any table with texts as scan input ``(id, ..., text)``; only the named columns are read.

    Files of plain text have no id: lines then get their hash as id, so that equal lines
    and repeated runs agree.  With ``by_place`` the id is made of the file, the split and the place in it: equal
    lines are told apart, and ids repeat as long as files and split sizes do (not for streams).
    """
    if by_place and stream:
        raise ValueError("lines of a stream have no lasting place")
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {format!r}")
    reader = (spark.readStream if stream else spark.read).format(format).options(**options)
    if schema:
        reader = reader.schema(schema)
    df = reader.load(path)
    if format == "text":
        df = df.withColumnRenamed("value", text_col)
    if id_col is None:
        place = F.concat_ws("|", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        return df.select(F.sha2(place if by_place else F.col(text_col), 256).alias("id"), *keep, text_col)
    return df.select(id_col, *keep, text_col)


def read_labelled(df: DataFrame, text: str = "text", label: str = "label", split: str | None = None,
                  check: bool = True) -> DataFrame:
    """Labelled samples with a string text and label 0 or 1; fails when none is left."""
    usable = df.where(F.col(text).isNotNull() & F.col(label).isin(0, 1))
    out = usable.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"),
                        *([F.col(split).alias("split")] if split else []))
    if check and out.isEmpty():
        raise ValueError("the labelled set holds no usable row")
    return out


def cap_rows(df: DataFrame, n: int = 1000, order: Sequence[str] = ("split", "id")) -> DataFrame:
    """The first ``n`` rows in a fixed order; ``split`` sorts train before test."""
    rank = [F.expr("CASE split WHEN 'train' THEN 0 WHEN 'test' THEN 1 ELSE 2 END") if c == "split" else F.col(c)
            for c in order]
    return df.orderBy(*rank).limit(n)


def read_billing_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Billing events from JSON lines, with a fixed schema."""
    return (spark.readStream if stream else spark.read).schema(EVENT_SCHEMA).json(path)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Spread a small table of long texts over all cores.

    A table of less than one input split per core, say a single file with one row group,
    would be scanned by a few tasks.  Its rows are then hashed by key, at most a split per
    core of shuffled data.  Larger tables and streams keep their input splits, unshuffled.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if estimated_bytes(df) >= cores * split:
        return df
    return df.repartition(4 * cores, *keys)


DIMENSIONS = {
    "free_api_keys": ("key_hash", "email", "requests_this_month", "month_bucket"),
    "api_keys": ("key_hash", "user_id", "tier", "requests_this_month", "revoked_at"),
    "subscriptions": ("user_id", "status", "plan"),
}


def read_dim(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A key or subscription table, pruned to the columns the joins use."""
    return spark.read.parquet(f"{base}/{name}").select(*DIMENSIONS[name])
