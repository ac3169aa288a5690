"""Stable substitutes for personal data: tokens and pseudonyms."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphgate.functions import columns
from glyphgate.operators import joins, personal_data, running

Keyed = Callable[[Column], Column]


def secret_hash(spark: SparkSession, secret: str | bytes) -> Keyed:
    """HMAC-SHA256 under a secret that stays out of the plan."""
    key = spark.sparkContext.broadcast(secret.encode() if isinstance(secret, str) else bytes(secret))

    @F.pandas_udf("string")
    def hashed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: hmac.new(key.value, v.encode(), hashlib.sha256).hexdigest(), na_action="ignore")

    # called nondeterministic so that filters on the result are not rewritten into second calls
    return hashed.asNondeterministic()


def prefix_hash(key: str) -> Keyed:
    """SHA-256 after a public prefix; stable, but not secret."""
    return lambda value: F.sha2(F.concat(F.lit(key + ":"), value), 256)


def tokens(df: DataFrame, id_col: str, text_col: str, types: Sequence[personal_data.DataType] | None = None,
           keyed: Keyed | None = None) -> DataFrame:
    """Entity table with a ``token`` per value, ``TYPE_`` and twelve hex digits of its keyed hash."""
    if keyed is None:
        raise ValueError("tokens need a keyed hash: secret_hash(spark, secret) or prefix_hash(key)")
    rows = personal_data.personal_data(df, id_col, text_col, types, masked=False)
    token = F.concat("type", F.lit("_"), F.left(keyed(F.concat("type", F.lit(":"), "value")), F.lit(12)))
    return rows.withColumn("token", token).withColumn("value", columns.mask(F.col("value")))


def token_table(df: DataFrame, id_col: str, text_col: str,
                types: Sequence[personal_data.DataType] | None = None, keyed: Keyed | None = None) -> DataFrame:
    """Distinct ``(token, masked)``; holds no raw value."""
    return tokens(df, id_col, text_col, types, keyed).select("token", F.col("value").alias("masked")).distinct()


def pseudonyms(df: DataFrame, id_col: str, text_col: str,
               types: Sequence[personal_data.DataType] | None = None, folder: str | None = None) -> DataFrame:
    """Entity table with a ``pseudonym`` per value: ``TYPE_n``, the same for equal values of the whole table.

    Values are told apart by their SHA-256.  Entities are read several times (to number the
    values, and to name them), so with ``folder`` they are stored there once, without raw
    values, and the texts are scanned once.  A value that fills a large share of all entities
    is spread by the lookup join.
    """
    found = personal_data.personal_data(df, id_col, text_col, types, masked=False)
    rows = (found.withColumn("__hash", F.sha2("value", 256))
            .withColumn("value", columns.mask(F.col("value"))))
    if folder:
        rows.write.mode("errorifexists").parquet(folder)
        rows = df.sparkSession.read.parquet(folder)
    rows = rows.withColumn("__key", F.concat_ws(":", "type", "__hash"))
    numbers = running.dense_numbers(rows, "type", "__hash", "__n").select(
        F.concat_ws(":", "type", "__hash").alias("__key"), "__n")
    numbered = joins.lookup_join(rows, numbers, "__key")
    return numbered.select(
        id_col, "ordinal", "type", "value", "start", "end",
        F.concat_ws("_", "type", F.col("__n").cast("string")).alias("pseudonym"))


def substitute(df: DataFrame, id_col: str, text_col: str, entities: DataFrame, shown: str) -> DataFrame:
    """Texts with each entity replaced by its ``shown`` column (a token or pseudonym).

    Entities are gathered per text, which is bounded by the text itself; offsets are code points
    (``personal_data(..., offsets="codepoint")``).
    """
    listed = entities.groupBy(id_col).agg(F.array_sort(F.collect_list(
        F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col(shown).alias("v")))).alias("__found"))
    joined = df.select(id_col, text_col).join(listed, id_col, "left")
    replaced = personal_data.replace_spans(text_col, "__found", "x.v")
    return joined.select(id_col, F.coalesce(replaced, F.col(text_col)).alias(text_col))


def _shown(found: str, shown: str, types: Sequence[personal_data.DataType]) -> Column:
    """Spans whose value is replaced by ``shown``, SQL over the span ``x``, its number ``i`` and its type ``kind``."""
    kind = personal_data._type_of("x.p", types)
    return F.expr(f"transform({found}, (x, i) -> named_struct('s', x.s, 'e', x.e, 'p', x.p,"
                  f" 'v', transform(array({kind}), kind -> {shown})[0]))")


def tokenize_texts(df: DataFrame, text_col: str = "text", types: Sequence[personal_data.DataType] | None = None,
                   keyed: Keyed | None = None, out_col: str = "tokenized") -> DataFrame:
    """Add the text with each value replaced by its token (as in :func:`tokens`); null where the text holds none.

    Works row by row, nothing is shuffled.  ``keyed`` takes a list of values and gives the list of their hashes:
    :func:`secret_hashes` or :func:`prefix_hashes`.
    """
    if keyed is None:
        raise ValueError("tokens need a keyed hash: secret_hashes(spark, secret) or prefix_hashes(key)")
    types = types or personal_data.data_types()
    keep = [F.col(f"`{c}`") for c in df.columns]
    found = personal_data.find(df, text_col, types)
    kind = personal_data._type_of("x.p", types)
    hashed = found.withColumn("__hashes", keyed(F.expr(f"transform(__found, x -> concat({kind}, ':', x.v))")))
    spans = hashed.withColumn("__shown", _shown("__found", "concat(kind, '_', left(__hashes[i], 12))", types))
    return spans.select(*keep, personal_data.replace_spans(text_col, "__shown", "x.v").alias(out_col))


def secret_hashes(spark: SparkSession, secret: str | bytes) -> Keyed:
    """HMAC-SHA256 of each value of a list, under a secret that stays out of the plan."""
    key = spark.sparkContext.broadcast(secret.encode() if isinstance(secret, str) else bytes(secret))

    @F.pandas_udf("array<string>")
    def hashed(lists: pd.Series) -> pd.Series:
        return lists.map(lambda vs: [hmac.new(key.value, v.encode(), hashlib.sha256).hexdigest() for v in vs], na_action="ignore")

    return hashed.asNondeterministic()


def prefix_hashes(key: str) -> Keyed:
    """SHA-256 after a public prefix of each value of a list; stable, but not secret."""
    return lambda values: F.transform(values, lambda v: F.sha2(F.concat(F.lit(key + ":"), v), 256))


def pseudonymize_texts(df: DataFrame, text_col: str = "text", types: Sequence[personal_data.DataType] | None = None,
                       folder: str | None = None, out_col: str = "pseudonymized") -> DataFrame:
    """Add the text with each value replaced by its pseudonym (as in :func:`pseudonyms`); null where the text holds none.

    Values are numbered over the whole table without the texts: spans, types and hashes of each distinct text are
    kept under the text's digest (with ``folder`` stored there, so that texts are scanned once), numbered by hash
    bucket, and gathered per digest.  The numbers come back by a lookup join on the digest: where they fit, they
    are broadcast and texts stay where they are; beyond that, texts are shuffled once, frequent ones spread.
    """
    types = types or personal_data.data_types()
    keep = [F.col(f"`{c}`") for c in df.columns]
    tagged = df.withColumn("__digest", F.sha2(F.col(f"`{text_col}`"), 256))
    found = personal_data.find(tagged.select("__digest", F.col(f"`{text_col}`").alias("__text")), "__text", types)
    narrow = (found.where(F.size("__found") > 0)
              .select("__digest", _shown("__found", "concat(kind, ':', sha2(x.v, 256))", types).alias("__spans"))
              .groupBy("__digest").agg(F.any_value("__spans").alias("__spans")))
    if folder:
        narrow.write.mode("errorifexists").parquet(folder)
        narrow = df.sparkSession.read.parquet(folder)
    rows = narrow.select("__digest", F.explode("__spans").alias("x")).select(
        "__digest", "x.s", "x.e", "x.p", F.col("x.v").alias("__key"), F.split_part("x.v", F.lit(":"), F.lit(1)).alias("type"),
        F.split_part("x.v", F.lit(":"), F.lit(2)).alias("__hash"))
    numbers = running.dense_numbers(rows, "type", "__hash", "__n").select(
        F.concat_ws(":", "type", "__hash").alias("__key"), "__n")
    named = joins.lookup_join(rows, numbers, "__key")
    listed = named.groupBy("__digest").agg(F.array_sort(F.collect_list(F.struct(
        "s", "e", "p", F.concat_ws("_", "type", F.col("__n").cast("string")).alias("v")))).alias("__shown"))
    joined = joins.lookup_join(tagged, listed, "__digest")
    return joined.select(*keep, personal_data.replace_spans(text_col, "__shown", "x.v").alias(out_col))
