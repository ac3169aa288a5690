"""Reports: digest, identifiers, signature, public view, compliance flags."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from glyphgate.functions import columns, fixed

REPORT_SCHEMA = (
    "report_id string, uuid string, timestamp_utc string, sha256 string, report_hash string, verdict string,"
    " engine_version string,"
    " integrity struct<injection_detected:boolean,signatures_matched:array<string>,confidence:double>,"
    " privacy struct<pii_detected:boolean,entities:array<struct<type:string,value:string,start:int,end:int>>>,"
    " audit_record boolean"
)


def verdict(hits: Column, entities: Column) -> Column:
    blocked, anonymized, cleared = fixed.VERDICTS
    return F.when(F.size(hits) > 0, blocked).when(F.size(entities) > 0, anonymized).otherwise(cleared)


def digest(verdict_: Column, hits: Column, entities: Column) -> Column:
    """SHA-256 of the compact JSON of verdict, hits and entities; the text itself is not part of it."""
    content = F.struct(verdict_.alias("verdict"), hits.alias("signaturesMatched"), entities.alias("entities"))
    return F.sha2(F.to_json(content), 256)


def with_ids(df: DataFrame, id_col: str, text_col: str | None = None, at: Column | None = None) -> DataFrame:
    """Add ``report_id``, ``uuid`` and ``timestamp_utc``.

    With ``text_col`` the ids derive from id and text and so repeat between runs
    (and between retries of a task); without it they are random.
    """
    moment = columns.iso_millis(at if at is not None else F.current_timestamp())
    if text_col is None:
        keyed = df.withColumn("__seed", F.sha2(F.uuid(), 256))
    else:
        seed = F.concat(F.col(id_col).cast("string"), F.lit("|"), F.col(text_col))
        keyed = df.withColumn("__seed", F.sha2(seed, 256))
    s = F.col("__seed")
    uuid = F.concat_ws("-", F.substring(s, 17, 8), F.substring(s, 25, 4), F.concat(F.lit("4"), F.substring(s, 30, 3)),
                       F.concat(F.lit("8"), F.substring(s, 34, 3)), F.substring(s, 37, 12))
    return (keyed.withColumn("report_id", F.concat(F.lit(fixed.REPORT_ID_PREFIX), F.upper(F.left(s, F.lit(16)))))
            .withColumn("uuid", uuid).withColumn("timestamp_utc", moment).drop("__seed"))


def _payload() -> Column:
    return F.concat_ws(".", "report_id", "sha256", "timestamp_utc")


def sign(df: DataFrame, secret: str | bytes | None, out_col: str = "report_hash") -> DataFrame:
    """Add the HMAC-SHA256 of ``report_id.sha256.timestamp_utc``; null without a secret.

    The secret travels in a broadcast variable and never becomes part of the plan.
    """
    if not secret:
        return df.withColumn(out_col, F.lit(None).cast("string"))
    key = df.sparkSession.sparkContext.broadcast(secret.encode() if isinstance(secret, str) else bytes(secret))

    @F.pandas_udf("string")
    def signed(payload: pd.Series) -> pd.Series:
        start = hmac.new(key.value, digestmod=hashlib.sha256)

        def one(text):
            mac = start.copy()
            mac.update(text.encode())
            return mac.hexdigest()

        return payload.map(one, na_action="ignore")

    # called nondeterministic so that filters on the result are not rewritten into second calls
    return df.withColumn(out_col, signed.asNondeterministic()(_payload()))


def verify(df: DataFrame, secret: str | bytes, hash_col: str = "report_hash") -> DataFrame:
    """Add ``valid``: whether the stored hash belongs to the stored report."""
    checked = sign(df, secret, "__expected")
    return checked.withColumn("valid", F.coalesce(F.col("__expected") == F.col(hash_col), F.lit(False))).drop("__expected")


def as_report(scanned: DataFrame, id_col: str) -> DataFrame:
    """Pack flat scan columns into ``(id, verdict, report, anonymized_input)``."""
    report_hash = F.col("report_hash") if "report_hash" in scanned.columns else F.lit(None).cast("string")
    report = F.struct(
        "report_id", "uuid", "timestamp_utc", "sha256", report_hash.alias("report_hash"), "verdict",
        F.lit(fixed.ENGINE_VERSION).alias("engine_version"),
        F.struct((F.size("signatures") > 0).alias("injection_detected"),
                 F.col("signatures").alias("signatures_matched"), "confidence").alias("integrity"),
        F.struct((F.size("entities") > 0).alias("pii_detected"), "entities").alias("privacy"),
        F.lit(True).alias("audit_record"))
    return scanned.select(id_col, "verdict", report.alias("report"), "anonymized_input")


# --- public view -----------------------------------------------------------------

def signature_label(signature: Column) -> Column:
    base = F.regexp_replace(signature, rf"_({'|'.join(fixed.LANGUAGE_SUFFIXES)})$", "")
    return F.coalesce(columns.lookup(fixed.SIGNATURE_LABELS, signature), columns.lookup(fixed.SIGNATURE_LABELS, base),
                      F.lit(fixed.UNKNOWN_SIGNATURE_LABEL))


def data_label(type_: Column) -> Column:
    return F.coalesce(columns.lookup(fixed.PERSONAL_DATA_LABELS, type_), F.lit(fixed.UNKNOWN_PERSONAL_DATA_LABEL))


def public_view(scanned: DataFrame, id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Report without internal ids: categories instead of signatures, labels instead of types."""
    staged = scanned.select(
        id_col, *keep, "verdict", "confidence",
        F.transform("signatures", signature_label).alias("categories_matched"),
        F.transform("entities", lambda e: F.struct(
            data_label(e["type"]).alias("category"), F.lit(fixed.ENTITY_ACTION).alias("action"))).alias("pii_entities"))
    fallback = F.when(F.col("verdict") == "CLEARED", fixed.NO_THREAT_LABEL).otherwise(fixed.UNKNOWN_SIGNATURE_LABEL)
    return staged.select(
        id_col, *keep, "verdict",
        F.coalesce(F.get("categories_matched", 0), F.get("pii_entities", 0)["category"], fallback)
        .alias("primary_category"),
        "categories_matched", (F.size("pii_entities") > 0).alias("pii_detected"), "pii_entities", "confidence")


def entity_records(entities: Column) -> Column:
    """Entities in the documented public shape: type, action, position pair."""
    return F.transform(entities, lambda e: F.struct(
        e["type"].alias("type"), F.lit(fixed.ENTITY_ACTION).alias("action"),
        F.array(e["start"], e["end"]).alias("position")))


def compliance(entities: Column) -> Column:
    """Compliance flags of one report."""
    return F.struct(*[F.lit(True).alias(flag) for flag in fixed.COMPLIANCE_FLAGS],
                    (F.size(entities) > 0).alias("personal_data"))
