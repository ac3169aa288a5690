"""Request admission: parse, authenticate, meter, classify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphgate.functions import columns, fixed
from glyphgate.operators import joins, running, usage

OUTCOME_STATUS = {
    "OK": 200, "INVALID_BODY": 400, "INVALID_INPUT": 400, "MISSING_API_KEY": 401, "INVALID_API_KEY": 401,
    "REVOKED_API_KEY": 401, "SUBSCRIPTION_INACTIVE": 402, "RATE_LIMIT_EXCEEDED": 429,
}


def parse_requests(df: DataFrame, body: str = "body", max_chars: int = fixed.API_BODY_LIMIT) -> DataFrame:
    """Add ``input``, ``modules``, ``options`` and ``body_ok``; malformed or oversized bodies are flagged, not dropped.

    An input that is not a JSON string, a module list that is not an array and options that
    are not an object read as null.  A missing or empty body is an empty object.
    """
    keep = [columns.name(c) for c in df.columns]
    text = columns.name(body)
    parsed = df.selectExpr("*", f"CASE WHEN {columns.utf16_length_sql(text)} > {max_chars} THEN NULL"
                            f" ELSE try_parse_json(if(coalesce({text}, '') = '', '{{}}', {text})) END AS __json")

    def field(path: str, kind: str, type_: str) -> str:
        part = f"try_variant_get(__json, '$.{path}', 'variant')"
        return (f"CASE WHEN schema_of_variant({part}) LIKE '{kind}%'"
                f" THEN try_variant_get(__json, '$.{path}', '{type_}') END AS {path}")

    return parsed.selectExpr(
        *keep, field("input", "STRING", "string"), field("modules", "ARRAY", "array<string>"),
        field("options", "OBJECT", "map<string,string>"), "__json IS NOT NULL AS body_ok")


def flag_oversize(df: DataFrame, col: str, max_bytes: int = fixed.DEMO_INPUT_LIMIT) -> DataFrame:
    """Add ``raw_too_long`` (UTF-16 units of the raw body) and ``too_large`` (UTF-8 bytes)."""
    return df.withColumns({
        "raw_too_long": F.expr(columns.utf16_length_sql(columns.name(col))) > 2 * max_bytes,
        "too_large": F.octet_length(col) > max_bytes,
    })


def effective_modules(modules: Column) -> Column:
    """The requested modules; a missing or empty list means all."""
    return F.when(F.size(modules) > 0, modules).otherwise(F.array(*[F.lit(m) for m in fixed.MODULES]))


def authenticate(requests: DataFrame, free: DataFrame, paid: DataFrame, subs: DataFrame,
                 header: str = "auth_header") -> DataFrame:
    """Add the key's identity: ``kind`` (none, revoked, inactive, free, paid, missing), tier, plan and limit."""
    keyed = (requests.withColumn("__token", columns.bearer(F.col(header)))
             .withColumn("key_hash", columns.key_hash(F.col("__token"))).drop("__token"))
    joined = usage.join_subscriptions(usage.join_paid(usage.join_free(keyed, free), paid), subs)
    active = F.coalesce(F.col("status").isin(*fixed.ACTIVE_STATUSES), F.lit(False))
    kind = (F.when(F.col("key_hash").isNull(), "missing")
            .when(F.col("is_free"), "free")
            .when(~F.col("is_paid"), "none")
            .when(F.col("revoked_at").isNotNull(), "revoked")
            .when(~active, "inactive")
            .otherwise("paid"))
    plan = F.when(F.col("is_free"), "free").otherwise(usage.plan_name(F.col("plan"), F.col("tier")))
    named = joined.withColumn("kind", kind).withColumn("plan", plan)
    tier = F.when(F.col("is_free"), "FREE").otherwise(
        F.upper(F.coalesce(F.nullif("tier", F.lit("")), F.nullif("plan", F.lit("")), F.lit("GROWTH"))))
    return (named.withColumn("tier", tier).withColumn("limit_n", usage.plan_limit(F.col("plan"), F.col("is_free")))
            .drop("is_free", "is_paid", "free_email", "revoked_at"))


def classify_requests(requests: DataFrame, free: DataFrame, paid: DataFrame, subs: DataFrame,
                      ts: str = "ts", tie: str = "request_id", limit: Column | None = None,
                      stored: DataFrame | None = None) -> DataFrame:
    """Add ``outcome`` and ``http_status`` of each request, with the quota applied in ``(ts, tie)`` order.

    Checks run in a fixed order: key, revocation, subscription, quota, body, input.  Only
    requests that pass all of them count against the quota.  ``limit`` overrides the plan limit.
    ``stored`` (``key_hash``, ``requests_this_month``, ``month_bucket``) says what keys had used before
    the log begins; a counter of another month counts as zero.
    """
    parsed = parse_requests(requests)
    known = authenticate(parsed, free, paid, subs)
    if limit is not None:
        known = known.withColumn("limit_n", limit)
    accepted_key = F.col("kind").isin("free", "paid")
    checked = known.withColumn("__valid", accepted_key & F.col("body_ok") & columns.is_valid_input(F.col("input")))
    # requests without an accepted key have no quota; a hash of their id spreads them
    spread = F.concat(F.lit("!"), F.pmod(F.xxhash64(tie), F.lit(4096)).cast("string"))
    metered = running.count_before(
        checked.withColumn("__meter", F.when(accepted_key, F.col("key_hash")).otherwise(spread))
        .withColumn("month", columns.month_key(F.col(ts))),
        ["__meter", "month"], ts, tie, F.col("__valid"), "__before")
    if stored is not None:
        used = stored.select("key_hash", F.col("requests_this_month").alias("__stored"), F.col("month_bucket").alias("__stored_month"))
        metered = joins.lookup_join(metered, used, "key_hash")
        earlier = F.when(F.col("month") == F.col("__stored_month"), F.col("__stored"))
        metered = metered.withColumn("__before", F.col("__before") + F.coalesce(earlier, F.lit(0))).drop("__stored", "__stored_month")
    outcome = (F.when(F.col("kind") == "missing", "MISSING_API_KEY")
               .when(F.col("kind") == "none", "INVALID_API_KEY")
               .when(F.col("kind") == "revoked", "REVOKED_API_KEY")
               .when(F.col("kind") == "inactive", "SUBSCRIPTION_INACTIVE")
               .when(F.col("__before") >= F.col("limit_n"), "RATE_LIMIT_EXCEEDED")
               .when(~F.col("body_ok"), "INVALID_BODY")
               .when(~columns.is_valid_input(F.col("input")), "INVALID_INPUT")
               .otherwise("OK"))
    done = (metered.withColumn("outcome", outcome)
            .withColumn("http_status", columns.lookup(OUTCOME_STATUS, F.col("outcome")))
            .withColumn("used_before", F.least("__before", "limit_n")))
    return done.drop("__before", "__meter", "__valid")
