"""Keys, subscriptions, plan limits, metering and quota state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from glyphgate.functions import columns, fixed
from glyphgate.operators import joins, running


# --- filters and projections over key tables -------------------------------------

def active_keys(keys: DataFrame) -> DataFrame:
    return keys.where(F.col("revoked_at").isNull())


def active_subscriptions(subs: DataFrame) -> DataFrame:
    return subs.where(F.col("status").isin(*fixed.ACTIVE_STATUSES))


def owned_by(df: DataFrame, user: object, user_col: str = "user_id") -> DataFrame:
    """Rows of one user (a value or an expression such as ``current_user()``)."""
    return df.where(F.col(user_col) == user)


def key_universe(free: DataFrame, paid: DataFrame) -> DataFrame:
    """All keys with their kind; a hash present in both tables counts as free.

    One grouped pass with the kinds ranked inside the aggregate; no join.
    """
    listed = (free.select("key_hash", F.lit("free").alias("kind"))
              .unionByName(paid.select("key_hash", F.lit("paid").alias("kind"))))
    return listed.groupBy("key_hash").agg(F.min("kind").alias("kind"))


# --- lookups ----------------------------------------------------------------------

def join_free(requests: DataFrame, free: DataFrame) -> DataFrame:
    dim = free.select("key_hash", F.col("email").alias("free_email"), F.lit(True).alias("is_free"))
    return joins.lookup_join(requests, dim, "key_hash").withColumn("is_free", F.coalesce("is_free", F.lit(False)))


def join_paid(requests: DataFrame, paid: DataFrame) -> DataFrame:
    """Paid key of each request; a request that matched a free key takes none."""
    dim = paid.select("key_hash", "user_id", "tier", "revoked_at", F.lit(True).alias("is_paid"))
    joined = joins.lookup_join(requests, dim, "key_hash")
    if "is_free" not in requests.columns:
        return joined.withColumn("is_paid", F.coalesce("is_paid", F.lit(False)))
    own = ~F.col("is_free")
    return joined.withColumns({
        **{c: F.when(own, F.col(c)) for c in ("user_id", "tier", "revoked_at")},
        "is_paid": F.coalesce(own & F.col("is_paid"), F.lit(False)),
    })


def join_subscriptions(keys: DataFrame, subs: DataFrame) -> DataFrame:
    dim = subs.select("user_id", "status", "plan")
    return joins.lookup_join(keys, dim, "user_id")


def plan_name(plan: Column, tier: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(plan, F.lit("")), F.nullif(tier, F.lit("")), F.lit("")))


def plan_limit(plan: Column, is_free: Column | None = None) -> Column:
    """Monthly limit: the free limit for free keys, else by plan name; unknown names get the growth limit."""
    paid = F.coalesce(columns.lookup(fixed.PLAN_LIMITS, plan), F.lit(fixed.PLAN_LIMITS[fixed.UNKNOWN_PLAN]))
    limit = paid if is_free is None else F.when(is_free, fixed.FREE_LIMIT).otherwise(paid)
    return limit.cast("long")


def price_plan(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Plan of a price id; unknown ids get the lowest paid plan."""
    joined = joins.lookup_join(events, prices.select("price_id", F.col("plan").alias("__plan")), "price_id")
    return joined.withColumn("plan", F.coalesce("__plan", F.lit(fixed.UNKNOWN_PRICE_PLAN))).drop("__plan")


# --- metering ---------------------------------------------------------------------

def usage_by(requests: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Requests per key (or user) and calendar month, with the time of the last one."""
    return (requests.groupBy(*keys, columns.month_key(F.col(ts)).alias("month"))
            .agg(F.count("*").alias("request_count"), F.max(ts).alias("last_used_at")))


def current_used(keys: DataFrame, month: str) -> DataFrame:
    """Counter that counts: a stored counter of another month reads as 0."""
    fresh = F.col("month_bucket") == month
    return keys.withColumn("used", F.when(fresh, F.coalesce("requests_this_month", F.lit(0))).otherwise(0))


def monthly_reset(paid: DataFrame, free: DataFrame, month: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both key tables after the roll-over, and one row saying how many rows of each changed."""
    new_paid = paid.withColumn("requests_this_month", F.lit(0))
    new_free = free.withColumns({"requests_this_month": F.lit(0), "month_bucket": F.lit(month)})
    changed_paid = paid.where("requests_this_month > 0").agg(F.count("*").alias("paid_reset"))
    stale = (F.col("requests_this_month") > 0) | (F.col("month_bucket") != month)
    changed_free = free.where(stale).agg(F.count("*").alias("free_reset"))
    one = F.lit(1).alias("__one")
    report = changed_paid.select("paid_reset", one).join(changed_free.select("free_reset", one), "__one").drop("__one")
    return new_paid, new_free, report


def running_usage(requests: DataFrame, key: str, ts: str = "ts", tie: str = "request_id",
                  valid: str = "valid") -> DataFrame:
    """The key's monthly counter as it reads after each request."""
    dated = requests.withColumn("month", columns.month_key(F.col(ts)))
    counted = running.count_before(dated, [key, "month"], ts, tie, F.col(valid), "__before")
    return counted.withColumn("counter", F.col("__before") + F.when(F.col(valid), 1).otherwise(0)).drop("__before")


def admit(requests: DataFrame, key: str, limit: str, ts: str = "ts", tie: str = "request_id",
          valid: str = "valid") -> DataFrame:
    """Quota admission: a request passes while the key's earlier valid requests of the month stay below its limit.

    Requests beyond the quota and invalid requests never count.  Adds ``used_before`` and ``admitted``.
    """
    dated = requests.withColumn("month", columns.month_key(F.col(ts)))
    counted = running.count_before(dated, [key, "month"], ts, tie, F.col(valid), "__before")
    return (counted.withColumn("used_before", F.least("__before", limit))
            .withColumn("admitted", F.col("__before") < F.col(limit)).drop("__before"))


def quota_status(used: Column, limit: Column) -> tuple[Column, Column]:
    """Remaining requests after the current one, and the limit as shown."""
    remaining = F.greatest(F.lit(0).cast("long"), limit - used - 1)
    shown = F.when(limit >= fixed.UNLIMITED_FROM, F.lit("∞")).otherwise(limit.cast("string"))
    return remaining, shown


def quotas(keys: DataFrame, usage: DataFrame, month: str, key: str = "key_hash") -> DataFrame:
    """Quota state of every key (``kind, tier, plan``) in a month: ``tier, plan, limit_n, used, remaining, limit_shown, reset_month``."""
    counts = usage.where(F.col("month") == month).select(key, F.col("request_count").alias("__n"))
    joined = keys.join(counts, key, "left").withColumn("used", F.coalesce("__n", F.lit(0)).cast("long")).drop("__n")
    limited = joined.withColumn("limit_n", plan_limit(F.col("plan"), F.col("kind") == "free"))
    remaining, shown = quota_status(F.col("used"), F.col("limit_n"))
    return limited.select(key, F.upper("tier").alias("tier"), "plan", "limit_n", "used", remaining.alias("remaining"),
                          shown.alias("limit_shown"), F.lit(month).alias("reset_month"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def retained(df: DataFrame, as_of: Column, ts: str = "created_at", days: int = fixed.AUDIT_RETENTION_DAYS) -> DataFrame:
    """Rows younger than the retention period; filters on the partition date too where the table has one."""
    start = as_of - F.make_interval(days=F.lit(days))
    kept = df.where(F.col(ts) >= start)
    return kept.where(F.col("dt") >= F.to_date(start)) if "dt" in df.columns else kept


def recent(df: DataFrame, n: int, ts: str = "created_at", tie: str = "report_id") -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


# --- sign-ups ---------------------------------------------------------------------

def valid_signups(signups: DataFrame) -> DataFrame:
    """Sign-ups with a well-formed e-mail and explicit consent, e-mail normalised."""
    ok = columns.is_email_shape(F.col("email")) & F.coalesce(F.col("consent"), F.lit(False))
    return signups.where(ok).withColumn("email", columns.norm_email(F.col("email")))


def new_signups(signups: DataFrame, free: DataFrame) -> DataFrame:
    """Valid sign-ups whose e-mail holds no key yet."""
    return joins.lookup_join(valid_signups(signups), free.select("email").distinct(), "email", "left_anti")


def register_keys(signups: DataFrame, free: DataFrame, raw_key: Column, ts: str = "ts",
                  tie: str = "signup_id", prefix: int = fixed.KEY_PREFIX_LENGTH) -> DataFrame:
    """New free-key rows: the first sign-up per new e-mail, hashed key, zero counter, month of issue."""
    fresh = new_signups(signups, free).withColumn("__raw", raw_key)
    first = fresh.groupBy("email").agg(F.min_by(F.struct("__raw", ts), F.struct(ts, tie)).alias("s"))
    return first.select(
        "email", columns.key_hash(F.col("s.__raw")).alias("key_hash"),
        columns.key_prefix(F.col("s.__raw"), prefix).alias("key_prefix"),
        F.lit(0).alias("requests_this_month"), columns.month_key(F.col(f"s.{ts}")).alias("month_bucket"),
        F.col(f"s.{ts}").alias("created_at"))


def leads(signups: DataFrame) -> DataFrame:
    """Waitlist rows with the default source."""
    return signups.withColumn("source", F.coalesce("source", F.lit(fixed.LEAD_SOURCE)))


def unique_leads(signups: DataFrame, held: DataFrame | None = None, ts: str = "ts", tie: str = "signup_id") -> DataFrame:
    """Leads as a table with a unique e-mail takes them: the first sign-up of each normalised e-mail that ``held`` doesn't hold yet."""
    rows = leads(signups.where(F.col("email").isNotNull()).withColumn("email", columns.norm_email(F.col("email"))))
    if held is not None:
        rows = joins.lookup_join(rows, held.select("email").distinct(), "email", "left_anti")
    return joins.repair(rows, ["email"], [ts, tie])[0].select(*signups.columns)
