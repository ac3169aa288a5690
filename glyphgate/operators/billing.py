"""Subscription state from billing events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphgate.functions import fixed
from glyphgate.operators import joins, usage

OBJECT_SCHEMA = ("struct<id:string,customer:string,subscription:string,status:string,"
                 "price_id:string,current_period_end:bigint>")
EVENT_SCHEMA = f"event_id string, ts timestamp, type string, object {OBJECT_SCHEMA}"
STATE_COLUMNS = ("subscription_id", "customer_id", "user_id", "status", "plan", "current_period_end", "updated_at")


def subscription_changes(events: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """One row per event that touches a subscription: what it sets, and whether it sets it.

    ``created`` and ``updated`` events set status, plan and period end (a null period end is
    a value); ``deleted`` and invoice events set the status only.  Other types drop out, as do
    invoices without a subscription.
    """
    o = "object."
    full = F.col("type").isin(fixed.SUBSCRIPTION_CREATED, fixed.SUBSCRIPTION_UPDATED)
    invoice = F.col("type").isin(fixed.INVOICE_PAID, fixed.INVOICE_FAILED)
    flat = events.where(full | invoice | (F.col("type") == fixed.SUBSCRIPTION_DELETED)).select(
        "event_id", "ts", "type",
        F.when(invoice, F.col(o + "subscription")).otherwise(F.col(o + "id")).alias("subscription_id"),
        F.col(o + "customer").alias("customer_id"),
        F.when(F.col("type") == fixed.SUBSCRIPTION_DELETED, "canceled")
        .when(F.col("type") == fixed.INVOICE_PAID, "active")
        .when(F.col("type") == fixed.INVOICE_FAILED, "past_due")
        .otherwise(F.col(o + "status")).alias("status"),
        F.col(o + "price_id").alias("price_id"),
        F.when(full, F.timestamp_seconds(F.nullif(o + "current_period_end", F.lit(0)))).alias("current_period_end"),
        full.alias("sets_plan"), (F.col("type") == fixed.SUBSCRIPTION_CREATED).alias("creates"),
    ).where(F.col("subscription_id").isNotNull())
    if prices is None:
        planned = flat.withColumn("plan", F.lit(fixed.UNKNOWN_PRICE_PLAN))
    else:
        planned = usage.price_plan(flat, prices)
    return planned.withColumn("plan", F.when(F.col("sets_plan"), F.col("plan")))


def resolve_users(changes: DataFrame, customers: DataFrame, subs: DataFrame | None = None) -> DataFrame:
    """Add ``user_id``: from the customer record, else from an earlier subscription of the customer."""
    out = joins.lookup_join(changes, customers.select("customer_id", F.col("user_id").alias("__meta")), "customer_id")
    if subs is None:
        return out.withColumnRenamed("__meta", "user_id")
    known = subs.groupBy("customer_id").agg(F.max_by("user_id", "updated_at").alias("__known"))
    return (joins.lookup_join(out, known, "customer_id")
            .withColumn("user_id", F.coalesce("__meta", "__known")).drop("__meta", "__known"))


def position_columns(changes: DataFrame) -> list[str]:
    """Order of changes in event time; of two forms of one event the one with the later known user comes last."""
    return ["ts", "event_id", *(["user_at"] if "user_at" in changes.columns else [])]


def latest_subscription(changes: DataFrame, order: str = "event") -> DataFrame:
    """Current state per subscription: per field the last value set, in event time (ties by event id).

    One aggregate that combines before the shuffle, so a subscription with very many events
    is no bottleneck.  Subscriptions never created drop out.  The last event to set a field
    cannot precede the creation, because the creation sets every field.
    ``order='arrival'`` takes the order of an ``arrival`` column instead.
    """
    position = F.struct(*position_columns(changes)) if order == "event" else F.struct("arrival")
    user = F.col("user_id") if "user_id" in changes.columns else F.lit(None).cast("string")

    def last(col, only):
        return F.max_by(col, F.when(only, position))

    sets, creates = F.col("sets_plan"), F.col("creates")
    return (changes.groupBy("subscription_id")
            .agg(last(F.col("customer_id"), creates).alias("customer_id"), last(user, creates).alias("user_id"),
                 F.max_by("status", position).alias("status"), last(F.col("plan"), sets).alias("plan"),
                 last(F.col("current_period_end"), sets).alias("current_period_end"),
                 F.max("ts").alias("updated_at"), F.max(creates).alias("__created"))
            .where("__created").drop("__created").select(*STATE_COLUMNS))


def updatable(changes: DataFrame, subs: DataFrame) -> DataFrame:
    """Changes to subscriptions that exist; creations pass."""
    known = subs.select("subscription_id").distinct()
    others = joins.lookup_join(changes.where(~F.col("creates")), known, "subscription_id", "left_semi")
    return changes.where(F.col("creates")).unionByName(others)


def apply_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Subscription table after the changes: base rows act as creations that came before."""
    as_changes = base.select(
        F.lit("").alias("event_id"), F.col("updated_at").alias("ts"), "subscription_id", "customer_id", "user_id",
        "status", "plan", "current_period_end", F.lit(True).alias("sets_plan"), F.lit(True).alias("creates"))
    return latest_subscription(as_changes.unionByName(changes.select(*as_changes.columns)))


def upsert(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key of both tables; updates win ties."""
    both = (base.withColumn("__rank", F.lit(0)).unionByName(updates.select(*base.columns).withColumn("__rank", F.lit(1))))
    row = F.struct(*base.columns)
    return (both.groupBy(key).agg(F.max_by(row, F.struct(version, "__rank")).alias("r")).select("r.*"))
