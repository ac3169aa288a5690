"""Queries over requests, keys, subscriptions and billing events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphgate.functions import columns, fixed
from glyphgate.operators import admission, billing, evaluate, flows, joins, rates, usage
from glyphgate.plans import inputs, oracle, text_queries
from glyphgate.plans.inputs import MONTH, derived, table
from glyphgate.plans.registry import query
from glyphgate.sources import sinks, upserts
from glyphgate.sources.texts import read_dim

TEST_LIMIT = 20          # small, so that quotas bite on the test log
IP_WINDOW, IP_LIMIT = 6 * 3_600_000, 3

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DUCK_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def stamp(c):
    return F.date_format(c, STAMP)


def duck_stamp(sql: str) -> str:
    return f"strftime({sql}, {DUCK_STAMP})"


def requests(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, "requests")


def keyed_requests(spark, sf_dir) -> DataFrame:
    return requests(spark, sf_dir).withColumn("key_hash", columns.key_hash(columns.bearer(F.col("auth_header"))))


_TOKEN = "CASE WHEN lower(left(auth_header, 7)) = 'bearer ' THEN nullif(trim(substr(auth_header, 8)), '') END"
_KEYED = f"SELECT *, sha256({_TOKEN}) AS key_hash, strftime(ts, '%Y-%m') AS month FROM requests"


# --- request parsing -------------------------------------------------------------------

@query("src_requests",
       "WITH j AS (SELECT request_id, json_valid(body) AS body_ok, CASE WHEN json_valid(body) THEN body END AS b FROM requests)"
       " SELECT request_id, body_ok, CASE WHEN json_type(b, '$.input') = 'VARCHAR' THEN json_extract_string(b, '$.input') END AS input,"
       " array_to_string(json_extract_string(b, '$.modules[*]'), ',') AS modules_text FROM j")
def src_requests(spark, sf_dir):
    parsed = admission.parse_requests(requests(spark, sf_dir))
    listed = F.coalesce(F.array_join("modules", ","), F.when(F.col("body_ok"), F.lit("")))
    return parsed.select("request_id", "body_ok", "input", listed.alias("modules_text"))


@query("flt_oversize", "SELECT doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 8192"
                       " AS raw_too_long, strlen(text) > 4096 AS too_large FROM texts")
def flt_oversize(spark, sf_dir):
    return admission.flag_oversize(text_queries.texts(spark, sf_dir), "text").select("doc_id", "raw_too_long", "too_large")


@query("prj_bearer", f"SELECT request_id, {_TOKEN} AS token FROM requests")
def prj_bearer(spark, sf_dir):
    return requests(spark, sf_dir).select("request_id", columns.bearer(F.col("auth_header")).alias("token"))


@query("prj_keyhash", f"SELECT request_id, key_hash FROM ({_KEYED})")
def prj_keyhash(spark, sf_dir):
    return keyed_requests(spark, sf_dir).select("request_id", "key_hash")


@query("prj_prefix", "SELECT raw_key, left(raw_key, 5) || '...' AS key_prefix FROM free_raw")
def prj_prefix(spark, sf_dir):
    return derived(spark, sf_dir, "free_raw").select("raw_key", columns.key_prefix(F.col("raw_key"), 5).alias("key_prefix"))


@query("prj_client_ip",
       "SELECT request_id, CASE WHEN forwarded <> '' THEN trim(string_split(forwarded, ',')[1])"
       " ELSE coalesce(nullif(peer, ''), 'unknown') END AS ip FROM requests")
def prj_client_ip(spark, sf_dir):
    ip = columns.client_ip(F.col("forwarded"), F.col("peer"))
    return requests(spark, sf_dir).select("request_id", ip.alias("ip"))


# --- filters over key tables -----------------------------------------------------------

@query("flt_revoked", "SELECT user_id, key_hash FROM paid_keys WHERE revoked_at IS NULL")
def flt_revoked(spark, sf_dir):
    return usage.active_keys(inputs.paid_keys(spark, sf_dir)).select("user_id", "key_hash")


@query("flt_active_sub", "SELECT user_id, status FROM subs WHERE status IN ('active', 'trialing')")
def flt_active_sub(spark, sf_dir):
    return usage.active_subscriptions(derived(spark, sf_dir, "subs")).select("user_id", "status")


_SIGNED = ("SELECT signup_id, ts, lower(trim(email)) AS email, source FROM signups"
           " WHERE regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') AND consent")


@query("flt_signup", f"SELECT signup_id, email FROM ({_SIGNED})")
def flt_signup(spark, sf_dir):
    return usage.valid_signups(derived(spark, sf_dir, "signups")).select("signup_id", "email")


@query("flt_owner", "SELECT user_id, tier FROM paid_keys WHERE user_id = (SELECT max(user_id) FROM paid_keys)")
def flt_owner(spark, sf_dir):
    """The keys of one user: the newest one."""
    keys = inputs.paid_keys(spark, sf_dir)
    newest = keys.agg(F.max("user_id").alias("user_id"))
    return usage.owned_by(keys, newest.scalar()).select("user_id", "tier")


@query("flt_retention",
       "SELECT request_id FROM requests WHERE ts >= TIMESTAMP '2024-04-20 00:00:00' - INTERVAL 90 DAY")
def flt_retention(spark, sf_dir):
    kept = usage.retained(requests(spark, sf_dir), F.lit("2024-04-20 00:00:00").cast("timestamp"), "ts")
    return kept.select("request_id")


# --- lookups ---------------------------------------------------------------------------

_FREE_JOIN = f"({_KEYED}) r LEFT JOIN free_keys f USING (key_hash)"
_PAID_JOIN = f"{_FREE_JOIN} LEFT JOIN paid_keys p ON p.key_hash = r.key_hash AND f.email IS NULL"


@query("join_free", f"SELECT request_id, f.email AS free_email, f.email IS NOT NULL AS is_free FROM {_FREE_JOIN}")
def join_free(spark, sf_dir):
    joined = usage.join_free(keyed_requests(spark, sf_dir), inputs.free_keys(spark, sf_dir))
    return joined.select("request_id", "free_email", "is_free")


@query("join_paid", f"SELECT request_id, p.user_id, p.tier, p.user_id IS NOT NULL AS is_paid FROM {_PAID_JOIN}")
def join_paid(spark, sf_dir):
    known = usage.join_free(keyed_requests(spark, sf_dir), inputs.free_keys(spark, sf_dir))
    return usage.join_paid(known, inputs.paid_keys(spark, sf_dir)).select("request_id", "user_id", "tier", "is_paid")


@query("join_subs", "SELECT p.key_hash, p.user_id, status, plan FROM paid_keys p LEFT JOIN subs USING (user_id)")
def join_subs(spark, sf_dir):
    joined = usage.join_subscriptions(inputs.paid_keys(spark, sf_dir), derived(spark, sf_dir, "subs"))
    return joined.select("key_hash", "user_id", "status", "plan")


_PLAN = "lower(coalesce(nullif(s.plan, ''), nullif(p.tier, ''), ''))"
_LIMIT = "CASE {plan} WHEN 'indie' THEN 25000 WHEN 'team' THEN 100000 WHEN 'enterprise' THEN 999999999 ELSE 500000 END"


@query("join_limit", f"SELECT p.key_hash, {_PLAN} AS plan_name, ({_LIMIT.format(plan=_PLAN)})::BIGINT AS limit_n"
                     " FROM paid_keys p LEFT JOIN subs s USING (user_id)")
def join_limit(spark, sf_dir):
    joined = usage.join_subscriptions(inputs.paid_keys(spark, sf_dir), derived(spark, sf_dir, "subs"))
    named = joined.withColumn("plan_name", usage.plan_name(F.col("plan"), F.col("tier")))
    return named.select("key_hash", "plan_name", usage.plan_limit(F.col("plan_name")).alias("limit_n"))


@query("join_plan", "SELECT event_id, coalesce(plan, 'indie') AS plan FROM billing LEFT JOIN prices USING (price_id)")
def join_plan(spark, sf_dir):
    return usage.price_plan(derived(spark, sf_dir, "billing"), inputs.prices(spark)).select("event_id", "plan")


@query("join_anti_signup", f"SELECT signup_id, email FROM ({_SIGNED}) WHERE email NOT IN (SELECT email FROM free_keys)")
def join_anti_signup(spark, sf_dir):
    fresh = usage.new_signups(derived(spark, sf_dir, "signups"), inputs.free_keys(spark, sf_dir))
    return fresh.select("signup_id", "email")


_CHANGES = (
    "SELECT event_id, ts, type, CASE WHEN type LIKE 'invoice%' THEN subscription ELSE id END AS subscription_id,"
    " customer AS customer_id, type IN ('customer.subscription.created', 'customer.subscription.updated') AS sets_plan,"
    " type = 'customer.subscription.created' AS creates,"
    " CASE type WHEN 'customer.subscription.deleted' THEN 'canceled' WHEN 'invoice.paid' THEN 'active'"
    " WHEN 'invoice.payment_failed' THEN 'past_due' ELSE status END AS status,"
    " coalesce(plan, 'indie') AS plan, current_period_end AS period FROM billing LEFT JOIN prices USING (price_id)"
    " WHERE CASE WHEN type LIKE 'invoice%' THEN subscription ELSE id END IS NOT NULL"
)


@query("src_billing", f"SELECT event_id, subscription_id, status, CASE WHEN sets_plan THEN plan END AS plan FROM ({_CHANGES})")
def src_billing(spark, sf_dir):
    """Billing events written as JSON lines, read back with the fixed schema, as subscription changes."""
    from glyphgate.sources.texts import read_billing_events

    path = sinks.work_dir(spark)
    inputs.billing_events(spark, sf_dir).write.json(path)
    changes = billing.subscription_changes(read_billing_events(spark, path), inputs.prices(spark))
    return changes.select("event_id", "subscription_id", "status", "plan")


def changes(spark, sf_dir) -> DataFrame:
    return billing.subscription_changes(inputs.billing_events(spark, sf_dir), inputs.prices(spark))


@query("join_semi_sub", f"SELECT event_id FROM ({_CHANGES}) WHERE creates OR subscription_id IN"
                        " (SELECT 'sub_' || user_id FROM subs)")
def join_semi_sub(spark, sf_dir):
    existing = derived(spark, sf_dir, "subs").select(F.expr("concat('sub_', user_id)").alias("subscription_id"))
    return billing.updatable(changes(spark, sf_dir), existing).select("event_id")


@query("join_user",
       f"SELECT event_id, coalesce(CASE WHEN c.c_nationkey < 12 THEN 'u' || c.c_custkey END, 's' || s.user_id) AS user_id"
       f" FROM ({_CHANGES}) e LEFT JOIN customer c ON e.customer_id = 'cus_' || c.c_custkey"
       " LEFT JOIN subs s ON s.customer_id = e.customer_id")
def join_user(spark, sf_dir):
    owned = billing.resolve_users(changes(spark, sf_dir), customer_users(spark, sf_dir), subscribed_users(spark, sf_dir))
    return owned.select("event_id", "user_id")


@query("chk_unique", "SELECT email, count(*) AS n FROM signups WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1")
def chk_unique(spark, sf_dir):
    rows = derived(spark, sf_dir, "signups").where("email IS NOT NULL")
    return joins.duplicate_keys(rows, "email")


@query("set_keys", "SELECT key_hash, min(kind) AS kind FROM (SELECT key_hash, 'free' AS kind FROM free_keys"
                   " UNION ALL SELECT key_hash, 'paid' FROM paid_keys) GROUP BY key_hash")
def set_keys(spark, sf_dir):
    return usage.key_universe(inputs.free_keys(spark, sf_dir), inputs.paid_keys(spark, sf_dir))


# --- metering --------------------------------------------------------------------------

@query("agg_usage_key", f"SELECT key_hash, month, count(*) AS request_count, {duck_stamp('max(ts)')} AS last_used_at"
                        f" FROM ({_KEYED}) WHERE key_hash IS NOT NULL GROUP BY ALL")
def agg_usage_key(spark, sf_dir):
    log = keyed_requests(spark, sf_dir).where("key_hash IS NOT NULL")
    return usage.usage_by(log, ["key_hash"]).withColumn("last_used_at", stamp("last_used_at"))


@query("agg_usage_user", "SELECT user_key, strftime(ts, '%Y-%m') AS month, count(*) AS request_count FROM requests"
                         " WHERE valid GROUP BY ALL")
def agg_usage_user(spark, sf_dir):
    return usage.usage_by(requests(spark, sf_dir).where("valid"), ["user_key"]).drop("last_used_at")


@query("agg_current_used", f"SELECT key_hash, CASE WHEN month_bucket = '{MONTH}' THEN requests_this_month ELSE 0 END::BIGINT AS used"
                           " FROM free_keys")
def agg_current_used(spark, sf_dir):
    read = usage.current_used(inputs.free_keys(spark, sf_dir), MONTH)
    return read.select("key_hash", F.col("used").cast("bigint").alias("used"))


@query("agg_reset", f"SELECT (SELECT count(*) FROM paid_keys WHERE requests_this_month > 0) AS paid_reset,"
                    f" (SELECT count(*) FROM free_keys WHERE requests_this_month > 0 OR month_bucket <> '{MONTH}') AS free_reset")
def agg_reset(spark, sf_dir):
    return usage.monthly_reset(inputs.paid_keys(spark, sf_dir), inputs.free_keys(spark, sf_dir), MONTH)[2]


@query("agg_count", "SELECT count(*) AS n FROM events")
def agg_count(spark, sf_dir):
    return usage.row_count(table(spark, sf_dir, "events"))


_KEY_KINDS = ("SELECT key_hash, 'free' AS kind, 'FREE' AS tier, 'free' AS plan FROM free_keys UNION ALL"
              f" SELECT p.key_hash, 'paid', coalesce(p.tier, 'growth'), {_PLAN} FROM paid_keys p LEFT JOIN subs s USING (user_id)")


@query("agg_quota",
       f"WITH used_ AS (SELECT key_hash, count(*) AS n FROM ({_KEYED}) WHERE month = '{MONTH}' GROUP BY key_hash),"
       f" q AS (SELECT k.key_hash, upper(tier) AS tier, plan, (CASE WHEN kind = 'free' THEN 10000 ELSE {_LIMIT.format(plan='plan')} END)::BIGINT"
       f" AS limit_n, coalesce(n, 0) AS used FROM ({_KEY_KINDS}) k LEFT JOIN used_ USING (key_hash))"
       f" SELECT *, greatest(0, limit_n - used - 1) AS remaining, CASE WHEN limit_n >= 999000000 THEN '∞' ELSE limit_n::VARCHAR END"
       f" AS limit_shown, '{MONTH}' AS reset_month FROM q")
def agg_quota(spark, sf_dir):
    paid = usage.join_subscriptions(inputs.paid_keys(spark, sf_dir), derived(spark, sf_dir, "subs"))
    named = paid.select("key_hash", F.lit("paid").alias("kind"), F.coalesce("tier", F.lit("growth")).alias("tier"),
                        usage.plan_name(F.col("plan"), F.col("tier")).alias("plan"))
    free = inputs.free_keys(spark, sf_dir).select(
        "key_hash", F.lit("free").alias("kind"), F.lit("FREE").alias("tier"), F.lit("free").alias("plan"))
    used = usage.usage_by(keyed_requests(spark, sf_dir), ["key_hash"])
    return usage.quotas(free.unionByName(named), used, MONTH)


_BEFORE = ("coalesce(sum(valid::INT) OVER (PARTITION BY user_key, strftime(ts, '%Y-%m') ORDER BY ts, request_id"
           " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT")


@query("win_admit", f"WITH b AS (SELECT request_id, {_BEFORE} AS earlier FROM requests)"
                    f" SELECT request_id, least(earlier, {TEST_LIMIT}) AS used_before, earlier < {TEST_LIMIT} AS admitted FROM b")
def win_admit(spark, sf_dir):
    log = requests(spark, sf_dir).select(
        "request_id", "ts", "user_key", "valid", F.lit(TEST_LIMIT).cast("bigint").alias("limit_n"))
    return usage.admit(log, "user_key", "limit_n").select("request_id", "used_before", "admitted")


@query("win_running", f"SELECT request_id, {_BEFORE} + valid::INT AS counter FROM requests")
def win_running(spark, sf_dir):
    log = requests(spark, sf_dir).select("request_id", "ts", "user_key", "valid")
    return usage.running_usage(log, "user_key").select("request_id", "counter")


_OUTCOME = (
    f"WITH k AS ({_KEYED}), a AS (SELECT r.request_id, r.ts, r.month, r.key_hash, json_valid(body) AS body_ok,"
    " CASE WHEN json_valid(body) THEN body END AS b,"
    " CASE WHEN r.key_hash IS NULL THEN 'missing' WHEN f.email IS NOT NULL THEN 'free' WHEN p.user_id IS NULL THEN 'none'"
    " WHEN p.revoked_at IS NOT NULL THEN 'revoked' WHEN coalesce(s.status, '') NOT IN ('active', 'trialing') THEN 'inactive'"
    " ELSE 'paid' END AS kind FROM k r LEFT JOIN free_keys f USING (key_hash) LEFT JOIN paid_keys p ON p.key_hash = r.key_hash"
    " LEFT JOIN subs s ON s.user_id = p.user_id),"
    " v AS (SELECT *, body_ok AND coalesce(json_type(b, '$.input') = 'VARCHAR' AND trim(json_extract_string(b, '$.input')) <> '', false) AS good,"
    " kind IN ('free', 'paid') AS known FROM a),"
    " n AS (SELECT *, coalesce(sum((good AND known)::INT) OVER (PARTITION BY key_hash, month ORDER BY ts, request_id"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM v)"
    " SELECT request_id, CASE WHEN kind = 'missing' THEN 'MISSING_API_KEY' WHEN kind = 'none' THEN 'INVALID_API_KEY'"
    " WHEN kind = 'revoked' THEN 'REVOKED_API_KEY' WHEN kind = 'inactive' THEN 'SUBSCRIPTION_INACTIVE'"
    f" WHEN earlier >= {TEST_LIMIT} THEN 'RATE_LIMIT_EXCEEDED' WHEN NOT body_ok THEN 'INVALID_BODY'"
    " WHEN NOT good THEN 'INVALID_INPUT' ELSE 'OK' END AS outcome FROM n"
)


def classified(spark, sf_dir) -> DataFrame:
    return admission.classify_requests(
        requests(spark, sf_dir), inputs.free_keys(spark, sf_dir), inputs.paid_keys(spark, sf_dir),
        derived(spark, sf_dir, "subs"), limit=F.lit(TEST_LIMIT).cast("bigint"))


@query("adm_outcome", _OUTCOME)
def adm_outcome(spark, sf_dir):
    return classified(spark, sf_dir).select("request_id", "outcome")


_STORED = _OUTCOME.replace(
    "v AS (SELECT *,", "u AS (SELECT a.*, CASE WHEN month = month_bucket THEN requests_this_month ELSE 0 END AS stored"
    " FROM a LEFT JOIN free_keys USING (key_hash)), v AS (SELECT *,").replace(
    "known FROM a),", "known FROM u),").replace("AS earlier FROM v)", "+ coalesce(stored, 0) AS earlier FROM v)")


def processed(spark, sf_dir) -> DataFrame:
    free = inputs.free_keys(spark, sf_dir)
    return flows.process_requests(
        requests(spark, sf_dir), free, inputs.paid_keys(spark, sf_dir), derived(spark, sf_dir, "subs"), stored=free,
        secret=text_queries.SECRET, limit=F.lit(TEST_LIMIT).cast("bigint"), as_of_year=inputs.AS_OF_YEAR)


_OK_REPORT = "CASE WHEN outcome = 'OK' THEN {} END"


@query("req_pipeline", f"SELECT request_id, outcome, {_OK_REPORT.format(chr(39) + 'CLEARED' + chr(39))} AS verdict FROM ({_STORED})")
def req_pipeline(spark, sf_dir):
    """Key, stored counter, quota, body, scan of the admitted inputs (the fixture's inputs are harmless)."""
    return processed(spark, sf_dir).select("request_id", "outcome", "verdict")


@query("req_audit", f"WITH o AS ({_STORED}) SELECT key_hash, count(*) AS reports, count(*) FILTER (f.email IS NOT NULL) AS free_reports"
                    f" FROM o JOIN ({_KEYED}) k USING (request_id) LEFT JOIN free_keys f USING (key_hash) WHERE outcome = 'OK' GROUP BY key_hash")
def req_audit(spark, sf_dir):
    """Audit rows by key, with the tier the request was admitted under."""
    rows = flows.audit_of(processed(spark, sf_dir))
    return rows.groupBy("key_hash").agg(F.count("*").alias("reports"), F.count_if(F.col("tier") == "FREE").alias("free_reports"))


_SIGNUP_SQL = (
    "WITH o AS (SELECT signup_id, client_ip AS k, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY client_ip"
    " ORDER BY epoch_us(ts) // 1000, signup_id) AS rn FROM signups), w AS (SELECT signup_id, k, rn, ms, ms AS start, 1 AS pos"
    " FROM o WHERE rn = 1 UNION ALL SELECT o.signup_id, o.k, o.rn, o.ms,"
    " CASE WHEN o.ms - w.start > 3600000 THEN o.ms ELSE w.start END,"
    " CASE WHEN o.ms - w.start > 3600000 THEN 1 ELSE w.pos + 1 END FROM w JOIN o ON o.k = w.k AND o.rn = w.rn + 1),"
    " e AS (SELECT s.signup_id, s.ts, lower(trim(s.email)) AS mail, CASE WHEN pos > 3 THEN 'RATE_LIMIT_EXCEEDED'"
    " WHEN NOT coalesce(regexp_matches(s.email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$'), false) THEN 'INVALID_EMAIL'"
    " WHEN NOT coalesce(consent, false) THEN 'CONSENT_REQUIRED' WHEN f.email IS NOT NULL THEN 'EXISTING' END AS early"
    " FROM signups s JOIN w USING (signup_id) LEFT JOIN free_keys f ON f.email = lower(trim(s.email)))"
    " SELECT signup_id, CASE WHEN early IS NOT NULL THEN early WHEN row_number() OVER (PARTITION BY mail, early IS NULL ORDER BY ts, signup_id) = 1"
    " THEN 'REGISTERED' ELSE 'EXISTING' END AS outcome FROM e")


@query("signup_outcome", _SIGNUP_SQL)
def signup_outcome(spark, sf_dir):
    """Three sign-ups per hour and address, then e-mail, consent, existing key."""
    return flows.signup_outcomes(derived(spark, sf_dir, "signups"), inputs.free_keys(spark, sf_dir)).select("signup_id", "outcome")


_CUSTOMER_USERS = "SELECT 'cus_' || c_custkey AS customer_id, 'u' || c_custkey AS meta FROM customer WHERE c_nationkey < 12"
LATEST_SQL = (
    f"WITH ch AS ({_CHANGES}), made AS (SELECT subscription_id FROM ch WHERE creates GROUP BY 1), cu AS ({_CUSTOMER_USERS}),"
    " known AS (SELECT customer_id, max('s' || user_id) AS other FROM subs GROUP BY 1),"
    " state AS (SELECT subscription_id, arg_max(customer_id, (ts, event_id)) FILTER (creates) AS customer_id,"
    " arg_max(status, (ts, event_id)) AS status, arg_max(plan, (ts, event_id)) FILTER (sets_plan) AS plan,"
    " arg_max(coalesce(period, -1), (ts, event_id)) FILTER (sets_plan) AS period_end FROM ch"
    " WHERE subscription_id IN (SELECT subscription_id FROM made) GROUP BY subscription_id)"
    " SELECT subscription_id, customer_id, coalesce(meta, other) AS user_id, status, plan, period_end"
    " FROM state LEFT JOIN cu USING (customer_id) LEFT JOIN known USING (customer_id)")


def customer_users(spark, sf_dir) -> DataFrame:
    """Users that customer records name."""
    return table(spark, sf_dir, "customer").where("c_nationkey < 12").selectExpr(
        "concat('cus_', c_custkey) AS customer_id", "concat('u', c_custkey) AS user_id")


def subscribed_users(spark, sf_dir) -> DataFrame:
    """Users of earlier subscriptions."""
    return derived(spark, sf_dir, "subs").selectExpr(
        "customer_id", "concat('s', user_id) AS user_id", "TIMESTAMP '2024-01-01 00:00:00' AS updated_at")


def latest_columns(state: DataFrame) -> DataFrame:
    return state.select("subscription_id", "customer_id", "user_id", "status", "plan",
                        F.coalesce(F.unix_seconds("current_period_end"), F.lit(-1)).cast("bigint").alias("period_end"))


@query("win_latest_sub", LATEST_SQL)
def win_latest_sub(spark, sf_dir):
    owned = billing.resolve_users(changes(spark, sf_dir), customer_users(spark, sf_dir), subscribed_users(spark, sf_dir))
    return latest_columns(billing.latest_subscription(owned))


def _rate_sql(key: str, limit: int, window: int) -> str:
    return (
        f"WITH o AS (SELECT request_id, {key} AS k, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY {key}"
        " ORDER BY epoch_us(ts) // 1000, request_id) AS rn FROM requests), w AS (SELECT request_id, k, rn, ms, ms AS start, 1 AS pos"
        " FROM o WHERE rn = 1 UNION ALL SELECT o.request_id, o.k, o.rn, o.ms,"
        f" CASE WHEN o.ms - w.start > {window} THEN o.ms ELSE w.start END,"
        f" CASE WHEN o.ms - w.start > {window} THEN 1 ELSE w.pos + 1 END FROM w JOIN o ON o.k = w.k AND o.rn = w.rn + 1)"
        f" SELECT request_id, start AS window_start, pos::BIGINT AS position, pos <= {limit} AS allowed,"
        f" greatest({limit} - pos, 0)::BIGINT AS remaining,"
        f" CASE WHEN pos > {limit} THEN ceil((start + {window} - ms) / 1000)::BIGINT END AS retry_after_s,"
        f" CASE WHEN pos > {limit} THEN ceil((start + {window} - ms) / 60000)::BIGINT END AS reset_in_min FROM w"
    )


_RATE_COLUMNS = ("window_start", "position", "remaining", "retry_after_s", "reset_in_min")
_IP_KEY = "(user_key % 50)"


def _rated(df: DataFrame) -> DataFrame:
    return df.select("request_id", "allowed", *[F.col(c).cast("bigint").alias(c) for c in _RATE_COLUMNS])


@query("win_rate", _rate_sql(_IP_KEY, IP_LIMIT, IP_WINDOW))
def win_rate(spark, sf_dir):
    log = requests(spark, sf_dir).select("request_id", "ts", F.expr(_IP_KEY).alias("ip"))
    return _rated(rates.rate_limit(log, "ip", "ts", "request_id", IP_LIMIT, IP_WINDOW))


@query("win_rate_hot", _rate_sql("'all'", 10, 3_600_000))
def win_rate_hot(spark, sf_dir):
    """One key that holds every request: long stretches go the block way."""
    log = requests(spark, sf_dir).select("request_id", "ts", F.lit("all").alias("ip"))
    return _rated(rates.rate_limit(log, "ip", "ts", "request_id", 10, 3_600_000, stretch=16))


# --- evaluation of latencies -----------------------------------------------------------

@query("agg_latency", "SELECT event_type, round(avg(value), 3) AS mean FROM events GROUP BY event_type")
def agg_latency(spark, sf_dir):
    return evaluate.mean_latency(table(spark, sf_dir, "events"), "value", ["event_type"])


def _pct_sql(by: str) -> str:
    group = f"{by}, " if by else ""
    picks = ", ".join(f"round(v[1 + least(n - 1, floor({p} * n / 100))::BIGINT], 3) AS p{p}" for p in (50, 95, 99))
    return (f"WITH s AS (SELECT {group}list_sort(list(value)) AS v, count(*) AS n FROM events"
            f"{' GROUP BY ' + by if by else ''}) SELECT {group}{picks} FROM s")


@query("agg_pct", _pct_sql(""))
def agg_pct(spark, sf_dir):
    return evaluate.percentiles(table(spark, sf_dir, "events"), "value")


@query("agg_pct_by", _pct_sql("event_type"))
def agg_pct_by(spark, sf_dir):
    return evaluate.percentiles(table(spark, sf_dir, "events"), "value", by=["event_type"])


# --- sinks -----------------------------------------------------------------------------

_DAY = "TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 7)::INT)"


def audit_rows(spark, sf_dir) -> DataFrame:
    """Audit rows of the signed scan, with their day."""
    moment = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(doc_id % 7 AS INT))")
    rows = text_queries.signed(spark, sf_dir).withColumn("created_at", moment)
    return sinks.audit_rows(rows, F.col("created_at"), user=F.concat(F.lit("u"), F.col("doc_id") % 10),
                            tier=F.when(F.col("doc_id") % 3 == 0, "GROWTH"), latency_ms=F.col("doc_id") % 13
                            ).withColumn("dt", F.to_date("created_at"))


def audit_table(spark, sf_dir) -> DataFrame:
    """Audit rows, appended to a day-partitioned table and read back."""
    path = sinks.work_dir(spark)
    sinks.write_audit(audit_rows(spark, sf_dir), path)
    return spark.read.parquet(path)


_AUDIT = (f"SELECT doc_id, 'zp_' || upper(left(sha256(doc_id || '|' || text), 16)) AS report_id, 'u' || doc_id % 10 AS user_id,"
          f" verdict, sha256, (doc_id % 13)::DOUBLE AS latency_ms, CASE WHEN doc_id % 3 = 0 THEN 'GROWTH' ELSE 'FREE' END AS tier,"
          f" {_DAY} AS created_at FROM rep JOIN texts USING (doc_id)")


@query("snk_audit", f"WITH {text_queries.REP}, audit_ AS ({_AUDIT}) SELECT report_id, user_id, verdict, sha256, latency_ms, tier,"
                    " strftime(created_at, '%Y-%m-%d') AS dt FROM audit_")
def snk_audit(spark, sf_dir):
    rows = audit_table(spark, sf_dir)
    return rows.select("report_id", "user_id", "verdict", "sha256", "latency_ms", "tier", F.col("dt").cast("string").alias("dt"))


@query("agg_verdicts", f"WITH {text_queries.REP}, audit_ AS ({_AUDIT}) SELECT strftime(created_at, '%Y-%m-%d') AS dt, tier, verdict,"
                       " count(*) AS reports, round(avg(latency_ms), 3) AS mean_latency_ms FROM audit_ GROUP BY ALL")
def agg_verdicts(spark, sf_dir):
    summary = evaluate.verdict_summary(audit_rows(spark, sf_dir))
    return summary.withColumn("dt", F.col("dt").cast("string"))


@query("srt_recent", f"WITH {text_queries.REP}, audit_ AS ({_AUDIT}) SELECT report_id, verdict FROM audit_"
                     " ORDER BY created_at DESC, report_id DESC LIMIT 20")
def srt_recent(spark, sf_dir):
    return usage.recent(audit_rows(spark, sf_dir), 20).select("report_id", "verdict")


@query("snk_upsert",
       f"WITH ch AS ({_CHANGES}), made AS (SELECT subscription_id FROM ch WHERE creates GROUP BY 1),"
       " news AS (SELECT subscription_id, arg_max(status, (ts, event_id)) AS status FROM ch"
       " WHERE subscription_id IN (SELECT subscription_id FROM made) GROUP BY 1)"
       " SELECT coalesce(n.subscription_id, b.id) AS subscription_id, coalesce(n.status, b.status) AS status"
       " FROM news n FULL JOIN (SELECT 'sub_' || user_id AS id, status FROM subs) b ON b.id = n.subscription_id")
def snk_upsert(spark, sf_dir):
    """Updates into a table of key-hash partitions: the partitions they touch are rewritten."""
    path = sinks.work_dir(spark)
    base, news = upsert_inputs(spark, sf_dir)
    for rows in (base, news):
        upserts.upsert_partitions(rows, path, "subscription_id", "updated_at", buckets=8)
    return upserts.read_upserted(spark, path).select("subscription_id", "status")


def upsert_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    base = derived(spark, sf_dir, "subs").selectExpr(
        "concat('sub_', user_id) AS subscription_id", "status", "TIMESTAMP '2023-12-31 00:00:00' AS updated_at")
    return base, billing.latest_subscription(changes(spark, sf_dir)).select(*base.columns)


_METRICS = ("tp", "fp", "tn", "fn", "precision", "recall", "f1", "accuracy")


@query("snk_metrics",
       f"{text_queries._EVAL}, counts AS (SELECT {text_queries._COUNTS} FROM hits JOIN synth USING (id)),"
       f" m AS (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, tn::DOUBLE AS tn, fn::DOUBLE AS fn, {text_queries._RATES} FROM counts)"
       f" SELECT metric, value::DOUBLE AS value FROM m UNPIVOT (value FOR metric IN ({', '.join(_METRICS)}))")
def snk_metrics(spark, sf_dir):
    path = sinks.work_dir(spark)
    sinks.write_metrics(evaluate.metrics(evaluate.confusion(text_queries.judged(spark, sf_dir))), path)
    stored = spark.read.schema(
        "tp bigint, fp bigint, tn bigint, fn bigint, precision double, recall double, f1 double, accuracy double").json(path)
    return evaluate.long_metrics(stored, _METRICS)


@query("snk_metrics_header",
       f"{text_queries._EVAL} SELECT 'fixture' AS source, TRUE AS marketing_grade, '2.0' AS engine_version, 22::BIGINT AS signature_count,"
       " count(*) AS samples, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM hits JOIN synth USING (id)")
def snk_metrics_header(spark, sf_dir):
    """The header of a written evaluation."""
    path = sinks.work_dir(spark)
    measured = evaluate.metrics(evaluate.confusion(text_queries.judged(spark, sf_dir)))
    sinks.write_metrics(evaluate.with_header(measured, "fixture", "2.0"), path)
    kinds = "source string, marketing_grade boolean, engine_version string, signature_count bigint, samples bigint, positives bigint, negatives bigint"
    return spark.read.schema(kinds).json(path)


@query("src_keys", "SELECT key_hash, email, requests_this_month::BIGINT AS requests_this_month, month_bucket FROM free_keys")
def src_keys(spark, sf_dir):
    """Free keys stored with more columns than the joins use, read as a dimension."""
    base = sinks.work_dir(spark)
    sinks.write_table(inputs.free_keys(spark, sf_dir).withColumn("created_by", F.lit("signup")), f"{base}/free_api_keys")
    return read_dim(spark, base, "free_api_keys").withColumn("requests_this_month", F.col("requests_this_month").cast("bigint"))


_RAW = "'live_' || sha256(email)"


@query("snk_register",
       f"WITH fresh AS (SELECT * FROM ({_SIGNED}) WHERE email NOT IN (SELECT email FROM free_keys)),"
       " firsts AS (SELECT email, min((ts, signup_id)) AS f FROM fresh GROUP BY email)"
       f" SELECT email, sha256({_RAW}) AS key_hash, left({_RAW}, 16) || '...' AS key_prefix, 0::BIGINT AS requests_this_month,"
       f" strftime(f[1], '%Y-%m') AS month_bucket, {duck_stamp('f[1]')} AS created_at FROM firsts")
def snk_register(spark, sf_dir):
    raw = F.concat(F.lit("live_"), F.sha2("email", 256))
    rows = usage.register_keys(derived(spark, sf_dir, "signups"), inputs.free_keys(spark, sf_dir), raw, prefix=16)
    stored = sinks.write_table(rows, sinks.work_dir(spark))
    return stored.withColumns({"created_at": stamp("created_at"),
                               "requests_this_month": F.col("requests_this_month").cast("bigint")})


@query("snk_leads", "SELECT signup_id, email, coalesce(source, 'landing') AS source FROM signups WHERE email IS NOT NULL")
def snk_leads(spark, sf_dir):
    path = sinks.work_dir(spark)
    rows = usage.leads(derived(spark, sf_dir, "signups").where("email IS NOT NULL"))
    sinks.export_csv(rows.select("signup_id", "email", "source"), path)
    return spark.read.option("header", True).schema("signup_id bigint, email string, source string").csv(path)


@query("snk_leads_unique",
       "WITH l AS (SELECT *, lower(trim(email)) AS mail, coalesce(source, 'landing') AS src FROM signups WHERE email IS NOT NULL)"
       " SELECT arg_min(signup_id, (ts, signup_id)) AS signup_id, mail AS email, arg_min(src, (ts, signup_id)) AS source"
       " FROM l WHERE mail NOT IN (SELECT email FROM free_keys) GROUP BY mail")
def snk_leads_unique(spark, sf_dir):
    """Leads with a unique e-mail, beside those that hold a key already."""
    path = sinks.work_dir(spark)
    rows = usage.unique_leads(derived(spark, sf_dir, "signups"), inputs.free_keys(spark, sf_dir))
    sinks.export_csv(rows.select("signup_id", "email", "source"), path)
    return spark.read.option("header", True).schema("signup_id bigint, email string, source string").csv(path)
