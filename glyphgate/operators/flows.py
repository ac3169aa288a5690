"""Composed flows: requests from key to audit row, sign-ups from rate limit to registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphgate.functions import columns, fixed
from glyphgate.operators import admission, joins, rates, report, usage
from glyphgate.plans.scan import scan
from glyphgate.sources import sinks


def process_requests(requests: DataFrame, free: DataFrame, paid: DataFrame, subs: DataFrame, *,
                     stored: DataFrame | None = None, secret: str | bytes | None = None, limit: Column | None = None,
                     ts: str = "ts", request_id: str = "request_id", as_of_year: int | None = None) -> DataFrame:
    """Every request with its outcome and, where it is ``OK``, its signed scan.

    Keys and quota are checked first, ``stored`` counters (``key_hash``, ``requests_this_month``, ``month_bucket``) included;
    only admitted inputs are scanned, with the modules they ask for.  One row per request; :func:`audit_of` keeps the audit part.
    """
    judged = admission.classify_requests(requests, free, paid, subs, ts, request_id, limit, stored)
    text = F.when(F.col("outcome") == "OK", F.col("input"))
    narrow = judged.select(request_id, ts, "outcome", "http_status", "user_id", "key_hash", "tier", "modules", text.alias("input"))
    kept = [ts, "outcome", "http_status", "user_id", "key_hash", "tier"]
    scanned = scan(narrow, request_id, "input", modules=admission.effective_modules(F.col("modules")), keep=kept,
                   keep_text=True, as_of_year=as_of_year)
    named = report.with_ids(scanned, request_id, "input", F.col(ts))
    return report.sign(named, secret).drop("input")


def audit_of(processed: DataFrame, ts: str = "ts") -> DataFrame:
    """Audit rows of the processed requests that were scanned, with their user, key and tier."""
    done = processed.where(F.col("outcome") == "OK")
    return sinks.audit_rows(done, F.col(ts), user=F.col("user_id").cast("string"), key_hash=F.col("key_hash"), tier=F.col("tier"))


def counters_of(processed: DataFrame, ts: str = "ts") -> DataFrame:
    """What the processed requests add to the monthly counters."""
    return usage.usage_by(processed.where(F.col("outcome") == "OK"), ["key_hash"], ts)


def signup_outcomes(signups: DataFrame, free: DataFrame, ip: str = "client_ip", ts: str = "ts", signup_id: str = "signup_id",
                    rate: tuple[int, int] = fixed.SIGNUP_RATE) -> DataFrame:
    """Add ``outcome``: RATE_LIMIT_EXCEEDED, INVALID_EMAIL, CONSENT_REQUIRED, EXISTING or REGISTERED.

    Checks run in this order.  Every attempt counts against the address's limit.  The first accepted sign-up of an e-mail that holds
    no key registers it; later ones find it existing.
    """
    limited = rates.rate_limit(signups, ip, ts, signup_id, *rate).drop(
        "window_start", "position", "remaining", "retry_after_s", "reset_in_min")
    keyed = joins.lookup_join(limited.withColumn("__email", columns.norm_email(F.col("email"))),
                              free.select(F.col("email").alias("__email"), F.lit(True).alias("__known")).distinct(), "__email")
    early = (F.when(~F.coalesce("allowed", F.lit(True)), "RATE_LIMIT_EXCEEDED")
             .when(~columns.is_email_shape(F.col("email")), "INVALID_EMAIL")
             .when(~F.coalesce("consent", F.lit(False)), "CONSENT_REQUIRED").when(F.col("__known"), "EXISTING"))
    staged = keyed.withColumn("__early", early)
    first = (staged.where("__early IS NULL").groupBy("__email")
             .agg(F.min(F.struct(ts, signup_id))[signup_id].alias("__first")))
    found = joins.lookup_join(staged, first, "__email")
    last = F.when(F.col("__first") == F.col(signup_id), "REGISTERED").otherwise("EXISTING")
    return found.withColumn("outcome", F.coalesce("__early", last)).drop("allowed", "__email", "__known", "__early", "__first")


def demo_view(requests: DataFrame, input_col: str = "input", ip: str = "client_ip", ts: str = "ts", request_id: str = "request_id",
              rate: tuple[int, int] = fixed.DEMO_RATE, max_bytes: int = fixed.DEMO_INPUT_LIMIT, as_of_year: int | None = None) -> DataFrame:
    """The keyless demo: every request with ``outcome``, ``http_status``, ``remaining``, ``retry_after_s`` and the public view.

    Checks run in this order: rate limit per address, a non-empty input, the size of the input; only inputs that pass are
    scanned, and nothing but the public view of their report is shown.
    """
    limited = rates.rate_limit(requests.select(request_id, ts, ip), ip, ts, request_id, *rate).select(
        request_id, F.col("allowed").alias("__allowed"), "remaining", "retry_after_s")
    joined = requests.select(request_id, input_col).join(limited, request_id)
    outcome = (F.when(~F.coalesce("__allowed", F.lit(True)), "RATE_LIMITED")
               .when(~columns.is_valid_input(F.col(input_col)), "INVALID_INPUT")
               .when(F.octet_length(input_col) > max_bytes, "INPUT_TOO_LARGE").otherwise("OK"))
    judged = joined.withColumn("outcome", outcome).withColumn("http_status", F.when(F.col("outcome") == "OK", 200)
        .when(F.col("outcome") == "RATE_LIMITED", 429).when(F.col("outcome") == "INPUT_TOO_LARGE", 413).otherwise(400))
    shown = judged.withColumn("__text", F.when(F.col("outcome") == "OK", F.col(input_col)))
    kept = ["outcome", "http_status", "remaining", "retry_after_s"]
    scanned = scan(shown, request_id, "__text", keep=kept, as_of_year=as_of_year)
    view = report.public_view(scanned, request_id, kept)
    passed = F.col("outcome") == "OK"
    return view.select(request_id, "outcome", "http_status", F.when(passed, F.col("remaining")).alias("remaining"), "retry_after_s",
                       *[F.when(passed, F.col(c)).alias(c) for c in view.columns if c not in (request_id, *kept)])
