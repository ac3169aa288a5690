"""Queries of rules as tables, sketches, retention by partitions, repair, the demo flow and SQL table functions."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import functions as F

from glyphgate import sql
from glyphgate.functions import fixed
from glyphgate.operators import evaluate, flows, joins, rules
from glyphgate.plans import inputs, oracle, text_queries, usage_queries
from glyphgate.plans.inputs import AS_OF_YEAR, derived, table
from glyphgate.plans.registry import query
from glyphgate.sources import retention, sinks

AUDIT_AS_OF, LOGS_AS_OF = datetime(2024, 4, 20, tzinfo=timezone.utc), datetime(2024, 2, 20, 6, tzinfo=timezone.utc)
_TEXT_TABLE = "glyphgate_texts"


# --- rules as a table ------------------------------------------------------------------

def _rule_rows() -> list[tuple]:
    """200 rules from the payloads: pairs of neighbouring words first, then words before a number or a word."""
    words = [re.findall(r"[A-Za-z]{3,}", p) for p in inputs.PAYLOADS]
    pairs = [rf"\b{a}\W+{b}\b" for ws in words for a, b in zip(ws, ws[1:])]
    singles = [rf"\b{w}[ :]+[a-z0-9]+" for ws in words for w in ws]
    patterns = list(dict.fromkeys([*pairs, *singles]))[:200]
    return [(f"R{k:03d}", "structural" if k % 2 else "semantic", p, k % 3 > 0, k % 7, None) for k, p in enumerate(patterns)]


def _custom_sql() -> str:
    listed = sorted(_rule_rows(), key=lambda r: (r[4], r[0]))
    cases = ", ".join(f"CASE WHEN regexp_matches(text, {oracle.lit(('(?i)' if fold else '') + p)}) THEN '{i}' END"
                      for i, _, p, fold, _, _ in listed)
    return f"SELECT doc_id, concat_ws('|', {cases}) AS hits FROM texts"


@query("scan_custom", _custom_sql())
def scan_custom(spark, sf_dir):
    """A rule table of 200 rules; each pattern runs only behind literals that it implies."""
    given = spark.createDataFrame(_rule_rows(), rules.RULE_SCHEMA)
    found = rules.scan_rules(text_queries.texts(spark, sf_dir), "doc_id", "text", rules.compile_rules(given.collect()))
    return found.select("doc_id", F.array_join("signatures", "|").alias("hits"))


# --- sketches --------------------------------------------------------------------------

@query("agg_pct_sketch", "SELECT event_type, p, count(*) AS n, TRUE AS within FROM events, (VALUES (50), (95), (99)) v(p) GROUP BY ALL")
def agg_pct_sketch(spark, sf_dir):
    """Percentiles from sketches stored per day, against the exact rank of what they give (at most 1 % off)."""
    events = table(spark, sf_dir, "events").withColumn("dt", F.to_date("ts"))
    stored = sinks.write_table(evaluate.sketches(events, "value", ["dt", "event_type"]), sinks.work_dir(spark))
    given = evaluate.sketch_percentiles(stored, by=["event_type"])
    pairs = given.select("event_type", "n", F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), F.col(f"p{p}").alias("at")) for p in (50, 95, 99)])).alias("x")).select("event_type", "n", "x.*")
    ranked = (events.select("event_type", "value").join(F.broadcast(pairs), "event_type")      # three rows per type
              .groupBy("event_type", "p", "n").agg(F.sum((F.col("value") < F.col("at")).cast("long")).alias("below"),
                                                   F.sum((F.col("value") <= F.col("at")).cast("long")).alias("upto")))
    target = F.col("p") * F.col("n") / 100
    return ranked.select("event_type", "p", "n", ((F.col("below") <= target + 0.01 * F.col("n") + 1)
                                                  & (F.col("upto") >= target - 0.01 * F.col("n") - 1)).alias("within"))


# --- retention -------------------------------------------------------------------------

def _retained(spark, sf_dir, as_of: datetime, days: int):
    path = sinks.work_dir(spark)
    usage_queries.requests(spark, sf_dir).select("request_id", "ts", F.to_date("ts").alias("dt")).write.partitionBy("dt").parquet(path)
    retention.drop_expired(spark, path, as_of, "ts", days)
    return spark.read.schema("request_id bigint, ts timestamp, dt date").parquet(path).select("request_id")


def _retention_sql(as_of: datetime, days: int) -> str:
    return f"SELECT request_id FROM requests WHERE ts >= TIMESTAMP '{as_of:%Y-%m-%d %H:%M:%S}' - INTERVAL {days} DAY"


@query("flt_retention_parts", _retention_sql(AUDIT_AS_OF, 90))
def flt_retention_parts(spark, sf_dir):
    """Audit rows older than 90 days leave a table of days: whole days unread, rows in the boundary day."""
    return _retained(spark, sf_dir, AUDIT_AS_OF, fixed.AUDIT_RETENTION_DAYS)


@query("flt_retention_logs", _retention_sql(LOGS_AS_OF, 30))
def flt_retention_logs(spark, sf_dir):
    """The same for server logs, which stay 30 days."""
    return _retained(spark, sf_dir, LOGS_AS_OF, fixed.LOG_RETENTION_DAYS)


# --- repair ----------------------------------------------------------------------------

@query("set_repair",
       "WITH s AS (SELECT *, lower(trim(email)) AS mail FROM signups WHERE email IS NOT NULL)"
       " SELECT mail, arg_min(signup_id, (ts, signup_id)) AS signup_id, count(*) - 1 AS dropped FROM s GROUP BY mail")
def set_repair(spark, sf_dir):
    """Sign-ups made unique by e-mail: the earliest stays."""
    rows = (derived(spark, sf_dir, "signups").where("email IS NOT NULL")
            .select(F.lower(F.trim("email")).alias("mail"), "ts", "signup_id"))
    kept, report = joins.repair(rows, ["mail"], ["ts", "signup_id"])
    return joins.lookup_join(kept, report.select("mail", "dropped"), "mail").select(
        "mail", "signup_id", F.coalesce("dropped", F.lit(0)).alias("dropped"))


# --- demo ------------------------------------------------------------------------------

_DEMO = ("SELECT doc_id AS request_id, TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(doc_id * 500) AS ts, doc_id % 5 AS ip, text FROM texts")
_DEMO_SQL = (
    f"WITH {text_queries.REP}, demo_log AS ({_DEMO}), lim AS ("
    + usage_queries._rate_sql("ip", 20, 60_000).replace("WITH o AS", "WITH RECURSIVE o AS").replace("FROM requests", "FROM demo_log")
    + "), lab AS (SELECT doc_id, string_agg(" + text_queries._DATA_LABEL_SQL + ", '|' ORDER BY s) AS pii, arg_min("
    + text_queries._DATA_LABEL_SQL + ", s) AS first FROM ents GROUP BY doc_id),"
    f" cats AS (SELECT *, list_transform(sigs, lambda s: {text_queries._LABEL_SQL}) AS c FROM rep),"
    " decided AS (SELECT *, CASE WHEN NOT allowed THEN 'RATE_LIMITED' WHEN trim(text) = '' THEN 'INVALID_INPUT'"
    " WHEN strlen(text) > 4096 THEN 'INPUT_TOO_LARGE' ELSE 'OK' END AS outcome FROM demo_log JOIN lim USING (request_id))"
    " SELECT request_id, outcome, CASE WHEN outcome = 'OK' THEN remaining END AS remaining, retry_after_s,"
    " CASE WHEN outcome = 'OK' THEN verdict END AS verdict,"
    " CASE WHEN outcome = 'OK' THEN coalesce(c[1], first, 'No threat detected') END AS primary_category,"
    " CASE WHEN outcome = 'OK' THEN array_to_string(c, '|') END AS categories_matched"
    " FROM decided JOIN cats ON cats.doc_id = request_id LEFT JOIN lab ON lab.doc_id = request_id")


@query("demo_view", _DEMO_SQL)
def demo_view(spark, sf_dir):
    """The keyless demo over the texts: two requests a second from five addresses."""
    log = text_queries.texts(spark, sf_dir).select(
        F.col("doc_id").alias("request_id"), F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("doc_id") * 500).alias("ts"),
        (F.col("doc_id") % 5).alias("client_ip"), F.col("text").alias("input"))
    seen = flows.demo_view(log, as_of_year=AS_OF_YEAR)
    return seen.select("request_id", "outcome", F.col("remaining").cast("bigint").alias("remaining"),
                       F.col("retry_after_s").cast("bigint").alias("retry_after_s"), "verdict", "primary_category",
                       F.array_join("categories_matched", "|").alias("categories_matched"))


# --- SQL -------------------------------------------------------------------------------

@query("sql_pii_rows", f"WITH {oracle.entity_ctes(AS_OF_YEAR, 'turns', 'turn_id')}"
                       f" SELECT turn_id, type, {oracle.MASK} AS value, s AS start, e AS \"end\" FROM ents")
def sql_pii_rows(spark, sf_dir):
    """Entities as rows of the table function."""
    sql.register_functions(spark, AS_OF_YEAR)
    derived(spark, sf_dir, "turns").createOrReplaceTempView(_TEXT_TABLE)
    return spark.sql(f"SELECT turn_id, r.type, r.value, CAST(r.start AS BIGINT) AS start, CAST(r.end AS BIGINT) AS end"
                     f" FROM {_TEXT_TABLE} t, LATERAL pii_rows(t.text) AS r")
