"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from glyphgate import scan
from glyphgate.plans.catalog import QUERIES
from glyphgate.plans.inputs import derived

HEADLINE = (
    "scan_full", "scan_verdict", "scan_pages", "scan_dedup", "scan_hybrid", "sig_all", "pii_entities", "pii_redact",
    "pii_pseudo", "flt_guard", "flt_guard_ctx", "adm_outcome", "win_admit", "win_rate", "win_rate_hot",
    "win_latest_sub", "agg_usage_key", "agg_quota", "agg_pct", "agg_metrics", "snk_audit", "str_scan",
    "req_pipeline", "signup_outcome", "scan_custom", "pii_tokenize_text", "snk_upsert",
)
RUNS = 3


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("glyphgate-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def measure(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def short_prompts(spark: SparkSession, sf_dir: str) -> float:
    """Milliseconds of a full scan per prompt, over 40 copies of the conversations' turns: prompts as short as published figures assume."""
    turns = (derived(spark, sf_dir, "turns").selectExpr("turn_id", "text", "explode(sequence(0, 39)) AS copy")
             .selectExpr("turn_id * 64 + copy AS turn_id", "text").repartition(4 * spark.sparkContext.defaultParallelism).persist())
    n = turns.count()
    start = time.perf_counter()
    scan(turns, "turn_id").write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - start
    turns.unpersist()
    return 1000 * took / max(n, 1)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    best = {name: min(measure(spark, name, sf_dir) for _ in range(RUNS)) for name in HEADLINE}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, chars = docs.selectExpr("count(*)", "sum(length(text))").first()
    seconds = best["scan_full"]
    short = min(short_prompts(spark, sf_dir) for _ in range(RUNS))
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(best.values()), 3), "unit": "sec",
        "queries": {name: round(sec, 3) for name, sec in best.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "scan_texts_per_sec": round(rows / seconds), "scan_mchars_per_sec": round(chars / seconds / 1e6, 2),
        "scan_ms_per_text": round(1000 * seconds / rows, 4), "scan_ms_per_short_prompt": round(short, 4),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
