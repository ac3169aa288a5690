"""The operators' expressions as SQL functions and views of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphgate.functions import columns
from glyphgate.operators import integrity, personal_data
from glyphgate.plans.scan import scan


def register_functions(spark: SparkSession, as_of_year: int | None = None) -> None:
    """Temporary SQL functions; the optimizer inlines their expressions.

    ``mask_value(v)``, ``sig_confidence(hits)``, ``sig_list(text)`` and ``pii_entities(text)``, and the table
    functions ``pii_rows(text)`` and ``sig_rows(text)``: ``SELECT id, r.* FROM t, LATERAL pii_rows(t.text) AS r`` gives
    the entities as rows with their ordinal, without leaving the JVM.  For large scans :func:`glyphgate.scan` is the
    faster form: it stages shared work.
    """
    ids = ", ".join(columns.sql_string(s.id) for s in integrity.SIGNATURES if s.layer == "structural")
    found = "array<struct<type:string,value:string,start:int,end:int>>"
    functions = {
        "mask_value(v STRING) RETURNS STRING": columns.mask_sql("v"),
        "sig_confidence(hits ARRAY<STRING>) RETURNS DOUBLE": integrity.confidence_sql("hits", ids),
        "sig_list(text STRING) RETURNS ARRAY<STRING>": integrity.signatures_expression("text"),
        f"pii_entities(text STRING) RETURNS {found}": personal_data.entities_expression(
            "text", personal_data.data_types(as_of_year)),
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    tables = {
        "pii_rows(text STRING) RETURNS TABLE (ordinal INT, type STRING, value STRING, start INT, end INT)":
            f"SELECT pos + 1, x.type, x.value, x.start, x.end FROM (SELECT posexplode({functions[f'pii_entities(text STRING) RETURNS {found}']}) AS (pos, x))",
        "sig_rows(text STRING) RETURNS TABLE (ordinal INT, signature STRING)":
            f"SELECT pos + 1, x FROM (SELECT posexplode({functions['sig_list(text STRING) RETURNS ARRAY<STRING>']}) AS (pos, x))",
    }
    for head, body in tables.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_scan(df: DataFrame, view: str, id_col: str, text_col: str = "text", **options) -> DataFrame:
    """Temporary view of the scan of ``df``."""
    scanned = scan(df, id_col, text_col, **options)
    scanned.createOrReplaceTempView(view)
    return scanned
