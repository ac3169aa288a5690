"""The scan: text table in, verdict table out.

One chain of projections, no shuffle.  The stages are separate selects on purpose:
verdict, score, redaction and digest all read the hit and span arrays, and array
functions are not code-generated, so computing the arrays once and referring to
them keeps every pattern to a single evaluation per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from glyphgate.functions import fixed
from glyphgate.operators import integrity, joins, personal_data, report

ENTITY_ARRAY = "array<struct<type:string,value:string,start:int,end:int>>"


def _selected(modules: Column | None, name: str) -> Column | None:
    """Whether a per-row module list asks for a module; an empty or missing list asks for all."""
    if modules is None:
        return None
    return F.coalesce(F.size(modules), F.lit(0)).isin(0, -1) | F.coalesce(F.array_contains(modules, name), F.lit(False))


def parse_modules(modules: str | Sequence[str]) -> list[str]:
    """Module names from a list or a comma-separated setting."""
    names = modules.split(",") if isinstance(modules, str) else modules
    return [n.strip() for n in names if n.strip()]


def scan(df: DataFrame, id_col: str, text_col: str = "text", *,
         modules: str | Sequence[str] | Column = fixed.MODULES,
         keep: Sequence[str] = (), keep_text: bool = False,
         as_of_year: int | None = None, offsets: str = "utf16", mode: str = "redact",
         sigs: Sequence[integrity.Signature] = integrity.SIGNATURES,
         types: Sequence[personal_data.DataType] | None = None) -> DataFrame:
    """Scan every text and return one row per input row.

    Columns: the id, ``keep``, the text if asked for, then ``signatures``, ``entities``,
    ``confidence``, ``verdict``, ``anonymized_input`` (null without personal data) and
    ``sha256``.  A null text has a null verdict.

    ``modules`` is a list (or comma-separated string), or a column with a list per row.
    An empty list means both; unknown names run nothing.
    """
    types = types or personal_data.data_types(as_of_year)
    per_row = modules if isinstance(modules, Column) else None
    wanted = fixed.MODULES if per_row is not None else (parse_modules(modules) or fixed.MODULES)
    columns = list(dict.fromkeys([id_col, *keep, text_col]))
    out = [c for c in columns if keep_text or c != text_col or c in (id_col, *keep)]
    text = F.col(f"`{text_col}`")

    base = df.select(*columns, *([per_row.alias("__modules")] if per_row is not None else []))
    row_modules = F.col("__modules") if per_row is not None else None
    if "integrity" in wanted:
        base = integrity.signatures(base, text_col, sigs, "signatures", _selected(row_modules, "integrity"))
    else:
        base = base.withColumn("signatures", F.array().cast("array<string>"))
    if "privacy" in wanted:
        base = personal_data.find(base, text_col, types, _selected(row_modules, "privacy"))
        listed = personal_data.entities("__found", text_col, types, offsets)
        clean = personal_data.redacted(text_col, "__found", types, mode)
    else:
        listed, clean = F.array().cast(ENTITY_ARRAY), F.lit(None).cast("string")
    staged = base.select(
        *columns, "signatures", listed.alias("entities"), clean.alias("anonymized_input"),
        integrity.confidence("signatures", [s.id for s in sigs if s.layer == "structural"]).alias("confidence"))
    judged = staged.withColumn(
        "verdict", F.when(text.isNotNull(), report.verdict(F.col("signatures"), F.col("entities"))))
    return judged.select(
        *out, "signatures", "entities", "confidence", "verdict", "anonymized_input",
        report.digest(F.col("verdict"), F.col("signatures"), F.col("entities")).alias("sha256"))


def scan_hybrid(df: DataFrame, id_col: str, text_col: str = "text", **options) -> DataFrame:
    """Signatures on all rows first, personal data only on rows that are not blocked.

    Blocked rows carry no entities.  The second pass is a per-row condition on the first
    pass's hits, so the table is read once and nothing is unioned or shuffled.
    """
    sigs = options.get("sigs", integrity.SIGNATURES)
    keep = options.pop("keep", ())
    columns = list(dict.fromkeys([id_col, *keep, text_col]))
    first = integrity.signatures(df.select(*columns), text_col, sigs, "__first")
    second = F.when(F.size("__first") > 0, F.array(F.lit("integrity"))).otherwise(F.array(F.lit("privacy")))
    done = scan(first, id_col, text_col, modules=second, keep=[*keep, "__first"],
                sigs=[], **{k: v for k, v in options.items() if k != "sigs"})
    blocked = F.size("__first") > 0
    structural = [s.id for s in sigs if s.layer == "structural"]
    judged = (done.withColumn("signatures", F.col("__first"))
              .withColumn("confidence", integrity.confidence("__first", structural))
              .withColumn("verdict", F.when(blocked, fixed.VERDICTS[0]).otherwise(F.col("verdict"))))
    return judged.withColumn(
        "sha256", report.digest(F.col("verdict"), F.col("signatures"), F.col("entities"))).drop("__first")


def scan_dedup(df: DataFrame, id_col: str, text_col: str = "text", **options) -> DataFrame:
    """Scan each distinct text once and give every copy its result.

    Texts are matched by SHA-256.  One row per digest survives the map-side part of the
    deduplication, so many copies of one text never meet in one task; the way back is a
    lookup join that spreads frequent digests.
    """
    tagged = df.select(id_col, F.col(f"`{text_col}`").alias("__text"), F.coalesce(F.sha2(f"`{text_col}`", 256), F.lit("")).alias("__digest"))
    distinct = tagged.groupBy("__digest").agg(F.any_value("__text").alias(text_col))
    results = scan(distinct, "__digest", text_col, **options)
    return joins.lookup_join(tagged.select(id_col, "__digest"), results, "__digest").drop("__digest")
