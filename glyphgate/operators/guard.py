"""Guard filters: which texts may reach a model, and in which form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from glyphgate.functions import fixed
from glyphgate.operators import joins
from glyphgate.operators.report import public_view  # noqa: F401  (part of this module's surface)


def fail_closed(verdict: Column, on_error: str = "block") -> Column:
    """A row whose scan gave no verdict counts as blocked (or cleared, if asked for)."""
    if on_error not in ("block", "allow"):
        raise ValueError(f"on_error must be 'block' or 'allow', not {on_error!r}")
    return F.coalesce(verdict, F.lit(fixed.VERDICTS[0] if on_error == "block" else fixed.VERDICTS[2]))


def guard(df: DataFrame, id_col: str, text_col: str = "text", keep: Sequence[str] = (),
          on_error: str = "block", **options) -> DataFrame:
    """Drop blocked rows, hand on redacted text where personal data was found, keep the rest."""
    from glyphgate.plans.scan import scan

    scanned = scan(df, id_col, text_col, keep=keep, keep_text=True, **options)
    judged = scanned.withColumn("verdict", fail_closed(F.col("verdict"), on_error))
    safe = F.coalesce("anonymized_input", text_col)
    return judged.where(F.col("verdict") != fixed.VERDICTS[0]).select(
        id_col, *keep, "verdict", safe.alias(text_col))


def guard_context(parents: DataFrame, chunks: DataFrame, key: str, chunk_id: str, text_col: str = "text",
                  parent_text: str | None = None, **options) -> DataFrame:
    """Two-level guard: chunks of a blocked parent drop, the others pass the row guard.

    The anti join comes first, so chunks of blocked parents are not scanned.
    """
    from glyphgate.plans.scan import scan

    judged = scan(parents, key, parent_text or text_col, modules=["integrity"])
    bad = judged.where(fail_closed(F.col("verdict")) == fixed.VERDICTS[0]).select(key).distinct()
    return guard(joins.lookup_join(chunks, bad, key, "left_anti"), chunk_id, text_col, keep=[key], **options)
