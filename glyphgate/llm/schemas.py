"""Schemas whose id columns keep the type of the input's."""

from __future__ import annotations

from pyspark.sql import types as T


def schema(ddl: str = "", **own: T.DataType) -> T.StructType:
    """Columns of given types first, then those of the DDL text."""
    return T.StructType([T.StructField(name, kind) for name, kind in own.items()] + (T.StructType.fromDDL(ddl).fields if ddl else []))
