"""Intermediate tables in the folder that the whole cluster shares, and connected components over them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from glyphgate.sources.sinks import work_dir

__all__ = ["Folder", "components", "setting"]


@contextmanager
def setting(spark, name: str, value: str) -> Iterator[None]:
    """A session setting for the queries that run in here."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Folder:
    """Writes tables below a fresh shared folder and reads them back, which cuts their lineage."""

    def __init__(self, spark):
        self.spark, self.path, self.n = spark, work_dir(spark), 0

    def kept(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, folder: Folder) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for undirected edges ``a``, ``b``.

    Every round takes the smallest label among the neighbours, then the label of the label, so
    the distance to the smallest node at least halves along label chains.  Labels are combined
    before each shuffle; a node with very many edges never meets them all in one task.
    """
    both = folder.kept(edges.where("a <> b").select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*"))
    labels = folder.kept(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "other"), "other")
                .groupBy("node").agg(F.min("component").alias("near")))
        best = (labels.join(near, "node").select("node", F.col("component").alias("before"),
                                                 F.least("component", "near").alias("label")))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("root"))
        new = folder.kept(best.join(jump, "label", "left").select(
            "node", "before", F.coalesce("root", "label").alias("component")))
        labels, changed = new.select("node", "component"), new.where("before <> component").isEmpty()
        if changed:
            return labels
