"""State that micro-batches add to, kept small by folding finished batches into versions.

Each micro-batch writes a folder of its own, ``batches/run=<query>/batch=<number>``.  :meth:`BatchTable.fold`
combines the newest version with the finished batches after it into ``versions/version=<n>``: rows first, then
the numbers of the batches they cover, whose finished write makes the version count.  A reader takes the newest finished version and the
finished batches that it doesn't cover, so every batch counts once at any moment.  Batch folders go away one
version late, when the version before already covers them: a reader that started before a fold still finds
all it listed.  One fold runs at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphgate.sources import files

_BATCH = re.compile(r"/run=([^/]+)/batch=(\d+)$")
_VERSION = re.compile(r"/version=(\d+)/")


def run_of(batch: DataFrame) -> str:
    """Id of the streaming query that a micro-batch belongs to; a new checkpoint makes a new one."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


class BatchTable:
    """``combine`` merges rows of any number of batches; merging merged rows gives the same."""

    def __init__(self, spark: SparkSession, path: str, combine: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.combine = spark, path.rstrip("/"), combine

    def store(self, rows: DataFrame, run: str, number: int, fold_every: int | None = None) -> str:
        """Write a batch once: a batch that comes again finds its folder finished and changes nothing."""
        folder = f"{self.path}/batches/run={run}/batch={number}"
        if not files.exists(self.spark, f"{folder}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(folder)
        if fold_every and number % fold_every == fold_every - 1:
            self.fold()
        return folder

    def _versions(self) -> list[int]:
        return sorted(int(_VERSION.search(f"{f}/")[1]) for f in files.finished(self.spark, f"{self.path}/versions/version=*/upto"))

    def _covered(self, version: int | None) -> dict[str, int]:
        if version is None:
            return {}
        upto = self.spark.read.schema("run string, batch bigint").parquet(f"{self.path}/versions/version={version}/upto")
        return {r["run"]: r["batch"] for r in upto.collect()}      # one row per query that has ever written

    def _batches(self) -> list[tuple[str, int, str]]:
        found = files.finished(self.spark, f"{self.path}/batches/run=*/batch=*")
        return [(m[1], int(m[2]), f) for f in found if (m := _BATCH.search(f))]

    def _state(self, before: tuple[str, int] | None = None) -> tuple[DataFrame | None, int | None, dict[str, int]]:
        """Merged rows, the version they start from, and the last batch of each run in them."""
        versions = self._versions()
        version = versions[-1] if versions else None
        upto = self._covered(version)
        later = [(run, n, f) for run, n, f in self._batches() if n > upto.get(run, -1) and not (before and run == before[0] and n >= before[1])]
        parts = [self.spark.read.parquet(*(f for _, _, f in later))] if later else []
        if version is not None:
            parts.append(self.spark.read.parquet(f"{self.path}/versions/version={version}/rows"))
        if not parts:
            return None, version, upto
        for run, n, _ in later:
            upto[run] = max(n, upto.get(run, -1))
        return self.combine(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])), version, upto

    def read(self) -> DataFrame:
        rows, _, _ = self._state()
        if rows is None:
            raise FileNotFoundError(f"no finished batch below {self.path}")
        return rows

    def before(self, run: str, number: int) -> DataFrame | None:
        """What the batches before one hold, for work that goes on from them; nothing before the first."""
        return self._state((run, number))[0]

    def fold(self) -> int | None:
        """Write the next version; remove batches that the version before covers, and versions older than that."""
        rows, version, upto = self._state()
        if rows is None:
            return None
        earlier = self._covered(version)
        following = 0 if version is None else version + 1
        at = f"{self.path}/versions/version={following}"
        rows.write.mode("overwrite").parquet(f"{at}/rows")
        covered = self.spark.createDataFrame(sorted(upto.items()), "run string, batch bigint")
        covered.coalesce(1).write.mode("overwrite").parquet(f"{at}/upto")
        files.remove(self.spark, [f for run, n, f in self._batches() if n <= earlier.get(run, -1)])
        files.remove(self.spark, [f"{self.path}/versions/version={v}" for v in self._versions() if v < following - 1])
        return following
