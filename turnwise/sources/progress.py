"""Progress log with exactly-once appends: data files per attempt, and a manifest that names the ones that count.

An append writes the rows of (run, batch) to a folder of their own and then one manifest row with the folder's
name. A writer that dies in between leaves a folder that no manifest row names; it is never read, and the
append that is tried again writes another one. An append of a (run, batch) that the manifest has already does
nothing, so the sink of a stream may repeat batches. If two writers race with the same (run, batch), the first
manifest row counts.

Each row carries its number within its append (``local_no``, in the given order). ``line_no``, the position in the
whole log, is that number plus the rows of all appends that were committed before; it does not depend on
file names or on how Spark packs files into tasks.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import ordinal

MANIFEST = "run_id string, batch_id long, attempt string, n_rows long, committed_at long"


@dataclass
class ProgressLog:
    """The log in the folder ``path`` (storage that all executors share)."""

    spark: SparkSession
    path: str

    def manifest(self) -> DataFrame:
        """``MANIFEST`` plus ``first_line``: the appends that count, one per (run, batch), the first commit of each."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], MANIFEST)
        one = Window.partitionBy("run_id", "batch_id").orderBy("committed_at", "attempt")
        rows = rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
        # one row per append: a running sum over the manifest, not over the log
        earlier = Window.orderBy("committed_at", "attempt").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("first_line", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)))

    def committed(self, run_id: str, batch_id: int) -> bool:
        return not self.manifest().filter((F.col("run_id") == run_id) & (F.col("batch_id") == batch_id)).isEmpty()

    def append(self, docs: DataFrame, run_id: str, batch_id: int = 0, order: Sequence[str] = ()) -> bool:
        """Append ``docs`` once as (run, batch); False if that was done before. ``order`` numbers the rows (by default
        all columns that can be ordered)."""
        if self.committed(run_id, batch_id):
            return False
        attempt = uuid.uuid4().hex
        order = list(order) or [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
        folder = f"{self.path}/data/attempt={attempt}"
        ordinal(docs, order, [], "local_no").write.mode("error").parquet(folder)
        n = self.spark.read.parquet(folder).count()
        self._commit(run_id, batch_id, attempt, n)
        return True

    def _commit(self, run_id: str, batch_id: int, attempt: str, n: int) -> None:
        row = [(run_id, batch_id, attempt, n, time.time_ns() // 1000)]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def read(self) -> DataFrame:
        """All rows that count, with ``run_id, batch_id, local_no, line_no``."""
        counted = self.manifest().filter("n_rows > 0").select("attempt", "run_id", "batch_id", "first_line")
        if counted.isEmpty():
            raise FileNotFoundError(f"no committed rows in {self.path}")
        rows = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/data").withColumn(
            "attempt", F.col("attempt").cast("string"))
        return (rows.join(counted, "attempt").withColumn("line_no", F.col("first_line") + F.col("local_no"))
                .drop("attempt", "first_line"))

    def sink(self, run_id: str, order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: each micro-batch counts once, however often it is tried."""
        def write(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, run_id, batch_id, order)
        return write
