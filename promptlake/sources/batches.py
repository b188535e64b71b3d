"""Tables that grow by whole batches, each visible in all of them at once or in none.

A batch's files are written under an attempt of its own. One marker file, made last
and only if the batch has none yet, names the attempt that counts. A job that dies
between two tables leaves files that no reader sees; run again it writes a new
attempt, and of two that work on the same batch one wins.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKERS = "_batches"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names, deleted when the application ends.

    Only a local session may go without one: it gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='promptlake-')}"
    path = f"{shared.rstrip('/')}/promptlake/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


class BatchStore:
    """A folder of tables. The folder must be one that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def begin(self) -> str:
        return uuid.uuid4().hex

    def write(self, attempt: str, table: str, rows: DataFrame) -> DataFrame:
        """Write a table's part of an attempt, and read it back."""
        where = f"{self.path}/{table}/attempt={attempt}"
        rows.write.parquet(where)
        return self.spark.read.schema(rows.schema).parquet(where)

    def commit(self, attempt: str, batch: str) -> bool:
        """Make the attempt's files the batch's; False if the batch has others already."""
        jvm = self.spark.sparkContext._jvm
        marker, fs = self._hadoop(f"{self.path}/{_MARKERS}/{batch}.json")
        draft, _ = self._hadoop(f"{self.path}/{_MARKERS}/.{attempt}")
        with_text = fs.create(draft, False)
        with_text.write(bytearray(json.dumps({"attempt": attempt, "batch": batch}).encode()))
        with_text.close()
        # a rename that never replaces: it fails if the marker is there
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, marker, options)
            return True
        except Exception:
            if not fs.exists(marker):
                raise
            fs.delete(draft, False)
            return False

    def batches(self) -> set[str]:
        """Names of the committed batches."""
        where, fs = self._hadoop(f"{self.path}/{_MARKERS}")
        if not fs.exists(where):
            return set()
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return {n.removesuffix(".json") for n in names if n.endswith(".json")}

    def attempts(self) -> list[str]:
        """The attempts that count, one for each batch."""
        if not self.batches():
            return []
        rows = self.spark.read.schema("attempt string").json(f"{self.path}/{_MARKERS}/*.json")
        return sorted(r.attempt for r in rows.collect())

    def read(self, table: str, schema: str) -> DataFrame:
        """What all committed batches hold of a table; other attempts' folders aren't read."""
        known = self.attempts()
        if known:
            try:
                return self.spark.read.schema(f"{schema}, attempt string").parquet(f"{self.path}/{table}").where(F.col("attempt").isin(known)).drop("attempt")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return self.spark.createDataFrame([], schema)

    def sweep(self, table: str) -> int:
        """Delete a table's attempts that no marker names; only while nobody writes. Gives their number."""
        known = {f"attempt={a}" for a in self.attempts()}
        where, fs = self._hadoop(f"{self.path}/{table}")
        if not fs.exists(where):
            return 0
        old = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("attempt=") and s.getPath().getName() not in known]
        for path in old:
            fs.delete(path, True)
        return len(old)


__all__ = ["BatchStore", "work_path"]
