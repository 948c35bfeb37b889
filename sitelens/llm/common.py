"""Helpers shared by the training-data operators.

Nothing here is collected to the driver unless its size is bounded by a
documented parameter, and every intermediate that outlives a stage is written
to the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import shared_path

#: Arrow batches handed to Python workers hold at most this many rows, so a
#: batch of long documents stays within tens of megabytes.
ARROW_ROWS = 256


def session(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: small Arrow batches, bounded in bytes too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: losing executors later costs no recomputation, and a
    second reader does not repeat the work.  Unlike ``checkpoint()`` the copy is
    compressed and columnar, so readers prune columns.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z only; other letters keep their case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that do not clash with ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        cand = f"__{n}"
        while cand.lower() in taken:
            cand += "_"
        taken.add(cand.lower())
        out.append(cand)
    return out


class Recent:
    """A bounded memo of two generations: what was used lately stays."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def get_all(self, keys: list) -> list:
        """What is held for each key, or None."""
        out = list(map(self.young.get, keys))
        if self.old:
            back, again = self.old.get, {}
            for i, got in enumerate(out):
                if got is None and (got := back(keys[i])) is not None:
                    out[i] = again[keys[i]] = got
            self.put_all(again)
        return out

    def put_all(self, items):
        """Note pairs of key and value; a generation may end with as many too many."""
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young.update(items)


# Tables that operators keep in a Python worker between its tasks, by operator.
_HELD: dict[str, dict] = {}
_last_task: list = [None]


def held(owner: str) -> dict:
    """A place for what the tasks of ``owner`` keep in their worker."""
    return _HELD.setdefault(owner, {})


def lean(owner: str) -> None:
    """Where a task of ``owner`` begins: what other operators keep in this worker goes, and
    memory that earlier tasks have freed is given back to the system.

    Spark reuses Python workers, so without this each stage adds to the ones before."""
    from pyspark import TaskContext

    task = TaskContext.get()
    if task is None or task.taskAttemptId() == _last_task[0]:
        return
    _last_task[0] = task.taskAttemptId()
    for other, tables in _HELD.items():
        if other != owner:
            tables.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
