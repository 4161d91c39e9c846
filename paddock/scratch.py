"""Tables written to the shared checkpoint folder to cut lineage.

The folder is the one the session names in ``spark.checkpoint.dir`` (or that was
set on the context).  Only a local session without one gets a folder of its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and stream checkpoints."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = sc.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="paddock-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once and read it back, so that every later use sees the same rows."""
    path = new_path(df.sparkSession, name)
    _MADE.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, name: str = "cut") -> tuple[DataFrame, int]:
    """As ``materialise``, with the row count taken during the write."""
    seen = Observation()
    held = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return held, int(seen.get["rows"])


def _empty(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], "x int").coalesce(1).write.mode("overwrite").parquet(path)


def made(spark: SparkSession) -> int:
    """How many lineage cuts of this application are not emptied yet: a mark for ``clear``."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def clear(spark: SparkSession, since: int = 0) -> None:
    """Empty the tables ``materialise`` wrote since a mark, when nothing reads them any more.

    The caller of an operator knows when its rows are written or counted; until then a lineage
    cut may be read again.
    """
    paths = _MADE.get(spark.sparkContext.applicationId, [])
    for path in paths[since:]:
        _empty(spark, path)
    del paths[since:]


class Scratch:
    """Tables that one job writes and reads again; emptied when it ends.

    Rows that a caller gets lazily must not come from here.  A table is emptied by overwriting
    it with no rows, which needs nothing but Spark's own writer, on any file system.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in list(self.paths):
            self.drop(path)

    def write(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.name)
        self.paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, table: DataFrame | str) -> None:
        path = table if isinstance(table, str) else table.scratch_path
        self.paths.remove(path)
        _empty(self.spark, path)
