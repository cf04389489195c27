"""Written steps of operators that go round by round, and the measured size of a join's side."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; an own folder only where they are one process."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if (master := spark.sparkContext.master) != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} see")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="chronolith-steps-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table, reread: the lineage is cut, and a lost executor costs nothing that is done."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a control table may be broadcast, by count; a row holds a few ids and times, at most 200 bytes.
FEW = 250_000


def small(df: DataFrame) -> DataFrame:
    """Marks a narrow table for broadcast if it has at most FEW rows; else leaves the join to shuffle."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
