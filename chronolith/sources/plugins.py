"""What users plug in: hooks around a snapshot, another source for a root, notices, object stores, visitors."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def command(line: str, timeout: int = 300) -> Callable[[dict[str, str]], None]:
    """A hook that runs a shell command on the driver with the given values in its environment; a failure raises."""

    def run(values: dict[str, str]) -> None:
        subprocess.run(line, shell=True, check=True, timeout=timeout, env=os.environ | values)  # noqa: S602  the user's own command

    return run


@dataclass
class Root:
    """A root with its hooks; ``source`` is read in place of ``folder`` where the root is captured transactionally."""

    id: str
    folder: str
    source: str | None = None
    before: list[Callable[[dict[str, str]], None]] = field(default_factory=list)
    after: list[Callable[[dict[str, str]], None]] = field(default_factory=list)
    prepare: Callable[[str, dict[str, str]], None] | None = None  # an application plugin, told the phase

    def read_from(self) -> str:
        return self.source or self.folder


@contextmanager
def captured(root: Root) -> Iterator[str]:
    """The folder to scan, between the hooks; those after run even if the scan fails, so that an application is let go."""
    values = {"ROOT_ID": root.id, "ROOT_PATH": root.folder}
    for hook in root.before:
        hook(values)
    if root.prepare:
        root.prepare("begin", values)
    try:
        yield root.read_from()
    finally:
        if root.prepare:
            root.prepare("end", values)
        for hook in root.after:
            hook(values)


def scan(spark: SparkSession, root: Root) -> DataFrame:
    """The listing of a root between its hooks; the rows are taken before the hooks after it run."""
    from .io import listing

    with captured(root) as folder:
        return listing(spark, folder).withColumn("root_id", F.lit(root.id))


def notices(send: Callable[[dict[str, str]], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: one call a row with its columns as text; the rows are notices, few by their rate limit."""

    def run(batch: DataFrame, epoch: int) -> None:
        for row in batch.select(*[F.col(c).cast("string") for c in batch.columns]).toLocalIterator():
            send({k.upper(): v or "" for k, v in row.asDict().items()})

    return run


class ObjectStore(Protocol):
    """What a store has to offer."""

    def put(self, key: str, data: bytes) -> None: ...

    def get(self, key: str) -> bytes: ...

    def exists(self, key: str) -> bool: ...

    def delete(self, key: str) -> None: ...

    def keys(self, prefix: str) -> DataFrame: ...


class FolderStore:
    """A store in a folder of any file system that Spark reads; writes go to a hidden name first and are renamed."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, key: str):
        if not key or key.startswith("/") or "\\" in key or any(p in ("", ".", "..") for p in key.split("/")):
            raise ValueError(f"not a key: {key!r}")
        return self._path(f"{self._folder}/{key}")

    def put(self, key: str, data: bytes) -> None:
        target = self._at(key)
        hidden = self._path(target.getParent(), f"_{target.getName()}.part")
        out = self._fs.create(hidden, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        self._fs.delete(target, False)
        if not self._fs.rename(hidden, target):
            raise OSError(f"cannot write {key}")

    def get(self, key: str) -> bytes:
        into = self._fs.open(self._at(key))
        try:
            return bytes(into.readAllBytes())
        finally:
            into.close()

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._at(key))

    def delete(self, key: str) -> None:
        self._fs.delete(self._at(key), False)

    def keys(self, prefix: str = "") -> DataFrame:
        from .io import listing

        return listing(self._spark, self._folder).where(F.col("key").startswith(prefix))


def visit(records: DataFrame, visitor: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """``visitor`` on each record, batch by batch on the executors; a record for which it gives none drops."""
    import pyarrow as pa

    out = records.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for b in batches:
            yield pa.RecordBatch.from_pylist([x for r in b.to_pylist() if (x := visitor(r)) is not None], schema=arrow)

    return records.mapInArrow(run, schema)


def as_lines(rows: DataFrame, form: str = "text") -> DataFrame:
    """A report's rows as lines: tab-separated text, or JSON."""
    if form == "json":
        return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))
    return rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns]).alias("line"))
