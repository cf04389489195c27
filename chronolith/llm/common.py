"""Shared pieces of the text operators: shared storage, words, sizes of join sides."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[ \t\n\x0B\f\r]+"

#: Rows and bytes up to which a join side may be broadcast; both are measured.
BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 50_000_000

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` where it is set.

    Only where the setting is absent and driver and executors are one process (tests) an own folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if (master := spark.sparkContext.master) != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} see")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="chronolith-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: With these on, Spark drops a query's shuffle files as soon as the query has ended.
CLEANUP = ("spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")


#: Paths of the steps that each running operator has written.
_steps: list[list[str]] = [[]]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors.

    What the write has shuffled is dropped at its end, so the steps of an operator don't add up on disk.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _steps[-1].append(path)
    before = {k: spark.conf.get(k, None) for k in CLEANUP}
    for k in CLEANUP:
        spark.conf.set(k, "true")
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def _read_by(df: DataFrame) -> str:
    """The paths that the plan of ``df`` reads, in one string."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return " ".join(x.relation().location().rootPaths().mkString(" ") for x in found if x.getClass().getSimpleName() == "LogicalRelation" and hasattr(x.relation(), "location"))


def delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scoped(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Removes the steps that ``operator`` wrote and its result doesn't read, when it returns or fails.

    What the result reads stays for the operator around it, and past the outermost one until ``clear``.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        _steps.append([])
        read = ""
        try:
            out = operator(docs, *args, **kwargs)
            read = _read_by(out)
            return out
        finally:
            mine = _steps.pop()
            kept = [p for p in mine if p.rsplit("/", 1)[-1] in read]
            _steps[-1].extend(kept)
            delete(docs.sparkSession, [p for p in mine if p not in kept])

    return run


def clear(spark: SparkSession) -> None:
    """Removes the steps that results still read; call it when these have been used."""
    delete(spark, _steps[0])
    _steps[0].clear()


def join_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table for broadcast if its counted rows and bytes are within bounds; else leaves the join to shuffle."""
    size = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) if kind in ("string", "binary") else F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) if kind in ("array", "struct", "map") else F.lit(8))
    n, bytes_ = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and bytes_ <= BROADCAST_BYTES else df


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def words(text: Column) -> Column:
    """Words ``[^\x20\x09-\x0D]+`` of a text; null and blank texts have none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though a lambda inside ``body`` uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def part(array: Column, skip: Column | int, size: Column) -> Column:
    """``size`` elements after the first ``skip``; none where ``size`` is negative."""
    return F.slice(array, F.lit(skip) + 1, F.greatest(size, F.lit(0)).cast("int"))


def fold_pairs(a: Column, b: Column, gap: int, n: Column) -> Column:
    """Hashes of ``(a[i], b[i + gap])`` for the first ``n`` places."""
    return F.zip_with(part(a, 0, n), part(b, gap, n), lambda a, b: F.xxhash64(a, b))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running ``step`` (associative) over an array of numbers, in rounds that double the reach: n log n, and no shuffle."""
    n = F.size(values)
    rounds = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def reach(a: Column, r: Column) -> Column:
        gap = F.least(F.lit(1).cast("int") * F.pow(F.lit(2), r).cast("int"), F.size(a))
        earlier = F.concat(F.array_repeat(F.lit(None).cast("bigint"), gap), F.slice(a, F.lit(1), F.size(a) - gap))
        return F.zip_with(earlier, a, lambda x, y: F.when(x.isNull(), y).otherwise(step(x, y)))

    return F.aggregate(rounds, values.cast("array<bigint>"), reach)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bounds the Arrow batches that Python gets by rows and bytes, where the session has not; a longer text is a batch of its own."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
