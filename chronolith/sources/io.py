"""Listings, document queues, bundles, commits and sinks."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fnmatch import fnmatchcase

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """key (relative to ``folder``), size, modified (epoch seconds) of all files below it, empty ones too; contents are not read.

    Spark's own file sources pass over empty files; Hadoop's listing, which the driver pages through by folder, has them.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(fs_path).toString().rstrip("/") + "/"
    folders = [fs_path]
    rows = []
    while folders:
        for s in fs.listStatus(folders.pop()):
            if s.isDirectory():
                folders.append(s.getPath())
            elif fnmatchcase(s.getPath().getName(), pattern):
                rows.append((s.getPath().toString().removeprefix(base), s.getLen(), s.getModificationTime() // 1000))
    return spark.createDataFrame(rows, "key string, size bigint, modified bigint")


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """key, size, content, oid (SHA-256) of all files below a folder; empty ones from their listing, as their content is known."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(fs_path).toString().rstrip("/") + "/"
    full = files.select(F.replace("path", F.lit(base), F.lit("")).alias("key"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("oid")).where("size > 0")
    none = listing(spark, folder, pattern).where("size = 0").select("key", "size", F.lit(b"").alias("content"), F.sha2(F.lit(b""), 256).alias("oid"))
    return full.unionByName(none)


def byte_range(content, start: int, length: int):
    """A slice of a binary column."""
    return F.substring(content, start + 1, length)


def live_scan(listed: DataFrame, snapshot: DataFrame, hashed: DataFrame) -> DataFrame:
    """key, oid of live files: the snapshot's where size and time agree, else that of ``hashed``; only changed files need hashing."""
    known = snapshot.select("key", F.col("oid").alias("known"), F.col("size").alias("ks"), F.col("modified").alias("km"))
    j = listed.join(known, "key", "left").withColumn("same", (F.col("size") == F.col("ks")) & (F.col("modified") == F.col("km")))
    return j.join(hashed.select("key", F.col("oid").alias("fresh")), "key", "left").select("key", "size", F.when(F.col("same"), F.col("known")).otherwise(F.col("fresh")).alias("oid"))


def json_queue(spark: SparkSession, folder: str, schema: str, order: list[str]) -> DataFrame:
    """The documents ``*.json`` of a folder that fit the schema, in order; ``rejected_documents`` counts the others."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder).orderBy(*order)


def rejected_documents(spark: SparkSession, folder: str, schema: str) -> int:
    fields = T._parse_datatype_string(schema).add("_bad", "string")
    d = spark.read.schema(fields).option("mode", "PERMISSIVE").option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(folder)
    # the fields are read too, as a scan of the bad column alone is refused
    return d.agg(F.count_if(F.col("_bad").isNotNull()), *[F.count(c) for c in fields.names if c != "_bad"]).first()[0]


def json_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The same queue as a stream, with the file that each row came from."""
    return spark.readStream.schema(schema).json(folder).withColumn("source_key", F.input_file_name())


def export_tables(tables: dict[str, DataFrame], folder: str, drop: dict[str, list[str]] | None = None) -> None:
    """One Parquet folder for each table; ``drop`` names columns to leave out (a compact export has no embedded documents)."""
    for name, df in tables.items():
        df.drop(*(drop or {}).get(name, [])).write.mode("overwrite").parquet(f"{folder}/{name}")


def import_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def union_hosts(hosts: dict[str, DataFrame]) -> DataFrame:
    """Tables of several hosts with a host column; columns that a host lacks are null."""
    out = None
    for name, df in sorted(hosts.items()):
        one = df.withColumn("host", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


OPERATION = "id string, kind string, before_snapshot string, after_snapshot string"


def encode_operations(ops: DataFrame) -> DataFrame:
    """One JSON line for each operation, with its length in front as a check against torn lines."""
    line = F.to_json(F.struct("id", "kind", "before_snapshot", "after_snapshot"))
    return ops.select(F.concat_ws(" ", F.octet_length(line).cast("string"), line).alias("line"))


def decode_operations(lines: DataFrame) -> DataFrame:
    """The operations of a log; a line that is torn or no operation raises."""
    size, line = F.split_part("line", F.lit(" "), F.lit(1)).try_cast("int"), F.expr("substring(line, locate(' ', line) + 1)")
    whole = (F.octet_length(line) == size) & F.from_json(line, OPERATION).id.isNotNull()
    checked = F.when(F.coalesce(whole, F.lit(False)), line).otherwise(F.raise_error(F.concat(F.lit("not an operation: "), F.substring("line", 1, 80))).cast("string"))
    return lines.select(F.from_json(checked, OPERATION).alias("op")).select("op.*")


def import_rows(table: DataFrame, imported: DataFrame, key: list[str]) -> DataFrame:
    """A table with imported rows in place of those of the same key; rows that repeat a key count once."""
    from ..operators.mutation import upsert

    return upsert(table, imported.dropDuplicates(key).select(*table.columns), key)


def import_journal(local: DataFrame, remote: DataFrame, key: str = "event_id") -> DataFrame:
    """A journal with the rows of a remote one that it lacks."""
    from ..operators.mutation import insert_or_ignore

    return insert_or_ignore(local, remote.dropDuplicates([key]), [key])


def _claim(fs, path) -> bool:
    """Makes a file only where there is none. Stores do so in one step; Hadoop's local files don't, the system's own call does."""
    uri = path.getFileSystem(fs.getConf()).makeQualified(path).toUri()
    try:
        if uri.getScheme() == "file":
            os.makedirs(os.path.dirname(uri.getPath()), exist_ok=True)
            os.close(os.open(uri.getPath(), os.O_CREAT | os.O_EXCL))
        else:
            fs.create(path, False).close()
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if fs.exists(path):
            return False
        raise e
    return True


@contextmanager
def locked(spark: SparkSession, folder: str, wait: float = 60.0) -> Iterator[None]:
    """One writer of a table at a time, marked by a file that is made only where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_writer")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    until = time.monotonic() + wait
    while not _claim(fs, path):
        if time.monotonic() > until:
            raise TimeoutError(f"another writer holds {folder}; remove {path.toString()} if it is gone")
        time.sleep(0.2)
    try:
        yield
    finally:
        fs.delete(path, False)


def put_if_absent(new: DataFrame, folder: str, key: str) -> int:
    """Appends the rows whose key the table at ``folder`` lacks; writing again adds nothing, nor do two writers at once. Gives the number added."""
    spark = new.sparkSession
    with locked(spark, folder):
        new.limit(0).write.mode("append").parquet(folder)  # so that it exists
        there = spark.read.schema(new.schema).parquet(folder)
        before = there.count()
        new.dropDuplicates([key]).join(there.select(key), key, "left_anti").select(*new.columns).write.mode("append").parquet(folder)
        return spark.read.schema(new.schema).parquet(folder).count() - before


def idempotent_sink(folder: str, key: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch that is replayed adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        put_if_absent(batch, folder, key)

    return write


def append_audit(ops: DataFrame, folder: str) -> None:
    """Appends operations as JSON lines."""
    ops.write.mode("append").json(folder)


def same_trees(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of records have the same trees, by one join of a row a root."""
    from ..operators.history import tree_ids

    x, y = (tree_ids(df.withColumn("snapshot_id", F.lit(""))).select("root_id", "tree_id", "file_count") for df in (a, b))
    return x.exceptAll(y).unionByName(y.exceptAll(x)).isEmpty()


def commit(records: DataFrame, parent: DataFrame | None, folder: str, snapshot_id: str) -> bool:
    """Writes a snapshot unless its records equal the parent's; the caller then flips the ref. True if written.

    The rows go to a hidden folder first, which is renamed as a whole: readers see all of a snapshot or
    nothing, and of two writers of one id the later rename fails and its rows go. A retry of a snapshot that
    is there writes nothing.
    """
    spark = records.sparkSession
    if parent is not None and same_trees(records, parent):
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    target = path(f"{folder}/snapshot_id={snapshot_id}")
    if fs.exists(target):
        return False
    hidden = path(f"{folder}/_new-{snapshot_id}-{uuid.uuid4().hex}")
    records.write.partitionBy("root_id").parquet(hidden.toString())
    if not fs.exists(target) and fs.rename(hidden, target):
        return True
    fs.delete(hidden, True)
    return False


def carried_forward(records: DataFrame, parent: DataFrame, skipped_roots: list[str], deleted_roots: list[str]) -> DataFrame:
    """Records with those of skipped roots taken from the parent; deleted roots go."""
    old = parent.where(F.col("root_id").isin(skipped_roots) & ~F.col("root_id").isin(deleted_roots))
    return records.where(~F.col("root_id").isin(skipped_roots + deleted_roots)).unionByName(old.select(*records.columns))


def cached_listing(saved: DataFrame, now: int, ttl: int = 60) -> DataFrame:
    """A saved listing with ``exact``: whether it is at most ``ttl`` seconds old; a stale one is used, marked inexact."""
    return saved.withColumn("exact", F.lit(now) - F.col("fetched_at") <= ttl)


def metrics(*frames: tuple[str, DataFrame]) -> DataFrame:
    """metric, labels, value: each frame's last column is the value, the others are labels."""
    out = None
    for name, df in frames:
        *labels, value = df.columns
        pairs = [x for c in labels for x in (F.lit(c), F.col(c).cast("string"))]
        m = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        one = df.select(F.lit(name).alias("metric"), m.alias("labels"), F.col(value).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def exposition(rows: DataFrame) -> DataFrame:
    """One text line for each metric row, labels escaped and sorted."""
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e.key, F.lit('="'), esc(e.value), F.lit('"'))))
    inner = F.array_join(pairs, ",")
    return rows.select(F.concat("metric", F.when(inner != "", F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(F.lit("")), F.lit(" "), F.col("value").cast("string")).alias("line"))
