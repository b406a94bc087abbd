"""Shared helpers of the training-data operators: tables, scratch space, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into Python strings at once.
SLICE_BYTES = 2 << 20
#: Rows that Spark sends to a Python worker at once.
BATCH_ROWS = 1000
#: A key that more than one in so many rows have is dealt out, unless it has few rows.
PARTS, LEAST = 1000, 500


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark context, and bounds their batches."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "hedgerow_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="hedgerow-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc.hedgerow_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark alone (the path may be one that only Spark can open)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local session, whose
    executors are the driver itself, gets a folder of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="hedgerow-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    """(file system, path) of Hadoop."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one run's files in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/hedgerow-{name}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> None:
    """Scratch files that were written at a path go when the driver's JVM ends, if not before."""
    fs, at = _place(spark, path)
    fs.deleteOnExit(at)
    made(spark).append(path)


def made(spark: SparkSession) -> list[str]:
    """The scratch files that were written and that weren't deleted, oldest first."""
    sc = spark.sparkContext
    if not hasattr(sc, "hedgerow_made"):
        sc.hedgerow_made = []
    return sc.hedgerow_made


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch files that no DataFrame in use reads."""
    for path in list(paths):
        fs, at = _place(spark, path)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)
        made(spark).remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, run, schema) -> DataFrame:  # noqa: ANN001
    """df.mapInArrow, with this package sent to the workers first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def rows_of(rows: DataFrame, keys: DataFrame, on: list[str], by: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The rows whose key is among keys(*on, n, *extra), one row for each key, where n is the number of rows that have
    it; with the columns ``extra``.

    A key that over one in ``PARTS`` of these rows have is dealt out over parts by the column ``by``, so no task gets
    all of it. Fewer than PARTS keys can be so frequent, which bounds the table that is sent to all tasks. ``keys`` is
    read more than once, so it should be a stored table.
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    most = max(total // PARTS, LEAST)
    parts = F.ceil(F.col("n") / most)
    hot = keys.filter(F.col("n") > most).select(*on, parts.alias("hedgerow_parts"))
    own = F.pmod(F.xxhash64(by, F.lit(11)), F.coalesce("hedgerow_parts", F.lit(1)))
    left = rows.join(F.broadcast(hot), on, "left").withColumn("hedgerow_part", own).drop("hedgerow_parts")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > most, parts - 1).otherwise(0).cast("long")))
    right = keys.select(*on, *extra, every.alias("hedgerow_part"))
    return left.join(right, [*on, "hedgerow_part"], "inner" if extra else "left_semi").select(*rows.columns, *extra)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.names.index(text))
        lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
