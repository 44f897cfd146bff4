"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: the ASCII white space that separates words.
WORD_SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is absent, a local session gets a temporary folder,
    which is written back to it; any other is refused, as its executors could
    not read such a folder.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spectraflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing URI below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage", **options) -> DataFrame:
    """Write ``df`` to the shared folder, by the writer's ``options``, and read it back.

    Cuts lineage, and makes anything that isn't reproducible (a sampled range
    partitioning, files written by tasks) happen once.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables made by ``materialise`` that nothing reads any more."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def batch_of(names: list[str], columns: list):
    """An Arrow batch of arrays (passed on as they are) and Python or numpy values with their type as (values, type)."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c[0], type=c[1]) if isinstance(c, tuple) else c for c in columns], names=names)


def slices_of(batch, most: int = 1 << 22):
    """Parts of an Arrow batch of about ``most`` bytes, a row at least, so that Python holds that much of it at a time."""
    rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI; any store pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, parts: list[bytes]) -> None:
    """Write a file under a name of its own, then move it into place, so that
    readers never see half a file and repeated task attempts don't clash."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    store.move(temporary, path)


def before(df: DataFrame, groups: list[str], order: list, fraction, slices: int, value, name: str = "__before") -> DataFrame:
    """Add the sum of ``value`` over the rows of a group that come earlier in ``order``, without one task per group.

    ``fraction`` rises with ``order`` and spreads a group's rows evenly over
    [0, 1): a seeded hash, or a rank over a count. Sums are taken inside
    ``slices`` slices of it; the slices' totals, a table of at most groups times
    slices rows, give each slice its start. Group columns hold no nulls.
    """
    keys = [*groups, "__slice"]
    cut = df.withColumn("__slice", F.least(F.floor(fraction * slices), F.lit(slices - 1)).cast("int")).withColumn("__value", value.cast("long"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("__local", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    earlier = Window.partitionBy(*groups).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys).agg(F.sum("__value").alias("__total"))
    starts = totals.select(*keys, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__start"))
    return local.join(starts, keys).withColumn(name, F.col("__start") + F.col("__local")).drop("__slice", "__value", "__local", "__start")


def seeded(seed: str, *columns):
    """Hex digits of a seeded MD5, and their place in [0, 1): a shuffle that every engine can repeat."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    digest = F.md5(text.cast("binary"))
    return digest, F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def text_digest(text):
    """MD5 of a text, null for null: tells rows of one doc_id apart, in every engine alike."""
    return F.md5(text.cast("binary"))


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
