"""Land daily CSV drops as a date-partitioned Parquet panel.

The reference re-reads each full feed on every run. Here new files dropped
in a directory are landed once into a Parquet panel partitioned by date, so
the panel pipelines read columnar data and the ``latest`` / ``trailing_days``
filters prune partitions. The stream runs with ``availableNow`` (process what
is there, then stop) and keeps its progress in a checkpoint, so a lost
executor or a rerun neither loses nor duplicates a file.

Two landing modes:

* ``"append"``: every drop holds new rows only (incremental files).
* ``"replace_dates"``: every drop is authoritative for the dates it contains
  (a feed republished in full, with corrections). Each micro-batch overwrites
  exactly those date partitions (dynamic partition overwrite), which is also
  idempotent when a batch is retried; when one batch holds several drops, a
  date is taken from the newest file that contains it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.panel import join_on


def newest_file_per_date(batch: DataFrame, date_col: str) -> DataFrame:
    """Rows of ``batch`` whose source file is the newest one holding their date.

    ``batch`` carries ``__file_time`` and ``__file``; ties on time go to the
    larger file name. The newest file per date is an aggregate (one row per
    date) joined back, so a date with many rows is never gathered in one task.
    """
    rank = F.struct("__file_time", "__file")
    newest = batch.groupBy(date_col).agg(F.max(rank).alias("__newest"))
    tagged = join_on(batch.withColumn("__rank", rank), newest, [date_col], how="inner", na_matches="na")
    return tagged.where(F.col("__rank") == F.col("__newest")).drop("__file_time", "__file", "__rank", "__newest")


def land_feed(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    panel_dir: str,
    checkpoint_dir: str | None,
    date_col: str,
    sep: str = ",",
    encoding: str = "UTF-8",
    mode: str = "replace_dates",
    max_files_per_trigger: int | None = None,
    wait: bool = True,
    reject_dir: str | None = None,
) -> StreamingQuery:
    """Land every new CSV file of ``source_dir`` into ``panel_dir`` (partitioned by ``date_col``).

    ``checkpoint_dir=None`` keeps the stream's progress under the session's
    shared ``spark.checkpoint.dir``, in a folder named after the panel path.
    In ``replace_dates`` mode rows whose date does not parse belong to no date:
    they go to ``reject_dir`` (``<panel_dir>-rejected`` by default), one folder
    per batch, so that no later batch replaces them. A file whose header
    differs from ``schema`` fails the stream.
    ``max_files_per_trigger`` bounds each micro-batch, so a backlog of drops is
    landed in several batches instead of one. A file stream needs its full
    schema up front, so ``schema`` lists the file's columns in file order
    (``scan_csv`` on landed batch files matches columns by name instead).
    """
    if mode not in ("append", "replace_dates"):
        raise ValueError("mode must be 'append' or 'replace_dates'")
    if checkpoint_dir is None:
        import hashlib

        from ..session import checkpoint_dir as shared_dir

        key = hashlib.sha1(panel_dir.encode()).hexdigest()[:16]
        checkpoint_dir = f"{shared_dir(spark).rstrip('/')}/vigie-streams/{key}"
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = (
        reader
        .option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("dateFormat", "yyyy-MM-dd")
        .option("escape", '"')          # doubled quotes inside quoted fields (RFC 4180)
        .option("enforceSchema", False)
        .csv(source_dir)
    )
    writer = stream.writeStream.option("checkpointLocation", checkpoint_dir).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", panel_dir).partitionBy(date_col).outputMode("append")
    else:
        stream = stream.select("*", F.col("_metadata.file_modification_time").alias("__file_time"),
                               F.col("_metadata.file_path").alias("__file"))

        rejected = reject_dir or f"{panel_dir.rstrip('/')}-rejected"

        def replace(batch: DataFrame, batch_id: int) -> None:
            dated = F.col(f"`{date_col}`").isNotNull()
            (newest_file_per_date(batch.where(dated), date_col).repartition(date_col).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(panel_dir))
            undated = batch.where(~dated).drop("__file_time")
            if not undated.isEmpty():  # a retried batch overwrites its own folder
                undated.withColumnRenamed("__file", "file").write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")

        writer = stream.writeStream.option("checkpointLocation", checkpoint_dir) \
            .trigger(availableNow=True).foreachBatch(replace)
    query = writer.start()
    if wait:
        query.awaitTermination()
    return query
