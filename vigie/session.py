"""Session settings the pipelines are written for, and the shared lineage folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the size checks: a join side is broadcast only when
# the bytes measured after its shuffle stage are under the adaptive threshold,
# otherwise the join stays sort-merge; skewed partitions of a sort-merge join
# are split; small shuffle partitions are coalesced.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # checkpoint files of ``reuse`` are removed once their DataFrame is gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 128 << 20,
                 shuffle_bytes: int | None = None) -> dict[str, str]:
    """Partition sizing for a run over ``input_bytes`` of Parquet on ``total_cores`` task slots.

    Shuffles are sized by what they move, not by what is scanned: the
    aggregates here are partial before their shuffle, so ``shuffle_bytes``
    defaults to a fiftieth of the input. Each initial partition then holds about
    ``target_partition_bytes``, with at least two per core; AQE coalesces small
    ones and splits skewed ones. E.g. 100 TB on 8000 cores gives 16,000 shuffle
    partitions. Pass ``shuffle_bytes`` for joins that move whole tables.
    """
    shuffle_bytes = input_bytes // 50 if shuffle_bytes is None else shuffle_bytes
    partitions = max(2 * total_cores, -(-shuffle_bytes // target_partition_bytes))
    return {
        **RECOMMENDED_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "vigie",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the benchmark (UI off)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; without one this raises."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set")
    return d


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, through the store's own client."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def reuse(df: DataFrame) -> DataFrame:
    """A derived table that a plan reads several times, computed once.

    When the session names a shared ``spark.checkpoint.dir`` (a cluster, or a
    test that set one), the table is checkpointed there eagerly: later reads
    hit the written files, lineage is cut, and a lost executor costs a re-read,
    not a re-derivation. Without one, the lazy plan is returned unchanged
    (never a machine-local folder, never ``localCheckpoint``).
    """
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df
    return df.checkpoint(eager=True)
