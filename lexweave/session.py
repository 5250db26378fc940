"""Session defaults, Arrow batches and shared storage. Everything else is left to the cluster's own settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC keeps date arithmetic independent of the host; AQE splits skewed joins and merges small partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Rows and bytes in an Arrow batch of whole texts; a batch ends at whichever comes first, after one row at least.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 256, 16 << 20


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS, size: int = TEXT_BATCH_BYTES) -> None:
    """Bound the Arrow batches of the session for columns of whole texts. The settings stay, as plans are run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lexweave")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config("spark.driver.memory", memory).getOrCreate()


def spread(scanned: DataFrame) -> DataFrame:
    """A table as it was read, dealt over all cores if it came in fewer parts than there are (one small file is one part).
    Large tables have more parts than cores and stay as they are."""
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    return scanned.repartition(cores) if 0 < scanned.rdd.getNumPartitions() < cores else scanned


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset (tests); it
    gets a new folder of the machine then, and elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder there that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='lexweave-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lexweave/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and is computed once."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_intermediates(spark: SparkSession) -> None:
    """Delete what was written between steps. Results that are still lazy read it, so call this when they have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lexweave")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
