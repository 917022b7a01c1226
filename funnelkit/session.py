"""SparkSession settings for tests and the benchmark (the driver brings its own session)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "funnelkit") -> SparkSession:
    """Local session: AQE on (coalescing, skew-join splitting), UI off, UTC."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_settings(input_bytes: int, partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Shuffle / scan sizing for a cluster run over ``input_bytes`` of CRM tables.

    Initial shuffle partitions are sized so each holds about ``partition_bytes``
    of scanned input (filters and column pruning only shrink that); AQE then
    coalesces small partitions toward the same advisory size and splits skewed
    ones, so a key holding a third of the rows is cut into many tasks instead
    of one.  Pass the result to ``SparkSession.builder.config(map=...)``.
    """
    partitions = max(200, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        # checkpointed funnel sides are deleted once their DataFrames are garbage-collected
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
