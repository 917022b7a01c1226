"""Small helpers of the operators: the cluster's shared folder and written tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and no checkpoint folder was given is one made and set, on one machine (tests); on a cluster that
    is an error, since executors do not see a folder of the driver's machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="funnelkit-llm-")
        context.setCheckpointDir(named)
    return named


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, for workers that cannot import it."""
    context = spark.sparkContext
    if getattr(context, "_funnelkit_llm_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="funnelkit-code-")) / "funnelkit.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._funnelkit_llm_shipped = True


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column) -> Column:
    """64-bit hash that tells apart the texts of rows with one doc_id; null and '' differ."""
    return F.xxhash64(F.lit(11), F.coalesce(text, F.lit("")), text.isNull())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: ASCII white space as a regular expression class, as the word rules of the contracts list it.
BLANKS = r"[\x20\x09-\x0D]"
