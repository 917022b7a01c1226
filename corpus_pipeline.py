"""The corpus pipeline: five stages over ``documents``, each calling one operator.

quality rules -> line dedup -> SimHash near-dedup -> benchmark decontamination -> packing.
A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Between stages the result is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm import decontam, linededup, quality, queries, simhash
from funnelkit.llm.shared import documents, ship, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, or their host's verdict, reject go."""
    return quality.judge(docs).filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out of the texts; n_chars follows the text."""
    found = linededup.dedup_lines(docs)
    row = F.when(F.col("n_removed") > 0, F.col("row").withField("text", F.col("text")).withField(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))).otherwise(F.col("row"))
    return found.select(row.alias("row")).select("row.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    ship(spark)
    return simhash.representatives(docs, simhash.SHINGLE, simhash.RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    ship(spark)
    found = decontam.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("not contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row a piece."""
    return queries.packed(spark, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


#: The packing stage needs the tokenizers library, which SQL cannot call.
ORACLE_SQL = None
