"""URL filter: listed rules first, else logistic regression on hashed character n-grams.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path goes
on up to ``?``, ``#`` or the end.  A rule names a host and a path; it fits that host and all its subdomains if
the path starts with the rule's; the longest fitting rule decides.  All other urls are judged by a model of
hashed character n-grams (``SIZES``) of host and path, trained from a small table of labelled urls.

The labelled table of the query is ``url_labels.LABELLED``: 120 made-up urls under reserved names, half of them to block.  The
rules' verdicts teach the model nothing.  Training and judging are Spark ML, on the JVM; the model has ``FEATURES`` weights.

Null urls and urls without ``://`` have an empty host and path, fit no rule, and are allowed: there is nothing
to judge.  With labels of one verdict only, that verdict is given; without any, all is allowed.  Repeated
rows are judged alike.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.shared import written
from funnelkit.llm.url_labels import LABELLED

#: Fixed values: (rule, verdict).
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
SIZES = (3, 4, 5)
FEATURES = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule, or null."""
    longest_first = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    fits = []
    for rule, _ in longest_first:
        name, _, rest = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule)))
    return F.coalesce(F.lit(None).cast("string"), *fits)


def verdict_column(rule: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(F.lit(None).cast("string"), *[F.when(rule == name, F.lit(verdict)) for name, verdict in rules])


def with_grams(parts: DataFrame) -> DataFrame:
    """``parts`` with ``features``: hashed n-grams of host and path, each with a mark of where it stands."""

    def grams(text: Column, mark: str) -> list[Column]:
        bounded = F.concat(F.lit("^"), text, F.lit("$"))
        return [F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(bounded) - (n - 1), F.lit(1))),
                            lambda i: F.concat(F.lit(mark), F.substr(bounded, i, F.lit(n)))) for n in SIZES]

    joined = parts.withColumn("grams", F.array_distinct(F.concat(*grams(F.col("host"), "h"), *grams(F.col("path"), "p"))))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(joined).drop("grams")


def fit(labelled: DataFrame):
    """A model of ``labelled`` (host, path, label: 1 to block, 0 to allow), or the one label there is, or None."""
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows at most
    if len(counts) < 2:
        return next(iter(counts), None)
    trained = LogisticRegression(maxIter=40, regParam=1e-4, standardization=False)
    return trained.fit(with_grams(labelled).select("features", F.col("label").cast("double").alias("label")))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """``row`` (the input row as a struct), page_id, host, path, rule, verdict, score (the model's chance
    of block; null where a rule decides).  ``labelled``: url, label (1 block, 0 allow), ``LABELLED`` by default."""
    parts = written(with_parts(pages.select(F.struct("*").alias("row"), "page_id", "url")), "urls")  # urls are parsed once
    lean = parts.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(LABELLED, "url string, label int")
    model = fit(with_parts(labelled.select("url", "label")).select("host", "path", "label"))
    ruled = verdict_column(F.col("rule"), rules)
    if model is None or isinstance(model, int):
        out = lean.withColumn("chance", F.lit(float(model or 0)))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.setPredictionCol("").setRawPredictionCol("").transform(with_grams(lean))
        out = scored.withColumn("chance", vector_to_array("probability")[1])
    empty = (F.col("host") == "") & (F.col("path") == "")
    chance = F.when(F.col("rule").isNull() & ~empty, F.round("chance", 9))
    return out.select("row", "page_id", "host", "path", "rule", chance.alias("score")).withColumn(
        "verdict", F.coalesce(ruled, F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))))
