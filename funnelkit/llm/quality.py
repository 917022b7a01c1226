"""Quality rules with host verdicts.

Each text is measured (words, their characters, symbols, repeated lines, repeated eight-word
windows) and held against rules.  The two base rules reject a document by themselves.  The
others are soft: a failure counts against the document's host (``source``), whose failure rate is shrunk with a beta prior
fitted to all hosts by the method of moments (empirical Bayes), so a host with few documents is judged by what hosts
are like in general.  The prior takes off what sampling alone may add to the variance of the hosts' rates.

The verdict on a host is the posterior chance that its rate exceeds the prior mean, and it is joined back to its
documents.  Each soft rule has a margin, the measure as a multiple of the rule's limit.  One over the chance is the highest margin a
host's documents may have: from a surely bad host every failure goes, from an average one a document that passes
the limit twice over, and from a surely good one hardly any.  A document that fails no rule always stays, wherever it comes from.
The corpus pipeline's first stage and the query give the same verdicts.

All of it is DataFrame expressions.  The measures are taken row by row without exploding a text; the
host table is one partial aggregation (a host with a third of all rows sends one row a task); the
verdicts, one row a host, are joined back by host.

Null and empty texts have zero words and fail the first base rule.  A null host is a host of its own.
Repeated rows are judged alike, each counting once for its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.shared import BLANKS, written

SPAN = 8
#: Soft rules: name and condition on the measures.
SOFT_RULES = {
    "symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "repeated_words": "100 * n_repeat_words > 15 * n_words",
}
#: Margins of the soft rules (a document fails above 1).  Short words are measured by the letters beyond the first, of
#: which a good text has at least one a word.
MARGINS = {
    "symbols": "10 * n_symbols / word_chars",
    "repeated_lines": "10 * n_dup_lines / (3 * n_lines)",
    "word_length": "greatest(word_chars / (15 * n_words), if(word_chars > n_words, n_words / (word_chars - n_words), 1e6))",
    "repeated_words": "100 * n_repeat_words / (15 * n_words)",
}
#: Weight of a prior whose hosts differ by no more than sampling explains, in documents.
MAX_WEIGHT = 1e6


def _pairs(column: str, reach: int) -> Column:
    """Hash of each element of an array column with the one ``reach`` further on."""
    n = F.greatest(F.size(column) - reach, F.lit(0))
    return F.zip_with(F.slice(column, 1, n), F.slice(column, reach + 1, n), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, f"{BLANKS}+"), lambda w: w != "")
    # each array is a column of its own, so that it is made once however often the next step names it
    step = docs.withColumns({
        "hashes": F.transform(words, lambda w: F.xxhash64(w)),
        "lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{BLANKS[1:-1]}]")),
        "word_chars": F.length(F.regexp_replace(t, f"{BLANKS}+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
    })
    step = step.withColumns({
        "n_words": F.size("hashes").cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "twos": _pairs("hashes", 1),
    }).drop("hashes", "lines")
    step = step.withColumn("fours", _pairs("twos", 2)).drop("twos")
    step = step.withColumn("spans", _pairs("fours", 4)).drop("fours")
    # Windows sorted by (hash, position): equal neighbours give the positions of repeated windows, and each
    # position adds the words up to the next one, eight at most.  Texts without a repeated window skip this.
    step = step.withColumn("placed", F.when(F.size(F.array_distinct("spans")) < F.size("spans"), F.sort_array(F.transform("spans", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("placed")
    starts = F.zip_with(
        "placed", F.concat(F.slice("placed", 2, n), F.array(F.lit(None))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    step = step.withColumn("starts", F.sort_array(F.array_distinct(F.flatten(starts)))).drop("placed", "spans")
    gaps = F.zip_with("starts", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.element_at("starts", -1) + SPAN)),
                      lambda a, b: F.least(b - a, F.lit(SPAN)))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    return step.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("starts")


def rules() -> dict[str, Column]:
    """The rules on the measures: base first, then the soft ones."""
    return {"base": F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"),
            **{name: F.coalesce(F.expr(rule), F.lit(False)) for name, rule in SOFT_RULES.items()}}


def above(a: Column, b: Column, x: Column) -> Column:
    """Chance that a beta(a, b) variable exceeds x (Abramowitz and Stegun 26.5.20, normal tail by a logistic cubic)."""
    one, two = F.cbrt(b * x), F.cbrt(a * (1 - x))
    z = 3 * (one * (1 - 1 / (9 * b)) - two * (1 - 1 / (9 * a))) / F.sqrt(one * one / b + two * two / a)
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * F.pow(z, F.lit(3)), F.lit(700.0))))


def host_chances(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row a host: ``host`` and, for each soft rule, ``chance_<rule>`` that its rate exceeds the prior mean."""
    tests = rules()
    names = list(SOFT_RULES)
    counted = written(measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), *[F.sum(tests[x].cast("long")).alias(x) for x in names]), "hosts")
    # beta prior of each rule by the method of moments over the hosts
    moments = counted.agg(F.avg(1 / F.col("n")).alias("thin"), F.count("*").alias("hosts"), *[
        f(F.col(x) / F.col("n")).alias(f"{k}_{x}") for x in names for k, f in (("mean", F.avg), ("var", F.var_samp))])
    thin, weights = F.col("thin"), {}
    for x in names:
        mean = F.col(f"mean_{x}")
        # hosts' own variance: what they show, less that of n draws each and two standard errors of it (few hosts
        # with few failures differ widely by chance); alpha + beta follow from it
        drawn = mean * (1 - mean) * thin
        error = drawn * F.sqrt(2 / (F.col("hosts") - 1) + thin / (mean * (1 - mean) * F.col("hosts")))
        var = F.when((thin < 1) & (F.col("hosts") > 1) & (mean > 0) & (mean < 1), (F.col(f"var_{x}") - drawn - 2 * error) / (1 - thin))
        weights[f"weight_{x}"] = F.when(var > 0, F.greatest(F.least(mean * (1 - mean) / var - 1, F.lit(MAX_WEIGHT)), F.lit(1e-3))).otherwise(F.lit(MAX_WEIGHT))
    out = counted.crossJoin(F.broadcast(moments.withColumns(weights)))  # one row
    for x in names:
        mean, weight = F.col(f"mean_{x}"), F.col(f"weight_{x}")
        chance = above(F.col(x) + mean * weight, F.col("n") - F.col(x) + (1 - mean) * weight, mean)
        # no host fails, or all do on every document: no host differs from the mean
        out = out.withColumn(f"chance_{x}", F.when((mean > 0) & (mean < 1), F.round(chance, 9)).otherwise(F.lit(0.5)))
    return out.select("host", *[f"chance_{x}" for x in names])


def judge(docs: DataFrame, text: str = "text", host: str = "source", carry: bool = True) -> DataFrame:
    """doc_id, source, the measures, base_failed, host_failed (the soft rule that rejects the document
    through its host, else null), kept and, with ``carry``, the input row as struct ``row``.

    The measures are taken once and written; hosts and verdicts read only the columns they need."""
    rows = [F.struct("*").alias("row")] if carry else []
    lean = docs.select(*rows, "doc_id", F.col(text).alias("text"), F.col(host).alias("source"))
    measured = written(measures(lean).drop("text"), "measures")
    tests = rules()
    judged = measured.join(host_chances(measured), F.col("source").eqNullSafe(F.col("host")), "left")
    # texts that fail no rule have nothing to divide by
    reason = F.coalesce(*[F.when(tests[x], F.when(F.expr(f"{m} * chance_{x} > 1"), F.lit(x))) for x, m in MARGINS.items()])
    return judged.withColumns({"base_failed": tests["base"], "host_failed": reason}).withColumn(
        "kept", ~F.col("base_failed") & F.col("host_failed").isNull())
