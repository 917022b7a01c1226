"""Relational building blocks the reports need beyond plain select/filter/join.

* ``first_per_key``  -- QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY o) = 1 (W1/W2)
* ``interval_join``  -- equi key + open time range relative to the left row (J5),
                        bucketed by time so one hot key does not land in one task
* ``spread_join``    -- left join whose heavy keys are cut into a grid of parts (J3)
* ``calendar_join``  -- date / timestamp -> fiscal attributes from a calendar (J6-J8)
* ``full_outer_join`` -- two relations, NULL keys kept out of the shuffle (J11)
* ``union_all``      -- positional bag union of conformed branches (U1)
* ``distinct_count_long`` -- many COUNT(DISTINCT) over one grouping, as a long
                        (group, metric, value) relation instead of an Expand per metric (A3)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], rn: str = "_rn") -> DataFrame:
    """Keep one row per key (NULL keys form their own group, as in SQL windows).

    ``row_number() == 1`` is planned as WindowGroupLimit, which keeps only the
    first row per key inside each map partition before the shuffle, so a hot key
    ships at most one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)


def month_bucket(ts: Column, months: int) -> Column:
    """Number of the run of ``months`` calendar months that a time lies in."""
    return F.floor((F.year(ts) * 12 + F.month(ts) - 1) / F.lit(months)).cast("int")


def interval_join(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str,
                  left_ts: str, right_ts: str, months: int, left_id: str) -> DataFrame:
    """Left join of ``right`` rows with the same key and ``left_ts < right_ts < left_ts + months``.

    Time is cut into buckets of ``months`` months.  A right row can only meet left rows of its own bucket
    or of the one before, so the right side, which is narrow, goes to these two buckets and each left row stays alone
    in its own: one left join on (key, bucket) with the exact range as a residual predicate gives every pair once and every
    unmatched left row once, with no second look at the pairs.  A key holding a third of all rows is spread over its buckets.

    ``left_id`` need not be unique; repeated left rows each keep their own matches.  Rows with a NULL key or
    time match nothing: left ones are spread over buckets of their own, right ones are left out.
    """
    bucket, home = "_bucket", "_r_bucket"
    lk, lt, rt = F.col(left_key), F.col(left_ts), F.col(right_ts)
    alone = -F.pmod(F.xxhash64(left_id), F.lit(997)).cast("int") - 1
    l_tag = left.withColumn(bucket, F.when(lk.isNull() | lt.isNull(), alone).otherwise(month_bucket(lt, months))).alias("l")
    own = month_bucket(rt, months)
    r_tag = (right.where(F.col(right_key).isNotNull() & rt.isNotNull())
             .select("*", F.explode(F.array(own, own - 1)).alias(home)).alias("r"))
    upper = F.col(f"l.{left_ts}") + F.make_ym_interval(F.lit(0), F.lit(months))
    cond = ((F.col(f"l.{left_key}") == F.col(f"r.{right_key}")) & (F.col(bucket) == F.col(home))
            & (F.col(f"r.{right_ts}") > F.col(f"l.{left_ts}")) & (F.col(f"r.{right_ts}") < upper))
    return l_tag.join(r_tag, cond, "left").select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns])


#: A heavy key has more than LEAST rows on a side; it is cut into at most SHARES parts of about LEAST rows.
SHARES, LEAST = 64, 100_000


def heavy_keys(joins: dict[str, tuple[DataFrame, str, DataFrame, str]], least: int = LEAST) -> DataFrame:
    """The heaviest keys of some joins, given as name -> (left, its key, right, its key): ``name:key`` with the number of parts (``left_parts``,
    ``right_parts``) to cut their rows into, ``2 * SHARES`` keys a join at most.

    One partial aggregation over the keys of all sides.  A key beyond the heaviest has less than one in SHARES of
    the rows and needs no cutting, so the result is small by construction, whatever the data."""
    sides = [side.selectExpr(f"'{name}:' || {key} AS heavy_key", f"{int(here == 'l')}L AS l", f"{int(here == 'r')}L AS r")
             for name, (left, left_key, right, right_key) in joins.items() for here, side, key in (("l", left, left_key), ("r", right, right_key))]
    counts = reduce(DataFrame.unionByName, sides).where("heavy_key IS NOT NULL").groupBy("heavy_key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    first = counts.where(f"greatest(l, r) > {least}").orderBy(F.expr("greatest(l, r) DESC"), "heavy_key").limit(2 * SHARES * len(joins))
    return first.selectExpr("heavy_key", *[f"CAST(least({SHARES}, greatest(1, ceil({c} / {least}))) AS int) AS {name}"
                                           for c, name in (("l", "left_parts"), ("r", "right_parts"))])


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_id: list[str], right_id: list[str],
                heavy: DataFrame, name: str) -> DataFrame:
    """LEFT JOIN on one key whose heavy keys (those of the join ``name`` in ``heavy``) are cut on both sides.

    The rows of a heavy key are dealt into parts by the hash of their ids, and each part of one side goes to every part of the other, so
    a key holding a third of both sides becomes a grid of tasks.  Other rows are moved once, as in a plain join.  A
    key with several right parts is there on the right, so a left copy that meets an empty part is no unmatched row and goes."""
    table = F.broadcast(heavy)  # 2 * SHARES rows a join at most

    def cut(side: DataFrame, key: str, ids: list[str], own: str, other: str, mark: str) -> DataFrame:
        found = side.join(table, F.expr(f"'{name}:' || {key} = heavy_key"), "left")
        return found.selectExpr(
            *side.columns, f"CAST(pmod(xxhash64({', '.join(ids)}), coalesce({own}, 1)) AS int) AS {mark}_own",
            f"explode(sequence(0, coalesce({other}, 1) - 1)) AS {mark}_other", f"coalesce({other}, 1) > 1 AS {mark}_cut")

    lt = cut(left, left_key, left_id, "left_parts", "right_parts", "_l")
    rt = cut(right, right_key, right_id, "right_parts", "left_parts", "_r")
    joined = lt.join(rt, F.expr(f"{left_key} = {right_key} AND _l_own = _r_other AND _l_other = _r_own"), "left")
    return joined.where(f"NOT _l_cut OR {right_key} IS NOT NULL").select(*left.columns, *right.columns)


def calendar_join(df: DataFrame, calendar: DataFrame, on: Column, prefix: str = "",
                  columns: tuple[str, ...] = ("fiscal_year", "fiscal_quarter")) -> DataFrame:
    """Left join to the calendar on a date expression (``F.to_date(ts)`` for timestamps).

    Spark chooses the join from the calendar's size.  A NULL date has NULL attributes; a date that
    the calendar does not have is an error, not a NULL label.
    """
    key, day = f"_{prefix}date_key", f"_{prefix}day"
    cal = calendar.select(F.col("date_key").alias(key), *[F.col(c).alias(f"_{prefix}{c}") for c in columns])
    joined = df.withColumn(day, on).join(cal, F.col(day) == F.col(key), "left")
    missing = F.raise_error(F.concat(F.lit("no calendar entry for "), F.col(day).cast("string")))
    for c in columns:
        found = F.col(f"_{prefix}{c}")
        joined = joined.withColumn(prefix + c, F.when(F.col(day).isNotNull() & F.col(key).isNull(), missing.cast("int")).otherwise(found))
    return joined.drop(key, day, *[f"_{prefix}{c}" for c in columns])


def full_outer_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """FULL OUTER JOIN on one key.  Rows whose key is NULL match nothing and go past the join, so they do not
    meet in one task (Spark does not split a full outer join)."""
    both = left.where(F.col(left_key).isNotNull()).join(
        right.where(F.col(right_key).isNotNull()), F.col(left_key) == F.col(right_key), "full")
    lone_left = left.where(F.col(left_key).isNull())
    lone_right = right.where(F.col(right_key).isNull())
    return both.unionByName(lone_left, allowMissingColumns=True).unionByName(lone_right, allowMissingColumns=True)


def union_all(*branches: DataFrame) -> DataFrame:
    out = branches[0]
    for b in branches[1:]:
        out = out.union(b)
    return out


def pivot_distinct_counts(long: DataFrame, group: str, names: list[str]) -> DataFrame:
    """(group, metric, value) rows -> one row per group with COUNT(DISTINCT value) per metric.

    ``distinct`` shuffles on all three columns, so a hot group is spread by
    value (and duplicates collapse map-side first); the count per (group,
    metric) aggregates partially before a tiny shuffle.  NULL values of counted
    metrics are dropped first; a row of a metric outside ``names`` (a presence
    marker) keeps groups whose metrics are all NULL, with zero counts, in one pass.
    """
    long = long.where(F.col("value").isNotNull() | ~F.col("metric").isin(names))
    counts = (long.distinct()
              .groupBy(group, "metric").agg(F.count("value").alias("n"))
              .groupBy(group).pivot("metric", names).agg(F.sum("n")))
    return counts.select(group, *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names])


def distinct_count_long(df: DataFrame, group: str, metrics: dict[str, Column]) -> DataFrame:
    """COUNT(DISTINCT m) for many m by ``group`` through one narrow long relation
    instead of an Expand per distinct aggregate (A3)."""
    pairs = F.array(F.struct(F.lit("_present").alias("metric"), F.lit(None).cast("string").alias("value")),
                    *[F.struct(F.lit(n).alias("metric"), c.cast("string").alias("value"))
                      for n, c in metrics.items()])
    long = (df.select(F.col(group), F.explode(pairs).alias("mv"))
            .select(group, "mv.metric", "mv.value"))
    return pivot_distinct_counts(long, group, list(metrics))
