"""Profiling aggregates.

Every statistic is a built-in aggregate so Catalyst plans partial (map-side)
plus final aggregation; many statistics share one pass over the data.
Exact medians and quartiles are selected in range partitions of the distinct
values (``quantiles``), so no task holds all of them; ``exact=False`` asks for
``percentile_approx`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage


def quantiles(values: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation between neighbouring ranks) of any
    number of doubles: one row per group with the columns of ``probs``.

    Equal values are counted first.  The distinct ones are range partitioned by
    (group, value); running counts inside each partition plus the counts of the
    partitions before it (a table of partitions x groups rows) give every
    value its ranks, and the wanted ranks are picked by one aggregation."""
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = values.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    # written once: partitions and their counts must belong together
    g = cut_lineage(g.repartitionByRange(n, *groups, "__v").withColumn("__pid", F.spark_partition_id()))
    per = g.groupBy("__pid", *groups).agg(F.sum("__c").alias("__s"))
    before = Window.partitionBy(*groups).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__pid", *groups, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"),
                     F.sum("__s").over(Window.partitionBy(*groups)).alias("__n"))
    same = F.col("a.__pid") == F.col("b.__pid")
    for c in groups:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    inside = Window.partitionBy("__pid", *groups).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    j = g.withColumn("__cum", F.sum("__c").over(inside)).alias("a").join(F.broadcast(per.alias("b")), same)
    end = F.col("__off") + F.col("__cum")          # ranks end - c .. end - 1 (from 0) hold this value
    aggs, out = [F.first("__n").alias("__n")], []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("__n") - 1)
        for k, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((rank >= end - F.col("__c")) & (rank < end), F.col("__v"))).alias(f"{name}__{k}"))
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name))
    return j.groupBy(*[F.col(f"a.{c}") for c in groups]).agg(*aggs).select(*groups, *out)


def long_form(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    """(keep..., column_name, value): one row per cell."""
    cells = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(*[f"`{c}`" for c in keep], f"stack({len(cols)}, {cells}) as (column_name, value)")


# A1 / A25 -------------------------------------------------------------------
def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, data_type, null_count, null_pct, total_rows) in one aggregate pass."""
    cols = cols or df.columns
    types = dict(df.dtypes)
    agg = df.agg(F.count("*").alias("__total"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', '{types[c]}', `{c}`" for c in cols)
    long = agg.selectExpr("__total", f"stack({len(cols)}, {stack}) as (column_name, data_type, null_count)")
    return long.select(
        "column_name", "data_type",
        F.col("null_count").cast("bigint").alias("null_count"),
        F.round(F.col("null_count") * 100.0 / F.col("__total"), 2).alias("null_pct"),
        F.col("__total").cast("bigint").alias("total_rows"),
    )


# A26 ------------------------------------------------------------------------
def null_indicators(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in cols],
                     *[F.col(c).isNull().cast("int").alias(f"{c}_is_null") for c in cols])


# A2 -------------------------------------------------------------------------
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, cols: list[str], dp: int = 3, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 %, max per column; one row per
    column.  ``exact=False`` takes the quartiles from ``percentile_approx``."""
    if exact:
        df = cut_lineage(df.select(*cols))      # read twice: what makes the columns runs once
    cells = long_form(df, [], cols)
    aggs = [F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"), F.max("value").alias("max")]
    if exact:
        q = quantiles(cells, ["column_name"], "value", QUARTILES)
        out = cells.groupBy("column_name").agg(*aggs).join(q, "column_name", "left")
    else:
        out = cells.groupBy("column_name").agg(*aggs, *[F.percentile_approx("value", p, accuracy).alias(k) for k, p in QUARTILES.items()])
    return out.select("column_name", F.col("count").cast("bigint").alias("count"),
                      *[F.round(st, dp).alias(st) for st in ("mean", "std", "min", *QUARTILES, "max")])


# A4 / A5 / W7 ---------------------------------------------------------------
def value_counts_filled(df: DataFrame, col: str, categories: DataFrame) -> DataFrame:
    """Counts for a fixed category list (0 for absent), % of total and balance
    (min count / max count).  ``categories`` has one column named ``col``."""
    counts = df.groupBy(col).count()
    full = categories.join(counts, col, "left") \
        .select(col, F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))
    w = Window.partitionBy()  # categories are a handful of rows
    return full.select(
        col, "n",
        F.round(F.col("n") * 100.0 / F.sum("n").over(w), 2).alias("pct"),
        F.round(F.min("n").over(w) / F.max("n").over(w), 2).alias("balance"),
    )


# A6 / A10 -------------------------------------------------------------------
def group_stats(df: DataFrame, by: str, cols: list[str], dp: int = 1, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    if exact:
        df = cut_lineage(df.select(by, *cols))
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.round(F.avg(x), dp).alias(f"{c}_mean"), F.round(F.stddev_samp(x), dp).alias(f"{c}_std"),
                 F.round(F.min(x), dp).alias(f"{c}_min"), F.round(F.max(x), dp).alias(f"{c}_max")]
        if not exact:
            aggs.append(F.round(F.percentile_approx(x, 0.5, accuracy), dp).alias(f"{c}_median"))
    out = df.groupBy(by).agg(F.count("*").alias("n"), *aggs)
    if exact:
        q = quantiles(long_form(df, [by], cols), [by, "column_name"], "value", {"median": 0.5})
        wide = q.groupBy(F.col(by).alias("__by")).agg(*[F.round(F.max(F.when(F.col("column_name") == c, F.col("median"))), dp).alias(f"{c}_median") for c in cols])
        out = out.join(wide, F.col(by).eqNullSafe(F.col("__by")), "left")   # a row per group on both sides
    return out.select(by, "n", *[f"{c}_{k}" for c in cols for k in ("mean", "median", "std", "min", "max")])


# A7 -------------------------------------------------------------------------
def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max; the last bin is closed.  The
    bounds are scalar subqueries (one tiny job), not a join."""
    x = F.col(col).cast("double")
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo = bounds.select("lo").scalar()
    hi = bounds.select("hi").scalar()
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((x - lo) / width), F.lit(bins - 1)))
    out = df.select(b.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return out.select("bin",
                      F.round(lo + F.col("bin") * width, 6).alias("bin_lo"),
                      F.round(lo + (F.col("bin") + 1) * width, 6).alias("bin_hi"),
                      F.col("n").cast("bigint").alias("n"))


# A8 / J9 ----------------------------------------------------------------------
TERMS, REACH = 20, 8.0


def kde(df: DataFrame, col: str, by: str, points: int = 1000, bins: int | None = None, direct: bool = False) -> DataFrame:
    """Gaussian density per group on ``points`` grid points from
    min - range/2 to max + range/2, Scott bandwidth h = std * n^(-1/5).

    Values go into boxes of width h / 2, and a box keeps ``TERMS`` moments of its
    values around its centre (one aggregation).  With a = (x - centre) / h and
    b = (value - centre) / h the kernel is exp(-a²/2) exp(-b²/2) exp(ab), and
    exp(ab) its Taylor sum: |ab| is at most 2 within ``REACH`` bandwidths, so the
    terms left out are below 2^20 / 20! = 5e-13 of a value's peak and the grid
    points beyond below exp(-32).  The work is the values, and boxes x the grid points they
    reach, instead of values x points.  Groups of one value or without spread have
    no bandwidth and no rows.  ``direct`` sums the kernel over distinct values;
    ``bins`` does so over that many equal-width bin centres."""
    # equal values are counted once; everything else comes from that table
    values = cut_lineage(df.select(by, F.col(col).cast("double").alias("v")).where("v IS NOT NULL").groupBy(by, "v").agg(F.count("*").alias("c")))
    mean = values.groupBy(by).agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
                                  F.min("v").alias("lo"), F.max("v").alias("hi"))
    square = F.sum(F.col("c") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean")))
    stats = values.join(mean, by).groupBy(by, "n", "lo", "hi").agg(F.sqrt(F.try_divide(square, F.col("n") - 1)).alias("sd"))
    stats = cut_lineage(stats.withColumns({"h": F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)), "rng": F.col("hi") - F.col("lo")}).where("h > 0"))
    if bins:
        w = F.col("rng") / bins
        j = F.when(w == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / w), F.lit(bins - 1)))
        values = (values.join(stats.select(by, "lo", "rng"), by).select(by, (F.col("lo") + (j + 0.5) * w).alias("v"), "c")
                  .groupBy(by, "v").agg(F.sum("c").alias("c")))
    placed = values.join(stats, by)
    grid = F.col("lo") - F.col("rng") / 2 + F.col("i") * (2 * F.col("rng")) / (points - 1)
    if direct or bins:
        at = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
        part = F.col("c") * F.exp(-F.pow((grid - F.col("v")) / F.col("h"), 2) / 2)
    else:
        box = F.floor((F.col("v") - F.col("lo")) / (F.col("h") / 2))
        centre = F.col("lo") + (F.col("box") + 0.5) * (F.col("h") / 2)
        b = placed.withColumn("box", box).withColumn("m", centre).withColumn("b", (F.col("v") - F.col("m")) / F.col("h"))
        b = b.withColumn("w", F.col("c") * F.exp(-F.col("b") * F.col("b") / 2))
        moments, power = [], F.col("w")
        for k in range(TERMS):
            moments.append(F.sum(power).alias(f"m{k}"))
            power = power * F.col("b") / (k + 1)
        boxes = b.groupBy(by, "box", "m", "n", "h", "lo", "rng").agg(*moments)
        step = (2 * F.col("rng")) / (points - 1)
        first = F.ceil((F.col("m") - REACH * F.col("h") - F.col("lo") + F.col("rng") / 2) / step)
        last = F.floor((F.col("m") + REACH * F.col("h") - F.col("lo") + F.col("rng") / 2) / step)
        at = boxes.withColumns({"first": F.greatest(first, F.lit(0)), "last": F.least(last, F.lit(points - 1))}).where("first <= last")
        at = at.select("*", F.explode(F.sequence("first", "last")).alias("i")).withColumn("a", (grid - F.col("m")) / F.col("h"))
        total = F.col(f"m{TERMS - 1}")
        for k in range(TERMS - 2, -1, -1):
            total = total * F.col("a") + F.col(f"m{k}")
        part = F.exp(-F.col("a") * F.col("a") / 2) * total
    sums = at.groupBy(by, F.col("i").cast("int").alias("i")).agg(F.sum(part).alias("s"))
    # every grid point of a group, also those that no value reaches
    every = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    out = every.join(sums, [by, "i"], "left")
    dens = F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("h") * F.sqrt(F.lit(2 * 3.141592653589793)))
    return out.select(by, F.col("i").cast("bigint").alias("i"), F.round(grid, 4).alias("x"),
                      F.round(dens * 1e6, 4).alias("density_e6"))


# A9 -------------------------------------------------------------------------
def box_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme values inside the fences)
    and outlier counts per group."""
    df = cut_lineage(df.select(by, col))
    x = F.col(col).cast("double")
    q = quantiles(df.select(by, x.alias("v")), [by], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    j = df.select(by, x.alias("v")).join(q, by)   # one row per group
    agg = j.groupBy(by, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(F.col("v") >= lo_f, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(F.col("v") <= hi_f, F.col("v"))).alias("whisker_hi"),
        F.count_if((F.col("v") < lo_f) | (F.col("v") > hi_f)).alias("n_outliers"))
    return agg.select(by, *[F.round(c, 3).alias(c) for c in ["q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi"]],
                      F.col("n_outliers").cast("bigint").alias("n_outliers"))


# A11 / A12 --------------------------------------------------------------------
def corr(a: str, b: str) -> Column:
    """Pearson correlation over the rows where both are known; null for a constant column."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def corr_pairs(df: DataFrame, cols: list[str], dp: int = 6) -> DataFrame:
    """Pearson correlation of every pair (lower triangle) in one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    wide = df.agg(*[corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    long = wide.selectExpr(f"stack({len(pairs)}, {stack}) as (col_a, col_b, corr)")
    return long.select("col_a", "col_b", F.round("corr", dp).alias("corr"))
