"""Correlations, likelihoods and probabilities that stay finite, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.sources.files import saved

FLOOR = 1e-10


def pearson(x: Column, y: Column, min_n: int = 2) -> Column:
    """Aggregate: Pearson's r over complete pairs; null for fewer than min_n or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    sx, sy = F.stddev_pop(a), F.stddev_pop(b)
    varied = (F.count(a) >= min_n) & (F.max(a) > F.min(a)) & (F.max(b) > F.min(b)) & (sx * sy > 0)
    return F.when(varied, F.covar_pop(a, b) / F.when(varied, sx * sy))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> list[Column]:
    return [a[k].eqNullSafe(b[f"_{k}"]) for k in keys]


def weighted_pearson(x: Column, y: Column, w: Column, min_n: int = 2) -> Column:
    """Aggregate: Pearson's r of pairs that stand for w rows each; for ranks, whose mean is of the size of their spread."""
    n = F.sum(w)
    mean = lambda v: F.sum(w * v) / n
    vx, vy = mean(x * x) - mean(x) * mean(x), mean(y * y) - mean(y) * mean(y)
    varied = (n >= min_n) & (F.max(x) > F.min(x)) & (F.max(y) > F.min(y)) & (vx > 0) & (vy > 0)
    return F.when(varied, (mean(x * y) - mean(x) * mean(y)) / F.when(varied, F.sqrt(vx) * F.sqrt(vy)))


def value_places(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values as (_value, _ties, _below, _<key>...): rows with the value, and rows of the group with smaller ones.

    With weight, a row of df stands for that many rows.

    Values are counted first, so a run of ties is one row wherever its rows are. The distinct values are then sorted by
    ranges: what lies below is the rows of ranges before, plus those before it in its own range. No task holds a group's
    values. The ranges are saved with their places, as a second run of the same plan may cut others.
    """
    counts = df.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("_ties"))
    order = [*keys, value]
    ranged = saved(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ranks")
    before = F.sum("_ties").over(Window.partitionBy("_range", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy("_range", *keys).agg(F.sum("_ties").alias("_size"))
    offset = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("_range").alias("_r"), F.coalesce(offset, F.lit(0)).alias("_offset"), *[F.col(k).alias(f"_{k}") for k in keys])
    placed = ranged.withColumn("_before", F.coalesce(before, F.lit(0)))
    placed = placed.join(sizes, [placed["_range"] == sizes["_r"], *_same(placed, sizes, keys)])
    return placed.select(F.col(value).alias("_value"), "_ties", (F.col("_offset") + F.col("_before")).alias("_below"), *[ranged[k].alias(f"_{k}") for k in keys])


def average_rank(df: DataFrame, keys: list[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """df with ranks within keys, ties averaged; no task holds a group's values."""
    places = value_places(df, keys, value, weight)
    ranked = places.select("_value", (F.col("_below") + (F.col("_ties") + 1) / 2).alias(name), *[f"_{k}" for k in keys])
    return df.join(ranked, [df[value].eqNullSafe(ranked["_value"]), *_same(df, ranked, keys)]).drop("_value", *[f"_{k}" for k in keys])


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys..., name): the median of the values that aren't null, by selection: a group's middle rows are those whose places, known from counts over ranges, hold its middle.

    Groups without a value have no row. No task holds a group's values.
    """
    places = value_places(df.where(F.col(value).isNotNull()), keys, value)
    sizes = places.groupBy(*[F.col(f"_{k}").alias(k) for k in keys]).agg(F.sum("_ties").alias("_n"))
    low, high = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    holds = lambda i: (F.col("_below") <= i) & (i < F.col("_below") + F.col("_ties"))
    middle = sizes.join(places, _same(sizes, places, keys)).where(holds(low) | holds(high))
    return middle.groupBy(*keys).agg(((F.min("_value") + F.max("_value")) / 2).alias(name))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, *, min_n: int = 2, more: list[Column] = ()) -> DataFrame:
    """By keys: n and rho over complete pairs (and further aggregates)."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    ranked = average_rank(average_rank(full, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), pearson(F.col("_rx"), F.col("_ry"), min_n).alias("rho"), *more)


def spearman_sets(df: DataFrame, sets: list[list[str]], x: str, y: str, *, min_n: int = 2) -> DataFrame:
    """(set, keys..., n, rho) for each grouping set; set is the grouping id over the keys of all sets, in their order.

    Pairs of values are counted by all sets in one pass, and one ranking serves all of them; a repeated pair is one row.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    counts = full.groupingSets([[*s, x, y] for s in sets], *keys, x, y).agg(F.shiftright(F.grouping_id(), 2).alias("set"), F.count("*").alias("_w"))
    by = ["set", *keys]
    counts = saved(counts, "pairs")
    ranked = average_rank(average_rank(counts, by, x, "_rx", "_w"), by, y, "_ry", "_w")
    return ranked.groupBy(*by).agg(F.sum("_w").alias("n"), weighted_pearson(F.col("_rx"), F.col("_ry"), F.col("_w"), min_n).alias("rho"))


def loglik(p: Column, neg: Column) -> Column:
    """ln of the observed answer's probability; ln(1e-10) where that is 0 or less."""
    q = F.when(neg == 1, p).otherwise(1 - p)
    return F.when(q > 0, F.log(q)).when(q.isNotNull(), F.log(F.lit(FLOOR)))


def clip(p: Column, low: float = FLOOR, high: float = 1 - FLOOR) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), p))


def binom_ll(p: Column, yes: Column, total: Column) -> Column:
    """yes ln p + (total - yes) ln(1 - p), p clipped; counts or probabilities that aren't valid, or not there, are an error."""
    q = clip(p)
    valid = (yes >= 0) & (yes <= total) & (p >= 0) & (p <= 1)
    return F.when(valid, yes * F.log(q) + (total - yes) * F.log1p(-q)).otherwise(error("counts must be within 0 to total, and a probability within 0 to 1"))


def error(why: str) -> Column:
    return F.raise_error(F.lit(why)).cast("double")


def finite(x: Column, name: str) -> Column:
    """x; null stays null, infinite values and NaN are an error."""
    x = x.cast("double")
    return F.when(x.isNull() | (F.abs(x) < float("inf")), x).otherwise(error(f"{name} must be finite"))


def positive(s: Column) -> Column:
    """A scale; one that isn't a finite number above zero is an error."""
    s = s.cast("double")
    return F.when((s > 0) & (s < float("inf")), s).otherwise(error("a scale must be finite and above zero"))


def p_set(lp_q: Column, theta: Column, s: Column) -> Column:
    """Probability that a query's Gumbel score passes the threshold."""
    z = F.greatest(F.lit(-745.0), F.least(F.lit(50.0), (finite(lp_q, "a score") - finite(theta, "a threshold")) / positive(s)))
    return -F.expm1(-F.exp(z))


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)) without overflow on either side."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def p_order(lp_q: Column, lp_t: Column, s: Column) -> Column:
    return sigmoid((finite(lp_q, "a score") - finite(lp_t, "a score")) / positive(s))


def structure_probs(lp_q: Column, lp_t: Column, theta: Column, s: Column) -> dict[str, Column]:
    """set, ordering, conjunction, disjunction; conjunction = ordering x P(either passes the threshold).

    Scores and thresholds must be finite and scales positive; a null gives null.
    """
    lp_q, lp_t, theta, s = finite(lp_q, "a score"), finite(lp_t, "a score"), finite(theta, "a threshold"), positive(s)
    hi, lo = F.greatest(lp_q, lp_t), F.least(lp_q, lp_t)
    rate = hi / s + F.log1p(F.exp((lo - hi) / s)) - theta / s
    either = -F.expm1(-F.exp(F.greatest(F.lit(-745.0), F.least(F.lit(50.0), rate))))
    inside = -F.expm1(-F.exp(F.greatest(F.lit(-745.0), F.least(F.lit(50.0), (lp_q - theta) / s))))
    above = sigmoid((lp_q - lp_t) / s)
    conj = F.greatest(F.lit(0.0), F.least(F.lit(1.0), above * either))
    return {"set": inside, "ordering": above, "conjunction": conj, "disjunction": F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside + above - conj))}
