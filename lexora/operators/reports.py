"""Summaries, pivots and diagnostics of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.functions.stats import exact_median, pearson
from lexora.functions.text import uniform
from lexora.operators.calibrate import vector_sums
from lexora.operators.vocab import attach

C = F.col
CELL = ["context", "trigger", "query"]


def ll_by_context(results: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, boundaries, mean, median, sd (n - 1, one row 0), min and max of the log-likelihood."""
    x = C("log_likelihood")
    base = results.groupBy(*keys).agg(F.count("*").alias("observed_rows"), F.countDistinct("set_boundary").alias("observed_boundaries"), F.avg(x).alias("average"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return attach(base, exact_median(results, keys, "log_likelihood"), tuple(keys), "left")


def context_means(results: DataFrame) -> DataFrame:
    return results.groupBy("structure", "source", "context").agg(F.avg("log_likelihood").alias("average"))


def ll_rollup(by_context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Means of context means by (source, structure), and means of those by source."""
    one = by_context.groupBy("source", "structure").agg(F.count("*").alias("context_count"), F.avg("average").alias("mean_log_likelihood"))
    return one, one.groupBy("source").agg(F.count("*").alias("structure_count"), F.avg("mean_log_likelihood").alias("overall"))


def human_rates(trials: DataFrame) -> DataFrame:
    return trials.groupBy(*CELL).agg(F.avg("neg").alias("human_rate"), F.count("*").alias("responses"))


def model_rates(results: DataFrame) -> DataFrame:
    """Mean over boundaries of what the model says per cell."""
    return results.groupBy("source", "structure", *CELL).agg(F.avg("negation_probability").alias("model_rate"))


def rate_points(model: DataFrame, human: DataFrame) -> DataFrame:
    return model.join(human, CELL)


def rate_correlations(points: DataFrame) -> DataFrame:
    return points.groupBy("source", "structure").agg(F.count("*").alias("cells"), F.countDistinct("context").alias("contexts"), pearson(C("model_rate"), C("human_rate")).alias("r"))


def cells(results: DataFrame, how: str = "mean") -> DataFrame:
    """Heatmap cells: the mean within a boundary, then mean, median, min or max over boundaries."""
    one = results.groupBy("structure", "set_boundary", *CELL).agg(F.avg("negation_probability").alias("p"))
    last = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}[how]
    return one.groupBy("structure", *CELL).agg(last("p").alias("p"))


def human_cells(results: DataFrame) -> DataFrame:
    """People's rate by cell: the mean answer within a boundary, then the mean over boundaries; rows of the ordering structure alone if it is there, as every structure repeats the answers."""
    ordering = results.agg(F.max(F.when(C("structure") == "ordering", 1).otherwise(0)).alias("_has"))  # one row
    kept = results.crossJoin(F.broadcast(ordering)).where((C("_has") == 0) | (C("structure") == "ordering"))
    return kept.groupBy("set_boundary", *CELL).agg(F.avg("neg").alias("p")).groupBy(*CELL).agg(F.avg("p").alias("human_rate"))


def axis(df: DataFrame, word: str, order: str, by: str | None = None) -> DataFrame:
    """(context, word, place): words of an axis from 1, by "appearance" (least value of `by`), "alphabet", or "base" (largest value of `by` first; words without one last); ties by word."""
    first = {"appearance": [F.asc_nulls_last("_by")], "alphabet": [], "base": [F.desc_nulls_last("_by")]}[order]
    value = {"appearance": F.min, "base": F.max}.get(order, F.min)(C(by) if by else F.lit(0))
    words = df.groupBy("context", C(word).alias("word")).agg(value.alias("_by"))
    return words.withColumn("place", F.row_number().over(Window.partitionBy("context").orderBy(*first, "word"))).drop("_by")


def ordered_matrix(cells: DataFrame, rows: DataFrame, columns: DataFrame, value: str) -> DataFrame:
    """The full grid of a context's axes as (context, row, column, trigger, query, value); cells that are missing are null."""
    r = rows.select("context", C("word").alias("trigger"), C("place").alias("row"))
    c = columns.select("context", C("word").alias("query"), C("place").alias("column"))
    return r.join(c, "context").join(cells.select(*CELL, value), CELL, "left").select("context", "row", "column", "trigger", "query", value)


def matrix(df: DataFrame, rows: str, columns: str, names: list[str], value: str) -> DataFrame:
    return df.groupBy(rows).pivot(columns, names).agg(F.first(value))


def missing_by_context(trials: DataFrame, missing: DataFrame) -> DataFrame:
    """Human, missing and available trials and the missing percentage; contexts of either side."""
    a = trials.groupBy("context").agg(F.count("*").alias("human"))
    b = missing.groupBy("context").agg(F.count("*").alias("missing"))
    out = a.join(b, "context", "full").fillna(0, ["human", "missing"])
    return out.withColumns({"available": C("human") - C("missing"), "percent": F.try_divide(100.0 * C("missing"), C("human"))})


def token_diagnostics(counts: DataFrame, trials: DataFrame, context: str) -> DataFrame:
    """Supported words of a context: count, share of all, share in the context, trials as query and as trigger."""
    total = counts.agg(F.sum("n").alias("_t"))
    own = counts.where(C("context") == context)
    inner = own.agg(F.sum("n").alias("_c"))
    q = trials.where(C("context") == context).groupBy(C("query").alias("token")).agg(F.count("*").alias("as_query"))
    t = trials.where(C("context") == context).groupBy(C("trigger").alias("token")).agg(F.count("*").alias("as_trigger"))
    out = own.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(inner)).join(q, "token", "left").join(t, "token", "left").fillna(0, ["as_query", "as_trigger"])
    return out.select("token", "n", (C("n") / C("_t")).alias("share_all"), (C("n") / C("_c")).alias("share_context"), "as_query", "as_trigger")


def query_scores(pairs: DataFrame) -> DataFrame:
    """Per query over its triggers: number, sorted list, mean, median, sd, min, max, and the difference from the base score."""
    x, keys = C("score"), ["context", "query"]
    base = pairs.groupBy(*keys).agg(F.count("*").alias("n_triggers"), F.array_join(F.sort_array(F.collect_set("trigger")), ",").alias("triggers"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x - C("base")).alias("delta"))
    return attach(base, exact_median(pairs, keys, "score"), tuple(keys), "left")


def delta_summary(df: DataFrame, prefix: str) -> DataFrame:
    """By context: n, mean, median, sd, 95 % interval (1.96 standard errors) and positive share of delta."""
    x = C("delta")
    half = 1.96 * F.stddev_samp(x) / F.sqrt(F.count(x))
    base = df.groupBy("context").agg(F.count(x).alias(f"{prefix}_n"), F.avg(x).alias(f"{prefix}_mean"), F.stddev_samp(x).alias(f"{prefix}_sd"), (F.avg(x) - half).alias(f"{prefix}_ci_low"), (F.avg(x) + half).alias(f"{prefix}_ci_high"), F.avg((x > 0).cast("int")).alias(f"{prefix}_positive"))
    return attach(base, exact_median(df, ["context"], "delta", f"{prefix}_median"), ("context",), "left")


def mean_se(results: DataFrame, keys: list[str], value: str = "log_likelihood") -> DataFrame:
    n = F.count(value)
    return results.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).alias("se"))


def region(rq: Column, rt: Column) -> Column:
    """Of a cell, by whether the query lies in the set and above the trigger. A: inside, below; B: inside, above; C: outside, below; D: outside, above. In A and D the set and ordering models differ."""
    inside, above = rq <= 3, rq < rt
    return F.when(inside & ~above, "A").when(inside, "B").when(~above, "C").otherwise("D")


def modal_regions(trials: DataFrame) -> DataFrame:
    """(context, trigger, query, region): the most frequent region of a cell's answers that have one; of equally frequent ones the first by name."""
    n = trials.where("region is not null").groupBy(*CELL, "region").agg(F.count("*").alias("n"))
    return n.groupBy(*CELL).agg(F.min_by("region", F.struct(-C("n"), "region")).alias("region"))


def region_summary(results: DataFrame, regions: DataFrame, cells: int = 30, critical_cells: int = 6) -> DataFrame:
    """Per (source, structure, context): mean log-likelihood overall and in the critical regions A and D (null without such rows), cells, and how many of those a full design has are missing.

    regions has one row for each cell; cells without one count as cells of no region.
    """
    critical, cell = C("region").isin("A", "D"), F.struct(*CELL)
    out = results.join(regions, CELL, "left").groupBy("source", "structure", "context").agg(F.avg("log_likelihood").alias("ll"), F.avg(F.when(critical, C("log_likelihood"))).alias("ll_critical"), F.countDistinct(cell).alias("cells"), F.countDistinct(F.when(critical, cell)).alias("critical_cells"))
    return out.withColumns({"missing_cells": cells - C("cells"), "missing_critical": critical_cells - C("critical_cells")})


def region_means(results: DataFrame, regions: DataFrame) -> DataFrame:
    """(source, structure, context, region, p): mean probability by region (context ALL) and by context and region, in one pass."""
    rows, keys = results.join(regions, CELL), ["source", "structure", "region"]
    sets = rows.groupingSets([[C(k) for k in keys], [C(k) for k in (*keys, "context")]], *[C(k) for k in (*keys, "context")])
    out = sets.agg(F.avg("negation_probability").alias("p"), F.grouping("context").alias("_all"))
    return out.withColumn("context", F.when(C("_all") == 1, "ALL").otherwise(C("context"))).select("source", "structure", "context", "region", "p")


def context_spread(by_context: DataFrame) -> DataFrame:
    return by_context.groupBy("context").agg((F.max("average") - F.min("average")).alias("spread"))


def scaled_top(df: DataFrame, group: str, n: int) -> DataFrame:
    """Scores scaled 0 to 100 over the table without its largest value, the n best of each group with ties."""
    kept = df.crossJoin(F.broadcast(df.agg(F.max("score").alias("_top")))).where("score < _top").drop("_top")
    ends = kept.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    scaled = kept.crossJoin(F.broadcast(ends)).withColumn("scaled", F.try_divide(100.0 * (C("score") - C("_lo")), C("_hi") - C("_lo"))).drop("_lo", "_hi")
    return scaled.withColumn("rk", F.rank().over(Window.partitionBy(group).orderBy(F.desc("scaled")))).where(C("rk") <= n)


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) number up to 8 from a uniform one, by inversion."""
    weight, term, cdf = F.lit(0), 0.36787944117144233, 0.36787944117144233
    for k in range(1, 9):
        weight = weight + F.when(u >= cdf, 1).otherwise(0)
        term /= k
        cdf += term
    return weight


def bootstrap_interval(means: DataFrame, keys: list[str], unit: str, value: str, samples: int = 1_000) -> DataFrame:
    """(keys..., ci_low, ci_high): 95 % Poisson-bootstrap interval of the mean of value over units.

    A unit brings one array, its weight in each sample and weight times value; arrays are added up in each task before
    rows move, so a key costs one array for a task, whatever its units.
    """
    u = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda b: uniform(C(unit), b, seed="boot"))
    w = F.transform(u, lambda x: poisson_weight(x).cast("double"))
    rows = means.select(*keys, unit, value, w.alias("_w")).select(*keys, F.concat(F.transform("_w", lambda x: x * C(value)), "_w").alias("_v"))
    sums = vector_sums(rows, keys, "_v")
    each = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.try_divide(C("sums")[i], C("sums")[i + samples]))
    drawn = sums.select(*keys, F.explode(each).alias("_mean"))
    return drawn.groupBy(*keys).agg(F.percentile("_mean", F.lit(0.025)).alias("ci_low"), F.percentile("_mean", F.lit(0.975)).alias("ci_high"))


def diagnostics(results: DataFrame, missing: DataFrame, samples: int = 1_000, floor: float = -23.0) -> DataFrame:
    """Per (source, structure): rows, boundaries, contexts and log-likelihoods, rows at the floor and of zero probability, rows by boundary, what is missing by reason, coverage, and the bootstrap interval of the mean of context means.

    missing holds (set_boundary, context, reason), as missing_trials gives it for all structures; imbalanced says that
    boundaries differ in rows. Coverage is rows by rows and missing ones.
    """
    x, keys, flag = C("log_likelihood"), ["source", "structure"], lambda c: F.sum(F.when(c, 1).otherwise(0))
    base = results.groupBy(*keys).agg(F.count("*").alias("rows"), F.countDistinct("set_boundary").alias("boundaries"), F.countDistinct("context").alias("contexts"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), flag(x < floor).alias("floor_rows"), flag(C("negation_probability") <= 0).alias("zero_rows"))
    base = attach(base, exact_median(results, keys, "log_likelihood"), tuple(keys), "left")
    each = results.groupBy(*keys, "set_boundary").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min("n").alias("boundary_rows_min"), F.max("n").alias("boundary_rows_max"))
    means = results.groupBy(*keys, "context").agg(F.avg(x).alias("m"))
    out = attach(attach(base, each, tuple(keys)), bootstrap_interval(means, keys, "context", "m", samples), tuple(keys))
    lost = missing.agg(F.count("*").alias("missing_rows"), F.countDistinct("set_boundary").alias("missing_boundaries"), F.countDistinct("context").alias("missing_contexts"), *[F.coalesce(flag(C("reason") == f"{r}_missing"), F.lit(0)).alias(f"missing_{r}_rows") for r in ("context", "query", "trigger")])
    spread = C("boundary_rows_max") - C("boundary_rows_min")
    return out.crossJoin(F.broadcast(lost)).withColumns({"floor_rate": C("floor_rows") / C("rows"), "zero_rate": C("zero_rows") / C("rows"), "boundary_rows_range": spread, "imbalanced": (spread > 0).cast("int"), "coverage": C("rows") / (C("rows") + C("missing_rows"))})


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n, mean, positive) of equal width from the least to the largest finite value, the last bin closed, empty ones kept; mean and number of positive values are those of all bins."""
    x = df.select(C(column).cast("double").alias("x")).where(F.abs("x") < float("inf"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.count_if(C("x") > 0).alias("positive"))
    b = F.least(F.floor((C("x") - C("lo")) / F.when(C("hi") > C("lo"), (C("hi") - C("lo")) / bins).otherwise(1.0)), F.lit(bins - 1)).cast("int")
    n = x.crossJoin(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "mean", "positive").join(n, "bin", "left").fillna(0, ["n"]).select("bin", "n", "mean", "positive")
