"""Alternative-structure models: which words a negation rules out, and how well that fits yes/no answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.functions.stats import loglik
from lexora.sources.files import saved

#: name: (needs a trigger, uses samples)
STRUCTURES = {"set": (False, True), "ordering": (True, True), "conjunction": (True, True), "disjunction": (True, True), "always_negate": (False, False), "never_negate": (False, False)}
DEFAULT = ("set", "ordering", "conjunction", "disjunction")
#: The regions that each structure negates (see reports.region).
NEGATED = {"set": ("A", "B"), "ordering": ("B", "D"), "conjunction": ("B",), "disjunction": ("A", "B", "D")}


def structures(names: list[str] | None = None, baselines: bool = False) -> list[str]:
    """Chosen structures, the four by default, with the two baselines on request; an unknown name is an error."""
    chosen = list(names or DEFAULT) + ([x for x in STRUCTURES if x.endswith("_negate")] if baselines else [])
    if unknown := [x for x in chosen if x not in STRUCTURES]:
        raise ValueError(f"unknown structures: {', '.join(unknown)}")
    return chosen


def sampled_probabilities(cells: DataFrame, positions: DataFrame, reps: int, boundaries: list[int]) -> DataFrame:
    """cells (context, trigger, query) x boundaries with p_set, p_ordering, p_conjunction, p_disjunction over repetitions.

    Each distinct cell is scored once. A repetition without the query counts 0 everywhere; one without the trigger
    counts 0 for all but the set, also for the disjunction.
    """
    q = positions.select("context", F.col("token").alias("query"), "rep", F.col("position").alias("pq"))
    t = positions.select("context", F.col("token").alias("trigger"), "rep", F.col("position").alias("pt"))
    both = cells.select("context", "trigger", "query").distinct().join(q, ["context", "query"], "left").join(t, ["context", "trigger", "rep"], "left")
    both = both.withColumn("set_boundary", F.explode(F.array(*[F.lit(b) for b in boundaries])))
    inside, above = F.col("pq") < F.col("set_boundary"), F.col("pq") < F.col("pt")
    share = lambda c: F.sum(F.when(c, 1).otherwise(0)) / float(reps)
    return both.groupBy("context", "trigger", "query", "set_boundary").agg(
        share(inside).alias("p_set"),
        share(above).alias("p_ordering"),
        share(inside & above).alias("p_conjunction"),
        share((inside | above) & F.col("pt").isNotNull()).alias("p_disjunction"),
    )


def to_long(probabilities: DataFrame, names: list[str]) -> DataFrame:
    """One row for each structure: columns structure and p."""
    value = {"always_negate": F.lit(1.0), "never_negate": F.lit(0.0)}
    rows = F.array(*[F.struct(F.lit(n).alias("structure"), value.get(n, F.col(f"p_{n}") if n not in value else None).cast("double").alias("p")) for n in names])
    keep = [c for c in probabilities.columns if not c.startswith("p_")]
    return probabilities.select(*keep, F.explode(rows).alias("_s")).select(*keep, "_s.structure", "_s.p")


#: Scored cells that go to every task; more are joined by key.
CELLS = 100_000


def scored_trials(trials: DataFrame, long: DataFrame) -> DataFrame:
    """Trials with negation_probability, probability_query_observed and log_likelihood per boundary and structure.

    The cells are saved and counted, and decide on the join: a saved table of trials is so much smaller than its rows
    that Spark would take it for the small side.
    """
    cells = saved(long, "cells")
    cells = F.broadcast(cells) if cells.count() <= CELLS else cells.hint("merge")
    out = trials.join(cells, ["context", "trigger", "query"])
    observed = F.when(F.col("neg") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return out.select("structure", "set_boundary", "context", "trigger", "query", "neg", F.col("p").alias("negation_probability"), observed.alias("probability_query_observed"), loglik(F.col("p"), F.col("neg")).alias("log_likelihood"))


def pair_order_counts(q: Column, t: Column, same: Column) -> Column:
    """Exact chance that the query is drawn before the trigger, from counts; null if undefined."""
    return F.when(same, 0.0).when(q.isNull() | t.isNull() | (q + t <= 0), None).otherwise(q / F.when(q + t > 0, q + t))


def pair_order_logprob(lq: Column, lt: Column, same: Column) -> Column:
    return F.when(same, 0.0).when(lq.isNotNull() & lt.isNotNull(), 1 / (1 + F.exp(lt - lq)))


def run_experiment(trials: DataFrame, positions: DataFrame, reps: int, boundaries: list[int], names: list[str], source: str) -> DataFrame:
    """All boundaries and structures over the trials; the nine result columns with structure and source."""
    cells = sampled_probabilities(trials, positions, reps, boundaries)
    out = scored_trials(trials, to_long(cells, names))
    return out.withColumns({"num_reps": F.lit(reps), "source": F.lit(source)})


def marginal_likelihood(counts: DataFrame, keys: list[str], low: float = 0.501, high: float = 0.999, step: float = 0.001) -> DataFrame:
    """Per key from counts (agree, total): ln of the likelihood averaged over a grid of response accuracies, and the best accuracy."""
    n = round((high - low) / step) + 1
    grid = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("accuracy", F.lit(low) + F.col("i") * step)
    ll = F.col("agree") * F.log("accuracy") + (F.col("total") - F.col("agree")) * F.log(1 - F.col("accuracy"))
    grid = grid.withColumn("ll", ll)
    top = grid.groupBy(*keys).agg(F.max("ll").alias("top"), F.max_by("accuracy", "ll").alias("best_accuracy"))
    return grid.join(top, keys).groupBy(*keys).agg((F.max("top") + F.log(F.sum(F.exp(F.col("ll") - F.col("top")))) - F.log(F.lit(float(n)))).alias("marginal"), F.max("best_accuracy").alias("best_accuracy"))


def query_gradation(halves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fitted, likelihood) of halves (context, region, query_rank, half, neg): half 1 fits, half 2 tests; the disjunction is fitted on half 2, as in the study.

    fitted: (structure, context, query_rank, total, p), the rate of "no" by query rank in the regions that the structure
    negates. likelihood: (structure, context, n, log_likelihood), the mean over test answers; outside its regions a
    structure says 0, and answers whose rank has no fitted rate are left out. Answers are counted before anything else,
    so all later steps work on a few counts for each context.
    """
    n = halves.groupBy("context", "region", "query_rank", "half", "neg").agg(F.count("*").alias("n"))
    applies = lambda s: F.col("region").isin(*NEGATED[s])
    each = F.array(*[F.struct(F.lit(s).alias("structure"), applies(s).alias("applies"), F.lit(2 if s == "disjunction" else 1).alias("fits")) for s in DEFAULT])
    rows = n.withColumn("_s", F.explode(each)).select("*", "_s.*").drop("_s")
    keys = ["structure", "context", "query_rank"]
    fitted = rows.where("applies and half = fits").groupBy(*keys).agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("neg")) / F.sum("n")).alias("p"))
    x = rows.where("half = 2").join(fitted.select(*keys, F.col("p").alias("_p")), keys, "left").withColumn("p", F.when(F.col("applies"), F.col("_p")).otherwise(0.0)).where("p is not null")
    mean = F.sum(F.col("n") * loglik(F.col("p"), F.col("neg"))) / F.sum("n")
    return fitted, x.groupBy("structure", "context").agg(F.sum("n").alias("n"), mean.alias("log_likelihood"))
