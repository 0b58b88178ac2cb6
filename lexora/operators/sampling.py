"""Weighted orderings without replacement, as an exponential race on keys that depend on values alone.

A source is a table (context, token, weight). A token's key is -ln(u) / weight with u from (seed, context,
repetition, token), so a draw is the same for any number of partitions; the smallest key comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.functions.text import uniform
from lexora.operators.vocab import attach, numbered
from lexora.sources.files import saved


def race_key(weight: Column, u: Column) -> Column:
    """Positive weights race at their rate, others at rate 1 among themselves."""
    return F.when(weight > 0, -F.log(u) / F.when(weight > 0, weight)).otherwise(-F.log(u))


def draws(source: DataFrame, reps: int, seed: int = 7, by: tuple[str, ...] = ("context",)) -> DataFrame:
    """source repeated for each repetition with its race key; repetitions are made where a token is, before any shuffle."""
    rep = source.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return rep.withColumn("key", race_key(F.col("weight"), uniform(*[F.col(c) for c in by], F.col("rep"), F.col("token"), seed=seed)))


def pilot_bounds(source: DataFrame, reps: int, k: int, seed: int = 7, by: tuple[str, ...] = ("context",), factor: int = 4) -> DataFrame:
    """(by..., bounds): for each repetition the k-th smallest key among the factor * k heaviest tokens of positive weight.

    Keys depend on values alone, so a pilot's race is a part of the whole one, and its k-th key is never below the
    whole one's. Contexts with fewer than k such tokens have no row.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "token"))
    pilot = source.where("weight > 0").withColumn("_rank", rank).where(F.col("_rank") <= factor * k).drop("_rank")
    place = F.row_number().over(Window.partitionBy(*by, "rep").orderBy("key", "token"))
    last = draws(pilot, reps, seed, by).withColumn("_place", place).where(F.col("_place") == k)
    return last.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "key"))), lambda x: x["key"]).alias("bounds"))


def within_pilot(source: DataFrame, reps: int, k: int, seed: int = 7, by: tuple[str, ...] = ("context",), factor: int = 4) -> DataFrame:
    """Draws that can be among the first k: keys up to the pilot's bound, and every draw of contexts that come out short.

    The bounds are saved, so that their size is known when Spark plans their join.
    """
    bounds = saved(pilot_bounds(source, reps, k, seed, by, factor), "pilot")
    out = draws(attach(source, bounds, by, "left"), reps, seed, by)
    bound = F.col("bounds")[F.col("rep")]
    return out.where(bound.isNull() | ((F.col("weight") > 0) & (F.col("key") <= bound))).drop("bounds")


def sample_orderings(source: DataFrame, reps: int, seed: int = 7, *, k: int | None = None, by: tuple[str, ...] = ("context",), pilot: int = 4) -> DataFrame:
    """(by..., rep, token, position): positive weights first by the race, then the others; the first k positions if given.

    With k, draws beyond the bound of a pilot (of pilot * k tokens; 0: none) go before anything is sorted, and Spark
    keeps k rows of each (context, repetition) per task before the shuffle. Without k, no task holds more of an
    ordering than its range.
    """
    made = within_pilot(source, reps, k, seed, by, pilot) if k is not None and pilot else draws(source, reps, seed, by)
    order, out = [F.desc("heavy"), F.asc("key"), F.asc("token")], made.withColumn("heavy", F.col("weight") > 0)
    if k is None:  # a whole vocabulary: ranges are sorted apart
        out = numbered(out.select(*by, "rep", "token", "heavy", "key"), order, "line", (*by, "rep")).withColumn("position", F.col("line") - 1)
    else:
        out = out.withColumn("position", F.row_number().over(Window.partitionBy(*by, "rep").orderBy(*order)) - 1).where(F.col("position") < k)
    return out.select(*by, "rep", "token", "position")


def required_positions(positions: DataFrame, required: DataFrame) -> DataFrame:
    """Positions of required (context, token) alone; a token that wasn't drawn has no row."""
    return positions.join(required.select("context", "token").distinct(), ["context", "token"], "left_semi")


def set_from_ordering(positions: DataFrame, size: int | Column) -> DataFrame:
    return positions.where(F.col("position") < size)


def sample_random_sets(source: DataFrame, reps: int, seed: int = 7) -> DataFrame:
    """Sets of a size that is uniform from 2 to the number of tokens, drawn for each repetition."""
    sizes = source.groupBy("context").agg(F.count("*").alias("_n"))
    out = sample_orderings(source, reps, seed).join(sizes, "context")
    size = (F.lit(2) + F.floor(uniform(F.col("context"), F.col("rep"), seed=f"{seed}s") * (F.col("_n") - 1))).cast("int")
    return out.withColumn("size", size).where("position < size").drop("_n")


def sample_uniform(vocab: DataFrame, reps: int, seed: int = 7) -> DataFrame:
    return sample_orderings(vocab.withColumn("weight", F.lit(1.0)), reps, seed)
