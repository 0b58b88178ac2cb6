"""Reliability and agreement: split halves, rank agreement, classification."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexora.functions.stats import pearson, spearman, spearman_sets
from lexora.functions.text import uniform
from lexora.operators.vocab import attach, numbered

C = F.col


def _tail(x: float, rest: float, a: float, b: float) -> float:
    """Regularised incomplete beta function at x = 1 - rest, where a or b is 1/2, by its continued fraction; steps grow with the root of a and b at most."""
    if x <= 0 or rest <= 0:
        return float(rest <= 0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _tail(rest, x, b, a)
    k = max(a, b)
    # ln gamma(k + 1/2) - ln gamma(k): for large k by its series, as the difference of two large numbers loses digits
    gain = math.lgamma(k + 0.5) - math.lgamma(k) if k < 1_000 else 0.5 * math.log(k) - 1 / (8 * k) + 1 / (192 * k**3)
    log = lambda v, other: math.log(v) if v < 0.5 else math.log1p(-other)
    front = math.exp(gain - math.lgamma(0.5) + a * log(x, rest) + b * log(rest, x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    value, m = d, 0
    while True:
        m += 1
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + part * d) or tiny), (1 + part / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14 or m > 1_000_000:
            return front * value


@F.pandas_udf(T.DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom; null below 3 rows. On summary rows only."""

    def one(r, n) -> float | None:
        if r is None or n is None or r != r or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else min(1.0, _tail((1 - r) * (1 + r), r * r, (int(n) - 2) / 2, 0.5))

    return pd.Series([one(a, b) for a, b in zip(r, n)])


def correlation_report(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """For all rows (group ALL) and each group: n, distinct x and y, Pearson and Spearman, p of Pearson, and why r is undefined.

    All of it and the groups are grouping sets of one pass; rows without a group are a group of their own (null).
    """
    both = df.select(C(group).alias("group"), C(x).alias("x"), C(y).alias("y")).where("x is not null and y is not null")
    sets = [[], ["group"]]
    base = both.groupingSets(sets, "group").agg(F.grouping_id().alias("set"), F.count("*").alias("n"), F.countDistinct("x").alias("x_unique"), F.countDistinct("y").alias("y_unique"), pearson(C("x"), C("y")).alias("r"))
    ranks = spearman_sets(both, sets, "x", "y").select(C("set").alias("_set"), C("group").alias("_group"), "rho")
    why = F.when(C("n") < 2, "fewer_than_two_points").when(C("x_unique") < 2, "constant_x").when(C("y_unique") < 2, "constant_y")
    out = base.where("n > 0").join(ranks, C("set").eqNullSafe(C("_set")) & C("group").eqNullSafe(C("_group")), "left")
    name = F.when(C("set") == 1, "ALL").otherwise(C("group"))
    return out.select(name.alias("group"), "n", "x_unique", "y_unique", "r", "rho", why.alias("undefined_reason"), p_value("r", "n").alias("p_value"))


def halves(df: DataFrame, cell: list[str], unit: str, seed: str, first_larger: bool = True) -> DataFrame:
    """df with half 1 or 2: units of each cell in a fixed random order; an odd one goes to the first half, or else to the second."""
    u = df.withColumn("_u", uniform(*[C(c) for c in cell], C(unit), seed=seed))
    placed = numbered(u, [F.asc("_u"), F.asc(unit)], "_k", tuple(cell))
    sizes = placed.groupBy(*cell).agg(F.max("_k").alias("_n"))
    cut = F.ceil(C("_n") / 2) if first_larger else F.floor(C("_n") / 2)
    return attach(placed, sizes, tuple(cell)).withColumn("half", F.when(C("_k") <= cut, 1).otherwise(2)).drop("_u", "_k", "_n")


def split_half(trials: DataFrame, seed: str = "split") -> DataFrame:
    """Per (context, trigger, query): the rate of either half."""
    cell = ["context", "trigger", "query"]
    h = halves(trials, cell, "user_id", seed)
    rate = lambda k: F.avg(F.when(C("half") == k, C("neg"))).alias(f"rate_{k}")
    return h.groupBy(*cell).agg(rate(1), rate(2))


def split_half_words(responses: DataFrame, splits: int, add: float = 1.0) -> DataFrame:
    """(context, split, rho): participants halved anew for each split, counts plus one over the vocabulary of the context, Spearman."""
    people = responses.select("context", "participant").distinct().withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    h = halves(people, ["context", "split"], "participant", "words", first_larger=False)
    n = responses.join(h, ["context", "participant"]).groupBy("context", "split", "word").agg(F.sum((C("half") == 1).cast("int")).alias("a"), F.sum((C("half") == 2).cast("int")).alias("b"))
    full = n.select("context", "split", (C("a") + add).alias("a"), (C("b") + add).alias("b"))  # every word of the context is in one half at least
    return spearman(full, ["context", "split"], "a", "b")


def half_vs_source(responses: DataFrame, source: DataFrame, seed: str = "half") -> DataFrame:
    """(half, context, n, rho): each half's shares over the source's words, 0 where absent."""
    h = halves(responses.select("context", "participant", "word").distinct(), ["context"], "participant", seed)
    size = h.groupBy("context", "half").agg(F.countDistinct("participant").alias("people"))
    share = h.groupBy("context", "half", "word").agg(F.count("*").alias("n")).join(size, ["context", "half"]).select("context", "half", "word", (C("n") / C("people")).alias("p"))
    words = source.groupBy("context", C("token").alias("word")).agg(F.max("weight").alias("weight")).withColumn("half", F.explode(F.array(F.lit(1), F.lit(2))))
    return spearman(words.join(share, ["context", "half", "word"], "left").fillna(0.0, ["p"]), ["half", "context"], "p", "weight")


def rank_agreement(df: DataFrame, keys: list[str], x: str, y: str, min_items: int = 3) -> DataFrame:
    """By keys: n_items, spearman_rho and the sums of both sides, for min_items finite rows at least."""
    out = spearman(df, keys, x, y, more=[F.sum(x).alias("sum_x"), F.sum(y).alias("sum_y")])
    return out.where(C("n") >= min_items).select(*keys, C("n").alias("n_items"), C("rho").alias("spearman_rho"), "sum_x", "sum_y")


def agreement_summary(df: DataFrame, by: str) -> DataFrame:
    """By source: contexts, mean rho and the mean weighted by items, over defined rhos."""
    ok = df.where("spearman_rho is not null")
    return ok.groupBy(by).agg(F.count("*").alias("contexts_evaluated"), F.avg("spearman_rho").alias("mean_spearman"), (F.sum(C("spearman_rho") * C("n_items")) / F.sum("n_items")).alias("weighted_spearman"))


def classification_report(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """One row: the confusion table, accuracy, precision, recall, F1 and Cohen's kappa; null where a base is 0."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t = df.agg(n((truth == 1) & (said == 1)).alias("tp"), n((truth == 0) & (said == 1)).alias("fp"), n((truth == 1) & (said == 0)).alias("fn"), n((truth == 0) & (said == 0)).alias("tn"))
    total = C("tp") + C("fp") + C("fn") + C("tn")
    accuracy, precision, recall = F.try_divide(C("tp") + C("tn"), total), F.try_divide(C("tp"), C("tp") + C("fp")), F.try_divide(C("tp"), C("tp") + C("fn"))
    chance = F.try_divide((C("tp") + C("fp")) * (C("tp") + C("fn")) + (C("fn") + C("tn")) * (C("fp") + C("tn")), (total * total).cast("double"))
    return t.select("tp", "fp", "fn", "tn", accuracy.alias("accuracy"), precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"), F.try_divide(accuracy - chance, 1 - chance).alias("kappa"))
