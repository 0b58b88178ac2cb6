"""Threshold models fitted by grid jobs, and grouped cross-validation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.functions.stats import binom_ll, clip, pearson, spearman_sets, structure_probs
from lexora.operators.vocab import numbered
from lexora.sources.files import saved

C = F.col

STRUCTURES = ("set", "ordering", "conjunction", "disjunction")
#: Columns that name a group of rows held out together.
KEY = ("family", "dataset", "group")


def bounds(df: DataFrame, s: float) -> DataFrame:
    """One row (low, high): the scores' range, ten scales wider on both sides."""
    return df.agg((F.min(F.least("lq", "lt")) - 10 * s).alias("low"), (F.max(F.greatest("lq", "lt")) + 10 * s).alias("high"))


def balanced_score(df: DataFrame, family: str = "family") -> DataFrame:
    """Sum of ll by sum of n per family, then the plain mean of families."""
    return df.groupBy(family).agg((F.sum("ll") / F.sum("n")).alias("score")).agg(F.avg("score").alias("balanced"))


def item_score(rate: Column, p: Column) -> Column:
    q = clip(p)
    return rate * F.log(q) + (1 - rate) * F.log1p(-q)


def vector_sums(df: DataFrame, keys: Sequence[str], vector: str, *more: Column) -> DataFrame:
    """By keys: sums, an array added element by element, and further aggregates. Spark adds arrays up in each task before rows move."""
    rows = df.withColumn("_vector", array_to_vector(vector))
    out = rows.groupBy(*keys).agg(Summarizer.sum(C("_vector")).alias("_sum"), *more)
    return out.withColumn("sums", vector_to_array("_sum")).drop("_sum")


def _at(box: Column, i: Column, shape: tuple[int, int]) -> tuple[Column, Column]:
    """Threshold and log scale at place i of a box's grid."""
    points, scales = shape
    row = F.floor(i / scales)
    theta = box["t0"] + row * ((box["t1"] - box["t0"]) / (points - 1))
    return theta, box["l0"] + (i - row * scales) * ((box["l1"] - box["l0"]) / max(scales - 1, 1))


def fit(df: DataFrame, score: Callable[[Column, Column], Column], weight: Column, *, low: Column, high: Column, scales: tuple[float, float] = (1.0, 1.0), shape: tuple[int, int] = (33, 1), rounds: int = 4, folds: Sequence[str] = (), family: Sequence[str] = ("family",)) -> DataFrame:
    """(folds..., theta, scale, objective, theta_at_bound, scale_at_bound): the best parameters of each fold by all rows outside it; of all rows where folds is empty.

    score(theta, scale) is a row's log score. The objective is the mean over families of their scores by their weights,
    in training rows alone; ties go to the smallest threshold, then scale. A grid over the whole range is followed by
    grids around each fold's own best, one cell to each side (two where scales are fitted as well).

    A round adds arrays of the grid's scores by fold in one pass, and by family for each box that some fold has; a
    fold's training score is the total less its own. Boxes are few however many folds there are, as folds share cells.
    An error if a fold leaves nothing to train on. The flags tell that a parameter lies at an end of its range, within
    1e-5 of its width (of a log scale: within 1e-5).
    """
    size, margin = shape[0] * shape[1], 1 if shape[1] == 1 else 2
    start = F.struct(low.cast("double").alias("t0"), high.cast("double").alias("t1"), F.lit(math.log(scales[0])).alias("l0"), F.lit(math.log(scales[1])).alias("l1"))
    seed = df.select(*folds).distinct() if folds else df.sparkSession.range(1).select()
    boxes = saved(seed.select(*folds, start.alias("box")).withColumn("ends", C("box")), "boxes")
    places = F.sequence(F.lit(0), F.lit(size - 1))

    def vectors(rows: DataFrame) -> DataFrame:
        def at(i: Column) -> Column:
            theta, log_scale = _at(C("box"), i, shape)
            return score(theta, F.exp(log_scale))

        return rows.select(*folds, *[c for c in family if c not in folds], "box", F.transform(places, at).alias("v"), weight.alias("w"))

    for r in range(rounds):
        every = boxes.select("box").distinct().agg(F.collect_list("box")).scalar()
        total = saved(vector_sums(vectors(df.withColumn("box", F.explode(every))), ["box", *family], "v", F.sum("w").alias("n")), "totals")
        means = total.select("box", F.transform("sums", lambda x: x / C("n")).alias("v"))
        means = vector_sums(means, ["box"], "v", F.count("*").alias("families")).withColumnRenamed("sums", "means")
        if folds:
            own = vector_sums(vectors(df.join(boxes.select(*folds, "box"), [*folds])), list(dict.fromkeys([*folds, "box", *family])), "v", F.sum("w").alias("n"))
            both = own.join(total.select("box", *family, C("sums").alias("all"), C("n").alias("all_n")), ["box", *family])
            left = C("all_n") - C("n")
            change = F.zip_with("sums", "all", lambda o, a: F.when(left > 0, (a - o) / F.when(left > 0, left)).otherwise(0.0) - a / C("all_n"))
            own = vector_sums(both.select(*folds, "box", change.alias("v"), F.when(left > 0, 0).otherwise(1).alias("gone")), [*folds, "box"], "v", F.sum("gone").alias("gone"))
            none = F.raise_error(F.lit("a fold leaves no rows to train on")).cast("double")
            count = F.when(C("families") > C("gone"), C("families") - C("gone")).otherwise(none)
            scored = own.join(means, "box").select(*folds, "box", F.zip_with("means", "sums", lambda m, c: (m + c) / count).alias("o"))
        else:
            scored = means.select("box", F.transform("means", lambda m: m / C("families")).alias("o"))
        scored = scored.select(*folds, "box", F.array_max("o").alias("objective"), (F.array_position("o", F.array_max("o")) - 1).alias("i"))
        best = scored.join(boxes.select(*folds, "box", "ends"), [*folds, "box"])
        theta, log_scale = _at(C("box"), C("i"), shape)
        best = best.select(*folds, "box", "ends", "objective", theta.alias("theta"), log_scale.alias("log_scale"))
        step = lambda a, b, n: margin * (C("box")[b] - C("box")[a]) / max(n - 1, 1)
        inside = lambda x, d, a, b: (F.greatest(C("ends")[a], x - d).alias(a), F.least(C("ends")[b], x + d).alias(b))
        narrow = F.struct(*inside(C("theta"), step("t0", "t1", shape[0]), "t0", "t1"), *inside(C("log_scale"), step("l0", "l1", shape[1]), "l0", "l1"))
        boxes = saved(best.withColumn("box", narrow), "boxes")
    near = lambda x, a, b, tolerance: (F.abs(C(x) - C("ends")[a]) <= tolerance) | (F.abs(C(x) - C("ends")[b]) <= tolerance)
    width = F.greatest(F.lit(1e-6), 1e-5 * (C("ends")["t1"] - C("ends")["t0"]))
    return boxes.select(*folds, "theta", F.exp("log_scale").alias("scale"), "objective", near("theta", "t0", "t1", width).alias("theta_at_bound"), near("log_scale", "l0", "l1", F.lit(1e-5)).alias("scale_at_bound"))


def _set_score(target: str) -> Callable[[Column, Column], Column]:
    return lambda theta, s: binom_ll(structure_probs(C("lq"), C("lt"), theta, s)[target], C("yes"), C("total"))


def fit_threshold(df: DataFrame, target: str, s: float, low: Column, high: Column, *, folds: Sequence[str] = (), points: int = 33, rounds: int = 4) -> DataFrame:
    """(folds..., theta, objective, at_bound): the threshold of the best response score, balanced over families. target is a structure that has a threshold."""
    if target not in STRUCTURES or target == "ordering":
        raise ValueError(f"no threshold in {target}")
    out = fit(df, _set_score(target), C("total"), low=low, high=high, scales=(s, s), shape=(points, 1), rounds=rounds, folds=folds)
    return out.select(*folds, "theta", "objective", C("theta_at_bound").alias("at_bound"))


def fit_threshold_scale(df: DataFrame, low: Column, high: Column, *, folds: Sequence[str] = (), s_low: float = 0.1, s_high: float = 20.0, points: int = 17, rounds: int = 3) -> DataFrame:
    """(folds..., theta, scale, objective, theta_at_bound, scale_at_bound): threshold and scale of the best item score of the set model, every item counting the same within its dataset and datasets the same."""
    score = lambda theta, s: item_score(C("rate"), structure_probs(C("lq"), C("lt"), theta, s)["set"])
    return fit(df, score, F.lit(1), low=low, high=high, scales=(s_low, s_high), shape=(points, points), rounds=rounds, folds=folds, family=("family", "dataset"))


def intercepts(df: DataFrame, folds: Sequence[str] = KEY) -> DataFrame:
    """(folds..., train_rows, test_rows, train_responses, test_responses, intercept): the rate of all rows outside each fold, from totals less its own sums."""
    own = df.groupBy(*folds).agg(F.sum("yes").alias("y"), F.sum("total").alias("test_responses"), F.count("*").alias("test_rows"))
    everything = df.agg(F.struct(F.sum("yes").alias("y"), F.sum("total").alias("n"), F.count("*").alias("rows"))).scalar()
    out = own.withColumn("all", everything).withColumns({"train_rows": C("all.rows") - C("test_rows"), "train_responses": C("all.n") - C("test_responses")})
    rate = F.when(C("train_responses") > 0, (C("all.y") - C("y")) / F.when(C("train_responses") > 0, C("train_responses")))
    return out.select(*folds, "train_rows", "test_rows", "train_responses", "test_responses", rate.alias("intercept"))


def predicted(df: DataFrame, theta: Column, s: Column) -> DataFrame:
    """df with p_ and ll_ of the four structures."""
    p = structure_probs(C("lq"), C("lt"), theta, s)
    return df.withColumns({f"p_{k}": p[k] for k in STRUCTURES}).withColumns({f"ll_{k}": binom_ll(C(f"p_{k}"), C("yes"), C("total")) for k in STRUCTURES})


def logo_cv(df: DataFrame, target: str, s: float, *, key: Sequence[str] = KEY, points: int = 33, rounds: int = 4) -> DataFrame:
    """df with theta, at_bound, p_ and ll_ of four structures, baseline and ll_baseline: one held-out prediction for each row.

    A fold is one group, named by (family, dataset, group), so groups of one name elsewhere are other folds. One
    threshold, fitted to `target` by all other groups, serves all structures; the baseline is their rate.
    """
    ends = bounds(df, s)
    fitted = fit_threshold(df, target, s, ends.select("low").scalar(), ends.select("high").scalar(), folds=key, points=points, rounds=rounds)
    told = fitted.select(*key, "theta", "at_bound").join(intercepts(df, key).select(*key, C("intercept").alias("baseline")), [*key])
    out = predicted(df.join(told, [*key]), C("theta"), F.lit(float(s)))
    return out.withColumn("ll_baseline", binom_ll(C("baseline"), C("yes"), C("total")))


def group_folds(df: DataFrame, k: int, strata: Sequence[str] = ("family", "dataset"), group: str = "group") -> DataFrame:
    """df with fold: the index of its group among the sorted groups of its family and dataset, mod k.

    An error unless k is 2 at least and each dataset has k groups. Groups are numbered by ranges, so no task holds a
    dataset's groups. A group is one of its dataset: the same name in another is another group.
    """
    if k < 2:
        raise ValueError("there must be two folds at least")
    groups = numbered(df.select(*strata, group).distinct(), [C(group)], "_i", by=tuple(strata))
    n = groups.groupBy(*strata).agg(F.count("*").alias("_n"))
    few = F.raise_error(F.concat(F.lit("fewer groups than folds in "), F.concat_ws(", ", *strata))).cast("int")
    folds = groups.join(n, [*strata]).select(*strata, group, F.when(C("_n") < k, few).otherwise(((C("_i") - 1) % k).cast("int")).alias("fold"))
    return df.join(folds, [*strata, group])


def cv_predictions(units: DataFrame, *, points: int = 17, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(predictions, parameters) of units with a fold: threshold and scale of each fold by the others, four structures and the intercept for each unit.

    The intercept is the mean rate of the unit's dataset in the other folds; an error where it has none there.
    """
    q = units.agg((F.min("lq") - 10).alias("low"), (F.max("lq") + 10).alias("high"))
    fitted = saved(fit_threshold_scale(units, q.select("low").scalar(), q.select("high").scalar(), folds=["fold"], points=points, rounds=rounds), "fitted")
    own = units.groupBy("family", "dataset", "fold").agg(F.sum("rate").alias("r"), F.count("*").alias("n"))
    every = own.groupBy("family", "dataset").agg(F.sum("r").alias("all_r"), F.sum("n").alias("all_n"))
    left = C("all_n") - C("n")
    none = F.raise_error(F.lit("a dataset has no training rows for its intercept")).cast("double")
    means = own.join(every, ["family", "dataset"]).select("family", "dataset", "fold", F.when(left > 0, (C("all_r") - C("r")) / F.when(left > 0, left)).otherwise(none).alias("intercept"))
    out = units.join(fitted.select("fold", "theta", "scale"), "fold").join(means, ["family", "dataset", "fold"])
    groups = units.groupBy("fold").agg(F.count("*").alias("test_rows"), F.countDistinct(*KEY).alias("test_groups"))
    all_of = units.agg(F.struct(F.count("*").alias("rows"), F.countDistinct(*KEY).alias("groups"))).scalar()
    told = groups.withColumn("all", all_of).select("fold", (C("all.rows") - C("test_rows")).alias("train_rows"), "test_rows", (C("all.groups") - C("test_groups")).alias("train_groups"), "test_groups")
    return predicted(out, C("theta"), C("scale")), told.join(fitted, "fold")


# ---------------------------------------------------------------- tables


def heldout_summary(pred: DataFrame) -> DataFrame:
    """By structure, over all rows and by (family, dataset, condition): items, responses, r, rho, log-likelihoods in total and by response, those of the baseline, and the difference."""
    each = F.array(*[F.struct(F.lit(k).alias("structure"), C(f"p_{k}").alias("p"), C(f"ll_{k}").alias("ll")) for k in STRUCTURES])
    rows = pred.select("family", "dataset", "condition", "total", "rate", "ll_baseline", F.explode(each).alias("m")).select("*", "m.*").drop("m")
    keys = ["family", "dataset", "condition"]
    sums = rows.groupingSets([["structure"], ["structure", *keys]], "structure", *keys).agg(
        F.grouping_id().alias("set"), F.grouping("family").alias("overall"), F.count("*").alias("items"), F.sum("total").alias("responses"), pearson(C("p"), C("rate")).alias("r"), F.sum("ll").alias("ll"), F.sum("ll_baseline").alias("baseline_ll")
    )
    scope = F.when(C("overall") == 1, "all").otherwise(F.concat_ws("::", *keys))
    sums = sums.withColumns({"scope_type": F.when(C("overall") == 1, "overall").otherwise("condition"), "scope": scope})
    ranks = spearman_sets(rows, [["structure"], ["structure", *keys]], "p", "rate").select(*[C(c).alias(f"_{c}") for c in ("set", "structure", *keys)], "rho")
    out = sums.join(ranks, [C(c).eqNullSafe(C(f"_{c}")) for c in ("set", "structure", *keys)], "left")
    by = lambda c: C(c) / C("responses")
    return out.select("scope_type", "scope", "structure", "items", "responses", "r", "rho", "ll", by("ll").alias("mean_ll"), "baseline_ll", by("baseline_ll").alias("baseline_mean_ll"), ((C("ll") - C("baseline_ll")) / C("responses")).alias("delta_mean_ll"))


def correlation_table(pred: DataFrame, rows: Sequence[str]) -> DataFrame:
    """A row for each dataset in the order of `rows` (position, from 1): items, count status, and r of six scores with the rate.

    r of the framed score is null unless every item has one. An error for a dataset that isn't in rows, and for more
    than one count status within one.
    """
    name = F.concat_ws("-", "family", "dataset")
    place = F.array_position(F.array(*[F.lit(x) for x in rows]), C("analysis_id"))
    unknown = F.raise_error(F.concat(F.lit("unknown table row "), C("analysis_id"))).cast("long")
    mixed = F.raise_error(F.lit("one dataset has more than one count status")).cast("string")
    r = lambda c: pearson(C(c), C("rate"), 3)
    out = pred.withColumn("analysis_id", name).groupBy("analysis_id").agg(
        F.count("*").alias("n"),
        F.when(F.countDistinct("status") == 1, F.min("status")).otherwise(mixed).alias("status"),
        F.when(F.count("x") == F.count("*"), r("x")).alias("r_x_but_not_y"),
        r("lq").alias("r_no_frame"),
        *[r(f"p_{k}").alias(f"r_{k}") for k in STRUCTURES],
    )
    return out.withColumn("position", F.when(place > 0, place).otherwise(unknown))


def score_table(pred: DataFrame) -> DataFrame:
    """By dataset and each of five models: mean item score, its difference to the intercept's, and response scores where every row has exact counts."""
    models = {"intercept": C("intercept"), **{k: C(f"p_{k}") for k in STRUCTURES}}
    each = F.array(*[F.struct(F.lit(k).alias("model"), p.alias("p")) for k, p in models.items()])
    rows = pred.select(F.concat_ws("-", "family", "dataset").alias("analysis_id"), "status", "rate", "yes", "total", item_score(C("rate"), C("intercept")).alias("base"), F.explode(each).alias("m"))
    rows = rows.select("*", "m.*").withColumns({"item": item_score(C("rate"), C("p")), "ll": F.when(C("status") == "exact", binom_ll(C("p"), C("yes"), C("total")))})
    exact = F.every(C("status") == "exact")
    out = rows.groupBy("analysis_id", "model").agg(
        F.count("*").alias("n"), F.avg("item").alias("item_score"), (F.avg("item") - F.avg("base")).alias("delta_item_score"), F.when(exact, F.sum("ll")).alias("response_ll"), F.when(exact, F.sum("total")).alias("responses")
    )
    return out.withColumn("response_score", C("response_ll") / C("responses"))


def widen_scores(correlations: DataFrame, scores: DataFrame) -> DataFrame:
    """The correlation table with item and response scores of each structure as columns."""
    wide = scores.groupBy("analysis_id").pivot("model", list(STRUCTURES)).agg(F.first("item_score").alias("item_score"), F.first("response_score").alias("response_score"))
    return correlations.join(wide, "analysis_id", "left")
