"""Next-word distributions and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.sources.files import observed, saved


def cloze_positive(responses: DataFrame) -> DataFrame:
    """(context, word, frequency, cloze_probability): answers by participants who gave any in the context."""
    people = responses.groupBy("context").agg(F.countDistinct("participant").alias("_n"))
    words = responses.groupBy("context", "word").agg(F.count("*").alias("frequency"))
    return words.join(people, "context").select("context", "word", "frequency", (F.col("frequency") / F.col("_n")).alias("cloze_probability"))


def cloze_negative(frequencies: DataFrame, positive: DataFrame) -> DataFrame:
    """Negative answers get flipped ranks below the smallest positive probability: (1 - f / max f) * (min p - 1e-12), 0 where that has no meaning."""
    cap = positive.where("cloze_probability > 0").groupBy("context").agg((F.min("cloze_probability") - 1e-12).alias("_cap"))
    top = F.col("_top")
    p = F.when((F.col("_cap") > 0) & (top > 0), F.greatest(F.lit(0.0), 1 - F.col("frequency") / top) * F.col("_cap")).otherwise(0.0)
    return with_total(frequencies, F.max("frequency"), "_top").join(cap, "context", "left").withColumn("cloze_probability", p).drop("_cap", "_top")


def merge_cloze(df: DataFrame) -> DataFrame:
    """Sums by (context, word_key) with the label of the largest weight, spaced words first."""
    best = F.max_by("word", F.struct(F.col("word").contains(" "), F.col("cloze_probability"), F.col("word")))
    return df.groupBy("context", "word_key").agg(F.sum("frequency").alias("frequency"), F.sum("cloze_probability").alias("cloze_probability"), best.alias("label"))


def restrict_cloze(df: DataFrame, max_words: int) -> DataFrame:
    """Words of at most max_words parts, repeats summed and counted, probabilities renormalised by context."""
    kept = df.where(F.size(F.split(F.trim("word"), r"\s+")) <= max_words).groupBy("context", "word").agg(F.sum("cloze_probability").alias("p"), F.count("*").alias("sources"))
    return with_total(kept, F.sum("p"), "_t").withColumn("p", F.col("p") / F.col("_t")).drop("_t")


def cloze_source(df: DataFrame) -> DataFrame:
    """(context, token, weight), normalised; a context without mass is an error. Tokens match exactly, neither trimmed nor lowered."""
    total = F.col("_t")
    bad = F.raise_error(F.concat(F.lit("no probability mass in "), F.col("context"))).cast("double")
    return with_total(df, F.sum("cloze_probability"), "_t").select("context", F.col("word").alias("token"), F.when(total > 0, F.col("cloze_probability") / F.when(total > 0, total)).otherwise(bad).alias("weight"))


def frequency_source(counts: DataFrame, required: DataFrame, *, background: int | None = None, cap: int | None = None, keep_zero: bool = False) -> DataFrame:
    """(token, weight) of the required tokens alone, of the `background` most frequent and the required ones, or of exactly the `cap` most frequent."""
    order = [F.desc("count"), F.asc("token")]
    if cap is not None:
        return counts.orderBy(*order).limit(cap).select("token", F.col("count").alias("weight"))
    need = required.select("token").distinct().join(counts.select("token", "count"), "token", "left").select("token", F.coalesce("count", F.lit(0)).alias("weight"))
    if not keep_zero or background is not None:
        need = need.where("weight > 0")
    if background is None:
        need, seen = observed(need, "required", positive=F.count_if(F.col("weight") > 0))
        if not seen["positive"]:
            raise ValueError("no required token has a count")
        return need
    top = counts.where("count > 0").orderBy(*order).limit(background).select("token", F.col("count").alias("weight"))
    return top.unionByName(need.join(top.select("token"), "token", "left_anti"))


def logprob_source(scores: DataFrame, top: int, required: DataFrame | None = None) -> DataFrame:
    """(context, token, weight): the top finite scores of a context and its required words, as a softmax."""
    finite = scores.where(~F.isnan("logprob") & (F.abs("logprob") < float("inf"))).select("context", "token", "logprob")
    rank = F.row_number().over(Window.partitionBy("context").orderBy(F.desc("logprob"), "token"))
    kept = finite.withColumn("_rk", rank).where(F.col("_rk") <= top).drop("_rk")  # each task keeps `top` rows of a context
    if required is not None:
        kept = kept.unionByName(finite.join(required.select("context", "token").distinct(), ["context", "token"], "left_semi")).distinct()
    best = with_total(kept, F.max("logprob"), "_m").withColumn("_e", F.exp(F.col("logprob") - F.col("_m")))
    return with_total(best, F.sum("_e"), "_t").select("context", "token", (F.col("_e") / F.col("_t")).alias("weight"))


def uniform_source(vocab: DataFrame, k: int) -> DataFrame:
    """Per context: N, P(in a set of k) and P(above) when all words are alike."""
    return vocab.groupBy("context").agg(F.count("*").alias("n")).select("context", "n", F.least(F.lit(1.0), k / F.col("n")).alias("p_set"), F.lit(0.5).alias("p_above"))


def vocab_at_least(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(token, count, line) of tokens at least as frequent as the rarest target; a target without a count is an error."""
    need = targets.select("token").distinct().join(counts, "token", "left")
    least = need.agg(F.min(F.coalesce("count", F.lit(0))).alias("_least"))
    bad = F.raise_error(F.lit("a target has no count")).cast("boolean")
    kept = counts.crossJoin(F.broadcast(least)).where(F.when(F.col("_least") > 0, F.col("count") >= F.col("_least")).otherwise(bad))
    return numbered(kept.select("token", "count"), [F.desc("count"), F.asc("token")])


def with_total(df: DataFrame, total: Column, name: str, by: tuple[str, ...] = ("context",)) -> DataFrame:
    """df with an aggregate of its group: summed map-side and joined, so that a large group is in no single task."""
    return attach(df, df.groupBy(*by).agg(total.alias(name)), by)


def attach(df: DataFrame, groups: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """df with the other columns of groups, which has one row for each `by`; a null group meets itself."""
    named = groups.withColumnsRenamed({c: f"_of_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return df.join(named, on, how).drop(*[f"_of_{c}" for c in by])


def numbered(df: DataFrame, order: list, name: str = "line", by: tuple[str, ...] = ()) -> DataFrame:
    """df with 1-based numbers in the given order (within `by`): ranges are sorted apart, and numbers offset by the rows of ranges before.

    Spark samples df once to find the ranges. The sorted rows are saved with their places, as a second run of the
    same plan may cut other ranges.
    """
    keys = [F.col(c) for c in by]
    ranged = saved(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    rows = ranged.withColumn("_p", F.shiftright("_m", 33))
    parts = rows.groupBy("_p", *by).agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.select("_p", *by, (before - F.col("_first") + 1).alias("_b"))
    return attach(rows, base, ("_p", *by)).select(*df.columns, (F.col("_m") + F.col("_b")).alias(name))


def bigram_scores(bigrams: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(token, count, score): count of the pair by count of its first word; pairs whose first word has none are left out."""
    first = unigrams.where("count > 0").select(F.col("token").alias("w1"), F.col("count").alias("n1"))
    return bigrams.withColumn("w1", F.substring_index("token", " ", 1)).join(first, "w1").select("token", "count", (F.col("count") / F.col("n1")).alias("score"))


def background_bigrams(scored: DataFrame, n: int) -> DataFrame:
    """The n best by (score, count, larger token), ranked by (score, count, smaller token)."""
    top = scored.orderBy(F.desc("score"), F.desc("count"), F.desc("token")).limit(n)
    return top.withColumn("background_rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("count"), "token")))


def select_bigrams(required: DataFrame, family: DataFrame, background: DataFrame, budget: int, core: int, exact: bool = True) -> DataFrame:
    """Per context budget tokens: required, then family (context, token, score), then background; a token counts for its first source.

    A context with more required tokens than the budget is an error, and with exact one that comes out short as well.
    """
    contexts = required.select("context").distinct()
    null = F.lit(None).cast("double")
    a = required.select("context", "token", F.lit(0).alias("_s"), null.alias("_o"))
    b = family.select("context", "token", F.lit(1).alias("_s"), (-F.col("score")).alias("_o"))
    c = contexts.crossJoin(F.broadcast(background.select("token", "background_rank"))).select("context", "token", F.lit(2).alias("_s"), F.col("background_rank").cast("double").alias("_o"))
    first = a.unionByName(b).unionByName(c).groupBy("context", "token").agg(F.min(F.struct("_s", "_o")).alias("f")).select("context", "token", "f._s", "f._o")
    sizes = first.groupBy("context").agg(F.count_if(F.col("_s") == 0).alias("_required"), F.count("*").alias("_all"))
    wrong = lambda why: F.raise_error(F.concat(F.lit(why), F.col("context"))).cast("int")
    checked = F.when(F.col("_required") > budget, wrong("more required tokens than the budget in ")).when(F.lit(exact) & (F.col("_all") < budget), wrong("fewer tokens than the budget in ")).otherwise(budget)
    first = attach(first, sizes.select("context", checked.alias("_budget")), ("context",))
    ranked = first.withColumn("_k", F.row_number().over(Window.partitionBy("context").orderBy("_s", "_o", "token"))).where((F.col("_k") <= budget) & (F.col("_k") <= F.col("_budget")))
    source = F.when(F.col("_s") == 0, "required").when(F.col("_s") == 1, "family").when(F.col("_o") <= core, "background_core").otherwise("background_overflow")
    return ranked.select("context", "token", source.alias("selection_source"), F.col("_k").alias("line_no"))


def union_vocab(selected: DataFrame) -> DataFrame:
    """Distinct tokens with the largest count of any context, numbered in token order."""
    return numbered(selected.groupBy("token").agg(F.max("count").alias("count")), [F.asc("token")])


def fill_counts(unigrams: DataFrame, raw: DataFrame, words: DataFrame) -> DataFrame:
    """unigrams with counts from the raw table for wanted words they lack; still none is an error."""
    absent = words.select("token").distinct().join(unigrams.select("token"), "token", "left_anti").join(raw, "token", "left")
    bad = F.raise_error(F.concat(F.lit("no count for "), F.col("token"))).cast("long")
    return unigrams.select("token", "count").unionByName(absent.select("token", F.when(F.col("count") > 0, F.col("count")).otherwise(bad).alias("count")))


def support_mass(support: DataFrame, counts: DataFrame) -> DataFrame:
    """Per context: tokens, positive and zero ones, the sum of counts and of global probabilities."""
    total = counts.agg(F.sum("count").alias("_t"))
    x = support.join(counts, "token", "left").crossJoin(F.broadcast(total)).withColumn("count", F.coalesce("count", F.lit(0)))
    return x.groupBy("context").agg(F.count("*").alias("tokens"), F.sum((F.col("count") > 0).cast("int")).alias("positive"), F.sum((F.col("count") <= 0).cast("int")).alias("zero"), F.sum("count").alias("count"), F.sum(F.col("count") / F.col("_t")).alias("probability"))


def top_words(source: DataFrame, k: int, ties: bool = False) -> DataFrame:
    """The k largest weights of a context; with ties, all words as large as the k-th."""
    rank = F.rank().over(Window.partitionBy("context").orderBy(F.desc("weight"))) if ties else F.row_number().over(Window.partitionBy("context").orderBy(F.desc("weight"), "token"))
    return source.withColumn("rk", rank).where(F.col("rk") <= k)


def word_position(source: DataFrame, words: DataFrame) -> DataFrame:
    """words (context, token) with their 0-based position by weight; null if absent."""
    pos = numbered(source.select("context", "token", "weight"), [F.desc("weight"), F.asc("token")], "_k", ("context",)).select("context", "token", (F.col("_k") - 1).alias("position"))
    return words.join(pos, ["context", "token"], "left")


def available_contexts(scores: DataFrame, required: DataFrame, target: int) -> DataFrame:
    """Contexts with target scored words at least and no required word missing."""
    done = scores.where(~F.isnan("logprob")).groupBy("context").agg(F.count("*").alias("scored"))
    short = required.select("context", "token").distinct().join(scores.where(~F.isnan("logprob")).select("context", "token"), ["context", "token"], "left_anti").select("context").distinct()
    return done.where(F.col("scored") >= target).join(short, "context", "left_anti")
