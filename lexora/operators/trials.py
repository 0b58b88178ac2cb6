"""Trials: preparation, filters, support and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.functions.text import clean_word, match_key, ngram_kind, norm_text, normalize_display, require
from lexora.sources.files import observed


def canonicalize(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """df with canonical: the alias table's (context, key -> canonical), else the key itself."""
    return df.join(aliases.select("context", "key", "canonical"), ["context", "key"], "left").withColumn("canonical", F.coalesce("canonical", "key"))


def force_label(df: DataFrame, labels: DataFrame, *, human: str, fallback: str) -> DataFrame:
    """df with label: the human's, else the one forced for (context, key), else the fallback."""
    out = df.join(labels.select("context", "key", "forced"), ["context", "key"], "left")
    return out.withColumn("label", F.coalesce(human, "forced", fallback)).drop("forced")


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def prepare_trials(df: DataFrame) -> DataFrame:
    """context from story, words from their cleaned columns or else the raw ones; cleaned where absent."""
    context = "story" if "story" in df.columns else "context"
    require(df, context)
    out = df if context == "context" else df.withColumn("context", F.col("story"))
    for word in ("query", "trigger"):
        cleaned = f"cleaned_{word}"
        require(out, cleaned if cleaned in out.columns else word)
        if cleaned not in out.columns:
            out = out.withColumn(cleaned, clean_word(F.col(word)))
        out = out.withColumn(word, F.col(cleaned))
    return out


def filter_contexts(df: DataFrame, names: list[str] | None = None, first: int | None = None, row: str = "row_id") -> DataFrame:
    """Listed contexts, or the first so many by order of their first row."""
    if names is not None:
        df = df.where(F.col("context").isin(*names))
    if first is not None:
        head = df.groupBy("context").agg(F.min(row).alias("_first")).orderBy("_first", "context").limit(first)
        df = df.join(head.select("context"), "context", "left_semi")
    return df


def keep_available(trials: DataFrame, source: DataFrame) -> tuple[DataFrame, int]:
    """Trials of contexts that the source has, and how many were dropped; an error if none is left."""
    known = source.select("context").distinct().withColumn("_known", F.lit(1))
    marked = trials.join(known, "context", "left")
    kept, n = observed(marked, "available", F.col("_known") == 1, all=F.count("*"), kept=F.count("_known"))
    if not n["kept"]:
        raise ValueError("no trial's context is in the source")
    return kept.drop("_known"), n["all"] - n["kept"]


def support(df: DataFrame, word: str = "token") -> DataFrame:
    """Distinct cleaned (context, token), no empty ones."""
    return df.select("context", clean_word(F.col(word)).alias("token")).where("token <> ''").distinct()


def with_support(trials: DataFrame, words: DataFrame, need_trigger: bool = True) -> DataFrame:
    """trials with reason: why a trial can't be scored, in order context, query, trigger; null if it can."""
    known = words.select("context", "token").distinct()
    contexts = known.select("context").distinct().withColumn("_c", F.lit(1))
    q = known.select("context", F.col("token").alias("query"), F.lit(1).alias("_q"))
    t = known.select("context", F.col("token").alias("trigger"), F.lit(1).alias("_t"))
    out = trials.join(contexts, "context", "left").join(q, ["context", "query"], "left").join(t, ["context", "trigger"], "left")
    reason = F.when(F.col("_c").isNull(), "context_missing").when(F.col("_q").isNull(), "query_missing")
    if need_trigger:
        reason = reason.when(F.col("_t").isNull(), "trigger_missing")
    return out.withColumn("reason", reason).drop("_c", "_q", "_t")


def unique_tokens(df: DataFrame, position: str = "pos", word: str = "token") -> DataFrame:
    """Cleaned tokens with their first position."""
    return df.select(clean_word(F.col(word)).alias("token"), position).where("token <> ''").groupBy("token").agg(F.min(position).alias("first"))


def required_tokens(trials: DataFrame) -> DataFrame:
    """Distinct (context, token) of all queries and triggers."""
    return trials.select("context", F.explode(F.array("query", "trigger")).alias("token")).distinct()


def missing_trials(trials: DataFrame, words: DataFrame, boundaries: list[int], structures: list[str], capped: bool = False) -> DataFrame:
    """Per boundary the trials that no structure scores, with a reason: a missing trigger drops a trial for all structures as soon as one needs it."""
    only_set = structures == ["set"]
    marked = with_support(trials, words, need_trigger=not set(structures) <= {"set", "always_negate", "never_negate"})
    if only_set and capped:
        marked = marked.withColumn("reason", F.when(F.col("reason") != "query_missing", F.col("reason")))
    return marked.where("reason is not null").withColumn("set_boundary", F.explode(F.array(*[F.lit(b) for b in boundaries])))


def pair_grid(trials: DataFrame, per_context: int | None = None) -> DataFrame:
    """Distinct (context, trigger, query) of two different, non-empty words; with per_context, another number of pairs in a context is an error."""
    grid = trials.where("trigger <> '' and query <> '' and trigger <> query").select("context", "trigger", "query").distinct()
    if per_context is not None:
        wrong = grid.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") != per_context).orderBy("context").limit(5).collect()
        if wrong:
            raise ValueError(f"not {per_context} pairs: {', '.join(str((r['context'], r['n'])) for r in wrong)}")
    return grid


def human_words(trials: DataFrame) -> DataFrame:
    """Words that people saw: (context, human_word, word_key)."""
    shown = required_tokens(trials).select("context", normalize_display(F.col("token")).alias("human_word"))
    return shown.select("context", "human_word", match_key(F.col("human_word")).alias("word_key")).distinct()


def missing_words(human: DataFrame, cloze: DataFrame) -> DataFrame:
    return human.join(cloze.select("context", "word_key").distinct(), ["context", "word_key"], "left_anti")


def drop_overlap(df: DataFrame) -> DataFrame:
    """df (context, word, positive) without negative words that are positive ones in the same context."""
    yes = df.where("positive").select("context", "word").distinct()
    return df.where("positive").unionByName(df.where("not positive").join(yes, ["context", "word"], "left_anti").select(*df.columns))


def target_words(trials: DataFrame) -> DataFrame:
    """Distinct lower-case words of one or two parts with their kind."""
    out = required_tokens(trials).select(F.lower(F.trim("token")).alias("token")).distinct()
    return out.withColumn("kind", ngram_kind(F.col("token"))).where("kind <> 'unsupported'")


def align(results: DataFrame, reference: str, target: str) -> DataFrame:
    """results where the target source has only keys that the reference source has; as they are when either is missing."""
    keys = ["context", "trigger", "query"]
    ref = results.where(F.col("source") == reference).select(*keys).distinct()
    known = results.where(F.col("source") == target)
    both = results.groupBy().agg(F.max((F.col("source") == reference).cast("int")).alias("_has"))
    kept = known.join(ref.withColumn("_in", F.lit(1)), keys, "left").crossJoin(F.broadcast(both)).where("_in = 1 or coalesce(_has, 0) = 0").select(*results.columns)
    return results.where(F.col("source") != target).unionByName(kept)


def attach_prompts(df: DataFrame, prompts: DataFrame) -> DataFrame:
    """Inner join on the context in Unicode NFC."""
    left = df.withColumn("_c", norm_text(F.col("context")))
    return left.join(prompts.select(norm_text(F.col("context")).alias("_c"), "prompt"), "_c").drop("_c")
