"""Canonical observation tables, scoring manifests and scoring jobs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.functions.stats import finite
from lexora.functions.text import fingerprint
from lexora.sources.files import observed

C = F.col
VERSION = "1.1"

#: The canonical columns in order.
COLUMNS = (
    "schema_version", "dataset_family", "dataset", "condition", "item_id", "group_id", "context_id", "generation_frame", "generation_prompt", "trigger", "query", "human_outcome",
    "human_yes", "human_total", "human_rate", "human_count_status",
    "trigger_logprob_sum", "query_logprob_sum", "trigger_logprob_mean", "query_logprob_mean", "trigger_token_count", "query_token_count", "trigger_tokenization_mode", "query_tokenization_mode",
    "x_but_not_y_applicable", "x_but_not_y_prompt", "x_but_not_y_logprob_sum", "x_but_not_y_logprob_mean", "x_but_not_y_token_count", "x_but_not_y_tokenization_mode",
    "model_name", "model_revision", "model_provenance_complete", "source_human_file", "source_score_file",
)

KEY = ("dataset_family", "dataset", "condition", "item_id")
NAMED = ("schema_version", "dataset_family", "dataset", "condition", "item_id", "group_id", "context_id", "generation_frame", "generation_prompt", "trigger", "query", "human_outcome", "human_count_status", "model_name")


def _score_rule(prefix: str) -> Column:
    """A score is wrong if its sum is positive or its mean isn't sum by tokens."""
    s, m, n = C(f"{prefix}_logprob_sum"), C(f"{prefix}_logprob_mean"), C(f"{prefix}_token_count")
    return F.coalesce((s > 0) | (n < 1) | (F.abs(m * n - s) > 1e-8 * F.greatest(F.lit(1.0), F.abs(s))), F.lit(False))


def rules() -> dict[str, Column]:
    """name: condition under which a row violates it."""
    exact, rate_only = C("human_count_status") == "exact", C("human_count_status") == "rate_only"
    bad_counts = C("human_yes").isNull() | C("human_total").isNull() | (C("human_yes") < 0) | (C("human_yes") > C("human_total")) | (F.abs(C("human_yes") - C("human_rate") * C("human_total")) > 1e-10 * C("human_total"))
    framed = [C(f"x_but_not_y_{x}") for x in ("prompt", "logprob_sum", "logprob_mean", "token_count", "tokenization_mode")]
    some, every = F.greatest(*[x.isNotNull().cast("int") for x in framed]), F.least(*[x.isNotNull().cast("int") for x in framed])
    return {
        "empty_text": F.greatest(*[F.coalesce(F.trim(C(x)) == "", F.lit(True)).cast("int") for x in NAMED]) == 1,
        "version": C("schema_version") != VERSION,
        "rate": ~F.coalesce(C("human_rate").between(0, 1), F.lit(False)),
        "count_status": ~(exact | rate_only),
        "exact_counts": exact & F.coalesce(bad_counts, F.lit(True)),
        "rate_only_counts": rate_only & (C("human_yes").isNotNull() | C("human_total").isNotNull()),
        "trigger_score": C("trigger_logprob_sum").isNull() | _score_rule("trigger"),
        "query_score": C("query_logprob_sum").isNull() | _score_rule("query"),
        "frame_score": _score_rule("x_but_not_y"),
        "frame_applies": F.when(C("x_but_not_y_applicable"), every == 0).otherwise(some == 1),
        "provenance": ~F.coalesce(C("model_provenance_complete"), F.lit(False)) & C("model_revision").isNotNull(),
    }


def repeats(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row (violations): keys that more than one row has."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations"))


def validate(df: DataFrame) -> DataFrame:
    """(rule, violations) of all rules in one pass, and of the key's uniqueness."""
    if missing := [c for c in COLUMNS if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    sums = df.agg(*[F.sum(F.coalesce(v, F.lit(False)).cast("long")).alias(k) for k, v in rules().items()])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(C(k), F.lit(0)).alias("violations")) for k in rules()])).alias("r")).select("r.*")
    twice = repeats(df, KEY).select(F.lit("unique_key").alias("rule"), "violations")
    order = F.lit(int([c for c in df.columns if c in COLUMNS] != list(COLUMNS))).cast("long")
    return long.unionByName(twice).unionByName(df.limit(0).agg(order.alias("violations")).select(F.lit("column_order").alias("rule"), "violations"))


def summarize(df: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.agg(F.count("*").alias("rows"), F.countDistinct("dataset_family").alias("families"), F.countDistinct("dataset").alias("datasets"), F.countDistinct("group_id").alias("groups"), F.countDistinct("context_id").alias("contexts"), n(C("human_count_status") == "exact").alias("exact"), n(C("human_count_status") == "rate_only").alias("rate_only"), n(C("x_but_not_y_applicable")).alias("framed"), F.sum("human_total").alias("responses"))


def response_counts(trials: DataFrame) -> DataFrame:
    """human_yes, human_total, human_rate per cell; an answer other than 0 and 1 is an error."""
    wrong = F.raise_error(F.lit("answers must be 0 or 1")).cast("int")
    neg = F.when(C("neg").isin(0, 1), C("neg")).otherwise(wrong)
    return trials.groupBy("context", "trigger", "query").agg(F.sum(neg).alias("human_yes"), F.count("*").alias("human_total"), F.avg(neg).alias("human_rate"))


def join_faults(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: keys repeated on either side, and keys of one side that the other lacks."""
    counts = lambda t, name: t.groupBy(*on).agg(F.count("*").alias(name))
    both = counts(left, "_l").join(counts(right, "_r"), on, "full")  # each side is read once
    return both.agg(F.count_if(C("_l") > 1).alias("left_repeats"), F.count_if(C("_r") > 1).alias("right_repeats"), F.count_if(C("_r").isNull()).alias("left_only"), F.count_if(C("_l").isNull()).alias("right_only"))


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "one_to_one") -> DataFrame:
    """Inner join, saved, after an error for repeated keys (on the right; on both sides if one_to_one) or unmatched left rows (or right ones if one_to_one).

    Faults are seen while the join is written, in the shuffle that it needs anyway; only if there are any does a
    second job count them. A repeated right key joins once, so that a fault can't multiply rows.
    """
    strict = how == "one_to_one"
    by = Window.partitionBy(*on)
    first = right.withColumns({"_rn": F.count("*").over(by), "_rk": F.row_number().over(by.orderBy(*on))}).where("_rk = 1").drop("_rk")
    mine = left.withColumn("_ln", F.count("*").over(by) if strict else F.lit(1))
    both = mine.join(first, on, "full")
    wrong = (C("_rn") > 1) | C("_rn").isNull()
    if strict:
        wrong = wrong | (C("_ln") > 1) | C("_ln").isNull()
    out, seen = observed(both, "joined", C("_ln").isNotNull() & C("_rn").isNotNull(), wrong=F.count_if(F.coalesce(wrong, F.lit(False))))
    if seen["wrong"]:
        raise ValueError(f"join on {', '.join(on)} is not {how}: {join_faults(left, right, on).first().asDict()}")
    return out.drop("_ln", "_rn")


def mismatches(df: DataFrame) -> DataFrame:
    """Rows whose joined trigger or query differs from the scored one, but for case and outer spaces."""
    same = lambda a, b: F.lower(F.trim(a)).eqNullSafe(F.lower(F.trim(b)))
    return df.where(~(same("trigger", "scored_trigger") & same("query", "scored_query")))


def select_scores(scores: DataFrame, family: str, frame: str) -> DataFrame:
    """Rows of one family and frame; an error unless keys are unique and the frame's scores present (no trigger score when framed)."""
    own = scores.where((C("dataset_family") == family) & (C("generation_frame") == frame))
    need_trigger = frame == "no_frame"
    wrong = C("query_logprob_sum").isNull() | (C("trigger_logprob_sum").isNull() if need_trigger else C("trigger_logprob_sum").isNotNull())
    same = F.row_number().over(Window.partitionBy("source_row_id").orderBy("source_row_id"))
    out, seen = observed(own.withColumn("_k", same), "selected", wrong=F.count_if(wrong), repeats=F.count_if((C("_k") > 1) | C("source_row_id").isNull()))
    if seen["wrong"] or seen["repeats"]:
        raise ValueError(f"scores of {family}, {frame}: {seen}")
    return out.drop("_k")


def provenance(df: DataFrame, fields: list[str], *, revision: str | None = None, path: str | None = None, scores: tuple[str, ...] = ()) -> DataFrame:
    """(field, n_values, value, fault) in one pass. fault is null where all is well.

    A field must have one non-empty value ("values"). The revision's value must stand in the path's ("path"), in every
    row that has both. A score, whose n_values counts values that aren't finite, must be finite in every row ("finite").
    """
    x = lambda c: F.trim(C(c).cast("string"))
    n = lambda wrong: F.coalesce(F.sum(wrong.cast("long")), F.lit(0))
    one = {c: (F.countDistinct(x(c)), F.min(x(c))) for c in fields}
    rows = [F.struct(F.lit(c).alias("field"), k.alias("n_values"), v.alias("value"), F.when((k != 1) | (v == ""), "values").alias("fault")) for c, (k, v) in one.items()]
    if revision and path:
        outside = n(~x(path).contains(x(revision)))
        rows.append(F.struct(F.lit(path).alias("field"), F.countDistinct(x(path)).alias("n_values"), F.min(x(path)).alias("value"), F.when(outside > 0, "path").alias("fault")))
    for c in scores:
        bad = n(~F.coalesce(F.abs(C(c).cast("double")) < float("inf"), F.lit(False)))
        rows.append(F.struct(F.lit(c).alias("field"), bad.alias("n_values"), F.lit(None).cast("string").alias("value"), F.when(bad > 0, "finite").alias("fault")))
    return df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def canonical(cells: DataFrame, plain: DataFrame, framed: DataFrame | None, *, family: str, dataset: str, condition: str, human_file: str, score_file: str) -> DataFrame:
    """The 35 columns from human cells (context, trigger, query, human_*) and scores of both frames, joined by (context, trigger, query)."""
    keys = ["context", "trigger", "query"]
    names = [c for c in plain.columns if c.endswith(("_sum", "_mean", "_count", "_mode"))]
    out = cells.join(plain.select(*keys, "generation_prompt", *names, "model_name", "model_revision"), keys)
    parts = ("logprob_sum", "logprob_mean", "token_count", "tokenization_mode")
    if framed is not None:
        f = framed.select(*keys, C("generation_prompt").alias("x_but_not_y_prompt"), *[C(f"query_{p}").alias(f"x_but_not_y_{p}") for p in parts])
        out = out.join(f, keys, "left")
    else:
        kinds = ("double", "double", "int", "string")
        out = out.withColumns({"x_but_not_y_prompt": F.lit(None).cast("string")} | {f"x_but_not_y_{p}": F.lit(None).cast(k) for p, k in zip(parts, kinds)})
    item = F.concat_ws("::", *keys)
    fixed = {"schema_version": VERSION, "dataset_family": family, "dataset": dataset, "condition": condition, "generation_frame": "no_frame", "human_outcome": "negation", "source_human_file": human_file, "source_score_file": score_file}
    out = out.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"item_id": item, "group_id": C("context"), "context_id": C("context"), "x_but_not_y_applicable": C("x_but_not_y_logprob_sum").isNotNull(), "model_provenance_complete": C("model_revision").isNotNull()})
    if "human_count_status" not in out.columns:
        out = out.withColumn("human_count_status", F.lit("exact"))
    return out.select(*COLUMNS, *[c for c in out.columns if c not in COLUMNS and c not in ("context",)])


def recovered(cells: DataFrame, excluded: DataFrame) -> DataFrame:
    """Published rates with totals to counts: exact where round(rate * total) gives the rate again (1e-10), else rate only; with a three-way inclusion label."""
    yes = F.round(C("rate") * C("total"))
    exact = C("total").isNotNull() & (F.abs(yes / F.when(C("total") > 0, C("total")) - C("rate")) <= 1e-10)
    out = cells.join(excluded.select("trigger", F.lit(True).alias("_x")), "trigger", "left")
    label = F.when(C("_x"), "excluded").when(exact, "included").otherwise("included_rate_only")
    return out.select("context", "trigger", "query", F.when(exact, yes.cast("long")).alias("human_yes"), F.when(exact, C("total")).alias("human_total"), C("rate").alias("human_rate"), F.when(exact, "exact").otherwise("rate_only").alias("human_count_status"), label.alias("analysis_inclusion_status"))


def combine(*tables: DataFrame) -> DataFrame:
    """All study tables with the canonical columns first and null where one lacks a further column; a violated rule is an error.

    Rows are checked while the table is saved, so the tables are made once; then one pass over the key tells whether it repeats.
    """
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out = out.select(*COLUMNS, *[c for c in out.columns if c not in COLUMNS])
    if missing := [c for c in COLUMNS if c not in out.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out, seen = observed(out, "canonical", **{k: F.count_if(F.coalesce(v, F.lit(False))) for k, v in rules().items()})
    if not any(seen.values()):
        seen = {"unique_key": repeats(out, KEY).first()["violations"]}
    if any(seen.values()):
        raise ValueError(f"not canonical: {', '.join(str(x) for x in sorted(seen.items()) if x[1])}")
    return out


def analysis_units(df: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """Included rows of rate-only scales averaged to one unit per (dataset, trigger, query); exact rows and other families one unit per row.

    Errors: an exact count that repeats within a unit, rates or scores that aren't finite, and with expected (units by
    dataset) any other number of units or an unknown dataset.
    """
    kept = df.where(F.coalesce(C("analysis_inclusion_status"), F.lit("included")) != "excluded")
    exact = C("human_count_status") == "exact"
    unit = F.when(exact, C("item_id")).otherwise(F.concat_ws("::", "dataset", "trigger", "query"))
    one = lambda c: F.when(F.count("*") == 1, F.min(c))
    rows = F.when((F.count("*") > 1) & F.max(exact), F.raise_error(F.lit("an exact count repeats within a unit")).cast("long")).otherwise(F.count("*"))
    out = kept.withColumn("unit_id", unit).groupBy("dataset_family", "dataset", "unit_id").agg(rows.alias("rows"), F.avg(finite(C("human_rate"), "a rate")).alias("rate"), one("human_yes").alias("yes"), one("human_total").alias("total"), F.avg(finite(C("query_logprob_mean"), "a score")).alias("query_score"), F.min("group_id").alias("cv_group_id"))
    if expected is not None:
        found = {r["dataset"]: r["n"] for r in out.groupBy("dataset").agg(F.count("*").alias("n")).limit(len(expected) + 1).collect()}
        if found != expected:
            raise ValueError(f"units by dataset: expected {expected}, found {found}")
    return out


# ---------------------------------------------------------------- manifests and scoring


#: The manifest's columns in order, its key, and conditions whose unframed prompts must be the same.
MANIFEST = (
    "manifest_version", "dataset_family", "dataset", "condition", "item_id", "group_id", "context_id", "generation_frame", "generation_prompt", "trigger", "query",
    "analysis_inclusion_status", "source_row_id", "prompt_provenance", "score_trigger", "score_query",
)
MANIFEST_KEY = ("dataset_family", "dataset", "condition", "item_id", "generation_frame")
MATCHED = (("ESI", "Eonly"), ("Estrong", "Eonlystrong"))


def _manifest(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """rows in the manifest's columns, from columns or fixed texts; triggers are scored in the unframed frame alone."""
    fixed = {"manifest_version": VERSION, "analysis_inclusion_status": "included", "generation_frame": "no_frame", "score_query": F.lit(True)} | columns
    fixed.setdefault("score_trigger", F.lit(fixed["generation_frame"] == "no_frame") if isinstance(fixed["generation_frame"], str) else fixed["generation_frame"] == "no_frame")
    return rows.select(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in ((k, fixed[k]) for k in MANIFEST)])


def build_manifest(pairs: DataFrame, prompts: DataFrame, family: str) -> DataFrame:
    """Two frames of each pair (context, trigger, query): the bare prompt with both candidates, and "<trigger> but not" with the query alone."""
    both = pairs.join(prompts, "context")
    frames = F.array(F.struct(F.lit("no_frame").alias("frame"), F.concat(F.rtrim("prompt"), F.lit(" ")).alias("text")), F.struct(F.lit("x_but_not_y").alias("frame"), F.concat(F.rtrim("prompt"), F.lit(" "), "trigger", F.lit(" but not ")).alias("text")))
    out = both.select("context", "trigger", "query", F.explode(frames).alias("f")).select("context", "trigger", "query", "f.*")
    item = F.concat_ws("::", "context", "trigger", "query")
    return _manifest(out, dataset_family=family, dataset=family, condition="base", item_id=item, group_id=C("context"), context_id=C("context"), generation_frame=C("frame"), generation_prompt=C("text"), trigger=C("trigger"), query=C("query"), source_row_id=F.concat_ws("|", item, "frame"), prompt_provenance="two_frames")


def scale_manifest(prompts: DataFrame, family: str, *, framed: bool = False) -> DataFrame:
    """One row of each prompt (dataset, item_id, scale_id, context_text, boundary_text, trigger, query, has_suite, prompt_source).

    Unframed, the prompt is the context and the text moved to its end, and both candidates are scored; framed, it is
    the context (which ends in "but not") and one space, and the query alone is. Rows wait for the exact filter, with
    or without a suite; a missing text counts as empty, a missing has_suite as false.
    """
    text = lambda c: F.coalesce(C(c).cast("string"), F.lit(""))
    suite = F.when(F.coalesce(C("has_suite"), F.lit(False)), "pending_suite_available").otherwise("pending_no_suite")
    item = F.concat(C("item_id"), F.lit("::x_but_not_y")) if framed else C("item_id").cast("string")
    prompt = F.concat(F.rtrim(text("context_text")), F.lit(" ")) if framed else F.concat(text("context_text"), text("boundary_text"))
    return _manifest(prompts, dataset_family=family, dataset=C("dataset"), condition="scalar_inference", item_id=item, group_id=F.concat_ws("::", "dataset", "scale_id"), context_id=C("item_id").cast("string"), generation_frame="x_but_not_y" if framed else "no_frame", generation_prompt=prompt, trigger=F.trim("trigger"), query=F.trim("query"), analysis_inclusion_status=suite, source_row_id=F.concat_ws("|", item, F.lit(family)), prompt_provenance=C("prompt_source"))


def condition_manifest(tables: dict[str, DataFrame], family: str, reuse: dict[str, str] = {b: a for a, b in MATCHED}) -> DataFrame:
    """Rows of all conditions from their tables (item_id, trigger, query, prompt); a condition named in reuse takes the prompts of the other one by item_id.

    An item without a prompt there is an error when the rows are made.
    """
    out = None
    for condition, rows in sorted(tables.items()):
        if source := reuse.get(condition):
            known = tables[source].select("item_id", C("prompt").alias("_prompt"))
            none = F.raise_error(F.concat(F.lit(f"no prompt of {source} for an item of {condition}: "), C("item_id").cast("string"))).cast("string")
            rows = rows.select("item_id", "trigger", "query").join(known, "item_id", "left").withColumn("prompt", F.coalesce("_prompt", none))
        item = F.concat_ws("::", F.lit(condition), C("item_id").cast("string"))
        part = _manifest(rows, dataset_family=family, dataset=family, condition=condition, item_id=item, group_id=C("item_id").cast("string"), context_id=item, generation_prompt=C("prompt"), trigger=F.trim("trigger"), query=F.trim("query"), source_row_id=F.concat_ws("|", item, F.lit(family)), prompt_provenance=f"reused_from_{source}" if source else "own_prompt")
        out = part if out is None else out.unionByName(part)
    return out


def combined_manifest(*parts: DataFrame) -> DataFrame:
    """All parts in order of the key, after an error for any violated rule."""
    out = parts[0].select(*MANIFEST)
    for p in parts[1:]:
        out = out.unionByName(p.select(*MANIFEST))
    if wrong := validate_manifest(out).where("violations > 0").orderBy("rule").collect():
        raise ValueError(f"not a manifest: {', '.join(str((r['rule'], r['violations'])) for r in wrong)}")
    return out.orderBy(*MANIFEST_KEY)


def condition_faults(df: DataFrame, matched: tuple[tuple[str, str], ...] = MATCHED) -> DataFrame:
    """(left, right, group_id, fault) of groups that one of two matched conditions lacks ("coverage"), or whose unframed prompt or candidates differ ("differs"); nulls equal each other."""
    told = F.struct("generation_prompt", "trigger", "query")
    out = None
    for a, b in matched:
        side = lambda name: df.where((C("condition") == name) & (C("generation_frame") == "no_frame")).select("dataset_family", "dataset", "group_id", told.alias(f"_{name}"))  # noqa: E731, B023
        both = side(a).join(side(b), ["dataset_family", "dataset", "group_id"], "full")
        fault = F.when(C(f"_{a}").isNull() | C(f"_{b}").isNull(), "coverage").when(~C(f"_{a}").eqNullSafe(C(f"_{b}")), "differs")
        part = both.select(F.lit(a).alias("left"), F.lit(b).alias("right"), "group_id", fault.alias("fault")).where("fault is not null")
        out = part if out is None else out.unionByName(part)
    return out


def validate_manifest(df: DataFrame, matched: tuple[tuple[str, str], ...] = MATCHED) -> DataFrame:
    """(rule, violations): empty values, versions, frames, flags, candidates, prompts, unique keys, and matched conditions."""
    framed = C("generation_frame") == "x_but_not_y"
    last = F.element_at(F.split("generation_prompt", "\n"), -1)
    checks = {
        "empty": F.greatest(*[F.coalesce(F.trim(C(c)) == "", F.lit(True)).cast("int") for c in MANIFEST if not c.startswith("score_")]) == 1,
        "version": ~C("manifest_version").isin("1.0", "1.1"),
        "frame": ~C("generation_frame").isin("no_frame", "x_but_not_y"),
        "old_version_frame": (C("manifest_version") == "1.0") & framed,
        "same_candidates": C("trigger") == C("query"),
        "prompt_end": ~C("generation_prompt").rlike(r"\s$"),
        "query_flag": ~C("score_query"),
        "flags": C("score_trigger") == framed,
        "answer_line": C("condition").isin(*[c for p in matched for c in p]) & last.rlike(r"(?i)\bonly\b"),
    }
    wrong = {k: F.coalesce(F.sum(F.coalesce(v, F.lit(True)).cast("long")), F.lit(0)) for k, v in checks.items()}
    sums = df.agg(*[v.alias(k) for k, v in wrong.items()], F.greatest(F.count_if(C("manifest_version") == "1.0") * F.count_if(C("manifest_version") == "1.1"), F.lit(0)).cast("boolean").cast("long").alias("one_version"))
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), C(k).alias("violations")) for k in (*checks, "one_version")])).alias("r")).select("r.*")
    twice = repeats(df, MANIFEST_KEY).select(F.lit("unique_key").alias("rule"), "violations")
    apart = condition_faults(df, matched).agg(F.count("*").alias("violations")).select(F.lit("matched_conditions").alias("rule"), "violations")
    return long.unionByName(twice).unionByName(apart)


def manifest_summary(df: DataFrame) -> DataFrame:
    """One row of eight counts: rows, families, datasets, conditions, frames, prompts, distinct prompt-candidate pairs, and rows that wait for a filter."""
    names = {"families": "dataset_family", "datasets": "dataset", "conditions": "condition", "frames": "generation_frame", "prompts": "generation_prompt"}
    counts = df.agg(F.count("*").alias("rows"), *[F.countDistinct(c).alias(k) for k, c in names.items()], F.count_if(C("analysis_inclusion_status").startswith("pending")).alias("pending"))
    return counts.crossJoin(F.broadcast(scoring_pairs(df).agg(F.count("*").alias("pairs"))))  # one row each


def scoring_pairs(manifest: DataFrame) -> DataFrame:
    """Distinct (generation_prompt, candidate) of all scored roles."""
    roles = F.array(F.when(C("score_trigger"), C("trigger")), F.when(C("score_query"), C("query")))
    return manifest.select("generation_prompt", F.explode(roles).alias("candidate")).where("candidate is not null").distinct()


def pending(manifest: DataFrame, done: DataFrame, version: str, settings: str) -> DataFrame:
    """Manifest rows not scored yet. done holds source_row_id, manifest_version, manifest_sha256 and settings of each scored row.

    An error if scores are of another version, of a manifest with another fingerprint, of other settings, repeated, or
    of unknown rows; all of it is seen while the pending rows are saved.
    """
    sha = fingerprint(manifest).select("sha256").scalar()
    told = {"manifest_version": "_version", "manifest_sha256": "_sha", "settings": "_settings"}
    again = F.row_number().over(Window.partitionBy("source_row_id").orderBy("source_row_id"))
    log = done.select("source_row_id", *[C(c).alias(name) for c, name in told.items()], again.alias("_k"))
    both = manifest.withColumn("_known", F.lit(True)).join(log, "source_row_id", "full").withColumn("_own_sha", sha)
    scored = C("_k").isNotNull()
    faults = {
        "repeated": C("_k") > 1,
        "other_version": scored & ~C("_version").eqNullSafe(version),
        "other_manifest": scored & ~C("_sha").eqNullSafe(C("_own_sha")),
        "other_settings": scored & ~C("_settings").eqNullSafe(settings),
        "unknown": C("_known").isNull(),
    }
    out, f = observed(both, "pending", ~scored, **{k: F.count_if(F.coalesce(v, F.lit(False))) for k, v in faults.items()})
    if any(f.values()):
        raise ValueError(f"scores don't belong to this manifest: {f}")
    return out.select(*manifest.columns)


def resume_scoring(manifest: DataFrame, scorer: Callable, path: str, version: str, settings: str, *, parts: int = 8) -> DataFrame:
    """All scores of the manifest from the log at path, after scoring what is pending in `parts` parts by hash of the row's id.

    A part is one write: its files are staged and appear together when it is committed, with the manifest's fingerprint
    and the settings in each row. So a run that stops loses its current part alone, and one that is repeated scores
    nothing twice; a log of another manifest or other settings is an error before anything is scored.
    """
    spark = manifest.sparkSession

    def log() -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    done = log()
    left = manifest if done is None else pending(manifest, done, version, settings)
    sha = fingerprint(manifest).select("sha256").scalar()
    own = F.pmod(F.xxhash64("source_row_id"), F.lit(parts))
    todo = {r["part"] for r in left.select(own.alias("part")).distinct().collect()}
    for part in sorted(todo):
        scored = score_candidates(left.where(own == part), scorer)
        scored.withColumns({"manifest_sha256": sha, "settings": F.lit(settings)}).write.mode("append").parquet(path)
        left = pending(manifest, log(), version, settings)
    return log()


def token_scores(manifest: DataFrame, scorer: Callable[[str, list[str]], list[list]], *, block: int = 256) -> DataFrame:
    """(generation_prompt, candidate, position, token, logprob): a row for each token of each distinct prompt and candidate, scored once.

    `scorer(prompt, candidates)` gives each candidate's tokens as (token, log-probability), or log-probabilities alone;
    a prompt's candidates are dealt by hash into groups of about `block`, however many it has.
    """
    pairs = scoring_pairs(manifest)
    sizes = pairs.groupBy("generation_prompt").agg(F.ceil(F.count("*") / block).alias("_groups"))
    pairs = pairs.join(sizes, "generation_prompt").withColumn("_b", F.pmod(F.xxhash64("candidate"), F.col("_groups"))).drop("_groups")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        prompt, candidates = pdf["generation_prompt"].iloc[0], list(pdf["candidate"])
        rows = []
        for candidate, tokens in zip(candidates, scorer(prompt, candidates), strict=True):
            for i, t in enumerate(tokens):
                token, logprob = t if isinstance(t, tuple) else (None, t)
                rows.append((prompt, candidate, i, token, float(logprob)))
        return pd.DataFrame(rows, columns=["generation_prompt", "candidate", "position", "token", "logprob"])

    return pairs.groupBy("generation_prompt", "_b").applyInPandas(score, "generation_prompt string, candidate string, position int, token string, logprob double")


def score_candidates(manifest: DataFrame, scorer: Callable[[str, list[str]], list[list]], *, block: int = 256) -> DataFrame:
    """Manifest rows with token arrays, sums, means and token counts of both candidates and their difference on unframed rows."""
    tokens = token_scores(manifest, scorer, block=block)
    in_order = F.sort_array(F.collect_list(F.struct("position", "token", "logprob")))  # of one candidate
    done = tokens.groupBy("generation_prompt", "candidate").agg(in_order.alias("tokens"))
    return joined_scores(manifest, done.select("generation_prompt", "candidate", "tokens", C("tokens.logprob").alias("logprobs")))


def joined_scores(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Scores (generation_prompt, candidate, logprobs, and tokens if there) joined to both roles of the manifest's rows."""
    total = F.aggregate("logprobs", F.lit(0.0), lambda s, x: s + x)
    more = ["tokens"] if "tokens" in done.columns else []
    done = done.select("generation_prompt", "candidate", total.alias("s"), F.size("logprobs").alias("n"), *more)
    role = lambda r: done.select("generation_prompt", C("candidate").alias(r), C("s").alias(f"{r}_logprob_sum"), (C("s") / C("n")).alias(f"{r}_logprob_mean"), C("n").alias(f"{r}_token_count"), *[C(c).alias(f"{r}_{c}") for c in more])
    out = manifest.join(role("query"), ["generation_prompt", "query"], "left").join(role("trigger"), ["generation_prompt", "trigger"], "left")
    names = [f"trigger_{x}" for x in ("logprob_sum", "logprob_mean", "token_count", *more)]
    out = out.withColumns({c: F.when(C("score_trigger"), C(c)) for c in names})
    return out.withColumn("difference", C("query_logprob_sum") - C("trigger_logprob_sum"))


def invalidate(scores: DataFrame, settings: DataFrame, fields: list[str]) -> DataFrame:
    """Scores whose context's recorded settings are all equal to the current ones (context, fields)."""
    now = settings.select("context", *[C(f).alias(f"_{f}") for f in fields])
    out = scores.join(now, "context")
    for f in fields:
        out = out.where(C(f).eqNullSafe(C(f"_{f}")))
    return out.select(*scores.columns)
