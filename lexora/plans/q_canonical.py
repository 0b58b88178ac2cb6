"""Queries of canonical tables, manifests and scoring."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lexora.functions import text as T
from lexora.operators import canonical as J

from . import q_models as M
from . import q_vocab as V
from . import study
from .study import query

C = F.col

_SCORED = """WITH prompts AS (SELECT DISTINCT lang AS context, 'In ' || lang || ' we have' AS prompt FROM documents),
man AS (SELECT p.context, trigger, query, 'no_frame' AS frame, prompt || ' ' AS generation_prompt, TRUE AS st FROM pairs p JOIN prompts USING (context) UNION ALL SELECT p.context, trigger, query, 'x_but_not_y', prompt || ' ' || trigger || ' but not ', FALSE FROM pairs p JOIN prompts USING (context)),
obs AS (SELECT context, trigger, query, sum(neg)::BIGINT AS human_yes, count(*) AS human_total, avg(neg) AS human_rate FROM trials GROUP BY ALL)"""


def prompts(spark, d):
    return study.documents(spark, d).select(C("lang").alias("context")).distinct().withColumn("prompt", F.concat(F.lit("In "), "context", F.lit(" we have")))


def manifest(spark, d):
    return J.build_manifest(study.pairs(spark, d), prompts(spark, d), "study")


def scores(spark, d, frame):
    """Score rows of one frame: sums from context counts, the mean over one or two tokens."""
    p = M._scored_pairs(spark, d)
    n = lambda w: F.when(F.length(w) > 6, 2).otherwise(1)
    framed = frame != "no_frame"
    prompt = F.concat(F.lit("In "), "context", F.lit(" we have "), *([C("trigger"), F.lit(" but not ")] if framed else []))
    q, t = (C("lq") - 1 if framed else C("lq")), F.when(F.lit(not framed), C("lt"))
    return p.select(
        "context", "trigger", "query", F.lit("study").alias("dataset_family"), F.lit(frame).alias("generation_frame"), prompt.alias("generation_prompt"),
        t.alias("trigger_logprob_sum"), (t / n("trigger")).alias("trigger_logprob_mean"), F.when(t.isNotNull(), n("trigger")).alias("trigger_token_count"), F.when(t.isNotNull(), F.lit("word")).alias("trigger_tokenization_mode"),
        q.alias("query_logprob_sum"), (q / n("query")).alias("query_logprob_mean"), n("query").alias("query_token_count"), F.lit("word").alias("query_tokenization_mode"),
        F.lit("counts").alias("model_name"), F.lit("r1").alias("model_revision"), F.concat_ws("|", "context", "trigger", "query", F.lit(frame)).alias("source_row_id"),
    )


def focus(spark, d):
    cells = J.response_counts(study.trials(spark, d))
    return J.canonical(cells, scores(spark, d, "no_frame"), scores(spark, d, "x_but_not_y"), family="focus", dataset="focus", condition="base", human_file="trials", score_file="counts")


def scales(spark, d):
    """Published rates: every third cell's rate is rounded to one digit, so that its counts can't be recovered."""
    cells = J.response_counts(study.trials(spark, d)).withColumn("_r", F.length(F.concat("trigger", "query")) % 3)
    pub = cells.select("context", "trigger", "query", F.when(C("_r") == 0, F.round("human_rate", 1)).otherwise(C("human_rate")).alias("rate"), F.when(C("_r") != 0, C("human_total")).alias("total"))
    out = J.recovered(pub, study.top(spark, d, 6).where("rk = 6").select(C("token").alias("trigger")).distinct())
    return J.canonical(out, scores(spark, d, "no_frame"), None, family="scales", dataset="scales", condition="base", human_file="published", score_file="counts")


def conditions(spark, d):
    cells = J.response_counts(study.trials(spark, d).where("rt <= 3"))
    return J.canonical(cells, scores(spark, d, "no_frame"), None, family="conditions", dataset="conditions", condition="c1", human_file="items", score_file="counts")


def everything(spark, d):
    return J.combine(focus(spark, d), scales(spark, d), conditions(spark, d))


_PUB = """, pub AS (SELECT context, trigger, query, human_yes, human_total, CASE WHEN length(trigger || query) % 3 = 0 THEN round(human_rate, 1) ELSE human_rate END AS human_rate, length(trigger || query) % 3 = 0 AS lost, trigger IN (SELECT token FROM dist WHERE rk = 6) AS ex FROM obs)"""

_RULES = "empty_text version rate count_status exact_counts rate_only_counts trigger_score query_score frame_score frame_applies provenance unique_key column_order".split()


@query("j1_canonical_validation", f"SELECT unnest({_RULES!r}) AS rule, 0::BIGINT + least(0, (SELECT count(*) FROM documents)) AS violations")
def j1(spark, d):
    return J.validate(everything(spark, d))


@query("j2_canonical_summary", _SCORED + """, n AS (SELECT count(*) AS c, sum(human_total)::BIGINT AS t FROM obs), s AS (SELECT count(*) AS c, sum((length(trigger || query) % 3 <> 0)::INT)::BIGINT AS e, sum(human_total) FILTER (WHERE length(trigger || query) % 3 <> 0)::BIGINT AS t FROM obs), k AS (SELECT count(*) AS c, sum(n)::BIGINT AS t FROM (SELECT count(*) AS n FROM trials WHERE rt <= 3 GROUP BY context, trigger, query))
SELECT n.c + s.c + k.c AS rows, 3 AS families, 3 AS datasets, (SELECT count(DISTINCT context) FROM obs) AS groups, (SELECT count(DISTINCT context) FROM obs) AS contexts, n.c + s.e + k.c AS exact, s.c - s.e AS rate_only, n.c AS framed, n.t + s.t + k.t AS responses FROM n, s, k""")
def j2(spark, d):
    return J.summarize(everything(spark, d))


@query("j4_response_counts", _SCORED + " SELECT * FROM obs")
def j4(spark, d):
    return J.response_counts(study.trials(spark, d))


@query("j5_validated_join", """WITH a AS (SELECT lang, count(*) AS n FROM (SELECT DISTINCT lang, source FROM documents WHERE lang <> 'es') GROUP BY lang), b AS (SELECT lang, count(*) AS n FROM (SELECT DISTINCT lang, n_chars % 7 AS m FROM documents WHERE lang <> 'de') GROUP BY lang)
SELECT (SELECT count(DISTINCT lang) FROM documents) AS joined, (SELECT count(*) FROM a WHERE n > 1) AS left_repeats, (SELECT count(*) FROM b WHERE n > 1) AS right_repeats, (SELECT count(*) FROM a ANTI JOIN b USING (lang)) AS left_only, (SELECT count(*) FROM b ANTI JOIN a USING (lang)) AS right_only""")
def j5(spark, d):
    """Rows of a join without faults, and the faults planted in another: repeated keys on both sides, and a language that each side lacks."""
    docs = study.documents(spark, d)
    joined = J.checked_join(docs.select("lang").distinct(), docs.groupBy("lang").agg(F.count("*").alias("n")), ["lang"])
    sources = docs.where("lang <> 'es'").select("lang", "source").distinct()
    faults = J.join_faults(sources, docs.where("lang <> 'de'").select("lang", C("n_chars") % 7).distinct(), ["lang"])
    return faults.crossJoin(F.broadcast(joined.agg(F.count("*").alias("joined"))))  # one row each


@query("j6_candidate_agreement", "SELECT context, trigger, query, upper(trigger) AS scored_trigger, query || 's' AS scored_query FROM pairs WHERE rq = 3")
def j6(spark, d):
    p = study.pairs(spark, d)
    return J.mismatches(p.select("context", "trigger", "query", F.upper("trigger").alias("scored_trigger"), F.when(C("rq") == 3, F.concat("query", F.lit("s"))).otherwise(F.concat(F.lit(" "), "query")).alias("scored_query")))


@query("j7_score_selection", "SELECT context, count(*) AS n FROM pairs GROUP BY context")
def j7(spark, d):
    both = scores(spark, d, "no_frame").unionByName(scores(spark, d, "x_but_not_y"))
    return J.select_scores(both, "study", "x_but_not_y").groupBy("context").agg(F.count("*").alias("n"))


@query("j8_single_provenance", """SELECT 'model_name' AS field, 1 AS n_values, 'counts' AS value, NULL AS fault UNION ALL SELECT 'model_revision', 1, 'r1', NULL UNION ALL SELECT 'context', count(DISTINCT context), min(context), CASE WHEN count(DISTINCT context) > 1 THEN 'values' END FROM pairs
UNION ALL SELECT 'model_path', count(DISTINCT rq = 1), CASE WHEN bool_or(rq = 1) THEN 'models/other' ELSE 'models/r1' END, CASE WHEN bool_or(rq = 1) THEN 'path' END FROM pairs UNION ALL SELECT 'query_logprob_sum', 0, NULL, NULL UNION ALL SELECT 'planted', count(*) FILTER (WHERE rq = 1), NULL, CASE WHEN bool_or(rq = 1) THEN 'finite' END FROM pairs""")
def j8(spark, d):
    best = study.pairs(spark, d).select("context", "trigger", "query", (C("rq") == 1).alias("best"))
    x = scores(spark, d, "no_frame").join(best, ["context", "trigger", "query"])
    x = x.withColumns({"model_path": F.concat(F.lit("models/"), F.when(C("best"), "other").otherwise(C("model_revision"))), "planted": F.when(C("best"), float("nan")).otherwise(C("query_logprob_sum"))})
    return J.provenance(x, ["model_name", "model_revision", "context"], revision="model_revision", path="model_path", scores=("query_logprob_sum", "planted"))


@query("j9_study_focus", _SCORED + """, asked AS MATERIALIZED (SELECT context, trigger AS token FROM pairs UNION SELECT context, query FROM pairs), few AS MATERIALIZED (SELECT s.context, s.token, s.logprob FROM scores s SEMI JOIN asked USING (context, token))
SELECT o.context || '::' || trigger || '::' || query AS item_id, human_yes, human_total, q.logprob AS query_logprob_sum, t.logprob AS trigger_logprob_sum, q.logprob - 1 AS x_but_not_y_logprob_sum FROM obs o JOIN few q ON q.context = o.context AND q.token = query JOIN few t ON t.context = o.context AND t.token = trigger""")
def j9(spark, d):
    return focus(spark, d).select("item_id", "human_yes", "human_total", "query_logprob_sum", "trigger_logprob_sum", "x_but_not_y_logprob_sum")


@query("j10_study_scales", _SCORED + _PUB + " SELECT context || '::' || trigger || '::' || query AS item_id, CASE WHEN NOT lost THEN human_yes END AS human_yes, human_rate, CASE WHEN lost THEN 'rate_only' ELSE 'exact' END AS human_count_status, CASE WHEN ex THEN 'excluded' WHEN lost THEN 'included_rate_only' ELSE 'included' END AS analysis_inclusion_status FROM pub")
def j10(spark, d):
    return scales(spark, d).select("item_id", "human_yes", "human_rate", "human_count_status", "analysis_inclusion_status")


@query("j11_study_conditions", "SELECT context || '::' || trigger || '::' || query AS item_id, count(*) AS human_total FROM trials WHERE rt <= 3 GROUP BY context, trigger, query")
def j11(spark, d):
    return conditions(spark, d).select("item_id", "human_total")


@query("j12_combine", "SELECT 'focus' AS dataset, count(*) AS n FROM pairs UNION ALL SELECT 'scales', count(*) FROM pairs UNION ALL SELECT 'conditions', count(*) FROM pairs WHERE rt <= 3")
def j12(spark, d):
    return everything(spark, d).groupBy("dataset").agg(F.count("*").alias("n"))


@query("j13_manifest", _SCORED + " SELECT context || '::' || trigger || '::' || query AS item_id, frame AS generation_frame, generation_prompt, trigger, query, st::INT AS score_trigger FROM man")
def j13(spark, d):
    return manifest(spark, d).select("item_id", "generation_frame", "generation_prompt", "trigger", "query", C("score_trigger").cast("int").alias("score_trigger"))


def _items(spark, d):
    """Pairs of the three best triggers as items of scales and conditions."""
    return study.pairs(spark, d).where("rt <= 3").withColumn("item_id", F.concat_ws("::", "context", "trigger", "query"))


def condition_rows(spark, d):
    items, prompt = _items(spark, d), lambda tail: F.concat(F.lit("A: in "), "context", F.lit(f"?\nB: {tail} "))
    own = {c: items.withColumn("prompt", prompt(tail)) for c, tail in (("ESI", "we have"), ("Eweak", "some have"), ("Estrong", "all have"))}
    return J.condition_manifest(own | {c: items for c in ("Eonly", "Eonlystrong")}, "conditions")


def scale_rows(spark, d, framed):
    text = [C("context").alias("dataset"), C("trigger").alias("scale_id"), F.concat(F.lit("In "), "context", F.lit(" we have"), *([F.lit(" "), "trigger", F.lit(" but not")] if framed else [])).alias("context_text"), F.lit(" ").alias("boundary_text"), (C("rq") <= 3).alias("has_suite"), F.lit("corpus").alias("prompt_source")]
    return J.scale_manifest(_items(spark, d).select("item_id", "trigger", "query", *text), "scales", framed=framed)


_MANIFESTS = _SCORED + """, it AS (SELECT context || '::' || trigger || '::' || query AS item, * FROM pairs WHERE rt <= 3),
tails AS (SELECT * FROM (VALUES ('ESI', 'we have'), ('Eweak', 'some have'), ('Estrong', 'all have'), ('Eonly', 'we have'), ('Eonlystrong', 'all have')) AS v(condition, tail)),
every AS (SELECT 'study' AS dataset_family, 'base' AS condition, context || '::' || trigger || '::' || query AS item_id, frame AS generation_frame, generation_prompt, trigger, query, st::INT AS score_trigger, context AS group_id, 'included' AS status FROM man
UNION ALL SELECT 'scales', 'scalar_inference', item, 'no_frame', 'In ' || context || ' we have ', trigger, query, 1, context || '::' || trigger, CASE WHEN rq <= 3 THEN 'pending_suite_available' ELSE 'pending_no_suite' END FROM it
UNION ALL SELECT 'scales', 'scalar_inference', item || '::x_but_not_y', 'x_but_not_y', 'In ' || context || ' we have ' || trigger || ' but not ', trigger, query, 0, context || '::' || trigger, CASE WHEN rq <= 3 THEN 'pending_suite_available' ELSE 'pending_no_suite' END FROM it
UNION ALL SELECT 'conditions', condition, condition || '::' || item, 'no_frame', 'A: in ' || context || '?' || chr(10) || 'B: ' || tail || ' ', trigger, query, 1, item, 'included' FROM it CROSS JOIN tails)"""


def manifests(spark, d):
    return [manifest(spark, d), scale_rows(spark, d, False), scale_rows(spark, d, True), condition_rows(spark, d)]


@query("j13_combined_manifest", _MANIFESTS + " SELECT dataset_family, condition, item_id, generation_frame, generation_prompt, trigger, query, score_trigger, group_id, status FROM every")
def j13_combined(spark, d):
    return J.combined_manifest(*manifests(spark, d)).select("dataset_family", "condition", "item_id", "generation_frame", "generation_prompt", "trigger", "query", C("score_trigger").cast("int").alias("score_trigger"), "group_id", C("analysis_inclusion_status").alias("status"))


@query("j14_manifest_validation", _MANIFESTS + """, n AS (SELECT count(*) FILTER (WHERE dataset_family = 'study' AND group_id = 'en') AS ends, count(*) FILTER (WHERE dataset_family = 'study' AND generation_frame = 'x_but_not_y' AND group_id = 'de') AS flags, count(*) FILTER (WHERE condition = 'Eweak' AND group_id LIKE 'es::%') AS twice, count(*) FILTER (WHERE condition = 'Eonly' AND group_id LIKE 'fr::%') AS gone,
count(*) FILTER (WHERE condition = 'Estrong' AND group_id LIKE 'de::%') AS barred, count(*) FILTER (WHERE dataset_family = 'scales' AND group_id LIKE 'es::%') AS same FROM every)
SELECT unnest(['empty', 'version', 'frame', 'old_version_frame', 'same_candidates', 'prompt_end', 'query_flag', 'flags', 'answer_line', 'one_version', 'unique_key', 'matched_conditions']) AS rule, unnest([0, 0, 0, 0, same, ends, 0, flags, barred, 0, twice, gone + barred]) AS violations FROM n""")
def j14(spark, d):
    """Faults are planted in each part, so that the rules have something to find."""
    study_rows, scale, framed, cond = manifests(spark, d)
    study_rows = study_rows.withColumns({"generation_prompt": F.when(C("group_id") == "en", F.rtrim("generation_prompt")).otherwise(C("generation_prompt")), "score_trigger": C("score_trigger") | (C("group_id") == "de")})
    both = scale.unionByName(framed)
    both = both.withColumn("query", F.when(C("group_id").startswith("es::"), C("trigger")).otherwise(C("query")))
    cond = cond.where(~((C("condition") == "Eonly") & C("group_id").startswith("fr::")))
    cond = cond.unionByName(cond.where((C("condition") == "Eweak") & C("group_id").startswith("es::")))
    cond = cond.withColumn("generation_prompt", F.when((C("condition") == "Estrong") & C("group_id").startswith("de::"), F.concat("generation_prompt", F.lit("only "))).otherwise(C("generation_prompt")))
    return J.validate_manifest(study_rows.unionByName(both).unionByName(cond))


@query("j15_manifest_summary", _MANIFESTS + """ SELECT count(*) AS rows, count(DISTINCT dataset_family) AS families, 2 + (SELECT count(DISTINCT context) FROM pairs) AS datasets, count(DISTINCT condition) AS conditions, count(DISTINCT generation_frame) AS frames, count(DISTINCT generation_prompt) AS prompts, count(*) FILTER (WHERE status LIKE 'pending%') AS pending,
(SELECT count(*) FROM (SELECT generation_prompt, query FROM every UNION SELECT generation_prompt, trigger FROM every WHERE score_trigger = 1)) AS pairs FROM every""")
def j15_summary(spark, d):
    return J.manifest_summary(J.combined_manifest(*manifests(spark, d)))


@query("j15_scoring_pairs", _SCORED + " SELECT generation_prompt, query AS candidate FROM man UNION SELECT generation_prompt, trigger FROM man WHERE st")
def j15(spark, d):
    return J.scoring_pairs(manifest(spark, d))


@query("j16_pending", _SCORED + " SELECT context || '::' || trigger || '::' || query || '|' || frame AS source_row_id FROM man WHERE NOT (frame = 'no_frame' AND context = 'en')")
def j16(spark, d):
    m = manifest(spark, d)
    done = m.where("generation_frame = 'no_frame' and group_id = 'en'").select("source_row_id", "manifest_version")
    done = done.withColumns({"manifest_sha256": T.fingerprint(m).select("sha256").scalar(), "settings": F.lit("sum")})
    return J.pending(m, done, "1.1", "sum").select("source_row_id")


@query("j17_score_candidates", _SCORED + " SELECT context || '::' || trigger || '::' || query || '|' || frame AS source_row_id, -ln(1 + length(query)) - length(generation_prompt) / 100.0 AS query_logprob_sum, CASE WHEN st THEN -ln(1 + length(trigger)) - length(generation_prompt) / 100.0 END AS trigger_logprob_sum, CASE WHEN st THEN ln(1 + length(trigger)) - ln(1 + length(query)) END AS difference FROM man")
def j17(spark, d):
    return J.score_candidates(manifest(spark, d), length_scorer).select("source_row_id", "query_logprob_sum", "trigger_logprob_sum", "difference")


def length_scorer(prompt, candidates):
    return [[(c, -math.log(1 + len(c))), ("<end>", -len(prompt) / 100.0)] for c in candidates]


@query("j17_token_scores", _SCORED + """, c AS (SELECT generation_prompt, query AS candidate FROM man UNION SELECT generation_prompt, trigger FROM man WHERE st)
SELECT generation_prompt, candidate, 0 AS position, candidate AS token, -ln(1 + length(candidate)) AS logprob FROM c UNION ALL SELECT generation_prompt, candidate, 1, '<end>', -length(generation_prompt) / 100.0 FROM c""")
def j17_tokens(spark, d):
    return J.token_scores(manifest(spark, d), length_scorer)


@query("j18_invalidate", "SELECT context, count(*) AS n FROM scores WHERE context <> 'fr' GROUP BY context")
def j18(spark, d):
    s = study.scores(spark, d).withColumns({"vocab_version": F.lit("v2"), "target": F.lit(60)})
    now = study.documents(spark, d).select(C("lang").alias("context")).distinct().select("context", F.when(C("context") == "fr", "v3").otherwise("v2").alias("vocab_version"), F.lit(60).alias("target"))
    return J.invalidate(s, now, ["vocab_version", "target"]).groupBy("context").agg(F.count("*").alias("n"))


@query("g8_analysis_units", _SCORED + _PUB + """, u AS (SELECT 'focus' AS dataset, context || '::' || trigger || '::' || query AS unit_id, human_rate AS rate FROM obs UNION ALL SELECT 'scales', CASE WHEN lost THEN 'scales::' || trigger || '::' || query ELSE context || '::' || trigger || '::' || query END, human_rate FROM pub WHERE NOT ex UNION ALL SELECT 'conditions', context || '::' || trigger || '::' || query, avg(neg) FROM trials WHERE rt <= 3 GROUP BY context, trigger, query)
SELECT dataset, unit_id, count(*) AS rows, avg(rate) AS rate FROM u GROUP BY dataset, unit_id""")
def g8(spark, d):
    return J.analysis_units(everything(spark, d)).select("dataset", "unit_id", "rows", "rate")


@query("p1_corpus_bigram_scorer", V._GRAMS + " SELECT g.token, ln(g.count / u.count::DOUBLE) AS logprob FROM gbi g JOIN guni u ON u.token = split_part(g.token, ' ', 1)")
def p1(spark, d):
    return V.d13(spark, d).select("token", F.log("score").alias("logprob"))
