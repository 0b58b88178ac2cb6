"""Queries of sampling and of alternative-structure models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexora.functions import stats as S
from lexora.functions.text import uniform
from lexora.operators import sampling, structures
from lexora.operators.reports import region
from lexora.operators.vocab import numbered, with_total

from . import study
from .study import query, u_sql

REPS = 20
BOUNDARIES = (5, 10)

#: SQL of draws with weights n (words of a length that seven divides have none), as in sampling.sample_orderings.
DRAWS = f"""
WITH src AS (SELECT context, token, rk, CASE WHEN length(token) % 7 = 0 THEN 0.0 ELSE n::DOUBLE END AS weight FROM dist),
reps AS (SELECT unnest(generate_series(0, {REPS - 1})) AS rep),
keyed AS (SELECT s.*, rep, CASE WHEN weight > 0 THEN -ln({u_sql("context", "rep", "token")}) / weight ELSE -ln({u_sql("context", "rep", "token")}) END AS key FROM src s CROSS JOIN reps),
pos AS (SELECT context, rep, token, row_number() OVER (PARTITION BY context, rep ORDER BY (weight > 0) DESC, key, token) - 1 AS position FROM keyed)
"""

#: SQL of cell probabilities from positions cut at 40, as in structures.sampled_probabilities.
CELLS = f"""{DRAWS}, cut AS (SELECT * FROM pos WHERE position < 40), bounds AS (SELECT unnest([5, 10]) AS set_boundary),
both_pos AS (SELECT p.context, p.trigger, p.query, q.rep, q.position AS pq, t.position AS pt FROM pairs p
  LEFT JOIN cut q ON q.context = p.context AND q.token = p.query LEFT JOIN cut t ON t.context = p.context AND t.token = p.trigger AND t.rep = q.rep),
cells AS (SELECT context, trigger, query, set_boundary, coalesce(sum((pq < set_boundary)::INT), 0) / {REPS}.0 AS p_set, coalesce(sum((pq < pt)::INT), 0) / {REPS}.0 AS p_ordering,
  coalesce(sum((pq < set_boundary AND pq < pt)::INT), 0) / {REPS}.0 AS p_conjunction, coalesce(sum(((pq < set_boundary OR pq < pt) AND pt IS NOT NULL)::INT), 0) / {REPS}.0 AS p_disjunction
  FROM both_pos CROSS JOIN bounds GROUP BY ALL)"""
LONG = CELLS + """, long AS (SELECT context, trigger, query, set_boundary, 'set' AS structure, p_set AS p FROM cells UNION ALL
  SELECT context, trigger, query, set_boundary, 'ordering', p_ordering FROM cells UNION ALL SELECT context, trigger, query, set_boundary, 'conjunction', p_conjunction FROM cells UNION ALL
  SELECT context, trigger, query, set_boundary, 'disjunction', p_disjunction FROM cells),
results AS (SELECT l.structure, l.set_boundary, t.context, t.trigger, t.query, t.user_id, t.neg, p AS negation_probability, CASE WHEN neg = 1 THEN p ELSE 1 - p END AS probability_query_observed,
  CASE WHEN CASE WHEN neg = 1 THEN p ELSE 1 - p END > 0 THEN ln(CASE WHEN neg = 1 THEN p ELSE 1 - p END) ELSE ln(1e-10) END AS log_likelihood FROM trials t JOIN long l USING (context, trigger, query))"""


def source(spark, d):
    return study.dist(spark, d).select("context", "token", F.expr("CASE WHEN length(token) % 7 = 0 THEN 0.0D ELSE CAST(n AS DOUBLE) END").alias("weight"))


def positions(spark, d, k=None):
    return sampling.sample_orderings(source(spark, d), REPS, k=k)


def cells(spark, d):
    return structures.sampled_probabilities(study.pairs(spark, d), positions(spark, d, 40), REPS, list(BOUNDARIES))


def results(spark, d, names=structures.DEFAULT):
    return structures.run_experiment(study.trials(spark, d), positions(spark, d, 40), REPS, list(BOUNDARIES), list(names), "cloze")


@query("e1_weighted_ordering", DRAWS + "SELECT * FROM pos")
def e1(spark, d):
    return positions(spark, d)


@query("e2_prefix_sampling", DRAWS + "SELECT context, rep, token, position FROM pos p WHERE position < 20 AND EXISTS (SELECT 1 FROM pairs q WHERE q.context = p.context AND q.query = p.token)")
def e2(spark, d):
    need = study.pairs(spark, d).select("context", F.col("query").alias("token"))
    return sampling.required_positions(positions(spark, d, 20), need).select("context", "rep", "token", "position")


@query("e3_full_positions", DRAWS + "SELECT context, rep, token, position FROM pos p WHERE EXISTS (SELECT 1 FROM pairs q WHERE q.context = p.context AND q.query = p.token)")
def e3(spark, d):
    need = study.pairs(spark, d).select("context", F.col("query").alias("token"))
    return sampling.required_positions(positions(spark, d), need).select("context", "rep", "token", "position")


@query("e4_set_from_ordering", DRAWS + "SELECT context, rep, count(*) AS size, min(token) AS first_token FROM pos WHERE position < 10 GROUP BY context, rep")
def e4(spark, d):
    return sampling.set_from_ordering(positions(spark, d, 10), 10).groupBy("context", "rep").agg(F.count("*").alias("size"), F.min("token").alias("first_token"))


@query("e5_random_size_sets", DRAWS + f""", sizes AS (SELECT context, rep, (2 + floor({u_sql("context", "rep", seed="7s")} * (count(*) - 1)))::INT AS size FROM pos GROUP BY context, rep)
SELECT context, rep, token, position, size FROM pos JOIN sizes USING (context, rep) WHERE position < size""")
def e5(spark, d):
    return sampling.sample_random_sets(source(spark, d), REPS)


@query("e6_uniform_orderings", f"""WITH keyed AS (SELECT context, token, rep, -ln({u_sql("context", "rep", "token")}) AS key FROM dist CROSS JOIN (SELECT unnest(generate_series(0, {REPS - 1})) AS rep))
SELECT context, rep, token, row_number() OVER (PARTITION BY context, rep ORDER BY key, token) - 1 AS position FROM keyed""")
def e6(spark, d):
    return sampling.sample_uniform(study.dist(spark, d).select("context", "token"), REPS)


@query("e7_orderings_per_trigger", f"""WITH src AS (SELECT p.context, p.trigger, d.token, d.n::DOUBLE AS weight FROM (SELECT DISTINCT context, trigger FROM pairs) p JOIN dist d ON d.context = p.context AND d.token <> p.trigger WHERE d.rk <= 20),
keyed AS (SELECT *, -ln({u_sql("context", "trigger", "rep", "token")}) / weight AS key FROM src CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS rep))
SELECT context, trigger, rep, token, row_number() OVER (PARTITION BY context, trigger, rep ORDER BY key, token) - 1 AS position FROM keyed""")
def e7(spark, d):
    shown = study.pairs(spark, d).select("context", "trigger").distinct()
    words = study.top(spark, d, 20).select("context", "token", F.col("n").cast("double").alias("weight"))
    return sampling.sample_orderings(shown.join(words, "context").where("token <> trigger"), 5, by=("context", "trigger"))


def _cell(name, column):
    @query(name, CELLS + f" SELECT context, trigger, query, set_boundary, {column} AS p FROM cells")
    def f(spark, d):
        return cells(spark, d).select("context", "trigger", "query", "set_boundary", F.col(column).alias("p"))

    return f


f1, f2 = _cell("f1_ordering_sampled", "p_ordering"), _cell("f2_set_sampled", "p_set")
f3, f4 = _cell("f3_conjunction_sampled", "p_conjunction"), _cell("f4_disjunction_sampled", "p_disjunction")


@query("f5_baselines", "SELECT context, neg, structure, count(*) AS n, sum(CASE WHEN neg = (structure = 'always_negate')::INT THEN 0.0 ELSE ln(1e-10) END) AS log_likelihood FROM trials CROSS JOIN (SELECT unnest(['always_negate', 'never_negate']) AS structure) GROUP BY ALL")
def f5(spark, d):
    long = structures.to_long(study.pairs(spark, d).withColumn("set_boundary", F.lit(0)).drop("rt", "rq"), ["always_negate", "never_negate"])
    return structures.scored_trials(study.trials(spark, d), long).groupBy("context", "neg", "structure").agg(F.count("*").alias("n"), F.sum("log_likelihood").alias("log_likelihood"))


@query("f6_log_likelihood", LONG + " SELECT context, trigger, query, structure, set_boundary, neg, log_likelihood, count(*) AS n FROM results GROUP BY ALL")
def f6(spark, d):
    return results(spark, d).groupBy("context", "trigger", "query", "structure", "set_boundary", "neg", "log_likelihood").agg(F.count("*").alias("n"))


@query("f7_structure_registry", LONG + " SELECT structure, count(*) AS n, avg(p) AS mean_p FROM (SELECT structure, p FROM long WHERE structure IN ('set', 'ordering') UNION ALL SELECT 'always_negate', 1.0 FROM cells UNION ALL SELECT 'never_negate', 0.0 FROM cells) GROUP BY structure")
def f7(spark, d):
    return structures.to_long(cells(spark, d), structures.structures(["set", "ordering"], True)).groupBy("structure").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"))


@query("f8_pair_order_counts", """SELECT p.context, trigger, query, q.n / (q.n + t.n)::DOUBLE AS p FROM pairs p JOIN dist q ON q.context = p.context AND q.token = query JOIN dist t ON t.context = p.context AND t.token = trigger""")
def f8(spark, d):
    n = study.dist(spark, d).select("context", "token", "n")
    both = study.pairs(spark, d).join(n.select("context", F.col("token").alias("query"), F.col("n").alias("q")), ["context", "query"]).join(n.select("context", F.col("token").alias("trigger"), F.col("n").alias("t")), ["context", "trigger"])
    return both.select("context", "trigger", "query", structures.pair_order_counts(F.col("q"), F.col("t"), F.col("query") == F.col("trigger")).alias("p"))


@query("f9_pair_order_logprob", """SELECT p.context, trigger, query, 1 / (1 + exp(t.logprob - q.logprob)) AS p FROM pairs p JOIN scores q ON q.context = p.context AND q.token = query JOIN scores t ON t.context = p.context AND t.token = trigger""")
def f9(spark, d):
    return _scored_pairs(spark, d).select("context", "trigger", "query", structures.pair_order_logprob(F.col("lq"), F.col("lt"), F.col("query") == F.col("trigger")).alias("p"))


def _scored_pairs(spark, d):
    s = study.scores(spark, d).select("context", "token", "logprob")
    return F.broadcast(study.pairs(spark, d)).join(s.select("context", F.col("token").alias("query"), F.col("logprob").alias("lq")), ["context", "query"]).join(s.select("context", F.col("token").alias("trigger"), F.col("logprob").alias("lt")), ["context", "trigger"])


#: SQL of estimates on positions cached up to 40, a missing one standing after all.
EST = f"""{DRAWS}, cut AS (SELECT * FROM pos WHERE position < 40), est AS (SELECT p.context, p.trigger, p.query, r.rep, coalesce(q.position, 40) AS pq, coalesce(t.position, 40) AS pt
FROM pairs p CROSS JOIN reps r LEFT JOIN cut q ON q.context = p.context AND q.token = query AND q.rep = r.rep LEFT JOIN cut t ON t.context = p.context AND t.token = trigger AND t.rep = r.rep),
e AS (SELECT context, trigger, query, avg((pq < 10)::INT) AS p_set, avg((pq < pt)::INT) AS p_ordering, avg((pq < 10 AND pq < pt)::INT) AS p_conjunction FROM est GROUP BY ALL)"""


def estimates(spark, d):
    cut = positions(spark, d, 40)
    base = study.pairs(spark, d).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1))))
    q = cut.select("context", F.col("token").alias("query"), "rep", F.col("position").alias("pq"))
    t = cut.select("context", F.col("token").alias("trigger"), "rep", F.col("position").alias("pt"))
    both = base.join(q, ["context", "query", "rep"], "left").join(t, ["context", "trigger", "rep"], "left").fillna(40, ["pq", "pt"])
    mean = lambda c: F.avg(c.cast("int"))
    return both.groupBy("context", "trigger", "query").agg(mean(F.col("pq") < 10).alias("p_set"), mean(F.col("pq") < F.col("pt")).alias("p_ordering"), mean((F.col("pq") < 10) & (F.col("pq") < F.col("pt"))).alias("p_conjunction"))


def _estimate(name, column):
    @query(name, EST + f" SELECT context, trigger, query, {column} AS p FROM e")
    def f(spark, d):
        return estimates(spark, d).select("context", "trigger", "query", F.col(column).alias("p"))

    return f


f10, f11, f13 = _estimate("f10_cached_set", "p_set"), _estimate("f11_cached_conjunction", "p_conjunction"), _estimate("f13_empirical_ordering", "p_ordering")


@query("f12_disjunction_inclusion_exclusion", EST + " SELECT context, trigger, query, least(1.0, greatest(0.0, p_set + p_ordering - p_conjunction)) AS p FROM e")
def f12(spark, d):
    p = F.col("p_set") + F.col("p_ordering") - F.col("p_conjunction")
    return estimates(spark, d).select("context", "trigger", "query", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"))


@query("f14_experiment_sweep", LONG + " SELECT structure, set_boundary, context, 20 AS num_reps, count(*) AS n, sum(neg)::BIGINT AS negations, avg(negation_probability) AS negation_probability, avg(probability_query_observed) AS observed, avg(log_likelihood) AS log_likelihood FROM results GROUP BY ALL")
def f14(spark, d):
    return results(spark, d).groupBy("structure", "set_boundary", "context", "num_reps").agg(F.count("*").alias("n"), F.sum("neg").alias("negations"), F.avg("negation_probability").alias("negation_probability"), F.avg("probability_query_observed").alias("observed"), F.avg("log_likelihood").alias("log_likelihood"))


@query("f15_counterfactual", LONG + " SELECT structure, context, set_boundary, avg(CASE WHEN negation_probability > 0 THEN ln(negation_probability) ELSE ln(1e-10) END) AS log_likelihood FROM results GROUP BY ALL")
def f15(spark, d):
    out = structures.run_experiment(study.trials(spark, d).withColumn("neg", F.lit(1)), positions(spark, d, 40), REPS, list(BOUNDARIES), list(structures.DEFAULT), "cloze")
    return out.groupBy("structure", "context", "set_boundary").agg(F.avg("log_likelihood").alias("log_likelihood"))


_TH = """WITH sp AS (SELECT p.context, trigger, query, q.logprob AS lq, t.logprob AS lt FROM pairs p JOIN scores q ON q.context = p.context AND q.token = query JOIN scores t ON t.context = p.context AND t.token = trigger),
th AS (SELECT *, 1 - exp(-exp(greatest(-745, least(50, (lq + 3) / 1.5)))) AS p_set, 1 / (1 + exp(-(lq - lt) / 1.5)) AS p_ordering,
  1 - exp(-exp(greatest(-745, least(50, greatest(lq, lt) / 1.5 + ln(1 + exp((least(lq, lt) - greatest(lq, lt)) / 1.5)) + 3 / 1.5)))) AS p_either FROM sp)"""


def thresholds(spark, d):
    p = S.structure_probs(F.col("lq"), F.col("lt"), F.lit(-3.0), F.lit(1.5))
    return _scored_pairs(spark, d).withColumns({f"p_{k}": v for k, v in p.items()})


@query("f16_threshold_set", _TH + " SELECT context, trigger, query, p_set FROM th")
def f16(spark, d):
    return thresholds(spark, d).select("context", "trigger", "query", "p_set")


@query("f17_threshold_ordering", _TH + " SELECT context, trigger, query, p_ordering FROM th")
def f17(spark, d):
    return thresholds(spark, d).select("context", "trigger", "query", "p_ordering")


@query("f18_threshold_structures", _TH + " SELECT context, trigger, query, p_ordering * p_either AS p_conjunction, least(1.0, greatest(0.0, p_set + p_ordering - p_ordering * p_either)) AS p_disjunction FROM th")
def f18(spark, d):
    return thresholds(spark, d).select("context", "trigger", "query", "p_conjunction", "p_disjunction")


_LOGICAL = """WITH logical AS (SELECT *, (rq <= 3)::INT AS m_set, (rq < rt)::INT AS m_ordering, (rq <= 3 AND rq < rt)::INT AS m_conjunction, (rq <= 3 OR rq < rt)::INT AS m_disjunction FROM trials)"""


def logical(spark, d):
    """Whether a deterministic model negates: inside the first three, above the trigger, both, either."""
    inside, above = F.col("rq") <= 3, F.col("rq") < F.col("rt")
    models = {"set": inside, "ordering": above, "conjunction": inside & above, "disjunction": inside | above}
    return study.trials(spark, d).withColumns({f"m_{k}": v.cast("int") for k, v in models.items()})


@query("f19_logical_models", _LOGICAL + " SELECT context, trigger, query, m_set, m_ordering, m_conjunction, m_disjunction, count(*) AS n FROM logical GROUP BY ALL")
def f19(spark, d):
    return logical(spark, d).groupBy("context", "trigger", "query", "m_set", "m_ordering", "m_conjunction", "m_disjunction").agg(F.count("*").alias("n"))


@query("f20_independence", CELLS + " SELECT context, trigger, query, set_boundary, p_set * p_ordering AS conjunction, p_set + p_ordering - p_set * p_ordering AS disjunction FROM cells")
def f20(spark, d):
    both = F.col("p_set") * F.col("p_ordering")
    return cells(spark, d).select("context", "trigger", "query", "set_boundary", both.alias("conjunction"), (F.col("p_set") + F.col("p_ordering") - both).alias("disjunction"))




@query("f21_direct_set", """WITH p AS (SELECT context, token, n / sum(n) OVER (PARTITION BY context) AS p FROM dist WHERE rk <= 4), x AS (SELECT t.context, t.neg, coalesce(p.p, 0) AS p FROM trials t LEFT JOIN p ON p.context = t.context AND p.token = t.query)
SELECT context, count(*) AS n, sum(CASE WHEN neg = 1 AND p > 0 THEN ln(p) WHEN neg = 0 AND p < 1 THEN ln(1 - p) ELSE 0 END) AS log_likelihood FROM x GROUP BY context""")
def f21(spark, d):
    w = Window.partitionBy("context")
    p = study.top(spark, d, 4).select("context", F.col("token").alias("query"), (F.col("n") / F.sum("n").over(w)).alias("p"))
    q = F.when(F.col("neg") == 1, F.col("p")).otherwise(1 - F.col("p"))
    x = study.trials(spark, d).join(p, ["context", "query"], "left").fillna(0.0, ["p"])
    return x.groupBy("context").agg(F.count("*").alias("n"), F.sum(F.when(q > 0, F.log(q)).otherwise(0.0)).alias("log_likelihood"))


@query("f22_marginal_likelihood", _LOGICAL + """, a AS (SELECT context, sum((neg = m_ordering)::INT) AS agree, count(*) AS total FROM logical GROUP BY context),
g AS (SELECT a.*, 0.501 + i * 0.001 AS accuracy FROM a CROSS JOIN (SELECT unnest(generate_series(0, 498)) AS i)), l AS (SELECT *, agree * ln(accuracy) + (total - agree) * ln(1 - accuracy) AS ll FROM g),
m AS (SELECT *, max(ll) OVER (PARTITION BY context) AS top FROM l) SELECT context, max(top) + ln(sum(exp(ll - top))) - ln(499) AS marginal, max_by(accuracy, ll)::DOUBLE AS best_accuracy FROM m GROUP BY context""")
def f22(spark, d):
    agree = logical(spark, d).groupBy("context").agg(F.sum((F.col("neg") == F.col("m_ordering")).cast("int")).alias("agree"), F.count("*").alias("total"))
    return structures.marginal_likelihood(agree, ["context"])


_GRADED = f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY context, trigger, query ORDER BY {u_sql("user_id", seed="half")}, user_id) AS k, count(*) OVER (PARTITION BY context, trigger, query) AS n FROM trials),
m AS (SELECT h.*, CASE WHEN k <= n // 2 THEN 1 ELSE 2 END AS half, structure, CASE structure WHEN 'set' THEN rq <= 3 WHEN 'ordering' THEN rq < rt WHEN 'conjunction' THEN rq <= 3 AND rq < rt ELSE rq <= 3 OR rq < rt END AS applies FROM h CROSS JOIN (SELECT unnest(['set', 'ordering', 'conjunction', 'disjunction']) AS structure)),
fit AS (SELECT structure, context, rq, count(*) AS total, avg(neg) AS p FROM m WHERE applies AND half = CASE WHEN structure = 'disjunction' THEN 2 ELSE 1 END GROUP BY ALL)"""


def graded(spark, d):
    cell = ("context", "trigger", "query")
    h = numbered(study.trials(spark, d).withColumn("u", uniform(F.col("user_id"), seed="half")), [F.asc("u"), F.asc("user_id")], "k", cell)
    h = with_total(h, F.count("*"), "n", cell)
    half = F.when(F.expr("k <= n div 2"), 1).otherwise(2)
    return structures.query_gradation(h.select("context", region(F.col("rq"), F.col("rt")).alias("region"), F.col("rq").alias("query_rank"), half.alias("half"), "neg"))


@query("f23_query_gradation", _GRADED + """, x AS (SELECT m.structure, m.context, CASE WHEN applies THEN fit.p ELSE 0 END AS p, neg FROM m LEFT JOIN fit USING (structure, context, rq) WHERE half = 2)
SELECT structure, context, count(*) AS n, avg(CASE WHEN CASE WHEN neg = 1 THEN p ELSE 1 - p END > 0 THEN ln(CASE WHEN neg = 1 THEN p ELSE 1 - p END) ELSE ln(1e-10) END) AS log_likelihood FROM x WHERE p IS NOT NULL GROUP BY ALL""")
def f23(spark, d):
    return graded(spark, d)[1]


@query("f23_graded_rates", _GRADED + " SELECT structure, context, rq AS query_rank, total, p FROM fit")
def f23_rates(spark, d):
    return graded(spark, d)[0]


@query("f24_inclusion_check", DRAWS + f", q AS (SELECT DISTINCT context, query FROM pairs) SELECT q.context, q.query, count(position) / {REPS}.0 AS empirical, max(d.weight) / max(t.total) AS direct FROM q JOIN src d ON d.context = q.context AND d.token = q.query JOIN (SELECT context, sum(weight) AS total FROM src GROUP BY context) t ON t.context = q.context LEFT JOIN pos p ON p.context = q.context AND p.token = q.query AND position < 10 GROUP BY q.context, q.query")
def f24(spark, d):
    src = source(spark, d)
    asked = study.pairs(spark, d).select("context", F.col("query").alias("token")).distinct()
    share = with_total(src, F.sum("weight"), "all_weight").select("context", "token", (F.col("weight") / F.col("all_weight")).alias("direct"))
    found = positions(spark, d, 10).groupBy("context", "token").agg((F.count("*") / float(REPS)).alias("empirical"))
    return asked.join(share, ["context", "token"]).join(found, ["context", "token"], "left").fillna(0.0, ["empirical"]).select("context", F.col("token").alias("query"), "empirical", "direct")


@query("f25_ll_totals", LONG + """, tot AS (SELECT context, sum(log_likelihood) AS log_likelihood FROM results WHERE structure = 'ordering' AND set_boundary = 5 GROUP BY context),
mis AS (SELECT context, string_agg(query, ',' ORDER BY query) AS excluded FROM (SELECT DISTINCT context, query FROM pairs WHERE rq = 6) GROUP BY context) SELECT coalesce(tot.context, mis.context) AS context, log_likelihood, coalesce(excluded, '') AS excluded FROM tot FULL JOIN mis ON tot.context = mis.context""")
def f25(spark, d):
    tot = results(spark, d, ["ordering"]).where("set_boundary = 5").groupBy("context").agg(F.sum("log_likelihood").alias("log_likelihood"))
    out = study.pairs(spark, d).where("rq = 6").select("context", "query").distinct().groupBy("context").agg(F.array_join(F.sort_array(F.collect_set("query")), ",").alias("excluded"))
    return tot.join(out, "context", "full").fillna("", ["excluded"])


