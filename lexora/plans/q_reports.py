"""Queries of calibration, agreement, reports and similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexora.functions import stats as S
from lexora.operators import agreement as A
from lexora.operators import calibrate as G
from lexora.operators import reports as R
from lexora.operators import trials
from lexora.operators.vocab import numbered

from . import q_models as M
from . import study
from .q_models import LONG
from .q_vocab import _RESP, responses
from .study import query, u_sql

C = F.col

# ---------------------------------------------------------------- G: calibration

_OBS = """WITH sp AS (SELECT p.context, trigger, query, q.logprob AS lq, t.logprob AS lt FROM pairs p JOIN scores q ON q.context = p.context AND q.token = query JOIN scores t ON t.context = p.context AND t.token = trigger),
obs AS MATERIALIZED (SELECT sp.context AS family, CASE WHEN rt % 2 = 1 THEN 'odd' ELSE 'even' END AS dataset, CASE WHEN rq <= 3 THEN 'frequent' ELSE 'rare' END AS condition, sp.trigger AS "group", sp.query AS item, lq, lt,
CASE WHEN rt % 2 = 1 THEN lq + 0.5 * lt END AS x, CASE WHEN sp.context IN ('de', 'en') THEN 'exact' ELSE 'rate_only' END AS status, sum(neg)::BIGINT AS yes, count(*) AS total, sum(neg) / count(*) AS rate FROM sp JOIN trials t USING (context, trigger, query) GROUP BY ALL),
folds AS MATERIALIZED (SELECT *, (dense_rank() OVER (PARTITION BY family, dataset ORDER BY "group") - 1) % 3 AS fold FROM obs)"""


@study.once("observations")
def observations(spark, d):
    """Answers by (family, dataset, group, item) = (language, triggers of odd or even rank, trigger, query), with both scores and a framed one for half of them."""
    n = study.trials(spark, d).groupBy("context", "trigger", "query", "rt", "rq").agg(F.sum("neg").alias("yes"), F.count("*").alias("total"))
    out = M._scored_pairs(spark, d).select("context", "trigger", "query", "lq", "lt").join(n, ["context", "trigger", "query"])
    odd = C("rt") % 2 == 1
    return out.select(
        C("context").alias("family"), F.when(odd, "odd").otherwise("even").alias("dataset"), F.when(C("rq") <= 3, "frequent").otherwise("rare").alias("condition"), C("trigger").alias("group"), C("query").alias("item"), "lq", "lt",
        F.when(odd, C("lq") + 0.5 * C("lt")).alias("x"), F.when(C("context").isin("de", "en"), "exact").otherwise("rate_only").alias("status"), "yes", "total", (C("yes") / C("total")).alias("rate"),
    )


@study.once("folded")
def folded(spark, d):
    return G.group_folds(observations(spark, d), 3)


def _p(theta, s, lq="lq", lt="lt"):
    z = f"({lq} - ({theta})) / {s}"
    either = f"greatest({lq}, {lt}) / {s} + ln(1 + exp((least({lq}, {lt}) - greatest({lq}, {lt})) / {s})) - ({theta}) / {s}"
    return {"set": f"(1 - exp(-exp(greatest(-745, least(50, {z})))))", "ordering": f"(1 / (1 + exp(-({lq} - {lt}) / {s})))", "either": f"(1 - exp(-exp(greatest(-745, least(50, {either})))))"}


def _ll(p):
    q = f"greatest(1e-10, least(1 - 1e-10, {p}))"
    return f"(yes * ln({q}) + (total - yes) * ln(1 - {q}))"


@query("g1_binomial_ll", _OBS + f" SELECT family, \"group\", item, {_ll(_p('-3', '1.5')['set'])} AS ll FROM obs")
def g1(spark, d):
    return observations(spark, d).select("family", "group", "item", S.binom_ll(S.p_set(C("lq"), F.lit(-3.0), F.lit(1.5)), C("yes"), C("total")).alias("ll"))


@query("g2_balanced_score", _OBS + f" SELECT avg(s) AS balanced FROM (SELECT sum({_ll(_p('-3', '1.5')['set'])}) / sum(total) AS s FROM obs GROUP BY family)")
def g2(spark, d):
    ll = S.binom_ll(S.p_set(C("lq"), F.lit(-3.0), F.lit(1.5)), C("yes"), C("total"))
    return G.balanced_score(observations(spark, d).withColumns({"ll": ll, "n": C("total")}))


@query("g3_threshold_bounds", _OBS + " SELECT min(least(lq, lt)) - 10 AS low, max(greatest(lq, lt)) + 10 AS high FROM obs")
def g3(spark, d):
    return G.bounds(observations(spark, d), 1.0)


_ENDS = ("(SELECT min(least(lq, lt)) - 10 FROM obs)", "(SELECT max(greatest(lq, lt)) + 10 FROM obs)")
_SCALE_ENDS = ("(SELECT min(lq) - 10 FROM obs)", "(SELECT max(lq) + 10 FROM obs)")
_KEY = 'family, dataset, "group"'


def _item(p):
    q = f"greatest(1e-10, least(1 - 1e-10, {p}))"
    return f"(rate * ln({q}) + (1 - rate) * ln(1 - {q}))"


def _fit_sql(rows, score, weight, *, folds="", family="family", ends=_ENDS, scales=(1.0, 1.0), shape=(33, 1), rounds=4):
    """SQL of G.fit: CTEs that end in `fitted`."""
    low, high = ends
    points, ps = shape
    margin, n, m = (1 if ps == 1 else 2), points - 1, max(ps - 1, 1)
    f = folds + ", " if folds else ""
    box = "t0, t1, l0, l1"
    out = f"b0 AS MATERIALIZED (SELECT DISTINCT {f}{low}::DOUBLE AS t0, {high}::DOUBLE AS t1, ln({scales[0]}) AS l0, ln({scales[1]}) AS l1 FROM {rows})"
    for r in range(rounds):
        out += f""",
g{r} AS MATERIALIZED (SELECT *, t0 + (i // {ps}) * ((t1 - t0) / {n}) AS theta, l0 + (i % {ps}) * ((l1 - l0) / {m}) AS ls FROM (SELECT DISTINCT {box} FROM b{r}), (SELECT unnest(generate_series(0, {points * ps - 1})) AS i)),
a{r} AS MATERIALIZED (SELECT {box}, i, {family}, sum({score}) AS v, sum({weight}) AS n FROM {rows}, g{r} GROUP BY ALL),
m{r} AS (SELECT {box}, i, sum(v / n) AS s, count(*) AS f FROM a{r} GROUP BY ALL)"""
        if folds:
            keys = ", ".join(dict.fromkeys([*folds.split(", "), *family.split(", ")]))
            out += f""",
o{r} AS (SELECT {keys}, {box}, i, sum({score}) AS v, sum({weight}) AS n FROM {rows} JOIN b{r} USING ({folds}) JOIN g{r} USING ({box}) GROUP BY ALL),
d{r} AS (SELECT {folds}, {box}, i, sum(CASE WHEN a.n > o.n THEN (a.v - o.v) / (a.n - o.n) ELSE 0 END - a.v / a.n) AS c, sum((a.n <= o.n)::INT) AS gone FROM o{r} o JOIN a{r} a USING ({box}, i, {family}) GROUP BY ALL),
q{r} AS (SELECT *, (s + c) / (f - gone) AS obj FROM d{r} JOIN m{r} USING ({box}, i) JOIN g{r} USING ({box}, i))"""
        else:
            out += f", q{r} AS (SELECT *, s / f AS obj FROM m{r} JOIN g{r} USING ({box}, i))"
        out += f""",
w{r} AS MATERIALIZED (SELECT {f}{box}, max_by(theta, (obj, -i)) AS theta, max_by(ls, (obj, -i)) AS ls, max(obj) AS obj FROM q{r} GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT {f}greatest({low}, theta - {margin} * (t1 - t0) / {n}) AS t0, least({high}, theta + {margin} * (t1 - t0) / {n}) AS t1, greatest(ln({scales[0]}), ls - {margin} * (l1 - l0) / {m}) AS l0, least(ln({scales[1]}), ls + {margin} * (l1 - l0) / {m}) AS l1 FROM w{r})"""
    near = lambda x, a, b, t: f"(abs({x} - ({a})) <= {t} OR abs({x} - ({b})) <= {t})::INT"
    return out + f""",
fitted AS MATERIALIZED (SELECT {f}theta, exp(ls) AS scale, obj AS objective, {near('theta', low, high, f'greatest(1e-6, 1e-5 * ({high} - {low}))')} AS theta_at_bound, {near('ls', f'ln({scales[0]})', f'ln({scales[1]})', '1e-5')} AS scale_at_bound FROM w{rounds - 1})"""


def _box_sql(rows, folds=""):
    return _fit_sql(rows, _item(_p("theta", "exp(ls)")["set"]), "1", folds=folds, family="family, dataset", ends=_SCALE_ENDS, scales=(0.1, 20.0), shape=(17, 17), rounds=3)


def _four(theta, s):
    """SQL columns p_ and ll_ of the four structures."""
    p = _p(theta, s)
    conj = f"greatest(0, least(1, {p['ordering']} * {p['either']}))"
    every = {"set": p["set"], "ordering": p["ordering"], "conjunction": conj, "disjunction": f"greatest(0, least(1, {p['set']} + {p['ordering']} - {conj}))"}
    return ", ".join([*(f"{v} AS p_{k}" for k, v in every.items()), *(f"{_ll(v)} AS ll_{k}" for k, v in every.items())])


def _ends(rows):
    ends = G.bounds(rows, 1.0)
    return ends.select("low").scalar(), ends.select("high").scalar()


def _flags(df):
    return df.withColumns({c: C(c).cast("int") for c in df.columns if c.endswith("at_bound")})


@query("g4_fit_threshold", _OBS + ", " + _fit_sql("obs", _ll(_p("theta", "1.0")["set"]), "total") + " SELECT theta, objective, theta_at_bound AS at_bound FROM fitted")
def g4(spark, d):
    rows = observations(spark, d)
    return _flags(G.fit_threshold(rows, "set", 1.0, *_ends(rows)))


_INTERCEPTS = f"""intercepts AS (SELECT {_KEY}, (SELECT count(*) FROM obs) - count(*) AS train_rows, count(*) AS test_rows, ((SELECT sum(total) FROM obs) - sum(total))::BIGINT AS train_responses, sum(total)::BIGINT AS test_responses,
((SELECT sum(yes) FROM obs) - sum(yes)) / ((SELECT sum(total) FROM obs) - sum(total)) AS intercept FROM obs GROUP BY ALL)"""
_LOGO = f"""{_OBS}, {_fit_sql("obs", _ll(_p("theta", "1.0")["set"]), "total", folds=_KEY)}, {_INTERCEPTS},
pred AS MATERIALIZED (SELECT *, {_ll("baseline")} AS ll_baseline FROM (SELECT o.*, theta, theta_at_bound AS at_bound, intercept AS baseline, {_four("theta", "1.0")} FROM obs o JOIN fitted USING ({_KEY}) JOIN intercepts USING ({_KEY})))"""
_P = [f"{a}_{k}" for a in ("p", "ll") for k in G.STRUCTURES]


@study.once("predictions")
def predictions(spark, d):
    return G.logo_cv(observations(spark, d), "set", 1.0)


@query("g5_leave_group_out", _LOGO + f" SELECT {_KEY}, item, theta, at_bound, baseline, ll_baseline, {', '.join(_P)} FROM pred")
def g5(spark, d):
    return _flags(predictions(spark, d)).select(*G.KEY, "item", "theta", "at_bound", "baseline", "ll_baseline", *_P)


@query("g6_training_intercept", f"{_OBS}, {_INTERCEPTS} SELECT * FROM intercepts")
def g6(spark, d):
    return G.intercepts(observations(spark, d))


_RANK = "rank() OVER (PARTITION BY scope, structure ORDER BY {0}) + (count(*) OVER (PARTITION BY scope, structure, {0}) - 1) / 2"


@query("g7_heldout_summary", f"""{_LOGO}, long AS ({" UNION ALL ".join(f"SELECT family, dataset, condition, total, rate, ll_baseline, '{k}' AS structure, p_{k} AS p, ll_{k} AS ll FROM pred" for k in G.STRUCTURES)}),
scoped AS (SELECT 'overall' AS scope_type, 'all' AS scope, * FROM long UNION ALL SELECT 'condition', concat_ws('::', family, dataset, condition), * FROM long),
ranked AS (SELECT *, {_RANK.format("p")} AS rp, {_RANK.format("rate")} AS rr FROM scoped)
SELECT scope_type, scope, structure, count(*) AS items, sum(total)::BIGINT AS responses, CASE WHEN count(*) > 1 AND min(p) < max(p) AND min(rate) < max(rate) THEN corr(p, rate) END AS r, CASE WHEN count(*) > 1 AND min(p) < max(p) AND min(rate) < max(rate) THEN corr(rp, rr) END AS rho,
sum(ll) AS ll, sum(ll) / sum(total) AS mean_ll, sum(ll_baseline) AS baseline_ll, sum(ll_baseline) / sum(total) AS baseline_mean_ll, (sum(ll) - sum(ll_baseline)) / sum(total) AS delta_mean_ll FROM ranked GROUP BY ALL""")  # fmt: skip
def g7(spark, d):
    return G.heldout_summary(predictions(spark, d))


@query("g9_group_folds", _OBS + f" SELECT {_KEY}, item, fold FROM folds")
def g9(spark, d):
    return folded(spark, d).select(*G.KEY, "item", "fold")


@query("g10_item_score", _OBS + f", x AS (SELECT family, rate, greatest(1e-10, least(1 - 1e-10, {_p('-3', '1.5')['set']})) AS p FROM obs) SELECT family, avg(rate * ln(p) + (1 - rate) * ln(1 - p)) AS score FROM x GROUP BY family")
def g10(spark, d):
    p = S.p_set(C("lq"), F.lit(-3.0), F.lit(1.5))
    return observations(spark, d).groupBy("family").agg(F.avg(G.item_score(C("rate"), p)).alias("score"))


@query("g11_fit_threshold_scale", _OBS + ", " + _box_sql("obs") + " SELECT * FROM fitted")
def g11(spark, d):
    rows = observations(spark, d)
    ends = rows.agg((F.min("lq") - 10).alias("low"), (F.max("lq") + 10).alias("high"))
    return _flags(G.fit_threshold_scale(rows, ends.select("low").scalar(), ends.select("high").scalar()))


_CV = f"""{_OBS}, {_box_sql("folds", "fold")},
means AS (SELECT family, dataset, fold, (sum(sum(rate)) OVER w - sum(rate)) / (sum(count(*)) OVER w - count(*)) AS intercept FROM folds GROUP BY family, dataset, fold WINDOW w AS (PARTITION BY family, dataset)),
pred AS MATERIALIZED (SELECT o.*, theta, scale, intercept, {_four("theta", "scale")} FROM folds o JOIN fitted USING (fold) JOIN means USING (family, dataset, fold))"""


@query("g12_fold_parameters", _CV + f""", size AS (SELECT fold, count(*) AS test_rows, count(DISTINCT ({_KEY})) AS test_groups FROM folds GROUP BY fold)
SELECT fitted.*, (SELECT count(*) FROM folds) - test_rows AS train_rows, test_rows, (SELECT count(DISTINCT ({_KEY})) FROM folds) - test_groups AS train_groups, test_groups FROM fitted JOIN size USING (fold)""")
def g12(spark, d):
    return _flags(G.cv_predictions(folded(spark, d))[1])


@study.once("cv")
def cv(spark, d):
    return G.cv_predictions(folded(spark, d))[0]


@query("g12_fold_predictions", _CV + f" SELECT {_KEY}, item, fold, theta, scale, intercept, {', '.join(_P)} FROM pred")
def g12_predictions(spark, d):
    return cv(spark, d).select(*G.KEY, "item", "fold", "theta", "scale", "intercept", *_P)


#: Fixed order of the tables' rows.
_ROWS = [f"{lang}-{kind}" for lang in ("de", "en", "es", "fr") for kind in ("odd", "even")]


def _r(c):
    return f"CASE WHEN count({c}) > 2 AND min({c}) < max({c}) AND min(rate) < max(rate) THEN corr({c}, rate) END"


_TABLE = f"""{_CV}, named AS (SELECT family || '-' || dataset AS analysis_id, * FROM pred), correlations AS (SELECT analysis_id, count(*) AS n, CASE WHEN count(DISTINCT status) = 1 THEN min(status) END AS status,
CASE WHEN count(x) = count(*) THEN {_r('x')} END AS r_x_but_not_y, {_r('lq')} AS r_no_frame, {', '.join(f"{_r('p_' + k)} AS r_{k}" for k in G.STRUCTURES)}, list_position([{', '.join(f"'{x}'" for x in _ROWS)}], analysis_id)::BIGINT AS position FROM named GROUP BY analysis_id)"""


@query("g13_correlation_table", _TABLE + " SELECT * FROM correlations")
def g13(spark, d):
    return G.correlation_table(cv(spark, d), _ROWS)


_SCORES = f"""{_TABLE}, long AS ({" UNION ALL ".join(f"SELECT analysis_id, status, rate, yes, total, intercept AS base, '{k}' AS model, {c} AS p FROM named" for k, c in (("intercept", "intercept"), *((k, f"p_{k}") for k in G.STRUCTURES)))}),
score_table AS (SELECT *, response_ll / responses AS response_score FROM (SELECT analysis_id, model, count(*) AS n, avg({_item("p")}) AS item_score, avg({_item("p")}) - avg({_item("base")}) AS delta_item_score,
CASE WHEN bool_and(status = 'exact') THEN sum({_ll("p")}) END AS response_ll, CASE WHEN bool_and(status = 'exact') THEN sum(total)::BIGINT END AS responses FROM long GROUP BY ALL))"""


@query("g14_score_table", _SCORES + " SELECT * FROM score_table")
def g14(spark, d):
    return G.score_table(cv(spark, d))


@query("g15_widen_scores", _SCORES + f""" SELECT correlations.*, {", ".join(f"max(t.{c}) FILTER (WHERE model = '{k}') AS {k}_{c}" for k in G.STRUCTURES for c in ("item_score", "response_score"))}
FROM correlations JOIN score_table t USING (analysis_id) GROUP BY ALL""")
def g15(spark, d):
    return G.widen_scores(g13(spark, d), g14(spark, d))


@query("g16_single_value", "SELECT lang, count(DISTINCT source) AS n_values, CASE WHEN count(DISTINCT source) = 1 THEN min(source) END AS value FROM documents GROUP BY lang")
def g16(spark, d):
    n = F.countDistinct("source")
    return study.documents(spark, d).groupBy("lang").agg(n.alias("n_values"), F.when(n == 1, F.min("source")).alias("value"))


# ---------------------------------------------------------------- H: agreement

_AGREE = "WITH x AS (SELECT m.source, m.context, m.token, m.n::DOUBLE AS a, d.n::DOUBLE AS b FROM model_counts m JOIN dist d USING (context, token)), rk AS (SELECT *, rank() OVER (PARTITION BY source, context ORDER BY a) + (count(*) OVER (PARTITION BY source, context, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY source, context ORDER BY b) + (count(*) OVER (PARTITION BY source, context, b) - 1) / 2.0 AS rb FROM x), rho AS (SELECT source, context, count(*) AS n_items, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(ra, rb) END AS spearman_rho, sum(a) AS sum_x, sum(b) AS sum_y FROM rk GROUP BY source, context)"


def _both(spark, d):
    """Words' counts by source and over all; joined by key, as Spark would broadcast the saved counts for their few bytes on disk."""
    own = study.dist(spark, d).select("context", "token", C("n").cast("double").alias("b")).hint("merge")
    return study.model_counts(spark, d).select("source", "context", "token", C("n").cast("double").alias("a")).join(own, ["context", "token"])


@query("h1_pearson", _AGREE + " SELECT source, context, count(*) AS n, CASE WHEN count(*) > 1 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS r FROM x GROUP BY ALL")
def h1(spark, d):
    return _both(spark, d).groupBy("source", "context").agg(F.count("*").alias("n"), S.pearson(C("a"), C("b")).alias("r"))


@query("h2_spearman", _AGREE + " SELECT source, context, n_items AS n, spearman_rho AS rho FROM rho")
def h2(spark, d):
    return S.spearman(_both(spark, d), ["source", "context"], "a", "b")


_H3 = _AGREE + ", g AS (SELECT unnest(['ALL', context]) AS \"group\", a, b FROM x), gr AS (SELECT *, rank() OVER (PARTITION BY \"group\" ORDER BY a) + (count(*) OVER (PARTITION BY \"group\", a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY \"group\" ORDER BY b) + (count(*) OVER (PARTITION BY \"group\", b) - 1) / 2.0 AS rb FROM g)"


#: Two-sided p of r with n rows: the finite series of Student's t for whole degrees of freedom.
_P_VALUE = """CASE WHEN n < 3 OR r IS NULL THEN NULL WHEN abs(r) >= 1 THEN 0 WHEN n % 2 = 0
THEN 1 - abs(r) * list_sum(list_transform(generate_series(0, (n - 4) // 2), lambda k: exp(k * ln(1 - r * r) + lgamma(k + 0.5) - lgamma(k + 1.0) - lgamma(0.5))))
ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * coalesce(list_sum(list_transform(generate_series(0, (n - 5) // 2), lambda k: exp(k * ln(1 - r * r) + lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5)))), 0)) END"""


@query("h3_correlation_report", _H3 + f', told AS (SELECT "group", count(*) AS n, count(DISTINCT a) AS x_unique, count(DISTINCT b) AS y_unique, corr(a, b) AS r, corr(ra, rb) AS rho, NULL AS undefined_reason FROM gr GROUP BY "group") SELECT *, abs(round({_P_VALUE}, 9)) AS p_value FROM told')
def h3(spark, d):
    return A.correlation_report(_both(spark, d), "context", "a", "b").withColumn("p_value", F.abs(F.round("p_value", 9)))


@query("h4_split_half", f"WITH h AS (SELECT *, row_number() OVER (PARTITION BY context, trigger, query ORDER BY {u_sql('context', 'trigger', 'query', 'user_id', seed='split')}, user_id) AS k, count(*) OVER (PARTITION BY context, trigger, query) AS n FROM trials) SELECT context, trigger, query, avg(neg) FILTER (WHERE k <= ceil(n / 2)) AS rate_1, avg(neg) FILTER (WHERE k > ceil(n / 2)) AS rate_2 FROM h GROUP BY ALL")
def h4(spark, d):
    return A.split_half(study.trials(spark, d))


_SPLITS = _RESP + f""", people AS (SELECT context, participant, split FROM (SELECT DISTINCT context, participant FROM resp) CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS split)),
h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY context, split ORDER BY {u_sql("context", "split", "participant", seed="words")}, participant) <= floor(count(*) OVER (PARTITION BY context, split) / 2) THEN 1 ELSE 2 END AS half FROM people),
n AS (SELECT r.context, split, word, sum((half = 1)::INT) + 1 AS a, sum((half = 2)::INT) + 1 AS b FROM resp r JOIN h USING (context, participant) GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY context, split ORDER BY a) + (count(*) OVER (PARTITION BY context, split, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY context, split ORDER BY b) + (count(*) OVER (PARTITION BY context, split, b) - 1) / 2.0 AS rb FROM n),
rho AS (SELECT context, split, count(*) AS n, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(ra, rb) END AS rho FROM rk GROUP BY ALL)"""


@query("h5_repeated_split_half", _SPLITS + " SELECT context, count(rho) AS valid, avg(rho) AS mean, stddev_samp(rho) AS sd FROM rho GROUP BY context")
def h5(spark, d):
    rho = A.split_half_words(responses(spark, d), 10)
    return rho.groupBy("context").agg(F.count("rho").alias("valid"), F.avg("rho").alias("mean"), F.stddev_samp("rho").alias("sd"))


@query("h6_half_vs_source", _RESP + f""", h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY context ORDER BY {u_sql("context", "participant", seed="half")}, participant) <= ceil(count(*) OVER (PARTITION BY context) / 2) THEN 1 ELSE 2 END AS half FROM (SELECT DISTINCT context, participant, word FROM resp)),
sz AS (SELECT context, half, count(DISTINCT participant) AS people FROM h GROUP BY ALL), sh AS (SELECT context, half, word, count(*) / any_value(people)::DOUBLE AS p FROM h JOIN sz USING (context, half) GROUP BY ALL),
v AS (SELECT d.context, d.token AS word, n::DOUBLE AS weight, half FROM (SELECT context, word AS token, count(*) AS n FROM resp WHERE source = 'src0' GROUP BY ALL) d CROSS JOIN (SELECT unnest([1, 2]) AS half)),
x AS (SELECT v.*, coalesce(p, 0) AS p FROM v LEFT JOIN sh USING (context, half, word)),
rk AS (SELECT *, rank() OVER (PARTITION BY half, context ORDER BY p) + (count(*) OVER (PARTITION BY half, context, p) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY half, context ORDER BY weight) + (count(*) OVER (PARTITION BY half, context, weight) - 1) / 2.0 AS rb FROM x)
SELECT half, context, count(*) AS n, CASE WHEN min(p) < max(p) AND min(weight) < max(weight) THEN corr(ra, rb) END AS rho FROM rk GROUP BY ALL""")
def h6(spark, d):
    r = responses(spark, d)
    src = r.where("source = 'src0'").groupBy("context", C("word").alias("token")).agg(F.count("*").cast("double").alias("weight"))
    return A.half_vs_source(r, src)


@query("h7_rank_agreement", _AGREE + " SELECT * FROM rho WHERE n_items >= 3")
def h7(spark, d):
    return A.rank_agreement(_both(spark, d), ["source", "context"], "a", "b")


@query("h8_agreement_summary", _AGREE + " SELECT source, count(*) AS contexts_evaluated, avg(spearman_rho) AS mean_spearman, sum(spearman_rho * n_items) / sum(n_items) AS weighted_spearman FROM rho WHERE n_items >= 3 AND spearman_rho IS NOT NULL GROUP BY source")
def h8(spark, d):
    return A.agreement_summary(h7(spark, d), "source")


@query("h9_sentence_summary", _AGREE + " SELECT source, avg(spearman_rho) AS mean_rho, count(spearman_rho) AS n FROM rho GROUP BY source")
def h9(spark, d):
    return h2(spark, d).groupBy("source").agg(F.avg("rho").alias("mean_rho"), F.count("rho").alias("n"))


@query("h10_mean_by_split", _SPLITS + " SELECT split, avg(rho) AS mean_rho FROM rho GROUP BY split")
def h10(spark, d):
    return A.split_half_words(responses(spark, d), 10).groupBy("split").agg(F.avg("rho").alias("mean_rho"))


_H11 = _RESP + """, hum AS (SELECT context, word, row_number() OVER (PARTITION BY context ORDER BY count(*) DESC, word) - 1 AS human_position FROM resp GROUP BY context, word), src AS (SELECT context, token AS word, rk - 1 AS position FROM dist),
j AS (SELECT hum.*, position FROM hum LEFT JOIN src USING (context, word))"""


@query("h11_rank_vs_source", _H11 + ", o AS (SELECT context, corr(rank_a, rank_b) AS rho FROM (SELECT context, rank() OVER (PARTITION BY context ORDER BY human_position) AS rank_a, rank() OVER (PARTITION BY context ORDER BY position) AS rank_b FROM j WHERE position IS NOT NULL) GROUP BY context) SELECT context, count(*) AS n_human_words, count(position) AS n_overlap, any_value(rho) AS rho FROM j LEFT JOIN o USING (context) GROUP BY context")
def h11(spark, d):
    n = responses(spark, d).groupBy("context", "word").agg(F.count("*").alias("n"))
    hum = numbered(n, [F.desc("n"), F.asc("word")], "k", ("context",)).select("context", "word", (C("k") - 1).alias("human_position"))
    src = numbered(study.dist(spark, d), [F.desc("n"), F.asc("token")], "k", ("context",)).select("context", C("token").alias("word"), (C("k") - 1).alias("position"))
    j = hum.join(src, ["context", "word"], "left")
    counts = j.groupBy("context").agg(F.count("*").alias("n_human_words"), F.count("position").alias("n_overlap"))
    rho = S.spearman(j.withColumns({"human_position": C("human_position").cast("double"), "position": C("position").cast("double")}), ["context"], "human_position", "position").select("context", "rho")
    return counts.join(rho, "context", "left")


@query("h12_ll_vs_rank", LONG + ", " + _AGREE[5:] + ", ll AS (SELECT context, avg(log_likelihood) AS ll FROM results GROUP BY context) SELECT context, ll, avg(spearman_rho) AS rho FROM ll JOIN rho USING (context) WHERE spearman_rho IS NOT NULL GROUP BY context, ll")
def h12(spark, d):
    ll = M.results(spark, d).groupBy("context").agg(F.avg("log_likelihood").alias("ll"))
    rho = h2(spark, d).where("rho is not null").groupBy("context").agg(F.avg("rho").alias("rho"))
    return ll.join(rho, "context").dropna()


@query("h13_match_stats", M._LOGICAL + " SELECT context, sum((neg = m_ordering)::INT)::BIGINT AS matches, count(*) AS n, corr(neg, m_ordering) AS r FROM logical GROUP BY context")
def h13(spark, d):
    x = M.logical(spark, d)
    return x.groupBy("context").agg(F.sum((C("neg") == C("m_ordering")).cast("int")).alias("matches"), F.count("*").alias("n"), S.pearson(C("neg"), C("m_ordering")).alias("r"))


@query("h14_classification", """WITH t AS (SELECT sum((quality = 0 AND toxic = 1)::INT)::BIGINT AS tp, sum((quality = 1 AND toxic = 1)::INT)::BIGINT AS fp, sum((quality = 0 AND toxic = 0)::INT)::BIGINT AS fn, sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS tn FROM labels),
m AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))::DOUBLE AS chance FROM t)
SELECT tp, fp, fn, tn, accuracy, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1, (accuracy - chance) / (1 - chance) AS kappa FROM m""")
def h14(spark, d):
    return A.classification_report(study.table(spark, d, "labels"), F.when(C("quality") == 0, 1).otherwise(0), C("toxic"))


# ---------------------------------------------------------------- I: reports

_RES = LONG + ", res AS (SELECT *, 'cloze' AS source FROM results), bc AS (SELECT structure, source, context, count(*) AS observed_rows, count(DISTINCT set_boundary) AS observed_boundaries, avg(log_likelihood) AS average, median(log_likelihood) AS median, coalesce(stddev_samp(log_likelihood), 0) AS std, min(log_likelihood) AS min, max(log_likelihood) AS max FROM res GROUP BY ALL)"


def by_context(spark, d):
    return R.ll_by_context(M.results(spark, d), ["structure", "source", "context"])


@query("i1_ll_by_context", _RES + " SELECT * FROM bc")
def i1(spark, d):
    return by_context(spark, d)


@query("i2_ll_rollup", _RES + ", one AS (SELECT source, structure, count(*) AS n, avg(average) AS mean FROM bc GROUP BY ALL) SELECT source, structure, n, mean FROM one UNION ALL SELECT source, 'ALL', count(*), avg(mean) FROM one GROUP BY source")
def i2(spark, d):
    one, two = R.ll_rollup(R.context_means(M.results(spark, d)))
    return one.select("source", "structure", C("context_count").alias("n"), C("mean_log_likelihood").alias("mean")).unionByName(two.select("source", F.lit("ALL").alias("structure"), C("structure_count").alias("n"), C("overall").alias("mean")))


@query("i3_human_rates", "SELECT context, trigger, query, avg(neg) AS human_rate, count(*) AS responses FROM trials GROUP BY ALL")
def i3(spark, d):
    return R.human_rates(study.trials(spark, d))


_POINTS = _RES + ", mr AS (SELECT source, structure, context, trigger, query, avg(negation_probability) AS model_rate FROM res GROUP BY ALL), hr AS (SELECT context, trigger, query, avg(neg) AS human_rate, count(*) AS responses FROM trials GROUP BY ALL)"


def points(spark, d):
    return R.rate_points(R.model_rates(M.results(spark, d)), R.human_rates(study.trials(spark, d)))


@query("i4_model_rates", _POINTS + " SELECT * FROM mr")
def i4(spark, d):
    return R.model_rates(M.results(spark, d))


@query("i5_rate_points", _POINTS + " SELECT * FROM mr JOIN hr USING (context, trigger, query)")
def i5(spark, d):
    return points(spark, d)


@query("i6_rate_correlations", _POINTS + " SELECT source, structure, count(*) AS cells, count(DISTINCT context) AS contexts, corr(model_rate, human_rate) AS r FROM mr JOIN hr USING (context, trigger, query) GROUP BY ALL")
def i6(spark, d):
    return R.rate_correlations(points(spark, d))


@query("i7_heatmap_cells", _RES + ", c AS (SELECT structure, set_boundary, context, trigger, query, avg(negation_probability) AS p FROM res GROUP BY ALL) SELECT structure, context, trigger, query, max(p) AS p FROM c GROUP BY ALL")
def i7(spark, d):
    return R.cells(M.results(spark, d), "max")


@query("i7_human_cells", LONG + " SELECT context, trigger, query, avg(p) AS human_rate FROM (SELECT context, trigger, query, set_boundary, avg(neg) AS p FROM results WHERE structure = 'ordering' GROUP BY ALL) GROUP BY ALL")
def i7_human(spark, d):
    return R.human_cells(M.results(spark, d))


@query("i8_ordered_matrix", """WITH cell AS (SELECT context, trigger, query, rt, rq, avg(neg) AS p FROM trials WHERE rt + rq <> 7 GROUP BY ALL),
rows AS (SELECT context, trigger, row_number() OVER (PARTITION BY context ORDER BY min(rt), trigger) AS "row" FROM cell GROUP BY context, trigger), cols AS (SELECT c.context, c.query, row_number() OVER (PARTITION BY c.context ORDER BY max(logprob) DESC NULLS LAST, c.query) AS "column" FROM cell c LEFT JOIN scores s ON s.context = c.context AND s.token = c.query GROUP BY c.context, c.query)
SELECT rows.context, "row", "column", rows.trigger, cols.query, p FROM rows JOIN cols USING (context) LEFT JOIN cell ON cell.context = rows.context AND cell.trigger = rows.trigger AND cell.query = cols.query""")
def i8_ordered(spark, d):
    rate = study.trials(spark, d).where("rt + rq <> 7").groupBy(*R.CELL, "rt").agg(F.avg("neg").alias("p"))
    asked = study.scores(spark, d).join(rate.select("context", C("query").alias("token")).distinct(), ["context", "token"], "right").select("context", C("token").alias("query"), "logprob")
    return R.ordered_matrix(rate, R.axis(rate, "trigger", "appearance", "rt"), R.axis(asked, "query", "base", "logprob"), "p")


@query("i8_matrix", "SELECT context || '-' || rt AS trigger, " + ", ".join(f"avg(neg) FILTER (WHERE rq = {k}) AS q{k}" for k in range(1, 7)) + " FROM trials GROUP BY context, rt")
def i8(spark, d):
    rate = study.trials(spark, d).groupBy(F.concat_ws("-", "context", "rt").alias("trigger"), F.concat(F.lit("q"), "rq").alias("q")).agg(F.avg("neg").alias("p"))
    return R.matrix(rate, "trigger", "q", [f"q{k}" for k in range(1, 7)], "p")


@query("i9_missing_by_context", "WITH m AS (SELECT context, count(*) AS missing FROM trials WHERE rq = 2 AND context <> 'de' GROUP BY context) SELECT h.context, human, coalesce(missing, 0) AS missing, human - coalesce(missing, 0) AS available, 100.0 * coalesce(missing, 0) / human AS percent FROM (SELECT context, count(*) AS human FROM trials GROUP BY context) h LEFT JOIN m USING (context)")
def i9(spark, d):
    t = study.trials(spark, d)
    return R.missing_by_context(t, t.where("rq = 2 and context <> 'de'"))


@query("i10_token_diagnostics", "SELECT token, n, n / (SELECT sum(n) FROM dist) AS share_all, n / (SELECT sum(n) FROM dist WHERE context = 'en') AS share_context, coalesce(q, 0) AS as_query, coalesce(t, 0) AS as_trigger FROM dist d LEFT JOIN (SELECT query AS token, count(*) AS q FROM trials WHERE context = 'en' GROUP BY query) a USING (token) LEFT JOIN (SELECT trigger AS token, count(*) AS t FROM trials WHERE context = 'en' GROUP BY trigger) b USING (token) WHERE context = 'en'")
def i10(spark, d):
    return R.token_diagnostics(study.dist(spark, d), study.trials(spark, d), "en")


_I11 = "WITH e AS (SELECT p.context, trigger, query, q.n / (q.n + t.n)::DOUBLE AS exact FROM pairs p JOIN dist q ON q.context = p.context AND q.token = query JOIN dist t ON t.context = p.context AND t.token = trigger), hr AS (SELECT context, trigger, query, avg(neg) AS human_rate FROM trials GROUP BY ALL)"


def pair_diagnostics(spark, d):
    exact = M.f8(spark, d).withColumnRenamed("p", "exact")
    return exact.join(R.human_rates(study.trials(spark, d)).drop("responses"), R.CELL, "left").withColumn("difference", C("exact") - C("human_rate"))


@query("i11_pair_diagnostics", _I11 + " SELECT *, exact - human_rate AS difference FROM e LEFT JOIN hr USING (context, trigger, query)")
def i11(spark, d):
    return pair_diagnostics(spark, d)


@query("i12_pair_preview", _I11 + " SELECT *, exact - human_rate AS difference FROM e LEFT JOIN hr USING (context, trigger, query) ORDER BY exact DESC, context, trigger, query LIMIT 8")
def i12(spark, d):
    return pair_diagnostics(spark, d).orderBy(F.desc("exact"), *R.CELL).limit(8)


_QS = "WITH sp AS (SELECT p.context, trigger, query, q.logprob - t.logprob AS score, q.logprob AS base FROM pairs p JOIN scores q ON q.context = p.context AND q.token = query JOIN scores t ON t.context = p.context AND t.token = trigger)"


def _pair_scores(spark, d):
    return M._scored_pairs(spark, d).select("context", "trigger", "query", (C("lq") - C("lt")).alias("score"), C("lq").alias("base"))


@query("i13_query_scores", _QS + " SELECT context, query, count(*) AS n_triggers, string_agg(DISTINCT trigger, ',' ORDER BY trigger) AS triggers, avg(score) AS mean, median(score) AS median, stddev_samp(score) AS sd, min(score) AS min, max(score) AS max, avg(score - base) AS delta FROM sp GROUP BY ALL")
def i13(spark, d):
    return R.query_scores(_pair_scores(spark, d))


def _delta(prefix, src):
    return f"SELECT context, count(delta) AS {prefix}_n, avg(delta) AS {prefix}_mean, median(delta) AS {prefix}_median, stddev_samp(delta) AS {prefix}_sd, avg(delta) - 1.96 * stddev_samp(delta) / sqrt(count(delta)) AS {prefix}_ci_low, avg(delta) + 1.96 * stddev_samp(delta) / sqrt(count(delta)) AS {prefix}_ci_high, avg((delta > 0)::INT) AS {prefix}_positive FROM {src} GROUP BY context"


@query("i14_delta_summary", _QS + ", dq AS (SELECT context, query, avg(score - base) AS delta FROM sp GROUP BY ALL), dp AS (SELECT context, score AS delta FROM sp) SELECT * FROM (" + _delta("query", "dq") + ") FULL JOIN (" + _delta("pair", "dp") + ") USING (context)")
def i14(spark, d):
    p = _pair_scores(spark, d)
    q = p.groupBy("context", "query").agg(F.avg(C("score") - C("base")).alias("delta"))
    return R.delta_summary(q, "query").join(R.delta_summary(p.select("context", C("score").alias("delta")), "pair"), "context", "full")


@query("i15_mean_se", _RES + " SELECT structure, set_boundary, count(log_likelihood) AS n, avg(log_likelihood) AS mean, stddev_samp(log_likelihood) / sqrt(count(*)) AS se FROM res GROUP BY ALL")
def i15(spark, d):
    return R.mean_se(M.results(spark, d), ["structure", "set_boundary"])


_REGIONS = _RES + """, cellr AS (SELECT context, trigger, query, CASE WHEN rq <= 3 AND rq > rt THEN 'A' WHEN rq <= 3 THEN 'B' WHEN rq > rt THEN 'C' ELSE 'D' END AS region FROM pairs),
rg AS (SELECT r.*, region FROM res r JOIN cellr USING (context, trigger, query))"""


def regions(spark, d):
    t = study.trials(spark, d)
    return R.modal_regions(t.withColumn("region", R.region(C("rq"), C("rt"))))


@query("i16_region_summary", _REGIONS + """ SELECT source, structure, context, avg(log_likelihood) AS ll, avg(log_likelihood) FILTER (WHERE region IN ('A', 'D')) AS ll_critical, count(DISTINCT (context, trigger, query)) AS cells, count(DISTINCT (context, trigger, query)) FILTER (WHERE region IN ('A', 'D')) AS critical_cells,
30 - count(DISTINCT (context, trigger, query)) AS missing_cells, 6 - count(DISTINCT (context, trigger, query)) FILTER (WHERE region IN ('A', 'D')) AS missing_critical FROM rg WHERE NOT (context = 'fr' AND trigger > query) GROUP BY ALL""")
def i16(spark, d):
    results = M.results(spark, d).where("not (context = 'fr' and trigger > query)")
    return R.region_summary(results, regions(spark, d))


@query("i16_region_means", _REGIONS + " SELECT source, structure, coalesce(context, 'ALL') AS context, region, avg(negation_probability) AS p FROM rg GROUP BY GROUPING SETS ((source, structure, region), (source, structure, region, context))")
def i16_means(spark, d):
    return R.region_means(M.results(spark, d), regions(spark, d))


@query("i17_context_spread", _RES + " SELECT context, max(average) - min(average) AS spread FROM bc GROUP BY context")
def i17(spark, d):
    return R.context_spread(R.context_means(M.results(spark, d)))


@query("i18_cells_with_rank", "SELECT context, trigger, query, avg(neg) AS mean, stddev_samp(neg) AS sd, any_value(rt) AS trigger_rank, any_value(rq) AS query_rank FROM trials GROUP BY context, trigger, query")
def i18(spark, d):
    cell = study.trials(spark, d).groupBy(*R.CELL).agg(F.avg("neg").alias("mean"), F.stddev_samp("neg").alias("sd"))
    ranks = study.top(spark, d, 6).select("context", "token", "rk")
    return cell.join(ranks.select("context", C("token").alias("trigger"), C("rk").alias("trigger_rank")), ["context", "trigger"]).join(ranks.select("context", C("token").alias("query"), C("rk").alias("query_rank")), ["context", "query"])


@query("i19_scaled_top", "WITH k AS (SELECT context, token, n::DOUBLE AS score FROM counts WHERE n < (SELECT max(n) FROM counts)), s AS (SELECT *, 100.0 * (score - (SELECT min(score) FROM k)) / ((SELECT max(score) FROM k) - (SELECT min(score) FROM k)) AS scaled FROM k) SELECT * FROM (SELECT *, rank() OVER (PARTITION BY context ORDER BY scaled DESC) AS rk FROM s) WHERE rk <= 10")
def i19(spark, d):
    return R.scaled_top(study.counts(spark, d).select("context", "token", C("n").cast("double").alias("score")), "context", 10)


_POISSON = "0" + "".join(f" + (u >= {e!r})::INT" for e in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253))


_DIAG = _RES + f""", lost AS (SELECT * FROM (SELECT context, set_boundary, CASE WHEN context = 'fr' THEN 'context_missing' WHEN context = 'en' AND rq = 2 THEN 'query_missing' WHEN context = 'en' AND rt = 2 THEN 'trigger_missing' END AS reason FROM trials CROSS JOIN (SELECT unnest([5, 10]) AS set_boundary)) WHERE reason IS NOT NULL),
means AS (SELECT source, structure, context, avg(log_likelihood) AS m FROM res GROUP BY ALL), weights AS (SELECT context, b, {_POISSON} AS w FROM (SELECT context, b, {u_sql('context', 'b', seed='boot')} AS u FROM (SELECT DISTINCT context FROM means) CROSS JOIN (SELECT unnest(generate_series(1, 1000)) AS b))),
boot AS (SELECT source, structure, b, sum(w * m) / nullif(sum(w), 0) AS mean FROM means JOIN weights USING (context) GROUP BY ALL), ci AS (SELECT source, structure, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM boot GROUP BY ALL),
by_bound AS (SELECT source, structure, min(n) AS boundary_rows_min, max(n) AS boundary_rows_max FROM (SELECT source, structure, set_boundary, count(*) AS n FROM res GROUP BY ALL) GROUP BY ALL),
base AS (SELECT source, structure, count(*) AS rows, count(DISTINCT set_boundary) AS boundaries, count(DISTINCT context) AS contexts, avg(log_likelihood) AS mean, median(log_likelihood) AS median, coalesce(stddev_samp(log_likelihood), 0) AS std, min(log_likelihood) AS min, max(log_likelihood) AS max, sum((log_likelihood < -23)::INT)::BIGINT AS floor_rows, sum((negation_probability <= 0)::INT)::BIGINT AS zero_rows FROM res GROUP BY ALL),
gone AS (SELECT count(*) AS missing_rows, count(DISTINCT set_boundary) AS missing_boundaries, count(DISTINCT context) AS missing_contexts, count(*) FILTER (WHERE reason = 'context_missing') AS missing_context_rows, count(*) FILTER (WHERE reason = 'query_missing') AS missing_query_rows, count(*) FILTER (WHERE reason = 'trigger_missing') AS missing_trigger_rows FROM lost)"""


@query("i20_diagnostics", _DIAG + " SELECT *, floor_rows / rows AS floor_rate, zero_rows / rows AS zero_rate, boundary_rows_max - boundary_rows_min AS boundary_rows_range, (boundary_rows_max > boundary_rows_min)::INT AS imbalanced, rows / (rows + missing_rows) AS coverage FROM base JOIN by_bound USING (source, structure) JOIN ci USING (source, structure) CROSS JOIN gone")
def i20(spark, d):
    from lexora.operators.structures import DEFAULT

    known = study.top(spark, d, 6).where("context <> 'fr' and not (context = 'en' and rk = 2)")
    missing = trials.missing_trials(study.trials(spark, d), known, list(M.BOUNDARIES), list(DEFAULT))
    return R.diagnostics(M.results(spark, d), missing)


@query("i21_likelihoods_long", LONG + " SELECT structure, context, avg(log_likelihood) AS ll FROM results GROUP BY ALL")
def i21(spark, d):
    from lexora.operators.structures import DEFAULT

    wide = M.results(spark, d).groupBy("context").pivot("structure", list(DEFAULT)).agg(F.avg("log_likelihood"))
    return wide.unpivot("context", list(DEFAULT), "structure", "ll")


@query("i22_expected_shares", M._LOGICAL + " SELECT context, rq, avg(m_set) AS set_share, avg(m_ordering) AS ordering_share FROM logical GROUP BY context, rq")
def i22(spark, d):
    return M.logical(spark, d).groupBy("context", "rq").agg(F.avg("m_set").alias("set_share"), F.avg("m_ordering").alias("ordering_share"))


@query("i23_histogram", "WITH e AS (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS mean, sum((value > 0)::INT)::BIGINT AS positive FROM events), n AS (SELECT least(floor((value - lo) / ((hi - lo) / 28)), 27)::INT AS bin, count(*) AS n FROM events, e GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS n, mean, positive FROM (SELECT unnest(generate_series(0, 27)) AS bin) b CROSS JOIN e LEFT JOIN n USING (bin)")
def i23(spark, d):
    return R.histogram(study.table(spark, d, "events"), "value", 28)


# ---------------------------------------------------------------- K: similarity


@query("k1_cosine_neighbours", """WITH t AS (SELECT vec_id AS target, embedding AS te FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT target, vec_id, list_sum(list_transform(list_zip(te, embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(te, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS cosine FROM t, embeddings WHERE vec_id <> target)
SELECT target, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(cosine, 9) DESC, vec_id) AS rk FROM s) WHERE rk <= 5""")
def k1(spark, d):
    from lexora.operators.similarity import nearest

    e = study.table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest(e, e.where("vec_id % 50 = 0").select(C("vec_id").alias("target"), C("embedding").alias("_t")), 5)
