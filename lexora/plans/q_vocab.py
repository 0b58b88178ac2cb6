"""Queries of sources, trial preparation, distributions and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexora.operators import trials as P
from lexora.operators import vocab as V
from lexora.sources import files

from . import study
from .study import query

C = F.col


def _written(df, label, fmt="parquet", **options):
    """df written to a new shared path and the path."""
    path = files.scratch_path(df.sparkSession, label)
    df.write.format(fmt).options(**options).save(path)
    return path


# ---------------------------------------------------------------- A: sources


@query("a1_csv_scan", "SELECT c_custkey, c_nationkey FROM customer")
def a1(spark, d):
    path = _written(study.table(spark, d, "customer").select("c_custkey", "c_nationkey"), "csv", "csv", header=True)
    return files.read_table(spark, path, ["c_custkey", "c_nationkey"], "c_custkey long, c_nationkey long").select("c_custkey", "c_nationkey")


_GRAMS = """WITH bi AS (SELECT context, token || ' ' || nxt AS token, count(*) AS count FROM (SELECT context, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM words) WHERE nxt IS NOT NULL GROUP BY ALL),
gbi AS (SELECT token, sum(count)::BIGINT AS count FROM bi GROUP BY token), guni AS (SELECT token, count(*) AS count FROM words GROUP BY token),
want AS (SELECT DISTINCT query AS token FROM pairs UNION SELECT token FROM gbi WHERE token LIKE 'the %')"""


def gbi(spark, d):
    return study.bigrams(spark, d)


def guni(spark, d):
    return study.unigrams(spark, d).groupBy("token").agg(F.sum("n").alias("count"))


@query("a2_ranked_count_lookup", _GRAMS + " SELECT token, count FROM guni WHERE token IN (SELECT token FROM want) UNION ALL SELECT token, count FROM gbi WHERE token IN (SELECT token FROM want)")
def a2(spark, d):
    uni = _written(guni(spark, d).withColumn("rank", F.lit(1)), "uni", "csv", sep="\t")
    bi = _written(gbi(spark, d).withColumn("rank", F.lit(1)), "bi", "csv", sep="\t")
    want = study.pairs(spark, d).select(C("query").alias("token")).unionByName(files.read_counts(spark, bi).where("token like 'the %'").select("token"))
    return files.frequency_counts(want, files.read_counts(spark, uni), files.read_counts(spark, bi))


@query("a3_ngram_shard_scan", "SELECT token, count(*) AS count FROM words WHERE length(token) >= 3 GROUP BY token")
def a3(spark, d):
    return files.scan_ngrams(spark, _shards(spark, d), n=1)


def _lines(spark, d):
    """Lines token, year (of the source), match_count, volume_count by prefix, with some broken ones.

    A row is one document, so its distinct words are found in its array and both counts are sums: no document is shuffled.
    """
    year = F.regexp_extract("source", "([0-9]+)", 1).cast("int") + 1900
    docs = study.documents(spark, d).select("doc_id", year.alias("year"), study.pieces().alias("w"))
    both = docs.select("doc_id", "year", F.posexplode(F.array("w", F.array_distinct("w"))).alias("kind", "w"))
    each = both.select("doc_id", "year", "kind", F.explode("w").alias("token")).where("length(token) >= 3")
    per = each.groupBy("token", "year").agg(F.count_if(C("kind") == 0).alias("n"), F.count_if((C("kind") == 1) & C("doc_id").isNotNull()).alias("v"))
    good = F.concat_ws("\t", F.initcap("token"), "year", "n", "v")
    broken = F.when(C("n") % 2 == 0, F.concat("token", F.lit("\t1900"))).otherwise(F.concat("token", F.lit("_X\t1900\tmany\t1")))
    return per.select(files.shard_prefix(C("token")).alias("prefix2"), F.explode(F.array(good, broken)).alias("value"))  # both lines of a count, which is made once


def _shards(spark, d):
    """gzip shards by prefix of _lines()."""
    path = files.scratch_path(spark, "ngrams")
    _lines(spark, d).repartition("prefix2").write.partitionBy("prefix2").option("compression", "gzip").text(path)
    return path


@query("a4_shard_pruning", "SELECT token, count(*) AS count FROM words WHERE length(token) >= 3 AND token[1:2] IN ('th', 'er') GROUP BY token")
def a4(spark, d):
    return files.scan_ngrams(spark, _shards(spark, d), n=1, prefixes=["th", "er"])


@query("a5_collect_results", "SELECT 'ordering' AS structure, lang AS source, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang")
def a5(spark, d):
    base = files.scratch_path(spark, "results")
    docs = study.documents(spark, d).select("doc_id", "lang")
    for lang in ("en", "fr", "de"):  # one folder for each result file, as a sink of one source makes
        docs.where(C("lang") == lang).write.option("header", True).csv(f"{base}/ordering_results_{lang}.csv")
    return files.collect_results(spark, base, ["ordering"], ["en", "fr"]).groupBy("structure", "source").agg(F.count("*").alias("n"))


@query("a6_word_list", "SELECT context, count(*) AS n, min(token) AS first, max(rk) AS last_line FROM dist GROUP BY context")
def a6(spark, d):
    path, order = files.scratch_path(spark, "vocab"), ["context", F.desc("n"), F.asc("token")]
    ordered = study.dist(spark, d).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("context", "token").write.partitionBy("context").text(path)
    return files.read_vocab(spark, path).groupBy("context").agg(F.count("*").alias("n"), F.min("token").alias("first"), F.max("line").alias("last_line"))


@query("a7_norm_lists", """WITH w AS (SELECT *, row_number() OVER (PARTITION BY context, trigger ORDER BY query) AS i FROM pairs)
SELECT context || '-' || trigger AS doc, 'We have ' || trigger AS sentence, query AS word, 0.1 AS probability FROM w""")
def a7(spark, d):
    w = study.pairs(spark, d).groupBy("context", "trigger").agg(F.array_sort(F.collect_list("query")).alias("q"))
    body = F.array_join(F.transform("q", lambda x: F.concat(F.lit("* "), x, F.lit(" (0.1)"))), "\n")
    text = F.concat(F.lit('1. "We have '), "trigger", F.lit('"\n* no response (0.5)\n** skipped (0.3)\n'), body)
    return files.parse_norms(w.select(F.concat_ws("-", "context", "trigger").alias("doc"), text.alias("text")))


_WIDE = """WITH wide AS (SELECT o_orderkey, o_orderpriority AS tea1, o_orderstatus AS tea2, CAST(o_custkey AS VARCHAR) AS cup_1, o_orderpriority AS cup_2 FROM orders)"""


@query("a8_unpivot_responses", _WIDE + """ SELECT o_orderkey, 'Tea' AS context, 1 AS slot, tea1 AS response FROM wide UNION ALL SELECT o_orderkey, 'Tea', 2, tea2 FROM wide UNION ALL SELECT o_orderkey, 'Cup', 1, cup_1 FROM wide UNION ALL SELECT o_orderkey, 'Cup', 2, cup_2 FROM wide""")
def a8(spark, d):
    o = study.table(spark, d, "orders")
    wide = o.select("o_orderkey", C("o_orderpriority").alias("tea1"), C("o_orderstatus").alias("tea2"), C("o_custkey").alias("cup_1"), C("o_orderpriority").alias("cup_2"))
    return files.unpivot_responses(wide, ["o_orderkey"], {"tea": "Tea", "cup": "Cup"}, 2)


@query("a9_result_sink", "SELECT structure, count(*) AS n, sum(neg)::BIGINT AS neg FROM trials CROSS JOIN (SELECT unnest(['always_negate', 'never_negate']) AS structure) GROUP BY structure")
def a9(spark, d):
    from lexora.operators import structures

    long = structures.to_long(study.pairs(spark, d).withColumn("set_boundary", F.lit(3)).drop("rt", "rq"), ["always_negate", "never_negate"])
    res = structures.scored_trials(study.trials(spark, d), long).withColumns({"num_reps": F.lit(1), "source": F.lit("base")})
    path = files.scratch_path(spark, "sink")
    files.write_results(res, path)
    files.write_results(res.where("structure = 'always_negate'"), path, "overwrite")
    return spark.read.parquet(path).groupBy("structure").agg(F.count("*").alias("n"), F.sum("neg").alias("neg"))


@query("a10_slice_sink", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def a10(spark, d):
    path = files.scratch_path(spark, "slices")
    files.write_slices(study.documents(spark, d).select("doc_id", "source"), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


@query("a11_json_manifest", """SELECT context, '{"tokens":' || count(*) || ',"sources":{"head":' || sum((rk <= 10)::INT) || ',"tail":' || sum((rk > 10)::INT) || '},"first":"' || min(token) || '","last":"' || max(token) || '","budget":60}' AS record FROM dist GROUP BY context""")
def a11(spark, d):
    head = study.top(spark, d, 10).select("context", "token", F.lit("head").alias("selection_source"))
    sel = study.dist(spark, d).join(F.broadcast(head), ["context", "token"], "left").fillna("tail", ["selection_source"])
    return files.manifest(sel, budget=60)


@query("a12_score_store", "SELECT context, token, logprob FROM scores WHERE context IN ('en', 'fr') AND n % 3 <> 0")
def a12(spark, d):
    path = files.scratch_path(spark, "scores")
    files.write_scores(study.scores(spark, d).withColumn("logprob", F.when(C("n") % 3 == 0, float("nan")).otherwise(C("logprob"))), path)
    return files.read_scores(spark, path, ["en", "fr"]).select("context", "token", "logprob")


# ---------------------------------------------------------------- C: trials



@query("c1_prepare_trials", "SELECT context, regexp_replace(query, '^(a|an) ', '') AS query, trigger, sum(neg)::BIGINT AS neg FROM trials GROUP BY ALL")
def c1(spark, d):
    raw = study.trials(spark, d).select(C("context").alias("story"), F.concat(F.lit(" A "), "query").alias("query"), C("trigger").alias("cleaned_trigger"), "neg")
    return P.prepare_trials(raw).groupBy("context", "query", "trigger").agg(F.sum("neg").alias("neg"))


@query("c3_filter_contexts", "SELECT lang AS context, count(*) AS n FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang ORDER BY min(doc_id), lang LIMIT 2) AND lang <> 'xx' GROUP BY lang")
def c3(spark, d):
    docs = study.documents(spark, d).select(C("lang").alias("context"), "doc_id")
    return P.filter_contexts(docs, ["en", "fr", "de", "es"], 2, "doc_id").groupBy("context").agg(F.count("*").alias("n"))


@query("c4_keep_available", "SELECT context, count(*) AS n FROM trials WHERE context IN (SELECT context FROM dist WHERE n > 50) GROUP BY context")
def c4(spark, d):
    return P.keep_available(study.trials(spark, d), study.dist(spark, d).where("n > 50"))[0].groupBy("context").agg(F.count("*").alias("n"))


_REASON = """, sup AS (SELECT context, token FROM dist WHERE rk NOT IN (2, 5) AND context <> 'de'), marked AS (SELECT t.*, CASE WHEN context NOT IN (SELECT context FROM sup) THEN 'context_missing'
WHEN NOT EXISTS (SELECT 1 FROM sup s WHERE s.context = t.context AND s.token = t.query) THEN 'query_missing' WHEN NOT EXISTS (SELECT 1 FROM sup s WHERE s.context = t.context AND s.token = t.trigger) THEN 'trigger_missing' END AS reason FROM trials t)"""


def _support(spark, d):
    gone = study.top(spark, d, 5).where("rk in (2, 5)").select("context", "token")
    return study.dist(spark, d).where("context <> 'de'").select("context", "token").join(F.broadcast(gone), ["context", "token"], "left_anti")


@query("c5_support_filter", "WITH one AS (SELECT 1)" + _REASON + " SELECT context, coalesce(reason, 'kept') AS reason, count(*) AS n FROM marked GROUP BY ALL")
def c5(spark, d):
    return P.with_support(study.trials(spark, d), _support(spark, d)).groupBy("context", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("c6_unique_tokens", "SELECT token, min(pos) AS first FROM words GROUP BY token")
def c6(spark, d):
    return P.unique_tokens(study.words(spark, d)).withColumn("first", C("first").cast("long"))


@query("c7_support_tables", "SELECT context, count(*) AS n FROM (SELECT DISTINCT context, token FROM words) GROUP BY context")
def c7(spark, d):
    return P.support(study.words(spark, d)).groupBy("context").agg(F.count("*").alias("n"))


@query("c8_required_tokens", "SELECT context, query AS token FROM trials UNION SELECT context, trigger FROM trials")
def c8(spark, d):
    return P.required_tokens(study.trials(spark, d))


@query("c9_missing_trials", "WITH one AS (SELECT 1)" + _REASON + " SELECT set_boundary, reason, count(*) AS n FROM marked CROSS JOIN (SELECT unnest([3, 6]) AS set_boundary) WHERE reason IS NOT NULL GROUP BY ALL")
def c9(spark, d):
    return P.missing_trials(study.trials(spark, d), _support(spark, d), [3, 6], ["set", "ordering"]).groupBy("set_boundary", "reason").agg(F.count("*").alias("n"))


@query("c10_pair_grid", "SELECT DISTINCT context, trigger, query FROM trials")
def c10(spark, d):
    return P.pair_grid(study.trials(spark, d), 30)


_HKEY = "CASE WHEN length(t) <= 3 THEN t WHEN t LIKE '%ies' AND length(t) > 4 THEN t[:-4] || 'y' WHEN regexp_matches(t, '(ss|sh|ch|x|z)es$') THEN t[:-3] WHEN t LIKE '%s' AND NOT regexp_matches(t, '(ss|us|is)$') THEN t[:-2] ELSE t END"


@query("c11_human_words", f"SELECT DISTINCT context, t AS human_word, {_HKEY} AS word_key FROM (SELECT context, query AS t FROM pairs UNION SELECT context, trigger FROM pairs)")
def c11(spark, d):
    return P.human_words(study.pairs(spark, d))


@query("c12_best_by", "SELECT lang, source, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS k FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)) WHERE k = 1")
def c12(spark, d):
    n = study.documents(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"))
    return P.best_by(n, ["lang"], [F.desc("n"), F.asc("source")])


@query("c13_missing_words", f"SELECT DISTINCT context, t AS human_word, {_HKEY} AS word_key FROM (SELECT context, query AS t FROM pairs WHERE rq > 2)")
def c13(spark, d):
    human = P.human_words(study.pairs(spark, d))
    return P.missing_words(human, P.human_words(study.pairs(spark, d).where("rq <= 2 and rt <= 2"))).select("context", "human_word", "word_key")


@query("c14_drop_overlap", "WITH x AS (SELECT DISTINCT context, token AS word, source IN ('src1', 'src2') AS positive FROM model_counts WHERE source IN ('src1', 'src2', 'src3')) SELECT context, word, positive::INT AS positive FROM x WHERE positive OR NOT EXISTS (SELECT 1 FROM x y WHERE y.positive AND y.context = x.context AND y.word = x.word)")
def c14(spark, d):
    x = study.model_counts(spark, d).where("source in ('src1', 'src2', 'src3')").select("context", C("token").alias("word"), C("source").isin("src1", "src2").alias("positive")).distinct()
    return P.drop_overlap(x).withColumn("positive", C("positive").cast("int"))


@query("c15_target_words", "SELECT DISTINCT query AS token, '1gram' AS kind FROM pairs")
def c15(spark, d):
    return P.target_words(study.pairs(spark, d))


@query("c16_align_sources", "SELECT source, count(*) AS n FROM model_counts m WHERE source <> 'src2' OR EXISTS (SELECT 1 FROM model_counts r WHERE r.source = 'src1' AND r.context = m.context AND r.token = m.token) GROUP BY source")
def c16(spark, d):
    m = study.model_counts(spark, d).select("source", "context", C("token").alias("trigger"), C("token").alias("query"))
    return P.align(m, "src1", "src2").groupBy("source").agg(F.count("*").alias("n"))


@query("c17_attach_prompts", "SELECT context, trigger, query, 'Prompt ' || context AS prompt FROM pairs")
def c17(spark, d):
    prompts = study.documents(spark, d).select(C("lang").alias("context")).distinct().withColumn("prompt", F.concat(F.lit("Prompt "), "context"))
    return P.attach_prompts(study.pairs(spark, d).select("context", "trigger", "query"), prompts)


# ---------------------------------------------------------------- D: distributions

_RESP = "WITH resp AS (SELECT lang AS context, doc_id AS participant, regexp_extract_all(lower(text), '[a-z]+')[1] AS word, source FROM documents WHERE len(regexp_extract_all(lower(text), '[a-z]+')) > 0)"
_CLOZE = _RESP + """, people AS (SELECT context, count(DISTINCT participant) AS n FROM resp GROUP BY context), cloze AS (SELECT r.context, word, count(*) AS frequency, count(*) / any_value(p.n)::DOUBLE AS cloze_probability FROM resp r JOIN people p USING (context) GROUP BY r.context, word)"""


@study.once("responses")
def responses(spark, d):
    """Each document's first word as a participant's answer."""
    w = F.element_at(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), 1)
    return study.documents(spark, d).where(F.lower("text").rlike("[a-z]")).select(C("lang").alias("context"), C("doc_id").alias("participant"), w.alias("word"), "source")


@query("d1_cloze_positive", _CLOZE + " SELECT * FROM cloze")
def d1(spark, d):
    return V.cloze_positive(responses(spark, d))


@query("d2_cloze_negative", _CLOZE + """, neg AS (SELECT context, word, count(*) AS frequency FROM resp WHERE source = 'src0' GROUP BY ALL), cap AS (SELECT context, min(cloze_probability) - 1e-12 AS cap FROM cloze WHERE cloze_probability > 0 GROUP BY context)
SELECT context, word, frequency, CASE WHEN cap > 0 THEN greatest(0, 1 - frequency / max(frequency) OVER (PARTITION BY context)) * cap ELSE 0 END AS cloze_probability FROM neg LEFT JOIN cap USING (context)""")
def d2(spark, d):
    neg = responses(spark, d).where("source = 'src0'").groupBy("context", "word").agg(F.count("*").alias("frequency"))
    return V.cloze_negative(neg, d1(spark, d))


@query("d3_merge_cloze", _CLOZE + " SELECT context, word[1:3] AS word_key, sum(frequency)::BIGINT AS frequency, sum(cloze_probability) AS cloze_probability, max_by(word, (cloze_probability, word)) AS label FROM cloze GROUP BY context, word[1:3]")
def d3(spark, d):
    return V.merge_cloze(d1(spark, d).withColumn("word_key", F.substring("word", 1, 3)))


@query("d4_restrict_cloze", _CLOZE + """, w AS (SELECT context, CASE WHEN length(word) > 6 THEN word || ' b c' ELSE word END AS word, cloze_probability FROM cloze) SELECT context, word, cloze_probability / sum(cloze_probability) OVER (PARTITION BY context) AS p, 1 AS sources FROM w WHERE word NOT LIKE '% % %'""")
def d4(spark, d):
    long = d1(spark, d).withColumn("word", F.when(F.length("word") > 6, F.concat("word", F.lit(" b c"))).otherwise(C("word")))
    return V.restrict_cloze(long, 2)


@query("d5_cloze_source", _CLOZE + " SELECT context, word AS token, cloze_probability / sum(cloze_probability) OVER (PARTITION BY context) AS weight FROM cloze")
def d5(spark, d):
    return V.cloze_source(d1(spark, d))


def _global(spark, d):
    return study.global_dist(spark, d).withColumnRenamed("n", "count")


_NEED = "WITH need AS (SELECT DISTINCT query AS token FROM pairs UNION SELECT 'zzzz')"


@query("d6_frequency_required", _NEED + " SELECT token, coalesce(n, 0) AS weight FROM need LEFT JOIN global_dist USING (token)")
def d6(spark, d):
    return V.frequency_source(_global(spark, d), _need(spark, d), keep_zero=True)


def _need(spark, d):
    return study.pairs(spark, d).select(C("query").alias("token")).unionByName(study.documents(spark, d).select(F.lit("zzzz").alias("token")).distinct())


@query("d7_background_plus_required", _NEED + ", top AS (SELECT token, n FROM global_dist ORDER BY n DESC, token LIMIT 30) SELECT token, n AS weight FROM top UNION ALL SELECT token, n FROM need JOIN global_dist USING (token) WHERE token NOT IN (SELECT token FROM top)")
def d7(spark, d):
    return V.frequency_source(_global(spark, d), _need(spark, d), background=30)


@query("d8_capped_frequency", "SELECT token, n AS weight FROM global_dist ORDER BY n DESC, token LIMIT 25")
def d8(spark, d):
    return V.frequency_source(_global(spark, d), _need(spark, d), cap=25)


@query("d9_logprob_source", "SELECT context, token, exp(logprob) / sum(exp(logprob)) OVER (PARTITION BY context) AS weight FROM scores s WHERE token IN (SELECT token FROM dist x WHERE x.context = s.context AND (x.rk <= 12 OR x.rk = 40))")
def d9(spark, d):
    return V.logprob_source(study.scores(spark, d), 12, study.top(spark, d, 40).where("rk = 40"))


@query("d10_uniform_source", "SELECT context, count(*) AS n, least(1.0, 10 / count(*)::DOUBLE) AS p_set, 0.5 AS p_above FROM counts GROUP BY context")
def d10(spark, d):
    return V.uniform_source(study.counts(spark, d), 10)


@query("d11_unigram_vocab", "WITH least AS (SELECT min(n) AS m FROM global_dist WHERE token IN (SELECT query FROM pairs)) SELECT token, n AS count, row_number() OVER (ORDER BY n DESC, token) AS line FROM global_dist, least WHERE n >= m")
def d11(spark, d):
    return V.vocab_at_least(_global(spark, d), study.pairs(spark, d).select(C("query").alias("token")))


@query("d12_bigram_vocab", _GRAMS + ", least AS (SELECT min(count) AS m FROM (SELECT count FROM gbi ORDER BY count DESC, token LIMIT 40)) SELECT token, count, row_number() OVER (ORDER BY count DESC, token) AS line FROM gbi, least WHERE count >= m")
def d12(spark, d):
    counts = gbi(spark, d)
    return V.vocab_at_least(counts, counts.orderBy(F.desc("count"), "token").limit(40))


@query("d13_bigram_scores", _GRAMS + " SELECT g.token, g.count, g.count / u.count::DOUBLE AS score FROM gbi g JOIN guni u ON u.token = split_part(g.token, ' ', 1)")
def d13(spark, d):
    return V.bigram_scores(gbi(spark, d), study.first_words(spark, d))


_BACK = _GRAMS + """, sc AS (SELECT g.token, g.count, g.count / u.count::DOUBLE AS score FROM gbi g JOIN guni u ON u.token = split_part(g.token, ' ', 1)),
back AS (SELECT token, count, score, row_number() OVER (ORDER BY score DESC, count DESC, token) AS background_rank FROM (SELECT * FROM sc ORDER BY score DESC, count DESC, token DESC LIMIT 50))"""


@query("d14_background_bigrams", _BACK + " SELECT token, count, score, background_rank FROM back")
def d14(spark, d):
    return V.background_bigrams(d13(spark, d), 50)


_BUDGET = _BACK + """, req AS (SELECT DISTINCT context, query AS token FROM pairs), fam AS (SELECT p.context, s.token, s.score FROM (SELECT DISTINCT context, trigger FROM pairs) p JOIN sc s ON split_part(s.token, ' ', 1) = p.trigger),
u AS (SELECT context, token, 0 AS s, NULL::DOUBLE AS o FROM req UNION ALL SELECT context, token, 1, -score FROM fam UNION ALL SELECT context, token, 2, background_rank FROM (SELECT DISTINCT context FROM req), back),
f AS (SELECT context, token, min(s) AS s, min_by(o, s) AS o FROM u GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY s, o, token) AS line_no FROM f)
SELECT context, token, CASE s WHEN 0 THEN 'required' WHEN 1 THEN 'family' ELSE CASE WHEN o <= 10 THEN 'background_core' ELSE 'background_overflow' END END AS selection_source, line_no FROM k WHERE line_no <= """


@query("d15_budgeted_selection", _BUDGET + "2000")
def d15(spark, d):
    return _selection(spark, d, 2000, exact=False)


@query("d15_exact_budget", _BUDGET + "50")
def d15_exact(spark, d):
    return _selection(spark, d, 50)


def _selection(spark, d, budget, exact=True):
    need = study.pairs(spark, d).select("context", C("query").alias("token")).distinct()
    first = study.pairs(spark, d).select("context", C("trigger").alias("w1")).distinct()
    begins = F.substring_index("token", " ", 1).alias("w1")
    shown = gbi(spark, d).join(F.broadcast(first.select("w1").distinct()), begins == C("w1"), "left_semi")  # before scores are joined to all pairs
    family = V.bigram_scores(shown, guni(spark, d)).withColumn("w1", begins).join(F.broadcast(first), "w1").select("context", "token", "score")
    scored = V.bigram_scores(gbi(spark, d), guni(spark, d))
    return V.select_bigrams(need, family, V.background_bigrams(scored, 50), budget, 10, exact)


@query("d16_vocab_union", "SELECT token, max(n) AS count, row_number() OVER (ORDER BY token) AS line FROM counts GROUP BY token")
def d16(spark, d):
    return V.union_vocab(study.counts(spark, d).withColumnRenamed("n", "count"))


@query("d17_fill_counts", "SELECT token, n AS count FROM global_dist WHERE n > 20 OR token IN (SELECT query FROM pairs)")
def d17(spark, d):
    counts = _global(spark, d)
    return V.fill_counts(counts.where("count > 20"), counts, study.pairs(spark, d).select(C("query").alias("token")))


@query("d18_support_mass", "WITH s AS (SELECT DISTINCT context, token FROM words) SELECT context, count(*) AS tokens, sum((coalesce(n, 0) > 0)::INT)::BIGINT AS positive, sum((coalesce(n, 0) <= 0)::INT)::BIGINT AS zero, sum(coalesce(n, 0))::BIGINT AS count, sum(coalesce(n, 0) / (SELECT sum(n) FROM global_dist)) AS probability FROM s LEFT JOIN global_dist USING (token) GROUP BY context")
def d18(spark, d):
    return V.support_mass(P.support(study.words(spark, d)), _global(spark, d))


@query("d19_top_words", "SELECT context, token, n AS weight, rk FROM (SELECT context, token, n, rank() OVER (PARTITION BY context ORDER BY n DESC) AS rk FROM counts) WHERE rk <= 10")
def d19(spark, d):
    return V.top_words(study.counts(spark, d).withColumnRenamed("n", "weight"), 10, ties=True)


@query("d20_word_position", "SELECT q.context, q.token, r.k - 1 AS position FROM (SELECT DISTINCT p.context, x.query AS token FROM pairs p, pairs x) q LEFT JOIN (SELECT context, token, row_number() OVER (PARTITION BY context ORDER BY n DESC, token) AS k FROM counts) r ON r.context = q.context AND r.token = q.token")
def d20(spark, d):
    asked = study.pairs(spark, d).select("context").distinct().crossJoin(study.pairs(spark, d).select(C("query").alias("token")).distinct())
    return V.word_position(study.counts(spark, d).withColumnRenamed("n", "weight"), asked)


@query("d21_available_contexts", "SELECT context, count(*) AS scored FROM scores WHERE context <> 'fr' GROUP BY context HAVING count(*) >= 60")
def d21(spark, d):
    s = study.scores(spark, d).where("not (context = 'fr' and n % 2 = 0)")
    return V.available_contexts(s, study.pairs(spark, d).select("context", C("query").alias("token")), 60)
