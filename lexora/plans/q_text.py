"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexora.functions import text as T

from .study import documents, pairs, query, table

_PHRASES = """
WITH phrases AS (
  SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '  A ' WHEN 1 THEN 'an ' WHEN 2 THEN 'My  ' WHEN 3 THEN '' WHEN 4 THEN 'a an ' ELSE ' The ' END
         || lower(o_orderpriority) || CASE o_orderkey % 5 WHEN 0 THEN ' berries' WHEN 1 THEN ' boxes' WHEN 2 THEN 'es' WHEN 3 THEN ' buses ' ELSE '  grass' END AS phrase
  FROM orders)
"""


def _phrases(spark, d):
    lead = F.expr("CASE o_orderkey % 6 WHEN 0 THEN '  A ' WHEN 1 THEN 'an ' WHEN 2 THEN 'My  ' WHEN 3 THEN '' WHEN 4 THEN 'a an ' ELSE ' The ' END")
    tail = F.expr("CASE o_orderkey % 5 WHEN 0 THEN ' berries' WHEN 1 THEN ' boxes' WHEN 2 THEN 'es' WHEN 3 THEN ' buses ' ELSE '  grass' END")
    return table(spark, d, "orders").select("o_orderkey", F.concat(lead, F.lower("o_orderpriority"), tail).alias("phrase"))


@query("b1_clean_word", _PHRASES + "SELECT o_orderkey, regexp_replace(lower(trim(phrase)), '^(a|an) ', '') AS word FROM phrases")
def b1(spark, d):
    return _phrases(spark, d).select("o_orderkey", T.clean_word(F.col("phrase")).alias("word"))


_DISPLAY = "trim(regexp_replace(regexp_replace(lower(trim(coalesce(phrase, ''))), '^(?:a|an|my)\\s+', ''), '\\s+', ' ', 'g'))"


@query("b2_normalize_display", _PHRASES + f"SELECT o_orderkey, {_DISPLAY} AS word FROM phrases")
def b2(spark, d):
    return _phrases(spark, d).select("o_orderkey", T.normalize_display(F.col("phrase")).alias("word"))


_KEY = f"""{_PHRASES}, k AS (SELECT o_orderkey, regexp_replace({_DISPLAY}, '[^a-z0-9]', '', 'g') AS k FROM phrases),
keyed AS (SELECT o_orderkey, CASE WHEN length(k) <= 3 THEN k WHEN k LIKE '%ies' AND length(k) > 4 THEN k[:-4] || 'y'
  WHEN regexp_matches(k, '(ss|sh|ch|x|z)es$') THEN k[:-3] WHEN k LIKE '%s' AND NOT regexp_matches(k, '(ss|us|is)$') THEN k[:-2] ELSE k END AS key FROM k)"""


@query("b3_match_key", _KEY + " SELECT o_orderkey, key FROM keyed")
def b3(spark, d):
    return _phrases(spark, d).select("o_orderkey", T.match_key(F.col("phrase")).alias("key"))


@query("b4_alias_canonical", _KEY + """, aliases AS (SELECT DISTINCT key, key[:5] AS canonical FROM keyed WHERE key LIKE '1%')
SELECT o_orderkey, coalesce(a.canonical, k.key) AS canonical FROM keyed k LEFT JOIN aliases a ON k.key = a.key""")
def b4(spark, d):
    from lexora.operators.trials import canonicalize

    keyed = b3(spark, d).withColumn("context", F.lit("all"))
    aliases = keyed.where("key like '1%'").select("context", "key", F.substring("key", 1, 5).alias("canonical")).distinct()
    return canonicalize(keyed, aliases).select("o_orderkey", "canonical")


@query("b5_forced_label", _KEY + """, labels AS (SELECT DISTINCT key, upper(key) AS label FROM keyed WHERE key LIKE '%berry')
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN phrase END, label, key) AS label
FROM keyed JOIN phrases USING (o_orderkey) LEFT JOIN labels USING (key)""")
def b5(spark, d):
    from lexora.operators.trials import force_label

    both = b3(spark, d).join(_phrases(spark, d), "o_orderkey").withColumn("context", F.lit("all"))
    both = both.withColumn("human", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN phrase END"))
    labels = both.where("key like '%berry'").select("context", "key", F.upper("key").alias("forced")).distinct()
    return force_label(both, labels, human="human", fallback="key").select("o_orderkey", "label")


@query("b6_ngram_kind", _PHRASES + """SELECT o_orderkey, CASE WHEN regexp_full_match(lower(trim(phrase)), '[a-z]+') THEN '1gram'
WHEN regexp_full_match(lower(trim(phrase)), '[a-z]+\\s+[a-z]+') THEN '2gram' ELSE 'unsupported' END AS kind,
CASE WHEN regexp_full_match(w, '[a-z]+(?:[''-][a-z]+)*') THEN '1gram' WHEN regexp_full_match(w, '[a-z]+(?:[''-][a-z]+)*\\s+[a-z]+(?:[''-][a-z]+)*') THEN '2gram' ELSE 'unsupported' END AS loose
FROM (SELECT *, regexp_replace(lower(trim(phrase)), '^(a|an) ', '') AS w FROM phrases)""")
def b6(spark, d):
    return _phrases(spark, d).select("o_orderkey", T.ngram_kind(F.col("phrase")).alias("kind"), T.ngram_kind(F.col("phrase"), "letters_apostrophe_hyphen", True).alias("loose"))


@query("b7_norm_text", "SELECT doc_id, sha256(trim(nfc_normalize(nfc_normalize(text) || ' '), ' ' || chr(9) || chr(10) || chr(13))) AS text_hash FROM documents")
def b7(spark, d):
    return documents(spark, d).select("doc_id", F.sha2(T.norm_text(F.concat("text", F.lit(" "))), 256).alias("text_hash"))


@query("b8_count_words", """SELECT role, w AS word, count(*) AS n FROM (SELECT role, lower(trim(unnest(string_split(text, ' ')))) AS w FROM conversations)
WHERE w NOT IN ('', 'nan', 'none', 'na', 'n/a', 'x') GROUP BY role, w""")
def b8(spark, d):
    answers = table(spark, d, "conversations").select("role", F.explode(F.split("text", " ")).alias("answer"))
    return answers.select("role", T.informative(F.col("answer")).alias("word")).where("word is not null").groupBy("role", "word").agg(F.count("*").alias("n"))


@query("b9_parse_bool", """SELECT doc_id, CASE WHEN lower(trim(q)) IN ('true', '1', 't', 'yes', 'y') THEN 1 ELSE 0 END AS lenient, toxic AS strict
FROM (SELECT doc_id, toxic, CASE doc_id % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'T' ELSE NULL END AS q FROM labels)""")
def b9(spark, d):
    q = F.expr("CASE doc_id % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'T' ELSE NULL END")
    return table(spark, d, "labels").select("doc_id", T.parse_bool(q).cast("int").alias("lenient"), T.parse_bool(F.col("toxic"), True).cast("int").alias("strict"))


@query("b10_to_number", """SELECT event_id, try_cast(x AS DOUBLE) AS number, CASE WHEN abs(try_cast(x AS DOUBLE) - round(try_cast(x AS DOUBLE))) <= 1e-9 AND round(try_cast(x AS DOUBLE)) >= 0
THEN round(try_cast(x AS DOUBLE))::BIGINT END AS whole FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'n' || event_id WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN '-' || event_id ELSE event_id || '.5' END AS x FROM events)""")
def b10(spark, d):
    x = F.expr("CASE event_id % 4 WHEN 0 THEN 'n' || event_id WHEN 1 THEN CAST(event_id AS STRING) WHEN 2 THEN '-' || event_id ELSE event_id || '.5' END")
    return table(spark, d, "events").select("event_id", T.to_number(x).alias("number"), T.to_number(x, "integer").alias("whole"))


@query("b12_pretty_name", """SELECT source, n, 'Model ' || upper(source[1]) || lower(source[2:]) || ' LLM' AS name FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def b12(spark, d):
    per = documents(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return per.withColumn("name", T.pretty_name(F.concat(F.lit("model_"), "source", F.lit("-llm"))))


@query("b13_keys", """SELECT DISTINCT context || '::' || trigger || '::' || query AS plain, '["' || context || '","' || trigger || '"]' AS json FROM pairs""")
def b13(spark, d):
    c = F.col
    return pairs(spark, d).select(T.key(c("context"), c("trigger"), c("query")).alias("plain"), T.key(c("context"), c("trigger"), style="json").alias("json")).distinct()


@query("b14_make_prompt", """SELECT context, trigger, query, 'I said: ''We only have ' || trigger || ' and [MASK].'' Then ' || query AS masked,
'We have ' || trigger || ' but not ' AS but_not FROM pairs""")
def b14(spark, d):
    prompt = F.concat(F.lit("I said: 'We only have the rest.' Then "), "query")
    return pairs(spark, d).select("context", "trigger", "query", T.make_prompt(prompt, F.col("trigger")).alias("masked"), T.make_prompt(F.lit("We have  "), F.col("trigger"), "but_not").alias("but_not"))


@query("b15_split_boundary", """SELECT item_id, rtrim(text) AS prefix, '  ' || split_part(text, ' ', 1) AS continuation FROM benchmark""")
def b15(spark, d):
    b = table(spark, d, "benchmark").select("item_id", T.split_boundary(F.concat("text", F.lit("  ")), F.substring_index("text", " ", 1)).alias("s"))
    return b.select("item_id", "s.prefix", "s.continuation")


@query("b16_fingerprint", r"""SELECT count(*) AS rows, sha256(count(*) || '|' || sum(('0x' || h[1:15])::HUGEINT) || '|' || sum(('0x' || h[16:30])::HUGEINT) || '|' || sum(('0x' || h[31:45])::HUGEINT) || '|' || sum(('0x' || h[46:60])::HUGEINT)) AS sha256
FROM (SELECT sha256(concat_ws(chr(31), coalesce(CAST(doc_id AS VARCHAR), chr(0)), coalesce(CAST(quality AS VARCHAR), chr(0)), coalesce(CAST(toxic AS VARCHAR), chr(0)))) AS h FROM labels)""")
def b16(spark, d):
    return T.fingerprint(table(spark, d, "labels").select("doc_id", "quality", "toxic"))


@query("b17_valid_word", """SELECT context, token, n FROM (SELECT *, row_number() OVER (PARTITION BY context, lower(token) ORDER BY n DESC, token) AS k FROM
(SELECT lang AS context, w AS token, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) WHERE regexp_full_match(w, '[A-Za-z]{2,}') GROUP BY lang, w)) WHERE k = 1""")
def b17(spark, d):
    from lexora.operators.trials import best_by

    raw = documents(spark, d).select(F.col("lang").alias("context"), F.explode(F.split("text", " ")).alias("token")).where(T.valid_word(F.col("token")))
    n = raw.groupBy("context", "token").agg(F.count("*").alias("n")).withColumn("low", F.lower("token"))
    return best_by(n, ["context", "low"], [F.desc("n"), F.asc("token")]).select("context", "token", "n")


